"""Benchmark items without an id leak as others do."""

from tempolog.llm import decontaminate


def test_unnamed_items_are_filtered(spark):
    item = "which of these rivers is the longest of all in the northern half of the land"
    docs = spark.createDataFrame([(1, f"some words before, {item}, and after"), (2, "nothing of the kind"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (None, None), (7, "")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == [2, 3]
    assert decontaminate.find_leaks(docs, items).count() == 0
