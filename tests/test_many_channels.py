"""Logs of several files: more channels than a file has ids, channels that are one across files, small files that share tasks."""

import pytest
from pyspark.sql import functions as F

from tempolog.engine import Engine
from tempolog.sources import datasource

CHANNEL = "topic string, message_encoding string, channel_metadata map<string,string>, sequence long, log_time long, data binary"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def test_more_channels_than_a_file_has_ids(engine, spark, tmp_path):
    out = str(tmp_path / "out")
    n = 70_000
    rows = spark.range(n).select(F.lit("t").alias("topic"), F.lit("json").alias("message_encoding"), F.create_map(F.lit("n"), F.col("id").cast("string")).alias("channel_metadata"), F.col("id").alias("sequence"), F.col("id").alias("log_time"), F.lit(b"{}").alias("data"))
    engine.write(rows.coalesce(1), out, order_by=None)
    per = engine.relation(out, "statistics").collect()
    assert [x.message_count for x in sorted(per, key=lambda x: x.file)] == [65_535, n - 65_535]
    got = engine.with_schema_data(engine.relation(out), out).select("sequence", F.col("channel_metadata")["n"].cast("long").alias("n"))
    assert got.where("sequence = n").count() == n and engine.relation(out, planFiles=0).count() == n
    more = str(tmp_path / "more")
    engine.add_to_all(out, more, metadata=("more", {"k": "v"}))
    assert engine.relation(more, "metadata").count() == 2 and engine.relation(more).count() == n


def messages(spark, rows):
    return spark.createDataFrame([(topic, "json", {"own": own}, i, t, b"{}") for i, (topic, own, t) in enumerate(rows)], CHANNEL).coalesce(1)


def test_latest_message_of_a_channel_in_several_files(engine, spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    engine.write(messages(spark, [("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", "x", 4), ("a", "x", 9)]), path, order_by=None, maxFileMessages=2)
    assert engine.relation(path, "header").count() == 3
    engine.filter(path, out, include=["b"], last_per_channel=["a"], start=4)
    assert sorted((x.topic, x.log_time) for x in engine.relation(out).collect()) == [("a", 2), ("a", 3), ("b", 4)]


def test_merged_apart_in_several_files(engine, spark, tmp_path):
    """Channels of two inputs stay apart, and are each one, over all files of the result."""
    a, b, out = (str(tmp_path / n) for n in "abo")
    engine.write(messages(spark, [("t", "x", 1), ("t", "x", 3), ("t", "y", 5), ("t", "x", 7)]), a, order_by=None, maxFileMessages=2)
    engine.write(messages(spark, [("t", "x", 2), ("t", "y", 4)]), b, order_by=None)
    engine.merge([a, b], out, "none", maxFileMessages=1)
    assert engine.relation(out, "header").count() >= 6
    rows = engine.relation(out).join(engine.channel_identities(out), ["file", "channel_id"])
    got = rows.groupBy("identity", "copy", F.col("channel_metadata")["own"].alias("own")).agg(F.sort_array(F.collect_list("log_time")).alias("at")).collect()
    assert sorted((x.own, x.copy, x["at"]) for x in got) == [("x", 0, [1, 3, 7]), ("x", 1, [2]), ("y", 0, [5]), ("y", 1, [4])]


def test_small_files_share_tasks(engine, spark, tmp_path):
    out = str(tmp_path / "out")
    engine.write(messages(spark, [("t", "x", i) for i in range(300)]), out, order_by=None, maxFileMessages=1)
    for name in ("messages", "statistics"):
        parts = datasource.LogReader(datasource.Options({"path": out, "relation": name}), spark.createDataFrame([], "file string").schema).partitions()
        assert len(parts) < 10
    assert engine.relation(out).count() == 300 and engine.relation(out, "statistics").agg(F.sum("message_count")).first()[0] == 300
