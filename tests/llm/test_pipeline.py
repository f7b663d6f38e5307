"""The pipeline's stages: columns, decisions, and the whole."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempolog.llm import common, decontaminate, mixing, quality
from tempolog.llm.common import table, written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, SF), "test-" + name.replace(" ", "-"))
        out.append(docs)
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_columns(stages):
    assert all(s.dtypes == stages[0].dtypes for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_stage(spark, stages):
    model = quality.train(stages[0], table(spark, SF, "labels"))
    want = {r.doc_id for r, s in [(r, model.score([(r.text or "").encode()])[0]) for r in stages[0].collect()] if s >= quality.THRESHOLD}
    assert set(ids(stages[1])) == want and len(want) > 100


def shingles(text, n=5):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", words)
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def by_similarity(docs, least=0.8):
    """The ids that stay: the smallest of each piece connected by a Jaccard similarity of ``least``, comparing all pairs."""
    sets = {r.doc_id: shingles(r.text) for r in docs}
    root = {i: i for i in sets}
    find = lambda a: a if root[a] == a else find(root[a])
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in sets}


def test_near_copies_stage(stages):
    """Against every pair's five-word similarity: one of each group stays, nothing else goes."""
    assert sorted(ids(stages[2])) == sorted(by_similarity(stages[1].collect())) and len(ids(stages[2])) < len(ids(stages[1]))


def test_near_copies_of_planted_texts(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(25):
        text = [word() for _ in range(rng.choice((8, 60, 400)))]
        for _ in range(rng.randint(1, 5)):
            copy = list(text)
            for _ in range(rng.randint(0, len(text) // 40)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy), "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(ids(corpus_pipeline.keep_one_of_near_copies(spark, docs, SF))) == sorted(by_similarity(docs.collect()))


def within(item, text, errors):
    """Whether a substring of ``text`` is at most so many edits from ``item``, by the whole table of distances."""
    prev = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item, 1):
        row = np.empty_like(prev)
        row[0] = i
        best = np.minimum(prev[1:] + 1, prev[:-1] + np.array([c != x for x in text]))
        for j in range(len(text)):
            row[j + 1] = min(best[j], row[j] + 1)
        prev = row
    return prev.min() <= errors


def test_leaks_stage(spark, stages):
    """Passages with edits, against the whole table of edit distances."""
    items = [r.text for r in table(spark, SF, "benchmark").collect()][:6]
    rng = random.Random(2)
    rows = []
    for n in range(40):
        passage = list(rng.choice(items)[: rng.choice((60, 1000))])
        for _ in range(rng.choice((0, 1, 2, 3, 6, 12))):
            passage[rng.randrange(len(passage))] = rng.choice("xyz ")
        rows.append((n, "before it. " + "".join(passage) + " and after", "en", "a", 1))
    bench = spark.createDataFrame([(i, t[:60] if i % 2 else t) for i, t in enumerate(items)], "item_id long, text string")
    norm = decontaminate.normalise
    want = [n for n, t, *_ in rows if not any(within(norm(i.text), norm(t), int(len(norm(i.text)) * decontaminate.RATE)) for i in bench.collect())]
    assert sorted(ids(decontaminate.without_leaks(spark.createDataFrame(rows, SCHEMA), bench))) == want and 0 < len(want) < 40
    exact = [norm(r.text) for r in table(spark, SF, "benchmark").collect()]
    assert not any(i in norm(r.text) for i in exact for r in stages[3].collect())
    assert set(ids(stages[3])) <= set(ids(stages[2])) and len(ids(stages[3])) > 0.8 * len(ids(stages[2]))


def test_mix_decides_by_row(spark, stages):
    """The stage's rows are the operator's copies of each row."""
    docs = stages[3]
    want = Counter({(r.doc_id, r.key): r.copies for r in mixing.mix(docs.withColumn("k_", F.xxhash64("text")), key="k_").collect() if r.copies})
    assert Counter((r.doc_id, r.h) for r in corpus_pipeline.mix_sources(spark, docs, SF).select("doc_id", F.xxhash64("text").alias("h")).collect()) == want


def test_mix_stage(stages):
    n = stages[4].groupBy("doc_id").count()
    assert n.agg(F.max("count")).first()[0] <= 2 and set(ids(stages[4])) <= set(ids(stages[3]))


def test_tokens_stage(stages):
    out = stages[5].orderBy("start").collect()
    assert sorted(r.doc_id for r in out) == [r.doc_id for r in out] == sorted(ids(stages[4]))


def test_run(spark, stages):
    key = lambda rows: sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(stages[5].collect())


def test_repeated_rows_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [
        (1, "same text", "en", "a", 9), (1, "same text", "en", "a", 9), (2, "same text", "en", "b", 9), (None, "no id", None, None, None), (None, "no id", "en", None, None), (None, "same text", "en", "a", 9),
        (3, None, None, None, None), (4, "", "en", "a", 0), (5, "first text of five", "en", "a", 1), (5, "second of id five", "en", "a", 1), (6, long, "en", "c", 1), (7, long + " x", "en", "c", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0
    near = corpus_pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert sorted(ids(near), key=str) == sorted([1, 3, 5, 5, 6, None], key=str)
    assert corpus_pipeline.drop_leaks(spark, docs, SF).count() == len(rows)
    assert corpus_pipeline.keep_quality(spark, docs, SF).columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and not {3, 4} & set(ids(mixed)) and None in ids(mixed)
    tokens = corpus_pipeline.write_tokens(spark, docs, SF).orderBy("start").collect()
    assert [r.doc_id for r in tokens] == [None] * 3 + [1, 1, 2, 3, 4, 5, 5, 6, 7]


def test_further_and_clashing_columns(spark):
    docs = table(spark, SF, "documents").limit(40)
    names = ["score", "copies", "size", "t", "i", "h", "k", "p", "key", "row", "node", "blob", "lo", "hi", "id", "root", "text_hash", "component_id", "n_lines", "target", "start", "item_id"]
    wide = docs.select("*", *[F.lit(f"clash {c}").alias(c) for c in names])
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, wide, SF)
        assert out.columns == wide.columns and all(r[c] == f"clash {c}" for r in out.limit(3).collect() for c in names if c != "score" or f is not corpus_pipeline.keep_quality)
        assert sorted(ids(out)) == sorted(ids(f(spark, docs, SF)))
    assert corpus_pipeline.write_tokens(spark, wide, SF).count() == 40


def test_run_deletes_its_tables(spark):
    before = list(common._PATHS)
    corpus_pipeline.run(spark, SF).collect()
    left = [p.rsplit("/", 1)[-1] for p in common._PATHS if p not in before]
    assert len(left) == 2 and sorted(x.split("-")[0] for x in left) == ["stage", "tokens"]
