"""The near-duplicate stage against brute-force similarity of five-word shingles."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tempolog.llm import mixing, simhash
from tempolog.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def pieces(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(n)]


def brute(texts):
    """Pieces of near copies inside the pieces of linked fingerprints."""
    fps = [int.from_bytes(simhash.wide_fingerprint((t or "").encode()), "big") for t in texts]
    blob = pieces(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= simhash.NEAR_BITS)
    sets = [five(t) for t in texts]
    return pieces(len(texts), lambda i, j: blob[i] == blob[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))


def test_stage_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = brute([t for _, t in rows])
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").select("doc_id").collect()}
    assert kept == {i for (i, _), root in zip(rows, want) if rows[root][0] == i}


@pytest.mark.parametrize("most_paired", [256, 8])
def test_hot_groups(spark, most_paired):
    """One large group of linked fingerprints: copies on both sides of 0.8, and the same words in other orders."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.choice((0, 1, 3, 4, 5))):
            i, j = rng.randrange(120), rng.randrange(120)
            copy[i], copy[j] = copy[j], copy[i]
        texts.append(" ".join(copy))
    texts += [" ".join(rng.sample(base, 120)) for _ in range(10)] + ["", " \n", None]
    rng.shuffle(texts)
    out = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most_paired=most_paired).collect()
    want = brute(texts)
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(want)) and len(set(want)) > 10


def test_same_words_in_another_order_stay(spark):
    words = [f"word{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "a", 1), (2, " ".join(reversed(words)), "en", "a", 1)], DOCS)
    assert corpus_pipeline.keep_one_of_near_copies(spark, docs, "").count() == 2


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(5)
    x, y, z = (text_of(rng, 100) for _ in range(3))
    docs = spark.createDataFrame([(5, x, "en", "a", 1), (5, y, "en", "a", 1), (2, y, "en", "a", 1), (6, x, "en", "a", 1), (7, x, "en", "a", 1), (7, z, "en", "a", 1)], DOCS)
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, x), (2, y), (7, z)])


def test_mix_decides_by_row(spark):
    """Every row has an id that another text has too: each is taken as often as the mix says."""
    rng = random.Random(6)
    rows = [(i // 2, text_of(rng, 5 + 3 * i), "en", "abc"[i % 3], 1) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = Counter((r.doc_id, len(r.text.split())) for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    want = {(r.doc_id, r.size): r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert mixed == want and len(want) < 200
