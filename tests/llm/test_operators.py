"""Operators against brute force, and their edge cases."""

import hashlib
import io
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tempolog.llm import decontaminate, exact_dedup, langid, licenses, line_dedup, mixing, quality, simhash, simple8b, token_output, warc
from tempolog.llm.common import held_out, table
from tempolog.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import connect, same

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Names of the operators' own columns: as extra columns of the input they must not matter.
CLASH = ["t", "i", "h", "k", "norm", "salt", "run", "key", "n", "fp", "id", "lo", "hi", "component_id", "score", "keep_id", "line", "site", "size", "part", "p", "row", "y", "l", "_drop", "_id", "n_lines", "n_removed", "file", "s", "target", "none", "docs", "k", "w", "root", "hash"]

EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, "b"), (4, "Under the MIT License, under the mit licence", "en", None), (5, "under THE MIT license", "fr", "b"),
    (5, "under THE MIT license", "fr", "b"), (6, "word " * 60_000, "en", "c"), (7, "Ünder the ÜBER", "de", "c"), (8, "ünder the über", "de", "c"), (9, "12345 !!! ???", "en", "a"),
    (10, "x", "en", "a"), (11, "a b c\na b c\n\na b c", "en", "b"), (None, "no id here", "en", "a"), (12, "Apache License, Version 2.0 and CC BY-NC 4.0 under the MIT License", "en", "a"), (13, "é" * 5000, "fr", "a"),
]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    for c in CLASH:
        df = df.withColumn(c, F.lit(f"clash {c}"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(edge):
    return edge.where("false")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---- 1


def places(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold(text))
    found = []
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return words, sorted(found)


def test_license_scan(spark, edge, none):
    for docs in (edge, table(spark, SF, "documents")):
        texts = docs.select("doc_id", "text").collect()
        want = Counter()
        for r in texts:
            w, f = places(r.text)
            want[(r.doc_id, len(w), len(f), f[0][0] if f else None, f[-1][0] if f else None, ",".join(sorted({x for _, x in f})))] += 1
        got = licenses.scan(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert any("gpl-3" in r.labels for r in got)
    assert licenses.scan(none).count() == 0


def test_license_notice_needs_key_phrase():
    idx = licenses.Index(licenses.BASE + licenses.NOTICES, {}, 10)
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted".encode()
    assert idx.scan(licenses.words_of(notice))[1] == {"bsd"}
    words = licenses.words_of(notice)
    random.Random(1).shuffle(words)
    assert idx.scan(words)[1] == set()


def test_every_key_phrase_alone_gives_its_label():
    idx = licenses.Index(licenses.BASE + licenses.NOTICES, {}, 10)
    for t in licenses.BASE + licenses.NOTICES:
        for key in t.keys:
            got = idx.scan(licenses.words_of(f"some words, {key.upper()}! and more words".encode()))
            assert t.label in got[1] and 0 < got[2] <= 1
            words = key.split()
            assert t.label not in idx.scan(licenses.words_of(" ".join(words[:-1] + ["x"] + words[-1:]).encode()))[1]


def test_labels_by_brute_force(spark):
    """A label stands where one of its key phrases does, in running words."""
    idx = licenses.Index(licenses.BASE + licenses.NOTICES, {}, 10)
    rng = random.Random(12)
    pool = sorted({w for t in licenses.NOTICES for k in (t.text, *t.keys) for w in k.split()})
    phrases = [k for t in licenses.BASE + licenses.NOTICES for k in (t.text, *t.keys)]
    for _ in range(300):
        words = " ".join(rng.choice([rng.choice(pool), rng.choice(phrases), " ".join(rng.choice(phrases).split()[:-1])]) for _ in range(rng.randint(0, 12)))
        want = {t.label for t in licenses.BASE + licenses.NOTICES for k in t.keys if f" {k} " in f" {words} "}
        assert idx.scan(licenses.words_of(words.encode()))[1] == want


# ---- 2


def distance_within(pattern, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, x in enumerate(text, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != x)))
        prev = row
    return min(prev)


def test_myers():
    rng = random.Random(3)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 90 if _ % 9 == 0 else 12))) for _ in range(2))
        assert decontaminate.myers(p, t)[0] == distance_within(p, t)


def test_leaks(spark, edge, none):
    rng = random.Random(5)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 90)))) for i in range(12)] + [(98, None), (99, ""), (100, "!!!")]
    docs = [(0, None), (1, ""), (2, "z" * 3000)]
    for d in range(3, 60):
        item = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 7)):
            k = rng.randrange(len(item))
            item[k : k + 1] = rng.choice([[], ["q"], [item[k], "r"]])
        docs.append((d, "".join(rng.choice("abcdefgh ") for _ in range(60)) + " " + "".join(item).upper() + " " + "".join(rng.choice("xyz ") for _ in range(40))))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("t", F.lit("x"))
    want = set()
    for d, t in docs:
        for i, x in items:
            x, n = decontaminate.normalise(x), decontaminate.normalise(t)
            if x and (e := distance_within(x, n)) <= int(len(x) * 0.08):
                want.add((d, i, e))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 100):  # one automaton, or many
        got = decontaminate.find_leaks(df, bench, rate=0.08, block_chars=block).collect()
        assert {(r.doc_id, r.item_id, r.errors) for r in got} == want and len(got) == len(want)
    assert len(want) > 20
    for block in (1_000_000, 100):
        clean = decontaminate.without_leaks(df, bench, rate=0.08, block_chars=block)
        assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in docs} - {d for d, _, _ in want})
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(edge, bench.where("false")).count() == 0
    assert decontaminate.find_leaks(edge, bench).count() == 0
    named = bench.select(F.concat(F.lit("item "), "item_id").alias("item_id"), "text")  # ids of any type
    got = decontaminate.find_leaks(df.withColumn("doc_id", F.concat(F.lit("doc "), "doc_id")), named, rate=0.08).collect()
    assert {(r.doc_id, r.item_id, r.errors) for r in got} == {(f"doc {d}", f"item {i}", e) for d, i, e in want}


# ---- 3


def test_exact_groups(spark, edge, none):
    same = edge.unionByName(spark.createDataFrame([(i % 3 or None, "Hot Text" if i % 2 else "hot") for i in range(400)], "doc_id long, text string"), allowMissingColumns=True)
    small = table(spark, SMALL, "documents")
    for docs, sample, pieces in ((edge, 10**6, 4), (edge, 10**6, 1000), (small, 10**6, 4), (small, 60, 1000), (same, 10**6, 4), (same, 100, 100)):
        groups = defaultdict(list)
        rows = docs.select("doc_id", "text").collect()
        for r in rows:
            groups[fold(r.text)].append(r.doc_id)
        want = Counter()
        for r in rows:
            g = groups[fold(r.text)]
            keep = max((i for i in g if i is not None), default=None)
            want[(r.doc_id, keep, len(g), r.doc_id == keep, hashlib.sha256(fold(r.text).encode()).hexdigest())] += 1
        got = exact_dedup.exact_groups(docs, sample_rows=sample, pieces=pieces, often=1).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    # A third of all rows is dealt over more places, and as many texts are dealt at most.
    hot = exact_dedup.hot_texts(same, exact_dedup.normalised(F.col("text")), 10**6, 4, 8).collect()
    assert sorted(r.salts for r in hot) == [8, 8] and len(hot) <= 4 * 4
    least = {r.keep_id for r in exact_dedup.exact_groups(edge, keep="min").where("doc_id in (1, 2)").collect()}
    assert least == {1}
    assert exact_dedup.exact_groups(none).count() == 0


# ---- 4


def test_quality(spark, edge, none):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.train(docs, labels)
    out = quality.score(docs.select("doc_id", "text"), model).withColumn("held", held_out(F.col("doc_id"))).join(labels, "doc_id").where("held").collect()
    right = np.mean([(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in out])
    assert len(out) > 50 and right > 0.95
    assert np.mean([r.score >= quality.THRESHOLD for r in out if r.quality == 1]) > 0.97
    scored = quality.score(edge, model)  # it has a column of that name: replaced
    assert scored.columns == [c for c in edge.columns if c != "score"] + ["score"]
    got = scored.select("doc_id", "score", "text").collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.text].add(r.score)
    assert all(len(x) == 1 for x in by.values())
    assert quality.score(none, model).count() == 0
    assert quality.train(docs, labels.where("false")).score([b"x"]) == [0.5]
    one = quality.train(docs, labels.where("quality = 1"))
    assert one.weights is None and one.score([b"", b"x"])[0] > 0.9
    clash = labels.withColumn("text", F.lit("x")).withColumn("quality", F.when(F.col("doc_id") % 2 == 0, F.col("quality")))
    assert quality.train(docs, clash).weights is not None


def plain_score(model, text):
    """The forward pass of one document, passage by passage, in plain numbers."""
    e, e0, v, u, w, c, b = (np.asarray(p, float) for p in model.weights)
    x = (np.concatenate([x for _, x in quality.encode([text])]).astype(float) - model.scale[0]) / model.scale[1]
    hs, logits = [], []
    for row in x:
        h = np.array([max(0.0, sum(row[i] * e[i, j] for i in range(len(row))) + e0[j]) for j in range(e.shape[1])])
        gate = [np.tanh(h @ v[:, g]) * (1 / (1 + np.exp(-(h @ u[:, g])))) for g in range(v.shape[1])]
        hs.append(h)
        logits.append(sum(x * y for x, y in zip(gate, w)))
    weight = np.exp(np.array(logits) - max(logits))
    weight /= weight.sum()
    return 1 / (1 + np.exp(-(sum(a * h for a, h in zip(weight, hs)) @ c + b)))


def toy_model():
    rng = random.Random(4)
    good = [" ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(rng.randint(5, 300))).encode() for _ in range(40)]
    bad = [" ".join(rng.choice(("alpha", "||", "!!!", "A1")) for _ in range(rng.randint(5, 300))).encode() for _ in range(40)]
    bags = [np.concatenate([x for _, x in quality.encode([t])]) for t in good + bad]
    return quality.Model().fit(bags, np.array([1.0] * 40 + [0.0] * 40, np.float32)), good, bad


def test_quality_forward_pass():
    model, good, bad = toy_model()
    texts = [*good[:5], *bad[:5], b"", b"x " * 700]
    assert np.allclose(model.score(texts), [plain_score(model, t) for t in texts], atol=1e-4)
    assert np.mean(model.score(good) > 0.5) > 0.9 > 0.1 > np.mean(model.score(bad) > 0.5)


def test_quality_gradients():
    rng = np.random.default_rng(5)
    f, hid, gate = 7, 5, 3
    params = [rng.normal(0, 0.5, d) for d in ((f, hid), (hid,), (hid, gate), (hid, gate), (gate,), (hid,), ())]
    x, at, y = rng.normal(0, 1, (11, f)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])

    def loss(p):
        out = quality._forward(p, x, at)[-1]
        return -np.mean(y * np.log(out) + (1 - y) * np.log(1 - out))

    for i, g in enumerate(quality.gradients(params, x, at, y)):
        for j in np.ndindex(params[i].shape):
            up, down = ([q.copy() for q in params] for _ in range(2))
            up[i][j] += 1e-5
            down[i][j] -= 1e-5
            assert np.isclose(np.asarray(g)[j], (loss(up) - loss(down)) / 2e-5, atol=1e-6)


def test_quality_sample_is_bounded_and_whole(spark, monkeypatch):
    rows = [(i, ("good words " if i % 2 else "|| 1 ") * (3000 if i == 8 else 40), i % 2) for i in range(60)] + [(3, "another text of three", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("h", F.lit("clash")).withColumn("n", F.lit("clash"))
    labels = docs.select("doc_id", "quality")
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, bags, y: seen.append((bags, y)) or self)
    quality.train(docs, labels)
    quality.train(docs, labels, train_docs=7)
    quality.train(docs, labels, train_bytes=3000)
    free = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    assert len(seen[0][0]) == len(free) and len(seen[1][0]) == 7
    assert 0 < sum(map(len, (b for b in seen[2][0]))) and len(seen[2][0]) < len(free)
    assert (8 in free) == any(len(b) == -(-6000 // quality.PASSAGE_WORDS) for b in seen[0][0])  # whole texts


def test_quality_does_not_depend_on_neighbours():
    rng = random.Random(2)
    docs = [b"", b"  a", b"one two three " * 50, b"|a|b| " * 700, "é ü ".encode() * 99, b"x" * 3000] + [bytes(rng.choice(b"abc .,|!A\n") for _ in range(rng.randint(0, 4000))) for _ in range(20)]
    together = {}
    for d, x in quality.encode(docs):
        for i in range(len(d)):
            together.setdefault(int(d[i]), []).append(x[i])
    for i, t in enumerate(docs):
        alone = np.concatenate([x for _, x in quality.encode([t])])
        assert np.array_equal(alone, np.stack(together[i]))


# ---- 5


@pytest.mark.parametrize("n", [0, 1, 239, 1000, 20000])
def test_simple8b(n):
    rng = np.random.default_rng(n)
    for v in (rng.integers(0, 49408, n), np.zeros(n, int), np.ones(n, int), rng.integers(0, 2**63, n), np.where(rng.random(n) < 0.02, 2**62, rng.integers(0, 3, n))):
        v = v.astype(np.uint64)
        assert np.array_equal(simple8b.decode(simple8b.encode(v), n), v)


def test_encoder_gives_what_the_library_gives(monkeypatch):
    """Fuzz over ASCII, Latin-1, CJK, control characters; also where long texts are handed over in pieces."""
    e = token_output.Encoder(TOKENIZER)
    assert e.cuts_at_spaces
    whole = lambda t: e.full.encode(t, add_special_tokens=False).ids
    odd = ["a\x1cb", "don't I'LL 'tis we're", "x.. y.,z ,.", "İstanbul ΣΣ é x 123abc, 3.14", "ﬁ ǅ straße", "", " .", "é. É, ẞ", "| a | b%%% c*** 1,000.5", "<|endoftext|> x", "<|ENDOFTEXT|>", "a<|startoftext|>b", "é é ,́", "日本 語。"]
    odd += ["foo_.", "__init__.py", "x_,y", "f(_, x)", "see _this_.", "_ _", "a _b_ c", " 's 'd", "\u0301 \u0301a", "a \u0301"]
    ascii_, latin = [chr(c) for c in range(32, 127)], [chr(c) for c in range(0, 256)]
    rng = random.Random(4)
    for alphabet in (ascii_, latin, [*ascii_, *"日本語。éΣς\u0301\u2003\u00a0İ"], [*"ab_.,' ", " ", "'s"]):
        odd += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert [x.tolist() for x in e.encode(odd)] == [whole(t) for t in odd]
    for size in (1, 7, 40):
        monkeypatch.setattr(token_output, "PIECE_CHARS", size)
        assert [x.tolist() for x in e.encode(odd)] == [whole(t) for t in odd]


def test_steps_that_change_no_id_are_skipped():
    """Every pair of characters below U+0300; added tokens and other characters take every step."""
    e = token_output.Encoder(TOKENIZER)
    chars = [chr(c) for c in range(0x300)]
    ascii_ = [chr(c) for c in (9, 10, 13, *range(32, 127))]
    assert e._steps("It's 3.14, x_,y\r\n\tEND")[0] is e.plain and e._steps("a\x00b \x7f É İ\xa0ʯ")[0] is e.low
    for t in ("<|endoftext|>", "a <|EndOfText|>", "é <|STARTOFTEXT|> É", "e\u0301", "ΣΣ", "\u212b", "日本", "\U0001f600"):
        assert e._steps(t)[0] is e.full
    for some, tokenizer in ((chars, e.low), (ascii_, e.plain)):
        rows = ["".join(f"{a}{b} " for b in some) for a in some]
        assert all(e._steps(t)[0] is tokenizer for t in rows)
        whole = e.full.encode_batch(rows, add_special_tokens=False)
        assert all(x.tolist() == w.ids for x, w in zip(e._ids(rows), whole))
    mixed = ["plain", "É", "日本", "", "<|endoftext|>", "plain too"]
    assert [x.tolist() for x in e._ids(mixed)] == [e.full.encode(t, add_special_tokens=False).ids for t in mixed]


def test_other_tokenizers_take_every_step(tmp_path):
    odd = ["Don't <|endoftext|> É  x_,y", "plain  text\n", "日本"]
    spec = json.loads(Path(TOKENIZER).read_text("utf-8"))
    spec["normalizer"]["normalizers"].pop()  # no lower-casing
    (tmp_path / "cased.json").write_text(json.dumps(spec), "utf-8")
    for path in (public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cased.json")):
        e = token_output.Encoder(path)
        assert all(e._steps(t)[0] is e.full for t in odd)
        assert [x.tolist() for x in e.encode(odd)] == [e.full.encode(t, add_special_tokens=False).ids for t in odd]


def test_token_output(spark, edge, none):
    e = token_output.Encoder(TOKENIZER)
    rows = [(r.doc_id, r.text or "") for r in edge.collect()]
    files = token_output.write(edge, TOKENIZER, file_bytes=20_000)
    got = token_output.read_digests(files).collect()
    want, start = Counter(), 0
    for i, t in rows:
        raw = np.array([*e.full.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        want[(i, len(raw) // 4, zlib.crc32(raw))] += 1
        start += len(raw) // 4
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    spans = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got)  # a null id comes first
    assert spans[0][0] == 0 and all(a[0] + a[2] == b[0] and a[1] <= b[1] for a, b in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][2] == start
    assert token_output.read_digests(token_output.write(none, TOKENIZER)).count() == 0
    twice = spark.createDataFrame([(i % 3, f"text {i} " * i) for i in range(60)], "doc_id long, text string")
    digests = [sorted(map(tuple, token_output.read_digests(token_output.write(d, TOKENIZER)).collect())) for d in (twice, twice.repartition(7))]
    assert digests[0] == digests[1]  # rows of one id have an order of their own


def test_files_of_empty_texts_stay_small():
    w = simple8b.Writer()
    while w.bytes < 1 << 20:
        w.add(None, np.array([1]))
    assert len(w.docs) < 70_000
    out = io.BytesIO()
    w.write(out)
    out.seek(0)
    assert all(i is None and ids.tolist() == [1] for i, ids in simple8b.read(out))


# ---- 6


def plain_targets(sizes, share=1.5, most=2.0, weights=(5.0, 2.0, 1.0)):
    """Shares by weight; those above their limit are cut, and the excess goes to the others by weight, until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, full = [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        left = share * sum(sizes) - sum(most * sizes[i] for i in full)
        out = [most * sizes[i] if i in full else left * w[i] / sum(w[j] for j in free) for i in range(len(sizes))]
        over = {i for i in free if out[i] > most * sizes[i]}
        if not over:
            return out
        full |= over


def test_targets(spark):
    rng = random.Random(3)
    cases = [[100, 100, 100], [10, 1000, 1000, 1000], [], [0, 0], [0, 5, 0, 9], [10**12, 1, 1], [rng.choice((0, 1, 30, 5000)) for _ in range(50)], [7]]
    for sizes in cases:
        names = [f"s{i:03d}" for i in range(len(sizes) - 1)] + [None]
        rows = list(zip(names, sizes))
        rng.shuffle(rows)
        got = sorted(mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect(), key=lambda r: r.k)
        assert [r.k for r in got] == list(range(len(sizes))) and [r.source for r in got] == names[: len(sizes)]
        assert [r.target for r in got] == pytest.approx(plain_targets(sizes))
    points = ["é", "z", "Z", "", "日本", "zz", "\U0001f600", "\uffee"]
    got = mixing.targets(spark.createDataFrame([(p, 1) for p in points], "source string, size long")).orderBy("k").collect()
    assert [r.source for r in got] == sorted(points)  # by code point


def test_landing_is_near_the_best():
    """The landing's words against the best choice of documents, by trying all."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        size = rng.integers(1, 50, 8).astype(float)
        p = rng.random(8)
        q = mixing.landing(p, size, np.random.default_rng(_))
        want = (p * size).sum()
        assert min(abs((np.array(x) * size).sum() - want) for x in itertools.product((0, 1), repeat=8)) <= abs((q * size).sum() - want) + 1e-6 <= size.max() + 1e-6


def test_repeated_ids_do_not_make_large_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(7, "two words", "a")] * 500 + [(i, "x " * (i % 9), "b") for i in range(200)], "doc_id long, text string, source string")
    seen = []
    for n in (1, 3):
        out = mixing.mix(docs.repartition(n), block=16).collect()
        seen.append(Counter((r.doc_id, r.taken) for r in out))
        assert len(out) == 700 and abs(sum(r.taken for r in out if r.doc_id == 7 and r.source_size == 1000) - next(r.target for r in out if r.source_size == 1000)) <= 40
    assert seen[0] == seen[1]


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(1, 3000, 500).astype(float)
    q = mixing.flight(p, size, np.random.default_rng(2))
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert set(np.unique(mixing.landing(p, size, np.random.default_rng(2)))) <= {0, 1}
    mean = np.mean([mixing.landing(p[:20], size[:20], np.random.default_rng(i)) for i in range(3000)], axis=0)
    assert np.abs(mean - p[:20]).max() < 0.05  # inclusion probabilities stand


@pytest.mark.parametrize("block", [4096, 16])
def test_mix(spark, edge, none, block):
    for docs in (edge, table(spark, SF, "documents")):
        out = mixing.mix(docs, block=block).collect()
        text = Counter((r.doc_id, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in docs.select("doc_id", "text").collect())
        assert Counter((r.doc_id, r["size"]) for r in out) == text
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in out)
        by = defaultdict(lambda: [0, 0.0, 0])
        for r in out:
            k = (r.source_size, r.target)
            by[k] = [by[k][0] + r.taken, r.target, max(by[k][2], r["size"])]
        for taken, target, biggest in by.values():
            assert abs(taken - target) <= biggest + 1
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in out), rel=0.01)
    again = mixing.mix(docs.repartition(5), block=block).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in out)
    assert mixing.mix(none).count() == 0


# ---- 7


def test_language(spark, edge, none):
    docs = table(spark, SF, "documents")
    model = langid.train(docs)
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    got = {r.doc_id: r for r in langid.identify(edge, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 9)) and got[10].lang_pred in model.langs
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(none, model).count() == 0
    assert langid.train(none).predict("x y") == ("und", 0.0, False)
    assert langid.train(docs.where("lang = 'en'")).predict("x y")[0] == "en"


def plain_decode(model, text):
    """Loss-weighted decoding, one codeword and one bit at a time."""
    f = (langid.profile(text).astype(float) - model.mean) * 20 @ model.w + model.b
    loss = [sum(t * np.log1p(np.exp(-c * x)) for t, c, x in zip(trust, word, f)) for trust, word in zip(model.trust, model.code)]
    near = [np.exp(min(loss) - x) for x in loss]
    first, second = sorted(near)[::-1][:2]
    return model.langs[loss.index(min(loss))], first / sum(near), second > 0.8 * first


def test_decoding_by_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    model = langid.train(docs)
    texts = [r.text for r in docs.collect() if langid.has_letter(r.text)][:60] + ["x", "de la der the", "é"]
    for t in texts:
        got, want = model.predict(t), plain_decode(model, t)
        assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-5) and got[2] == want[2]


def test_language_sample(spark):
    """Rows are learned from, not ids: only with a language, equal ones once, each with its own; the bound holds."""
    free = next(i for i in range(1, 50) if zlib.crc32(str(i).encode()) % 5)
    rows = [(free, f"text {i}", "en" if i % 2 else "de") for i in range(16)] + [(free, f"null {i}", None) for i in range(500)] + [(free, "text 1", "en")] * 300
    held = next(i for i in range(1, 50) if not zlib.crc32(str(i).encode()) % 5)
    docs = spark.createDataFrame([*rows, (held, "held out", "fr"), (None, "no id", "fr")], "doc_id long, text string, lang string").repartition(4)
    for c in ("i", "t", "l", "h", "k", "n", "most"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = langid.training_rows(docs, train_docs=10).collect()
    assert len(got) == 10 and Counter(r.l for r in got) == {"en": 5, "de": 5}
    assert all((r.i, r.t, r.l) in rows for r in got)
    assert {tuple(r) for r in langid.training_rows(docs.repartition(2), train_docs=10).collect()} == {tuple(r) for r in got}
    assert sorted(map(tuple, langid.training_rows(docs).collect())) == sorted({r for r in rows if r[2]})
    many = spark.createDataFrame([(i, f"t {i}", f"l{i % 40}") for i in range(400)], "doc_id long, text string, lang string")
    assert Counter(Counter(r.l for r in langid.training_rows(many, train_docs=7).collect()).values()) == {1: 40}


def test_codewords():
    far = lambda code: min((a != b).sum() for a, b in itertools.combinations(code, 2))
    assert all(langid._least_distance(langid.codewords(k)) == far(langid.codewords(k)) for k in (3, 7, 20))
    assert langid.codewords(3000).shape[0] == 3000
    for k in (2, 3, 5, 12):
        code = langid.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k


def test_profile_of_long_text():
    t = "abc déf ghi " * 200_000
    assert np.allclose(langid.profile(t), langid.profile("abc déf ghi " * 2000), atol=1e-2)


# ---- 8


def test_warc(spark):
    rows = [(i, f"http://x/{i}", "<p>é</p>" * (i % 40)) for i in range(300)] + [(None, None, None), (5, "http://x/5", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("x"))
    path, index = warc.write(pages.repartition(3), file_bytes=3000)
    assert index.count() == len(rows)
    r = index.where("page_id = 7").first()
    head, body = warc.parse(warc._load(path, r.file)[r.offset : r.offset + r.length])
    assert head["WARC-Target-URI"] == "http://x/7" and body.decode() == rows[7][2]
    assert warc.audit(index, path, warc.copy(path, index)).count() == 0
    bad = {3, 77, 78, 290}
    hurt = warc.copy(path, index, lambda i, b: b[:-1] + bytes([b[-1] ^ 4]) if i in bad else b)
    found = warc.audit(index, path, hurt, fanout=3).join(index, ["file", "seq"])
    assert {x.page_id for x in found.collect()} == bad
    lost = warc.copy(path, index)
    fs, root = warc.pafs.FileSystem.from_uri(lost)
    gone = index.first().file
    fs.delete_file(f"{root}/{gone}")
    assert warc.audit(index, path, lost).count() == index.where(F.col("file") == gone).count()
    more = warc.copy(path, index)  # bytes after the last record, and a file more
    fs, root = warc.pafs.FileSystem.from_uri(more)
    junk = warc._load(more, gone) + b"junk"
    with fs.open_output_stream(f"{root}/{gone}", compression=None) as f:
        f.write(junk)
    with fs.open_output_stream(f"{root}/zz.warc.gz", compression=None) as f:
        f.write(b"more")
    after = index.where(F.col("file") == gone).count()
    assert sorted((x.file, x.seq, x.hash_one is None) for x in warc.audit(index, path, more, fanout=3).collect()) == sorted([(gone, after, False), ("zz.warc.gz", 0, True)])
    path, index = warc.write(pages.where("false"))
    assert warc.audit(index, path, warc.copy(path, index)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 15, 16, 17, 300])
def test_tree_by_hashlib(n):
    """Every level and root again, from the definition."""
    rng = random.Random(n)
    parts = [rng.randbytes(rng.randint(0, 9)) for _ in range(n)]
    recs, at = [], 0
    for p in parts:
        recs.append((at, len(p)))
        at += len(p)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    level = [sha(o.to_bytes(8, "little") + k.to_bytes(8, "little") + p) for (o, k), p in zip(recs, parts)]
    level.append(sha(at.to_bytes(8, "little") + (4).to_bytes(8, "little") + b"tail"))
    for got in warc.tree(b"".join(parts) + b"tail", recs, 4):
        assert got == level
        level = [sha("".join(level[i : i + 4]).encode()) for i in range(0, len(level), 4)]
    assert len(got) == 1


def test_descent_reads_only_below_what_differs(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i % 50)) for i in range(200)], "page_id long, url string, html string").withColumn("node", F.lit("x")).withColumn("hash", F.lit("y")).withColumn("i", F.lit(1))
    path, index = warc.write(pages.coalesce(1))
    hurt = warc.copy(path, index, lambda i, b: b[:-1] + b"?" if i == 77 else b)
    sizes = []
    real = warc.written
    monkeypatch.setattr(warc, "written", lambda df, name, by=None: (out := real(df, name, by), sizes.append((name, out.count())))[0])
    assert [x.seq for x in warc.audit(index, path, hurt, fanout=4).collect()] == [77]
    assert [n for name, n in sizes if name in ("warc-roots", "warc-wrong")] == [1] * 5  # one node a level, of 201 leaves


def test_warc_query(spark):
    got = QUERIES["op8_warc_fixity"](spark, SMALL).collect()
    assert len(got) == table(spark, SMALL, "pages").count()
    assert {r.page_id for r in got if not r.intact} == {r.page_id for r in got if r.page_id % 1009 == 7}


# ---- 9


def test_lines(spark, edge, none):
    rows = []
    for d in range(40):
        lines = [f"own {d}", "  all sites ", "", "nine sites" if d % 10 < 9 else "x", "ten sites", None and "y"]
        rows.append((d, "\n".join(filter(lambda x: x is not None, lines)), f"s{d % 10}" if d % 10 or d else None))
    rows += [(40, None, "s1"), (41, "", "s1"), (0, rows[0][1], None), (1, "ten sites\nten sites\n\nother", "s1"), (None, "ten sites", "s2"), (None, "x\nten sites\ny", "s2"), (None, "ten sites", "s3")]
    rows += [(42, "\n".join(["ten sites", "mine"] * 20_000), "s4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_drop", F.lit(1)).withColumn("h", F.lit(2)).withColumn("n", F.lit(2)).withColumn("n_lines", F.lit("old"))
    for threshold in (10, 11, 2):
        sites = defaultdict(set)
        for _, t, s in rows:
            for x in (t or "").split("\n"):
                if x.strip(" "):
                    sites[x.strip(" ")].add(s)
        want = Counter()
        for d, t, _ in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if not (x.strip(" ") and len(sites[x.strip(" ")]) >= threshold)]
            want[(d, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
        got = line_dedup.remove_boilerplate(docs, min_sites=threshold).collect()
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == want
    assert line_dedup.remove_boilerplate(none).count() == 0
    assert line_dedup.remove_boilerplate(edge).columns == [c for c in edge.columns if c[:2] != "n_" or c == "n_chars"] + ["n_lines", "n_removed"] and line_dedup.remove_boilerplate(edge).count() == len(EDGE)


# ---- 10


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", fold(text))
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def reachable(fps, most=2):
    root = {}
    ids = sorted(fps)
    find = lambda a: a if root.setdefault(a, a) == a else find(root[a])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {a: find(a) for a in ids}


def test_simhash(spark, edge, none):
    docs = edge.select("doc_id", "text", *CLASH)
    got = simhash.near_duplicates(docs).collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert all(simhash.signed(fps[r.doc_id]) == r.fp for r in got) and len(got) == len(EDGE)
    fps.pop(None)
    want = reachable(fps)
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_copies(none).count() == 0


@pytest.mark.parametrize("most_paired", [256, 2])
def test_links_are_complete(spark, most_paired):
    """Random fingerprints in chains and clumps; groups above and below the limit."""
    rng = random.Random(9)
    fps = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.append(x)
            for _ in range(rng.choice((1, 2, 2, 3))):
                x ^= 1 << rng.randrange(64)
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, id long")
    roots = {r.id: r.root for r in simhash.components(simhash.links(nodes, most_paired)).collect()}
    want = reachable(dict(enumerate(fps)))
    assert {i: roots.get(i, i) for i in want} == want


def test_golay_keys():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = a ^ np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64) ^ np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    sets = []
    for x in (a, b):
        s = defaultdict(set)
        for r, k in zip(*simhash.golay_keys(x)):
            s[r].add(k)
        sets.append(s)
    far = np.bitwise_count(a ^ b)
    assert all(sets[0][i] & sets[1][i] for i in range(3000) if far[i] <= 2)


def test_near_copies(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, owner = [], {}
    for g in range(30):
        text = [word() for _ in range(300)]
        for c in range(4 if g else 60):
            copy = list(text)
            for _ in range(3 if c else 0):
                copy[rng.randrange(300)] = word()
            owner[len(docs)] = g
            docs.append((len(docs), " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most_paired in (256, 8):
        out = simhash.near_copies(df, most_paired=most_paired).collect()
        assert all(owner[r.component_id] == owner[r.doc_id] for r in out)
        assert len({r.component_id for r in out}) == 30


def test_components(spark):
    rng = random.Random(8)
    edges = [(i + 1, i) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    root = {}
    find = lambda a: a if root.setdefault(a, a) == a else find(root[a])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert {i: got.get(i, i) for i in nodes} == {i: find(i) for i in nodes}


# ---- queries with SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    same(QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).execute(ORACLE_SQL[name]).df())


def test_zz_forget(spark):
    """Last: takes away all intermediate tables."""
    from tempolog.llm.common import forget, written

    df = written(spark.range(3), "x")
    assert df.count() == 3 and forget(spark) >= 1 and forget(spark) == 0
