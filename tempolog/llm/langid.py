"""Language identification with error-correcting output codes.

Every language has a codeword of +1/-1 bits.  One linear classifier a bit, on
hashed frequencies of three and four neighbouring bytes of the lower-cased
letters, predicts the bits; decoding weighs each bit's logistic loss by how
well that bit was told apart for that language in fitting, and picks the
nearest codeword.  Where the runner-up is nearly as near, ``ambiguous`` is set.

Fitting takes a bounded sample: at most ``train_docs`` rows that are not held
out and have a language (of each language the same number, at least one: those
with the smallest hash of id and text), and whole texts of them.  Prediction
covers whole texts of all rows.

Edge cases: null texts, and texts without a letter, are ``und`` with score 0;
rows with a null language or id teach nothing; rows of one id are rows of their
own, each with its own text and language, and equal rows teach once; with one
language all other texts get that language, with none ``und``; repeated rows get
equal results; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, map_arrow, written

BUCKETS = 1 << 12
TRAIN_DOCS = 4000
#: Bytes hashed at once.
_PART = 1 << 20
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def profile(text: str) -> np.ndarray:
    """Square roots of the shares of hashed three- and four-byte grams, whole text."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    out = np.zeros(BUCKETS, np.float64)
    for at in range(0, max(1, len(raw) - 3), _PART):  # parts share three bytes, so that no gram is lost or counted twice
        b = np.frombuffer(raw[at : at + _PART + 3], np.uint8).astype(np.uint32)
        if len(b) < 3:
            continue
        three = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)
        last = at + _PART >= len(raw) - 3
        grams = three if last else three[:_PART]
        out += np.bincount(((grams ^ grams >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(20), minlength=BUCKETS)
        if len(b) > 3:
            four = three[:-1] ^ b[3:] * np.uint32(0x27D4EB2F)
            out += np.bincount(((four ^ four >> np.uint32(13)) * np.uint32(0x297A2D39)) >> np.uint32(20), minlength=BUCKETS)
    total = out.sum()
    return np.sqrt(out / total).astype(np.float32) if total else out.astype(np.float32)


def _least_distance(code: np.ndarray) -> int:
    """Of any two codewords; some rows at a time, so that memory stays bounded with very many languages."""
    k, n = code.shape
    least = n
    for at in range(0, k, 1024):
        far = (n - code[at : at + 1024] @ code.T) / 2
        far[np.arange(len(far)), np.arange(at, at + len(far))] = n
        least = min(least, int(far.min()))
    return least


def codewords(k: int) -> np.ndarray:
    """Exhaustive codes up to five languages; beyond, the best of seeded random codes by least distance (fewer are tried of large ones)."""
    if k <= 5:
        cols = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, np.float32).T.reshape(k, -1)
    rng, best, far = np.random.default_rng(11), None, -1
    bits = int(np.ceil(10 * np.log2(k)))
    for _ in range(int(np.clip(2e9 / (k * k * bits), 1, 200))):
        code = rng.choice(np.array([-1, 1], np.float32), (k, bits))
        if (d := _least_distance(code)) > far:
            best, far = code, d
    return best


class Model:
    def __init__(self, langs: list[str]):
        self.langs, self.code = langs, codewords(len(langs)) if len(langs) > 1 else None
        self.w = self.b = self.trust = None

    def fit(self, x: np.ndarray, lang: np.ndarray, steps: int = 150, rate: float = 0.3) -> Model:
        """``lang``: index of each row's language.  All bits at once by Adam on the logistic loss."""
        if self.code is None:
            return self
        y = self.code[lang]
        self.mean = x.mean(0)
        x = (x - self.mean) * 20
        w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        mw, vw = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) / len(x)
            gw = x.T @ g + 1e-4 * w
            mw = 0.9 * mw + 0.1 * gw
            vw = 0.99 * vw + 0.01 * gw * gw
            w -= rate * 0.1 * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.99**step)) + 1e-6)
            b -= rate * g.sum(0)
        self.w, self.b = w, b
        right = np.sign(x @ w + b) == y
        trust = np.stack([right[lang == i].mean(0) if (lang == i).any() else np.ones(y.shape[1]) for i in range(len(self.langs))])
        self.trust = (trust + 1e-3) / (trust + 1e-3).sum(1, keepdims=True)
        return self

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the second is nearly as near."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, False
        if self.code is None:
            return self.langs[0], 1.0, False
        f = (profile(text) - self.mean) * 20 @ self.w + self.b
        loss = (self.trust * np.logaddexp(0, -self.code * f)).sum(1)
        p = np.exp(-(loss - loss.min()))
        p /= p.sum()
        best = int(np.argmin(loss))
        return self.langs[best], float(p[best]), bool(np.sort(p)[-2] > 0.8 * p[best])


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``i, t, l``: the rows to learn from, ``train_docs`` at most, or one a language if these are more."""
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.where(~held_out(F.col("i")) & F.col("i").isNotNull() & F.col("l").isNotNull()).withColumn("h", F.xxhash64("i", "t"))
    # One row a language.  Of each about twice the wanted number pass by hash; the first of these in order are taken.
    kinds = written(rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")), "langid-kinds")
    each = max(1, train_docs // max(1, kinds.count()))
    limits = kinds.select("l", F.greatest(F.lit(1), F.ceil(F.least(F.lit(1.0), 2 * each / F.col("n") + 16 / F.col("n")) * (1 << 30))).alias("most"))
    passed = rows.join(limits, "l").where(F.pmod("h", F.lit(1 << 30)) < F.col("most")).select("l", "h").distinct()
    first = passed.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("k") <= each).select("l", "h")
    first = written(first, "langid-rows")  # ids of the sample only: as bounded as it is
    return rows.join(F.broadcast(first), ["l", "h"]).groupBy("l", "h").agg(F.first("i").alias("i"), F.first("t").alias("t")).select("i", "t", "l")


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from :func:`training_rows`."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [profile(t).astype(np.float16).tobytes() if has_letter(t) else None for t in batch.column("t").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("i"), batch.column("l"), pa.array(x, pa.binary())], ["i", "l", "x"])

    got = map_arrow(training_rows(docs, doc_id, text, lang, train_docs), each, "i long, l string, x binary").collect()
    got = sorted((r for r in got if r.x), key=lambda r: (r.i, r.l, r.x))
    langs = sorted({r.l for r in got})
    model = Model(langs)
    return model.fit(np.stack([np.frombuffer(r.x, np.float16) for r in got]).astype(np.float32), np.array([langs.index(r.l) for r in got])) if langs else model


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, ambiguous``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, close = zip(*map(model.predict, batch.column("t").to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return map_arrow(docs, each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
