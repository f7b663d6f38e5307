"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage of
every document is encoded from the frequencies of neighbouring character
classes, hashed words, and a few figures on its words; a small network embeds it, learned
gated attention (tanh times sigmoid) weighs it within its document, and the
weighted sum is scored.  Only document labels are learned from.

The model is fitted on the driver with numpy on a bounded sample: at most
``train_docs`` labelled documents (those with the smallest hash of their id),
of ``train_bytes`` of text together; a document that would go beyond is left
out as a whole.  All passages of whole texts are learned from, as are scored.

Edge cases: a null or empty text is one passage of zeros and gets a score;
labels that are null, held out, or of unknown documents are not learned from;
where labels of one document differ the largest counts; where an id has several
texts the one with the least hash is learned from; ids are integers (cast to
bigint) in fitting, anything in scoring; with no label, or one class only, the
score is the smoothed share of label 1; a column with the name of the score is
replaced, others stay; repeated rows get equal scores.  A text of more than
``SEGMENT_BYTES`` is cut into segments at spaces, and passages start anew there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow, texts

PASSAGE_WORDS = 64
TRAIN_DOCS = 4000
TRAIN_BYTES = 24 << 20
SEGMENT_BYTES = 1 << 20
THRESHOLD = 0.3

#: Character classes: space, line end, lower, upper, digit, beyond ASCII, '.', ',', bar, '!', quotes and the like, other.
_CLASSES = 12
_CLASS = np.full(256, 11, np.uint8)
_CLASS[[9, 11, 12, 32]] = 0
_CLASS[[10, 13]] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[128:] = 5
_CLASS[ord(".")] = 6
_CLASS[ord(",")] = 7
_CLASS[ord("|")] = 8
_CLASS[ord("!")] = 9
_CLASS[[*b"'\"-:;?()"]] = 10
_WORD_FIGURES = 8
#: Buckets of hashed words.
_WORDS = 64
FEATURES = _CLASSES**2 + _WORDS + _WORD_FIGURES


def _segments(text: bytes) -> Iterator[bytes]:
    text = text.strip()
    while len(text) > SEGMENT_BYTES:
        cut = text.rfind(b" ", 1, SEGMENT_BYTES)
        cut = cut if cut > 0 else SEGMENT_BYTES
        yield text[:cut].strip()
        text = text[cut:].strip()
    yield text


def encode(docs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(document of each passage, features of each passage)`` for a few documents at a time."""
    held, size, first = [], 0, 0
    for d, text in enumerate(docs):
        for part in _segments(text):
            held.append((d, part))
            size += len(part) + 1
        if size >= SEGMENT_BYTES:
            yield _encode(held)
            held, size = [], 0
    if held:
        yield _encode(held)


def _encode(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join([p for _, p in parts]) + b" ", np.uint8)
    ends = np.cumsum([len(p) + 1 for _, p in parts])
    cls = _CLASS[buf]
    gap = cls <= 1
    begin = ~gap
    begin[1:] &= gap[:-1]
    pos = np.flatnonzero(begin)
    part = np.searchsorted(ends, pos, "right")
    words = np.bincount(part, minlength=len(parts))
    n_pass = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.cumsum(n_pass) - n_pass
    word_at = np.arange(len(pos)) - (np.cumsum(words) - words)[part]
    of_word = base[part] + word_at // PASSAGE_WORDS
    n = int(n_pass.sum())
    out = np.zeros((n, FEATURES), np.float32)
    doc = np.repeat(np.array([d for d, _ in parts]), n_pass)
    if not len(pos):
        return doc, out
    # pairs of neighbouring classes; what follows a part's end doesn't count
    pair = cls.astype(np.int32) * _CLASSES
    pair[:-1] += cls[1:]
    pair[ends - 1] = 0
    of_byte = np.repeat(of_word, np.diff(np.append(pos, len(buf)))).astype(np.int64)
    pair = pair[pos[0] :]
    k = _CLASSES**2
    out[:, :k] = np.bincount(of_byte * k + pair, minlength=n * k).reshape(n, k)
    size = np.maximum(1, out[:, :k].sum(1, keepdims=True))
    out[:, :k] = np.sqrt(out[:, :k] / size)
    # words: their first eight bytes and length stand for them
    close = np.flatnonzero(gap & np.append([False], ~gap[:-1]))
    length = close - pos
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    head = np.zeros(len(pos), np.uint64)
    for i in range(8):
        head |= np.where(i < length, padded[pos + i], 0).astype(np.uint64) << np.uint64(8 * i)
    head ^= length.astype(np.uint64) << np.uint64(56)
    held = np.bincount(of_word, minlength=n)
    count = np.maximum(1, held)
    mean = lambda x: np.bincount(of_word, weights=x, minlength=n) / count
    figures = [held / PASSAGE_WORDS, mean(length) / 10, mean(length > 15), mean(length == 1)]
    for lag in (1, 2, 3):
        same = np.zeros(len(pos))
        same[lag:] = (head[lag:] == head[:-lag]) & (part[lag:] == part[:-lag])
        figures.append(mean(same))
    figures.append(mean(cls[pos] == 3))
    out[:, k + _WORDS :] = np.stack(figures, 1)
    bucket = ((head * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 6)).astype(np.int64)
    hashed = np.bincount(of_word * _WORDS + bucket, minlength=n * _WORDS).reshape(n, _WORDS)
    out[:, k : k + _WORDS] = np.sqrt(hashed / count[:, None])
    return doc, out


class Model:
    """Embedding, gated attention and scorer; ``prior`` alone where nothing could be learned."""

    def __init__(self, prior: float = 0.5, hidden: int = 24, gate: int = 12, seed: int = 7):
        self.prior, self.weights, self.scale = prior, None, None
        self._shape = (hidden, gate, seed)

    def score(self, docs: list[bytes]) -> np.ndarray:
        """From 0 to 1 for each document, over all its passages."""
        if self.weights is None:
            return np.full(len(docs), self.prior)
        out = np.empty(len(docs))
        for doc, x in encode(docs):
            m, s = self.scale
            at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            out[doc[0] : doc[-1] + 1] = _forward(self.weights, (x - m) / s, at)[-1].round(9)
        return out

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 3e-3) -> Model:
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        if len(set(y.tolist())) < 2:
            return self
        hidden, gate, seed = self._shape
        rng = np.random.default_rng(seed)
        n = sum(map(len, bags))
        m = (sum(b.sum(0, dtype=np.float64) for b in bags) / n).astype(np.float32)
        s = np.sqrt(sum(((b - m) ** 2).sum(0, dtype=np.float64) for b in bags) / n).astype(np.float32) + np.float32(1e-2)
        shapes = ((FEATURES, hidden), (hidden,), (hidden, gate), (hidden, gate), (gate,), (hidden,), ())
        params = [(rng.normal(0, np.sqrt(1 / d[0]), d) if d and i != 1 else np.zeros(d)).astype(np.float32) for i, d in enumerate(shapes)]
        m1, m2, step = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(bags), batch):
                k = order[i : i + batch]
                at = np.cumsum([0] + [len(bags[j]) for j in k[:-1]])
                grads = gradients(params, (np.concatenate([bags[j] for j in k]) - m) / s, at, y[k])
                step += 1
                for j, g in enumerate(grads):
                    g = g + 1e-4 * params[j]
                    m1[j] = 0.9 * m1[j] + 0.1 * g
                    m2[j] = 0.999 * m2[j] + 0.001 * g * g
                    params[j] = (params[j] - rate * (m1[j] / (1 - 0.9**step)) / (np.sqrt(m2[j] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        # Scored in double precision and rounded: equal texts get equal scores, whatever stands beside them.
        self.weights, self.scale = [q.astype(float) for q in params], (m.astype(float), s.astype(float))
        return self


def _forward(params: list[np.ndarray], x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of bags that begin at rows ``at``: before the embedding's kink, the embedding, tanh, gate, weights, bags, scores."""
    e, e0, v, u, w, c, b = params
    n = np.diff(np.append(at, len(x)))
    pre = x @ e + e0
    h = np.maximum(0, pre)
    tv, sg = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
    a = (tv * sg) @ w
    a = np.exp(a - np.repeat(np.maximum.reduceat(a, at), n))
    a /= np.repeat(np.add.reduceat(a, at), n)
    z = np.add.reduceat(h * a[:, None], at, axis=0)
    return pre, h, tv, sg, a, z, 1 / (1 + np.exp(-np.clip(z @ c + b, -30, 30)))


def gradients(params: list[np.ndarray], x: np.ndarray, at: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean logistic loss of some bags, by parameter."""
    e, e0, v, u, w, c, b = params
    pre, h, tv, sg, a, z, out = _forward(params, x, at)
    n = np.diff(np.append(at, len(x)))
    d = ((out - y) / len(y)).astype(x.dtype)
    gz = np.repeat(d[:, None] * c, n, axis=0)
    ga = (gz * h).sum(1)
    ga = a * (ga - np.repeat(np.add.reduceat(a * ga, at), n))
    gts = ga[:, None] * w
    gv, gu = gts * sg * (1 - tv**2), gts * tv * sg * (1 - sg)
    gh = (a[:, None] * gz + gv @ v.T + gu @ u.T) * (pre > 0)
    return [x.T @ gh, gh.sum(0), h.T @ gv, h.T @ gu, (tv * sg).T @ ga, z.T @ d, d.sum()]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Learn from at most ``train_docs`` labelled documents that are not held out, of ``train_bytes`` together."""
    spark = docs.sparkSession
    known = labels.select(F.col(label_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("i").isNotNull() & ~held_out(F.col("i")))
    sample = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(train_docs).collect()
    if not sample:
        return Model()
    chosen = F.broadcast(spark.createDataFrame(sample, "i long, y int"))  # train_docs rows at most
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).join(chosen, "i").withColumn("h", F.xxhash64("t"))
    # One text an id, and its size: train_docs rows at most.
    sizes = rows.select("i", F.struct("h", F.coalesce(F.octet_length("t"), F.lit(0)).alias("n")).alias("s")).groupBy("i").agg(F.min("s").alias("s"), F.xxhash64("i").alias("o")).select("i", "s.*", "o").collect()
    room, taken = train_bytes, []
    for r in sorted(sizes, key=lambda r: (r.o, r.i)):
        if r.n <= room:
            room -= r.n
            taken.append((r.i, r.h))
    if not taken:
        return Model()
    bags = rows.join(F.broadcast(spark.createDataFrame(taken, "i long, h long")), ["i", "h"]).groupBy("i", "h").agg(F.first("y").alias("y"), F.first("t").alias("t"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[int, list[np.ndarray]] = {}
        for doc, x in encode(texts(batch, "t")):
            for d in np.unique(doc):
                found.setdefault(int(d), []).append(x[doc == d].astype(np.float16))
        return pa.RecordBatch.from_arrays([batch.column("i"), batch.column("y"), pa.array([np.concatenate(found[d]).tobytes() for d in range(batch.num_rows)], pa.binary())], ["i", "y", "x"])

    got = sorted(map_arrow(bags.select("i", "y", "t"), each, "i long, y int, x binary").collect(), key=lambda r: r.i)
    return Model().fit([np.frombuffer(r.x, np.float16).reshape(-1, FEATURES).astype(np.float32) for r in got], np.array([r.y for r in got], np.float32))


def score(docs: DataFrame, model: Model, text: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text as a further, last column; one of that name is replaced."""
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != score_col or c == text])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(texts(batch, text)), pa.float64())], [*batch.schema.names, score_col])

    return map_arrow(rest, each, f"{schema}, `{score_col}` double")
