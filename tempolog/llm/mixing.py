"""Mixing sources to target weights by the cube method.

Every document gets an expected number of copies: its source's target over its
source's size (2 at most).  The whole copies are certain; the fraction is an
inclusion probability.  Within each source the cube method's flight phase moves
the fractions of a few documents at a time through the null space of the
balancing constraints (words, documents, and with them the source's total), so
that both totals hold exactly while fractions become 0 or 1.  It runs in blocks
of ``BLOCK`` documents, each of which leaves three at most undecided; these go
on to the next level's blocks, and so on until one block a source is left: the
small landing problem, where the constraints are let go one after another and
the last document is drawn.

A hot source has more blocks, not larger ones, so no task gathers a source; a
task walks its blocks one after another, and one that repeated ids make larger
is cut.  Sources stay in tables too: only totals over them come to the driver.
Blocks, order and draws come from hashes of the ids: reruns agree.

Edge cases: a null text has size 0 and is never taken; a null source is a
source of its own and comes last; sources without words get target 0; ids are
integers (cast to bigint); repeated or null ids are separate documents, of which
those of one size are alike; other columns are ignored; an empty table gives no
row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, map_arrow, texts, written

#: Documents in one block.
BLOCK = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
_EPS = 1e-9


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (``source, size``, one row each) with ``k``, their place in order of code points (null last), and ``target``.

    Targets are shares by weight, none above ``most`` times its size, the excess going to the others by weight: that is, a
    rate a weight, at which those below their limit use up what the others leave.  The rate rises to where it settles, from
    sums over all sources; sizes are whole numbers, so the sums don't depend on their order.
    """
    spark = sources.sparkSession
    # UTF-8 sorts by code point.  Ranks in ranges of the first characters: no task ranks all sources.
    keyed = sources.withColumn("_a", F.col("source").isNull()).withColumn("_b", F.coalesce(F.substring("source", 1, 3), F.lit("")))
    ranges = keyed.groupBy("_a", "_b").agg(F.count("*").alias("_n"))
    ranges = ranges.select("_a", "_b", F.coalesce(F.sum("_n").over(Window.orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_a", "_b").orderBy("source"))
    ranked = keyed.withColumn("_own", own).join(ranges, ["_a", "_b"]).select("source", "size", (F.col("_own") + F.col("_before") - 1).alias("k"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("w", weight), "mix-ranked")

    total = share * (ranked.agg(F.sum("size")).first()[0] or 0)
    limit = F.col("size") * float(most)
    rate = 0.0
    while True:
        full = F.col("w") * rate >= limit
        r = ranked.agg(F.sum(F.when(full, limit)).alias("spent"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        new = max(0.0, total - (r.spent or 0.0)) / r.w if r.w else rate
        if new <= rate:
            break
        rate = new
    return ranked.select("source", "size", "k", F.least(F.col("w") * rate, limit).alias("target"))


def _null_vector(a: list[tuple[float, ...]]) -> list[float]:
    """A vector that the constraints (one tuple for each unit, fewer constraints than units) do not see."""
    m = np.array(a, float).T
    if m.shape == (2, 3):  # the cross product, by far the most frequent case
        (a0, a1, a2), (b0, b1, b2) = a_ = m.tolist()
        v = [a1 * b2 - a2 * b1, a2 * b0 - a0 * b2, a0 * b1 - a1 * b0]
        if max(map(abs, v)) > 1e-12:
            return v
        m = np.array(a_)
    return np.linalg.svd(m)[2][-1].tolist()


def _settle_large(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, constraints: int, times: float = 4.0) -> np.ndarray:
    """Decides the documents of over ``times`` the mean size, the largest first, against all others at once.

    The null vector moves one large document and gives each other one a share of the counterweight by its room, p (1 - p):
    so a long text is decided while short ones can still make up for it, and landing moves few words.
    """
    p = p.copy()
    open_ = (p > _EPS) & (p < 1 - _EPS)
    if not constraints or open_.sum() <= constraints + 1:
        return p
    rows = np.stack([np.ones_like(size), size / max(1.0, size.max())])[2 - constraints :]
    large = np.flatnonzero(open_ & (size > times * size[open_].mean()))
    for i in large[np.argsort(-size[large], kind="stable")].tolist():
        for _ in range(8):
            others = np.flatnonzero((p > _EPS) & (p < 1 - _EPS) & (np.arange(len(p)) != i))
            if not _EPS < p[i] < 1 - _EPS or len(others) <= constraints:
                break
            a, room = rows[:, others], p[others] * (1 - p[others])
            gram = (a * room) @ a.T
            if np.linalg.cond(gram) > 1e12:
                break
            v = -room * (a.T @ np.linalg.solve(gram, rows[:, i]))
            at, v = np.append(others, i), np.append(v, 1.0)
            value = p[at]
            some = np.abs(v) > 1e-15
            up = np.min(np.where(v > 0, 1 - value, value)[some] / np.abs(v[some]))
            down = np.min(np.where(v > 0, value, 1 - value)[some] / np.abs(v[some]))
            p[at] = np.clip(value + (up if rng.random() * (up + down) < down else -down) * v, 0, 1)
    return p


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, constraints: int = 2) -> np.ndarray:
    """Moves ``p`` until ``constraints`` documents at most are undecided; keeps the sums of p, and of p * size, as expected and exact.

    ``constraints``: 2 balances documents and words, 1 words, 0 nothing.  Large documents are decided against all others
    first; then a few documents at a time, entering from the end.
    """
    p = _settle_large(p.astype(float), size.astype(float), rng, constraints)
    scale = max(1.0, float(size.max(initial=1)))
    fraction = ((p > _EPS) & (p < 1 - _EPS)).nonzero()[0].tolist()
    draws = iter(rng.random(2 * len(fraction) + 8).tolist())
    held: list[int] = []
    value = p.tolist()
    unit = [(1.0, s / scale) for s in size.tolist()]
    while True:
        while len(held) < constraints + 1 and fraction:
            held.append(fraction.pop())
        if len(held) < constraints + 1:
            break
        v = _null_vector([unit[i][2 - constraints :] for i in held]) if constraints else [1.0]
        up = min(((1 - value[i]) / x if x > 0 else value[i] / -x) for i, x in zip(held, v) if abs(x) > 1e-15)
        down = min((value[i] / x if x > 0 else (1 - value[i]) / -x) for i, x in zip(held, v) if abs(x) > 1e-15)
        move = up if next(draws) * (up + down) < down else -down
        for i, x in zip(held, v):
            value[i] += move * x
        held = [i for i in held if _EPS < value[i] < 1 - _EPS]
    out = np.array(value)
    out[out <= _EPS] = 0
    out[out >= 1 - _EPS] = 1
    return out


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides the rest: all documents by falling size, so that short ones are left; words stay balanced until one is, which is drawn."""
    p = _settle_large(p.astype(float), size.astype(float), rng, 2, 0.0)
    for constraints in (2, 1, 0):
        p = flight(p, size, rng, constraints)
    return p


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", key: str | None = None) -> DataFrame:
    """``doc_id, source, size``: runs of other than space and \\x09-\\x0d."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("t"), *([F.col(key).cast("long").alias("key")] if key else []))
    more = ["key"] if key else []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array([len(t.split()) for t in texts(batch, "t")], pa.int64()), *(batch.column(c) for c in more)], ["doc_id", "source", "size", *more])

    return map_arrow(docs, each, "doc_id long, source string, size long" + (", key long" if key else ""))


def _fly(rows: DataFrame, seed: int, level: int, last: bool, block: int) -> DataFrame:
    """The flight (or the landing) in each block of ``k, part``; rows come sorted, so a task holds one block and a batch."""
    names = ["k", "part", "row", "doc_id", "none", "size", "p"]

    def fly(cols: list[np.ndarray], cut: int) -> pa.RecordBatch:
        k, part, row, ids, none, size, p = cols
        rng = np.random.default_rng([seed, level, int(k[0]), int(part[0]), cut])
        order = rng.permutation(len(k))
        order = order[np.argsort(size[order], kind="stable")]
        new = (landing if last else flight)(p[order], size[order].astype(float), rng)
        return pa.RecordBatch.from_arrays([pa.array(k[order]), pa.array(row[order]), pa.array(ids[order], mask=none[order]), pa.array(size[order]), pa.array(new)], ["k", "row", "doc_id", "size", "p"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        cut = 0  # pieces taken so far of the block that goes on
        for batch in batches:
            new = [(batch.column(c).fill_null(0) if c == "doc_id" else batch.column(c)).to_numpy(zero_copy_only=False) for c in names]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            ends = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            at = 0
            for end in [*ends.tolist(), None]:  # the last block may go on in the next batch
                while (len(held[0]) if end is None else end) - at > 2 * block:
                    yield fly([c[at : at + 2 * block] for c in held], cut)
                    at, cut = at + 2 * block, cut + 1
                if end is not None:
                    yield fly([c[at:end] for c in held], cut)
                    at, cut = end, 0
            held = [c[at:] for c in held]
        if held and len(held[0]):
            yield fly(held, cut)

    bound_batches(rows.sparkSession)
    rows = rows.withColumn("none", F.col("doc_id").isNull())
    # What is of one id and size is alike: any order of it gives the same rows.
    return rows.select(names).repartition("k", "part").sortWithinPartitions("k", "part", "size", "doc_id").mapInArrow(walk, "k long, row long, doc_id long, size long, p double")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, seed: int = 1, block: int = BLOCK, key: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, copies, taken``; with ``key``, a long column that tells rows of one id apart, also ``key``."""
    rows = written(sized(docs, doc_id, text, source, key).withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    sources = written(sources, "mix-sources")
    per = targets(sources.select("source", "size"), share, most, weights)
    per = written(per.join(sources.select(F.col("source").alias("s"), "docs"), F.col("s").eqNullSafe(F.col("source"))).select("s", F.col("size").alias("source_size"), "target", "k", "docs"), "mix-targets")
    # No hint: whether the table of sources is small enough to broadcast is for Spark to see by its size.
    all_ = rows.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    all_ = all_.withColumn("want", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    all_ = all_.withColumn("whole", F.floor(F.col("want") + F.lit(_EPS)).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("want") - F.col("whole")))

    left = all_.where(F.col("p") > _EPS).select("k", "row", "doc_id", "size", "p", "docs")
    decided = None
    level = 0
    biggest = sources.agg(F.max("docs")).first()[0] or 0
    while True:
        last = biggest <= block
        h = F.xxhash64("doc_id", "size", F.lit(seed), F.lit(level))
        part = F.lit(0).cast("long") if last else F.pmod(h, F.greatest(F.lit(1), F.ceil(F.col("docs") / block)))
        flown = written(_fly(left.withColumn("part", part), seed, level, last, block), f"mix-{level}")
        done = flown.where("p in (0, 1)").select("row", F.col("p").cast("long").alias("drawn"))
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        # Three or fewer of each block are left.
        open_ = flown.where("p not in (0, 1)")
        counts = open_.groupBy("k").agg(F.count("*").alias("docs"))
        biggest = counts.agg(F.max("docs")).first()[0] or 0
        left = open_.join(counts, "k").select("k", "row", "doc_id", "size", "p", "docs")
        level += 1
    copies = F.col("whole") + F.coalesce("drawn", F.lit(0))
    return all_.join(decided, "row", "left").select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["key"] if key else []))
