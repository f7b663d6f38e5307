"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint has 64 bits; two link when at most two bits differ.  It is cut
into three segments of 22, 21 and 21 bits.  By the pigeonhole principle two
linked fingerprints have a segment without error, and at most two errors in
the segment after it.  That one is read as a word of the perfect binary Golay
code [23, 12, 7]: the word and its 23 neighbours at one bit decode to one or
six codewords, and two words at distance two or less have a neighbour, hence a
codeword index, in common.  A key is (which segment, its bits, codeword index
of the next): 3 to 18 keys each, 36 bits wide, and no link is missed.

Equal fingerprints are one node from the start, so copies cost nothing more.
Key groups up to ``MOST_PAIRED`` fingerprints are joined and verified by
popcount, and give a link per fingerprint at most: a spanning forest.  Larger
groups are never paired or gathered: there fingerprints meet at the midpoints
(themselves and the words at one bit), and all that share one are at distance
two or less, so each links with the least of them.  Either way all links of
the group, and nothing else, end up connected.

Components come from alternating large-star and small-star steps on written
edge tables.

Edge cases: null and empty texts have fingerprint zero and link like any other;
ids are integers (cast to bigint); rows with a null id get a fingerprint and the
component of their fingerprint, or null if no row with an id has it; repeated
rows stay and agree; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, map_arrow, release, texts, written

BITS = 64
#: Fingerprints of one key group that are compared in pairs; more than these meet at midpoints instead.
MOST_PAIRED = 256
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011


def shingles(text: bytes, n: int) -> list[bytes]:
    words = text.lower().split()  # of bytes: A-Z only, and runs without space or \x09-\x0d
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return [b" ".join(w) for w in zip(*(words[i:] for i in range(n)))]


def fingerprint(text: bytes, n: int = 3) -> int:
    """64 bits; a bit is set where it is in over half of the shingles' hashes."""
    found = shingles(text, n)
    if not found:
        return 0
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, 42) for s in found]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([signed(fingerprint(t, n)) for t in texts(batch, "t")], pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs, each, "doc_id long, fp long")


# ---- Golay keys


def _divide(words: np.ndarray) -> np.ndarray:
    """Remainder by the generator: the 11-bit syndrome."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, _GENERATOR << (bit - 11), 0)
    return words


def _coset_leaders() -> np.ndarray:
    """The error pattern of weight three at most for each syndrome: the code is perfect, so each has exactly one."""
    one = 1 << np.arange(23, dtype=np.int64)
    errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    errors = np.array(errors, np.int64)
    leaders = np.empty(2048, np.int64)
    leaders[_divide(errors)] = errors
    return leaders


_LEADERS = _coset_leaders()
_LOW = _divide(np.arange(1 << 12, dtype=np.int64))  # syndromes by table: of the low 12 and the high 11 bits
_HIGH = _divide(np.arange(1 << 11, dtype=np.int64) << 12)


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    return (words ^ _LEADERS[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]) >> 11


_BALL = np.array([0, *(1 << np.arange(23))], np.int64)
_SEGMENTS = ((0, 22), (22, 21), (43, 21))  # from the lowest bit


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: the distinct keys of each fingerprint (uint64)."""
    parts = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in _SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        index = np.sort(codeword_index(parts[(i + 1) % 3][:, None] ^ _BALL), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        r, c = np.nonzero(first)
        rows.append(r)
        keys.append(i << 34 | parts[i][r] << 12 | index[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _explode(df: DataFrame, make, name: str) -> DataFrame:
    """``name, fp, id`` for each of the keys that ``make`` gives a fingerprint."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, keys = make(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
        rows = pa.array(rows)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("fp").take(rows), batch.column("id").take(rows)], [name, "fp", "id"])

    return map_arrow(df.select("fp", "id"), each, f"{name} long, fp long, id long")


def midpoints(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ball = np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    return np.repeat(np.arange(len(fp)), 65), (fp[:, None] ^ ball).ravel()


def forests(first: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, most: int) -> set[tuple[int, int]]:
    """Links that connect what is at distance ``most`` or less in each group of neighbouring rows: each id with the least of its piece.

    Groups of one size are compared together; few have anything near.
    """
    out: set[tuple[int, int]] = set()
    for n in np.unique(size[size > 1]).tolist():
        starts = first[size == n]
        step = max(1, (1 << 20) // (n * n))
        for i in range(0, len(starts), step):
            at = starts[i : i + step, None] + np.arange(n)
            a, b = lo[at], hi[at]
            near = np.bitwise_count(a[:, :, None] ^ a[:, None, :]).astype(np.int16) + np.bitwise_count(b[:, :, None] ^ b[:, None, :]) <= most
            near[:, np.arange(n), np.arange(n)] = False
            for g in np.flatnonzero(near.any(axis=(1, 2))).tolist():
                out.update(_connect(near[g], ids[at[g]]))
    return out


def _forest(df: DataFrame, most: int) -> DataFrame:
    """``a, b``: links that connect what is near in each group of ``key`` (of bounded size); columns ``key, lo, hi, id``.

    Rows come sorted by key, so a task holds one batch and the group that goes on in the next.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 4

        def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, lo, hi, ids = cols
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            out = forests(first, np.diff(np.append(first, len(key))), lo.view(np.uint64), hi.view(np.uint64), ids, most)
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [np.concatenate([r, batch.column(k).to_numpy(zero_copy_only=False)]) for r, k in zip(rest, ("key", "lo", "hi", "id"))]
            if not len(cols[0]):
                continue
            end = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
            rest = [c[end:] for c in cols]
            if end:
                yield edges([c[:end] for c in cols])
        if len(rest[0]):
            yield edges(rest)

    return df.select("key", "lo", "hi", "id").repartition("key").sortWithinPartitions("key").mapInArrow(walk, "a long, b long")


def _connect(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Each id with the least of its connected piece."""
    n = len(ids)
    order = np.argsort(ids)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label = rank.copy()
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        if (new == label).all():
            return [(int(ids[i]), int(ids[order[label[i]]])) for i in range(n) if label[i] != rank[i]]
        label = new


def links(nodes: DataFrame, most_paired: int = MOST_PAIRED) -> DataFrame:
    """``a, b`` (ids, a > b) that connect the fingerprints of ``nodes`` (``fp`` distinct, ``id``) that link."""
    keyed = _explode(nodes, golay_keys, "key")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = written(keyed.join(sizes, "key"), "simhash-keys")

    small = sized.where(F.col("n") <= most_paired).select("key", F.col("fp").alias("lo"), F.lit(0).cast("long").alias("hi"), "id")
    found = _forest(small, 2)
    large = sized.where(F.col("n") > most_paired).select("fp", "id").distinct()
    if large.head(1):
        met = _explode(large, midpoints, "mid")
        least = met.groupBy("mid").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b")
        found = found.unionByName(met.join(least, "mid").where("id > b").select(F.col("id").alias("a"), "b"))
    return found.distinct()


#: Parts that the neighbours of a node are dealt into, so that a node with very many is no task of its own.
SALTS = 64


def _dealt(df: DataFrame, by: str) -> DataFrame:
    """``df`` with a salt ``s`` from another column: the rows of a hot key lie in many tasks."""
    return df.withColumn("s", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _joined(dealt: DataFrame, key: str, of: DataFrame) -> DataFrame:
    """``dealt`` (with its salt) joined with one row for each ``key``, which goes to the salts that the key has: no more than there are."""
    places = dealt.select(key, "s").distinct().join(of, key)
    return dealt.join(places, [key, "s"]).drop("s")


def _with_least(edges: DataFrame) -> DataFrame:
    """``a, b, m``: each neighbour b of a, with the least of a's neighbours; a hot a's neighbours stay apart."""
    dealt = _dealt(edges, "b")
    least = dealt.groupBy("a").agg(F.min("b").alias("m"))
    return _joined(dealt, "a", least).select("a", "b", "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, root``: the least id of the component of every id that has an edge (``a > b``)."""
    edges = written(edges.select("a", "b").distinct(), "cc")
    for _ in range(rounds):
        # Large star: every larger neighbour of a node moves to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = written(large.distinct(), "cc")
        # Small star: smaller neighbours of a node, and the node, move to the least of them.
        met = _with_least(large)
        small = met.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(met.select("a", F.col("m").alias("b")).unionByName(small).distinct(), "cc")
        release(edges, large)
        edges = new
        # Done when every node has one edge and no root has an edge of its own.
        if not new.groupBy("a").count().where("count > 1").head(1) and not new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi").head(1):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, most_paired: int = MOST_PAIRED) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (the least id reachable over links)."""
    docs = written(fingerprints(docs, doc_id, text, n), "simhash")
    nodes = written(docs.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    roots = components(links(nodes, most_paired))
    nodes = nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return docs.join(nodes, "fp", "left").select("doc_id", "fp", "component_id")


# ---- near copies: wide fingerprints of word sets

#: Bits of 128 at which fingerprints link, so that their texts are compared.  Texts whose five-word shingles are 0.8 alike differ by about 6 bits, at most
#: by about 14 in nine cases of ten; unrelated texts of one language by more than 30 (figures in the README).
NEAR_BITS = 14
#: Of the six segments of 21 or 22 bits, those whose codeword indices make a key together.
_PAIRS = ((0, 1), (2, 5), (3, 4))


def wide_fingerprint(text: bytes) -> bytes:
    """128 bits on the distinct words of a text, lower-cased (A-Z)."""
    words = set(text.lower().split())
    if not words:
        return bytes(16)
    digest = xxhash.xxh128_digest
    raw = np.frombuffer(b"".join([digest(w) for w in words]), np.uint8).reshape(-1, 16)
    ones = np.zeros(128, np.int64)
    for i in range(0, len(raw), 1 << 15):
        ones += np.unpackbits(raw[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(raw)).tobytes()


def _indices(lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the six segments: the sorted codeword indices of the word's ball, and which of them are the first of their kind."""
    out = []
    for half in (lo, hi):
        for at, n in _SEGMENTS:
            word = ((half >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)
            index = np.sort(codeword_index(word[:, None] ^ _BALL), axis=1)
            out.append((index, np.concatenate([np.ones((len(lo), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)))
    return out


def _wide_keys(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: pairs of codeword indices of two segments, for each of the pairs."""
    index = _indices(lo, hi)
    rows, keys = [], []
    for p, (i, j) in enumerate(_PAIRS):
        r, a, b = np.nonzero(index[i][1][:, :, None] & index[j][1][:, None, :])
        rows.append(r)
        keys.append(p << 24 | index[i][0][r, a] << 12 | index[j][0][r, b])
    return np.concatenate(rows), np.concatenate(keys)


def _wider_keys(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: each key of two segments with each codeword index of a third: 36 bits, and which segments they are."""
    index = _indices(lo, hi)
    pair = key >> 24
    rows, keys = [], []
    for k in range(6):
        free = ~np.array([k in p for p in _PAIRS])[pair]
        r, c = np.nonzero(index[k][1] & free[:, None])
        rows.append(r)
        keys.append(key[r] << 15 | k << 12 | index[k][0][r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _to_least(edges: DataFrame) -> DataFrame:
    """Links that connect the same: each id keeps the least of those it links with (one a key at most), which the others link with instead."""
    least = F.min("b").over(Window.partitionBy("a"))
    one = edges.distinct().withColumn("m", least)
    return one.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def wide_links(nodes: DataFrame, most: int = NEAR_BITS, most_paired: int = MOST_PAIRED) -> DataFrame:
    """``a, b`` (ids, a > b) that connect the fingerprints of ``nodes`` (``lo, hi`` distinct, ``id``) that share a key and are near.

    Key groups up to ``most_paired`` are compared in one piece.  Members of larger ones are first compared with their
    least one only, which joins what is one large group of copies.  Those that are not in its component meet, of the
    members, only those with which they share a third segment's codeword index too: of unrelated fingerprints one in
    hundreds.  Two fingerprints in reach of each other miss that only if they differ by three bits or more in each of
    the four other segments.
    """

    def columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
        return [batch.column(k).to_numpy(zero_copy_only=False) for k in names]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, keys = _wide_keys(*(c.view(np.uint64) for c in columns(batch, "lo", "hi")))
        rows = pa.array(rows)
        return pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(k).take(rows) for k in ("lo", "hi", "id"))], ["key", "lo", "hi", "id"])

    def wider(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, lo, hi = columns(batch, "key", "lo", "hi")
        rows, keys = _wider_keys(key, lo.view(np.uint64), hi.view(np.uint64))
        rows = pa.array(rows)
        return pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(k).take(rows) for k in ("lo", "hi", "root", "minor"))], ["key", "lo", "hi", "root", "minor"])

    keyed = map_arrow(nodes.select("lo", "hi", "id"), each, "key long, lo long, hi long, id long")
    # Keys with more members than are compared in one piece: few, and a table of their own.
    hot = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most_paired).select("key"), "near-hot")
    if not hot.head(1):
        return _to_least(_forest(keyed, most))
    large = written(keyed.join(hot, "key", "left_semi"), "near-large")
    leaders = large.groupBy("key").agg(F.min(F.struct("id", "lo", "hi")).alias("l")).select("key", F.col("l.id").alias("l_id"), F.col("l.lo").alias("l_lo"), F.col("l.hi").alias("l_hi"))

    def near(other: str):
        return (F.bit_count(F.col("lo").bitwiseXOR(F.col(f"{other}_lo"))) + F.bit_count(F.col("hi").bitwiseXOR(F.col(f"{other}_hi")))) <= most

    star = large.join(leaders, "key").where(near("l") & (F.col("id") > F.col("l_id"))).select(F.col("id").alias("a"), F.col("l_id").alias("b")).distinct()
    found = written(_to_least(_forest(keyed.join(hot, "key", "left_anti"), most).unionByName(star)), "near-links")
    roots = written(components(found), "near-roots")
    # What is not of the leader's component yet meets the members; what is has no need to meet its own.
    rooted = large.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    l_root = leaders.select("key", "l_id").join(roots, F.col("l_id") == F.col("id"), "left").select("key", F.coalesce("root", "l_id").alias("l_root"))
    marked = rooted.join(l_root, "key").withColumn("minor", F.col("root") != F.col("l_root"))
    open_ = marked.where("minor").select("key").distinct()
    longer = written(map_arrow(marked.join(open_, "key", "left_semi").select("key", "lo", "hi", "root", "minor"), wider, "key long, lo long, hi long, root long, minor boolean"), "near-longer")
    minor = longer.where("minor").select("key", F.col("root").alias("m_root"), F.col("lo").alias("m_lo"), F.col("hi").alias("m_hi"))
    # Only what is not connected yet; a pair of two that are minor is met once.
    cross = longer.join(minor, "key").where((F.col("root") != F.col("m_root")) & (~F.col("minor") | (F.col("root") > F.col("m_root"))) & near("m"))
    cross = cross.select(F.greatest("root", "m_root").alias("a"), F.least("root", "m_root").alias("b")).distinct()
    return roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(cross).distinct()


# ---- near copies: links verified by five-word shingles

#: Texts are near copies when their sets of ``SHINGLE``-word shingles have this Jaccard similarity or more (numerator, denominator).
SIMILAR = (4, 5)
SHINGLE = 5


def shingle_set(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles."""
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(s) for s in set(shingles(text, n))), np.uint64))


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which of the sets are near copies of which, by exact counts of what they share."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((n, n), np.int64)
    if size.sum():
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), size)
        often = times[at] > 1  # what one set alone has is shared by none
        number = (np.cumsum(times > 1) - 1)[at[often]]
        owner = owner[often]
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        step = max(1, (1 << 22) // n)
        for lo in range(0, int(number[-1]) + 1 if len(number) else 0, step):
            i, j = np.searchsorted(number, (lo, lo + step))
            has = np.zeros((n, min(step, int(number[-1]) + 1 - lo)), np.float32)
            has[owner[i:j], number[i:j] - lo] = 1
            shared += (has @ has.T).astype(np.int64)
    up, down = SIMILAR
    both = size[:, None] + size[None, :]
    near = (up + down) * shared >= up * both  # shared / (both - shared) >= up / down
    near[np.diag_indices(n)] = False
    return near


def _verified(df: DataFrame) -> DataFrame:
    """``a, b`` (nodes, a > b): a spanning forest of the near copies in each ``blob`` (of bounded size); columns ``blob, node, t``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, {}

        def edges() -> pa.RecordBatch:
            out = _connect(similar(list(sets.values())), np.array(list(sets), np.int64)) if len(sets) > 1 else []
            a, b = zip(*out) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for blob, node, t in zip(batch.column("blob").to_pylist(), batch.column("node").to_pylist(), texts(batch, "t")):
                if blob != now:
                    if len(sets) > 1:
                        yield edges()
                    now, sets = blob, {}
                if node not in sets:
                    sets[node] = shingle_set(t)
        if len(sets) > 1:
            yield edges()

    bound_batches(df.sparkSession)
    return df.select("blob", "node", "t").repartition("blob").sortWithinPartitions("blob").mapInArrow(walk, "a long, b long")


def _across(large: DataFrame, inside: DataFrame) -> DataFrame:
    """``a, b``: the near copies in large blobs that are not yet connected; ``large``: ``blob, node, t``, ``inside``: ``id, root``.

    Two sets at similarity s share one of their rarest 1 - s parts, in any one order of all shingles: here by how many
    texts of the blob have them.  What the blob's main piece has is connected, so only pairs with a text outside it meet.
    """
    up, down = SIMILAR

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t).view(np.int64) for t in texts(batch, "t")]
        empty = np.zeros(1, np.int64)  # texts without a word are near copies of each other
        return pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("node"), pa.array([s if len(s) else empty for s in sets], pa.list_(pa.int64()))], ["blob", "node", "s"])

    sets = written(map_arrow(large, hashes, "blob long, node long, s array<long>"), "near-sets")
    rooted = sets.select("blob", "node").join(inside, F.col("node") == F.col("id"), "left").select("blob", "node", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "near-rooted")
    most = rooted.groupBy("blob", "root").agg(F.count("*").alias("n")).groupBy("blob").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    outer = _joined(_dealt(rooted, "node"), "blob", most).withColumn("outer", F.col("root") != F.col("main")).select("node", "root", "outer")

    each = sets.select("blob", "node", F.size("s").alias("size"), F.explode("s").alias("x"))
    times = each.groupBy("blob", "x").agg(F.count("*").alias("n"))
    rare = each.join(times, ["blob", "x"]).groupBy("blob", "node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("by"))
    keep = (F.col("size") - F.ceil(F.col("size") * up / down) + 1).cast("int")
    keys = rare.withColumn("key", F.explode(F.slice("by", F.lit(1), keep))).where("key.n > 1").select("blob", "node", "size", F.col("key.x").alias("x"))
    keys = written(keys.join(outer, "node"), "near-prefixes")
    other = keys.select("blob", "x", F.col("node").alias("m"), F.col("size").alias("m_size"), F.col("root").alias("m_root"), F.col("outer").alias("m_outer"))
    sizes_near = (F.col("size") * down >= F.col("m_size") * up) & (F.col("m_size") * down >= F.col("size") * up)
    once = ~F.col("m_outer") | (F.col("node") > F.col("m"))
    pairs = keys.where("outer").join(other, ["blob", "x"]).where((F.col("root") != F.col("m_root")) & once & sizes_near).select("node", "m").distinct()
    met = pairs.join(sets.select("node", "s"), "node").join(sets.select(F.col("node").alias("m"), F.col("s").alias("m_s")), "m")
    shared = F.size(F.array_intersect("s", "m_s"))
    near = met.where(shared * (up + down) >= (F.size("s") + F.size("m_s")) * up)
    return near.select(F.greatest("node", "m").alias("a"), F.least("node", "m").alias("b"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = NEAR_BITS, most_paired: int = MOST_PAIRED) -> DataFrame:
    """One row per document: ``doc_id, text_hash, component_id, component_hash``.

    The last two name the document with the least id (of that, the least hash) reachable over near copies, which are
    texts whose five-word shingles have a Jaccard similarity of 0.8 or more.  ``text_hash`` tells rows of one id apart;
    a null text counts as empty, and a null id comes after all others.

    Fingerprints only say what to compare: texts whose fingerprints are reachable from each other make a blob, and every
    pair in a blob that is not connected yet is compared by exact shingle sets.  Blobs up to ``most_paired`` texts
    are compared in one piece; larger ones in pieces of about that size, then what these leave apart by rare shingles.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("t"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = np.frombuffer(b"".join([wide_fingerprint(t) for t in texts(batch, "t")]), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "text_hash", "lo", "hi"])

    rows = written(map_arrow(docs, each, "doc_id long, text_hash long, lo long, hi long"), "near")
    # A node is a text, with the least id that has it; numbers of their own tell nodes apart where ids repeat.
    nodes = rows.groupBy("lo", "hi", "text_hash").agg(F.min("doc_id").alias("least_id"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    prints = written(nodes.groupBy("lo", "hi").agg(F.min("node").alias("id")), "near-prints")
    roots = components(wide_links(prints, most, most_paired))
    blobs = prints.join(roots, "id", "left").select("lo", "hi", F.coalesce("root", "id").alias("blob"))
    members = nodes.join(blobs, ["lo", "hi"]).select("blob", "node", "least_id", "text_hash")
    sizes = members.groupBy("blob").agg(F.count("*").alias("n")).where("n > 1")
    members = _joined(_dealt(members, "node"), "blob", sizes).select("blob", "n", "node", F.col("least_id").alias("doc_id"), "text_hash")
    # Repeated rows give a node more than once: the same text each time.
    members = members.withColumnsRenamed({"doc_id": "m_id", "text_hash": "m_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash"))
    compared = written(docs.join(members.hint("merge"), same).select("blob", "n", "node", "t"), "near-texts")
    found = _verified(compared.where(F.col("n") <= most_paired))
    large = compared.where(F.col("n") > most_paired).dropDuplicates(["node"])
    if large.head(1):
        parts = F.ceil(F.col("n") * 2 / most_paired)
        inside = _verified(large.withColumn("blob", F.xxhash64("blob", F.pmod(F.xxhash64("node"), parts))))
        # All meet a second time, with other neighbours: that joins the pieces.
        again = _verified(large.withColumn("blob", F.xxhash64("blob", F.lit(1), F.pmod(F.xxhash64("node", F.lit(1)), parts))))
        inside = written(inside.unionByName(again).distinct(), "near-inside")
        found = found.unionByName(inside).unionByName(_across(large.select("blob", "node", "t"), written(components(inside), "near-pieces")))
    roots = components(found)
    named = nodes.join(roots, F.col("node") == F.col("id"), "left").select("lo", "hi", "text_hash", "least_id", F.coalesce("root", "node").alias("root"))
    named = written(named, "near-named")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull(), "least_id", "text_hash")).alias("f"))
    named = named.join(first, "root").select("lo", "hi", "text_hash", F.col("f.least_id").alias("component_id"), F.col("f.text_hash").alias("component_hash"))
    return rows.join(named, ["lo", "hi", "text_hash"], "left").select("doc_id", "text_hash", "component_id", "component_hash")
