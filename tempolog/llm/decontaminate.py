"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a text with up to k = m * rate edits.
It is split into k + 1 pieces; k edits can't touch them all, so one piece
stands unchanged.  One Aho-Corasick pass over a text finds every piece; each
hit gives the window where the item would lie, and Myers' bit-parallel
algorithm gives the least edit distance of the item to a substring of it.

Texts and items are compared as lower-cased letters and digits with one space
between words and around the whole.  Items are dealt into blocks of a bounded
number of characters by executors, and lie in the shared folder; the driver
only counts them.  Each block is matched against all rows, so a benchmark of
any size keeps an automaton that fits a worker, at the price of one pass a
block of a million characters.

Edge cases: null or empty texts and items match nothing; an item too short for
one edit is searched for exactly; equal items are all reported; ids of rows and
of items are of any type; repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import ahocorasick
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_arrow, shared_path

#: Edits allowed for each character of an item.
RATE = 0.05
#: Characters of items in one block, and so in one automaton (about 100 bytes of memory each).
BLOCK_CHARS = 1_000_000
_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    words = _GAP.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, each with its offset."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to a substring of ``text``, and where the first such substring ends."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Block:
    """The automaton of some items."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            for at, piece in pieces(t, k):
                found[piece].append((n, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        if found:
            self.auto.make_automaton()

    def matches(self, text: str) -> list[tuple[object, int, int, int]]:
        """``(item_id, errors, from, to)``: the best place in the normalised text of each item that it holds."""
        if not self.items:
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (n, where) in self.auto.iter(text):
            for item, at in where:
                starts[item].append(end + 1 - n - at)
        out = []
        for n, diagonals in starts.items():
            item, t, k = self.items[n]
            m, best = len(t), None
            for s in dict.fromkeys(diagonals):
                if text[max(s, 0) : s + m] == t:
                    best = (0, s, s + m)
                    break
            lo = hi = None
            for s in [] if best else [*sorted(set(diagonals)), None]:
                if lo is not None and (s is None or s > hi + 2 * k + 1):
                    a, b = max(0, lo - k), hi + m + k
                    errors, end = myers(t, text[a:b])
                    if errors <= k and (best is None or errors < best[0]):
                        best = (errors, max(0, a + end - m), a + end)
                    lo = None
                if s is not None:
                    lo, hi = (s if lo is None else lo), s
            if best:
                out.append((item, *best))
        return sorted(out, key=lambda r: (str(r[0]), r[1:]))


def blocks(items: DataFrame, item_id: str, text: str, block_chars: int, unnamed: bool = False) -> list[str]:
    """Paths of the test items ``i, t`` in blocks of about ``block_chars`` characters; with ``unnamed`` those without an id too.

    A block is a hash of the item's text: items that are equal share one, the others are spread evenly.
    """
    spark = items.sparkSession
    items = items.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    items = (items if unnamed else items.where("i is not null")).where(F.length("t") > 0)
    n = -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars)
    if not n:
        return []
    out = shared_path(spark, "items")
    items.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(n)).cast("int")).repartition(min(n, 200), "block").write.partitionBy("block").parquet(out)
    return [f"{out}/block={k}" for k in range(n)]


def load_block(path: str) -> list[tuple[object, str]]:
    """The items of a block, normalised, in order; equal ones too."""
    fs, root = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(root).type == pafs.FileType.NotFound:  # no item fell there
        return []
    got = pq.read_table(root, filesystem=fs, partitioning=None)
    return [(i, n) for i, t in zip(got["i"].to_pylist(), got["t"].to_pylist()) if (n := normalise(t))]


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document and test item that it holds: ``doc_id, item_id, errors, start, end``.

    ``start`` and ``end`` are characters of the normalised text; ``errors`` is the least edit distance.
    Items without an id can't be named and give no row.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kinds = docs.schema["doc_id"].dataType, items.schema[item_id].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, errors int, `start` int, `end` int"
    out = None
    for path in blocks(items, item_id, item_text, block_chars):
        found = map_arrow(docs, _Matcher(path, rate, to_arrow_type(kinds[1])), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no test item, items without an id included, with all their columns, in one pass a block: nothing is shuffled."""
    for path in blocks(items, item_id, item_text, block_chars, unnamed=True):
        docs = map_arrow(docs, _Filter(path, rate, text), docs.schema)
    return docs


class _Matcher:
    """Builds its block's automaton once in each worker."""

    def __init__(self, path: str, rate: float, kind: pa.DataType | None = None):
        self.path, self.rate, self.kind, self._block = path, rate, kind, None

    def __getstate__(self):
        return self.__dict__ | {"_block": None}

    @property
    def block(self) -> Block:
        if self._block is None:
            self._block = Block(load_block(self.path), self.rate)
        return self._block

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = [], []
        for n, t in enumerate(batch.column("t").to_pylist()):
            found = self.block.matches(normalise(t)) if t else []
            at += [n] * len(found)
            rows += found
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(cols[0], self.kind), *(pa.array(c, pa.int32()) for c in cols[1:])],
            ["doc_id", "item_id", "errors", "start", "end"],
        )


class _Filter(_Matcher):
    def __init__(self, path: str, rate: float, text: str):
        super().__init__(path, rate)
        self.text = text

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = [not (t and self.block.matches(normalise(t))) for t in batch.column(self.text).to_pylist()]
        return batch.filter(pa.array(clean, pa.bool_()))
