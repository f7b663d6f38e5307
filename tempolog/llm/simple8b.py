"""Simple-8b: word-aligned coding of token ids, and the file format around it.

A 64-bit word has a selector in its top four bits and values in the other 60.
A selector says how many values of how many bits follow, from the lowest bit
on (:data:`SELECTORS`).  Selector 15 is the escape: the next word is one value
of 64 bits.  The last word of a block may hold fewer values than it has room
for; the block's count says how many belong to it.

A file (all numbers little-endian, unsigned)::

    "TS8B" | version u32 | blocks u64 | documents u64 | ids u64
    documents: doc_id i64, n_ids u64                 (16 bytes each; the top bit of n_ids marks a null id)
    blocks:    offset u64 of the first word, ids u64 (16 bytes each, offset from the first block)
    words:     u64 each, block after block

Blocks hold ``BLOCK_IDS`` ids each (the last fewer), start at a word of their
own, and can be decoded alone: a reader seeks by the two tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

#: (values, bits each) by selector; fixed values of the coding, but for 0 (values are zero) and 15 (escape).
SELECTORS = ((240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK_IDS = 1 << 14
MAGIC, VERSION = b"TS8B", 2
_NO_ID = 1 << 63
_COUNT = np.array([n for n, _ in SELECTORS] + [1])
_BITS = np.array([b for _, b in SELECTORS] + [64])


def _width(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    if len(values) and int(values.max()) < 1 << 24:
        return _WIDTH_OF[np.frexp(values.astype(np.float32))[1]]
    out = np.zeros(len(values), np.uint8)
    for b in range(64):
        out[values >> np.uint64(b) != 0] = b + 1
    return out


_WIDTH_OF = np.arange(64, dtype=np.uint8)


def encode(values: np.ndarray) -> np.ndarray:
    """The words of some ids (uint64)."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    width = _width(values)
    # The selector at every position if a word began there: the densest whose values all fit.
    # Past the end there is room for anything, so the last word may be partly empty.
    sel = np.full(n, ESCAPE, np.uint8)
    longest = np.concatenate([width, np.zeros(240, np.uint8)])
    reach = {1: longest}
    span = 1
    while span < 240:  # greatest width of the next 1, 2, 4, ... values
        prev = reach[span]
        nxt = prev.copy()
        nxt[:-span] = np.maximum(prev[:-span], prev[span:])
        span *= 2
        reach[span] = nxt
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[s]
        p = 1 << (count.bit_length() - 1)
        most = reach[p][:n] if p == count else np.maximum(reach[p][:n], reach[p][count - p : count - p + n])
        sel[most <= bits] = s
    step = _COUNT[sel].tolist()
    starts, i = [], 0
    add = starts.append
    while i < n:
        add(i)
        i += step[i]
    at = np.array(starts)
    kind = sel[at]
    words = kind.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(240, np.uint64)])
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(kind == s)
        if bits and len(mine):
            got = padded[at[mine, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[mine] |= np.bitwise_or.reduce(got, axis=1)
    esc = np.flatnonzero(kind == ESCAPE)
    return np.insert(words, esc + 1, values[at[esc]]) if len(esc) else words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids in some words: all words of one selector at once."""
    words = np.ascontiguousarray(words, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(kind == ESCAPE).tolist():  # in order: the word after an escape isn't a selector's
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, _COUNT[kind])
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s, (m, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero((kind == s) & ~raw)
        if bits and len(mine):
            out[at[mine, None] + np.arange(m)] = words[mine, None] >> (np.arange(m, dtype=np.uint64) * np.uint64(bits)) & np.uint64((1 << bits) - 1)
    esc = np.flatnonzero((kind == ESCAPE) & ~raw)
    out[at[esc]] = words[esc + 1]
    return out[:n]


class Writer:
    """Collects documents' ids and writes one file."""

    def __init__(self):
        self.docs: list[tuple[int, int]] = []
        self.blocks: list[tuple[int, int]] = []
        self.words: list[bytes] = []
        self.ids = self.at = self.held = 0
        self.rest: list[np.ndarray] = []

    @property
    def bytes(self) -> int:
        """Of the file, nearly: words, what is not packed yet, and the table of documents."""
        return self.at + 4 * self.held + 16 * len(self.docs)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((0, len(ids) - _NO_ID) if doc_id is None else (doc_id, len(ids)))
        self.ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        rest = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        end = len(rest) if all_ else len(rest) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, end, BLOCK_IDS):
            ids = rest[i : i + BLOCK_IDS]
            words = encode(ids).astype("<u8").tobytes()
            self.blocks.append((self.at, len(ids)))
            self.words.append(words)
            self.at += len(words)
        self.rest, self.held = [rest[end:].copy()], len(rest) - end

    def write(self, out: BinaryIO) -> None:
        self._flush(True)
        out.write(MAGIC + np.array([VERSION], "<u4").tobytes() + np.array([len(self.blocks), len(self.docs), self.ids], "<u8").tobytes())
        out.write(np.array(self.docs, "<i8").reshape(-1, 2).tobytes())
        out.write(np.array(self.blocks, "<u8").reshape(-1, 2).tobytes())
        for w in self.words:
            out.write(w)


def read(file: BinaryIO) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of every document in a file, a few blocks in memory at a time."""
    head = file.read(32)
    if head[:4] != MAGIC or int.from_bytes(head[4:8], "little") != VERSION:
        raise ValueError("not a file of this format")
    n_blocks, n_docs, _ = np.frombuffer(head[8:], "<u8").tolist()
    docs = np.frombuffer(file.read(16 * n_docs), "<i8").reshape(-1, 2).tolist()
    blocks = np.frombuffer(file.read(16 * n_blocks), "<u8").reshape(-1, 2).tolist()
    offsets = [o for o, _ in blocks]
    have, rest, k = 0, [], 0
    for doc_id, n in docs:
        if n < 0:
            doc_id, n = None, n + _NO_ID
        while have < n:
            size = offsets[k + 1] - offsets[k] if k + 1 < n_blocks else None
            ids = decode(np.frombuffer(file.read() if size is None else file.read(size), "<u8"), blocks[k][1])
            rest.append(ids)
            have += len(ids)
            k += 1
        all_ = rest[0] if len(rest) == 1 else np.concatenate(rest) if rest else np.zeros(0, np.uint64)
        yield doc_id, all_[:n]
        rest, have = [all_[n:]], have - n
