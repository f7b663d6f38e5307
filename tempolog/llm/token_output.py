"""Token ids of a corpus, in binary files in ascending order of document.

Rows are range-partitioned and sorted by id (the sampling reads ids and hashes
only), and each task encodes its texts and writes Simple-8b files of about
``FILE_BYTES`` (:mod:`.simple8b`) to the shared folder.  A file is written under
a name of its attempt and then renamed, so a task that is run again leaves whole
files only, and the manifest names those of the attempt that counted.

The tokenizers library encodes whole texts, some at a time.  Only a text of
more than ``PIECE_CHARS`` is handed to it in pieces, cut before spaces, and only
where the tokenizer is found to cut there itself (:meth:`Encoder.cuts_at_spaces`).
Steps of the tokenizer that leave a text's ids as they are are not run on it
(:class:`Encoder`): it is the library, the file's model and the whole text still.

Edge cases: a null or empty text has the end id alone; ids are integers (cast
to bigint), null ones come first and are marked in the files; rows of one id
come in the order of their texts' hash, so that reruns agree, and equal rows
are alike; other columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import bound_batches, shared_path

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END_ID = 1
FILE_BYTES = 8 << 20
#: Characters handed to the library at once, about; longer texts are cut where that is exact.
PIECE_CHARS = 1 << 20


#: The steps around the model that :class:`Encoder` knows shorter forms of, as tokenizer files write them.
_STEPS = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: The same pieces: the alternatives moved to the front begin with characters of their own, and nothing follows a run that could make it shorter.
_PIECES = r"\p{L}++|\p{N}|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]++"
#: Bytes of texts that byte-level writing leaves alone (or that separate pieces), and of UTF-8 below U+0300.
_PLAIN = bytes([9, 10, 13, *range(32, 127)])
_LOW = bytes(range(0xCC))


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers; one in each worker.

    With a tokenizer of the steps :data:`_STEPS`, a text without added tokens
    skips the steps that cannot change its ids.  Below U+0300 nothing composes,
    so NFC is the identity; lower-casing is Python's, the same there character by
    character; a run of white space is dropped between pieces whether or not it
    was made one space.  In printable ASCII, byte-level writing is the identity
    too.  All other texts, and all texts with other tokenizers, take every step.
    """

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.low = self.plain = None  # for texts below U+0300, and in printable ASCII; both with the model of ``full``
        self._cuts: bool | None = None
        spec = json.loads(Path(path).read_text("utf-8"))
        self._added = [t["content"] for t in spec["added_tokens"]]
        if {k: spec.get(k) for k in _STEPS} == _STEPS and not any(t["normalized"] for t in spec["added_tokens"]):
            split = pre_tokenizers.Split(Regex(_PIECES), "removed", invert=True)
            self.low, self.plain = Tokenizer(self.full.model), Tokenizer(self.full.model)
            self.low.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.plain.pre_tokenizer = split

    def _steps(self, text: str) -> tuple[Tokenizer, str]:
        """The tokenizer whose steps this text needs, and the text as that one takes it."""
        if self.low is None:
            return self.full, text
        raw = text.encode()
        if not text.isascii() and raw.translate(None, _LOW):
            return self.full, text
        lower = text.lower()
        if any(a in text or a in lower for a in self._added):
            return self.full, text
        return (self.low if raw.translate(None, _PLAIN) else self.plain), lower

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        taken = [self._steps(t) for t in texts]
        for tokenizer in (self.full, self.low, self.plain):
            mine = [i for i, (t, _) in enumerate(taken) if t is tokenizer]
            if mine:
                for i, e in zip(mine, tokenizer.encode_batch_fast([taken[i][1] for i in mine], add_special_tokens=False)):
                    out[i] = np.array(array("I", e.ids), "<u4")
        return out

    @property
    def cuts_at_spaces(self) -> bool:
        """Whether this tokenizer takes what stands before and after a space alone: its own pieces never hold a space, nor do its added tokens."""
        if self._cuts is None:
            probe = "ab  cd 's x_,y 12 3.5 É́ ́ 日本 語。 ¿ \n \t\u2003z  "
            pre = self.full.pre_tokenizer
            pieces = [w for w, _ in pre.pre_tokenize_str(probe)] if pre else [probe]
            apart = [i for i in range(1, len(probe)) if probe[i] == " " and self._ids([probe])[0].tolist() != np.concatenate(self._ids([probe[:i], probe[i:]])).tolist()]
            spaced = any(" " in w or "\u0120" in w or "\u2581" in w for w in pieces)  # a space as byte-level and sentence-piece tokenizers write it
            self._cuts = not spaced and not apart and not any(" " in t.content for t in self.full.get_added_tokens_decoder().values())
        return self._cuts

    def _pieces(self, text: str) -> list[str]:
        out = []
        at = 0
        while len(text) - at > PIECE_CHARS and self.cuts_at_spaces:
            cut = text.rfind(" ", at + 1, at + PIECE_CHARS)
            if cut < 0 and (cut := text.find(" ", at + PIECE_CHARS)) < 0:
                break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; about ``PIECE_CHARS`` characters go to the library at a time."""
        held: list[str] = []
        size = 0
        for t in texts:
            if len(t) > PIECE_CHARS:
                yield from self._ids(held)
                held, size = [], 0
                yield np.concatenate([self._ids([p])[0] for p in self._pieces(t)])
                continue
            held.append(t)
            size += len(t)
            if size > PIECE_CHARS:
                yield from self._ids(held)
                held, size = [], 0
        yield from self._ids(held)


_MANIFEST = "task long, n long, path string, docs long, ids long"


def _write_task(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, end_id: int, file_bytes: int) -> Iterator[pa.RecordBatch]:
    fs, root = pafs.FileSystem.from_uri(path)
    task = TaskContext.get().partitionId()
    encoder = Encoder.of(tokenizer)
    end = np.array([end_id], "<u4")
    made: list[tuple[int, int, str, int, int]] = []
    out = None

    def close() -> None:
        name = f"part-{task:06d}-{len(made):05d}-{uuid.uuid4().hex}.s8b"
        with fs.open_output_stream(f"{root}/_{name}") as f:
            out.write(f)
        fs.move(f"{root}/_{name}", f"{root}/{name}")
        made.append((task, len(made), f"{path}/{name}", len(out.docs), out.ids))

    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([t or "" for t in batch.column("t").to_pylist()])):
            out = out or simple8b.Writer()
            out.add(doc_id, np.concatenate([ids, end]))
            if out.bytes >= file_bytes:
                close()
                out = None
    if out:
        close()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["task", "n", "path", "docs", "ids"])


def write(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files; returns the manifest: ``task, n, path, docs, ids, start``, files of a task in the order of ``n``."""
    spark = docs.sparkSession
    bound_batches(spark)
    path = shared_path(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    ranged = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "t").select("doc_id", "t")
    made = ranged.mapInArrow(lambda it: _write_task(it, path, tokenizer, end_id, file_bytes), _MANIFEST)
    made.write.parquet(f"{path}/_manifest")  # one row a file
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest")
    # What came before: the tasks before (one row a task), and the task's own files before.
    tasks = manifest.groupBy("task").agg(F.sum("ids").alias("_ids"))
    tasks = tasks.select("task", F.sum("_ids").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.sum("ids").over(Window.partitionBy("task").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("_own", own).join(tasks, "task").select("task", "n", "path", "docs", "ids", (F.coalesce("_before", F.lit(0)) + F.coalesce("_own", F.lit(0))).alias("start"))


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_stream(name) as f:
                rows = []
                for doc_id, ids in simple8b.read(f):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """From the files: ``doc_id, start, n_tokens, ids_crc32``, one row per document."""
    files = manifest.select("path", "start").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return files.mapInArrow(_read_task, "doc_id long, start long, n_tokens long, ids_crc32 long")
