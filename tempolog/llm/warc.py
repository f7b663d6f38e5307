"""WARC files and their Merkle fixity audit.

``write`` turns pages into WARC/1.1 response records, one gzip member each, in
files of about ``FILE_BYTES``, and returns the index: which record lies where.
``trees`` hashes every record of a replica by the index (offset, length and
stored bytes), what lies after the last record, and ordered runs of ``FANOUT``
nodes up to one root a file; a task makes the tree of a file in one reading, as
a file's size bounds it.  ``audit`` compares the roots of two replicas, then,
level by level, only the children of nodes that differ, down to the damage.

Files are written under a name of their own and renamed when whole, so tasks
may run again.  Rows keep their order; nothing is shuffled to write.

Edge cases: null columns are written as empty; ids are integers (cast to
bigint); an empty table gives no file; a file that is missing or cut short in a
replica yields the hash of what is there; bytes after a file's last record are
found as a record after the last, files beyond the index as one record each
(without a page); repeated rows are records of their own, in any order among
themselves; other columns are ignored, whatever their names.  A page is held
whole, so the longest one must fit a worker.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, shared_path, written

FILE_BYTES = 8 << 20
FANOUT = 16
DATE = "2024-01-01T00:00:00Z"
_INDEX = "file string, seq long, page_id long, `offset` long, length long"


def record(page_id: int | None, url: bytes, html: bytes) -> bytes:
    """One response record, as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html
    uid = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{url.decode('utf-8', 'replace')}")
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{uid}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: ".encode() + b" ".join(url.split())
    head += f"\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(html).hexdigest()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(head + http + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one stored record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines if ": " in line)
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _save(path: str, name: str, parts: list[bytes]) -> None:
    fs, root = pafs.FileSystem.from_uri(path)
    own = f"{root}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as f:
        for p in parts:
            f.write(p)
    fs.move(own, f"{root}/{name}")


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """The folder, and the index ``file, seq, page_id, offset, length``."""
    bound_batches(pages.sparkSession)
    path = shared_path(pages.sparkSession, "warc")
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        rows: list[tuple] = []
        at = n = 0

        def close() -> pa.RecordBatch:
            name = f"part-{TaskContext.get().partitionId():06d}-{n:05d}-{uuid.uuid4().hex[:12]}.warc.gz"
            _save(path, name, held)
            seq, ids, offset, length = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(seq)), pa.array(seq), pa.array(ids, pa.int64()), pa.array(offset), pa.array(length)], ["file", "seq", "page_id", "offset", "length"])

        for batch in batches:
            for i, u, h in zip(batch.column("i").to_pylist(), batch.column("u").cast(pa.binary()).to_pylist(), batch.column("h").cast(pa.binary()).to_pylist()):
                held.append(record(i, u or b"", h or b""))
                rows.append((len(rows), i, at, len(held[-1])))
                at += len(held[-1])
                if at >= file_bytes:
                    yield close()
                    held, rows, at, n = [], [], 0, n + 1
        if rows:
            yield close()

    rows = pages.select(F.col(page_id).cast("long").alias("i"), F.col(url).alias("u"), F.col(html).alias("h"))
    return path, written(rows.mapInArrow(task, _INDEX), "warc-index")


def copy(path: str, index: DataFrame, damage: Callable[[int | None, bytes], bytes] | None = None) -> str:
    """A replica of the files; ``damage`` may change the stored bytes of a record (for drills and tests)."""
    to = shared_path(index.sparkSession, "warc-copy")
    fs, root = pafs.FileSystem.from_uri(to)
    fs.create_dir(root, recursive=True)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        for name, recs in zip(batch.column("file").to_pylist(), batch.column("recs").to_pylist()):
            data = _load(path, name)
            parts = [data[r["offset"] : r["offset"] + r["length"]] for r in recs]
            _save(to, name, [damage(r["page_id"], p) for r, p in zip(recs, parts)] if damage else parts)
        return batch.select(["file"])

    _by_file(index, each, "file string").write.format("noop").mode("overwrite").save()
    return to


def _load(path: str, name: str) -> bytes:
    fs, root = pafs.FileSystem.from_uri(path)
    try:
        with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
            return f.read()
    except FileNotFoundError:
        return b""


def _by_file(index: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` on one row a file, with its records in order: a file's size bounds them."""
    files = index.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "page_id", "offset", "length"))).alias("recs"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file in memory at a time
                yield fn(batch.slice(i, 1))

    return files.mapInArrow(task, schema)


def leaf(offset: int, data: bytes) -> str:
    return hashlib.sha256(struct.pack("<QQ", offset, len(data)) + data).hexdigest()


def node(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def tree(data: bytes, recs: list[tuple[int, int]], fanout: int = FANOUT) -> list[list[str]]:
    """Levels of hashes: records and what follows them, then runs of ``fanout`` nodes, up to the root alone."""
    end = max((o + n for o, n in recs), default=0)
    out = [[leaf(o, data[o : o + n]) for o, n in recs] + [leaf(end, data[end:])]]
    while len(out[-1]) > 1:
        out.append([node(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def trees(path: str, index: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``file, level, node, hash, root`` of the replica at ``path``; files beyond the index are one leaf, missing ones hash as empty."""
    names = index.sparkSession.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file")).where("file not like '\\_%'")
    recs = index.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "offset", "length"))).alias("recs"))
    files = names.distinct().join(recs, "file", "full")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, r in zip(batch.column("file").to_pylist(), batch.column("recs").to_pylist()):
                made = tree(_load(path, name), [(x["offset"], x["length"]) for x in r or ()], fanout)
                for level, hashes in enumerate(made):
                    n = len(hashes)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([level] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(hashes), pa.array([level + 1 == len(made)] * n)], ["file", "level", "node", "hash", "root"])

    return files.mapInArrow(task, "file string, level int, node long, hash string, root boolean")


def audit(index: DataFrame, one: str, other: str, fanout: int = FANOUT) -> DataFrame:
    """The records that differ between two replicas: ``file, seq, hash_one, hash_other``.

    A tree is read by level: of a level, only the children of what differs above are joined.
    """
    a, b = (written(trees(p, index, fanout), "warc-tree", by="level") for p in (one, other))
    roots = [t.where("root").select("file", "level", "node", F.col("hash").alias(name)) for t, name in ((a, "hash_one"), (b, "hash_other"))]
    wrong = roots[0].join(roots[1], ["file", "level", "node"], "full").where(~F.col("hash_one").eqNullSafe(F.col("hash_other")))
    wrong = written(wrong, "warc-roots")
    top = wrong.agg(F.max("level")).first()[0]
    found = wrong.where("level = 0")
    for level in range(top or 0, 0, -1):
        parents = wrong.where(F.col("level") == level).select("file", F.col("node").alias("parent")).distinct()
        below = [
            t.where(F.col("level") == level - 1).withColumn("parent", F.expr(f"node div {fanout}")).join(parents, ["file", "parent"], "left_semi").select("file", "level", "node", F.col("hash").alias(name))
            for t, name in ((a, "hash_one"), (b, "hash_other"))
        ]
        differ = below[0].join(below[1], ["file", "level", "node"], "full").where(~F.col("hash_one").eqNullSafe(F.col("hash_other")))
        # Roots of smaller files stand at this level too.
        wrong = written(differ.unionByName(wrong.where(F.col("level") < level)).distinct(), "warc-wrong")
        found = wrong.where("level = 0")
    return found.select("file", F.col("node").alias("seq"), "hash_one", "hash_other")
