"""``spark.read.format("tlog")``: log files as relations, with chunk pruning, a writer and a stream.

Options: ``path`` (files or folders, comma-separated), ``relation`` (default
``messages``), ``topics`` (comma-separated), ``start`` and ``end`` (nanoseconds),
``payload`` (``false`` leaves payloads out), ``validateCrc``,
``recordLengthLimit``, ``maxDecompressedSize``, ``mode`` (``PERMISSIVE``
salvages), ``emitInvalidChunks`` (rows of chunks whose checksum differs),
``dropUndefined`` (messages whose channel is not defined before them go),
``keepUnknown`` (messages of no channel at all stay, without a topic),
``partitionBytes``, ``planFiles``, ``maxScanBytes`` (a scan that would read more
is an error), ``codecs`` (modules to import on executors; they register codecs).
Writing: ``relation`` (messages, attachments or metadata), ``compression``,
``compressionLevel``, ``maxFileMessages`` and ``maxFileBytes`` (a task goes on in
a further file), and the switches of :class:`.records.WriteOptions`.

With ``spark.sql.python.filterPushdown.enabled`` comparisons on ``log_time`` and
equality or IN on ``topic``, ``chunk_offset`` and ``msg_offset`` prune chunks and
messages; Spark still checks them.  Up to ``planFiles`` files are planned chunk by
chunk from their indexes; of more only names and sizes are listed, and each task
reads the index of its file and takes the chunks that begin in its byte range.  A
file without a usable index is read through by one task.  Attachments, metadata
and message indexes are read by offset where the index has them all.
"""

from __future__ import annotations

import importlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..model import ATTACHMENTS, CHANNELS, CHUNKS, MESSAGE_INDEX, MESSAGES, METADATA, SCHEMAS, STATISTICS, LogError
from . import files
from . import records as r

SUFFIX = ".tlog"
_POS = ", file_pos bigint"
RELATIONS = {
    "messages": MESSAGES + _POS, "channels": CHANNELS + _POS, "schemas": SCHEMAS + _POS, "summary_channels": CHANNELS + _POS, "summary_schemas": SCHEMAS + _POS,
    "chunks": CHUNKS, "chunk_index": CHUNKS, "attachments": ATTACHMENTS, "attachment_index": ATTACHMENTS, "metadata": METADATA, "statistics": STATISTICS, "message_index": MESSAGE_INDEX + ", index_offset bigint",
    "header": "file string, profile string, library string", "footer": "file string, summary_start bigint, summary_offset_start bigint, summary_crc bigint",
    "summary_offsets": "file string, group_opcode int, group_start bigint, group_length bigint", "records": "file string, opcode int, kind string, in_chunk boolean, chunk_offset bigint, `offset` bigint, length bigint",
    "raw_records": "file string, opcode int, `offset` bigint, data binary", "problems": "file string, problem string",
}
RELATIONS["recovery"] = "file string, kind string, recovered bigint, discarded bigint, truncated boolean"
#: Relations that the index alone answers.
FROM_SUMMARY = ("summary_channels", "summary_schemas", "chunk_index", "attachment_index", "statistics", "header", "footer", "summary_offsets")


#: What opening a file counts for, in bytes, where small files share a task.
OPEN_BYTES = 256 << 10


@dataclass
class Part(InputPartition):
    """``chunks`` of a file (offset, length), all of it (None), or the chunks that begin in a ``span`` of bytes; then ``more`` whole files.

    Definitions stay in the file: a task reads those that it needs, so that many files of 65,535 channels are no load on the driver.
    """

    path: str
    chunks: list[tuple[int, int]] | None
    span: tuple[int, int] | None = None
    more: list[tuple[str, int]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(self.path)


class Options:
    def __init__(self, raw: dict):
        get = lambda k, d=None: next((v for x, v in raw.items() if x.lower() == k.lower()), d)
        self.path = get("path", "")
        self.relation = get("relation", "messages")
        if self.relation not in RELATIONS:
            raise LogError(f"unknown relation {self.relation}: one of {', '.join(RELATIONS)}")
        self.topics = None if get("topics") is None else set(filter(None, get("topics").split(",")))
        self.start, self.end = int(get("start", 0)), None if get("end") is None else int(get("end"))
        self.payload = str(get("payload", "true")).lower() == "true"
        self.crc = str(get("validateCrc", "true")).lower() == "true"
        self.limit = int(get("recordLengthLimit", 0)) or None
        self.lenient = str(get("mode", "FAILFAST")).upper() == "PERMISSIVE"
        self.part_bytes = int(get("partitionBytes", 32 << 20))
        self.max_scan = int(get("maxScanBytes", 0))
        self.plan_files = int(get("planFiles", 256))
        flag = lambda k: str(get(k, "false")).lower() == "true"
        self.emit_invalid, self.drop_undefined, self.keep_unknown = flag("emitInvalidChunks"), flag("dropUndefined"), flag("keepUnknown")
        self.max_open = int(get("maxDecompressedSize", 0)) or None
        self.chunk_offsets = self.msg_offsets = None
        self.codecs = [m for m in get("codecs", "").split(",") if m]

    def load_codecs(self) -> None:
        for module in self.codecs:
            importlib.import_module(module)

    def scan(self, data: bytes, lenient=None):
        return r.scan(data, self.crc and not self.emit_invalid, self.limit, lenient, self.max_open)


def _i64(v: int, name: str) -> int:
    if v >= 1 << 63:
        raise LogError(f"{name} {v} is beyond 63 bits")
    return v


class LogReader(DataSourceReader):
    def __init__(self, options: Options, schema: StructType):
        self.o, self.schema = options, schema
        self.names = schema.names

    def pushFilters(self, filters):  # noqa: N802
        o = self.o
        for f in filters:
            column = getattr(f, "attribute", ())
            if o.relation == "messages" and column == ("log_time",):
                v = getattr(f, "value", None)
                if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                    o.start = max(o.start, v + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    v += not isinstance(f, LessThan)
                    o.end = v if o.end is None else min(o.end, v)
            if o.relation == "messages" and column == ("topic",) and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                o.topics = some if o.topics is None else o.topics & some
            if o.relation == "messages" and column in (("chunk_offset",), ("msg_offset",)) and isinstance(f, (EqualTo, In)):
                name = column[0] + "s"
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                setattr(o, name, some if getattr(o, name) is None else getattr(o, name) & some)
            yield f  # Spark checks it again

    # ---- planning on the driver

    def partitions(self):
        o = self.o
        o.load_codecs()
        found = files.sized(o.path)
        if len(found) > o.plan_files and not o.max_scan:
            return self._splits(found)
        out, total = [], 0
        for path, _ in found:
            parts = self._plan(path)
            total += sum(sum(n for _, n in p.chunks) if p.chunks is not None else self._size for p in parts)
            out += parts
        if o.max_scan and total > o.max_scan:
            raise LogError(f"the scan would read {total} bytes; maxScanBytes is {o.max_scan}")
        return out or [Part("", [])]

    def _splits(self, found: list[tuple[str, int]]) -> list[Part]:
        """By name and size alone: nothing is opened here; small files share a task."""
        step, room = self.o.part_bytes, 0
        whole = self._whole()
        out: list[Part] = []
        for p, size in found:
            if not whole and size > step:
                out += [Part(p, None, (at, at + step)) for at in range(0, size, step)]
                room = 0
            elif room < size + OPEN_BYTES:
                out.append(Part(p, None, None if whole else (0, max(1, size))))
                room = step - size - OPEN_BYTES
            else:
                out[-1].more.append((p, size))
                room -= size + OPEN_BYTES
        return out

    def _whole(self) -> bool:
        """Whether files are read whole, by one task each at most."""
        return self.o.relation != "messages" or self.o.lenient

    def _index(self, path: str) -> tuple[r.Summary | None, list[dict] | None]:
        """The summary, and the chunks that may have rows; None for the latter where the file must be read through."""
        o = self.o
        f, self._size = files.open_random(path)
        with f:
            try:
                s = r.read_summary(f, self._size, definitions=False)
            except LogError:
                s = None
        if s is None or not s.proves_complete or sum(s.statistics["channel_message_counts"].values()) != s.statistics["message_count"]:
            return s, None
        ids = None if o.topics is None else {i for i, c in s.channels.items() if r.decode(r.CHANNEL, c)["topic"] in o.topics}
        kept = []
        for c in s.chunks:
            if c["end_time"] < o.start or (o.end is not None and c["start_time"] >= o.end):
                continue
            if ids is not None and c["message_index_offsets"] and not ids & c["message_index_offsets"].keys():
                continue
            if o.chunk_offsets is not None and c["chunk_offset"] not in o.chunk_offsets:
                continue
            kept.append(c)
        return s, sorted(kept, key=lambda c: c["chunk_offset"])

    def _plan(self, path: str) -> list[Part]:
        o = self.o
        if self._whole():
            f, self._size = files.open_random(path)
            f.close()
            return [Part(path, None)]
        s, kept = self._index(path)
        if kept is None:
            return [Part(path, None)]
        out: list[Part] = []
        room = 0
        for c in kept:
            if room < c["chunk_length"] or not out:
                out.append(Part(path, []))
                room = o.part_bytes
            out[-1].chunks.append((c["chunk_offset"], c["chunk_length"]))
            room -= c["chunk_length"]
        return out

    # ---- reading on executors

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        self.o.load_codecs()
        if not partition.path:
            return
        parts = [partition, *(Part(p, None, None if self._whole() else (0, max(1, n))) for p, n in partition.more)]
        if self.o.relation == "messages":
            for part in parts:
                yield from self._message_batches(part, arrow)
            return
        rows, size = [], 0
        for row in (row for part in parts for row in relation(part.path, self.o)):
            rows.append({k: v for k, v in row.items() if k in self.names})
            size += len(row.get("data") or b"") + 100
            if len(rows) >= 10_000 or size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def _message_batches(self, p: Part, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Messages as columns: numbers and payloads in lists, what depends on the channel by number of the channel."""
        views: list[tuple] = []  # one for each channel seen: what its messages have in common
        number: dict[tuple, int] = {}
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            which, cid, seq, log, pub, data, chunk, at, pos = zip(*held)
            take = pa.array(which, pa.int32())
            own = {"channel_id": cid, "sequence": seq, "log_time": log, "publish_time": pub, "data": data, "chunk_offset": chunk, "msg_offset": at, "file_pos": pos}
            shared = {"topic": 0, "schema_id": 1, "schema_name": 2, "schema_encoding": 3, "message_encoding": 4}
            cols = []
            for f in arrow:
                if f.name in own:
                    cols.append(pa.array(own[f.name], f.type))
                elif f.name in shared:
                    cols.append(pa.array([v[shared[f.name]] for v in views], f.type).take(take))
                else:
                    cols.append(pa.array([p.path], f.type).take(pa.array([0] * len(held), pa.int32())))
            return pa.RecordBatch.from_arrays(cols, schema=arrow)

        for cid, seq, log, pub, data, view, chunk, at, pos in self._messages(p):
            n = number.get(view)
            if n is None:
                n = number[view] = len(views)
                views.append(view)
            held.append((n, cid, seq, log, pub, data, chunk, at, pos))
            size += 100 + (len(data) if data is not None else 0)
            if len(held) >= 10_000 or size > 8 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def _view(self, path: str, cid: int, channels: dict, schemas: dict) -> tuple | None:
        """What all messages of a channel share; None for those that go."""
        o = self.o
        c = _defined(channels, cid, r.CHANNEL)
        if c is None:
            if o.keep_unknown and o.topics is None:
                return (None,) * 5
            if o.lenient or o.drop_undefined:
                return None
            raise LogError(f"{path}: message of unknown channel {cid}")
        if o.topics is not None and c["topic"] not in o.topics:
            return None
        s = _defined(schemas, c["schema_id"], r.SCHEMA)
        if s is None and c["schema_id"] and not o.lenient:
            raise LogError(f"{path}: channel {cid} has unknown schema {c['schema_id']}")
        return c["topic"], c["schema_id"], s and s["name"], s and s["encoding"], c["message_encoding"]

    def _message(self, path: str, body: memoryview, chunk: int, at: int, views: dict, channels: dict, schemas: dict, pos: int) -> tuple | None:
        # the fixed head first: payloads of rows that go are never copied
        o = self.o
        cid, seq, log, pub = _MESSAGE_HEAD.unpack_from(body)
        if log < o.start or (o.end is not None and log >= o.end) or (o.msg_offsets is not None and at not in o.msg_offsets) or (o.chunk_offsets is not None and chunk not in o.chunk_offsets):
            return None
        if cid not in views:
            views[cid] = self._view(path, cid, channels, schemas)
        view = views[cid]
        if view is None:
            return None
        return cid, seq, _i64(log, "log_time"), _i64(pub, "publish_time"), bytes(body[22:]) if o.payload else None, view, chunk, at, pos

    def _messages(self, p: Part) -> Iterator[tuple]:
        chunks, channels, schemas = p.chunks, {}, {}
        if chunks or p.span is not None:
            s, kept = self._index(p.path)
            if kept is not None:
                channels, schemas = s.channels, s.schemas
                if p.span is not None:
                    chunks = [(c["chunk_offset"], c["chunk_length"]) for c in kept if p.span[0] <= c["chunk_offset"] < p.span[1]]
            elif p.span is None:
                raise LogError(f"{p.path}: the index that the scan was planned by is gone")
            elif p.span[0]:
                return  # the first span reads a file without an index
        if chunks is None:
            yield from self._through(p.path)
            return
        if not chunks:
            return
        f, _ = files.open_random(p.path)
        with f:
            o, views = self.o, {}
            lo, hi, most = o.start, 1 << 64 if o.end is None else o.end, o.limit or 1 << 64
            for start, length in chunks:
                if o.chunk_offsets is not None and start not in o.chunk_offsets:
                    continue
                f.seek(start)
                raw = f.read(length)
                data = r.open_chunk(r.decode(r.CHUNK, memoryview(raw)[9:]), self.o.crc and not self.o.emit_invalid, self.o.max_open)
                known, named = channels, schemas
                at, pos, size = 0, -1, len(data)
                while at < size:
                    pos += 1
                    if size - at >= 31 and data[at] == r.MESSAGE:  # nearly all are messages: no view is made of each
                        _, n, cid, seq, log, pub = r._MESSAGE_RECORD.unpack_from(data, at)
                        end = at + 9 + n
                        if 22 <= n <= most and end <= size:
                            if lo <= log < hi and (o.msg_offsets is None or at in o.msg_offsets):
                                if cid not in views:
                                    views[cid] = self._view(p.path, cid, known, named)
                                if (view := views[cid]) is not None:
                                    if log >= 1 << 63 or pub >= 1 << 63:
                                        _i64(log, "log_time"), _i64(pub, "publish_time")
                                    yield cid, seq, log, pub, data[at + 31 : end] if o.payload else None, view, start, at, pos
                            at = end
                            continue
                    op, _, body = next(r.split(data, at, o.limit))
                    if op == r.MESSAGE:
                        if row := self._message(p.path, body, start, at, views, known, named, pos):
                            yield row
                    elif op in (r.CHANNEL, r.SCHEMA) and len(body) >= 2 and int.from_bytes(body[:2], "little") not in (known if op == r.CHANNEL else named):
                        v = r.decode(op, body)  # the summary has no such id: it goes for this chunk alone
                        if op == r.CHANNEL:
                            known = known | {v["id"]: v}
                        else:
                            named = named | {v["id"]: v}
                        views = {}
                    at += 9 + len(body)
                if known is not channels or named is not schemas:
                    views = {}

    def _through(self, path: str) -> Iterator[tuple]:
        """A file without an index; definitions may follow their use, so a first pass gathers them (unless such messages are to go)."""
        o = self.o
        data = files.read_all(path)
        quiet = _quiet if o.lenient else None
        schemas: dict[int, dict] = {}
        channels: dict[int, dict] = {}

        def define(op: int, body: memoryview) -> None:
            try:
                v = r.decode(op, body)
            except LogError:
                if not o.lenient:
                    raise
                return
            known = schemas if op == r.SCHEMA else channels
            if known.setdefault(v["id"], v) != v and not o.lenient:
                raise LogError(f"{path}: {r.NAMES[op]} {v['id']} is defined twice, differently")

        if not o.drop_undefined:
            for op, _, _, body in o.scan(data, quiet):
                if op in (r.SCHEMA, r.CHANNEL):
                    define(op, body)
        views: dict[int, tuple | None] = {}
        for pos, (op, chunk, at, body) in enumerate(o.scan(data, quiet)):
            if op == r.MESSAGE and len(body) >= 22:
                if row := self._message(path, body, chunk if chunk >= 0 else at, at if chunk >= 0 else 0, views, channels, schemas, pos):
                    yield row
            elif op in (r.SCHEMA, r.CHANNEL) and o.drop_undefined:
                define(op, body)
                views = {}


_MESSAGE_HEAD = struct.Struct("<HIQQ")


def _defined(some: dict, id: int, op: int) -> dict | None:  # noqa: A002
    """A definition by id; the bytes of a summary are decoded when they are asked for."""
    v = some.get(id)
    if v is not None and not isinstance(v, dict):
        v = some[id] = r.decode(op, v)
    return v


def _quiet(problem: str) -> None:
    pass


def relation(path: str, o: Options) -> Iterator[dict]:
    """Rows of a relation other than messages."""
    name = o.relation
    if name in FROM_SUMMARY:
        f, size = files.open_random(path)
        with f:
            try:
                s = r.read_summary(f, size, o.crc and not o.lenient)
            except LogError:
                if not o.lenient:
                    raise
                s = None
        if s is not None or name == "header":
            s = s or r.Summary(header=next((r.decode(op, b) for op, _, _, b in r.scan(files.read_all(path), False, None, _quiet if o.lenient else None) if op == r.HEADER), {}))
            got = {"summary_channels": s.channels.values(), "summary_schemas": s.schemas.values(), "chunk_index": s.chunks, "attachment_index": s.attachments, "statistics": [s.statistics] if s.statistics else [], "header": [s.header] if s.header else [], "footer": [s.footer] if s.footer else [], "summary_offsets": s.offsets}[name]
            for i, v in enumerate(got):
                yield {"file": path, "file_pos": i} | v
            return
        if name != "footer":
            return
    if name == "recovery":
        yield from recovery(path, o)
        return
    if name in ("attachments", "metadata", "message_index") and not o.lenient and (got := _by_offset(path, name, o)) is not None:
        yield from got
        return
    problems: list[str] = []
    data = files.read_all(path)
    in_data = True
    chunk = -1
    for pos, (op, c, at, body) in enumerate(o.scan(data, problems.append if o.lenient or name == "problems" else None)):
        if op == r.DATA_END:
            in_data = False
        base = {"file": path, "file_pos": pos}
        if o.lenient and op in r.FIELDS and name not in ("records", "raw_records"):
            try:
                r.decode(op, body)
            except (LogError, UnicodeDecodeError) as e:
                problems.append(f"{r.NAMES[op]} at {at}: {e}")
                continue
        if name == "records":
            yield {"file": path, "opcode": op, "kind": r.NAMES.get(op, "private" if op >= 0x80 else "unknown"), "in_chunk": c >= 0, "chunk_offset": c, "offset": at, "length": len(body)}
        elif name == "raw_records" and op not in r.FIELDS:
            yield {"file": path, "opcode": op, "offset": at, "data": bytes(body)}
        elif name in ("channels", "schemas") and in_data and op == (r.CHANNEL if name == "channels" else r.SCHEMA):
            yield base | r.decode(op, body)
        elif name == "chunks" and op == r.CHUNK:
            v = r.decode(op, body)
            yield base | v | {"chunk_offset": at, "chunk_length": len(body) + 9, "compressed_size": len(v["records"]), "message_index_offsets": None, "message_index_length": None}
        elif name == "message_index":
            chunk = at if op == r.CHUNK else chunk
            if op == r.MESSAGE_INDEX:
                v = r.decode(op, body)
                yield {"file": path, "chunk_offset": chunk, "index_offset": at, "channel_id": v["channel_id"], "entries": [{"log_time": t, "msg_offset": m} for t, m in v["entries"]]}
        elif name == "attachments" and op == r.ATTACHMENT:
            yield base | _attachment(path, body, at, o)
        elif name == "metadata" and op == r.METADATA:
            yield base | r.decode(op, body) | {"offset": at, "length": len(body) + 9}
        elif name == "footer" and op == r.FOOTER:
            yield base | r.decode(op, body)
    if name == "problems":
        for x in problems:
            yield {"file": path, "problem": x}


def _attachment(path: str, body: memoryview, at: int, o: Options) -> dict:
    v = r.decode(r.ATTACHMENT, body)
    if o.crc and not o.lenient and v["crc"] and zlib.crc32(memoryview(body)[:-4]) != v["crc"]:
        raise LogError(f"{path}: checksum of attachment {v['name']} differs")
    return v | {"offset": at, "length": len(body) + 9, "data_size": len(v["data"]), "data": v["data"] if o.payload else None}


def _by_offset(path: str, name: str, o: Options) -> Iterator[dict] | None:
    """Rows read at the offsets that the index gives; None where it doesn't have them all."""
    f, size = files.open_random(path)
    with f:
        try:
            s = r.read_summary(f, size)
        except LogError:
            s = None
    if s is None or s.statistics is None or name == "message_index" and (not s.proves_complete or any(not c["message_index_offsets"] for c in s.chunks)):
        return None
    if name != "message_index" and len(index := s.attachments if name == "attachments" else s.metadata) != s.statistics[name.rstrip("s") + "_count" if name == "attachments" else "metadata_count"]:
        return None

    def rows() -> Iterator[dict]:
        f, _ = files.open_random(path)
        with f:
            if name == "message_index":
                for c in s.chunks:
                    f.seek(c["chunk_offset"] + c["chunk_length"])
                    begin = c["chunk_offset"] + c["chunk_length"]
                    for op, at, body in r.split(f.read(c["message_index_length"])):
                        if op == r.MESSAGE_INDEX:
                            v = r.decode(op, body)
                            yield {"file": path, "chunk_offset": c["chunk_offset"], "index_offset": begin + at, "channel_id": v["channel_id"], "entries": [{"log_time": t, "msg_offset": m} for t, m in v["entries"]]}
                return
            for pos, v in enumerate(index):
                base = {"file": path, "file_pos": pos}
                if name == "attachments" and not o.payload:
                    yield base | v | {"data": None}
                    continue
                f.seek(v["offset"])
                raw = f.read(v["length"])
                op, n = r._HEAD.unpack_from(raw)
                if op != (r.ATTACHMENT if name == "attachments" else r.METADATA) or n + 9 != v["length"]:
                    raise LogError(f"{path}: the index names a record at {v['offset']} that isn't there")
                body = memoryview(raw)[9:]
                yield base | (_attachment(path, body, v["offset"], o) if name == "attachments" else r.decode(op, body) | {"offset": v["offset"], "length": v["length"]})

    return rows()


#: Kinds that a recovery tells apart.
_SAVED = {r.HEADER: "header", r.SCHEMA: "schema", r.CHANNEL: "channel", r.CHUNK: "chunk", r.MESSAGE: "message", r.ATTACHMENT: "attachment", r.METADATA: "metadata"}


def recovery(path: str, o: Options) -> Iterator[dict]:
    """By kind of record: how many can be saved and how many are lost; whether the file ends before its end."""
    data = files.read_all(path)
    good: dict[str, int] = dict.fromkeys([*_SAVED.values(), "other"], 0)
    bad = dict(good)
    channels: set[int] = set()
    loose: dict[int, int] = {}
    ended, broken = False, []
    for op, _, _, body in r.scan(data, True, o.limit, broken.append, o.max_open):
        kind = _SAVED.get(op, "other")
        try:
            v = r.decode(op, body) if op in r.FIELDS and op != r.MESSAGE else None
            if op == r.CHUNK:
                r.open_chunk(v, False, o.max_open)
            if op == r.MESSAGE:
                if len(body) < 22:
                    raise LogError("message cut short")
                cid = int.from_bytes(body[:2], "little")
                loose[cid] = loose.get(cid, 0) + 1
                continue
            if op == r.CHANNEL:
                channels.add(v["id"])
        except Exception:  # whatever a broken record raises, it is lost
            bad[kind] += 1
            continue
        ended = ended or op in (r.DATA_END, r.FOOTER)
        good[kind] += 1
    for cid, n in loose.items():
        (good if cid in channels else bad)["message"] += n
    for kind in good:
        yield {"file": path, "kind": kind, "recovered": good[kind], "discarded": bad[kind], "truncated": not ended or any("cut short" in p or "opcode 0" in p or "magic" in p for p in broken)}


# ---- writing


@dataclass
class Wrote(WriterCommitMessage):
    path: list[str]
    own: list[str]
    messages: int


class LogWriter(DataSourceArrowWriter):
    """One file a task, written under a name of its own; the driver gives it its name when all are whole."""

    def __init__(self, raw: dict, overwrite: bool):
        self.raw, self.overwrite = {k.lower(): v for k, v in raw.items()}, overwrite
        self.root = self.raw["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        from pyspark import TaskContext

        get = self.raw.get
        flag = lambda k, d=True: str(get(k.lower(), d)).lower() == "true"
        for module in filter(None, get("codecs", "").split(",")):
            importlib.import_module(module)
        options = r.WriteOptions(
            profile=get("profile", ""), library=get("library", "tempolog"), chunk_size=int(get("chunksize", 1 << 20)), compression=get("compression", "zstd").replace("none", ""), compression_level=int(get("compressionlevel", 0)) or None, use_chunking=flag("useChunking"), statistics=flag("statistics"),
            message_index=flag("messageIndex"), chunk_index=flag("chunkIndex"), summary_offsets=flag("summaryOffsets"), repeat_schemas=flag("repeatSchemas"), repeat_channels=flag("repeatChannels"), crcs=flag("crcs"), data_crc=flag("dataCrc"), force_compression=flag("forceCompression", False),
        )
        most, most_bytes = int(get("maxfilemessages", 0)), int(get("maxfilebytes", 0))
        self._limited = bool(most or most_bytes)
        fs, root = files.resolve(self.root)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, str]] = []
        put = {"messages": self._put_messages, "attachments": _put_attachments, "metadata": _put_metadata}[get("relation", "messages")]
        out = w = None

        def writer(full: bool = False) -> r.Writer:
            """The file to go on with: a further one where this one is full."""
            nonlocal out, w
            if w is not None and (full or most and w.messages >= most or most_bytes and w.at + w.chunk_bytes >= most_bytes):
                w.finish()
                out.close()
                w = None
            if w is None:
                name = f"part-{TaskContext.get().partitionId():05d}-{len(done):04d}-{uuid.uuid4().hex[:12]}{SUFFIX}"
                done.append((f"{root}/{name}", f"{root}/_{name}"))
                out = fs.open_output_stream(done[-1][1])
                w = r.Writer(out, options)
                w.ids, w.copies = {}, {}
            return w

        try:
            total = put(batches, writer)
            if w is None and get("relation", "messages") == "messages":  # a task without a row leaves an empty log
                writer()
            if w is not None:
                w.finish()
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            raise
        return Wrote([p for p, _ in done], [o for _, o in done], total)

    def _put_messages(self, batches: Iterator[pa.RecordBatch], writer: Callable[..., r.Writer]) -> int:
        """Ids of schemas and channels are each file's own; where a file has no id left, the task goes on in a further one."""
        topic_break = str(self.raw.get("chunkperchannel", "false")).lower() == "true"
        last, total = None, 0
        for b in batches:
            n = b.num_rows
            col = lambda k: _values(b.column(k)) if k in b.schema.names else [None] * n  # noqa: E731, B023
            names = ("topic", "schema_name", "schema_encoding", "schema_data", "message_encoding", "channel_metadata", "channel_copy", "sequence", "log_time", "publish_time", "data")
            if not (self._limited or topic_break) and n and all(k not in b.schema.names or _same(b.column(k)) for k in names[:7]):
                w = writer()  # all of one channel
                key = tuple(_values(b.column(k).slice(0, 1))[0] if k in b.schema.names else None for k in names[:7])
                key = (*key[:5], key[5] or (), key[6])
                c = w.ids.get(key)
                if c is None:
                    if not w.room_for(1, 1 + (key[6] or 0)):
                        w = writer(full=True)
                    c = w.ids[key] = _channel(w, *key)
                seqs, logs, pubs, payloads = map(col, names[7:])
                w.write_many(c, [x or 0 for x in seqs], logs, [t if x is None else x for x, t in zip(pubs, logs)], [x or b"" for x in payloads])
                total += n
                continue
            for topic, name, encoding, definition, kind, metadata, copy, seq, log, pub, data in zip(*map(col, names)):
                w = writer()
                key = (topic, name, encoding, definition, kind, metadata or (), copy)
                c = w.ids.get(key)
                if c is None:
                    if not w.room_for(1, 1 + (copy or 0)):
                        w = writer(full=True)
                    c = w.ids[key] = _channel(w, *key)
                if topic_break and last not in (None, (w, c)):
                    w.flush()
                if topic_break:
                    last = (w, c)
                w.write(c, seq or 0, log, log if pub is None else pub, data or b"")
            total += n
        return total

    def commit(self, messages) -> None:
        fs, root = files.resolve(self.root)
        old = files.listed(self.root, SUFFIX) if self.overwrite and fs.get_file_info(root).type.name == "Directory" else []
        # Many at a time: a write of small files has very many.
        with ThreadPoolExecutor(16) as pool:
            for _ in pool.map(lambda names: fs.move(*names), ((own, path) for m in filter(None, messages) for own, path in zip(m.own, m.path))):
                pass
        for f in old:
            fs.delete_file(files.resolve(f)[1])

    def abort(self, messages) -> None:
        fs, _ = files.resolve(self.root)
        for m in filter(None, messages):
            for own in m.own:
                fs.delete_file(own)


def _same(column: pa.Array) -> bool:
    """Whether all values are one; of maps only whether all are null."""
    if column.null_count:
        return column.null_count == len(column)
    return not pa.types.is_nested(column.type) and len(column.unique()) == 1


def _values(column: pa.Array) -> list:
    """As ``to_pylist``, and maps as tuples of pairs."""
    if pa.types.is_map(column.type):
        pairs, at = list(zip(_values(column.keys), _values(column.items))), column.offsets.to_pylist()
        first = at[0] if len(at) else 0
        return [tuple(pairs[a - first : z - first]) for a, z in zip(at, at[1:])]
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _channel(w: r.Writer, topic: str, name: str | None, encoding: str | None, definition: bytes | None, kind: str | None, metadata: tuple, copy: int | None) -> int:
    """The id of a channel in a file.

    Channels of the same content stay apart by ``copy``, their number among these, from 0: a file that has one has those before it
    too, so that in all files of a log the order of their ids tells which is which.
    """
    schema = w.add_schema(name, encoding or "", definition or b"") if name is not None else 0
    if copy is None:
        return w.add_channel(schema, topic, kind or "", dict(metadata))
    ids = w.copies.setdefault((schema, topic, kind, tuple(sorted(metadata))), [])
    while len(ids) <= copy:
        ids.append(w.new_channel(schema, topic, kind or "", dict(metadata)))
        if len(ids) <= copy:
            w.declare(ids[-1])
    return ids[copy]


def _put_attachments(batches: Iterator[pa.RecordBatch], writer: Callable[..., r.Writer]) -> int:
    total = 0
    for b in batches:
        for v in b.to_pylist():
            writer().attach(v["name"], v.get("media_type") or "", v.get("log_time") or 0, v.get("create_time") or 0, v.get("data") or b"")
        total += b.num_rows
    return total


def _put_metadata(batches: Iterator[pa.RecordBatch], writer: Callable[..., r.Writer]) -> int:
    total = 0
    for b in batches:
        for v in b.to_pylist():
            writer().add_metadata(v["name"], dict(v.get("metadata") or {}))
        total += b.num_rows
    return total


# ---- streaming


class LogStream(DataSourceStreamReader):
    """New whole records of files that grow; the offset is, by file, the end of its last whole record.

    Neither planning nor reading begins anew: the driver goes on from the end that it knows, and a task reads its range
    alone.  Definitions from before the range are kept in the worker; one that hasn't seen them reads them once.
    """

    _known: dict[str, tuple[int, dict, dict]] = {}

    def __init__(self, options: Options, schema: StructType):
        self.o, self.schema = options, schema
        self._ends: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = {}
        for path in files.listed(self.o.path, SUFFIX):
            f, size = files.open_random(path)
            with f:
                at = self._ends.get(path, len(r.MAGIC))
                while at + 9 <= size:
                    f.seek(at)
                    op, n = r._HEAD.unpack(f.read(9))
                    if op in (r.DATA_END, 0) or at + 9 + n > size:
                        break
                    at += 9 + n
            out[path] = self._ends[path] = at
        return out

    def partitions(self, start: dict, end: dict):
        self._ends = dict(start) | self._ends
        return [InputPartition(json.dumps([path, start.get(path, len(r.MAGIC)), stop])) for path, stop in sorted(end.items()) if stop > start.get(path, len(r.MAGIC))] or [InputPartition(json.dumps(["", 0, 0]))]

    def _definitions(self, f, path: str, start: int) -> tuple[dict, dict]:
        at, schemas, channels = self._known.get(path, (len(r.MAGIC), {}, {}))
        if at > start:  # an earlier range again
            at, schemas, channels = len(r.MAGIC), {}, {}
        schemas, channels = dict(schemas), dict(channels)
        if at < start:
            f.seek(at)
            for op, _, _, body in self.o.scan(r.MAGIC + f.read(start - at)):
                if op in (r.SCHEMA, r.CHANNEL):
                    v = r.decode(op, body)
                    (schemas if op == r.SCHEMA else channels)[v["id"]] = v
        return schemas, channels

    def read(self, partition: InputPartition):
        path, start, stop = json.loads(partition.value)
        if not path:
            return
        self.o.load_codecs()
        f, _ = files.open_random(path)
        with f:
            schemas, channels = self._definitions(f, path, start)
            f.seek(start)
            data = r.MAGIC + f.read(stop - start)
        shift = start - len(r.MAGIC)
        reader = LogReader(self.o, self.schema)
        views: dict = {}
        for op, chunk, at, body in self.o.scan(data):
            if op in (r.SCHEMA, r.CHANNEL):
                v = r.decode(op, body)
                (schemas if op == r.SCHEMA else channels)[v["id"]] = v
                views = {}
            elif op == r.MESSAGE:
                row = reader._message(path, body, shift + (chunk if chunk >= 0 else at), at if chunk >= 0 else 0, views, channels, schemas, 0)
                if row:
                    cid, seq, log, pub, payload, view, chunk_at, msg_at, pos = row
                    all_ = dict(zip(("topic", "schema_id", "schema_name", "schema_encoding", "message_encoding"), view)) | {"file": path, "channel_id": cid, "sequence": seq, "log_time": log, "publish_time": pub, "data": payload, "chunk_offset": chunk_at, "msg_offset": msg_at, "file_pos": pos}
                    yield tuple(all_.get(n) for n in self.schema.names)
        self._known[path] = (stop, schemas, channels)

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tlog"

    def schema(self) -> str:
        return RELATIONS[Options(self.options).relation]

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(Options(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(dict(self.options), overwrite)

    def streamReader(self, schema: StructType) -> LogStream:  # noqa: N802
        return LogStream(Options(self.options), schema)


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats of this package known to a session, and turns filter pushdown on."""
    from .rosbag import BagSource
    from .sqlite import Db3Source
    from .ulog import ULogSource

    for source in (LogSource, BagSource, Db3Source, ULogSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def relations(spark: SparkSession, path: str, **options: str) -> dict:
    """All relations of some files, by name."""
    register(spark)
    return {name: spark.read.format("tlog").options(relation=name, path=path, **options).load() for name in RELATIONS}
