"""The container format: records in bytes, a writer and readers of one file.

Layout: magic, header, data section (schemas, channels, messages or chunks of
them, attachments, metadata), data end, summary, summary offsets, footer,
magic.  A record is an opcode, a length and a content; readers ignore what
follows the fields they know.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..model import MAX_IDS, LogError

# ---- fixed values of the format
MAGIC = bytes((0x89, 0x4D, 0x43, 0x41, 0x50, 0x30, 0x0D, 0x0A))
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX = range(0x01, 0x09)
ATTACHMENT, ATTACHMENT_INDEX, STATISTICS, METADATA, METADATA_INDEX, SUMMARY_OFFSET, DATA_END = range(0x09, 0x10)
NAMES = {
    HEADER: "header", FOOTER: "footer", SCHEMA: "schema", CHANNEL: "channel", MESSAGE: "message", CHUNK: "chunk", MESSAGE_INDEX: "message_index", CHUNK_INDEX: "chunk_index",
    ATTACHMENT: "attachment", ATTACHMENT_INDEX: "attachment_index", STATISTICS: "statistics", METADATA: "metadata", METADATA_INDEX: "metadata_index", SUMMARY_OFFSET: "summary_offset", DATA_END: "data_end",
}

#: Fields of each record in order: name and type.  Types: b h i q unsigned of 1 2 4 8 bytes, s string, B bytes after
#: a 4-byte length, L after an 8-byte one, R the rest, m map of strings, c map of channel to offset or count, x index entries.
FIELDS: dict[int, tuple[tuple[str, str], ...]] = {
    HEADER: (("profile", "s"), ("library", "s")),
    FOOTER: (("summary_start", "q"), ("summary_offset_start", "q"), ("summary_crc", "i")),
    SCHEMA: (("id", "h"), ("name", "s"), ("encoding", "s"), ("data", "B")),
    CHANNEL: (("id", "h"), ("schema_id", "h"), ("topic", "s"), ("message_encoding", "s"), ("metadata", "m")),
    MESSAGE: (("channel_id", "h"), ("sequence", "i"), ("log_time", "q"), ("publish_time", "q"), ("data", "R")),
    CHUNK: (("start_time", "q"), ("end_time", "q"), ("uncompressed_size", "q"), ("crc", "i"), ("compression", "s"), ("records", "L")),
    MESSAGE_INDEX: (("channel_id", "h"), ("entries", "x")),
    CHUNK_INDEX: (("start_time", "q"), ("end_time", "q"), ("chunk_offset", "q"), ("chunk_length", "q"), ("message_index_offsets", "c"), ("message_index_length", "q"), ("compression", "s"), ("compressed_size", "q"), ("uncompressed_size", "q")),
    ATTACHMENT: (("log_time", "q"), ("create_time", "q"), ("name", "s"), ("media_type", "s"), ("data", "L"), ("crc", "i")),
    ATTACHMENT_INDEX: (("offset", "q"), ("length", "q"), ("log_time", "q"), ("create_time", "q"), ("data_size", "q"), ("name", "s"), ("media_type", "s")),
    STATISTICS: (("message_count", "q"), ("schema_count", "h"), ("channel_count", "i"), ("attachment_count", "i"), ("metadata_count", "i"), ("chunk_count", "i"), ("message_start_time", "q"), ("message_end_time", "q"), ("channel_message_counts", "c")),
    METADATA: (("name", "s"), ("metadata", "m")),
    METADATA_INDEX: (("offset", "q"), ("length", "q"), ("name", "s")),
    SUMMARY_OFFSET: (("group_opcode", "b"), ("group_start", "q"), ("group_length", "q")),
    DATA_END: (("data_section_crc", "i"),),
}
_INT = {"b": (struct.Struct("<B"), 1), "h": (struct.Struct("<H"), 2), "i": (struct.Struct("<I"), 4), "q": (struct.Struct("<Q"), 8)}
_HEAD = struct.Struct("<BQ")
#: All of a message record before its payload, and a message index of one entry.
_MESSAGE_RECORD = struct.Struct("<BQHIQQ")
_INDEX_RECORD = struct.Struct("<BQHIQQ")


# ---- codecs

CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes, int], bytes]]] = {"": (lambda b: b, lambda b, n: bytes(b))}


def register_codec(name: str, compress: Callable[[bytes], bytes], decompress: Callable[[bytes, int], bytes]) -> None:
    CODECS[name] = (compress, decompress)


def _zstd_in(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(b)


def _zstd_out(b: bytes, n: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(bytes(b), max_output_size=n)


def _lz4(b: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("lz4").compress(b, asbytes=True)


def _lz4_out(b: bytes, n: int) -> bytes:
    import pyarrow as pa

    return pa.Codec("lz4").decompress(bytes(b), n, asbytes=True) if n else b""


register_codec("zstd", _zstd_in, _zstd_out)
register_codec("lz4", _lz4, _lz4_out)


def decompress(name: str, data: bytes, size: int) -> bytes:
    if name not in CODECS:
        raise LogError(f"unknown compression {name!r}")
    return CODECS[name][1](data, size)


def compress(name: str, data: bytes, level: int | None = None) -> bytes:
    if name not in CODECS:
        raise LogError(f"unknown compression {name!r}")
    if level is not None and name == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    return CODECS[name][0](data)


# ---- encoding


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<I", len(raw)) + raw


def _channel_content(v: dict) -> bytes:
    """As :func:`content`: channels may be as many as messages."""
    metadata = b"".join([_text(k) + _text(x) for k, x in sorted(v["metadata"].items())])
    return struct.pack("<HH", v["id"], v["schema_id"]) + _text(v["topic"]) + _text(v["message_encoding"]) + struct.pack("<I", len(metadata)) + metadata


def content(op: int, values: dict) -> bytes:
    if op == CHANNEL:
        return _channel_content(values)
    out = []
    for name, kind in FIELDS[op]:
        v = values[name]
        if kind in _INT:
            out.append(_INT[kind][0].pack(v))
        elif kind == "s":
            out.append(_text(v))
        elif kind in "BL":
            out.append(struct.pack("<I" if kind == "B" else "<Q", len(v)) + bytes(v))
        elif kind == "R":
            out.append(bytes(v))
        else:
            if kind == "m":
                body = b"".join(_text(k) + _text(x) for k, x in sorted(v.items()))
            elif kind == "c":
                body = b"".join(struct.pack("<HQ", k, x) for k, x in sorted(v.items()))
            else:
                body = b"".join(struct.pack("<QQ", *e) for e in v)
            out.append(struct.pack("<I", len(body)) + body)
    return b"".join(out)


def frame(op: int, body: bytes) -> bytes:
    return _HEAD.pack(op, len(body)) + body


def encode(op: int, **values) -> bytes:
    return frame(op, content(op, values))


# ---- decoding


_CHANNEL_HEAD, _LENGTH = struct.Struct("<HHI"), struct.Struct("<I")


def _decode_channel(body: bytes | memoryview) -> dict:
    """As :func:`decode`: channels may be as many as messages."""
    raw = bytes(body)
    try:
        id_, schema_id, n = _CHANNEL_HEAD.unpack_from(raw)
        at = 8 + n
        topic = raw[8:at]
        n = _LENGTH.unpack_from(raw, at)[0] + at + 4
        encoding, at = raw[at + 4 : n], n
        end = _LENGTH.unpack_from(raw, at)[0] + at + 4
        at += 4
        metadata, texts = {}, []
        while at < end or len(texts) == 1:
            n = _LENGTH.unpack_from(raw, at)[0] + at + 4
            texts.append(raw[at + 4 : n])
            at = n
            if len(texts) == 2:
                metadata[texts[0].decode()] = texts[1].decode()
                texts = []
        if max(at, end) > len(raw):
            raise LogError("channel record cut short")
    except struct.error:
        raise LogError("channel record cut short") from None
    return {"id": id_, "schema_id": schema_id, "topic": topic.decode(), "message_encoding": encoding.decode(), "metadata": metadata}


def decode(op: int, body: bytes | memoryview) -> dict:
    """Fields of a record; bytes that follow the known fields are ignored."""
    if op == CHANNEL:
        return _decode_channel(body)
    body = memoryview(body)
    out, at = {}, 0

    def take(n: int) -> memoryview:
        nonlocal at
        if at + n > len(body):
            raise LogError(f"{NAMES.get(op, op)} record cut short")
        at += n
        return body[at - n : at]

    def text() -> str:
        return bytes(take(struct.unpack("<I", take(4))[0])).decode()

    for name, kind in FIELDS[op]:
        if kind in _INT:
            out[name] = _INT[kind][0].unpack(take(_INT[kind][1]))[0]
        elif kind == "s":
            out[name] = text()
        elif kind == "B":
            out[name] = bytes(take(struct.unpack("<I", take(4))[0]))
        elif kind == "L":
            out[name] = bytes(take(struct.unpack("<Q", take(8))[0]))
        elif kind == "R":
            out[name] = bytes(take(len(body) - at))
        else:
            end = struct.unpack("<I", take(4))[0] + at
            if end > len(body):
                raise LogError(f"{NAMES.get(op, op)} record cut short")
            if kind == "m":
                m = {}
                while at < end:
                    k = text()
                    m[k] = text()
                out[name] = m
            elif kind == "c":
                out[name] = dict(struct.iter_unpack("<HQ", take(end - at)))
            else:
                out[name] = list(struct.iter_unpack("<QQ", take(end - at)))
    return out


def split(data: bytes | memoryview, at: int = 0, limit: int | None = None, stop: Callable[[str], None] | None = None) -> Iterator[tuple[int, int, memoryview]]:
    """``(opcode, offset, content)``; broken framing raises, or calls ``stop`` and ends."""
    data = memoryview(data)
    while at < len(data):
        if at + 9 > len(data):
            problem = f"record header cut short at {at}"
        else:
            op, n = _HEAD.unpack_from(data, at)
            problem = "opcode 0" if op == 0 else f"record of {n} bytes at {at} is over the limit" if limit and n > limit else f"record cut short at {at}" if at + 9 + n > len(data) else ""
        if problem:
            if stop is None:
                raise LogError(problem)
            stop(problem)
            return
        yield op, at, data[at + 9 : at + 9 + n]
        at += 9 + n


# ---- writer


@dataclass
class WriteOptions:
    profile: str = ""
    library: str = "tempolog"
    chunk_size: int = 1 << 20
    compression: str = "zstd"
    compression_level: int | None = None
    force_compression: bool = False
    use_chunking: bool = True
    message_index: bool = True
    chunk_index: bool = True
    attachment_index: bool = True
    metadata_index: bool = True
    statistics: bool = True
    summary_offsets: bool = True
    repeat_schemas: bool = True
    repeat_channels: bool = True
    crcs: bool = True
    data_crc: bool = True


@dataclass
class Writer:
    """Writes one file to anything with ``write``."""

    out: object
    options: WriteOptions = field(default_factory=WriteOptions)

    # The largest ids so far.
    _schema_top = _channel_top = 0

    def __post_init__(self):
        self.at = self.crc = 0
        self.schemas: dict[int, dict] = {}
        self.channels: dict[int, dict] = {}
        self._schema_ids: dict[tuple, int] = {}
        self._channel_ids: dict[tuple, int] = {}
        self._written: set[tuple[int, int]] = set()
        self.chunk_indexes: list[bytes] = []
        self.attachment_indexes: list[bytes] = []
        self.metadata_indexes: list[bytes] = []
        self.counts: dict[int, int] = {}
        self.messages = self.attachments = self.metadata = self.chunks = 0
        self.first: int | None = None
        self.last = 0
        self._open_chunk()
        self._raw(MAGIC + encode(HEADER, profile=self.options.profile, library=self.options.library))

    def _open_chunk(self):
        self.chunk: list[bytes] = []
        self.chunk_bytes = 0
        self.index: dict[int, list[tuple[int, int]]] = {}
        self.lo: int | None = None
        self.hi = 0

    def _raw(self, data: bytes) -> int:
        at = self.at
        self.out.write(data)
        self.crc = zlib.crc32(data, self.crc) if self.options.data_crc else 0
        self.at += len(data)
        return at

    def _put(self, data: bytes) -> None:
        if self.options.use_chunking:
            self.chunk.append(data)
            self.chunk_bytes += len(data)
        else:
            self._raw(data)

    def add_schema(self, name: str, encoding: str, data: bytes, id: int | None = None) -> int:  # noqa: A002
        """Equal content gets the id it has; another content under a known id is an error."""
        key = (name, encoding, bytes(data))
        if id is None:
            id = self._schema_ids.get(key) or self._schema_top + 1  # noqa: A001
        if id == 0:
            raise LogError("schema id 0 means no schema")
        if id > MAX_IDS:
            raise LogError(f"a file has {MAX_IDS} schemas at most")
        got = {"id": id, "name": name, "encoding": encoding, "data": bytes(data)}
        if self.schemas.setdefault(id, got) != got:
            raise LogError(f"schema {id} is defined otherwise")
        self._schema_top = max(self._schema_top, id)
        self._schema_ids.setdefault(key, id)
        return id

    def room_for(self, schemas: int, channels: int) -> bool:
        """Whether ids are left for so many more."""
        return self._schema_top + schemas <= MAX_IDS and self._channel_top + channels <= MAX_IDS

    def new_channel(self, schema_id: int, topic: str, message_encoding: str, metadata: dict[str, str] | None = None) -> int:
        """A channel of its own, whatever the content of others."""
        return self.add_channel(schema_id, topic, message_encoding, metadata, self._channel_top + 1)

    def add_channel(self, schema_id: int, topic: str, message_encoding: str, metadata: dict[str, str] | None = None, id: int | None = None) -> int:  # noqa: A002
        if schema_id and schema_id not in self.schemas:
            raise LogError(f"schema {schema_id} is not defined")
        metadata = dict(metadata or {})
        key = (schema_id, topic, message_encoding, tuple(sorted(metadata.items())))
        if id is None:
            id = self._channel_ids.get(key)  # noqa: A001
            if id is None:
                id = self._channel_top + 1  # noqa: A001
        if id > MAX_IDS:
            raise LogError(f"a file has {MAX_IDS} channels at most")
        got = {"id": id, "schema_id": schema_id, "topic": topic, "message_encoding": message_encoding, "metadata": metadata}
        if self.channels.setdefault(id, got) != got:
            raise LogError(f"channel {id} is defined otherwise")
        self._channel_top = max(self._channel_top, id)
        self._channel_ids.setdefault(key, id)
        return id

    def write(self, channel_id: int, sequence: int, log_time: int, publish_time: int, data: bytes) -> None:
        if channel_id not in self.channels:
            raise LogError(f"channel {channel_id} is not defined")
        o = self.options
        if o.use_chunking and self.chunk_bytes > o.chunk_size:
            self.flush()
        if (CHANNEL, channel_id) not in self._written:
            self.declare(channel_id)
        if o.use_chunking:
            self.index.setdefault(channel_id, []).append((log_time, self.chunk_bytes))
            self.lo = log_time if self.lo is None else min(self.lo, log_time)
            self.hi = max(self.hi, log_time)
        self._put(_MESSAGE_RECORD.pack(MESSAGE, 22 + len(data), channel_id, sequence, log_time, publish_time) + bytes(data))
        self.messages += 1
        self.counts[channel_id] = self.counts.get(channel_id, 0) + 1
        self.first = log_time if self.first is None else min(self.first, log_time)
        self.last = max(self.last, log_time)

    def write_many(self, channel_id: int, sequences: list[int], log_times: list[int], publish_times: list[int], payloads: list[bytes]) -> None:
        """As :meth:`write` for each, of one channel."""
        o = self.options
        if not o.use_chunking:
            for row in zip(sequences, log_times, publish_times, payloads):
                self.write(channel_id, *row)
            return
        if channel_id not in self.channels:
            raise LogError(f"channel {channel_id} is not defined")
        i, n, pack = 0, len(log_times), _MESSAGE_RECORD.pack
        while i < n:
            if self.chunk_bytes > o.chunk_size:
                self.flush()
            if (CHANNEL, channel_id) not in self._written:
                self.declare(channel_id)
            begin, size, chunk, entries = i, self.chunk_bytes, self.chunk, self.index.setdefault(channel_id, [])
            while i < n and (size <= o.chunk_size or i == begin):
                data, log = payloads[i], log_times[i]
                record = pack(MESSAGE, 22 + len(data), channel_id, sequences[i], log, publish_times[i]) + data
                entries.append((log, size))
                chunk.append(record)
                size += len(record)
                i += 1
            self.chunk_bytes = size
            lo, hi = min(log_times[begin:i]), max(log_times[begin:i])
            self.lo, self.hi = lo if self.lo is None else min(self.lo, lo), max(self.hi, hi)
            self.first, self.last = lo if self.first is None else min(self.first, lo), max(self.last, hi)
        self.messages += n
        self.counts[channel_id] = self.counts.get(channel_id, 0) + n

    def declare(self, channel_id: int) -> None:
        """Writes a channel's definition, and its schema's, where they aren't yet."""
        c = self.channels[channel_id]
        if c["schema_id"] and (SCHEMA, c["schema_id"]) not in self._written:
            self._written.add((SCHEMA, c["schema_id"]))
            self._put(encode(SCHEMA, **self.schemas[c["schema_id"]]))
        if (CHANNEL, channel_id) not in self._written:
            self._written.add((CHANNEL, channel_id))
            self._put(encode(CHANNEL, **c))

    def private_record(self, op: int, data: bytes) -> None:
        if op < 0x80:
            raise LogError("private records have opcodes from 0x80")
        self._put(frame(op, data))

    def flush(self) -> None:
        """Closes the chunk: readers can read up to here."""
        if not self.chunk:
            return
        o = self.options
        raw = b"".join(self.chunk)
        name = o.compression
        packed = compress(name, raw, o.compression_level)
        if name and len(packed) >= len(raw) and not o.force_compression:
            name, packed = "", raw
        body = encode(CHUNK, start_time=self.lo or 0, end_time=self.hi, uncompressed_size=len(raw), crc=zlib.crc32(raw) if o.crcs else 0, compression=name, records=packed)
        at = self._raw(body)
        offsets = {}
        begin = self.at
        if o.message_index:
            for c, entries in sorted(self.index.items()):
                offsets[c] = self._raw(_INDEX_RECORD.pack(MESSAGE_INDEX, 22, c, 16, *entries[0]) if len(entries) == 1 else encode(MESSAGE_INDEX, channel_id=c, entries=entries))
        self.chunk_indexes.append(encode(CHUNK_INDEX, start_time=self.lo or 0, end_time=self.hi, chunk_offset=at, chunk_length=len(body), message_index_offsets=offsets, message_index_length=self.at - begin, compression=name, compressed_size=len(packed), uncompressed_size=len(raw)))
        self.chunks += 1
        self._open_chunk()

    def attach(self, name: str, media_type: str, log_time: int, create_time: int, data: bytes) -> None:
        self.flush()
        v = {"log_time": log_time, "create_time": create_time, "name": name, "media_type": media_type, "data": data, "crc": 0}
        raw = content(ATTACHMENT, v)
        if self.options.crcs:
            raw = raw[:-4] + struct.pack("<I", zlib.crc32(raw[:-4]))
        at = self._raw(frame(ATTACHMENT, raw))
        self.attachments += 1
        self.attachment_indexes.append(encode(ATTACHMENT_INDEX, offset=at, length=len(raw) + 9, log_time=log_time, create_time=create_time, data_size=len(data), name=name, media_type=media_type))

    def add_metadata(self, name: str, metadata: dict[str, str]) -> None:
        self.flush()
        raw = encode(METADATA, name=name, metadata=metadata)
        at = self._raw(raw)
        self.metadata += 1
        self.metadata_indexes.append(encode(METADATA_INDEX, offset=at, length=len(raw), name=name))

    def finish(self) -> None:
        self.flush()
        o = self.options
        self._raw(encode(DATA_END, data_section_crc=self.crc if o.data_crc else 0))
        start = self.at
        groups: list[tuple[int, list[bytes]]] = []
        if o.repeat_schemas:
            groups.append((SCHEMA, [encode(SCHEMA, **s) for i, s in sorted(self.schemas.items()) if (SCHEMA, i) in self._written]))
        if o.repeat_channels:
            groups.append((CHANNEL, [encode(CHANNEL, **c) for i, c in sorted(self.channels.items()) if (CHANNEL, i) in self._written]))
        if o.statistics:
            n = {k: sum(1 for op, _ in self._written if op == k) for k in (SCHEMA, CHANNEL)} | getattr(self, "counted", {})
            groups.append((STATISTICS, [encode(STATISTICS, message_count=self.messages, schema_count=n[SCHEMA], channel_count=n[CHANNEL], attachment_count=self.attachments, metadata_count=self.metadata, chunk_count=self.chunks, message_start_time=self.first or 0, message_end_time=self.last, channel_message_counts=self.counts)]))
        groups += [(CHUNK_INDEX, self.chunk_indexes if o.chunk_index else []), (ATTACHMENT_INDEX, self.attachment_indexes if o.attachment_index else []), (METADATA_INDEX, self.metadata_indexes if o.metadata_index else [])]
        summary, offsets = b"", b""
        for op, records in groups:
            if records:
                body = b"".join(records)
                offsets += encode(SUMMARY_OFFSET, group_opcode=op, group_start=start + len(summary), group_length=len(body))
                summary += body
        offsets = offsets if o.summary_offsets else b""
        values = {"summary_start": start if summary else 0, "summary_offset_start": start + len(summary) if offsets else 0, "summary_crc": 0}
        head = frame(FOOTER, content(FOOTER, values))[:-4]
        tail = summary + offsets + head
        crc = zlib.crc32(tail) if o.crcs else 0
        self.out.write(tail + struct.pack("<I", crc) + MAGIC)
        self.at += len(tail) + 4 + len(MAGIC)


def amend(source, size: int, sink, attachments: list[dict], metadata: list[tuple[str, dict]], piece: int = 1 << 22) -> bool:
    """Copies a file with further records before the end of its data, and its summary anew; False (nothing written) if it has no summary."""
    s = read_summary(source, size)
    if s is None:
        return False
    # The data section ends with its end record, right before the summary.
    source.seek(s.end - 13)
    head = source.read(13)
    if head[0] != DATA_END:
        return False
    keep_crc = head[9:] != bytes(4)
    w = Writer.__new__(Writer)
    w.out, w.options = sink, WriteOptions(data_crc=keep_crc, crcs=bool(s.footer["summary_crc"]) or keep_crc, summary_offsets=bool(s.footer["summary_offset_start"]), repeat_schemas=bool(s.schemas), repeat_channels=bool(s.channels), statistics=s.statistics is not None)
    w.at = w.crc = 0
    w._open_chunk()
    source.seek(0)
    left = s.end - 13
    while left:
        got = source.read(min(piece, left))
        if not got:
            raise LogError("the file ends before its data does")
        w._raw(got)
        left -= len(got)
    w.schemas, w.channels = s.schemas, s.channels
    w._schema_ids, w._channel_ids = {}, {}
    w._written = {(SCHEMA, i) for i in s.schemas} | {(CHANNEL, i) for i in s.channels}
    w.chunk_indexes, w.attachment_indexes, w.metadata_indexes = ([encode(op, **v) for v in some] for op, some in ((CHUNK_INDEX, s.chunks), (ATTACHMENT_INDEX, s.attachments), (METADATA_INDEX, s.metadata)))
    t = s.statistics or {}
    w.counts, w.messages, w.chunks = t.get("channel_message_counts", {}), t.get("message_count", 0), t.get("chunk_count", 0)
    w.attachments, w.metadata = t.get("attachment_count", 0), t.get("metadata_count", 0)
    w.first, w.last = t.get("message_start_time"), t.get("message_end_time", 0)
    for name, values in metadata:
        w.add_metadata(name, values)
    for v in attachments:
        w.attach(v["name"], v["media_type"], v["log_time"], v["create_time"], v["data"])
    if s.statistics and not (s.schemas and s.channels):  # what the summary doesn't repeat still counts
        w.counted = {SCHEMA: t["schema_count"], CHANNEL: t["channel_count"]}
    w.finish()
    return True


# ---- readers


@dataclass
class Summary:
    header: dict = field(default_factory=dict)
    footer: dict = field(default_factory=dict)
    schemas: dict[int, dict] = field(default_factory=dict)
    channels: dict[int, dict] = field(default_factory=dict)
    chunks: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    metadata: list[dict] = field(default_factory=list)
    statistics: dict | None = None
    offsets: list[dict] = field(default_factory=list)
    end: int = 0

    @property
    def proves_complete(self) -> bool:
        """Whether the index provably covers all messages, and repeats all definitions."""
        s = self.statistics
        return bool(s) and s["channel_count"] == len(self.channels) and s["schema_count"] == len(self.schemas) and s["chunk_count"] == len(self.chunks) and (s["chunk_count"] > 0 or s["message_count"] == 0)


def _read_at(file, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def read_summary(file, size: int, validate: bool = True, definitions: bool = True) -> Summary | None:
    """From the end of a file; None where there is no summary, or a broken one.

    Without ``definitions`` schemas and channels stay undecoded, as bytes by id: to plan a file of 65,535 channels needs none.
    """
    out = Summary()
    if size < 2 * len(MAGIC) or _read_at(file, 0, 8) != MAGIC:
        raise LogError("bad magic at the start")
    head = _read_at(file, 8, 9)
    if len(head) == 9 and head[0] == HEADER:
        out.header = decode(HEADER, _read_at(file, 17, _HEAD.unpack(head)[1]))
    tail = _read_at(file, max(0, size - 37), 37)
    if tail[-8:] != MAGIC or tail[0] != FOOTER:
        return None
    out.footer = decode(FOOTER, tail[9:29])
    start = out.footer["summary_start"]
    if not start:
        return None
    raw = _read_at(file, start, size - 37 - start)
    if validate and out.footer["summary_crc"] and zlib.crc32(raw + tail[:25]) != out.footer["summary_crc"]:
        raise LogError("summary checksum differs")
    for op, at, body in split(raw):
        if op not in FIELDS:
            continue
        if not definitions and op in (SCHEMA, CHANNEL) and len(body) >= 2:
            (out.schemas if op == SCHEMA else out.channels)[int.from_bytes(body[:2], "little")] = body
            continue
        v = decode(op, body)
        if op == SCHEMA:
            out.schemas[v["id"]] = v
        elif op == CHANNEL:
            out.channels[v["id"]] = v
        elif op == CHUNK_INDEX:
            out.chunks.append(v)
        elif op == ATTACHMENT_INDEX:
            out.attachments.append(v)
        elif op == METADATA_INDEX:
            out.metadata.append(v)
        elif op == STATISTICS:
            out.statistics = v
        elif op == SUMMARY_OFFSET:
            out.offsets.append(v)
    out.end = start
    return out


def open_chunk(v: dict, validate: bool = True, most: int | None = None) -> bytes:
    if most is not None and v["uncompressed_size"] > most:
        raise LogError(f"chunk of {v['uncompressed_size']} bytes is over the limit of {most}")
    raw = decompress(v["compression"], v["records"], v["uncompressed_size"])
    if validate and v["crc"] and zlib.crc32(raw) != v["crc"]:
        raise LogError("chunk checksum differs")
    return raw


def scan(data: bytes, validate: bool = True, limit: int | None = None, lenient: Callable[[str], None] | None = None, most: int | None = None) -> Iterator[tuple[int, int, int, memoryview]]:
    """``(opcode, chunk offset or -1, offset, content)`` of every record, chunks opened, in file order.

    ``lenient``: reports problems and goes on: a chunk whose checksum differs gives its rows, one that can't
    be opened is left out, broken framing ends the scan.
    """
    if data[:8] != MAGIC:
        if lenient is None:
            raise LogError("bad magic at the start")
        lenient("bad magic at the start")
        return
    end = len(data) - 8 if data[-8:] == MAGIC else len(data)
    for op, at, body in split(memoryview(data)[:end], 8, limit, lenient):
        yield op, -1, at, body
        if op == CHUNK:
            try:
                v = decode(CHUNK, body)
                raw = open_chunk(v, validate and lenient is None, most)
                if lenient and validate and v["crc"] and zlib.crc32(raw) != v["crc"]:
                    lenient(f"chunk checksum differs at {at}")
            except Exception as e:
                if lenient is None:
                    raise
                lenient(f"chunk at {at}: {e}")
                continue
            for op2, at2, body2 in split(raw, 0, limit, lenient):
                yield op2, at, at2, body2
        if op == FOOTER:
            return
