"""``spark.read.format("ulog")``: flight-controller recordings as JSON messages.

A recording defines formats (named lists of typed fields, which may nest), then
subscriptions of message ids to formats, then data.  Each subscription is a
channel (``name``, or ``name/instance`` from the second instance on) with a JSON
schema made from its format; times are the payload's first ``timestamp`` in
microseconds.  Logged strings come as topic ``log_message``.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from ..model import LogError
from . import files
from .rosbag import SCHEMA, _Reader

MAGIC = bytes((0x55, 0x4C, 0x6F, 0x67, 0x01, 0x12, 0x35))
#: Fixed values of the format: codes of the basic types.
BASIC = {"int8_t": "b", "uint8_t": "B", "int16_t": "h", "uint16_t": "H", "int32_t": "i", "uint32_t": "I", "int64_t": "q", "uint64_t": "Q", "float": "f", "double": "d", "bool": "?", "char": "c"}
_FIELD = re.compile(r"(\w+)(?:\[(\d+)\])? (\w+)")
_LOG_SCHEMA = {"type": "object", "properties": {"timestamp": {"type": "integer"}, "level": {"type": "integer"}, "message": {"type": "string"}}}


class Formats:
    def __init__(self):
        self.fields: dict[str, list[tuple[str, int | None, str]]] = {}

    def add(self, text: str) -> None:
        name, _, rest = text.partition(":")
        self.fields[name] = [(m[1], int(m[2]) if m[2] else None, m[3]) for f in rest.split(";") if (m := _FIELD.fullmatch(f.strip()))]

    def schema(self, kind: str) -> dict:
        if kind in BASIC:
            return {"type": {"f": "number", "d": "number", "?": "boolean", "c": "string"}.get(BASIC[kind], "integer")}
        if kind not in self.fields:
            raise LogError(f"unknown type {kind}")
        one = lambda t, n: {"type": "string"} if t == "char" else self.schema(t) if n is None else {"type": "array", "items": self.schema(t)}
        return {"type": "object", "properties": {name: one(t, n) for t, n, name in self.fields[kind] if not name.startswith("_padding")}}

    def read(self, kind: str, data: bytes, at: int) -> tuple[object, int]:
        if kind in BASIC:
            size = struct.calcsize(BASIC[kind])
            if at + size > len(data):
                raise LogError(f"{kind} cut short")
            v = struct.unpack_from("<" + BASIC[kind], data, at)[0]
            return v.decode("latin-1") if isinstance(v, bytes) else v, at + size
        out = {}
        for t, n, name in self.fields[kind]:
            if name.startswith("_padding") and at >= len(data):
                continue  # padding at the end may be left out
            if t == "char" and n is not None:
                value, at = data[at : at + n].split(b"\0")[0].decode("utf-8", "replace"), at + n
            elif n is None:
                value, at = self.read(t, data, at)
            else:
                value = []
                for _ in range(n):
                    v, at = self.read(t, data, at)
                    value.append(v)
            if not name.startswith("_padding"):
                out[name] = value
        return out, at


def _plain(v):
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def read_ulog(data: bytes, path: str = "") -> Iterator[dict]:
    if not data.startswith(MAGIC):
        raise LogError("not such a recording")
    formats, topics, count = Formats(), {}, {}
    at = 16  # magic, version, start time

    def row(channel: int, topic: str, name: str, schema: dict, t: int, value: dict) -> dict:
        count[channel] = count.get(channel, -1) + 1
        return {
            "file": path, "channel_id": channel, "topic": topic, "schema_name": name, "schema_encoding": "jsonschema", "schema_data": json.dumps(schema, sort_keys=True).encode(), "message_encoding": "json",
            "channel_metadata": {}, "sequence": count[channel], "log_time": t * 1000, "publish_time": t * 1000, "data": json.dumps(_plain(value)).encode(),
        }

    schemas: dict[str, dict] = {}
    while at + 3 <= len(data):
        size, kind = struct.unpack_from("<Hc", data, at)
        body = data[at + 3 : at + 3 + size]
        at += 3 + size
        if len(body) < size:
            return  # a recording that breaks off ends with its last whole message
        if kind == b"F":
            formats.add(body.decode("utf-8", "replace"))
        elif kind == b"A":
            instance, i = struct.unpack_from("<BH", body)
            name = body[3:].decode()
            topics[i] = (name if not instance else f"{name}/{instance}", name)
        elif kind == b"D":
            i = struct.unpack_from("<H", body)[0]
            if i not in topics:
                raise LogError(f"data of unknown subscription {i}")
            topic, name = topics[i]
            value, _ = formats.read(name, body, 2)
            schema = schemas.get(name) or schemas.setdefault(name, formats.schema(name))
            yield row(i + 1, topic, name, schema, value.get("timestamp", 0), value)
        elif kind == b"L":
            level, t = struct.unpack_from("<BQ", body)
            yield row(65_000, "log_message", "log_message", _LOG_SCHEMA, t, {"timestamp": t, "level": level, "message": body[9:].decode("utf-8", "replace")})


def _read_file(path: str) -> Iterator[dict]:
    return read_ulog(files.read_all(path), path)


class ULogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ulog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema, ".ulg", _read_file)
