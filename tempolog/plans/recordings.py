"""Recordings of other formats made of messages, so that their sources can be queried: one file a task."""

from __future__ import annotations

import bz2
import sqlite3
import struct
import uuid
from collections.abc import Callable, Iterator
from contextlib import closing

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..sources import files
from ..sources.rosbag import MAGIC, OP_CHUNK, OP_CONNECTION, OP_MESSAGE

_Rows = list[tuple[str, int, bytes]]
KIND, DEFINITION = "std_msgs/String", "string data\n"


def _sized(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def _fields(**named: bytes) -> bytes:
    return _sized(*[k.encode() + b"=" + v for k, v in named.items()])


#: Bytes of a bag's chunk before it is compressed.
CHUNK_BYTES = 768 << 10
#: Messages of a file: a task holds the rows of one.
FILE_MESSAGES = 250_000


def bag(rows: _Rows) -> bytes:
    """All messages in compressed chunks, each topic's connection before its first message."""
    known: dict[str, bytes] = {}
    parts: list[bytes] = []
    out, size = [MAGIC], 0

    def close() -> None:
        raw = b"".join(parts)
        out.append(_sized(_fields(op=bytes([OP_CHUNK]), compression=b"bz2", size=struct.pack("<I", len(raw))), bz2.compress(raw)))
        parts.clear()

    for topic, at, data in rows:
        if topic not in known:
            known[topic] = struct.pack("<I", len(known))
            head = _fields(op=bytes([OP_CONNECTION]), conn=known[topic], topic=topic.encode())
            parts.append(_sized(head, _fields(type=KIND.encode(), message_definition=DEFINITION.encode())))
        parts.append(_sized(_fields(op=bytes([OP_MESSAGE]), conn=known[topic], time=struct.pack("<II", *divmod(at, 1_000_000_000))), data))
        size += len(parts[-1])
        if size >= CHUNK_BYTES:
            close()
            size = 0
    if parts:
        close()
    return b"".join(out)


def db3(rows: _Rows) -> bytes:
    with closing(sqlite3.connect(":memory:")) as db:
        db.executescript(
            "create table topics(id integer, name text, type text, serialization_format text);"
            "create table messages(id integer, topic_id integer, timestamp integer, data blob);"
            "create table message_definitions(id integer, topic_type text, encoding text, encoded_message_definition text);"
        )
        ids = {t: i for i, t in enumerate(dict.fromkeys(t for t, _, _ in rows), 1)}
        db.executemany("insert into topics values (?, ?, ?, 'cdr')", [(i, t, KIND) for t, i in ids.items()])
        db.execute("insert into message_definitions values (1, ?, 'ros2msg', ?)", (KIND, DEFINITION))
        db.executemany("insert into messages values (?, ?, ?, ?)", [(n, ids[t], at, data) for n, (t, at, data) in enumerate(rows)])
        db.commit()
        return db.serialize()


def deal(messages: DataFrame, key: str, count: int, least: int = 3) -> DataFrame:
    """Rows for as many files as ``count`` of them need."""
    return messages.repartition(max(least, -(-count // FILE_MESSAGES)), key)


def write(messages: DataFrame, path: str, suffix: str, make: Callable[[_Rows], bytes]) -> str:
    """``topic, log_time, data`` as files of the format, named by task, so that a task that is run again replaces its own; their names, comma-separated."""
    fs, root = files.resolve(path)
    fs.create_dir(root, recursive=True)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("topic", "log_time", "data")))]
        if rows:
            fs, root = files.resolve(path)
            part = f"{root}/{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(part) as out:
                out.write(make(rows))
            fs.move(part, f"{root}/part-{TaskContext.get().partitionId():06d}{suffix}")
        yield from ()

    messages.select("topic", "log_time", "data").mapInArrow(each, "none int").write.format("noop").mode("overwrite").save()
    return ",".join(files.listed(path, suffix))
