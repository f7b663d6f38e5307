"""``format("db3")``: SQLite recordings as messages, in order of time and id.

Topics are joined with their message definitions; one without is an error.
Sequences count from 0 in each channel.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from ..model import LogError
from . import files
from .rosbag import SCHEMA, _Reader


def read_db3(path: str) -> Iterator[dict]:
    with closing(sqlite3.connect(":memory:")) as db:  # the library opens local files only: nothing is put on a local disk
        db.deserialize(files.read_all(path))
        columns = {r[1] for r in db.execute("pragma table_info(topics)")}
        if not db.execute("select 1 from sqlite_master where type = 'table' and name = 'message_definitions'").fetchone():
            raise LogError("the recording has no message definitions")
        definitions: dict[str, tuple[str, str]] = {}
        for kind, encoding, text in db.execute("select topic_type, encoding, encoded_message_definition from message_definitions"):
            if definitions.setdefault(kind, (encoding, text)) != (encoding, text):
                raise LogError(f"several definitions of {kind}")
        qos = "offered_qos_profiles" if "offered_qos_profiles" in columns else "''"
        topics = {}
        for i, name, kind, serialization, profile in db.execute(f"select id, name, type, serialization_format, {qos} from topics order by id"):
            if kind not in definitions:
                raise LogError(f"no definition of {kind}")
            topics[i] = {"channel_id": i, "topic": name, "schema_name": kind, "schema_encoding": definitions[kind][0], "schema_data": definitions[kind][1].encode(), "message_encoding": serialization, "channel_metadata": {"offered_qos_profiles": profile} if profile else {}}
        count: dict[int, int] = {}
        for topic, t, data in db.execute("select topic_id, timestamp, data from messages order by timestamp, id"):
            if topic not in topics:
                raise LogError(f"message of unknown topic {topic}")
            n = count[topic] = count.get(topic, -1) + 1
            yield {"file": path, "sequence": n, "log_time": t, "publish_time": t, "data": data} | topics[topic]


class Db3Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "db3"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema, ".db3", read_db3)
