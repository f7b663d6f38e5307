"""The engine: logs by path, and the commands over them.

``Engine(spark)`` reads relations, answers summaries from the index where it
can, and writes logs.  Commands return DataFrames, or :class:`Outcome` where
there is something to warn of.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import decode, text
from .functions import time as times
from .model import LogError
from .operators import integrity, join, listing, merge, order, select, stats, usage
from .sources import datasource, files, records


@dataclass
class Outcome:
    """What a command gives, and its warnings; exit codes 0, 3 with warnings."""

    df: DataFrame | None
    warnings: list[str] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return 3 if self.warnings else 0


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = datasource.register(spark)

    # ---- relations

    def relation(self, path: str, name: str = "messages", columns: list[str] | None = None, **options) -> DataFrame:
        """``columns``: only these are read."""
        read = self.spark.read if columns is None else self.spark.read.schema(", ".join(f"{k} {t}" for k, t in (x.strip().split(" ", 1) for x in datasource.RELATIONS[name].split(", ")) if k in columns))
        return read.format("tlog").options(path=path, relation=name, **{k: str(v) for k, v in options.items()}).load()

    def messages(self, path: str, topics: list[str] | None = None, start: int = 0, end: int = 0, order_by: str | None = "log_time", reverse: bool = False, include: list[str] = (), exclude: list[str] = (), where: Callable[[str], bool] | None = None, inclusive_end: bool = False, across: bool = False, **options) -> DataFrame:
        """Messages of a half-open time range and some topics, in order; ``across``: one order by time over all files, as of a log in several.

        Patterns and predicates are resolved to topics on the driver, so that they prune chunks too.
        """
        start, stop = select.resolve_bounds(start, end)
        if stop is not None and inclusive_end:
            stop += 1
        if include or exclude or where:
            known = self.topics(path)
            picked = [t for t, _ in [(r.topic, 0) for r in select.topics_matching(known, include, exclude).collect()] if where is None or where(t)]
            topics = [t for t in picked if topics is None or t in topics]
        if topics is not None and not topics:
            return self.relation(path, **options).where(F.lit(False))
        if topics is not None:
            options["topics"] = ",".join(topics) if not any("," in t for t in topics) else None
            options = {k: v for k, v in options.items() if v is not None}
        if start:
            options["start"] = start
        if stop is not None:
            options["end"] = stop
        df = self.relation(path, **options)
        if topics is not None:
            df = select.topics_in(df, topics)
        if "," not in path:  # files of a folder are in order of their names
            keys = ["file"]
        elif len(files.listed(path)) > 1:  # those of a list in its order, no order across them
            place = {p: i for i, p in enumerate(files.listed(path))}
            df = df.withColumn("file_ordinal", F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col("file")])
            keys = ["file_ordinal"]
        else:
            keys = []
        by = {"log_time": ["log_time", "chunk_offset", "msg_offset"], "file": ["chunk_offset", "msg_offset"], "topic": ["topic", "channel_id", "log_time", "chunk_offset", "msg_offset"], None: None}[order_by]
        if by is None:
            return df
        if across:
            keys, by = [], [by[0], "file", *by[1:]] if order_by == "log_time" else [*by, "file"]
        return df.orderBy(*keys, *[F.desc(k) if reverse else F.asc(k) for k in by])

    def topics(self, path: str) -> DataFrame:
        """From the index where every file has one; by reading otherwise."""
        short = self.relation(path, "summary_channels").select("topic").distinct()
        if self._indexed(path):
            return short
        return short.unionByName(self.relation(path, "channels").select("topic")).distinct()

    def _indexed(self, path: str) -> bool:
        """Whether every file's index covers all its messages; files are looked at by tasks, many at a time."""

        def whole(p: str) -> bool:
            f, size = files.open_random(p)
            with f:
                s = records.read_summary(f, size, definitions=False)
            return s is not None and s.proves_complete

        found = files.listed(path)
        if len(found) <= 16:
            return all(map(whole, found))

        def each(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([whole(p) for p in b.column("p").to_pylist()])], ["ok"])

        names = self.spark.createDataFrame([(p,) for p in found], "p string").repartition(min(len(found), 1000))
        return not names.mapInArrow(each, "ok boolean").where("not ok").head(1)

    def definitions(self, path: str, what: str) -> DataFrame:
        """``channels`` or ``schemas``, one row an id and file: from the index where every file has one, by reading otherwise."""
        short = self._indexed(path)
        return self.relation(path, f"summary_{what}" if short else what).dropDuplicates(["file", "id"])

    def channel_identities(self, path: str) -> DataFrame:
        """Which channels of a log's files are one: those of equal ``identity`` (topic, schema, encoding, metadata) and ``copy``.

        Ids are each file's own.  Channels of equal content in one file are told apart by ``copy``: their number in order of their ids.
        """
        s = self.definitions(path, "schemas").select("file", F.col("id").alias("schema_id"), F.col("name").alias("schema_name"), F.col("encoding").alias("schema_encoding"), F.sha2("data", 256).alias("_data"))
        c = self.definitions(path, "channels").withColumnsRenamed({"id": "channel_id", "metadata": "channel_metadata"}).join(s, ["file", "schema_id"], "left")
        what = F.to_json(F.struct("topic", "schema_name", "schema_encoding", "_data", "message_encoding", F.array_sort(F.map_entries("channel_metadata")).alias("metadata")))
        c = c.withColumn("identity", what)
        copy = F.row_number().over(Window.partitionBy("file", "identity").orderBy("channel_id")) - 1
        return c.select("file", "channel_id", "topic", "channel_metadata", "identity", copy.alias("copy"))

    def decoded(self, path: str, topic: str | None = None, **options) -> DataFrame:
        rows = self.messages(path, [topic] if topic else None, **options)
        return decode.decoded(rows, self.definitions(path, "schemas"))

    def typed(self, path: str, topic: str, columns: list[str] | None = None, **options) -> DataFrame:
        """A topic's messages with ``value``: a struct of the types that its definition states (ROS 1, ROS 2), else a VARIANT; and its ``json``.

        ``columns``: which of the messages' own columns are wanted besides; then no others are brought through Python.
        """
        seen = self.definitions(path, "channels").where(F.col("topic") == topic).select("file", F.col("schema_id").alias("id"), "message_encoding").join(self.definitions(path, "schemas"), ["file", "id"])
        kinds = seen.select("message_encoding", "encoding", "name", "data").distinct().limit(2).collect()
        if len(kinds) != 1:
            raise LogError(f"topic {topic} has {'several schemas' if kinds else 'no schema'}")
        kind = kinds[0]
        few = columns is not None and options.get("order_by", "log_time") is None
        rows = self.messages(path, [topic], columns=sorted({*columns, "topic", "data"}) if few else None, **options)
        rows = decode.flat_values(rows.select(*columns, *({"data"} - set(columns))) if columns is not None else rows, kind.message_encoding, kind.encoding, kind.name, bytes(kind.data))
        if rows is not None:
            rows = rows.withColumn("json", F.to_json("value", {"ignoreNullFields": "false"}))
            return rows if columns is None else rows.select(*columns, "value", "json")
        rows = self.decoded(path, topic, **options)
        if columns is not None:
            rows = rows.select(*columns, "json")
        if kind.encoding in ("ros1msg", "ros2msg"):
            return rows.withColumn("value", F.from_json("json", decode.spark_type(kind.name, bytes(kind.data).decode(), kind.encoding == "ros1msg")))
        return rows.withColumn("value", F.parse_json("json"))

    def _typed_as(self, path: str, topic: str, encoding: str, options: dict) -> DataFrame:
        rows = self.typed(path, topic, **options)
        if other := rows.where(F.col("message_encoding") != encoding).select("message_encoding").head(1):
            raise LogError(f"topic {topic} is encoded as {other[0].message_encoding}, not {encoding}")
        return rows

    def read_ros1(self, path: str, topic: str, **options) -> DataFrame:
        return self._typed_as(path, topic, "ros1", options)

    def read_ros2(self, path: str, topic: str, **options) -> DataFrame:
        return self._typed_as(path, topic, "cdr", options)

    def read_protobuf(self, path: str, topic: str, **options) -> DataFrame:
        return self._typed_as(path, topic, "protobuf", options)

    def write_typed(self, rows: DataFrame, path: str, topic: str, message_encoding: str, schema_encoding: str, schema_name: str, schema_data: bytes, **options) -> None:
        """Values (a struct or JSON text in ``value``, with ``log_time``) as messages of one topic; the payloads are encoded on executors."""
        if options.get("order_by", "log_time") == "log_time":  # before they are encoded: dealing rows into ranges reads them twice
            rows, options = self._by_time(rows), options | {"order_by": None}
        self.write(decode.encoded(rows, topic, message_encoding, schema_encoding, schema_name, schema_data), path, **options)

    @staticmethod
    def _by_time(df: DataFrame) -> DataFrame:
        tie = [c for c in ("phase", "input_idx", "chunk_offset", "msg_offset", "sequence") if c in df.columns]
        return df.repartitionByRange("log_time").sortWithinPartitions("log_time", *tie)

    def message(self, path: str, chunk_offset: int, msg_offset: int) -> DataFrame:
        """One message by its place: only its chunk is read."""
        return self.relation(path).where((F.col("chunk_offset") == chunk_offset) & (F.col("msg_offset") == msg_offset))

    def chunk(self, path: str, chunk_offset: int) -> DataFrame:
        """The messages of one chunk, in their order."""
        return self.relation(path).where(F.col("chunk_offset") == chunk_offset).orderBy("file", "msg_offset")

    # ---- summaries

    def statistics(self, path: str) -> DataFrame:
        """From the index where it has statistics, else from the messages and records."""
        if self._indexed(path):
            return self.relation(path, "statistics").drop("channel_message_counts")
        return self.scanned_statistics(path)

    def scanned_statistics(self, path: str) -> DataFrame:
        """As if there were no index: everything is counted anew."""
        seen = stats.file_statistics(self.relation(path, payload=False))
        records_ = self.relation(path, "records")
        kinds = {"schema_count": ("schemas", None), "attachment_count": (None, 0x09), "metadata_count": (None, 0x0C), "chunk_count": (None, 0x06)}
        counted = records_.groupBy("file").agg(*[F.count_if((F.col("opcode") == op) & ~F.col("in_chunk")).alias(k) for k, (_, op) in kinds.items() if op])
        channels, schemas = (self.relation(path, w).groupBy("file").agg(F.countDistinct("id").cast("int" if w == "schemas" else "long").alias(k)) for w, k in (("channels", "channel_count"), ("schemas", "schema_count")))
        out = counted.join(seen.drop("channel_count"), "file", "left").join(channels, "file", "left").join(schemas, "file", "left")
        names = ["message_count", "schema_count", "channel_count", "attachment_count", "metadata_count", "chunk_count", "message_start_time", "message_end_time"]
        return out.select("file", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])

    def summary(self, path: str, scan: bool = False) -> dict[str, DataFrame]:
        """Schemas, channels, chunk indexes and statistics; ``scan`` (or a file without an index) builds them from the records."""
        if not scan and self._indexed(path):
            return {"schemas": self.definitions(path, "schemas"), "channels": self.definitions(path, "channels"), "chunks": self.relation(path, "chunk_index"), "statistics": self.statistics(path)}
        return {**{w: self.relation(path, w).dropDuplicates(["file", "id"]) for w in ("schemas", "channels")}, "chunks": self.relation(path, "chunks"), "statistics": self.scanned_statistics(path)}

    def info(self, path: str) -> dict[str, DataFrame]:
        m = None if self._indexed(path) else self.relation(path, payload=False)
        chunks = self.relation(path, "chunk_index" if m is None else "chunks")
        return {
            "header": self.relation(path, "header"), "statistics": self.statistics(path), "compression": stats.compression_table(chunks), "overlap": stats.chunk_overlap(chunks),
            "channels": listing.channels(self.relation(path, "summary_channels" if m is None else "channels").dropDuplicates(["file", "id"])),
            "frequency": stats.channel_frequency(m if m is not None else self.relation(path, payload=False)),
        }

    def du(self, path: str, approximate: bool = False) -> dict[str, DataFrame]:
        if approximate:
            return {"channels": usage.by_topic_from_index(self.relation(path, "message_index"), self.relation(path, "chunk_index"))}
        return {"kinds": usage.by_kind(self.relation(path, "records").where("not in_chunk")), "topics": usage.by_topic(self.relation(path))}

    def listed(self, path: str, what: str) -> DataFrame:
        relations = {"channels": "channels", "schemas": "schemas", "chunks": "chunk_index", "attachments": "attachments", "metadata": "metadata"}
        if what not in relations:
            raise LogError(f"can't list {what}")
        df = self.relation(path, relations[what], payload=what != "attachments")
        return getattr(listing, what)(self.definitions(path, what) if what in ("channels", "schemas") else df)

    def attachment(self, path: str, name: str, offset: int | None = None) -> DataFrame:
        return listing.get_attachment(self.relation(path, "attachments"), name, offset)

    def metadata(self, path: str, name: str) -> DataFrame:
        return stats.merged_metadata(select.metadata_where(self.relation(path, "metadata"), name))

    def doctor(self, path: str, strict: bool = False) -> Outcome:
        found = integrity.doctor(datasource.relations(self.spark, path, mode="PERMISSIVE", keepUnknown="true"), strict)
        return Outcome(found, ["see findings"] if found.head(1) else [])

    def validate(self, path: str) -> Outcome:
        """Decodes every message and checks the order."""
        self.decoded(path, order_by=None).agg(F.sum(F.length("json"))).collect()
        late = integrity.out_of_order(self.relation(path, payload=False))
        return Outcome(late, [f"{n} messages out of order"] if (n := late.count()) else [])

    # ---- output

    def cat(self, path: str, style: str = "text", **options) -> Outcome:
        rows = self.messages(path, **options)
        if style == "text":
            return Outcome(text.text_line(rows))
        if style == "ndjson":
            return Outcome(text.ndjson_line(decode.decoded(rows, self.definitions(path, "schemas")).withColumn("data", F.col("json"))))
        if style == "csv":
            return self.csv(rows)
        raise LogError(f"unknown format {style}")

    def csv(self, messages: DataFrame) -> Outcome:
        """One topic; the columns are those of its first message, what others have besides is dropped with a warning."""
        if len(messages.select("topic").distinct().limit(2).collect()) > 1:
            raise LogError("CSV needs one topic")
        fixed = ["log_time", "publish_time", "sequence"]
        flat = text.flattened(messages)
        first = flat.orderBy("log_time", "chunk_offset", "msg_offset").select("fields").head(1)
        keys = sorted(first[0].fields or {}) if first else []
        kept = [k for k in keys if k not in fixed]
        warnings = [f"column {k} collides" for k in keys if k in fixed]
        if flat.where(F.size(F.array_except(F.map_keys("fields"), F.array(*[F.lit(k) for k in keys]) if keys else F.expr("array()").cast("array<string>"))) > 0).head(1):
            warnings.append("messages with further columns")
        return Outcome(flat.select(*fixed, *[F.coalesce(F.col("fields")[k], F.lit("")).alias(k) for k in kept]), warnings)

    def write(self, messages: DataFrame, path: str, mode: str = "append", order_by: str | None = "log_time", attachments: DataFrame | None = None, metadata: DataFrame | None = None, **options) -> None:
        """Range-partitioned by the order and sorted in each file, so files follow one another.

        Attachments and metadata records go to files of their own beside those of the messages.
        """
        df = messages
        if order_by == "file":
            place = [c for c in ("phase", "input_idx", "file", "chunk_offset", "msg_offset") if c in df.columns]
            df = df.repartitionByRange(*place).sortWithinPartitions(*place)
        elif order_by:
            keys = {"log_time": ["log_time"], "topic": ["topic", "channel_id", "log_time"]}[order_by]
            tie = [c for c in ("phase", "input_idx", "chunk_offset", "msg_offset", "sequence") if c in df.columns]
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys, *tie)
        options = {k: str(v) for k, v in options.items()}
        df.write.format("tlog").mode(mode).options(path=path, chunkPerChannel=str(order_by == "topic"), **options).save()
        for name, rows in (("attachments", attachments), ("metadata", metadata)):
            if rows is not None:
                order = [c for c in ("input_idx", "file", "offset") if c in rows.columns]
                rows = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
                rows.write.format("tlog").mode("append").options(path=path, relation=name, **options).save()

    def kept(self, path: str, include_attachments: bool = True, include_metadata: bool = True, **options) -> dict[str, DataFrame]:
        """The attachments and metadata records that a rewrite carries over, whatever the times of its messages."""
        wanted = {"attachments": include_attachments, "metadata": include_metadata}
        return {name: self.relation(path, name, **options) for name, keep in wanted.items() if keep}

    def with_schema_data(self, messages: DataFrame, path: str, **options) -> DataFrame:
        """What a writer needs besides: definitions of schemas and metadata of channels."""
        names = {w: self.definitions(path, w) if not options else self.relation(path, w, **options).dropDuplicates(["file", "id"]) for w in ("schemas", "channels")}
        s = names["schemas"].select("file", F.col("id").alias("schema_id"), F.col("data").alias("schema_data"))
        c = names["channels"].select("file", F.col("id").alias("channel_id"), F.col("metadata").alias("channel_metadata"))
        return messages.join(s, ["file", "schema_id"], "left").join(c, ["file", "channel_id"], "left")

    def filter(self, path: str, out: str, include: list[str] = (), exclude: list[str] = (), last_per_channel: list[str] = (), start: int = 0, end: int = 0, order_by: str = "log_time", include_attachments: bool = True, include_metadata: bool = True, **options) -> None:
        """Topics and a time range into a new log; channels named by ``last_per_channel`` get their latest message before it as well.

        Attachments and metadata records stay, unless excluded, whatever the time range.
        """
        rows = self.messages(path, include=include, exclude=exclude, start=start, end=end, order_by=None)
        if last_per_channel:
            before = self.messages(path, include=last_per_channel, order_by=None)
            rows = join.last_of_identity(join.last_per_channel(before, start), self.channel_identities(path)).withColumn("phase", F.lit(0)).unionByName(rows.withColumn("phase", F.lit(1)), allowMissingColumns=True)
        self.write(self.with_schema_data(rows, path), out, order_by=order_by, profile=self.profile(path), **self.kept(path, include_attachments, include_metadata), **options)

    def sort(self, path: str, out: str, order_by: str = "log_time", **options) -> None:
        self.filter(path, out, order_by=order_by, **options)

    def compress(self, path: str, out: str, compression: str = "zstd", **options) -> None:
        self.filter(path, out, compression=compression, **options)

    def decompress(self, path: str, out: str, **options) -> None:
        self.filter(path, out, compression="none", **options)

    def profile(self, path: str) -> str:
        """Of all files if they agree: at most two distinct ones come to the driver."""
        return merge.merged_profile([r.profile for r in self.relation(path, "header").select("profile").distinct().limit(2).collect()])

    def merge(self, paths: list[str], out: str, coalesce: str = "auto", allow_duplicate_metadata: bool = False, include_attachments: bool = True, include_metadata: bool = True, **options) -> None:
        """Several logs into one: order by time, then input, then place; attachments one after another.

        A name of metadata records that comes twice is an error, unless allowed; then equal records are written once.
        """
        parts = []
        for p in paths:
            rows = self.with_schema_data(self.relation(p), p)
            parts.append(rows.withColumn("input_order", F.struct("file", "chunk_offset", "msg_offset")))
        rows = merge.union_inputs(parts)
        if coalesce == "force":  # the first metadata seen of a topic goes for all
            first = rows.groupBy("topic", "schema_name", "message_encoding").agg(F.min_by("channel_metadata", F.struct("log_time", "input_idx", "input_order")).alias("channel_metadata"))
            rows = rows.withColumnsRenamed({"channel_metadata": "_own", "schema_name": "_schema"})
            same = (F.col("f.topic") == F.col("r.topic")) & F.col("_schema").eqNullSafe(F.col("schema_name")) & (F.col("f.message_encoding") == F.col("r.message_encoding"))
            rows = rows.alias("r").join(first.alias("f"), same).select("r.*", "schema_name", "channel_metadata").drop("_own", "_schema")
        elif coalesce == "none":  # each channel of each input stays one of its own, the first input's before the next one's
            own = merge.union_inputs([self.channel_identities(p) for p in paths])
            own = own.select("input_idx", "file", "channel_id", (F.dense_rank().over(Window.partitionBy("identity").orderBy("input_idx", "copy")) - 1).alias("channel_copy"))
            rows = rows.join(own, ["input_idx", "file", "channel_id"], "left")
        elif coalesce != "auto":
            raise LogError(f"unknown mode {coalesce}")
        kept: dict[str, DataFrame] = {}
        if include_attachments:
            kept["attachments"] = merge.union_inputs([self.relation(p, "attachments") for p in paths])
        if include_metadata:
            kept["metadata"] = merge.merge_metadata(merge.union_inputs([self.relation(p, "metadata") for p in paths]), allow_duplicate_metadata)
        self.write(rows, out, profile=merge.merged_profile([self.profile(p) for p in paths]), **kept, **options)

    def convert(self, path: str, out: str, **options) -> None:
        kind = {".bag": "rosbag", ".db3": "db3", ".ulg": "ulog"}.get(PurePosixPath(path).suffix)
        if kind is None:
            raise LogError(f"can't convert {path}")
        self.write(self.spark.read.format(kind).option("path", path).load(), out, profile={"rosbag": "ros1", "db3": "ros2", "ulog": ""}[kind], **options)

    def recover(self, path: str, out: str, **options) -> Outcome:
        """What can be read of damaged files, attachments and metadata records too, file by file.

        The result's table says by file and kind of record how many are recovered and discarded, and whether the file breaks
        off; there are warnings (and exit code 3) only where something is lost.
        """
        lenient = {"mode": "PERMISSIVE"}
        rows = self.with_schema_data(self.relation(path, **lenient), path, **lenient)
        self.write(rows, out, **self.kept(path, **lenient), **options)
        found = self.relation(path, "recovery", **lenient)
        lost = found.groupBy("kind").agg(F.sum("discarded").alias("n"), F.count_if(F.col("discarded") > 0).alias("files")).where("n > 0").orderBy("kind").collect()  # one row a kind
        cut = found.where("truncated").select("file").distinct().count()
        warnings = [f"discarded {r.n} {r.kind} records in {r.files} files" for r in lost] + ([f"{cut} files break off before their end"] if cut else [])
        return Outcome(found, warnings)

    def problems(self, path: str) -> DataFrame:
        """Every problem that a lenient reading meets."""
        return self.relation(path, "problems", mode="PERMISSIVE")

    def on_records(self, path: str, callbacks: dict[str, Callable[[Iterator[dict]], object]], **options) -> None:
        """Calls ``callbacks[relation]`` with the rows of that relation, as dicts, on the executors that read them: once a partition."""

        def caller(fn):
            def each(batches):
                fn(row for b in batches for row in b.to_pylist())
                yield from ()

            return each

        for name, fn in callbacks.items():
            self.relation(path, name, **options).mapInArrow(caller(fn), "none int").write.format("noop").mode("overwrite").save()

    def add(self, path: str, out: str, attachment: dict | None = None, metadata: tuple[str, dict] | None = None, options: records.WriteOptions | None = None) -> None:
        """One file again with one more attachment or metadata record: its data is copied as it is, a piece at a time, and the summary is made anew.

        A file without a summary is written anew from its records.
        """
        _add(path, out, attachment, metadata, options)

    def add_to_all(self, path: str, out: str, attachment: dict | None = None, metadata: tuple[str, dict] | None = None) -> None:
        """:meth:`add` for each file of a log in several, into a folder; the files are copied by tasks."""
        fs, root = files.resolve(out)
        fs.create_dir(root, recursive=True)

        def each(batches):
            fs, root = files.resolve(out)
            for b in batches:
                for p in b.column("p").to_pylist():
                    name = p.rsplit("/", 1)[-1]
                    part = f"_{uuid.uuid4().hex}.tmp"  # a task that runs again replaces its own
                    _add(p, f"{out}/{part}", attachment, metadata)
                    fs.move(f"{root}/{part}", f"{root}/{name}")
            yield from ()

        found = files.listed(path, datasource.SUFFIX)
        names = self.spark.createDataFrame([(p,) for p in found], "p string").repartitionByRange(min(len(found), 1000), "p")
        names.mapInArrow(each, "none int").write.format("noop").mode("overwrite").save()

    # ---- shown

    shown_time = staticmethod(times.shown)
    ranked = staticmethod(order.global_rank)


def _add(path: str, out: str, attachment: dict | None, metadata: tuple[str, dict] | None, options: records.WriteOptions | None = None) -> None:
    source, size = files.open_random(path)
    fs, root = files.resolve(out)
    with source, fs.open_output_stream(root) as sink:
        if options is None and records.amend(source, size, sink, [attachment] if attachment else [], [metadata] if metadata else []):
            return
        w = records.Writer(sink, options or records.WriteOptions())
        attached, named = [], []
        source.seek(0)
        for op, _, _, body in records.scan(source.read()):
            v = records.decode(op, body) if op in (records.SCHEMA, records.CHANNEL, records.MESSAGE, records.ATTACHMENT, records.METADATA) else None
            if op == records.SCHEMA and v["id"]:
                w.add_schema(v["name"], v["encoding"], v["data"], v["id"])
            elif op == records.CHANNEL:
                w.add_channel(v["schema_id"], v["topic"], v["message_encoding"], v["metadata"], v["id"])
            elif op == records.MESSAGE:
                w.write(**v)
            elif op == records.ATTACHMENT:
                attached.append(v)
            elif op == records.METADATA:
                named.append(v)
        for v in named:
            w.add_metadata(v["name"], v["metadata"])
        if metadata:
            w.add_metadata(*metadata)
        for v in attached + ([attachment] if attachment else []):
            w.attach(v["name"], v["media_type"], v["log_time"], v["create_time"], v["data"])
        w.finish()
