"""Integrity rules: each is one query of ``severity, rule, file, detail``; :func:`doctor` is their union.

The relations come from a scan of the whole file in file order
(:func:`tempolog.sources.datasource.relations`) or from any tables of those shapes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .join import compare_index, summary_only, unknown_channels, unknown_schemas
from .order import running_max_before

ERROR, WARNING = "error", "warning"
PROFILES = ("", "ros1", "ros2")
#: Records that may stand in a chunk: schema, channel, message.
IN_CHUNK = (0x03, 0x04, 0x05)


def finding(df: DataFrame, severity: str, rule: str, detail: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.col("file"), detail.cast("string").alias("detail"))


def out_of_order(messages: DataFrame, strict: bool = False) -> DataFrame:
    """Messages earlier than the latest before them in their file's order."""
    late = running_max_before(messages, ("chunk_offset", "msg_offset"), "log_time", by="file").where("log_time < max_before")
    return finding(late, ERROR if strict else WARNING, "decreasing-log-time", F.concat_ws(" < ", "log_time", "max_before"))


def previous_later(messages: DataFrame) -> DataFrame:
    """Messages earlier than the one just before them in their chunk."""
    w = Window.partitionBy("file", "chunk_offset").orderBy("msg_offset")
    return messages.withColumn("_p", F.lag("log_time").over(w)).where("log_time < _p").drop("_p")


def unknown_channel(messages: DataFrame, channels: DataFrame) -> DataFrame:
    found = unknown_channels(messages, channels).groupBy("file", "channel_id").agg(F.count("*").alias("n"))
    return finding(found, ERROR, "unknown-channel", F.format_string("channel %d: %d messages", "channel_id", "n"))


def unknown_schema(channels: DataFrame, schemas: DataFrame) -> DataFrame:
    return finding(unknown_schemas(channels, schemas), ERROR, "unknown-schema", F.format_string("channel %d: schema %d", "id", "schema_id"))


def message_before_channel(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """``channels`` with ``file_pos``, the place of the definition in file order; messages with the same."""
    first = channels.groupBy("file", F.col("id").alias("channel_id")).agg(F.min("file_pos").alias("defined"))
    early = messages.join(first, ["file", "channel_id"]).where("file_pos < defined").groupBy("file", "channel_id").agg(F.count("*").alias("n"))
    return finding(early, ERROR, "message-before-channel", F.format_string("channel %d: %d messages", "channel_id", "n"))


def conflicting(definitions: DataFrame, fields: list[str], kind: str) -> DataFrame:
    """One id with different content."""
    content = F.to_json(F.struct(*[F.hex(f) if t == "binary" else F.array_sort(F.map_entries(f)) if t.startswith("map") else F.col(f) for f, t in definitions.dtypes if f in fields]))
    many = definitions.groupBy("file", "id").agg(F.countDistinct(content).alias("n")).where("n > 1")
    return finding(many, ERROR, f"conflicting-{kind}", F.format_string("id %d: %d versions", "id", "n"))


def duplicates(definitions: DataFrame, kind: str) -> DataFrame:
    many = definitions.groupBy("file", "id").agg(F.count("*").alias("n")).where("n > 1")
    return finding(many, WARNING, f"duplicate-{kind}", F.format_string("id %d: %d times", "id", "n"))


def not_in_data(summary: DataFrame, data: DataFrame, kind: str) -> DataFrame:
    return finding(summary_only(summary, data, ["file", "id"]), ERROR, f"{kind}-only-in-summary", F.col("id"))


def schema_rules(schemas: DataFrame) -> DataFrame:
    zero = finding(schemas.where("id = 0"), ERROR, "schema-id-zero", F.col("name"))
    empty = finding(schemas.where("encoding = '' and octet_length(data) > 0"), ERROR, "schema-data-without-encoding", F.col("id"))
    hollow = finding(schemas.where("encoding <> '' and octet_length(data) = 0"), WARNING, "schema-encoding-without-data", F.col("id"))
    return zero.unionByName(empty).unionByName(hollow)


def header_rules(header: DataFrame) -> DataFrame:
    lib = finding(header.where("library = ''"), WARNING, "empty-library", F.lit(""))
    return lib.unionByName(finding(header.where(~F.col("profile").isin(*PROFILES)), WARNING, "unknown-profile", F.col("profile")))


def file_rules(records: DataFrame) -> DataFrame:
    """From ``file, opcode, in_chunk`` of every record: end records, unknown and illegal ones, several statistics."""
    ends = records.groupBy("file").agg(*[F.count_if(F.col("opcode") == op).alias(name) for op, name in ((0x0F, "data_end"), (0x02, "footer"), (0x0B, "statistics"))])
    out = [
        finding(ends.where("data_end = 0"), ERROR, "no-data-end", F.lit("")),
        finding(ends.where("footer = 0"), ERROR, "no-footer", F.lit("")),
        finding(ends.where("statistics > 1"), ERROR, "several-statistics", F.col("statistics")),
        finding(records.where("opcode > 15 and opcode < 128 or opcode = 0"), WARNING, "unknown-opcode", F.col("opcode")),
        finding(records.where(F.col("in_chunk") & ~F.col("opcode").isin(*IN_CHUNK) & (F.col("opcode") < 128)), ERROR, "illegal-in-chunk", F.col("opcode")),
    ]
    loose = records.where("not in_chunk and opcode = 5").groupBy("file").agg(F.count("*").alias("n"))
    indexed = records.where("opcode = 8").select("file").distinct()
    out.append(finding(loose.join(indexed, "file", "left_semi"), WARNING, "message-outside-chunk", F.col("n")))
    return reduce(DataFrame.unionByName, out)


def chunk_bounds(chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """Chunk headers against the times seen; 0 for a chunk without a message."""
    seen = messages.groupBy("file", "chunk_offset").agg(F.min("log_time").alias("lo"), F.max("log_time").alias("hi"))
    both = chunks.join(seen, ["file", "chunk_offset"], "left").withColumns({"lo": F.coalesce("lo", F.lit(0)), "hi": F.coalesce("hi", F.lit(0))})
    start = finding(both.where("start_time <> lo"), ERROR, "chunk-start", F.format_string("chunk %d: %d, seen %d", "chunk_offset", "start_time", "lo"))
    return start.unionByName(finding(both.where("end_time <> hi"), ERROR, "chunk-end", F.format_string("chunk %d: %d, seen %d", "chunk_offset", "end_time", "hi")))


def index_mismatch(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Only where a file has an index at all."""
    chunks = chunks.join(index.select("file").distinct(), "file", "left_semi")
    return finding(compare_index(index, chunks), ERROR, "chunk-index-mismatch", F.format_string("chunk %d: %s", "chunk_offset", "field"))


def duplicate_index(index: DataFrame) -> DataFrame:
    many = index.groupBy("file", "chunk_offset").agg(F.count("*").alias("n")).where("n > 1")
    return finding(many, ERROR, "duplicate-chunk-index", F.col("chunk_offset"))


def not_repeated(index: DataFrame, summary_channels: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Channels of indexed chunks, by the index or by the chunks' messages, that the summary lacks."""
    used = index.select("file", F.explode(F.map_keys("message_index_offsets")).alias("id")).distinct()
    if messages is not None:
        seen = messages.select("file", "chunk_offset", F.col("channel_id").alias("id")).distinct().join(index.select("file", "chunk_offset"), ["file", "chunk_offset"], "left_semi")
        used = used.unionByName(seen.select("file", "id")).distinct()
    return finding(used.join(summary_channels, ["file", "id"], "left_anti"), ERROR, "channel-not-in-summary", F.col("id"))


def schemas_not_repeated(index: DataFrame, messages: DataFrame, channels: DataFrame, summary_schemas: DataFrame) -> DataFrame:
    """Schemas of the messages of indexed chunks that the summary lacks."""
    seen = messages.select("file", "chunk_offset", "channel_id").distinct().join(index.select("file", "chunk_offset"), ["file", "chunk_offset"], "left_semi")
    used = seen.join(channels.select("file", F.col("id").alias("channel_id"), "schema_id").distinct(), ["file", "channel_id"]).where("schema_id <> 0").select("file", F.col("schema_id").alias("id")).distinct()
    return finding(used.join(summary_schemas, ["file", "id"], "left_anti"), ERROR, "schema-not-in-summary", F.col("id"))


def index_without_chunk(index: DataFrame, records: DataFrame) -> DataFrame:
    """Chunk indexes that point where no chunk record begins."""
    chunks = records.where("opcode = 6 and not in_chunk").select("file", F.col("offset").alias("chunk_offset"))
    return finding(index.join(chunks, ["file", "chunk_offset"], "left_anti"), ERROR, "chunk-index-points-at-no-chunk", F.col("chunk_offset"))


def statistics_mismatch(statistics: DataFrame, messages: DataFrame) -> DataFrame:
    seen = messages.groupBy("file").agg(F.count("*").alias("n"), F.min("log_time").alias("lo"), F.max("log_time").alias("hi"))
    both = statistics.join(seen, "file", "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("n", "lo", "hi")})
    out = None
    for stated, got in (("message_count", "n"), ("message_start_time", "lo"), ("message_end_time", "hi")):
        rule = finding(both.where(F.col(stated) != F.col(got)), ERROR, f"statistics-{stated.replace('_', '-')}", F.format_string("%d, seen %d", stated, got))
        out = rule if out is None else out.unionByName(rule)
    return out


def statistics_channels(statistics: DataFrame, summary_channels: DataFrame) -> DataFrame:
    ids = statistics.select("file", F.explode(F.map_keys("channel_message_counts")).alias("id"))
    return finding(ids.join(summary_channels, ["file", "id"], "left_anti"), ERROR, "statistics-channel-not-in-summary", F.col("id"))


def doctor(r: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """All rules over the relations of some files (see :func:`tempolog.sources.datasource.relations`)."""
    ch, sc = r["channels"], r["schemas"]
    schema_fields, channel_fields = ["name", "encoding", "data"], ["schema_id", "topic", "message_encoding", "metadata"]
    out = [
        header_rules(r["header"]), file_rules(r["records"]), schema_rules(sc),
        conflicting(sc.unionByName(r["summary_schemas"]), schema_fields, "schema"), conflicting(ch.unionByName(r["summary_channels"]), channel_fields, "channel"),
        duplicates(sc, "schema"), duplicates(ch, "channel"),
        not_in_data(r["summary_schemas"], sc, "schema"), not_in_data(r["summary_channels"], ch, "channel"),
        unknown_schema(ch, sc), unknown_channel(r["messages"], ch), message_before_channel(r["messages"], ch), out_of_order(r["messages"], strict),
        chunk_bounds(r["chunks"], r["messages"]), index_mismatch(r["chunk_index"], r["chunks"]), duplicate_index(r["chunk_index"]),
        not_repeated(r["chunk_index"], r["summary_channels"], r["messages"]), schemas_not_repeated(r["chunk_index"], r["messages"], ch, r["summary_schemas"]), index_without_chunk(r["chunk_index"], r["records"]),
        statistics_mismatch(r["statistics"], r["messages"]), statistics_channels(r["statistics"], r["summary_channels"]),
    ]
    return reduce(DataFrame.unionByName, out)
