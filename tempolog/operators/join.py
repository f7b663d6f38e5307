"""The star join, as-of lookups, and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import LogError


def message_view(messages: DataFrame, channels: DataFrame, schemas: DataFrame, strict: bool = False) -> DataFrame:
    """Messages with their channel (inner) and schema (left: id 0 has none).

    The dimensions have 65,535 rows a file at most.  Catalyst broadcasts them while they are below its threshold.
    ``strict``: a message of an unknown channel, or a channel of an unknown schema, is an error instead of a lost row.
    """
    if strict and unknown_channels(messages, channels).head(1):
        raise LogError("message of a channel that is not defined")
    if strict and unknown_schemas(channels, schemas).head(1):
        raise LogError("channel of a schema that is not defined")
    c = channels.select("file", F.col("id").alias("channel_id"), "schema_id", "topic", "message_encoding")
    s = schemas.select("file", F.col("id").alias("schema_id"), F.col("name").alias("schema_name"), F.col("encoding").alias("schema_encoding"))
    facts = messages.drop("schema_id", "topic", "message_encoding", "schema_name", "schema_encoding")
    return facts.join(c, ["file", "channel_id"]).join(s, ["file", "schema_id"], "left")


def unknown_channels(messages: DataFrame, channels: DataFrame) -> DataFrame:
    return messages.join(channels.select("file", F.col("id").alias("channel_id")), ["file", "channel_id"], "left_anti")


def unknown_schemas(channels: DataFrame, schemas: DataFrame) -> DataFrame:
    return channels.where("schema_id <> 0").join(schemas.select("file", F.col("id").alias("schema_id")), ["file", "schema_id"], "left_anti")


def last_per_channel(messages: DataFrame, before: int) -> DataFrame:
    """Of each channel its latest message before ``before``.

    ``max_by`` over the whole row: aggregated before the shuffle, nothing is sorted, a hot channel costs one row a task.
    """
    keys = F.struct("log_time", "chunk_offset", "msg_offset")
    found = messages.where(F.col("log_time") < F.lit(before)).groupBy("file", "channel_id").agg(F.max_by(F.struct(*messages.columns), keys).alias("m"))
    return found.select("m.*")


def last_of_identity(latest: DataFrame, identities: DataFrame) -> DataFrame:
    """Of the latest messages of each file's channels those of the whole log: ``identities`` says which channels of its files are one."""
    place = F.struct("log_time", "file", "chunk_offset", "msg_offset")
    named = latest.join(identities.select("file", "channel_id", "identity", "copy"), ["file", "channel_id"])
    return named.groupBy("identity", "copy").agg(F.max_by(F.struct(*latest.columns), place).alias("m")).select("m.*")


def last_per_channel_ranked(messages: DataFrame, before: int) -> DataFrame:
    """The same by ``row_number``: Catalyst's group limit prunes each task's rows first."""
    w = Window.partitionBy("file", "channel_id").orderBy(F.desc("log_time"), F.desc("chunk_offset"), F.desc("msg_offset"))
    return messages.where(F.col("log_time") < F.lit(before)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def seeded_window(messages: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """The window's messages, preceded by each channel's latest before it: ``phase`` 0 and 1."""
    window = messages.where(F.col("log_time") >= F.lit(start))
    window = window if end is None else window.where(F.col("log_time") < F.lit(end))
    return last_per_channel(messages, start).withColumn("phase", F.lit(0)).unionByName(window.withColumn("phase", F.lit(1)))


def summary_only(summary: DataFrame, data: DataFrame, on: list[str]) -> DataFrame:
    """Definitions of the summary that the data section lacks."""
    return summary.join(data.select(*on).distinct(), on, "left_anti")


def compare_index(index: DataFrame, chunks: DataFrame, fields: tuple[str, ...] = ("chunk_length", "start_time", "end_time", "compression", "compressed_size", "uncompressed_size")) -> DataFrame:
    """Chunk index against chunk headers: one row for each field that differs, or ``missing``."""
    i = index.select("file", "chunk_offset", F.struct(*fields).alias("i"))
    c = chunks.select("file", "chunk_offset", F.struct(*fields).alias("c"))
    both = i.join(c, ["file", "chunk_offset"], "full")
    wrong = F.array_compact(F.array(F.when(F.col("i").isNull() | F.col("c").isNull(), F.lit("missing")), *[F.when(~F.col(f"i.{f}").eqNullSafe(F.col(f"c.{f}")) & F.col("i").isNotNull() & F.col("c").isNotNull(), F.lit(f)) for f in fields]))
    return both.select("file", "chunk_offset", F.explode(wrong).alias("field"))


def definitions_for(topics: DataFrame, definitions: DataFrame, key: str = "type") -> DataFrame:
    """Topics with their message definitions: a type without one, or with several, is an error."""
    if definitions.groupBy(key).count().where("count > 1").head(1):
        raise LogError("duplicate message definition")
    if topics.join(definitions, key, "left_anti").head(1):
        raise LogError("topic without a message definition")
    return topics.join(definitions, key)
