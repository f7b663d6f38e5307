"""The driver's tables as relations of a message log.

``events``: topic = event type, channel = (event type, user), sequence = event
id, chunk = a hundred events.  The first topic in order has no schema.  With
``jitter`` log times are shifted by up to 500 minutes, so that they come out of
order and chunks overlap.  Channels and schemas are dimensions: their ids are
numbered over distinct keys, never over messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.time import nanos_of
from .model import MESSAGE_OVERHEAD


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = read(spark, sf_dir, "events").select(F.col("event_type").alias("topic")).distinct()
    ids = topics.withColumn("id", F.row_number().over(Window.orderBy("topic")) - 1)
    return ids.where("id > 0").select(F.lit("events").alias("file"), "id", F.concat(F.lit("ns/"), "topic").alias("name"), F.lit("jsonschema").alias("encoding"), F.lit('{"type":"object"}').cast("binary").alias("data"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), "user_id").distinct()
    w = Window.orderBy("topic", "user_id")
    return pairs.select(F.lit("events").alias("file"), F.row_number().over(w).alias("id"), (F.dense_rank().over(Window.orderBy("topic")) - 1).alias("schema_id"), "topic", F.lit("json").alias("message_encoding"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"), "user_id")


def messages(spark: SparkSession, sf_dir: str, jitter: bool = False) -> DataFrame:
    e = read(spark, sf_dir, "events")
    at = nanos_of(F.col("ts"))
    log = at + F.pmod(F.col("event_id") * 7919, F.lit(500)) * F.lit(60_000_000_000) if jitter else at
    ids = channels(spark, sf_dir).select("topic", "user_id", F.col("id").alias("channel_id"))  # 65,535 rows at most
    rows = e.withColumn("topic", F.col("event_type")).join(ids, ["topic", "user_id"])
    return rows.select(
        F.lit("events").alias("file"), "channel_id", "topic", F.col("event_id").alias("sequence"), log.alias("log_time"), at.alias("publish_time"), F.col("props").cast("binary").alias("data"),
        F.floor(F.col("event_id") / 100).alias("chunk_offset"), F.pmod("event_id", F.lit(100)).alias("msg_offset"),
    )


def byte_offsets(messages_: DataFrame) -> DataFrame:
    """Offsets in bytes instead of places in the chunk: what the message index holds."""
    size = F.octet_length("data") + MESSAGE_OVERHEAD
    before = Window.partitionBy("file", "chunk_offset").orderBy("msg_offset").rowsBetween(Window.unboundedPreceding, -1)
    return messages_.withColumn("msg_offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large stream: topic = return flag, channel = supplier."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("lineitem").alias("file"), F.col("l_suppkey").cast("int").alias("channel_id"), F.col("l_returnflag").alias("topic"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sequence"),
        nanos_of(F.col("l_shipdate")).alias("log_time"), F.octet_length(F.col("l_linestatus")).alias("size"), F.col("l_orderkey").alias("chunk_offset"), F.col("l_linenumber").cast("long").alias("msg_offset"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.lit("documents").alias("file"), F.col("doc_id").cast("string").alias("name"), F.col("source").alias("media_type"), F.col("doc_id").alias("log_time"), F.lit(0).cast("long").alias("create_time"), F.col("doc_id").alias("offset"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("data_size"), F.col("text"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as metadata: name = conversation, one key a role, later turns overwrite."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.lit("conversations").alias("file"), F.col("conv_id").cast("string").alias("name"), F.col("turn").alias("offset"), F.create_map("role", F.coalesce("text", F.lit(""))).alias("metadata"))
