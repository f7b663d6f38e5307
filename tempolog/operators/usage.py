"""Where the bytes go: exact by record, or estimated from the message index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import MESSAGE_OVERHEAD

#: A record's opcode and length.
ENVELOPE = 9
#: Magic bytes at both ends of a file.
MAGIC_BYTES = 16


def by_topic(messages: DataFrame) -> DataFrame:
    """Payload bytes of each topic, the largest first."""
    got = messages.groupBy("topic").agg(F.sum(F.octet_length("data")).alias("bytes"), F.count("*").alias("messages"))
    return _share(got, "topic")


def by_kind(records: DataFrame) -> DataFrame:
    """Bytes of each kind of record, with its envelope, from ``kind, length`` (of the content)."""
    return _share(records.groupBy("kind").agg(F.sum(F.col("length") + ENVELOPE).alias("bytes")), "kind")


def _share(df: DataFrame, name: str) -> DataFrame:
    total = df.agg(F.sum("bytes").alias("t")).first().t  # df has one row a topic or kind
    return df.withColumn("percent", F.format_string("%.6f", 100 * F.col("bytes") / F.lit(total or 1))).orderBy(F.desc("bytes"), name)


def by_topic_from_index(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Payload bytes of each channel from distances of neighbouring offsets in a chunk.

    A distance also covers other records that lie between; one of :data:`MESSAGE_OVERHEAD` or less counts as nothing.
    """
    entries = index.select("file", "chunk_offset", "channel_id", F.explode("entries").alias("e")).select("file", "chunk_offset", "channel_id", "e.msg_offset")
    sized = entries.join(chunks.select("file", "chunk_offset", "uncompressed_size"), ["file", "chunk_offset"])
    w = Window.partitionBy("file", "chunk_offset").orderBy("msg_offset")
    gap = F.coalesce(F.lead("msg_offset").over(w), F.col("uncompressed_size")) - F.col("msg_offset") - MESSAGE_OVERHEAD
    return sized.withColumn("bytes", F.greatest(gap, F.lit(0))).groupBy("file", "channel_id").agg(F.sum("bytes").alias("bytes"))
