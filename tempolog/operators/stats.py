"""Aggregates: file statistics, frequencies, codec table, chunk overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_statistics(messages: DataFrame) -> DataFrame:
    """Counts and time bounds of each file; bounds are 0 without a message."""
    return messages.groupBy("file").agg(
        F.count("*").alias("message_count"),
        F.countDistinct("channel_id").alias("channel_count"),
        F.coalesce(F.min("log_time"), F.lit(0)).alias("message_start_time"),
        F.coalesce(F.max("log_time"), F.lit(0)).alias("message_end_time"),
    )


def channel_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("file", "channel_id").agg(F.count("*").alias("message_count"))


def topic_counts(messages: DataFrame) -> DataFrame:
    """Summed over the channels of a topic."""
    return messages.groupBy("topic").agg(F.count("*").alias("message_count"))


def channel_frequency(messages: DataFrame) -> DataFrame:
    """``max_hz = n / d`` and ``min_hz = (n - 1) / d`` with the duration of the whole file; null for one message or no time."""
    bounds = messages.groupBy("file").agg((F.max("log_time") - F.min("log_time")).alias("duration"))
    d = F.col("duration") / 1e9
    some = (F.col("n") > 1) & (F.col("duration") > 0)
    return (
        messages.groupBy("file", "channel_id").agg(F.count("*").alias("n")).join(bounds, "file")
        .select("file", "channel_id", "n", F.when(some, F.col("n") / d).alias("max_hz"), F.when(some, (F.col("n") - 1) / d).alias("min_hz"))
    )


def frequency_label(max_hz: Column, min_hz: Column) -> Column:
    """The rate with as many decimals as the two bounds tell apart; two where that is more than two."""
    digits = F.ceil(-F.log10(max_hz - min_hz))
    shown = F.when(digits > 2, F.format_string("%.2f", max_hz)).when(digits == 2, F.format_string("%.2f", max_hz)).when(digits == 1, F.format_string("%.1f", max_hz)).otherwise(F.format_string("%.0f", max_hz))
    return F.concat(shown, F.lit("Hz"))


def compression_table(chunks: DataFrame) -> DataFrame:
    """By codec: chunks, bytes, ratio in percent, and compressed bytes a second of the recording."""
    d = chunks.groupBy("file").agg(((F.max("end_time") - F.min("start_time")) / 1e9).alias("seconds"))
    by = chunks.groupBy("file", "compression").agg(F.count("*").alias("chunks"), F.sum("compressed_size").alias("compressed"), F.sum("uncompressed_size").alias("uncompressed"))
    return by.join(d, "file").select(
        "file", "compression", "chunks", "compressed", "uncompressed",
        F.when(F.col("uncompressed") > 0, 100 * (1 - F.col("compressed") / F.col("uncompressed"))).alias("ratio"),
        F.when(F.col("seconds") > 0, F.col("compressed") / F.col("seconds")).alias("bytes_per_second"),
    )


def chunk_overlap(chunks: DataFrame) -> DataFrame:
    """The most chunks open at one time, and their bytes then; touching chunks overlap, fewer than two never do.

    A sweep over starts and ends of each file's chunks: one row a chunk, not a message.
    """
    start = chunks.select("file", F.col("start_time").alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("d"), F.col("uncompressed_size").alias("size"))
    end = chunks.select("file", F.col("end_time").alias("t"), F.lit(1).alias("kind"), F.lit(-1).alias("d"), (-F.col("uncompressed_size")).alias("size"))
    rows = Window.partitionBy("file").orderBy("t", "kind", F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = start.unionByName(end).withColumns({"active": F.sum("d").over(rows), "bytes": F.sum("size").over(rows)}).where("kind = 0")
    peak = swept.groupBy("file").agg(F.max(F.struct("active", "bytes")).alias("p"))
    return peak.select("file", F.when(F.col("p.active") > 1, F.col("p.active")).otherwise(0).cast("long").alias("max_concurrent"), F.when(F.col("p.active") > 1, F.col("p.bytes")).otherwise(0).cast("long").alias("peak_bytes"))


def tallies(records: DataFrame, kind: str = "kind", ok: str = "ok") -> DataFrame:
    """Recovered and discarded records of each kind."""
    return records.groupBy(kind).agg(F.count_if(F.col(ok)).alias("recovered"), F.count_if(~F.col(ok)).alias("discarded"))


def merged_metadata(metadata: DataFrame) -> DataFrame:
    """One map a name; of equal keys the value of the record with the greatest offset stays."""
    each = metadata.select("file", "name", "offset", F.explode("metadata").alias("key", "value"))
    last = each.groupBy("file", "name", "key").agg(F.max_by("value", "offset").alias("value"))
    return last.groupBy("file", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))


def indexed_messages(index: DataFrame) -> DataFrame:
    """Messages in the index, each index record counted once."""
    return index.dropDuplicates(["file", "index_offset"]).groupBy("file").agg(F.sum(F.size("entries")).cast("long").alias("indexed"))
