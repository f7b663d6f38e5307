"""Logs as streams: latest values, windows over time, late messages, sorted release."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.datasource import register


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New messages of files that grow."""
    register(spark)
    return spark.readStream.format("tlog").options(path=path, **options).load()


def event_time(messages: DataFrame) -> DataFrame:
    """``messages`` with ``ts``: the log time as TIMESTAMP (microseconds), for watermarks only."""
    return messages.withColumn("ts", F.timestamp_micros(F.expr("log_time div 1000")))


def latest_per_channel(messages: DataFrame) -> DataFrame:
    """Running latest message of each channel; use with complete or update mode."""
    keys = F.struct("log_time", "chunk_offset", "msg_offset") if "chunk_offset" in messages.columns else F.col("log_time")
    return messages.groupBy("topic", "channel_id").agg(F.max_by(F.struct("log_time", "sequence"), keys).alias("m"), F.count("*").alias("n")).select("topic", "channel_id", "m.*", "n")


def windowed_counts(messages: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Messages of each topic in tumbling or sliding windows; later than ``late`` is too late."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return event_time(messages).withWatermark("ts", late).groupBy(w.alias("w"), "topic").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "topic", "n")


def sessions(messages: DataFrame, gap: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    s = F.session_window("ts", gap)
    return event_time(messages).withWatermark("ts", late).groupBy(s.alias("w"), "channel_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "channel_id", "n")


def with_definitions(messages: DataFrame, channels: DataFrame, schemas: DataFrame) -> DataFrame:
    """Stream-static star join."""
    from ..operators.join import message_view

    return message_view(messages, channels, schemas)


def sorted_release(messages: DataFrame, delay_ns: int) -> DataFrame:
    """Messages of each topic in order of log time, held until ``delay_ns`` newer ones have come.

    State is what has not been released: bounded by the delay, not by the stream.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in zip(*state.get)] if state.exists else []
        for pdf in batches:
            held += list(zip(pdf["log_time"].tolist(), pdf["sequence"].tolist()))
        held.sort()
        edge = held[-1][0] - delay_ns
        out = [h for h in held if h[0] <= edge]
        rest = [h for h in held if h[0] > edge]
        state.update((tuple(h[0] for h in rest), tuple(h[1] for h in rest)))
        yield pd.DataFrame({"topic": [key[0]] * len(out), "log_time": [h[0] for h in out], "sequence": [h[1] for h in out]})

    return messages.select("topic", "log_time", "sequence").groupBy("topic").applyInPandasWithState(step, "topic string, log_time long, sequence long", "t array<long>, s array<long>", "append", GroupStateTimeout.NoTimeout)


def out_of_order(messages: DataFrame) -> Column:
    """For foreachBatch: whether a message is earlier than the one before it in its batch."""
    from ..operators.order import lag_in_file

    return F.col("log_time") < lag_in_file(messages)
