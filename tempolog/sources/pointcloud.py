"""Rows of CSV as JSON messages: one message a frame, points as an array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def messages(spark: SparkSession, path: str, time: str, topic: str = "pointcloud", unit_ns: int = 1) -> DataFrame:
    """``path``: CSV with a header; rows of one ``time`` make a message, in order of their other columns."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    points = [F.col(c).cast("double").alias(c) for c in rows.columns if c != time]
    frames = rows.groupBy((F.col(time).cast("bigint") * unit_ns).alias("log_time")).agg(F.array_sort(F.collect_list(F.struct(*points))).alias("points"))
    return frames.select(F.lit(topic).alias("topic"), F.lit("json").alias("message_encoding"), F.lit(None).cast("string").alias("schema_name"), "log_time", F.col("log_time").alias("publish_time"), F.lit(0).cast("long").alias("sequence"), F.to_json(F.struct("points")).cast("binary").alias("data"))
