"""Listings and lookups of the relations that are not messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import LogError


def sorted_json(column: str):
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))


def channels(df: DataFrame) -> DataFrame:
    return df.select("id", "schema_id", "topic", "message_encoding", sorted_json("metadata").alias("metadata")).orderBy("id")


def schemas(df: DataFrame) -> DataFrame:
    """The definition as text, or its size where it isn't text."""
    text = F.when(F.is_valid_utf8(F.col("data")), F.col("data").cast("string")).otherwise(F.format_string("<%d bytes binary>", F.octet_length("data")))
    return df.select("id", "name", "encoding", text.alias("data")).orderBy("id")


def chunks(df: DataFrame) -> DataFrame:
    ratio = F.when(F.col("uncompressed_size") > 0, F.col("compressed_size") / F.col("uncompressed_size")).otherwise(0.0)
    return df.select(
        F.col("chunk_offset").alias("offset"), F.col("chunk_length").alias("length"), "start_time", "end_time", "compression", "compressed_size", "uncompressed_size",
        F.format_string("%.6f", ratio).alias("ratio"), "message_index_length",
    ).orderBy("offset")


def attachments(df: DataFrame) -> DataFrame:
    return df.select("name", "media_type", "log_time", "create_time", F.col("data_size").alias("length"), "offset").orderBy("offset")


def metadata(df: DataFrame) -> DataFrame:
    return df.select("name", "offset", "length", sorted_json("metadata").alias("metadata")).orderBy("offset")


def get_attachment(df: DataFrame, name: str, offset: int | None = None) -> DataFrame:
    """None by that name is an error; of several, the offset says which; of one, it must agree."""
    found = df.where(F.col("name") == name)
    wanted = found if offset is None else found.where(F.col("offset") == offset)
    n = wanted.count()
    if offset is None and n > 1:
        some = sorted(r.offset for r in found.select("offset").limit(20).collect())  # for the message alone
        raise LogError(f"{n} attachments named {name}: give an offset, as {some}{' or others' if n > len(some) else ''}")
    if not n:
        raise LogError(f"attachment {name} not found" + ("" if offset is None else f" at offset {offset}"))
    return wanted
