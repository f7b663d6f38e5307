"""Merging logs: one order, shared schemas and channels, metadata without duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import MAX_IDS, LogError

#: Order of merged messages.
MERGE_ORDER = ("log_time", "input_idx", "input_order")


def union_inputs(inputs: Sequence[DataFrame]) -> DataFrame:
    """All inputs with ``input_idx``, in the order in which they were given."""
    out = None
    for i, df in enumerate(inputs):
        df = df.withColumn("input_idx", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise LogError("nothing to merge")
    return out


def merged(inputs: Sequence[DataFrame]) -> DataFrame:
    return union_inputs(inputs).orderBy(*MERGE_ORDER)


def merged_profile(profiles: Sequence[str]) -> str:
    """Kept only where all inputs agree."""
    return profiles[0] if profiles and len(set(profiles)) == 1 else ""


def schema_ids(schemas: DataFrame) -> DataFrame:
    """``input_idx, id, out_id``: equal name, encoding and data share an id, counted from 1 in order of first sight."""
    key = ["name", "encoding", "data"]
    first = schemas.groupBy(*key).agg(F.min(F.struct("input_idx", "id")).alias("first"))
    # schemas, not messages: few rows
    numbered = first.withColumn("out_id", F.row_number().over(Window.orderBy("first")))
    return schemas.join(numbered, key).select("input_idx", "id", "out_id")


def coalesce_channels(messages: DataFrame, mode: str = "auto") -> DataFrame:
    """``input_idx, channel_id, out_id`` for the channels that have a message.

    ``messages`` has the channel's ``schema_key, topic, message_encoding, channel_metadata`` (as sorted JSON).
    auto: equal schema, topic, encoding and metadata share an id; force: metadata doesn't count; none: each is its own.
    Ids are given from 1 in order of first message.
    """
    keys = {"auto": ["schema_key", "topic", "message_encoding", "channel_metadata"], "force": ["schema_key", "topic", "message_encoding"], "none": ["input_idx", "channel_id"]}
    if mode not in keys:
        raise LogError(f"unknown mode {mode}")
    # one row a channel after map-side aggregation; only these are numbered
    per = messages.groupBy("input_idx", "channel_id", "schema_key", "topic", "message_encoding", "channel_metadata").agg(F.min(F.struct(*MERGE_ORDER)).alias("first"))
    groups = per.groupBy(*keys[mode]).agg(F.min("first").alias("first"))
    numbered = groups.select(*[F.col(k).alias(f"_{k}") for k in keys[mode]], F.row_number().over(Window.orderBy("first")).alias("out_id"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys[mode]]
    return per.join(numbered, same).select("input_idx", "channel_id", "out_id")


def check_ids(mapping: DataFrame) -> DataFrame:
    most = mapping.agg(F.max("out_id").alias("m")).first().m or 0
    if most > MAX_IDS:
        raise LogError(f"{most} channels; a file has {MAX_IDS} at most")
    return mapping


def merge_metadata(metadata: DataFrame, allow_duplicates: bool = False) -> DataFrame:
    """A name that comes twice is an error, unless allowed; then equal records collapse."""
    if not allow_duplicates:
        if twice := metadata.groupBy("name").count().where("count > 1").head(1):
            raise LogError(f"metadata name {twice[0].name!r} comes more than once: allow duplicates to merge them")
        return metadata
    return metadata.withColumn("_m", F.array_sort(F.map_entries("metadata"))).dropDuplicates(["name", "_m"]).drop("_m")
