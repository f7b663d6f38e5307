"""Selection: time ranges, topics, predicates on the other relations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LogError

NANOS = 1_000_000_000


def resolve_bounds(start: int = 0, end: int = 0) -> tuple[int, int | None]:
    """An end of 0 is no bound; an end before the start is an error."""
    if end and end < start:
        raise LogError("end-time is before start-time")
    return start, end or None


def bound_nanos(text: str | None = None, nsecs: int | None = None, secs: int | None = None) -> int:
    """A time bound: a string wins over nanoseconds, those over seconds."""
    from ..functions.time import parse_time

    if text:
        return parse_time(text)
    value = nsecs if nsecs is not None else (secs or 0) * NANOS
    if not 0 <= value < 1 << 64:
        raise LogError("time out of range")
    return value


def time_range(messages: DataFrame, start: int | None = None, end: int | None = None, column: str = "log_time", inclusive: bool = False) -> DataFrame:
    """``start <= log_time < end``, or ``<= end`` where ``inclusive`` asks for it."""
    if start:
        messages = messages.where(F.col(column) >= F.lit(start))
    if end is not None:
        messages = messages.where(F.col(column) <= F.lit(end) if inclusive else F.col(column) < F.lit(end))
    return messages


def topics_in(messages: DataFrame, topics: Iterable[str] | None) -> DataFrame:
    """Exact set membership.  None is no filter, an empty set selects nothing."""
    return messages if topics is None else messages.where(F.col("topic").isin(*topics) if (topics := list(topics)) else F.lit(False))


def _any_match(column: Column, patterns: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        re.compile(p)  # reports a bad pattern on the driver
        out = out | column.rlike(f"^(?:{p})$")
    return out


def topics_matching(messages: DataFrame, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Any include pattern matches the whole topic, or no exclude pattern does; not both kinds at once."""
    include, exclude = list(include), list(exclude)
    if include and exclude:
        raise LogError("include and exclude patterns can't be combined")
    if include:
        return messages.where(_any_match(F.col("topic"), include))
    return messages.where(~_any_match(F.col("topic"), exclude)) if exclude else messages


def topics_where(messages: DataFrame, channels: DataFrame, predicate: Callable[[str], bool]) -> DataFrame:
    """An arbitrary Python predicate, run over the channels (65,535 a file at most) and never over messages."""
    keep = F.udf(predicate, "boolean")
    chosen = channels.select("topic").distinct().where(keep("topic"))
    return messages.join(chosen, "topic", "left_semi")  # Spark broadcasts it by its size


def semi_channels(channels: DataFrame, topics: Iterable[str]) -> DataFrame:
    """Ids of the channels of some topics."""
    return channels.where(F.col("topic").isin(*topics)).select("file", F.col("id").alias("channel_id"))


def chunks_in_range(chunks: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Chunks that may hold a message of the half-open range."""
    if start:
        chunks = chunks.where(F.col("end_time") >= F.lit(start))
    return chunks if end is None else chunks.where(F.col("start_time") < F.lit(end))


def chunks_with_channels(chunks: DataFrame, ids: Iterable[int]) -> DataFrame:
    """Chunks whose index has one of the channels; a chunk without an index can't be left out."""
    wanted = F.array(*[F.lit(int(i)) for i in ids]) if (ids := list(ids)) else F.expr("array()").cast("array<int>")
    keys = F.map_keys("message_index_offsets")
    return chunks.where((F.size(keys) == 0) | F.arrays_overlap(keys, wanted))


def attachments_where(attachments: DataFrame, name: str | None = None, media_type: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """By name, media type and log time, both ends included."""
    for column, value in (("name", name), ("media_type", media_type)):
        if value is not None:
            attachments = attachments.where(F.col(column) == value)
    return time_range(attachments, start, end, inclusive=True)


def metadata_where(metadata: DataFrame, name: str | None = None) -> DataFrame:
    return metadata if name is None else metadata.where(F.col("name") == name)


def crc_valid(data: str = "data", stored: str = "crc") -> Column:
    """A stored checksum of 0 means that there is none."""
    return (F.col(stored) == 0) | (F.crc32(F.col(data)) == F.col(stored))
