"""Orders, ranks and running values over whole logs, without a one-task window.

Spark's window without a partition puts all rows in one task.  Here rows are
dealt into buckets by boundaries of the whole key (of a bounded sample of keys,
used as literals, so that every pass deals alike): a hot leading value is cut by
the keys that follow.  Windows run inside buckets, and what came before a bucket
is one row a bucket: a small table of sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FILE_ORDER, LOG_TIME_ORDER


def log_time(messages: DataFrame) -> DataFrame:
    return messages.orderBy(*LOG_TIME_ORDER)


def reverse_log_time(messages: DataFrame) -> DataFrame:
    return messages.orderBy(*[F.desc(c) for c in LOG_TIME_ORDER])


def file_order(messages: DataFrame) -> DataFrame:
    return messages.orderBy(*FILE_ORDER)


def topic_order(messages: DataFrame) -> DataFrame:
    return messages.orderBy("topic", "channel_id", *LOG_TIME_ORDER)


def seed_order(seeds: DataFrame) -> DataFrame:
    """Order of the messages that precede a window."""
    return seeds.orderBy("log_time", "channel_id", "sequence", "publish_time")


#: Keys sampled for each bucket.
SAMPLE_A_BUCKET = 20


def _literal(v: int | float | str) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{v!r}L" if isinstance(v, int) else f"{v!r}D"


def _below(keys: Sequence[str], cut: Sequence) -> str:
    """Whether a row's keys come before ``cut``, first key first."""
    out = "false"
    for k, c in reversed(list(zip(keys, map(_literal, cut)))):
        out = f"(`{k}` < {c} OR (`{k}` = {c} AND {out}))"
    return out


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int | None = None, name: str = "_b") -> DataFrame:
    """``df`` with ``name``: which range of ``keys`` (numbers or texts, not null) a row is in, the least first.

    Rows equal in all keys share a bucket; so the keys should tell rows apart.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The keys of least hash: a bounded sample, the same in every run.
    sample = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(SAMPLE_A_BUCKET * n).collect() if n > 1 else []
    rows = sorted(set(map(tuple, sample)))
    cuts = sorted({rows[len(rows) * i // n] for i in range(1, n)}) if rows else []

    def place(lo: int, hi: int) -> str:  # a tree of comparisons: as deep as the logarithm of the buckets
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"IF({_below(keys, cuts[mid])}, {place(lo, mid)}, {place(mid + 1, hi)})"

    return df.withColumn(name, F.expr(place(0, len(cuts))))


def global_rank(df: DataFrame, keys: Sequence[str], descending: bool = False, name: str = "rank", buckets: int | None = None) -> DataFrame:
    """1-based row number over ``keys``, which should be a total order."""
    dealt = bucketed(df, keys, buckets)
    counts = dealt.groupBy("_b").agg(F.count("*").alias("_n"))  # one row a bucket
    order = [F.desc(k) if descending else F.asc(k) for k in keys]
    far = Window.orderBy(F.desc("_b") if descending else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(far), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return ranked.join(F.broadcast(before), F.col("_b") == F.col("_c")).withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_c", "_r", "_before")


def running_max_before(df: DataFrame, keys: Sequence[str], value: str, name: str = "max_before", buckets: int | None = None, by: str | None = None) -> DataFrame:
    """The greatest ``value`` of all rows that precede in the order of ``keys``; null for the first.

    ``by``: a column of which each value has an order of its own (a log's file); a file may span buckets, and a bucket files.
    """
    group = [by] if by else []
    dealt = bucketed(df, [*group, *keys], buckets)
    inside = F.max(value).over(Window.partitionBy("_b", *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    tops = dealt.groupBy("_b", *group).agg(F.max(value).alias("_m"))  # one row a bucket and file
    far = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(F.col("_b").alias("_c"), *[F.col(g).alias("_g") for g in group], F.max("_m").over(far).alias("_before")).where(F.col("_before").isNotNull())
    same = F.col("_b") == F.col("_c")
    if by:
        same &= F.col(by).eqNullSafe(F.col("_g"))
    out = dealt.withColumn("_in", inside).join(before, same, "left")
    return out.withColumn(name, F.greatest("_in", "_before")).drop("_b", "_c", "_g", "_in", "_before")


def sequence_in_channel(messages: DataFrame, keys: Sequence[str] = ("log_time", "msg_offset")) -> DataFrame:
    """0-based sequence within each channel."""
    return messages.withColumn("sequence", (F.row_number().over(Window.partitionBy("file", "channel_id").orderBy(*keys)) - 1).cast("long"))


def lag_in_file(messages: DataFrame) -> Column:
    """The log time of the message before, in file order within a chunk."""
    return F.lag("log_time").over(Window.partitionBy("file", "chunk_offset").orderBy("msg_offset"))
