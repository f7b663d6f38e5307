"""Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned by splitters that Spark samples from a bounded sort
key (the first characters of the normalised text, then its 64-bit hash), and
sorted inside each range by key and whole text, so that equal texts become
neighbours; a run ends where a text differs from its neighbour, byte for byte.
A text that holds more than a part of a range's rows, by a bounded sample, is
spread over further ranges by a salt; the one row of each salted run that stays
is then compared with its kin.

Texts are equal when identical after lower-casing A-Z.  Of equal texts the row
with the largest id stays (``keep="max"``) or that with the smallest.

Edge cases: a null text counts as empty; null ids sort below all others and
are only kept where a group has no other; repeated rows belong to one group,
and ``kept`` holds for each of those that bear the kept id; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Leading characters in the sort key: they only place a row, whole texts are compared.
KEY_CHARS = 64
#: Rows sampled, about, to find texts with many copies.
SAMPLE_ROWS = 1_000_000
#: A salted piece of a text holds this part of a range's rows at most, about; so PIECES times the number of ranges bounds the salts, and with them the hot texts.
PIECES = 4
#: Copies in the sample below which a text's share is not known well enough to matter: under a hundred-thousandth of all rows.
OFTEN = 8


def normalised(text: Column) -> Column:
    """Null as empty; A-Z lower-cased, nothing else."""
    text = F.coalesce(text, F.lit(""))
    # lower() is much faster than translate() and the same on ASCII
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def hot_texts(docs: DataFrame, text: Column, sample_rows: int, pieces: int, often: int) -> DataFrame:
    """``h, salts`` of the texts that fill more than one of ``pieces`` parts of a range: as many as there are parts at most."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, docs.count())
    share = min(1.0, sample_rows / n)
    sampled = docs if share == 1.0 else docs.sample(share, seed=3)
    counts = sampled.select(F.xxhash64(text).alias("h")).groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= often)
    return counts.select("h", F.ceil(F.col("c") * (pieces * ranges / (share * n))).alias("salts")).where("salts > 1")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "max", sample_rows: int = SAMPLE_ROWS, pieces: int = PIECES, often: int = OFTEN) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    best = F.max if keep == "max" else F.min
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("norm")).select("doc_id", "norm", F.xxhash64("norm").alias("h"))

    hot = written(hot_texts(docs, normalised(F.col(text)), sample_rows, pieces, often), "exact-hot")
    any_hot = bool(hot.head(1))
    # PIECES times the number of ranges bounds the rows of hot, at any size of the input: safe to broadcast.
    salted = rows.join(F.broadcast(hot), "h", "left") if any_hot else rows.withColumn("salts", F.lit(None).cast("long"))
    # By row, not by id: ids may repeat or be null.
    salted = salted.withColumn("row", F.monotonically_increasing_id())
    salted = salted.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("salts"))).cast("int"))

    key = ["k", "h", "salt"] if any_hot else ["k", "h"]
    ranged = salted.select("doc_id", "norm", "salts", F.substring("norm", 1, KEY_CHARS).alias("k"), "h", "salt").repartitionByRange(*key)
    # The ranges already hold each key whole: no further exchange for these windows.
    in_order = Window.partitionBy(*key).orderBy("norm", "doc_id")
    runs = ranged.withColumn("new", F.coalesce(F.lag("norm").over(in_order) != F.col("norm"), F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.select(
        "doc_id", "k", "h", "salt", "run", F.sha2("norm", 256).alias("text_sha256"),
        F.when(F.col("salts").isNotNull() & (F.col("new") == 1), F.col("norm")).alias("norm"),
    )
    run = Window.partitionBy(*key, "run")
    runs = runs.withColumns({"keep_id": best("doc_id").over(run), "group_size": F.count("*").over(run)})
    runs = written(runs, "exact-runs")
    done = runs.select("doc_id", "keep_id", "group_size", "text_sha256")

    if any_hot:
        # One row for each salt of a hot text: PIECES times the number of ranges at most.
        heads = runs.where(F.col("norm").isNotNull())
        same = heads.groupBy("h", "norm").agg(best("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
        heads = heads.join(same, ["h", "norm"]).select("k", "h", "salt", "run", "all_keep", "all_size")
        done = runs.join(heads, ["k", "h", "salt", "run"], "left").select(
            "doc_id", F.coalesce("all_keep", "keep_id").alias("keep_id"), F.coalesce("all_size", "group_size").alias("group_size"), "text_sha256"
        )
    return done.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
