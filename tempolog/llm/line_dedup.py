"""Cross-site boilerplate lines by distinct-site spread, in DataFrame operations only.

A line is boilerplate when it stands on ``min_sites`` distinct sites or more.
HyperLogLog sketches of sites, one for each line hash, merge by aggregation:
every task sketches what it reads before anything is shuffled, so a line that
stands everywhere costs one sketch a task.  Lines whose estimate is within
``MARGIN`` of the threshold (over four standard errors of the sketch) get an exact
distinct count; the others are decided by the estimate.

Texts are never shuffled to be counted: only hashes of lines are.  Then each
text is joined with the places of its boilerplate lines, and loses these; what
lies between two places is copied in one piece, so long texts cost no more.

Edge cases: a null text counts as empty; lines are compared without the spaces
around them, and blank ones stay; a null site is a site of its own; ids may be
null or repeat, as rows are told apart by id and text; repeated rows are cleaned
alike; columns named ``n_lines`` or ``n_removed`` are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_SITES = 10
#: Share of the threshold around it where exact counts decide.
MARGIN = 0.1
#: Sketch of 2**12 slots: a standard error of 1.6 %, and far less for few sites.
LG_K = 12


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """64 bits of a line without the spaces around it."""
    return F.xxhash64(F.trim(line))


def _hashed(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """``id, th, site, n, h, h2``: hash of the text; place and hashes (96 bits) of the lines that are not blank."""
    site_ = F.when(F.col(site).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(site).cast("string")))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), site_.alias("site"), F.posexplode(lines_of(F.col(text))).alias("n", "line")).where(F.trim("line") != "")
    return rows.select("id", "th", "site", "n", line_key(F.col("line")).alias("h"), F.hash(F.trim("line")).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """``h, h2`` of the lines on ``min_sites`` sites or more."""
    band = max(1.0, margin * min_sites)
    spread = lines.groupBy("h", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    spread = written(spread.where(F.col("sites") >= min_sites - band), "line-spread")
    near = spread.where(F.col("sites") <= min_sites + band).select("h", "h2")
    exact = lines.join(near, ["h", "h2"], "left_semi").groupBy("h", "h2").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    return spread.where(F.col("sites") > min_sites + band).select("h", "h2").unionByName(exact.select("h", "h2"))


def remove_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with cleaned texts and, as last columns, ``n_lines`` and ``n_removed``."""
    lines = written(_hashed(docs, doc_id, text, site), "lines")
    known = boilerplate(lines, min_sites)
    # The places in one text: no more than its lines.
    own = lines.join(known, ["h", "h2"]).groupBy("id", "th").agg(F.sort_array(F.collect_set("n")).alias("__line_dedup_at__")).select(F.col("id").alias("__line_dedup_id__"), F.col("th").alias("__line_dedup_th__"), "__line_dedup_at__")
    joined = docs.join(own, F.col(doc_id).eqNullSafe(F.col("__line_dedup_id__")) & (F.xxhash64(text) == F.col("__line_dedup_th__")), "left")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = joined.select(*[docs[c] for c in names if c != text], lines_of(docs[text]).alias("__line_dedup_all__"), "__line_dedup_at__")
    all_, at = F.col("__line_dedup_all__"), F.col("__line_dedup_at__")
    cuts = F.concat(F.array(F.lit(-1)), at, F.array(F.size(all_)))
    between = F.transform(F.sequence(F.lit(0), F.size(at)), lambda i: F.slice(F.col("__line_dedup_all__"), F.get("__line_dedup_cuts__", i) + 2, F.get("__line_dedup_cuts__", i + 1) - F.get("__line_dedup_cuts__", i) - 1))
    out = out.withColumn("__line_dedup_cuts__", cuts).withColumn("__line_dedup_kept__", F.when(at.isNull(), all_).otherwise(F.flatten(between)))
    return out.select(
        *[F.array_join("__line_dedup_kept__", "\n").alias(text) if c == text else F.col(f"`{c}`") for c in names],
        F.size(all_).cast("long").alias("n_lines"), (F.size(all_) - F.size("__line_dedup_kept__")).cast("long").alias("n_removed"),
    )
