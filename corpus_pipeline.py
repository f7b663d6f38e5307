"""Raw documents to token ids: five stages, each calling one operator of ``tempolog.llm``.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

Rows are told apart by id and text.  Edge cases, in every stage: a null text
counts as empty (the first stage scores it, near copies are one group, it holds
no test item, the mix never takes it as its size is 0); a null id comes after
all others among near copies and before them in the files, and is decided as any
other; rows that repeat an id with other texts are decided one by one, equal
rows are one; an empty table gives an empty one; further columns pass through
unless the stages' own names (``__pipeline_..__``) clash with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempolog.llm import decontaminate, mixing, quality, simhash, token_output
from tempolog.llm.common import release, scratch, table, written

TOKENIZER = "word_bpe_49k.json"
#: Names that no input has.
SCORE, COPIES, TEXT, HASH, ID, ROW = (f"__pipeline_{x}__" for x in ("score", "copies", "text", "hash", "id", "row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, score_col=SCORE).where(F.col(SCORE) >= quality.THRESHOLD).drop(SCORE)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, of those with the smallest id (null last).

    Rows are told apart by id and text: rows of one id whose texts are not near copies all stay.
    """
    found = written(simhash.near_copies(docs), "near-components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_hash"))
    gone = found.where(~stays).select(F.col("doc_id").alias(ID), F.col("text_hash").alias(HASH)).distinct()
    keyed = docs.withColumn(TEXT, F.xxhash64(F.coalesce("text", F.lit(""))))
    # The list grows with the documents: the same join at every size, never a broadcast that fits only small inputs.
    kept = keyed.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(ID)) & (F.col(TEXT) == F.col(HASH)), "left_anti")
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").head(1):
        # Repeated rows of one id and text: the first of them in order of the other columns stays.
        kept = kept.groupBy("doc_id", TEXT).agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias(ROW)).select("doc_id", f"{ROW}.*")
    return kept.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or what few edits make of it, go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice; rows equal in id and text as often as the most taken of them."""
    keyed = docs.withColumn(TEXT, F.xxhash64("text"))
    copies = mixing.mix(keyed, key=TEXT).where("copies > 0").groupBy(F.col("doc_id").alias(ID), F.col("key").alias(HASH)).agg(F.max("copies").cast("int").alias(COPIES))
    taken = keyed.join(copies, F.col("doc_id").eqNullSafe(F.col(ID)) & (F.col(TEXT) == F.col(HASH)))
    return taken.withColumn(COPIES, F.explode(F.sequence(F.lit(1), F.col(COPIES)))).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files; one row for each document taken, repeats included, from the files."""
    return token_output.read_digests(token_output.write(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("source mix", mix_sources),
    ("token ids", write_tokens),
]

#: Learned scores, edit distances and tokens are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # a stage's own tables go once its result is written
            before, docs = docs, keep(written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-")))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
