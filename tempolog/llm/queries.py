"""The contract queries: each applies its operator to whole tables and derives the columns asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, langid, licenses, line_dedup, mixing, quality, simhash, token_output, warc
from .common import held_out, table

#: The tokenizer of the token-id output; its file is found at run time and never copied.
TOKENIZER = "word_bpe_49k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("places")


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_output.write(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return token_output.read_digests(files)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


#: One page in so many is damaged in the replica that op8 audits.
DAMAGED = 1009


def drill(page_id: int | None, data: bytes) -> bytes:
    """Flips a bit in the middle of every :data:`DAMAGED`-th page's record."""
    if page_id is None or page_id % DAMAGED != 7 or not data:
        return data
    k = len(data) // 2
    return data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :]


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drill: all pages as WARC, a replica with known damage, and for each record whether the audit finds it intact."""
    path, index = warc.write(table(spark, sf_dir, "pages"))
    wrong = warc.audit(index, path, warc.copy(path, index, drill)).select("file", "seq", F.lit(False).alias("intact"))  # none beyond the index in this drill
    return index.join(wrong, ["file", "seq"], "left").select("page_id", "seq", "offset", "length", F.coalesce("intact", F.lit(True)).alias("intact"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return clean.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("clean_chars"), F.sha2("text", 256).alias("clean_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_benchmark_leaks, op3_exact_dedup, op4_quality_mil, op5_token_ids, op6_source_mix, op7_language_id, op8_warc_fixity, op9_line_dedup, op10_simhash)
}

ORACLE_SQL = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        WINDOW g AS (PARTITION BY norm)
    """,
    "op9_line_dedup": """
        WITH lines AS (
            SELECT doc_id, coalesce(source, '-') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
            FROM documents
        ), wide AS (
            SELECT trim(line) AS line FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10
        ), clean AS (
            SELECT doc_id, count(*) AS n_lines, count(wide.line) AS n_removed, coalesce(string_agg(lines.line, chr(10) ORDER BY n) FILTER (wide.line IS NULL), '') AS kept
            FROM lines LEFT JOIN wide ON trim(lines.line) = wide.line GROUP BY doc_id
        )
        SELECT doc_id, n_lines, n_removed, length(kept) AS clean_chars, sha256(kept) AS clean_sha256 FROM clean
    """,
}
