"""Queries of the text problems and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import percentile_queries
from quillspark.llm.broken_pairs import broken_pairs
from quillspark.llm.leakage import decontaminate, leaks
from quillspark.llm.mixing import Mixture
from quillspark.llm.near_dup import NearDuplicates
from quillspark.llm.reading_level import reading_levels
from quillspark.llm.scan_noise import scan_noise
from quillspark.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "questions"))


def scanned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, record_id, document_id, text): evidence excerpts and citation quotes, each record once."""
    e = table(spark, sf_dir, "evidence").select(F.lit("excerpt").alias("field"), F.concat_ws("/", "document_id", "evidence_id").alias("record_id"), "document_id", F.col("excerpt").alias("text"))
    c = table(spark, sf_dir, "source_citations").select(F.lit("quote").alias("field"), F.col("citation_id").alias("record_id"), "document_id", F.col("quote").alias("text"))
    return e.unionByName(c).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise(scanned_texts(spark, sf_dir), document="document_id").select("field", "record_id", F.explode("noise").alias("noise")).distinct()


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise(scanned_texts(spark, sf_dir), document="document_id").select("field", "record_id", "repaired", F.array_join("noise", ",").alias("noise"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = NearDuplicates(table(spark, sf_dir, "questions"), F.col("question_id"), F.col("question_text"))
    return near.id_pairs().select(F.col("id_a").alias("question_id_a"), F.col("id_b").alias("question_id_b"))


P7_FOUND = r"""
WITH q AS (SELECT DISTINCT question_id AS id, list_sort(list_distinct(regexp_extract_all(lower(question_text), '[\p{L}\p{N}]+'))) AS w FROM questions WHERE question_text IS NOT NULL)
SELECT DISTINCT a.id AS question_id_a, b.id AS question_id_b FROM q a JOIN q b ON a.id < b.id AND len(a.w) > 0 AND len(b.w) > 0 AND len(a.w) >= 0.75 * len(b.w) AND len(b.w) >= 0.75 * len(a.w)
WHERE len(list_intersect(a.w, b.w)) >= 0.75 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))
"""


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = NearDuplicates(table(spark, sf_dir, "questions"), F.col("question_id"), F.col("question_text"))
    return near.groups().withColumnRenamed("id", "question_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


P8_FOUND = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
gi AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 12) x),
gd AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 12) x)
SELECT DISTINCT doc_id, item_id FROM gd JOIN gi USING (g)
"""


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    """Of the vocabulary file that the session's quillspark.tokenizer names."""
    vocabulary = spark.conf.get("quillspark.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    return Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), tokenizer=vocabulary)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).mix


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same mix as p9_mix: the draw depends on the documents alone."""
    return _mixture(spark, sf_dir).report


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, graded = table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_samples")
    return reading_levels(docs, graded, F.col("doc_id"), F.col("text"), F.col("text"), F.col("reading_level"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).filter("n_words >= 80 AND reading_level IS NOT NULL").select("doc_id", "reading_level")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language, length and difficulty."""
    return _levels(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return percentile_queries.QUERIES | {"p1_found": p1_found, "p2_found": p2_found, "p2_repaired": p2_repaired, "p7_found": p7_found, "p7_groups": p7_groups, "p8_found": p8_found, "p8_clean": p8_clean, "p9_mix": p9_mix, "p9_report": p9_report, "p10_found": p10_found, "p10_levels": p10_levels}


def oracle_sql() -> dict[str, str]:
    return percentile_queries.ORACLES | {"p7_found": P7_FOUND, "p8_found": P8_FOUND}
