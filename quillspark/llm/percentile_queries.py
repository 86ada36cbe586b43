"""Queries of problem 3 on this project's tables, with the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.quantiles import exact_percentiles, histogram, merge_histograms, select_ranks
from quillspark.session import stored, table

PERCENTS = [5.0, 25.0, 50.0, 75.0, 95.0]


def mastery_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(interaction_id, day, concept_id, mastery) once per answer and concept; only masteries within 0..1."""
    i = table(spark, sf_dir, "interactions")
    v = i.select("interaction_id", F.to_date("ts").alias("day"), F.explode("post_mastery").alias("concept_id", "mastery")).filter("NOT isnan(mastery) AND mastery BETWEEN 0 AND 1")
    return v.groupBy("interaction_id", "concept_id").agg(F.max("mastery").alias("mastery"), F.min("day").alias("day"))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_percentiles(mastery_values(spark, sf_dir), "concept_id", F.col("mastery"), PERCENTS)
    return out.select("concept_id", F.col("percent").cast("int").alias("percent"), "n", F.round("lower", 6).alias("mastery"))


P3_PERCENTILES = """
WITH v AS (SELECT interaction_id, e.key AS concept_id, max(e.value) AS mastery
           FROM (SELECT interaction_id, unnest(map_entries(post_mastery)) AS e FROM interactions) t
           WHERE NOT isnan(e.value) AND e.value BETWEEN 0 AND 1 GROUP BY 1, 2),
r AS (SELECT concept_id, mastery, row_number() OVER (PARTITION BY concept_id ORDER BY mastery) AS rn, count(*) OVER (PARTITION BY concept_id) AS n FROM v),
p AS (SELECT unnest([5, 25, 50, 75, 95]) AS percent)
SELECT concept_id, CAST(percent AS INTEGER) AS percent, CAST(n AS BIGINT) AS n, round(mastery, 6) AS mastery
FROM r JOIN p ON rn = greatest(1, (percent * n + 99) // 100)
"""


def p3_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each day and concept, and of all days (day null) from the same daily summaries added up."""
    daily = stored(histogram(mastery_values(spark, sf_dir), ["day", "concept_id"], F.col("mastery"), bits=32))
    by_day = select_ranks(daily.select(F.struct("day", "concept_id").alias("g"), "key", "n"), "g", PERCENTS, digits=2)
    overall = select_ranks(merge_histograms(daily, ["concept_id"]), "concept_id", PERCENTS, digits=2)
    cols = [F.col("percent").cast("int").alias("percent"), "n", F.round((F.col("lower") + F.col("upper")) / 2, 4).alias("mastery")]
    return by_day.select(F.col("g.day").cast("string").alias("day"), F.col("g.concept_id").alias("concept_id"), *cols).unionByName(overall.select(F.lit(None).cast("string").alias("day"), "concept_id", *cols))


P3_DAILY = """
WITH v AS (SELECT interaction_id, e.key AS concept_id, max(e.value) AS mastery, CAST(min(d) AS VARCHAR) AS day
           FROM (SELECT interaction_id, CAST(ts AT TIME ZONE 'UTC' AS DATE) AS d, unnest(map_entries(post_mastery)) AS e FROM interactions) t
           WHERE NOT isnan(e.value) AND e.value BETWEEN 0 AND 1 GROUP BY 1, 2),
u AS (SELECT day, concept_id, mastery FROM v UNION ALL SELECT NULL, concept_id, mastery FROM v),
r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY day, concept_id) AS n FROM u WINDOW w AS (PARTITION BY day, concept_id ORDER BY mastery)),
p AS (SELECT unnest([5, 25, 50, 75, 95]) AS percent)
SELECT day, concept_id, CAST(percent AS INTEGER) AS percent, CAST(n AS BIGINT) AS n, round(mastery, 4) AS mastery
FROM r JOIN p ON rn = greatest(1, (percent * n + 99) // 100)
"""


def p3_combined_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily summaries of 32 leading bits, combined over all days; the bounds hold the exact percentile."""
    daily = stored(histogram(mastery_values(spark, sf_dir), ["day", "concept_id"], F.col("mastery"), bits=32))
    out = select_ranks(merge_histograms(daily, ["concept_id"]), "concept_id", PERCENTS, digits=2)
    return out.select("concept_id", F.col("percent").cast("int").alias("percent"), "n", F.round((F.col("lower") + F.col("upper")) / 2, 4).alias("mastery"))


P3_COMBINED_DAYS = P3_PERCENTILES.replace("round(mastery, 6)", "round(mastery, 4)")

QUERIES = {"p3_daily": p3_daily, "p3_percentiles": p3_percentiles, "p3_combined_days": p3_combined_days}
ORACLES = {"p3_daily": P3_DAILY, "p3_percentiles": P3_PERCENTILES, "p3_combined_days": P3_COMBINED_DAYS}
