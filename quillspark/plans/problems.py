"""Queries of the core problems (4 to 6) on this project's tables, with the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.features import feature_table
from quillspark.operators.hierarchy import hierarchy, ranges
from quillspark.operators.sessions import sessionize
from quillspark.session import table


def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pre = table(spark, sf_dir, "prerequisite_links").select(F.lit("prerequisite").alias("hierarchy"), F.col("document_id").alias("tree"), F.col("source_concept_id").alias("parent"), F.col("target_concept_id").alias("child"))
    sec = table(spark, sf_dir, "sections").select(F.lit("section").alias("hierarchy"), F.col("document_id").alias("tree"), F.col("section_id").alias("parent"), F.explode_outer("children").alias("child"))
    return pre.unionByName(sec)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ranges(all_links(spark, sf_dir))
    return h.filter("cycle_id IS NOT NULL").select("hierarchy", F.col("tree").alias("document_id"), F.col("node").alias("node_id"), "cycle_id")


_LINKS = """
l AS (SELECT DISTINCT 'prerequisite' AS hierarchy, document_id, source_concept_id AS a, target_concept_id AS b FROM prerequisite_links
      UNION SELECT DISTINCT 'section', document_id, section_id, unnest(children) FROM sections),
r AS (SELECT hierarchy, document_id, a, b FROM l UNION SELECT r.hierarchy, r.document_id, r.a, l.b FROM r JOIN l ON r.hierarchy = l.hierarchy AND r.document_id = l.document_id AND r.b = l.a)
"""
P4_FOUND = f"""
WITH RECURSIVE {_LINKS}
SELECT x.hierarchy, x.document_id, x.a AS node_id, min(x.b) AS cycle_id FROM r x JOIN r y ON x.hierarchy = y.hierarchy AND x.document_id = y.document_id AND x.a = y.b AND x.b = y.a GROUP BY 1, 2, 3
"""


def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node with path, depth, root and descendants, arrays joined with slashes."""
    h = hierarchy(all_links(spark, sf_dir))
    return h.select("hierarchy", F.col("tree").alias("document_id"), F.col("node").alias("node_id"), "state", "root", "depth", F.array_join("path", "/").alias("path"), F.size("descendants").cast("long").alias("n_descendants"), F.array_join(F.array_sort("descendants"), "/").alias("descendants"))


P4_NODES = f"""
WITH RECURSIVE {_LINKS},
nodes AS (SELECT hierarchy, document_id, a AS node_id FROM l WHERE a IS NOT NULL UNION SELECT hierarchy, document_id, b FROM l WHERE b IS NOT NULL
          UNION SELECT 'section', document_id, section_id FROM sections),
cyc AS (SELECT DISTINCT hierarchy, document_id, a AS node_id FROM r WHERE a = b),
bad AS (SELECT * FROM cyc UNION SELECT r.hierarchy, r.document_id, r.b FROM r JOIN cyc c ON r.hierarchy = c.hierarchy AND r.document_id = c.document_id AND r.a = c.node_id),
home AS (SELECT hierarchy, document_id, b AS node_id, min(a) AS parent FROM l WHERE b IS NOT NULL GROUP BY 1, 2, 3),
good AS (SELECT n.*, h.parent FROM nodes n LEFT JOIN home h USING (hierarchy, document_id, node_id) WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.hierarchy = n.hierarchy AND b.document_id = n.document_id AND b.node_id = n.node_id)),
t AS (SELECT hierarchy, document_id, node_id, node_id AS root, 0 AS depth, node_id AS path FROM good WHERE parent IS NULL
      UNION ALL SELECT g.hierarchy, g.document_id, g.node_id, t.root, t.depth + 1, t.path || '/' || g.node_id FROM good g JOIN t ON g.hierarchy = t.hierarchy AND g.document_id = t.document_id AND g.parent = t.node_id),
d AS (SELECT hierarchy, document_id, a AS node_id, count(b) AS n_descendants, string_agg(b, '/' ORDER BY b) AS descendants FROM r WHERE b IS NOT NULL GROUP BY 1, 2, 3)
SELECT n.hierarchy, n.document_id, n.node_id,
       CASE WHEN c.node_id IS NOT NULL THEN 'cycle' WHEN t.node_id IS NOT NULL THEN 'rooted' ELSE 'below_cycle' END AS state,
       t.root, CAST(t.depth AS INTEGER) AS depth, coalesce(t.path, NULL) AS path, CAST(coalesce(d.n_descendants, 0) AS BIGINT) AS n_descendants, coalesce(d.descendants, '') AS descendants
FROM nodes n LEFT JOIN cyc c USING (hierarchy, document_id, node_id) LEFT JOIN t USING (hierarchy, document_id, node_id) LEFT JOIN d USING (hierarchy, document_id, node_id)
"""


def outcome_types() -> Column:
    """array of concept|outcome, the event types of an answer."""
    c = F.col("correctness")
    outcome = F.when(c.isNull() | F.isnan(c), "unmarked").when(c >= 1.0, "right").when(c <= 0.0, "wrong").otherwise("partial")
    return F.transform("concept_ids", lambda x: F.concat_ws("|", x, outcome))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "interactions")
    return feature_table(i, F.col("learner_id"), outcome_types(), F.col("interaction_id"), F.col("ts"), F.col("time_taken_seconds"), F.col("score"))


def p5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per learner; recency counts back from the latest answer of the whole table."""
    as_of = table(spark, sf_dir, "interactions").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    f = _features(spark, sf_dir)
    return f.select(
        F.col("entity").alias("learner_id"),
        "events",
        "kinds",
        ((F.lit(as_of) - F.col("last_us")) / 1e6).alias("recency_seconds"),
        F.transform_values("features", lambda k, v: F.struct(v["n"].alias("n"), ((F.lit(as_of) - v["last_us"]) / 1e6).alias("recency_seconds"), v["seconds"].alias("seconds"), v["score"].alias("score"))).alias("features"),
    )


def p5_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide rows taken apart again, for the comparison with SQL."""
    f = _features(spark, sf_dir).select("entity", F.explode("features").alias("type", "v"))
    return f.select(F.col("entity").alias("learner_id"), F.col("type").alias("event_type"), F.col("v.n").alias("n"), F.col("v.last_us").alias("last_us"), F.round("v.seconds", 2).alias("seconds"), F.round("v.score", 4).alias("score"))


P5_BY_TYPE = """
WITH e AS (SELECT DISTINCT learner_id, interaction_id, unnest(list_distinct(concept_ids)) || '|' || CASE WHEN correctness IS NULL OR isnan(correctness) THEN 'unmarked' WHEN correctness >= 1 THEN 'right' WHEN correctness <= 0 THEN 'wrong' ELSE 'partial' END AS event_type,
                  epoch_us(ts) AS us, greatest(coalesce(time_taken_seconds, 0), 0) AS s, greatest(coalesce(score, 0), 0) AS score FROM interactions WHERE learner_id IS NOT NULL)
SELECT learner_id, event_type, CAST(count(*) AS BIGINT) AS n, CAST(max(us) AS BIGINT) AS last_us, round(sum(s), 2) AS seconds, round(sum(score), 4) AS score FROM e GROUP BY 1, 2
"""


def _sittings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "interactions")
    return sessionize(i, F.col("learner_id"), F.col("interaction_id"), F.col("ts"), F.col("time_taken_seconds"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sittings(spark, sf_dir).select(F.col("entity").alias("learner_id"), F.col("first_id").alias("first_interaction_id"), F.col("last_id").alias("last_interaction_id"))


_SITTINGS = """
WITH i AS (SELECT DISTINCT learner_id, interaction_id, epoch_us(ts) AS at_us, CAST(round(greatest(coalesce(time_taken_seconds, 0), 0) * 1000000) AS BIGINT) AS dur FROM interactions WHERE learner_id IS NOT NULL),
g AS (SELECT *, CASE WHEN at_us - dur - lag(at_us) OVER w > 1800000000 THEN 1 ELSE 0 END AS new FROM i WINDOW w AS (PARTITION BY learner_id ORDER BY at_us, interaction_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY learner_id ORDER BY at_us, interaction_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
"""
P6_FOUND = f"{_SITTINGS} SELECT learner_id, arg_min(interaction_id, (at_us, interaction_id)) AS first_interaction_id, arg_max(interaction_id, (at_us, interaction_id)) AS last_interaction_id FROM s GROUP BY learner_id, no"


def p6_sittings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sittings(spark, sf_dir)
    return s.select(F.col("entity").alias("learner_id"), F.col("first_id").alias("first_interaction_id"), F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), F.round("duration_seconds", 3).alias("duration_seconds"), F.round("active_seconds", 3).alias("active_seconds"), "answers")


P6_SITTINGS = f"{_SITTINGS} SELECT learner_id, arg_min(interaction_id, (at_us, interaction_id)) AS first_interaction_id, CAST(min(at_us - dur) AS BIGINT) AS start_us, CAST(max(at_us) AS BIGINT) AS end_us, round((max(at_us) - min(at_us - dur)) / 1000000.0, 3)::DOUBLE AS duration_seconds, round(sum(dur) / 1000000.0, 3)::DOUBLE AS active_seconds, CAST(count(*) AS BIGINT) AS answers FROM s GROUP BY learner_id, no"

QUERIES = {"p4_found": p4_found, "p4_nodes": p4_nodes, "p5_features": p5_features, "p5_by_type": p5_by_type, "p6_found": p6_found, "p6_sittings": p6_sittings}
ORACLES = {"p4_found": P4_FOUND, "p4_nodes": P4_NODES, "p5_by_type": P5_BY_TYPE, "p6_found": P6_FOUND, "p6_sittings": P6_SITTINGS}
