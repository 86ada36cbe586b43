"""Queries on the knowledge graph: trusted links, upstream weaknesses, orphans, section paths, concept checks, definitions, beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import cohort, resolve
from quillspark.operators.hierarchy import hierarchy
from quillspark.plans.library import STATES, query, states
from quillspark.plans.library_text import _REACH, doc_links
from quillspark.session import table

# Fixed pattern: a name in front of a defining verb.
DEFINES = r"([A-Z][a-z]+(?: [a-z]+){0,3}?) (?:is defined as|refers to|describes|denotes|means that)"


def _as_hierarchy(links: DataFrame, parent: str, child: str) -> DataFrame:
    return hierarchy(links.select(F.lit("p").alias("hierarchy"), "tree", F.col(parent).alias("parent"), F.col(child).alias("child")))


@query(f"""WITH RECURSIVE {_REACH}, c AS (SELECT x.tree, x.a AS node, min(x.b) AS cyc FROM r x JOIN r y ON x.tree = y.tree AND x.a = y.b AND x.b = y.a GROUP BY 1, 2),
g AS (SELECT document_id AS tree, source_concept_id AS source, target_concept_id AS target, list(coalesce(confidence, 0) ORDER BY coalesce(confidence, 0)) AS c, len(list_distinct(flatten(list(evidence_ids)))) AS evidence FROM prerequisite_links GROUP BY 1, 2, 3),
m AS (SELECT *, round(least(0.99::DOUBLE, 1.0::DOUBLE - list_reduce(list_prepend(1.0::DOUBLE, c), lambda a, x: a * (1.0::DOUBLE - x))), 6) AS confidence FROM g)
SELECT m.tree, m.source, m.target, coalesce(s.cyc = t.cyc, false) AS cyclic, m.confidence >= 0.7 AND m.evidence > 0 AND NOT coalesce(s.cyc = t.cyc, false) AS trusted FROM m LEFT JOIN c s ON s.tree = m.tree AND s.node = m.source LEFT JOIN c t ON t.tree = m.tree AND t.node = m.target""")
def grf_05_06_trusted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged links, those within one cycle marked, and the trusted ones: confident, with evidence, off cycles."""
    l = doc_links(spark, sf_dir)  # noqa: E741
    cyc = _as_hierarchy(l, "source", "target").filter("cycle_id IS NOT NULL").select("tree", "node", "cycle_id")
    m = resolve.edges_merged(l)
    m = m.join(cyc.select("tree", F.col("node").alias("source"), F.col("cycle_id").alias("cs")), ["tree", "source"], "left").join(cyc.select("tree", F.col("node").alias("target"), F.col("cycle_id").alias("ct")), ["tree", "target"], "left")
    cyclic = F.coalesce(F.col("cs") == F.col("ct"), F.lit(False))
    return m.select("tree", "source", "target", cyclic.alias("cyclic"), ((F.col("confidence") >= 0.7) & (F.col("evidence") > 0) & ~cyclic).alias("trusted"))


@query(f"""WITH RECURSIVE {STATES}, {_REACH} SELECT r.tree, s.learner_id, r.b AS concept_id, count(*) AS upstream, count(*) FILTER (coalesce(q.mastery, 0.3) < 0.5) AS weak FROM r JOIN states s ON s.concept_id = r.b AND s.mastery < 0.5 LEFT JOIN states q ON q.learner_id = s.learner_id AND q.concept_id = r.a GROUP BY 1, 2, 3""")
def grf_13_upstream_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each weak concept of a learner: how many concepts it rests on within a document, and how many of those are weak."""
    l = doc_links(spark, sf_dir)  # noqa: E741
    up = _as_hierarchy(l, "target", "source").select("tree", F.col("node").alias("concept_id"), F.col("descendants").alias("above"))
    return cohort.upstream_weak(states(spark, sf_dir), up)


@query("SELECT concept_id FROM concepts WHERE concept_id NOT IN (SELECT source_concept_id FROM prerequisite_links UNION SELECT target_concept_id FROM prerequisite_links)")
def set_05_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts at no end of any link."""
    l = doc_links(spark, sf_dir)  # noqa: E741
    ends = l.select(F.col("source").alias("concept_id")).unionByName(l.select(F.col("target").alias("concept_id")))
    return table(spark, sf_dir, "concepts").select("concept_id").distinct().join(ends, "concept_id", "left_anti")


@query("""WITH RECURSIVE l AS (SELECT DISTINCT document_id AS tree, section_id AS a, unnest(children) AS b FROM sections), t AS (SELECT document_id AS tree, section_id AS node, min(coalesce(nullif(trim(title), ''), section_id)) AS title FROM sections GROUP BY 1, 2),
n AS (SELECT tree, node FROM t UNION SELECT tree, a FROM l UNION SELECT tree, b FROM l WHERE b IS NOT NULL), h AS (SELECT tree, b AS node, min(a) AS parent FROM l WHERE b IS NOT NULL GROUP BY 1, 2),
p AS (SELECT n.tree, n.node, coalesce(t.title, n.node) AS path FROM n LEFT JOIN t USING (tree, node) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.tree = n.tree AND h.node = n.node)
 UNION ALL SELECT h.tree, h.node, p.path || ' > ' || coalesce(t.title, h.node) FROM p JOIN h ON h.tree = p.tree AND h.parent = p.node LEFT JOIN t ON t.tree = h.tree AND t.node = h.node),
r AS (SELECT tree, a, b FROM l WHERE b IS NOT NULL UNION SELECT r.tree, r.a, l.b FROM r JOIN l ON r.tree = l.tree AND r.b = l.a WHERE l.b IS NOT NULL), bad AS (SELECT tree, a AS node FROM r WHERE a = b UNION SELECT r.tree, r.b FROM r JOIN (SELECT tree, a FROM r WHERE a = b) c ON c.tree = r.tree AND c.a = r.a)
SELECT p.tree, p.node, p.path FROM p LEFT JOIN bad ON bad.tree = p.tree AND bad.node = p.node WHERE bad.node IS NULL""")
def win_15_section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from the root down to each section; a section without a title stands by its id."""
    s = table(spark, sf_dir, "sections").select(F.col("document_id").alias("tree"), "section_id", "title", "children")
    h = hierarchy(s.select(F.lit("s").alias("hierarchy"), "tree", F.col("section_id").alias("parent"), F.explode_outer("children").alias("child"))).filter("path IS NOT NULL")
    t = s.groupBy("tree", F.col("section_id").alias("step")).agg(F.min(F.coalesce(F.when(F.trim("title") != "", F.trim("title")), F.col("section_id"))).alias("title"))
    steps = h.select("tree", "node", F.posexplode("path").alias("k", "step")).join(t, ["tree", "step"], "left")
    named = steps.groupBy("tree", "node").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("title", "step").alias("t")))).alias("x"))
    return named.select("tree", "node", F.array_join(F.col("x.t"), " > ").alias("path"))


@query("""WITH n AS (SELECT lower(trim(canonical_name)) AS k, count(*) AS n FROM concepts GROUP BY 1) SELECT c.concept_id, array_to_string(list_filter([CASE WHEN trim(coalesce(c.canonical_name, '')) = '' THEN 'no_name' END, CASE WHEN n.n > 1 THEN 'shared_name' END, CASE WHEN coalesce(c.confidence, 0) < 0.7 THEN 'low_confidence' END, CASE WHEN trim(coalesce(c.description, '')) = '' THEN 'no_description' END], lambda v: v IS NOT NULL), ',') AS objections
FROM concepts c LEFT JOIN n ON n.k = lower(trim(c.canonical_name))""")
def qc_07_concept_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "concepts").select("concept_id", "canonical_name", "confidence", "description", F.lower(F.trim("canonical_name")).alias("key"))
    n = c.groupBy("key").agg(F.count("*").alias("shared"))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    why = F.array_compact(F.array(F.when(blank("canonical_name"), "no_name"), F.when(F.col("shared") > 1, "shared_name"), F.when(F.coalesce("confidence", F.lit(0.0)) < 0.7, "low_confidence"), F.when(blank("description"), "no_description")))
    return c.join(n, "key", "left").select("concept_id", F.array_join(why, ",").alias("objections"))
