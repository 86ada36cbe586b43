"""Graph repair, topics, evidence, validators and records, each with the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import records as R
from quillspark.functions import text as T
from quillspark.operators import graph, planning, retrieval
from quillspark.operators.hierarchy import ranges
from quillspark.plans.library import _QUESTIONS, STATES, query, states
from quillspark.plans.library_planning import ancestors, claims, newest
from quillspark.plans.library_text import _REACH, doc_links
from quillspark.session import stored, table

# ---------------------------------------------------------------- graph


@query(f"""WITH RECURSIVE {_REACH}, c AS (SELECT x.tree, x.a AS node, min(x.b) AS cycle_id FROM r x JOIN r y ON x.tree = y.tree AND x.a = y.b AND x.b = y.a GROUP BY 1, 2) SELECT tree, cycle_id, count(*) AS nodes, string_agg(node, ',' ORDER BY node) AS members FROM c GROUP BY 1, 2""")
def grf_07_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycles of each document's prerequisites, as lists of their nodes."""
    h = ranges(doc_links(spark, sf_dir).select(F.lit("p").alias("hierarchy"), "tree", F.col("source").alias("parent"), F.col("target").alias("child"))).filter("cycle_id IS NOT NULL")
    return h.groupBy("tree", "cycle_id").agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members"))


@query()
def grf_08_acyclic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links without broken, self- and repeated ones, and without the last link of each cycle met."""
    return graph.sanitised(doc_links(spark, sf_dir), table(spark, sf_dir, "concepts"))


@query(f"""WITH RECURSIVE {_REACH}, p AS (SELECT tree, a, b, tree IN (SELECT tree FROM r WHERE a = b) AS cyclic FROM l WHERE a <> b) SELECT tree, count(*) AS links, bool_or(cyclic) AS cyclic FROM p GROUP BY 1""")
def grf_10_checked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose links would close a cycle if added in order of their ends, by what has to be left out."""
    l = doc_links(spark, sf_dir).filter("source != target").select("tree", "source", "target").distinct()  # noqa: E741
    kept = graph.added_in_order(l)
    loops = doc_links(spark, sf_dir).filter("source = target").select("tree", F.lit(1).alias("self")).distinct()
    n = l.groupBy("tree").agg(F.count("*").alias("links")).join(kept.groupBy("tree").agg(F.count("*").alias("kept")), "tree", "left").join(loops, "tree", "left")
    return n.select("tree", "links", ((F.coalesce("kept", F.lit(0)) < F.col("links")) | F.col("self").isNotNull()).alias("cyclic"))


_CHAPTERS = f"{_QUESTIONS}, ch AS (SELECT DISTINCT chapter_id AS topic, unnest(concept_ids) AS concept_id FROM q WHERE chapter_id IS NOT NULL)"


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(spark, sf_dir).filter("chapter_id IS NOT NULL").select(F.col("chapter_id").alias("topic"), F.explode("concept_ids").alias("concept_id")).distinct()


@query(f"WITH {_CHAPTERS}, e AS (SELECT DISTINCT source_concept_id AS s, target_concept_id AS t FROM prerequisite_links) SELECT a.topic AS source, b.topic AS target, count(*) AS links FROM e JOIN ch a ON a.concept_id = e.s JOIN ch b ON b.concept_id = e.t WHERE a.topic <> b.topic GROUP BY 1, 2")
def grf_16_topic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between chapters, from the prerequisites between their concepts."""
    e = table(spark, sf_dir, "prerequisite_links").select(F.col("source_concept_id").alias("s"), F.col("target_concept_id").alias("t")).distinct()
    return graph.topic_links(e, chapters(spark, sf_dir))


@query(f"""WITH {_CHAPTERS}, t AS (SELECT DISTINCT q.document_id, chapter_id AS topic FROM q WHERE chapter_id IS NOT NULL AND q.document_id IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY topic) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n FROM t), k AS (SELECT *, least(3, greatest(1, n // 2)) AS m FROM o)
SELECT document_id, topic, CASE WHEN n > 4 THEN CAST(i // greatest(1, (n + m - 1) // m) + 1 AS INTEGER) ELSE CAST(i + 1 AS INTEGER) END AS module FROM k""")
def grf_17_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's chapters put together to at most three modules where there are more than four."""
    t = newest(spark, sf_dir).filter("chapter_id IS NOT NULL AND document_id IS NOT NULL").select("document_id", F.col("chapter_id").alias("topic")).distinct()
    return graph.modules(t, "document_id", "topic", above=4, least=1, most=3, per=2)


@query("""WITH c AS (SELECT concept_id, row_number() OVER (ORDER BY concept_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT concept_id FROM concepts) z) SELECT concept_id, CAST(floor(i / n::DOUBLE * 12) AS INTEGER) AS topic FROM c""")
def grf_21_assigned_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts spread in order over twelve topics."""
    return graph.spread(table(spark, sf_dir, "concepts").select("concept_id").distinct(), "concept_id", 12)


@query(f"""WITH RECURSIVE {_REACH}, n AS (SELECT tree, a AS node FROM l UNION SELECT tree, b FROM l), an AS (SELECT tree, b AS node, count(*) FILTER (a <> b) AS ancestors FROM r GROUP BY 1, 2), dp AS (SELECT tree, a AS node, string_agg(b, ',' ORDER BY b) AS dependents FROM l GROUP BY 1, 2)
SELECT n.tree, n.node, coalesce(an.ancestors, 0) AS ancestors, coalesce(dp.dependents, '') AS dependents FROM n LEFT JOIN an USING (tree, node) LEFT JOIN dp USING (tree, node)""")
def grf_20_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown around a concept: how much it rests on, and what depends on it at once."""
    l = doc_links(spark, sf_dir).select("tree", "source", "target").distinct()  # noqa: E741
    nodes = l.select("tree", F.explode(F.array("source", "target")).alias("node")).distinct()
    up = ancestors(spark, sf_dir).groupBy("tree", "node").agg(F.count("*").alias("ancestors"))
    down = l.groupBy("tree", F.col("source").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("target")), ",").alias("dependents"))
    return nodes.join(up, ["tree", "node"], "left").join(down, ["tree", "node"], "left").fillna(0, ["ancestors"]).fillna("", ["dependents"])


@query(f"""WITH {STATES}, {_CHAPTERS.split("), ch AS")[0]}), ch AS (SELECT DISTINCT chapter_id AS topic, unnest(concept_ids) AS concept_id FROM q WHERE chapter_id IS NOT NULL), nm AS (SELECT concept_id, max(canonical_name) AS name FROM concepts GROUP BY 1),
g AS (SELECT topic, count(*) AS concepts, list(coalesce(nm.name, ch.concept_id) ORDER BY ch.concept_id) AS names FROM ch LEFT JOIN nm USING (concept_id) GROUP BY 1), m AS (SELECT topic, count(*) AS states, round(avg(mastery), 8) AS mastery FROM ch JOIN states USING (concept_id) GROUP BY 1)
SELECT g.topic, concepts, CASE WHEN concepts <= 3 THEN array_to_string(names, ' & ') ELSE names[1] || ' +' || (concepts - 1) || ' more' END AS label, coalesce(states, 0) AS states, mastery FROM g LEFT JOIN m USING (topic)""")
def agg_10_30_topic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters as topics: a label from their concepts, and the mean mastery of all who answered on them."""
    ch = stored(chapters(spark, sf_dir))
    nm = table(spark, sf_dir, "concepts").groupBy("concept_id").agg(F.max("canonical_name").alias("name"))
    g = ch.join(nm, "concept_id", "left").groupBy("topic").agg(F.count("*").alias("concepts"), F.transform(F.array_sort(F.collect_list(F.struct("concept_id", F.coalesce("name", "concept_id").alias("n")))), lambda x: x["n"]).alias("names"))
    m = states(spark, sf_dir).select("concept_id", "mastery").join(ch, "concept_id").groupBy("topic").agg(F.count("*").alias("states"), F.round(F.avg("mastery"), 8).alias("mastery"))
    n = F.col("concepts")
    label = F.when(n <= 3, F.array_join("names", " & ")).otherwise(F.concat(F.element_at("names", 1), F.lit(" +"), (n - 1).cast("string"), F.lit(" more")))
    return g.join(m, "topic", "left").fillna(0, ["states"]).select("topic", "concepts", label.alias("label"), "states", "mastery")


@query("""WITH d AS (SELECT DISTINCT document_id, target_concept_id AS concept_id, unnest(evidence_ids) AS evidence_id FROM prerequisite_links), c AS (SELECT document_id, unnest(evidence_ids) AS evidence_id, page, section_id FROM source_citations), t AS (SELECT document_id, section_id, max(title) AS title FROM sections GROUP BY 1, 2)
SELECT d.concept_id, d.document_id, d.evidence_id, min(c.page) AS page, min(t.title) AS section_title FROM d LEFT JOIN c ON c.document_id = d.document_id AND c.evidence_id = d.evidence_id LEFT JOIN t ON t.document_id = c.document_id AND t.section_id = c.section_id GROUP BY 1, 2, 3""")
def jn_02_evidence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page and section of the evidence each concept rests on."""
    d = table(spark, sf_dir, "prerequisite_links").select("document_id", F.col("target_concept_id").alias("concept_id"), F.explode("evidence_ids").alias("evidence_id")).distinct()
    c = table(spark, sf_dir, "source_citations").select("document_id", F.explode("evidence_ids").alias("evidence_id"), "page", "section_id")
    t = table(spark, sf_dir, "sections").groupBy("document_id", "section_id").agg(F.max("title").alias("title"))
    return d.join(c.join(t, ["document_id", "section_id"], "left"), ["document_id", "evidence_id"], "left").groupBy("concept_id", "document_id", "evidence_id").agg(F.min("page").alias("page"), F.min("title").alias("section_title"))


@query("""WITH d AS (SELECT document_id, target_concept_id AS concept_id, unnest(evidence_ids) AS evidence_id FROM prerequisite_links UNION SELECT document_id, source_concept_id, unnest(evidence_ids) FROM prerequisite_links) SELECT DISTINCT d.document_id, e.block_id, d.concept_id FROM d JOIN evidence e ON e.document_id = d.document_id AND e.evidence_id = d.evidence_id WHERE e.block_id IS NOT NULL""")
def jn_05_block_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and the concepts whose evidence stands in them, each pair once."""
    l = table(spark, sf_dir, "prerequisite_links")  # noqa: E741
    d = l.select("document_id", F.explode(F.array("source_concept_id", "target_concept_id")).alias("concept_id"), "evidence_ids").select("document_id", "concept_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    e = table(spark, sf_dir, "evidence").filter("block_id IS NOT NULL").select("document_id", "evidence_id", "block_id").distinct()
    return d.join(e, ["document_id", "evidence_id"]).select("document_id", "block_id", "concept_id").distinct()


@query("SELECT document_id, block_id, min(page) AS page FROM source_citations WHERE block_id IS NOT NULL GROUP BY 1, 2")
def jn_26_block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_citations").filter("block_id IS NOT NULL").groupBy("document_id", "block_id").agg(F.min("page").alias("page"))


# ---------------------------------------------------------------- validators

_BLOCK = "bk AS (SELECT document_id, block_id, arg_max(excerpt, (length(excerpt), excerpt)) AS text FROM evidence WHERE excerpt IS NOT NULL AND block_id IS NOT NULL GROUP BY 1, 2), ev AS (SELECT DISTINCT document_id, evidence_id, block_id, span_start, span_end, excerpt FROM evidence)"


def block_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest excerpt of each block stands for its text."""
    e = table(spark, sf_dir, "evidence").filter("excerpt IS NOT NULL AND block_id IS NOT NULL")
    return e.groupBy("document_id", "block_id").agg(F.max_by("excerpt", F.struct(F.length("excerpt"), "excerpt")).alias("text"))


_BAD_SPAN = "bk.text IS NOT NULL AND (span_start < 0 OR span_end > length(bk.text) OR span_start > span_end OR (excerpt <> '' AND NOT contains(bk.text, excerpt)))"


@query(f"""WITH {_BLOCK}, s AS (SELECT ev.document_id, count(*) AS records, count(*) FILTER ({_BAD_SPAN}) AS bad_spans FROM ev LEFT JOIN bk ON bk.document_id = ev.document_id AND bk.block_id = ev.block_id GROUP BY 1),
k AS (SELECT DISTINCT concept_id FROM concepts), l AS (SELECT document_id, count(*) FILTER (source_concept_id NOT IN (SELECT concept_id FROM k) OR target_concept_id NOT IN (SELECT concept_id FROM k)) AS broken_ends, count(*) FILTER (source_concept_id = target_concept_id) AS self_links FROM prerequisite_links GROUP BY 1)
SELECT coalesce(s.document_id, l.document_id) AS document_id, coalesce(records, 0) AS records, coalesce(bad_spans, 0) AS bad_spans, coalesce(broken_ends, 0) AS broken_ends, coalesce(self_links, 0) AS self_links, coalesce(bad_spans, 0) + coalesce(broken_ends, 0) + coalesce(self_links, 0) AS violations FROM s FULL OUTER JOIN l ON l.document_id = s.document_id""")
def qc_04_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard invariants by document: spans within their block, excerpts that stand in it, ends of links that exist."""
    e = table(spark, sf_dir, "evidence").select("document_id", "evidence_id", "block_id", "span_start", "span_end", "excerpt").distinct().join(block_texts(spark, sf_dir), ["document_id", "block_id"], "left")
    s = e.groupBy("document_id").agg(F.count("*").alias("records"), F.count_if(R.bad_span(F.col("text"), F.col("span_start"), F.col("span_end"), F.col("excerpt"))).alias("bad_spans"))
    k = table(spark, sf_dir, "concepts").select("concept_id").distinct()
    l = table(spark, sf_dir, "prerequisite_links").join(k.select(F.col("concept_id").alias("source_concept_id"), F.lit(1).alias("ks")), "source_concept_id", "left").join(k.select(F.col("concept_id").alias("target_concept_id"), F.lit(1).alias("kt")), "target_concept_id", "left")  # noqa: E741
    g = l.groupBy("document_id").agg(F.count_if(F.col("source_concept_id").isNotNull() & F.col("ks").isNull() | F.col("target_concept_id").isNotNull() & F.col("kt").isNull()).alias("broken_ends"), F.count_if(F.col("source_concept_id") == F.col("target_concept_id")).alias("self_links"))
    return s.join(g, "document_id", "full_outer").fillna(0).withColumn("violations", F.col("bad_spans") + F.col("broken_ends") + F.col("self_links"))


@query(f"""WITH {_BLOCK}, d AS (SELECT DISTINCT document_id, target_concept_id AS concept_id, unnest(evidence_ids) AS evidence_id FROM prerequisite_links), j AS (SELECT d.*, ev.evidence_id IS NULL AS missing, (ev.excerpt <> '' AND contains(bk.text, ev.excerpt)) OR (ev.span_start < length(bk.text) AND ev.span_end <= length(bk.text)) AS ok FROM d LEFT JOIN ev ON ev.document_id = d.document_id AND ev.evidence_id = d.evidence_id LEFT JOIN bk ON bk.document_id = ev.document_id AND bk.block_id = ev.block_id)
SELECT document_id, concept_id, count(DISTINCT evidence_id) AS evidence, count(DISTINCT evidence_id) FILTER (missing) AS missing, count(DISTINCT evidence_id) FILTER (ok) AS grounded, count(DISTINCT evidence_id) FILTER (ok) = 0 AS ungrounded FROM j GROUP BY 1, 2""")
def qc_05_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each concept's evidence, what is missing and what stands in the text it is taken from."""
    return _grounded(spark, sf_dir)


def _grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "prerequisite_links").select("document_id", F.col("target_concept_id").alias("concept_id"), F.explode("evidence_ids").alias("evidence_id")).distinct()
    e = table(spark, sf_dir, "evidence").select("document_id", "evidence_id", "block_id", "span_start", "span_end", "excerpt", F.lit(1).alias("there")).distinct()
    j = d.join(e.join(block_texts(spark, sf_dir), ["document_id", "block_id"], "left"), ["document_id", "evidence_id"], "left")
    n = F.length("text")
    ok = (F.col("excerpt") != "") & F.contains("text", F.col("excerpt")) | (F.col("span_start") < n) & (F.col("span_end") <= n)
    per = j.groupBy("document_id", "concept_id", "evidence_id").agg(F.max(F.col("there").isNull()).alias("missing"), F.max(F.coalesce(ok, F.lit(False))).alias("ok"))
    return per.groupBy("document_id", "concept_id").agg(F.count("*").alias("evidence"), F.count_if("missing").alias("missing"), F.count_if("ok").alias("grounded")).withColumn("ungrounded", F.col("grounded") == 0)


@query(f"""WITH RECURSIVE {_REACH}, {_BLOCK}, s AS (SELECT ev.document_id, count(*) FILTER ({_BAD_SPAN}) AS violations FROM ev LEFT JOIN bk ON bk.document_id = ev.document_id AND bk.block_id = ev.block_id GROUP BY 1), c AS (SELECT DISTINCT tree FROM r WHERE a = b)
SELECT s.document_id, violations, c.tree IS NOT NULL AS cyclic, CASE WHEN violations > 0 THEN 'failed' WHEN c.tree IS NOT NULL THEN 'warning' ELSE 'passed' END AS status FROM s LEFT JOIN c ON c.tree = s.document_id""")
def qc_06_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report a document: violations fail it, a cycle of prerequisites warns."""
    e = table(spark, sf_dir, "evidence").select("document_id", "evidence_id", "block_id", "span_start", "span_end", "excerpt").distinct().join(block_texts(spark, sf_dir), ["document_id", "block_id"], "left")
    s = e.groupBy("document_id").agg(F.count_if(R.bad_span(F.col("text"), F.col("span_start"), F.col("span_end"), F.col("excerpt"))).alias("violations"))
    c = ranges(doc_links(spark, sf_dir).select(F.lit("p").alias("hierarchy"), "tree", F.col("source").alias("parent"), F.col("target").alias("child"))).filter("cycle_id IS NOT NULL").select(F.col("tree").alias("document_id"), F.lit(True).alias("cyclic")).distinct()
    x = s.join(c, "document_id", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    return x.withColumn("status", F.when(F.col("violations") > 0, "failed").when(F.col("cyclic"), "warning").otherwise("passed"))


@query("""WITH k AS (SELECT DISTINCT concept_id FROM concepts), p AS (SELECT document_id, source_concept_id AS s, target_concept_id AS t, count(*) AS n FROM prerequisite_links GROUP BY 1, 2, 3)
SELECT document_id, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (s <> '' AND t <> '' AND s <> t) AS unique_edges, CAST(coalesce(sum(n) FILTER (coalesce(s, '') = '' OR coalesce(t, '') = ''), 0) AS BIGINT) AS empty_ends, CAST(coalesce(sum(n) FILTER (s = t AND s <> ''), 0) AS BIGINT) AS self_links,
CAST(coalesce(sum(n) FILTER (s <> '' AND t <> '' AND s <> t AND (s NOT IN (SELECT concept_id FROM k) OR t NOT IN (SELECT concept_id FROM k))), 0) AS BIGINT) AS dangling, CAST(coalesce(sum(n - 1) FILTER (s <> '' AND t <> '' AND s <> t), 0) AS BIGINT) AS repeated FROM p GROUP BY 1""")
def qc_08_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships with an empty end, to themselves, to nothing, or repeated, by document."""
    k = table(spark, sf_dir, "concepts").select("concept_id").distinct()
    p = table(spark, sf_dir, "prerequisite_links").groupBy("document_id", F.col("source_concept_id").alias("s"), F.col("target_concept_id").alias("t")).agg(F.count("*").alias("n"))
    p = p.join(k.select(F.col("concept_id").alias("s"), F.lit(1).alias("ks")), "s", "left").join(k.select(F.col("concept_id").alias("t"), F.lit(1).alias("kt")), "t", "left")
    blank = (F.coalesce("s", F.lit("")) == "") | (F.coalesce("t", F.lit("")) == "")
    own, n = ~blank & (F.col("s") == F.col("t")), F.col("n")
    good = ~blank & (F.col("s") != F.col("t"))
    total = lambda c, v=n: F.sum(F.when(c, v).otherwise(0))
    return p.groupBy("document_id").agg(F.sum("n").alias("total"), F.count_if(good).alias("unique_edges"), total(blank).alias("empty_ends"), total(own).alias("self_links"), total(good & (F.col("ks").isNull() | F.col("kt").isNull())).alias("dangling"), total(good, n - 1).alias("repeated"))


@query(f"""WITH {_QUESTIONS} SELECT question_id, array_to_string(list_filter([CASE WHEN length(trim(coalesce(question_text, ''))) < 5 THEN 'short_text' END, CASE WHEN question_type = 'mcq' AND coalesce(len(options), 0) < 2 THEN 'few_options' END, CASE WHEN question_type = 'mcq' AND len(options) >= 2 AND len(list_distinct(options)) < len(options) THEN 'repeated_options' END,
CASE WHEN question_type = 'mcq' AND coalesce(correct_answer, '') = '' THEN 'no_answer' END, CASE WHEN question_type = 'mcq' AND correct_answer <> '' AND len(options) > 0 AND NOT list_contains(options, correct_answer) AND NOT list_contains(list_transform(generate_series(0, len(options) - 1), lambda i: chr(CAST(65 + i AS INTEGER))), correct_answer) AND NOT list_contains(list_transform(generate_series(0, len(options) - 1), lambda i: CAST(i AS VARCHAR)), correct_answer) THEN 'answer_not_offered' END,
CASE WHEN question_type = 'true_false' AND NOT coalesce(lower(correct_answer) IN ('true', 'false', '1', '0', 't', 'f'), false) THEN 'no_boolean' END, CASE WHEN difficulty < 0 OR difficulty > 1 THEN 'difficulty_range' END], lambda x: x IS NOT NULL), ',') AS objections FROM q""")
def qc_10_question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a question that is to be served."""
    c = F.col
    why = R.question_objections(c("question_text"), c("question_type"), c("options"), c("correct_answer"), c("difficulty"))
    return newest(spark, sf_dir).select("question_id", F.array_join(why, ",").alias("objections"))


@query()
def qc_13_quiz_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification quizzes: questions, those twice in one, and those that touch nothing that was to be verified."""
    s = stored(states(spark, sf_dir))
    v, q = planning.to_verify(claims(s)), newest(spark, sf_dir)
    z = stored(planning.quizzes(v, q))
    c = z.join(q.select("question_id", F.explode("concept_ids").alias("concept_id")), "question_id").join(v.select("learner_id", "concept_id", F.lit(1).alias("wanted")), ["learner_id", "concept_id"], "left")
    per = c.groupBy("learner_id", "question_id").agg(F.max("wanted").alias("wanted"))
    return z.groupBy("learner_id").agg(F.count("*").alias("questions"), (F.count("*") - F.count_distinct("question_id")).alias("repeated")).join(per.groupBy("learner_id").agg(F.count_if(F.col("wanted").isNull()).alias("outside")), "learner_id")


@query("""WITH d AS (SELECT DISTINCT document_id FROM documents WHERE document_id IS NOT NULL AND length(trim(coalesce(text, ''))) > 0), u AS (SELECT document_id, count(DISTINCT section_id) AS units FROM sections GROUP BY 1), c AS (SELECT document_id, count(DISTINCT c) AS concepts FROM (SELECT document_id, unnest(concept_ids) AS c FROM documents) z GROUP BY 1), e AS (SELECT document_id, count(DISTINCT evidence_id) AS evidence FROM evidence GROUP BY 1)
SELECT document_id, coalesce(units, 0) AS units, coalesce(concepts, 0) AS concepts, coalesce(evidence, 0) AS evidence, coalesce(units, 0) > 0 AND coalesce(concepts, 0) > 0 AND coalesce(evidence, 0) > 0 AS usable FROM d LEFT JOIN u USING (document_id) LEFT JOIN c USING (document_id) LEFT JOIN e USING (document_id)""")
def prj_34_usable_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text, and whether they gave units, concepts and evidence."""
    d = table(spark, sf_dir, "documents")
    have = d.filter(F.col("document_id").isNotNull() & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)).select("document_id").distinct()
    u = table(spark, sf_dir, "sections").groupBy("document_id").agg(F.count_distinct("section_id").alias("units"))
    c = d.select("document_id", F.explode("concept_ids").alias("c")).groupBy("document_id").agg(F.count_distinct("c").alias("concepts"))
    e = table(spark, sf_dir, "evidence").groupBy("document_id").agg(F.count_distinct("evidence_id").alias("evidence"))
    x = have.join(u, "document_id", "left").join(c, "document_id", "left").join(e, "document_id", "left").fillna(0)
    return x.withColumn("usable", (F.col("units") > 0) & (F.col("concepts") > 0) & (F.col("evidence") > 0))


# ---------------------------------------------------------------- retrieval payloads


@query(r"""WITH e AS (SELECT DISTINCT document_id, evidence_id, block_id, excerpt FROM evidence WHERE excerpt IS NOT NULL), c AS (SELECT document_id, block_id, min(page) AS page FROM source_citations GROUP BY 1, 2), f AS (SELECT e.*, page, trim(regexp_replace(excerpt, '\s+', ' ', 'g')) AS t FROM e LEFT JOIN c USING (document_id, block_id))
SELECT document_id, evidence_id, CAST(page + 1 AS INTEGER) AS page_label, CASE WHEN length(t) <= 320 THEN t ELSE rtrim(left(t, 319)) || '…' END AS quote, least(1.0, 1.0 / greatest(1, len(list_filter(string_split_regex(regexp_replace(trim(excerpt), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''))))::DOUBLE AS coverage FROM f""")
def prj_48_agg_29_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload of a citation: page as printed, quote of 320 letters, and how much of it one record of evidence covers."""
    e = table(spark, sf_dir, "evidence").filter("excerpt IS NOT NULL").select("document_id", "evidence_id", "block_id", "excerpt").distinct()
    c = table(spark, sf_dir, "source_citations").groupBy("document_id", "block_id").agg(F.min("page").alias("page"))
    return e.join(c, ["document_id", "block_id"], "left").select("document_id", "evidence_id", (F.col("page") + 1).alias("page_label"), T.shorten(F.col("excerpt")).alias("quote"), R.coverage(F.lit(1), F.col("excerpt")).alias("coverage"))


@query("SELECT question_id, string_agg(block_id, ',' ORDER BY k, block_id) AS block_ids FROM (SELECT question_id, block_id, min(citation_id) AS k FROM source_citations WHERE question_id IS NOT NULL AND block_id IS NOT NULL GROUP BY 1, 2) z GROUP BY 1")
def set_11_distinct_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks a question cites, each once, in the order they are first cited."""
    c = table(spark, sf_dir, "source_citations").filter("question_id IS NOT NULL AND block_id IS NOT NULL").groupBy("question_id", "block_id").agg(F.min("citation_id").alias("k"))
    return c.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "block_id"))), lambda x: x["block_id"]), ",").alias("block_ids"))


@query("""WITH c AS (SELECT question_id, citation_id, any_value(page) AS page, any_value(trim(coalesce(quote, ''))) AS t FROM (SELECT DISTINCT question_id, citation_id, page, quote FROM source_citations WHERE question_id IS NOT NULL) z GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY citation_id) AS i FROM c), p AS (SELECT *, '[E' || i || '] page ' || (coalesce(page, 0) + 1) || chr(10) || t || chr(10) AS piece FROM o), s AS (SELECT *, sum(length(piece)) OVER (PARTITION BY question_id ORDER BY i) AS used FROM p)
SELECT question_id, string_agg(CASE WHEN i = 1 AND used > 600 THEN left(piece, 600) ELSE piece END, chr(10) ORDER BY i) AS prompt FROM s WHERE used <= 600 OR i = 1 GROUP BY 1""")
def str_15_evidence_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's citations as labelled evidence for a prompt, 600 letters at most."""
    c = table(spark, sf_dir, "source_citations").filter("question_id IS NOT NULL").select("question_id", "citation_id", "page", F.trim(F.coalesce("quote", F.lit(""))).alias("t")).distinct()
    per = c.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("citation_id", "page", "t"))).alias("e"))
    return per.select("question_id", R.evidence_prompt(F.col("e"), 600).alias("prompt"))


@query(f"""WITH {_QUESTIONS}, x AS (SELECT q.question_id, list_distinct(list_filter(regexp_extract_all(lower(q.question_text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 3)) AS qw, list_filter(string_split_regex(c.quote, '\\s+'), lambda w: w <> '') AS w, array_to_string(list_filter(string_split_regex(c.quote, '\\s+'), lambda w: w <> ''), ' ') AS flat
 FROM q JOIN (SELECT question_id, max(quote) AS quote FROM source_citations WHERE quote <> '' GROUP BY 1) c ON c.question_id = q.question_id WHERE q.question_text IS NOT NULL),
k AS (SELECT *, list_transform(range(1, greatest(2, len(w) - 20 + 2), 5), lambda i: array_to_string(w[i : i + 19], ' ')) AS wins FROM x), s AS (SELECT *, list_transform(wins, lambda t: len(list_intersect(qw, list_distinct(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'), lambda z: length(z) > 3))))) AS sc FROM k)
SELECT question_id, CASE WHEN length(flat) <= 120 THEN flat WHEN len(qw) = 0 THEN left(flat, 120) ELSE left(wins[list_position(sc, list_max(sc))], 120) END AS excerpt FROM s""")
def top_17_best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of twenty words of a question's quote that shares most words with the question; the first of equals."""
    c = table(spark, sf_dir, "source_citations").filter("quote != ''").groupBy("question_id").agg(F.max("quote").alias("quote"))
    q = newest(spark, sf_dir).filter("question_text IS NOT NULL").select("question_id", "question_text").join(c, "question_id")
    return q.select("question_id", R.best_passage(F.col("quote"), F.col("question_text"), 120).alias("excerpt"))


@query(r"""WITH e AS (SELECT document_id, block_id, string_agg(excerpt, chr(10) ORDER BY excerpt) AS t, list(excerpt ORDER BY excerpt) AS ex FROM (SELECT DISTINCT document_id, block_id, excerpt FROM evidence WHERE excerpt IS NOT NULL AND block_id IS NOT NULL) z GROUP BY 1, 2),
s AS (SELECT *, list_filter(list_transform(flatten(list_transform(ex, lambda x: string_split(replace(x, chr(10), ' '), '. '))), lambda x: rtrim(trim(x), '.')), lambda x: length(x) > 25 AND regexp_matches(lower(x), '^(a |an |the |is |are |refers to|is defined|is called|means |consists of)')) AS d, list_filter(list_transform(ex, lambda x: trim(x)), lambda x: length(x) > 40) AS f FROM e)
SELECT document_id, block_id, CASE WHEN len(d) > 0 THEN CASE WHEN length(d[1]) <= 300 THEN d[1] ELSE left(d[1], 299) || '…' END WHEN len(f) > 0 THEN CASE WHEN length(f[1]) <= 300 THEN f[1] ELSE left(f[1], 299) || '…' END ELSE '' END AS description FROM s""")
def prj_35_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence of the source that describes: one that defines, else the first longer excerpt; never more than 300 letters."""
    e = table(spark, sf_dir, "evidence").filter("excerpt IS NOT NULL AND block_id IS NOT NULL").select("document_id", "block_id", "excerpt").distinct()
    return e.groupBy("document_id", "block_id").agg(F.array_sort(F.collect_list("excerpt")).alias("x")).select("document_id", "block_id", R.description(F.col("x")).alias("description"))


@query("SELECT concept_id, array_to_string(list_distinct_ordered, ' | ') AS terms FROM (SELECT concept_id, list_sort(list_distinct(list_filter([canonical_name] || coalesce(aliases, []), lambda x: trim(coalesce(x, '')) <> ''))) AS list_distinct_ordered FROM concepts) z")
def prj_36_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and aliases of each concept, what it is searched by."""
    all_ = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return table(spark, sf_dir, "concepts").select("concept_id", F.array_join(F.array_sort(F.array_distinct(F.filter(all_, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))), " | ").alias("terms"))


@query()
def prj_37_38_concept_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three passages that tell most of each concept, by its name and aliases."""
    all_ = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    c = table(spark, sf_dir, "concepts").select("concept_id", F.array_join(all_, " ").alias("terms"))
    d = stored(retrieval.tokenised(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text")))
    return retrieval.bm25(d, stored(retrieval.tokenised(c, F.col("concept_id"), F.col("terms"))), k=3).select(F.col("query").alias("concept_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- records


@query(f"""WITH {_QUESTIONS} SELECT question_id, question_text AS prompt, array_to_string(CASE WHEN options IS NULL OR list_contains(options, 'I don''t know') THEN coalesce(options, []) ELSE options || ['I don''t know'] END, '|') AS options FROM q""")
def prj_17_18_39_client_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as learners see them: no answer, no explanation, and not knowing always among the options."""
    o = F.coalesce("options", F.array().cast("array<string>"))
    more = F.when(F.col("options").isNull() | F.array_contains("options", "I don't know"), o).otherwise(F.array_append(o, F.lit("I don't know")))
    return newest(spark, sf_dir).select("question_id", F.col("question_text").alias("prompt"), F.array_join(more, "|").alias("options"))


@query("""WITH s AS (SELECT learner_id, session_id, max(ts) AS last, count(DISTINCT question_id) AS answered FROM interactions WHERE learner_id IS NOT NULL AND session_id IS NOT NULL GROUP BY 1, 2) SELECT learner_id, arg_max(session_id, (last, session_id)) AS session_id, arg_max(answered, (last, session_id)) AS answered, arg_max(answered, (last, session_id)) < 25 AS active FROM s GROUP BY 1""")
def win_09_10_18_20_latest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's latest session, the place of the next question in it, and whether it is still open."""
    s = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND session_id IS NOT NULL").groupBy("learner_id", "session_id").agg(F.max("ts").alias("last"), F.count_distinct("question_id").alias("answered"))
    return s.groupBy("learner_id").agg(F.max_by(F.struct("session_id", "answered"), F.struct("last", "session_id")).alias("b")).select("learner_id", "b.session_id", "b.answered", (F.col("b.answered") < 25).alias("active"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY document_id, evidence_id ORDER BY coalesce(block_id, ''), coalesce(span_start, -1), coalesce(excerpt, ''), coalesce(source_confidence, -1)) AS k FROM evidence)
SELECT document_id, CASE WHEN k = 1 THEN evidence_id ELSE evidence_id || '_' || k END AS unique_id, k > 1 AS renamed FROM e""")
def win_19_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made unique within their document: the second and later ones get a number."""
    e = table(spark, sf_dir, "evidence")
    w = Window.partitionBy("document_id", "evidence_id").orderBy(F.coalesce("block_id", F.lit("")), F.coalesce("span_start", F.lit(-1)), F.coalesce("excerpt", F.lit("")), F.coalesce("source_confidence", F.lit(-1.0)))
    k = F.col("k")
    return e.withColumn("k", F.row_number().over(w)).select("document_id", F.when(k == 1, F.col("evidence_id")).otherwise(F.concat("evidence_id", F.lit("_"), k.cast("string"))).alias("unique_id"), (k > 1).alias("renamed"))


@query("""WITH h AS (SELECT document_id, section_id, min(coalesce(page_start, 0)) AS page, min(title) AS title FROM sections GROUP BY 1, 2) SELECT document_id, 'sec_' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY page, section_id) AS VARCHAR), 3, '0') AS outline_id, title FROM h""")
def src_40_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat outline of each document's headings."""
    h = table(spark, sf_dir, "sections").groupBy("document_id", "section_id").agg(F.min(F.coalesce("page_start", F.lit(0))).alias("page"), F.min("title").alias("title"))
    w = Window.partitionBy("document_id").orderBy("page", "section_id")
    return h.select("document_id", F.format_string("sec_%03d", F.row_number().over(w)).alias("outline_id"), "title")


@query(f"WITH {STATES} SELECT learner_id, concept_id, recent AS sequence FROM states WHERE length(recent) >= 3")
def src_42_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent answers long enough to calibrate on."""
    return states(spark, sf_dir).filter(F.length("recent") >= 3).select("learner_id", "concept_id", F.col("recent").alias("sequence"))


@query("""WITH d AS (SELECT document_id, count(*) AS passages, count(*) FILTER (trim(coalesce(text, '')) <> '') AS filled FROM documents WHERE document_id IS NOT NULL GROUP BY 1), e AS (SELECT document_id, count(DISTINCT evidence_id) AS evidence, count(DISTINCT block_id) AS blocks FROM evidence GROUP BY 1), p AS (SELECT document_id, count(DISTINCT c) AS concepts FROM (SELECT document_id, source_concept_id AS c FROM prerequisite_links UNION SELECT document_id, target_concept_id FROM prerequisite_links) z GROUP BY 1), g AS (SELECT document_id, max(page) AS pages FROM source_citations GROUP BY 1)
SELECT d.document_id, passages, coalesce(evidence, 0) AS evidence, coalesce(blocks, 0) AS blocks, coalesce(concepts, 0) AS concepts, pages, CASE WHEN filled = 0 THEN 'PROCESSING' WHEN evidence IS NULL OR concepts IS NULL THEN 'PARTIAL' ELSE 'READY' END AS status FROM d LEFT JOIN e USING (document_id) LEFT JOIN p USING (document_id) LEFT JOIN g USING (document_id)""")
def src_34_35_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials with what was made of them, and their state."""
    d = table(spark, sf_dir, "documents").filter("document_id IS NOT NULL").groupBy("document_id").agg(F.count("*").alias("passages"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("filled"))
    e = table(spark, sf_dir, "evidence").groupBy("document_id").agg(F.count_distinct("evidence_id").alias("evidence"), F.count_distinct("block_id").alias("blocks"))
    p = table(spark, sf_dir, "prerequisite_links").select("document_id", F.explode(F.array("source_concept_id", "target_concept_id")).alias("c")).groupBy("document_id").agg(F.count_distinct("c").alias("concepts"))
    g = table(spark, sf_dir, "source_citations").groupBy("document_id").agg(F.max("page").alias("pages"))
    x = d.join(e, "document_id", "left").join(p, "document_id", "left").join(g, "document_id", "left")
    status = F.when(F.col("filled") == 0, "PROCESSING").when(F.col("evidence").isNull() | F.col("concepts").isNull(), "PARTIAL").otherwise("READY")
    return x.select("document_id", "passages", F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("concepts", F.lit(0)).alias("concepts"), "pages", status.alias("status"))


@query("""WITH e AS (SELECT document_id, block_id, CAST(min(span_start) AS BIGINT) AS x0, CAST(max(span_end) AS BIGINT) AS x1, count(DISTINCT evidence_id) AS parts FROM evidence WHERE block_id IS NOT NULL AND span_start IS NOT NULL AND span_end IS NOT NULL GROUP BY 1, 2) SELECT * FROM e""")
def src_38_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent of all parts of a block together."""
    e = table(spark, sf_dir, "evidence").filter("block_id IS NOT NULL AND span_start IS NOT NULL AND span_end IS NOT NULL")
    return e.groupBy("document_id", "block_id").agg(F.min("span_start").cast("long").alias("x0"), F.max("span_end").cast("long").alias("x1"), F.count_distinct("evidence_id").alias("parts"))


@query(f"""WITH {_QUESTIONS}, r AS (SELECT question_id, 'Sure: ```json' || chr(10) || '{{"id": "' || question_id || '", "kind": "' || question_type || '"}}' || chr(10) || '```' AS reply FROM q WHERE question_type IS NOT NULL) SELECT question_id, CAST(length(reply) AS INTEGER) AS letters, question_id AS id, true AS valid FROM r""")
def arr_01_02_model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects taken out of replies around them, and checked against a template."""
    q = newest(spark, sf_dir).filter("question_type IS NOT NULL").select("question_id", F.concat(F.lit('Sure: ```json\n{"id": "'), "question_id", F.lit('", "kind": "'), "question_type", F.lit('"}\n```')).alias("reply"))
    o = R.json_object(F.col("reply"))
    return q.select("question_id", F.length("reply").alias("letters"), F.get_json_object(o, "$.id").alias("id"), (F.size(R.template_objections(o, {"id": "string", "kind": "string"})) == 0).alias("valid"))


@query("""SELECT interaction_id, strftime(min(ts) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at FROM interactions WHERE ts IS NOT NULL GROUP BY 1""")
def arr_07_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "interactions").filter("ts IS NOT NULL").groupBy("interaction_id").agg(F.min("ts").alias("ts"))
    return i.select("interaction_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@query("""SELECT document_id, 'skill_' || substr(sha256(document_id || '|apply|' || string_agg(c, ',' ORDER BY c)), 1, 12) AS skill_id, count(*) AS concepts FROM (SELECT DISTINCT document_id, unnest(concept_ids) AS c FROM questions WHERE document_id IS NOT NULL) z GROUP BY 1""")
def str_24_skill_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of skills from their sorted concepts."""
    c = table(spark, sf_dir, "questions").filter("document_id IS NOT NULL").select("document_id", F.explode("concept_ids").alias("c")).distinct()
    g = c.groupBy("document_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return g.select("document_id", T.stable_id(F.concat("document_id", F.lit("|apply|"), F.array_join("cs", ",")), "skill").alias("skill_id"), F.size("cs").cast("long").alias("concepts"))


@query("""SELECT document_id, coalesce(arg_min(title, (coalesce(page_start, 0), section_id)) FILTER (level = 1 AND trim(coalesce(title, '')) <> ''), document_id) AS title FROM sections GROUP BY 1""")
def str_25_document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first titled section of the first level, else the id."""
    s = table(spark, sf_dir, "sections")
    ok = (F.col("level") == 1) & (F.trim(F.coalesce("title", F.lit(""))) != "")
    return s.groupBy("document_id").agg(F.coalesce(F.min_by("title", F.when(ok, F.struct(F.coalesce("page_start", F.lit(0)).alias("p"), "section_id"))), F.col("document_id")).alias("title"))


