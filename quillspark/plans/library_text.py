"""Queries of the text, graph, resolution, layout and streaming operators, with the SQL that must agree with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import graph, layout, resolve
from quillspark.operators.hierarchy import hierarchy
from quillspark.operators.tracing import calibration, misconceptions
from quillspark.plans.library import _BM25, _DOC_TOKENS, _QUESTIONS, ANSWERS, STATES, _quoted, answers, query
from quillspark.session import table, tables_dir
from quillspark.streaming import answers as S

# ---------------------------------------------------------------- strings


@query(f"WITH {_DOC_TOKENS}, c AS (SELECT id, t, count(*) AS n FROM dt GROUP BY 1, 2) SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS terms, string_agg(t, ' ' ORDER BY t) AS term_list FROM c GROUP BY 1")
def str_01_02_search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.search_tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return d.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("terms"), F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("term_list"))


_NUM = "CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.NUMERALS.items()) + " ELSE w END"
_KEY = rf"""array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(trim(s)), '[''’]s\b', '', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: w <> ''), lambda w: {_NUM}), ' ')"""
_FOLD = r"""CASE WHEN length(tail) <= 4 OR tail LIKE '%us' OR tail LIKE '%is' OR tail LIKE '%ss' OR NOT regexp_matches(tail, '^\p{L}+$') THEN k
 ELSE head || CASE WHEN tail LIKE '%ies' AND length(tail) > 5 THEN left(tail, length(tail) - 3) || 'y' WHEN (tail LIKE '%es' AND substr(tail, -3, 1) IN ('s', 'x', 'z')) OR tail LIKE '%ches' OR tail LIKE '%shes' THEN left(tail, length(tail) - 2)
  WHEN tail LIKE '%s' THEN left(tail, length(tail) - 1) ELSE tail END END"""
_NAMES = f"""n AS (SELECT DISTINCT concept_id, s FROM (SELECT concept_id, canonical_name AS s FROM concepts UNION ALL SELECT concept_id, unnest(aliases) FROM concepts) z WHERE s IS NOT NULL),
k AS (SELECT *, {_KEY} AS k FROM n), h AS (SELECT *, regexp_extract(k, '(\\S+)$', 1) AS tail FROM k), f AS (SELECT *, left(k, length(k) - length(tail)) AS head FROM h), e AS (SELECT concept_id, s, k, {_FOLD} AS folded FROM f)""".replace("\\\\S", "\\S")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "concepts")
    return c.select("concept_id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("s")).filter("s IS NOT NULL").distinct()


@query(rf"""WITH {_NAMES} SELECT concept_id, s, k AS entity_key, folded, 'concept_' || substr(sha256(s), 1, 12) AS stable_id, sha256(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]', '', 'g')) AS fingerprint,
trim(regexp_replace(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) AS matching_key, lower(regexp_replace(regexp_replace(regexp_replace(s, '\.[^.]*$', ''), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM e""")
def str_03_05_11_19_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir)
    k = T.entity_key(F.col("s"))
    return n.select("concept_id", "s", k.alias("entity_key"), T.fold_plural(k).alias("folded"), T.stable_id(F.col("s"), "concept").alias("stable_id"), T.fingerprint(F.col("s")).alias("fingerprint"), T.matching_key(F.col("s")).alias("matching_key"), T.slug(F.col("s")).alias("slug"))


@query(f"WITH {_NAMES}, c AS (SELECT folded AS entity_key, s AS surface, count(*) AS n FROM e GROUP BY 1, 2) SELECT entity_key, arg_min(surface, (-n, surface)) AS canonical, count(*) AS surfaces, CAST(sum(n) AS BIGINT) AS mentions FROM c WHERE entity_key <> '' GROUP BY 1")
def qc_01_set_12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept names and aliases as mentions, clustered by key."""
    m = names(spark, sf_dir).select(F.col("s").alias("surface"), F.lit(1).cast("long").alias("n"))
    return resolve.clusters(m)


_LINES = "l AS (SELECT doc_id, k AS line_no, ls[k] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL) z WHERE trim(ls[k]) <> '')"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "t").filter(F.trim("t") != "")


@query(rf"""WITH {_LINES}, x AS (SELECT *, trim(t) AS s, lower(trim(t)) AS lo FROM l)
SELECT doc_id, line_no, CASE WHEN starts_with(lo, 'definition') OR contains(lo, 'is defined as') OR contains(lo, 'refers to') THEN 'definition' WHEN starts_with(lo, 'example') OR contains(lo, 'for example') THEN 'example' WHEN starts_with(lo, 'theorem') THEN 'theorem'
 WHEN contains(lo, 'exercise') OR starts_with(lo, 'q') OR contains(lo, 'question') THEN 'exercise' WHEN contains(lo, 'objective') OR contains(lo, 'able to') THEN 'learning_objective' WHEN contains(lo, 'prerequisite') OR contains(lo, 'before studying') THEN 'prerequisite_statement' ELSE 'explanation' END AS role,
 CASE WHEN regexp_matches(s, '(\.{{3,}}|…)\s*\d+\s*$') OR regexp_matches(s, '(?i)^(contents|table of contents)$') THEN 'toc' WHEN regexp_matches(s, '^[A-Z][a-zA-Z0-9\s\-]{{2,30}}\s*[:\-—]\s+[A-Z]') AND length(s) < 250 THEN 'glossary_entry'
  WHEN regexp_matches(s, '^(\[\d+\]|\d+\.)\s+[A-Z][a-z]+,') OR regexp_matches(s, '(?i)^(references|bibliography)$') THEN 'bibliography' WHEN regexp_matches(s, '(?i)^(example|worked example)\s+\d+(\.\d+)*') THEN 'worked_example'
  WHEN regexp_matches(s, '(?i)^(exercise|problem|practice question)\s+\d+(\.\d+)*') THEN 'exercise' WHEN regexp_matches(s, '(?i)^(note|remember|key point|tip|warning):\s+') THEN 'sidebar' END AS tag,
 ({' OR '.join(f"contains(lower(t), '{h}')" for h in T.HEDGES)}) AS hedged,
 length(s) <= 200 AND len(regexp_extract_all(s, '\S+')) <= 14 AND NOT regexp_matches(s, '[.;,]$') AS title_like,
 CAST(greatest(1, floor(len(regexp_extract_all(t, '\S+')) * 1.3::DOUBLE)) AS INTEGER) AS tokens,
 CASE WHEN regexp_matches(t, '[ऀ-ॿ]') AND regexp_matches(t, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(t, '[ऀ-ॿ]') THEN 'hi' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS script
FROM x""")
def prj_08_14_20_24_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return lines(spark, sf_dir).select("doc_id", "line_no", T.text_role(t).alias("role"), T.structure_tag(t).alias("tag"), T.is_hedged(t).alias("hedged"), T.is_title_block(t).alias("title_like"), T.token_estimate(t).alias("tokens"), T.script(t).alias("script"))


@query(r"""WITH d AS (SELECT doc_id, text AS t, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(flat) <= 320 THEN flat ELSE rtrim(left(flat, 319)) || '…' END AS short_text, CASE WHEN length(t) > 0 THEN round(len(regexp_extract_all(t, '[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0B\x0C\x0E-\x1F]')) / length(t), 8) ELSE 0 END AS garbage,
 CAST((list_sum(list_transform(string_split(left(t, 0) || 'doc' || doc_id, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ascii(c) END)) % 900 + 100) AS INTEGER) AS label,
 array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(t), '[a-z]{3,}'), lambda x: x NOT IN (""" + _quoted(T.STOP_TOKENS) + r""")), lambda x: left(x, 5)))), ' ') AS stems FROM d""")
def str_09_20_21_prj_04_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = table(spark, sf_dir, "documents").filter("text IS NOT NULL"), F.col("text")
    return d.select("doc_id", T.shorten(t).alias("short_text"), F.round(T.garbage_ratio(t), 8).alias("garbage"), T.anonymous_number(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("label"), F.array_join(T.citation_stems(t), " ").alias("stems"))


@query(f"""WITH {_DOC_TOKENS}, o AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
g AS (SELECT id, n, array_to_string(w[k : k + n - 1], ' ') AS gram, w[k] AS a, w[k + n - 1] AS z FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM o CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) q WHERE len(w) >= n) y),
p AS (SELECT id, n, gram, count(*) AS c FROM g WHERE n = 1 OR (a NOT IN ({_quoted(T.STOP_TOKENS)}) AND z NOT IN ({_quoted(T.STOP_TOKENS)})) GROUP BY 1, 2, 3)
SELECT CAST(n AS INTEGER) AS n, gram, CAST(sum(c) AS BIGINT) AS occurrences, count(*) AS documents FROM p GROUP BY 1, 2""".replace("\\\\p", "\\p"))
def agg_20_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word grams of one to three words, how often and in how many documents."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("tokens"))
    return resolve.ngram_counts(d, T.STOP_TOKENS)


# ---------------------------------------------------------------- evidence, questions, quality


@query("""WITH c AS (SELECT DISTINCT citation_id, document_id, unnest(evidence_ids) AS evidence_id, trim(coalesce(quote, '')) AS quote FROM source_citations),
e AS (SELECT document_id, evidence_id, max(excerpt) AS excerpt FROM evidence GROUP BY 1, 2)
SELECT c.citation_id, count(*) AS cited, count(e.excerpt) AS known, count(*) FILTER (c.quote <> '' AND contains(e.excerpt, c.quote)) AS grounding FROM c LEFT JOIN e USING (document_id, evidence_id) GROUP BY 1""")
def jn_01_prj_19_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations joined to the evidence they name, and how many of the excerpts hold the quote."""
    c = table(spark, sf_dir, "source_citations").select("citation_id", "document_id", F.explode("evidence_ids").alias("evidence_id"), F.trim(F.coalesce("quote", F.lit(""))).alias("quote")).distinct()
    e = table(spark, sf_dir, "evidence").groupBy("document_id", "evidence_id").agg(F.max("excerpt").alias("excerpt"))
    return c.join(e, ["document_id", "evidence_id"], "left").groupBy("citation_id").agg(F.count("*").alias("cited"), F.count("excerpt").alias("known"), F.count_if((F.col("quote") != "") & F.contains("excerpt", F.col("quote"))).alias("grounding"))


@query(f"""WITH {_QUESTIONS}, c AS (SELECT question_id, count(*) AS n, min(page) AS page FROM source_citations WHERE page IS NOT NULL GROUP BY 1)
SELECT q.question_id, coalesce(c.n, 0) AS citations, c.page AS first_page, CASE WHEN coalesce(c.n, 0) = 0 THEN 'invalid' ELSE q.validation_status END AS served_status FROM q LEFT JOIN c USING (question_id)""")
def jn_16_src_24_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their citations on known pages; those without any are not to be served."""
    q = resolve.latest(table(spark, sf_dir, "questions"), ["question_id"], ["exposure_count", "created_at"]).select("question_id", "validation_status")
    c = table(spark, sf_dir, "source_citations").filter("page IS NOT NULL").groupBy("question_id").agg(F.count("*").alias("n"), F.min("page").alias("page"))
    n = F.coalesce("n", F.lit(0))
    return q.join(c, "question_id", "left").select("question_id", n.alias("citations"), F.col("page").alias("first_page"), F.when(n == 0, "invalid").otherwise(F.col("validation_status")).alias("served_status"))


@query(r"""WITH g AS (SELECT question_id, arg_max(struct_pack(k := question_type, t := question_text, o := options, a := correct_answer, c := concept_ids), (exposure_count, created_at)) AS q FROM questions GROUP BY 1),
x AS (SELECT question_id, q.k AS k, coalesce(q.t, '') AS t, coalesce(q.o, []) AS o, q.a AS a, coalesce(q.c, []) AS c FROM g),
u AS (SELECT DISTINCT question_id FROM (SELECT question_id, unnest(c) AS c FROM x) z WHERE c NOT IN (SELECT concept_id FROM concepts WHERE coalesce(status, '') <> 'rejected')),
s AS (SELECT DISTINCT question_id FROM source_citations WHERE trim(coalesce(quote, '')) <> '')
SELECT x.question_id, array_to_string(list_filter([CASE WHEN len(list_distinct(list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+'), lambda w: length(w) > 3))) < 3 THEN 'short_text' END, CASE WHEN k = 'mcq' AND len(o) < 2 THEN 'few_options' END,
 CASE WHEN k = 'mcq' AND len(list_distinct(o)) < len(o) THEN 'repeated_options' END, CASE WHEN k = 'mcq' AND NOT coalesce(list_contains(o, a), false) THEN 'answer_not_an_option' END, CASE WHEN len(c) = 0 THEN 'no_concept' END,
 CASE WHEN u.question_id IS NOT NULL THEN 'unknown_concept' END, CASE WHEN s.question_id IS NULL THEN 'no_citation' END], lambda v: v IS NOT NULL), ',') AS objections
FROM x LEFT JOIN u ON u.question_id = x.question_id LEFT JOIN s ON s.question_id = x.question_id""")
def qc_09_question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.question_checks(table(spark, sf_dir, "questions"), table(spark, sf_dir, "concepts"), table(spark, sf_dir, "source_citations"))


@query(r"SELECT sha256(regexp_replace(lower(coalesce(question_text, '')), '[^\p{L}\p{N}]', '', 'g')) AS fingerprint, min(question_id) AS kept, count(DISTINCT question_id) AS copies FROM questions GROUP BY 1")
def set_07_08_question_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.first_by_fingerprint(table(spark, sf_dir, "questions"), "question_id", "question_text")


@query("""SELECT count(*) AS concepts, count(*) FILTER (status = 'active') AS active, count(*) FILTER (trim(coalesce(description, '')) <> '') AS described, count(*) FILTER (len(coalesce(aliases, [])) > 0) AS aliased, round(100.0::DOUBLE * count(*) FILTER (trim(coalesce(description, '')) <> '') / greatest(count(*), 1), 2) AS described_pct FROM concepts""")
def agg_17_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.completeness(table(spark, sf_dir, "concepts"))


@query(f"""WITH {_QUESTIONS}, v AS (SELECT unnest(list_distinct(concept_ids)) AS concept_id FROM q), n AS (SELECT concept_id, count(*) AS n FROM v GROUP BY 1), g AS (SELECT greatest(1, least(4, 400 // greatest(1, count(*)))) AS goal FROM concepts)
SELECT c.concept_id, coalesce(n.n, 0) AS questions, greatest(0, goal - coalesce(n.n, 0)) AS missing FROM concepts c LEFT JOIN n USING (concept_id) CROSS JOIN g""")
def agg_15_16_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions per concept, and how many are missing for a bank of 400."""
    q = resolve.latest(table(spark, sf_dir, "questions"), ["question_id"], ["exposure_count", "created_at"])
    n = q.select(F.explode(F.array_distinct("concept_ids")).alias("concept_id")).groupBy("concept_id").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "concepts").select("concept_id")
    goal = max(1, min(4, 400 // max(1, c.count())))
    have = F.coalesce("n", F.lit(0))
    return c.join(n, "concept_id", "left").select("concept_id", have.alias("questions"), F.greatest(F.lit(0), F.lit(goal) - have).cast("long").alias("missing"))


def doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prerequisite_links").select(F.col("document_id").alias("tree"), F.col("source_concept_id").alias("source"), F.col("target_concept_id").alias("target"), "confidence", "evidence_ids")


@query("""WITH g AS (SELECT document_id AS tree, source_concept_id AS source, target_concept_id AS target, list(coalesce(confidence, 0) ORDER BY coalesce(confidence, 0)) AS c, len(list_distinct(flatten(list(evidence_ids)))) AS evidence, count(*) AS repeats FROM prerequisite_links GROUP BY 1, 2, 3)
SELECT tree, source, target, round(least(0.99::DOUBLE, 1.0::DOUBLE - list_reduce(list_prepend(1.0::DOUBLE, c), lambda a, x: a * (1.0::DOUBLE - x))), 6) AS confidence, CAST(evidence AS BIGINT) AS evidence, repeats FROM g""")
def set_06_agg_23_merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.edges_merged(doc_links(spark, sf_dir))


# ---------------------------------------------------------------- graph


@query("SELECT DISTINCT document_id AS tree, source_concept_id AS node FROM prerequisite_links p WHERE NOT EXISTS (SELECT 1 FROM prerequisite_links x WHERE x.document_id = p.document_id AND x.target_concept_id = p.source_concept_id)")
def grf_01_foundations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.foundations(doc_links(spark, sf_dir))


@query("""WITH o AS (SELECT document_id AS tree, source_concept_id AS node, count(*) AS downstream, count(DISTINCT target_concept_id) AS dependents FROM prerequisite_links GROUP BY 1, 2), i AS (SELECT document_id AS tree, target_concept_id AS node, count(DISTINCT source_concept_id) AS prerequisites FROM prerequisite_links GROUP BY 1, 2)
SELECT tree, node, coalesce(downstream, 0) AS downstream, coalesce(dependents, 0) AS dependents, coalesce(prerequisites, 0) AS prerequisites FROM o FULL OUTER JOIN i USING (tree, node)""")
def grf_02_14_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(doc_links(spark, sf_dir))


_REACH = """l AS (SELECT DISTINCT document_id AS tree, source_concept_id AS a, target_concept_id AS b FROM prerequisite_links), r AS (SELECT tree, a, b FROM l UNION SELECT r.tree, r.a, l.b FROM r JOIN l ON r.tree = l.tree AND r.b = l.a)"""


@query(f"""WITH RECURSIVE {_REACH}, p AS (SELECT document_id AS tree, source_concept_id AS s, target_concept_id AS t, count(*) AS n FROM prerequisite_links GROUP BY 1, 2, 3), c AS (SELECT tree, count(*) AS k FROM (SELECT DISTINCT tree, a FROM r WHERE a = b) z GROUP BY 1)
SELECT p.tree, CAST(sum(n) AS BIGINT) AS links, CAST(sum(n - 1) AS BIGINT) AS repeated, count(*) FILTER (s = t) AS self_links, count(*) FILTER (s NOT IN (SELECT concept_id FROM concepts) OR t NOT IN (SELECT concept_id FROM concepts)) AS broken, coalesce(max(c.k), 0) AS on_cycles FROM p LEFT JOIN c ON c.tree = p.tree GROUP BY 1""")
def grf_07_09_11_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = doc_links(spark, sf_dir)  # noqa: E741
    cyc = hierarchy(l.select(F.lit("p").alias("hierarchy"), "tree", F.col("source").alias("parent"), F.col("target").alias("child"))).filter("cycle_id IS NOT NULL").select("tree", "node")
    return graph.validation(l, table(spark, sf_dir, "concepts"), cyc)


@query(f"WITH RECURSIVE {_REACH} SELECT tree, b AS node, count(*) AS ancestors, string_agg(a, ',' ORDER BY a) AS ancestor_ids FROM r GROUP BY 1, 2")
def grf_03_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prerequisites a node rests on: descendants of the reversed links."""
    h = hierarchy(doc_links(spark, sf_dir).select(F.lit("p").alias("hierarchy"), "tree", F.col("target").alias("parent"), F.col("source").alias("child")))
    return h.filter(F.size("descendants") > 0).select("tree", "node", F.size("descendants").cast("long").alias("ancestors"), F.array_join(F.array_sort("descendants"), ",").alias("ancestor_ids"))


@query(f"""WITH RECURSIVE {_REACH}, n AS (SELECT tree, a AS node FROM l UNION SELECT tree, b FROM l), bad AS (SELECT tree, a AS node FROM r WHERE a = b UNION SELECT r.tree, r.b FROM r JOIN (SELECT tree, a FROM r WHERE a = b) c ON c.tree = r.tree AND c.a = r.a)
SELECT n.tree, count(*) AS nodes, count(*) FILTER (bad.node IS NULL) AS ordered FROM n LEFT JOIN bad ON bad.tree = n.tree AND bad.node = n.node GROUP BY 1""")
def grf_04_order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes per document, and how many the prerequisite-first order reaches."""
    o = graph.topological_order(doc_links(spark, sf_dir))
    return o.groupBy("tree").agg(F.count("*").alias("nodes"), F.count_if("acyclic").alias("ordered"))


@query()
def grf_04_topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topological_order(doc_links(spark, sf_dir))


# ---------------------------------------------------------------- sections and chunks

_HEADS = "h AS (SELECT document_id, section_id, any_value(title ORDER BY coalesce(page_start, 0), coalesce(level, 0), coalesce(title, '')) AS title, min(least(6, greatest(1, coalesce(level, 1)))) AS level, min(coalesce(page_start, 0)) AS page FROM sections GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, section_id) AS position FROM h)"


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sections").groupBy("document_id", "section_id").agg(F.min(F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce("level", F.lit(1))))).alias("level"), F.min(F.coalesce("page_start", F.lit(0))).alias("page"))
    return s.withColumn("position", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "section_id")))


@query(f"WITH {_HEADS.replace('any_value(title ORDER BY coalesce(page_start, 0), coalesce(level, 0), coalesce(title, ' + chr(39) * 2 + '))', 'min(title)')} SELECT a.document_id, a.section_id, a.position, (SELECT arg_max(b.section_id, b.position) FROM o b WHERE b.document_id = a.document_id AND b.position < a.position AND b.level < a.level) AS parent_id FROM o a")
def win_14_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in page order, each below the nearest earlier one of a smaller level."""
    return layout.nest(headings(spark, sf_dir)).select("document_id", "section_id", F.col("position").cast("long").alias("position"), "parent_id")


@query()
def win_16_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as blocks, each four paragraphs a section, put together to chunks."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    p = d.select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n\n")).alias("para", "p"))
    b = p.select("document_id", F.concat(F.lit("s"), F.floor(F.col("para") / 4).cast("string")).alias("section_id"), "para", F.posexplode(F.split("p", "\n")).alias("k", "text"))
    b = b.withColumn("position", F.col("para") * F.lit(100_000) + F.col("k")).withColumn("is_heading", T.is_title_block(F.col("text")))
    return layout.chunks(b)


# ---------------------------------------------------------------- calibration, misconceptions


@query()
def agg_25_26_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-step-ahead error of 180 parameter sets."""
    a = answers(spark, sf_dir)
    c = calibration(a, F.col("learner_id"), F.col("concept_id"), F.col("interaction_id"), F.col("ts"), F.col("correctness"))
    return c.select("transit", "slip", "guess", "predictions", F.round("rmse", 8).alias("rmse"))


@query()
def win_07_08_misconceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong responses to one question as signs of one misconception; later right answers count against it."""
    i = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND correctness IS NOT NULL AND question_id IS NOT NULL")
    e = i.select("learner_id", F.concat(F.lit("misc_"), F.substring(F.sha2("question_id", 256), 1, 10)).alias("misconception_id"), F.col("ts").alias("at"), F.col("interaction_id").alias("event_id"), (F.col("correctness") < 0.5).alias("wrong"))
    return misconceptions(e)


# ---------------------------------------------------------------- streams driven over what is there


def _folder(spark: SparkSession) -> str:
    return f"{tables_dir(spark)}/stream-{uuid.uuid4().hex}"


def _arrivals(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The interactions as a stream of six files in order of delivery, one a trigger."""
    i = S.received(table(spark, sf_dir, "interactions")).select("interaction_id", "learner_id", "session_id", "concept_ids", "correctness", "score", "ts", "received").filter("received IS NOT NULL")
    return S.read_arrivals(spark, S.in_order_of_arrival(i, f"{folder}/in"))


_DELIVERED = """dl AS (SELECT interaction_id, learner_id, session_id, concept_ids, correctness, score, ts, epoch_us(coalesce(TRY_CAST(json_extract_string(metadata, '$.received_at') AS TIMESTAMPTZ), ts)) AS us FROM interactions WHERE interaction_id IS NOT NULL),
tm AS (SELECT interaction_id, list(us ORDER BY us) AS t FROM dl WHERE us IS NOT NULL GROUP BY 1), pr AS (SELECT interaction_id, len(t) AS deliveries, list_reduce(list_prepend([t[1]], list_transform(t[2:], lambda x: [x])), lambda s, x: CASE WHEN x[1] > s[len(s)] + 86400000000 THEN s || x ELSE s END) AS kept FROM tm)"""


@query(f"WITH {_DELIVERED} SELECT interaction_id, deliveries, len(kept) AS processed, deliveries - len(kept) AS replayed FROM pr")
def stm_01_02_19_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries by token: processed once in 24 hours, otherwise answered by what was kept."""
    folder = _folder(spark)
    out = S.run_to_table(S.idempotent(_arrivals(spark, sf_dir, folder), "interaction_id", "received", "score"), folder)
    return out.groupBy(F.col("token").alias("interaction_id")).agg(F.count("*").alias("deliveries"), F.count_if(~F.col("replayed")).alias("processed"), F.count_if("replayed").alias("replayed"))


@query(f"WITH {_DELIVERED} SELECT epoch_us(date_trunc('day', make_timestamp(us))) AS start_us, count(*) AS answers, count(*) FILTER (correctness >= 0.5) AS \"right\", round(sum(coalesce(score, 0)), 4) AS score FROM dl WHERE us IS NOT NULL GROUP BY 1")
def stm_04_daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries a day of arrival, with a watermark of 24 hours."""
    folder = _folder(spark)
    s = S.activity(_arrivals(spark, sf_dir, folder).withWatermark("received", S.LATE), at="received")
    out = S.run_to_table(s.select("start", "answers", "right", "score"), folder, "update", ["start"])
    return out.select(F.unix_micros("start").alias("start_us"), "answers", "right", F.round("score", 4).alias("score"))


@query("""WITH i AS (SELECT DISTINCT interaction_id, learner_id, session_id, ts, correctness FROM interactions WHERE learner_id IS NOT NULL AND session_id IS NOT NULL) SELECT learner_id, session_id, count(*) AS answers, string_agg(interaction_id, ',' ORDER BY ts, interaction_id) AS history FROM i GROUP BY 1, 2""")
def stm_04_session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of answers by learner and session, each once, in order of time."""
    i = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND session_id IS NOT NULL").select("interaction_id", "learner_id", "session_id", "ts", "correctness").distinct()
    return i.groupBy("learner_id", "session_id").agg(F.count("*").alias("answers"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "interaction_id"))), lambda x: x["interaction_id"]), ",").alias("history"))


_STEP_STREAM = STATES[STATES.index("round(greatest(0.01") : STATES.index(")) * 10000) / 10000") + len(")) * 10000) / 10000")]


@query(f"""WITH {_DELIVERED}, ev AS (SELECT dl.interaction_id, any_value(learner_id) AS learner_id, any_value(concept_ids) AS concept_ids, any_value(correctness) AS correctness FROM dl GROUP BY 1),
e AS (SELECT learner_id, interaction_id, correctness, us, unnest(list_distinct(concept_ids)) AS concept_id FROM (SELECT ev.*, unnest(pr.kept) AS us FROM ev JOIN pr USING (interaction_id)) z WHERE learner_id IS NOT NULL AND correctness IS NOT NULL AND NOT isnan(correctness)),
o AS (SELECT learner_id, concept_id, list(CASE WHEN correctness >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY us, interaction_id) AS obs FROM e GROUP BY 1, 2)
SELECT learner_id, concept_id, round(list_reduce(list_prepend(0.30::DOUBLE, obs), lambda p, x: {_STEP_STREAM}), 4) AS mastery, len(obs) AS attempts, CAST(list_sum(obs) AS BIGINT) AS correct FROM o""")
def stm_05_06_mastery_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastery after the whole stream, answers in order of delivery, redeliveries within 24 hours once."""
    folder = _folder(spark)
    out = S.run_to_table(S.mastery_stream(_arrivals(spark, sf_dir, folder), at="received"), folder, "update", ["learner_id", "concept_id"], "attempts")
    return out.select("learner_id", "concept_id", F.round("mastery", 4).alias("mastery"), "attempts", "correct")


@query("""WITH s AS (SELECT learner_id, session_id, count(*) AS answers, count(*) FILTER (correctness >= 0.5) AS "right" FROM interactions WHERE learner_id IS NOT NULL AND session_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) SELECT learner_id, session_id, answers, "right", answers >= 25 AS completed FROM s""")
def stm_08_session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after the whole stream: answers as delivered, and whether they were completed."""
    folder = _folder(spark)
    s = S.session_states(_arrivals(spark, sf_dir, folder).withColumn("received", F.col("received")), at="received", idle="3650 days")
    out = S.run_to_table(s, folder, "update", ["learner_id", "session_id"], "answers")
    return out.select("learner_id", "session_id", "answers", "right", (F.col("status") == "COMPLETED").alias("completed"))
