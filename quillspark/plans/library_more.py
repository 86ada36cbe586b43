"""More queries: mentions and relations, evaluation, diagnosis, contracts, pre/post gains, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import HEDGES
from quillspark.operators import relations as R
from quillspark.operators import resolve
from quillspark.operators.hierarchy import hierarchy
from quillspark.plans.library import _QUESTIONS, ROSTER, STATES, query, roster, states
from quillspark.plans.library_text import doc_links, win_07_08_misconceptions
from quillspark.session import table

# Patterns of instructions hidden in text.
INJECTIONS = [r"ignore\s+(all\s+)?previous\s+instructions", r"disregard\s+(all\s+)?prior\s+prompts", r"system\s+prompt:", r"you\s+are\s+now\s+an?\s+ai", r"override\s+system\s+rules", r"developer\s+mode\s+enabled"]
# Fixed value: letters of formulas.
MATH = r"[∀-⋿⨀-⫿℀-⅏Ͱ-Ͽ=+\-*/^]"


def concept_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "concepts")
    return c.select("concept_id", F.posexplode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("ord", "term")).filter("term IS NOT NULL")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


_TERMS = "tm AS (SELECT concept_id, lower(trim(ts[k])) AS term, k AS ord FROM (SELECT concept_id, list_concat([canonical_name], coalesce(aliases, [])) AS ts, unnest(generate_series(1, 1 + len(coalesce(aliases, [])))) AS k FROM concepts) z WHERE ts[k] IS NOT NULL AND trim(ts[k]) <> ''), tw AS (SELECT concept_id, list_distinct(flatten(list(regexp_extract_all(term, '[a-z0-9_-]{2,}')))) AS words FROM tm GROUP BY 1), tk AS (SELECT tm.*, tw.words FROM tm JOIN tw USING (concept_id))"
_MENTIONS_OF = """{terms}, tx AS (SELECT id, lower(text) AS low, regexp_extract_all(lower(text), '[a-z0-9_-]{{2,}}') AS toks FROM ({src}) z WHERE text IS NOT NULL),
hit AS (SELECT tx.id, tk.concept_id, tk.term, tk.ord, instr(tx.low, tk.term) AS start FROM tx JOIN tk ON contains(tx.low, tk.term) AND list_has_any(tx.toks, tk.words)),
mn AS (SELECT id, concept_id, arg_min(start, (ord, term)) AS start, arg_min(term, (ord, term)) AS term FROM hit GROUP BY 1, 2)"""
_MENTIONS = _MENTIONS_OF.format(terms=_TERMS, src="SELECT doc_id AS id, text FROM documents")
_EVIDENCE_MENTIONS = _MENTIONS_OF.format(terms=_TERMS, src="SELECT document_id || '/' || evidence_id AS id, max(excerpt) AS text FROM evidence GROUP BY 1")


def _excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "evidence")
    return e.groupBy(F.concat_ws("/", "document_id", "evidence_id").alias("id")).agg(F.max("excerpt").alias("text"))


@query(f"WITH {_EVIDENCE_MENTIONS} SELECT id, concept_id, CAST(start AS INTEGER) AS start, term FROM mn")
def jn_03_concept_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where concepts are first named in evidence."""
    return R.mentions(_excerpts(spark, sf_dir), concept_terms(spark, sf_dir)).select("id", "concept_id", "start", "term")


def _has(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


_RULE = (
    f"CASE WHEN {_has('low', R.WHOLE_RECALL)} THEN 'R' WHEN contains(low, '{R.UNDERSTAND}') AND {_has('low', R.UNDERSTAND_WITH)} THEN 'R' WHEN {_has('mid', R.PREREQUISITE)} OR {_has('low', R.WHOLE_PREREQUISITE)} THEN 'P' WHEN {_has('mid', R.REQUIRES)} OR (fw AND {_has('low', R.WHOLE_REQUIRES)}) THEN 'R' "
    + " ".join(f"WHEN {_has('mid', p)} THEN '{n}'" for n, p in R.BETWEEN.items())
    + " END"
)


@query(f"""WITH {_EVIDENCE_MENTIONS}, sp AS (SELECT m.id, concept_id AS c, start AS s, start + length(term) AS e, low FROM mn m JOIN tx ON tx.id = m.id WHERE NOT {_has('low', HEDGES)}),
pr AS (SELECT a.id, a.low, a.s < b.s AS fw, CASE WHEN a.s < b.s THEN a.c ELSE b.c END AS early, CASE WHEN a.s < b.s THEN b.c ELSE a.c END AS late, greatest(a.s, b.s) AS s2, least(a.s, b.s) AS s1, CASE WHEN a.s < b.s THEN a.e ELSE b.e END AS e1 FROM sp a JOIN sp b ON a.id = b.id AND a.c <> b.c AND a.s <> b.s AND abs(a.s - b.s) <= 400),
md AS (SELECT *, CASE WHEN e1 <= s2 THEN substr(low, e1, s2 - e1) ELSE substr(low, s1, s2 - s1) END AS mid FROM pr), rl AS (SELECT *, {_RULE} AS rule FROM md)
SELECT DISTINCT id, CASE WHEN rule = 'R' THEN late ELSE early END AS source, CASE WHEN rule IN ('R', 'P') THEN 'PREREQUISITE_OF' ELSE rule END AS relation, CASE WHEN rule = 'R' THEN early ELSE late END AS target FROM rl WHERE rule IS NOT NULL""")
def jn_04_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _excerpts(spark, sf_dir)
    return R.relations(t, R.mentions(t, concept_terms(spark, sf_dir)))


@query(f"""WITH {_MENTIONS}, g AS (SELECT DISTINCT doc_id AS id, unnest(concept_ids) AS concept_id FROM documents), j AS (SELECT coalesce(mn.id, g.id) AS id, mn.id IS NOT NULL AS f, g.id IS NOT NULL AS t FROM mn FULL OUTER JOIN g ON mn.id = g.id AND mn.concept_id = g.concept_id)
SELECT id AS doc_id, count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (t AND NOT f) AS fn FROM j GROUP BY 1""")
def set_01_agg_22_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts found in each text against the concepts it is filed under."""
    found = R.mentions(_texts(spark, sf_dir), concept_terms(spark, sf_dir)).select("id", F.col("concept_id").alias("item"))
    golden = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode("concept_ids").alias("item"))
    return R.agreement(found, golden).withColumnRenamed("id", "doc_id")


@query("""WITH n AS (SELECT lower(trim(canonical_name)) AS k, min(concept_id) AS to_id FROM concepts WHERE status = 'active' GROUP BY 1), a AS (SELECT k, min(concept_id) AS to_id FROM (SELECT concept_id, lower(trim(unnest(aliases))) AS k FROM concepts WHERE status = 'active') z GROUP BY 1)
SELECT c.concept_id, CASE WHEN c.status = 'active' THEN 'same' WHEN n.to_id IS NOT NULL OR a.to_id IS NOT NULL THEN 'merged_into' ELSE 'removed' END AS mapping, CASE WHEN c.status = 'active' THEN c.concept_id ELSE coalesce(n.to_id, a.to_id) END AS to_id
FROM concepts c LEFT JOIN n ON n.k = lower(trim(c.canonical_name)) LEFT JOIN a ON a.k = lower(trim(c.canonical_name))""")
def jn_19_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that are not active any more, by name or alias to one that is."""
    c = table(spark, sf_dir, "concepts").withColumn("k", F.lower(F.trim("canonical_name")))
    live = c.filter("status = 'active'")
    n = live.groupBy("k").agg(F.min("concept_id").alias("by_name"))
    a = live.select(F.explode("aliases").alias("a"), "concept_id").groupBy(F.lower(F.trim("a")).alias("k")).agg(F.min("concept_id").alias("by_alias"))
    to = F.coalesce("by_name", "by_alias")
    active = F.coalesce(F.col("status") == "active", F.lit(False))
    return c.join(n, "k", "left").join(a, "k", "left").select("concept_id", F.when(active, "same").when(to.isNotNull(), "merged_into").otherwise("removed").alias("mapping"), F.when(active, F.col("concept_id")).otherwise(to).alias("to_id"))


_HYP = f"""{STATES}, l AS (SELECT DISTINCT document_id AS tree, source_concept_id AS a, target_concept_id AS b FROM prerequisite_links), r AS (SELECT tree, a, b FROM l UNION SELECT r.tree, r.a, l.b FROM r JOIN l ON r.tree = l.tree AND r.b = l.a),
nd AS (SELECT tree, a AS c FROM l UNION SELECT tree, b FROM l), h AS (SELECT nd.tree, s.learner_id, nd.c, s.mastery AS m, (1.0::DOUBLE - s.mastery) * (0.5::DOUBLE + 0.5::DOUBLE * 0.85::DOUBLE) + 0.1::DOUBLE AS w FROM nd JOIN states s ON s.concept_id = nd.c),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY tree, learner_id) AS p FROM h),
x AS (SELECT q.tree, q.learner_id, q.c AS q, i.p, greatest(0.001::DOUBLE, least(0.999::DOUBLE, CASE WHEN i.c = q.c OR EXISTS (SELECT 1 FROM r WHERE r.tree = q.tree AND r.a = i.c AND r.b = q.c) THEN 0.25::DOUBLE ELSE q.m * 0.9::DOUBLE + (1.0::DOUBLE - q.m) * 0.25::DOUBLE END)) AS k FROM p q JOIN p i ON q.tree = i.tree AND q.learner_id = i.learner_id),
z AS (SELECT *, sum(p * k) OVER (PARTITION BY tree, learner_id, q) AS ok FROM x)"""


@query(f"""WITH {STATES}, {ROSTER}, w AS (SELECT DISTINCT learner_id, question_id FROM interactions WHERE correctness < 0.5 AND learner_id IS NOT NULL AND question_id IS NOT NULL), n AS (SELECT class_id, count(*) AS n FROM roster GROUP BY 1)
SELECT r.class_id, 'misc_' || substr(sha256(w.question_id), 1, 10) AS misconception_id, count(DISTINCT w.learner_id) AS learners, round(count(DISTINCT w.learner_id) / max(n.n), 2) AS prevalence FROM w JOIN roster r USING (learner_id) JOIN n ON n.class_id = r.class_id GROUP BY 1, 2""")
def agg_04_misconception_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learners of a class by misconception, and their share."""
    r = roster(spark, sf_dir)
    n = r.groupBy("class_id").agg(F.count("*").alias("n"))
    m = win_07_08_misconceptions(spark, sf_dir).join(r, "learner_id").groupBy("class_id", "misconception_id").agg(F.count_distinct("learner_id").alias("learners"))
    return m.join(n, "class_id").select("class_id", "misconception_id", "learners", F.round(F.col("learners") / F.col("n"), 2).alias("prevalence"))


@query("""WITH i AS (SELECT DISTINCT ON (interaction_id) interaction_id, pre_mastery, post_mastery FROM interactions), e AS (SELECT interaction_id, unnest(map_keys(post_mastery)) AS c, post_mastery, pre_mastery FROM i WHERE post_mastery IS NOT NULL AND pre_mastery IS NOT NULL),
v AS (SELECT c AS concept_id, CAST(round(pre_mastery[c] * 10000) AS BIGINT) AS b, CAST(round(post_mastery[c] * 10000) AS BIGINT) AS a FROM e WHERE NOT isnan(coalesce(pre_mastery[c], 'nan'::DOUBLE)) AND NOT isnan(coalesce(post_mastery[c], 'nan'::DOUBLE)) AND pre_mastery[c] BETWEEN 0 AND 1 AND post_mastery[c] BETWEEN 0 AND 1)
SELECT concept_id, count(*) AS answers, round(sum(b) / 10000.0 / count(*), 8)::DOUBLE AS pre_mean, round(sum(a) / 10000.0 / count(*), 8)::DOUBLE AS post_mean, count(*) FILTER (b < 4000) AS struggling_before, count(*) FILTER (a < 4000) AS struggling_after, (sum(a) - sum(b)) > 1000 * count(*) OR count(*) FILTER (a < 4000) < count(*) FILTER (b < 4000) AS effective FROM v GROUP BY 1""")
def agg_09_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastery before and after the answers on each concept."""
    i = table(spark, sf_dir, "interactions").select("interaction_id", "pre_mastery", F.explode("post_mastery").alias("concept_id", "after"))
    v = i.withColumn("before", F.try_element_at("pre_mastery", F.col("concept_id"))).filter("NOT isnan(before) AND NOT isnan(after) AND before BETWEEN 0 AND 1 AND after BETWEEN 0 AND 1")
    v = v.groupBy("interaction_id", "concept_id").agg(F.max(F.round(F.col("before") * 10_000).cast("long")).alias("b"), F.max(F.round(F.col("after") * 10_000).cast("long")).alias("a"))
    n = F.count("*")
    sb, sa = F.count_if(F.col("b") < 4000), F.count_if(F.col("a") < 4000)
    return v.groupBy("concept_id").agg(n.alias("answers"), F.round(F.sum("b") / 10_000.0 / n, 8).alias("pre_mean"), F.round(F.sum("a") / 10_000.0 / n, 8).alias("post_mean"), sb.alias("struggling_before"), sa.alias("struggling_after"), ((F.sum("a") - F.sum("b") > 1000 * n) | (sa < sb)).alias("effective"))


@query(f"""WITH {_QUESTIONS}, c AS (SELECT document_id, chapter_id, unnest(concept_ids) AS c FROM q), k AS (SELECT document_id, chapter_id, count(DISTINCT c) AS concepts, string_agg(DISTINCT c, ',' ORDER BY c) AS concept_ids FROM c GROUP BY 1, 2)
SELECT q.document_id, q.chapter_id, count(*) AS questions, round(avg(difficulty), 8) AS difficulty, coalesce(max(k.concepts), 0) AS concepts, coalesce(max(k.concept_ids), '') AS concept_ids FROM q LEFT JOIN k ON k.document_id = q.document_id AND k.chapter_id = q.chapter_id GROUP BY 1, 2""")
def agg_10_30_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters with their questions and concepts."""
    q = resolve.latest(table(spark, sf_dir, "questions"), ["question_id"], ["exposure_count", "created_at"])
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("concept_ids"))))
    return q.groupBy("document_id", "chapter_id").agg(F.count("*").alias("questions"), F.round(F.avg("difficulty"), 8).alias("difficulty"), F.size(ids).cast("long").alias("concepts"), F.array_join(ids, ",").alias("concept_ids"))


@query("""WITH e AS (SELECT document_id, evidence_id, max(excerpt) AS t FROM evidence GROUP BY 1, 2) SELECT document_id, count(*) AS records, count(*) FILTER (trim(coalesce(t, '')) = '') AS empty, CAST(sum(length(coalesce(t, ''))) AS BIGINT) AS chars,
CASE WHEN sum(length(coalesce(t, ''))) = 0 THEN 'INVALID' WHEN count(*) FILTER (trim(coalesce(t, '')) = '') * 2 > count(*) OR sum(length(coalesce(t, ''))) < 500 THEN 'WARNING' ELSE 'VALID' END AS status FROM e GROUP BY 1""")
def agg_21_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much text a document's evidence holds."""
    e = table(spark, sf_dir, "evidence").groupBy("document_id", "evidence_id").agg(F.coalesce(F.max("excerpt"), F.lit("")).alias("t"))
    empty, chars, n = F.count_if(F.trim("t") == ""), F.sum(F.length("t")), F.count("*")
    return e.groupBy("document_id").agg(n.alias("records"), empty.alias("empty"), chars.alias("chars"), F.when(chars == 0, "INVALID").when((empty * 2 > n) | (chars < 500), "WARNING").otherwise("VALID").alias("status"))


@query("""WITH s AS (SELECT DISTINCT document_id, section_id FROM sections), c AS (SELECT document_id, section_id, count(DISTINCT citation_id) AS units FROM source_citations WHERE section_id IS NOT NULL GROUP BY 1, 2) SELECT s.document_id, s.section_id, c.units FROM s JOIN c USING (document_id, section_id) WHERE c.units > 0""")
def agg_27_section_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with citations in them; empty ones are dropped."""
    s = table(spark, sf_dir, "sections").select("document_id", "section_id").distinct()
    c = table(spark, sf_dir, "source_citations").filter("section_id IS NOT NULL").groupBy("document_id", "section_id").agg(F.count_distinct("citation_id").alias("units"))
    return s.join(c, ["document_id", "section_id"])


@query("""WITH r AS (SELECT document_id, section_id, count(*) AS n, count(DISTINCT coalesce(title, '') || '|' || coalesce(level, 0)) AS v, max(CASE WHEN trim(coalesce(title, '')) = '' THEN 1 ELSE 0 END) AS untitled, max(CASE WHEN page_start IS NULL THEN 1 ELSE 0 END) AS unpaged FROM sections GROUP BY 1, 2),
k AS (SELECT DISTINCT document_id, unnest(children) AS child FROM sections), d AS (SELECT k.document_id, count(*) AS dangling FROM k LEFT JOIN r ON r.document_id = k.document_id AND r.section_id = k.child WHERE r.section_id IS NULL GROUP BY 1)
SELECT r.document_id, count(*) AS sections, CAST(sum(n - 1) AS BIGINT) AS repeated, CAST(sum(untitled) AS BIGINT) AS untitled, CAST(sum(unpaged) AS BIGINT) AS unpaged, coalesce(max(d.dangling), 0) AS dangling FROM r LEFT JOIN d ON d.document_id = r.document_id GROUP BY 1""")
def qc_14_section_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of the section table's contract by document."""
    s = table(spark, sf_dir, "sections")
    r = s.groupBy("document_id", "section_id").agg(F.count("*").alias("n"), F.max((F.trim(F.coalesce("title", F.lit(""))) == "").cast("int")).alias("u"), F.max(F.col("page_start").isNull().cast("int")).alias("p"))
    d = s.select("document_id", F.explode("children").alias("section_id")).distinct().join(r, ["document_id", "section_id"], "left_anti").groupBy("document_id").agg(F.count("*").alias("dangling"))
    out = r.groupBy("document_id").agg(F.count("*").alias("sections"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("u").alias("untitled"), F.sum("p").alias("unpaged"))
    return out.join(d, "document_id", "left").fillna(0, ["dangling"])


@query("""WITH i AS (SELECT *, count(*) OVER (PARTITION BY interaction_id) AS n FROM interactions) SELECT lower(trim(coalesce(source, ''))) AS source, count(*) AS rows, count(*) FILTER (learner_id IS NULL) AS no_learner, count(*) FILTER (correctness IS NULL) AS ungraded, count(*) FILTER (correctness < 0 OR correctness > 1) AS out_of_range,
count(*) FILTER (time_taken_seconds < 0) AS negative_time, count(*) FILTER (len(coalesce(concept_ids, [])) = 0) AS no_concept, count(*) FILTER (n > 1) AS redelivered FROM i GROUP BY 1""")
def qc_11_12_response_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaches of the response contract by source."""
    i = table(spark, sf_dir, "interactions").select("interaction_id", "source", "learner_id", "correctness", "time_taken_seconds", "concept_ids")
    n = i.groupBy("interaction_id").agg(F.count("*").alias("n")).filter("n > 1")
    x = i.join(n, "interaction_id", "left")
    c = F.count_if
    return x.groupBy(F.lower(F.trim(F.coalesce("source", F.lit("")))).alias("source")).agg(
        F.count("*").alias("rows"), c(F.col("learner_id").isNull()).alias("no_learner"), c(F.col("correctness").isNull()).alias("ungraded"), c((F.col("correctness") < 0) | (F.col("correctness") > 1)).alias("out_of_range"),
        c(F.col("time_taken_seconds") < 0).alias("negative_time"), c(F.size(F.coalesce("concept_ids", F.array().cast("array<string>"))) == 0).alias("no_concept"), c(F.col("n").isNotNull()).alias("redelivered"),
    )


@query("WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, " + ", ".join(f"regexp_matches(text, '(?i){p}') AS pattern_{k}" for k, p in enumerate(INJECTIONS, 1)) + ", left(" + "".join("regexp_replace(" for _ in INJECTIONS) + "text" + "".join(f", '(?i){p}', '[filtered]', 'g')" for p in INJECTIONS) + ", 500) AS redacted, round(len(regexp_extract_all(text, '" + MATH + "')) / greatest(1, length(text)), 8) AS math_density FROM d")
def prj_09_11_29_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden instructions in texts, found and filtered; density of formula signs."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    red = F.col("text")
    for p in INJECTIONS:
        red = F.regexp_replace(red, f"(?i){p}", "[filtered]")
    return d.select("doc_id", *[F.col("text").rlike(f"(?i){p}").alias(f"pattern_{k}") for k, p in enumerate(INJECTIONS, 1)], F.left(red, F.lit(500)).alias("redacted"), F.round(F.regexp_count("text", F.lit(MATH)) / F.greatest(F.lit(1), F.length("text")), 8).alias("math_density"))


@query("WITH d AS (SELECT concept_id, md5(coalesce(canonical_name, '')) AS h FROM concepts) SELECT concept_id, " + ", ".join(f"round(CAST('0x' || substr(h, {2 * k + 1}, 2) AS INTEGER) / 255.0::DOUBLE, 8) AS e{k}" for k in range(8)) + " FROM d")
def udf_03_hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight numbers from the first bytes of a name's md5."""
    h = F.md5(F.coalesce("canonical_name", F.lit("")))
    return table(spark, sf_dir, "concepts").select("concept_id", *[F.round(F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("double") / 255.0, 8).alias(f"e{k}") for k in range(8)])


@query(f"""WITH {STATES} SELECT learner_id, string_agg(concept_id || '=' || CAST(CAST(round(mastery * 10000) AS BIGINT) AS VARCHAR) || '/' || attempts, ';' ORDER BY concept_id) AS summary FROM states GROUP BY 1""")
def arr_06_state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    item = F.concat_ws("", F.col("concept_id"), F.lit("="), F.round(F.col("mastery") * 10_000).cast("long").cast("string"), F.lit("/"), F.col("attempts").cast("string"))
    return s.groupBy("learner_id").agg(F.array_join(F.array_sort(F.collect_list(item)), ";").alias("summary"))


@query("""WITH i AS (SELECT DISTINCT interaction_id, learner_id, question_id, ts, correctness FROM interactions WHERE learner_id IS NOT NULL AND question_id IS NOT NULL),
g AS (SELECT learner_id, question_id, ts, max(correctness) AS correctness FROM i GROUP BY 1, 2, 3) SELECT a.interaction_id, epoch_us(b.ts) AS prev_us, b.correctness AS prev_correctness FROM i a ASOF LEFT JOIN g b ON a.learner_id = b.learner_id AND a.question_id = b.question_id AND a.ts > b.ts""")
def asof_previous_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer with the learner's latest earlier answer to the same question."""
    i = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND question_id IS NOT NULL").select("interaction_id", "learner_id", "question_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "correctness").distinct()
    right = i.groupBy("learner_id", "question_id", "us").agg(F.max("correctness").alias("correctness"))
    out = R.asof_join(i.select("interaction_id", "learner_id", "question_id", "us"), right, ["learner_id", "question_id"], "us", ["us", "correctness"])
    return out.select("interaction_id", "prev_us", "prev_correctness")
