"""Views for teaching and learning, page inspection and term acceptance, each with the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import terms as X
from quillspark.functions import text as T
from quillspark.operators import cohort, relations
from quillspark.plans.library import _QUESTIONS, FULL, STATES, _quoted, query, roster, states, subject_concepts
from quillspark.plans.library_checks import chapters
from quillspark.plans.library_extract import BLOCKS, blocks
from quillspark.plans.library_more import _MENTIONS, _texts, concept_terms
from quillspark.plans.library_planning import newest
from quillspark.session import stored, table

_DIST = f"{FULL}, ds AS (SELECT class_id, concept_id, avg(m) AS mean, count(*) FILTER (m < 0.4) AS weak, count(*) AS n FROM full_ GROUP BY 1, 2)"


@query(f"""WITH {_DIST} SELECT class_id, concept_id, round(greatest(0.15, least(0.92, round(mean, 10) * 0.85::DOUBLE + 0.05::DOUBLE)) + 1e-9, 2) AS first_try, CAST(floor(45 + (1.0 - round(mean, 10)) * 120 + 1e-9) AS INTEGER) AS minutes,
CASE WHEN round(mean, 10) < 0.35 OR weak / n > 0.5 THEN 'VERY_HARD' WHEN round(mean, 10) < 0.55 OR weak / n > 0.3 THEN 'HARD' WHEN round(mean, 10) < 0.75 THEN 'MODERATE' ELSE 'EASY' END AS tier FROM ds""")
def agg_08_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How hard each concept is for a class: share right at first, minutes to master it, tier."""
    d = cohort.concept_distribution(states(spark, sf_dir), roster(spark, sf_dir), subject_concepts(spark, sf_dir))
    m, weak = F.col("mean_mastery"), F.col("share_struggling")
    tier = F.when((m < 0.35) | (weak > 0.5), "VERY_HARD").when((m < 0.55) | (weak > 0.3), "HARD").when(m < 0.75, "MODERATE").otherwise("EASY")
    return d.select("class_id", "concept_id", F.round(F.greatest(F.lit(0.15), F.least(F.lit(0.92), m * 0.85 + 0.05)) + 1e-9, 2).alias("first_try"), F.floor(45 + (1.0 - m) * 120 + 1e-9).cast("int").alias("minutes"), tier.alias("tier"))


@query(f"""WITH {_DIST}, e AS (SELECT DISTINCT source_concept_id AS s, target_concept_id AS t FROM prerequisite_links), sz AS (SELECT class_id, count(*) AS n FROM roster GROUP BY 1),
b AS (SELECT x.class_id, e.s, e.t, round(count(*) / max(sz.n), 2) AS severity FROM full_ x JOIN e ON x.concept_id = e.s JOIN full_ y ON y.learner_id = x.learner_id AND y.concept_id = e.t JOIN sz ON sz.class_id = x.class_id WHERE x.m < 0.5 AND y.m < 0.5 GROUP BY 1, 2, 3),
tb AS (SELECT class_id, arg_min(s, (-severity, s, t)) AS prerequisite, arg_min(t, (-severity, s, t)) AS target FROM b GROUP BY 1), lo AS (SELECT class_id, arg_min(concept_id, (round(mean, 10), concept_id)) AS weakest FROM ds GROUP BY 1)
SELECT lo.class_id, coalesce(tb.target, lo.weakest) AS target, tb.prerequisite, CASE WHEN tb.target IS NULL THEN 0 ELSE 15 END AS prerequisite_minutes, CASE WHEN tb.target IS NULL THEN 25 ELSE 25 END AS instruction_minutes, CASE WHEN tb.target IS NULL THEN 35 ELSE 20 END AS reassess_minutes FROM lo LEFT JOIN tb USING (class_id)""")
def top_18_teaching_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lesson of 60 minutes for each class: the worst bottleneck's target, else the weakest concept, and how the time is shared."""
    s, r = stored(states(spark, sf_dir)), stored(roster(spark, sf_dir))
    e = table(spark, sf_dir, "prerequisite_links").select(F.lit("all").alias("subject_id"), F.col("source_concept_id").alias("source"), F.col("target_concept_id").alias("target")).distinct()
    b = cohort.bottlenecks(s, r, e).groupBy("class_id").agg(F.min_by(F.struct("source", "target"), F.struct(-F.col("severity"), "source", "target")).alias("b"))
    low = cohort.concept_distribution(s, r, subject_concepts(spark, sf_dir)).groupBy("class_id").agg(F.min_by("concept_id", F.struct("mean_mastery", "concept_id")).alias("weakest"))
    x = low.join(b, "class_id", "left")
    first, teach, rest = cohort.minutes(F.lit(60), F.col("b").isNotNull())
    return x.select("class_id", F.coalesce("b.target", "weakest").alias("target"), F.col("b.source").alias("prerequisite"), first.alias("prerequisite_minutes"), teach.alias("instruction_minutes"), rest.alias("reassess_minutes"))


@query(f"""WITH {_QUESTIONS}, x AS (SELECT DISTINCT question_id, unnest(concept_ids) AS c FROM q), ch AS (SELECT DISTINCT chapter_id AS topic, unnest(concept_ids) AS c FROM q WHERE chapter_id IS NOT NULL) SELECT x.question_id, string_agg(DISTINCT ch.topic, ',' ORDER BY ch.topic) AS topics FROM x JOIN ch USING (c) GROUP BY 1""")
def jn_24_question_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics a question belongs to by the concepts they share."""
    x = newest(spark, sf_dir).select("question_id", F.explode("concept_ids").alias("concept_id")).distinct()
    return x.join(chapters(spark, sf_dir), "concept_id").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics"))


@query("""WITH w AS (SELECT DISTINCT learner_id, unnest(concept_ids) AS concept_id FROM interactions WHERE learner_id IS NOT NULL AND correctness < 0.5), d AS (SELECT DISTINCT document_id, target_concept_id AS concept_id, unnest(evidence_ids) AS evidence_id FROM prerequisite_links), u AS (SELECT d.concept_id, count(DISTINCT e.document_id || '/' || e.block_id) AS units, min(e.document_id || '/' || e.block_id) AS first_unit FROM d JOIN evidence e ON e.document_id = d.document_id AND e.evidence_id = d.evidence_id WHERE e.block_id IS NOT NULL GROUP BY 1)
SELECT w.learner_id, w.concept_id, coalesce(units, 0) AS units, first_unit FROM w LEFT JOIN u USING (concept_id)""")
def jn_15_23_remediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each concept a learner failed: the units whose evidence is about it."""
    w = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND correctness < 0.5").select("learner_id", F.explode("concept_ids").alias("concept_id")).distinct()
    d = table(spark, sf_dir, "prerequisite_links").select("document_id", F.col("target_concept_id").alias("concept_id"), F.explode("evidence_ids").alias("evidence_id")).distinct()
    e = table(spark, sf_dir, "evidence").filter("block_id IS NOT NULL").select("document_id", "evidence_id", F.concat_ws("/", "document_id", "block_id").alias("unit")).distinct()
    u = d.join(e, ["document_id", "evidence_id"]).groupBy("concept_id").agg(F.count_distinct("unit").alias("units"), F.min("unit").alias("first_unit"))
    return w.join(u, "concept_id", "left").select("learner_id", "concept_id", F.coalesce("units", F.lit(0)).alias("units"), "first_unit")


@query(f"WITH {_MENTIONS} SELECT concept_id, count(DISTINCT id) AS passages, min(id) AS first_passage FROM mn GROUP BY 1")
def jn_18_bound_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that name a concept; the first one is bound to it as evidence."""
    m = relations.mentions(_texts(spark, sf_dir), concept_terms(spark, sf_dir))
    return m.groupBy("concept_id").agg(F.count_distinct("id").alias("passages"), F.min("id").alias("first_passage"))


@query(r"""SELECT concept_id, CASE WHEN trim(coalesce(canonical_name, '')) <> '' AND NOT regexp_matches(trim(canonical_name), '(?i)^c_[a-f0-9]{6,}$') THEN canonical_name WHEN len(aliases) > 0 THEN list_min(aliases) WHEN regexp_matches(replace(concept_id, 'c_', ''), '(?i)^[a-f0-9]{6,}$') THEN 'Core Concept' ELSE replace(replace(concept_id, 'c_', ''), '_', ' ') END AS name FROM concepts""")
def jn_22_concept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name to show: the canonical one unless it is an id, else an alias, else what the id says."""
    bare = F.replace("concept_id", F.lit("c_"), F.lit(""))
    good = (F.trim(F.coalesce("canonical_name", F.lit(""))) != "") & ~F.coalesce(F.trim("canonical_name").rlike(r"(?i)^c_[a-f0-9]{6,}$"), F.lit(False))
    return table(spark, sf_dir, "concepts").select("concept_id", F.when(good, F.col("canonical_name")).when(F.size("aliases") > 0, F.array_min("aliases")).when(bare.rlike(r"(?i)^[a-f0-9]{6,}$"), "Core Concept").otherwise(F.replace(bare, F.lit("_"), F.lit(" "))).alias("name"))


@query(f"""WITH {_QUESTIONS}, nm AS (SELECT concept_id, max(canonical_name) AS name FROM concepts GROUP BY 1), i AS (SELECT DISTINCT interaction_id, question_id, correctness FROM interactions WHERE correctness IS NOT NULL AND NOT isnan(correctness)), c AS (SELECT question_id, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT question_id, unnest(list_distinct(concept_ids)) AS concept_id FROM q) z JOIN nm USING (concept_id) GROUP BY 1)
SELECT interaction_id, CASE WHEN correctness >= 0.5 THEN 'right' WHEN correctness > 0 THEN 'close' ELSE 'Key concept to review: ' || coalesce(c.names, 'Topic fundamental principles') || '.' END AS guidance FROM i JOIN q USING (question_id) LEFT JOIN c USING (question_id)""")
def udf_10_11_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer is told: right, close, or the concepts to review."""
    nm = table(spark, sf_dir, "concepts").groupBy("concept_id").agg(F.max("canonical_name").alias("name"))
    q = newest(spark, sf_dir).select("question_id", "concept_ids")
    c = q.select("question_id", F.explode(F.array_distinct("concept_ids")).alias("concept_id")).join(nm, "concept_id").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    i = table(spark, sf_dir, "interactions").filter("correctness IS NOT NULL AND NOT isnan(correctness)").select("interaction_id", "question_id", "correctness").distinct()
    x = i.join(q.select("question_id"), "question_id").join(c, "question_id", "left")
    return x.select("interaction_id", F.when(F.col("correctness") >= 0.5, "right").when(F.col("correctness") > 0, "close").otherwise(F.concat(F.lit("Key concept to review: "), F.coalesce("names", F.lit("Topic fundamental principles")), F.lit("."))).alias("guidance"))


@query(f"""WITH {STATES}, k AS (SELECT learner_id, concept_id, CASE WHEN mastery >= 0.75 THEN 1 WHEN attempts > 0 AND mastery < 0.4 THEN 3 ELSE 2 END AS kind, mastery FROM states), r AS (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY kind DESC, mastery, concept_id) AS rn FROM k)
SELECT learner_id, CAST(rn AS INTEGER) AS place, concept_id, CASE kind WHEN 3 THEN 'FOUNDATION_REVIEW' WHEN 2 THEN 'ACTIVE_TARGET' ELSE 'READY_TO_ADVANCE' END AS step FROM r WHERE rn <= 2""")
def top_20_next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps for each learner: foundations to review, then what is under way, then what is ready to advance from."""
    kind = F.when(F.col("mastery") >= 0.75, 1).when((F.col("attempts") > 0) & (F.col("mastery") < 0.4), 3).otherwise(2)
    w = Window.partitionBy("learner_id").orderBy(F.col("kind").desc(), "mastery", "concept_id")
    x = states(spark, sf_dir).withColumn("kind", kind).withColumn("place", F.row_number().over(w)).filter("place <= 2")
    return x.select("learner_id", "place", "concept_id", F.when(F.col("kind") == 3, "FOUNDATION_REVIEW").when(F.col("kind") == 2, "ACTIVE_TARGET").otherwise("READY_TO_ADVANCE").alias("step"))


@query("""WITH i AS (SELECT DISTINCT learner_id, session_id, question_id, interaction_id, ts, correctness FROM interactions WHERE learner_id IS NOT NULL AND session_id IS NOT NULL AND question_id IS NOT NULL AND correctness IS NOT NULL AND NOT isnan(correctness)), f AS (SELECT learner_id, session_id, question_id, arg_min(correctness, (ts, interaction_id)) AS c, count(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT learner_id, session_id, count(*) AS recorded, CAST(sum(n - 1) AS BIGINT) AS ignored, round(avg(c), 4) AS score FROM f GROUP BY 1, 2""")
def stm_07_14_recorded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a session as evidence: the first to each question is recorded, later ones change nothing."""
    i = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND session_id IS NOT NULL AND question_id IS NOT NULL AND correctness IS NOT NULL AND NOT isnan(correctness)").select("learner_id", "session_id", "question_id", "interaction_id", "ts", "correctness").distinct()
    f = i.groupBy("learner_id", "session_id", "question_id").agg(F.min_by("correctness", F.struct("ts", "interaction_id")).alias("c"), F.count("*").alias("n"))
    return f.groupBy("learner_id", "session_id").agg(F.count("*").alias("recorded"), F.sum(F.col("n") - 1).alias("ignored"), F.round(F.avg("c"), 4).alias("score"))


# ---------------------------------------------------------------- pages and sources

_PAGES = f"""{BLOCKS}, pg AS (SELECT doc_id, page_index, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(regexp_replace(text, '[^\\x{{FFFD}}□�]', '', 'g'))) AS BIGINT) AS bad, (doc_id * 7 + page_index) % 60 AS paths, ((doc_id + page_index) % 10) / 20.0::DOUBLE AS cover, 0.1::DOUBLE AS ink FROM b GROUP BY 1, 2)"""


@query(f"""WITH {_PAGES}, m AS (SELECT *, bad / greatest(1, chars)::DOUBLE AS garbage FROM pg), k AS (SELECT *, CASE WHEN paths > 35 AND cover >= 0.15 THEN 'diagram' WHEN garbage >= 0.15 AND chars >= 50 THEN 'garbled' WHEN cover >= 0.4 AND chars < 100 AND ink > 0.05 THEN 'figure' END AS reason FROM m)
SELECT doc_id, page_index, chars, reason IS NOT NULL AS requires_vision, reason, round(CASE reason WHEN 'diagram' THEN least(1.0, 0.4 + paths / 100.0 * 0.3 + cover * 0.3) WHEN 'garbled' THEN least(1.0, 0.6 + garbage * 0.4) WHEN 'figure' THEN least(1.0, 0.5 + cover * 0.5) ELSE 0.0 END, 6)::DOUBLE AS complexity,
CASE WHEN chars = 0 THEN 'blank' WHEN reason IS NOT NULL THEN 'vision' WHEN chars < 20 THEN 'ocr' ELSE 'native' END AS route FROM k""")
def prj_03_06_page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages hold, whether they need to be seen rather than read, and the extractor they are sent to."""
    d = F.col("doc_id")
    p = blocks(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.length(F.regexp_replace("text", r"[^\x{FFFD}□]", ""))).alias("bad"))
    p = p.withColumn("paths", (d * 7 + F.col("page_index")) % 60).withColumn("cover", ((d + F.col("page_index")) % 10) / 20.0).withColumn("ink", F.lit(0.1))
    reason, score = T.vision_need(F.col("chars"), F.col("bad") / F.greatest(F.lit(1), F.col("chars")), F.col("ink"), F.col("cover"), F.col("paths"))
    return p.select("doc_id", "page_index", "chars", reason.isNotNull().alias("requires_vision"), reason.alias("reason"), F.round(score, 6).alias("complexity"), F.when(F.col("chars") == 0, "blank").when(reason.isNotNull(), "vision").when(F.col("chars") < 20, "ocr").otherwise("native").alias("route"))


@query("""SELECT doc_id, CASE WHEN coalesce(length(text), 0) < 10 THEN 'INVALID' WHEN length(text) > 5000 THEN 'TOO_LARGE' ELSE 'VALID' END AS status, substr(sha256(coalesce(text, '')), 1, 24) || '_en_' || substr(sha256(coalesce(source, '')), 1, 8) AS cache_key FROM documents""")
def prj_01_02_src_37_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs by size, and the key their extraction is cached under."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.coalesce(n, F.lit(0)) < 10, "INVALID").when(n > 5000, "TOO_LARGE").otherwise("VALID").alias("status"), F.concat(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 24), F.lit("_en_"), F.substring(F.sha2(F.coalesce("source", F.lit("")), 256), 1, 8)).alias("cache_key"))


@query("""SELECT learner_id, arg_max(source, (ts, interaction_id)) AS active FROM interactions WHERE learner_id IS NOT NULL AND source IS NOT NULL AND ts IS NOT NULL GROUP BY 1""")
def src_25_26_active_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source each learner came from last."""
    i = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND source IS NOT NULL AND ts IS NOT NULL")
    return i.groupBy("learner_id").agg(F.max_by("source", F.struct("ts", "interaction_id")).alias("active"))


@query("""WITH w AS (SELECT document_id, evidence_id, CASE WHEN source_confidence IS NULL THEN 'NO_CONFIDENCE' WHEN source_confidence < 0.6 THEN 'LOW_CONFIDENCE' END AS code FROM (SELECT DISTINCT document_id, evidence_id, source_confidence FROM evidence) z) SELECT document_id, evidence_id, code, CAST(row_number() OVER (PARTITION BY document_id ORDER BY evidence_id, code) AS INTEGER) AS no FROM w WHERE code IS NOT NULL""")
def src_30_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of each document in the order they are read."""
    c = F.col("source_confidence")
    w = table(spark, sf_dir, "evidence").select("document_id", "evidence_id", "source_confidence").distinct().withColumn("code", F.when(c.isNull(), "NO_CONFIDENCE").when(c < 0.6, "LOW_CONFIDENCE")).filter("code IS NOT NULL")
    return w.select("document_id", "evidence_id", "code", F.row_number().over(Window.partitionBy("document_id").orderBy("evidence_id", "code")).alias("no"))


@query(f"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z0-9]+(?:\\s[A-Z][a-z0-9]+)*\\b')) AS term FROM documents WHERE text IS NOT NULL), f AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM p GROUP BY 1), st AS (SELECT DISTINCT lower(trim(s)) AS s FROM (SELECT unnest(string_split(text, chr(10))) AS s FROM documents) z WHERE length(trim(s)) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(s), '[.,;:!?]$'))
SELECT term, n AS occurrences, docs AS documents, lower(term) IN (SELECT s FROM st) AS declared, (lower(term) IN (SELECT s FROM st) OR n >= 2) AND NOT lower(term) IN ({_quoted(X.STOP_TERMS)}) AND length(term) >= 3 AND NOT (NOT contains(term, ' ') AND lower(term) IN ({_quoted(X.LEADING)})) AS accepted FROM f""")
def prj_46_47_accepted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised phrases: declared by a line of their own, or met twice; no furniture and no function word."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    p = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z0-9]+(?:\s[A-Z][a-z0-9]+)*\b"), F.lit(0))).alias("term"))
    per = p.groupBy("term", "doc_id").agg(F.count("*").alias("k")).groupBy("term").agg(F.sum("k").alias("occurrences"), F.count("*").alias("documents"))
    s = F.trim("s")
    alone = d.select(F.explode(F.split("text", "\n")).alias("s")).filter(F.length(s).between(1, 60) & ~s.rlike(r"[.,;:!?]$")).select(F.lower(s).alias("low"), F.lit(True).alias("line")).distinct()
    x = per.withColumn("low", F.lower("term")).join(alone, "low", "left")
    declared = F.coalesce("line", F.lit(False))
    ok = (declared | (F.col("occurrences") >= 2)) & ~F.col("low").isin(X.STOP_TERMS) & (F.length("term") >= 3) & ~(~F.contains("term", F.lit(" ")) & F.col("low").isin(X.LEADING))
    return x.select("term", "occurrences", "documents", declared.alias("declared"), ok.alias("accepted"))
