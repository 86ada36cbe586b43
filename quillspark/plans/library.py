"""Queries of the analytic operators on this project's tables, each with the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import learning as L
from quillspark.functions import text as T
from quillspark.operators import cohort, graph, resolve, retrieval
from quillspark.operators.hierarchy import hierarchy
from quillspark.operators.tracing import recent_failures, trace
from quillspark.session import stored, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# ---------------------------------------------------------------- knowledge tracing


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded answers by concept: one row per (interaction, concept)."""
    i = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND correctness IS NOT NULL")
    return i.select("learner_id", "interaction_id", "ts", "correctness", F.explode(F.array_distinct("concept_ids")).alias("concept_id"))


ANSWERS = """
a AS (SELECT DISTINCT learner_id, interaction_id, ts, correctness, unnest(list_distinct(concept_ids)) AS concept_id FROM interactions WHERE learner_id IS NOT NULL AND correctness IS NOT NULL)
"""
_STEP = "round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, post + (1.0::DOUBLE - post) * 0.05::DOUBLE)) * 10000) / 10000"
STATES = f"""
{ANSWERS},
o AS (SELECT learner_id, concept_id, list(CASE WHEN correctness >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY ts, interaction_id) AS obs, epoch_us(max(ts)) AS last_us FROM a GROUP BY 1, 2),
s AS (SELECT learner_id, concept_id, len(obs) AS attempts, CAST(list_sum(obs) AS BIGINT) AS correct, last_us, obs[greatest(1, len(obs) - 9):] AS rec,
      list_reduce(list_prepend(0.30::DOUBLE, obs), lambda p, x: rint_step(p, x)) AS mastery FROM o),
states AS (SELECT *, array_to_string(list_transform(rec, lambda x: CASE WHEN x = 1 THEN '1' ELSE '0' END), '') AS recent FROM s)
""".replace(
    "rint_step(p, x)",
    "round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, (CASE WHEN x = 1 THEN p * 0.95::DOUBLE / (p * 0.95::DOUBLE + (1.0::DOUBLE - p) * 0.33::DOUBLE) ELSE p * 0.05::DOUBLE / (p * 0.05::DOUBLE + (1.0::DOUBLE - p) * 0.67::DOUBLE) END) * 0.95::DOUBLE + 0.05::DOUBLE)) * 10000) / 10000",
)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir)
    return trace(a, F.col("learner_id"), F.col("concept_id"), F.col("interaction_id"), F.col("ts"), F.col("correctness")).withColumnsRenamed({"entity": "learner_id", "item": "concept_id"})


@query(f"WITH {STATES} SELECT learner_id, concept_id, round(mastery, 4) AS mastery, attempts, correct, recent FROM states")
def win_01_02_mastery_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select("learner_id", "concept_id", F.round("mastery", 4).alias("mastery"), "attempts", "correct", "recent")


@query(f"""WITH {STATES}, v AS (SELECT *, length(recent) AS n, length(replace(recent, '0', '')) AS k FROM states),
w AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.35::DOUBLE * n) AS ew, 1.0::DOUBLE - 2.0::DOUBLE * abs(0.5::DOUBLE - k / n) AS vol FROM v)
SELECT learner_id, concept_id, round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, 0.45::DOUBLE * ew + 0.35::DOUBLE * vol * (1.0::DOUBLE - 0.5::DOUBLE * (1.0::DOUBLE - ew)) + 0.2::DOUBLE * 4.0::DOUBLE * mastery * (1.0::DOUBLE - mastery))), 3) AS uncertainty,
       round(0.3::DOUBLE + 0.65::DOUBLE * abs(k / n - 0.5::DOUBLE) * 2.0::DOUBLE * least(1.0::DOUBLE, n / 5.0::DOUBLE), 3) AS confidence FROM w""")
def win_03_04_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(spark, sf_dir)
    n, k = F.length("recent"), F.length(F.replace("recent", F.lit("0"), F.lit("")))
    return s.select("learner_id", "concept_id", F.round(L.uncertainty(n, k, F.col("mastery")), 3).alias("uncertainty"), F.round(L.diagnostic_confidence(n, k), 3).alias("confidence"))


@query(f"""WITH {ANSWERS}, b AS (SELECT DISTINCT learner_id, concept_id, interaction_id, ts, correctness FROM a)
SELECT learner_id, concept_id, interaction_id, CAST(sum(CASE WHEN correctness < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY learner_id, concept_id ORDER BY ts, interaction_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent_failures FROM b""")
def win_06_recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir).dropDuplicates(["learner_id", "concept_id", "interaction_id"])
    return recent_failures(a, ["learner_id", "concept_id"], ["ts", "interaction_id"], F.col("correctness") < 0.5).select("learner_id", "concept_id", "interaction_id", "recent_failures")


@query(f"""WITH {STATES} SELECT learner_id, concept_id, rank, round(mastery, 4) AS mastery FROM (SELECT *, CAST(row_number() OVER (PARTITION BY learner_id ORDER BY mastery, concept_id) AS INTEGER) AS rank FROM states) t WHERE rank <= 5""")
def top_03_weakest_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("learner_id").orderBy("mastery", "concept_id")
    return states(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("learner_id", "concept_id", "rank", F.round("mastery", 4).alias("mastery"))


@query(f"WITH {STATES} SELECT learner_id, count(*) AS weak, string_agg(concept_id, ',' ORDER BY concept_id) AS concept_ids FROM states WHERE attempts >= 2 AND mastery < 0.4 GROUP BY 1")
def top_04_weak_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    weak = states(spark, sf_dir).filter("attempts >= 2 AND mastery < 0.4")
    return weak.groupBy("learner_id").agg(F.count("*").alias("weak"), F.array_join(F.array_sort(F.collect_list("concept_id")), ",").alias("concept_ids"))


# ---------------------------------------------------------------- cohorts


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learners in classes by the first letter of their id; all classes study one subject here."""
    i = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL")
    return i.select(F.concat(F.lit("class_"), F.substring("learner_id", 5, 1)).alias("class_id"), F.lit("all").alias("subject_id"), "learner_id").distinct()


def subject_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "concepts").select(F.lit("all").alias("subject_id"), "concept_id")


ROSTER = "roster AS (SELECT DISTINCT 'class_' || substr(learner_id, 5, 1) AS class_id, learner_id FROM interactions WHERE learner_id IS NOT NULL)"
FULL = f"""{STATES}, {ROSTER},
full_ AS (SELECT r.class_id, r.learner_id, c.concept_id, coalesce(s.mastery, 0.30::DOUBLE) AS m, coalesce(s.attempts, 0) AS att FROM roster r CROSS JOIN concepts c LEFT JOIN states s ON s.learner_id = r.learner_id AND s.concept_id = c.concept_id)"""


@query(f"""WITH {FULL}, l AS (SELECT class_id, concept_id, list(m ORDER BY m) AS v, count(*) AS n, sum(m) AS sm, sum(att) AS sa FROM full_ GROUP BY 1, 2)
SELECT class_id, concept_id, n AS enrolled, round(sm / n, 10) AS mean_mastery, round((v[CAST(floor((n - 1) / 2) AS BIGINT) + 1] + v[CAST(floor(n / 2) AS BIGINT) + 1]) / 2, 10) AS median_mastery,
       v[CAST(floor(0.25 * n) AS BIGINT) + 1] AS p25_mastery, v[CAST(floor(0.75 * n) AS BIGINT) + 1] AS p75_mastery,
       round(len(list_filter(v, lambda x: x >= 0.7::DOUBLE)) / n, 6) AS share_mastered, round(len(list_filter(v, lambda x: x < 0.4::DOUBLE)) / n, 6) AS share_struggling, round(CAST(sa AS DOUBLE) / n, 10) AS mean_attempts FROM l""")
def agg_01_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.concept_distribution(states(spark, sf_dir), roster(spark, sf_dir), subject_concepts(spark, sf_dir))


@query(f"""WITH {FULL}, e AS (SELECT DISTINCT source_concept_id AS source, target_concept_id AS target FROM prerequisite_links WHERE document_id LIKE 'doc_0%'),
sz AS (SELECT class_id, count(*) AS n FROM roster GROUP BY 1)
SELECT x.class_id, e.source, e.target, CAST(count(*) AS BIGINT) AS affected, round(count(*) / max(sz.n), 2) AS severity
FROM full_ x JOIN e ON x.concept_id = e.source JOIN full_ y ON y.learner_id = x.learner_id AND y.concept_id = e.target JOIN sz ON sz.class_id = x.class_id
WHERE x.m < 0.5 AND y.m < 0.5 GROUP BY 1, 2, 3""".replace(" WHERE document_id LIKE 'doc_0%'", ""))
def agg_03_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "prerequisite_links").select(F.lit("all").alias("subject_id"), F.col("source_concept_id").alias("source"), F.col("target_concept_id").alias("target")).distinct()
    return cohort.bottlenecks(states(spark, sf_dir), roster(spark, sf_dir), e)


@query(f"""WITH {FULL}, c AS (SELECT class_id, concept_id, avg(m) AS m FROM full_ GROUP BY 1, 2) SELECT class_id, round(avg(m), 8) AS readiness FROM c GROUP BY 1""")
def agg_05_class_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cohort.concept_distribution(states(spark, sf_dir), roster(spark, sf_dir), subject_concepts(spark, sf_dir))
    return d.groupBy("class_id").agg(F.round(F.avg("mean_mastery"), 8).alias("readiness"))


@query(f"""WITH {STATES} SELECT learner_id, count(*) AS concepts, count(*) FILTER (mastery >= 0.7) AS mastered, count(*) FILTER (mastery >= 0.4 AND mastery < 0.7) AS developing, count(*) FILTER (mastery < 0.4) AS struggling,
CAST(sum(attempts) AS BIGINT) AS attempts, round(sum(correct) / sum(attempts), 6) AS accuracy, arg_min(concept_id, (mastery, concept_id)) AS weakest, round(avg(mastery), 10) AS mean_mastery FROM states GROUP BY 1""")
def agg_06_07_learner_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.learner_rollup(states(spark, sf_dir))


@query(f"""WITH {STATES} SELECT concept_id, count(*) AS learners, round(avg(mastery), 10) AS mean_mastery, round(coalesce(var_pop(mastery), 0), 10) AS variance, round(count(*) FILTER (mastery < 0.4) / count(*), 6) AS low,
round(count(*) FILTER (mastery >= 0.4 AND mastery < 0.7) / count(*), 6) AS mid, round(count(*) FILTER (mastery >= 0.7) / count(*), 6) AS high FROM states GROUP BY 1""")
def agg_24_mastery_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.mastery_audit(states(spark, sf_dir))


@query(f"""WITH {STATES}, {ROSTER} SELECT class_id, concept_id, count(*) AS states, round(avg(mastery), 10) AS mean_mastery, CAST(grouping(class_id, concept_id) AS INTEGER) AS level FROM states JOIN roster USING (learner_id) GROUP BY ROLLUP (class_id, concept_id)""")
def agg_rollup_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.rollup(states(spark, sf_dir), roster(spark, sf_dir))


_GAPS = f"""{STATES}, v AS (SELECT *, length(recent) AS n, length(replace(recent, '0', '')) AS k FROM states),
w AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.35::DOUBLE * n) AS ew, 1.0::DOUBLE - 2.0::DOUBLE * abs(0.5::DOUBLE - k / n) AS vol FROM v),
u AS (SELECT *, round(greatest(0.01::DOUBLE, least(0.99::DOUBLE, 0.45::DOUBLE * ew + 0.35::DOUBLE * vol * (1.0::DOUBLE - 0.5::DOUBLE * (1.0::DOUBLE - ew)) + 0.2::DOUBLE * 4.0::DOUBLE * mastery * (1.0::DOUBLE - mastery))), 4) AS un FROM w),
dn AS (SELECT source_concept_id AS concept_id, count(*) AS downstream FROM prerequisite_links GROUP BY 1),
pr AS (SELECT DISTINCT source_concept_id AS p, target_concept_id AS concept_id FROM prerequisite_links),
wk AS (SELECT u.learner_id, u.concept_id, count(*) AS weak FROM u JOIN pr USING (concept_id) LEFT JOIN u q ON q.learner_id = u.learner_id AND q.concept_id = pr.p WHERE coalesce(q.mastery, 0.3) < 0.5 GROUP BY 1, 2),
g AS (SELECT u.learner_id, u.concept_id, u.mastery, u.un, coalesce(dn.downstream, 0) AS downstream, coalesce(wk.weak, 0) AS weak, (attempts < 3 OR un > 0.4) AS thin, mastery < 0.5 AS low FROM u LEFT JOIN dn USING (concept_id) LEFT JOIN wk USING (learner_id, concept_id))"""


@query(f"""WITH {_GAPS} SELECT * FROM (SELECT learner_id, concept_id, downstream, weak AS weak_prerequisites,
array_to_string(list_filter([CASE WHEN thin THEN 'INSUFFICIENT_EVIDENCE' END, CASE WHEN low THEN 'LOW_MASTERY' END, CASE WHEN weak > 0 THEN 'WEAK_PREREQUISITE' END, CASE WHEN (low OR thin) AND downstream >= 2 THEN 'HIGH_DOWNSTREAM_IMPACT' END], lambda x: x IS NOT NULL), ',') AS reasons,
CASE WHEN low THEN 'LOW_MASTERY' WHEN thin THEN 'INSUFFICIENT_EVIDENCE' WHEN weak > 0 THEN 'WEAK_PREREQUISITE' ELSE 'HIGH_DOWNSTREAM_IMPACT' END AS gap_type FROM g) t WHERE reasons <> ''""")
def jn_09_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "prerequisite_links").select(F.col("source_concept_id").alias("source"), F.col("target_concept_id").alias("target"))
    return cohort.gaps(states(spark, sf_dir), links).select("learner_id", "concept_id", "downstream", "weak_prerequisites", "reasons", "gap_type")


@query(f"""WITH {_GAPS} SELECT * FROM (SELECT learner_id, concept_id, round(0.35::DOUBLE * (1.0::DOUBLE - mastery) + 0.2::DOUBLE * un + CASE WHEN weak > 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + 0.15::DOUBLE * least(1.0::DOUBLE, downstream / 5.0::DOUBLE), 6) AS priority,
CAST(row_number() OVER (PARTITION BY learner_id ORDER BY round(0.35::DOUBLE * (1.0::DOUBLE - mastery) + 0.2::DOUBLE * un + CASE WHEN weak > 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + 0.15::DOUBLE * least(1.0::DOUBLE, downstream / 5.0::DOUBLE), 6) DESC, concept_id) AS INTEGER) AS rank
FROM g WHERE low OR thin OR weak > 0) t WHERE rank <= 10""")
def top_01_gap_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "prerequisite_links").select(F.col("source_concept_id").alias("source"), F.col("target_concept_id").alias("target"))
    g = cohort.gaps(states(spark, sf_dir), links)
    g = g.withColumn("priority", F.round(L.gap_priority(F.col("mastery"), F.col("uncertainty"), F.col("weak_prerequisites") > 0, F.col("downstream")), 6))
    w = Window.partitionBy("learner_id").orderBy(F.col("priority").desc(), "concept_id")
    return g.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("learner_id", "concept_id", "priority", "rank")


# ---------------------------------------------------------------- item selection and grading


_QUESTIONS = "q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY exposure_count DESC NULLS LAST, created_at DESC) AS rn FROM questions) t WHERE rn = 1)"


@query(f"""WITH {_QUESTIONS} SELECT question_id, exposure_count FROM q""")
def src_24_latest_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest export of each question: an upsert by key."""
    return resolve.latest(table(spark, sf_dir, "questions"), ["question_id"], ["exposure_count", "created_at"]).select("question_id", "exposure_count")


_BH = "(-(greatest(1e-7, least(1.0 - 1e-7, {p})) * log2(greatest(1e-7, least(1.0 - 1e-7, {p}))) + (1.0 - greatest(1e-7, least(1.0 - 1e-7, {p}))) * log2(1.0 - greatest(1e-7, least(1.0 - 1e-7, {p})))))"
_IG = f"""d AS (SELECT *, greatest(0.02::DOUBLE, least(0.40::DOUBLE, 0.10::DOUBLE / greatest(0.1::DOUBLE, least(2.0::DOUBLE, coalesce(information_value, 1.0))))) AS sl, greatest(0.05::DOUBLE, least(0.45::DOUBLE, 0.25::DOUBLE / greatest(0.1::DOUBLE, least(2.0::DOUBLE, coalesce(information_value, 1.0))))) AS gu FROM base),
r AS (SELECT *, p * (1.0 - sl) + (1.0 - p) * gu AS ok FROM d),
t AS (SELECT *, p * (1.0 - sl) / ok AS pr, p * sl / (1.0 - ok) AS pw FROM r),
i AS (SELECT *, greatest(0.0::DOUBLE, {_BH.format(p='p')} - ok * {_BH.format(p='pr')} - (1.0 - ok) * {_BH.format(p='pw')}) AS gain FROM t)"""


@query(f"""WITH {_QUESTIONS}, base AS (SELECT question_id, information_value, coalesce(difficulty, 0.5::DOUBLE) AS p, coalesce(exposure_count, 0) AS ex FROM q), {_IG}
SELECT question_id, round(gain, 6) AS gain, round(0.5::DOUBLE * gain + 0.3::DOUBLE * 0.85::DOUBLE + 0.2::DOUBLE / (1.0 + ex), 6) AS score FROM i""")
def mth_03_information_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain and selection score of each question for a learner whose mastery equals its difficulty."""
    q = resolve.latest(table(spark, sf_dir, "questions"), ["question_id"], ["exposure_count", "created_at"])
    gain = L.information_gain(F.coalesce("difficulty", F.lit(0.5)), F.coalesce("information_value", F.lit(1.0)))
    return q.select("question_id", F.round(gain, 6).alias("gain"), F.round(L.item_score(gain, F.lit(0.85), F.coalesce("exposure_count", F.lit(0))), 6).alias("score"))


@query(f"""WITH {STATES}, h AS (SELECT learner_id, concept_id, mastery / sum(mastery) OVER (PARTITION BY learner_id) AS p FROM states)
SELECT learner_id, round(sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END), 5) + 0.0::DOUBLE AS entropy FROM h GROUP BY 1""")
def mth_01_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy of each learner's mastery shares."""
    s = states(spark, sf_dir)
    total = s.groupBy("learner_id").agg(F.sum("mastery").alias("t"))
    return s.join(total, "learner_id").groupBy("learner_id").agg((F.round(F.sum(L.plog2p(F.col("mastery") / F.col("t"))), 5) + 0.0).alias("entropy"))


@query(r"""WITH i AS (SELECT DISTINCT interaction_id, question_id, question_type, response FROM interactions), """ + _QUESTIONS + r""",
j AS (SELECT i.interaction_id, i.question_type AS k, lower(trim(i.response)) AS r, lower(trim(q.correct_answer)) AS e FROM i JOIN q USING (question_id)),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(r, '^[+-]?\d+(\.\d+)?'), '') AS DOUBLE) AS rn, TRY_CAST(nullif(regexp_extract(e, '^[+-]?\d+(\.\d+)?'), '') AS DOUBLE) AS en,
 list_distinct(regexp_extract_all(r, '[\p{L}\p{N}]+')) AS rw, list_distinct(regexp_extract_all(e, '[\p{L}\p{N}]+')) AS ew FROM j)
SELECT interaction_id, CAST(CASE WHEN r IS NULL OR e IS NULL THEN 0 WHEN k = 'mcq' THEN CASE WHEN r = e THEN 1 ELSE 0 END
 WHEN k = 'true_false' THEN CASE WHEN (r IN ('true','t','yes','1') AND e IN ('true','t','yes','1')) OR (r IN ('false','f','no','0') AND e IN ('false','f','no','0')) THEN 1 ELSE 0 END
 WHEN k = 'numerical' THEN coalesce(CASE WHEN en = 0 THEN CASE WHEN abs(rn) <= 1e-5 THEN 1 ELSE 0 END ELSE CASE WHEN abs(rn - en) <= 0.02::DOUBLE * abs(en) THEN 1 WHEN rn IS NOT NULL AND en IS NOT NULL THEN 0 END END, 0)
 ELSE CASE WHEN len(ew) > 0 THEN round(len(list_intersect(rw, ew)) / len(ew), 2) ELSE 0 END END AS DOUBLE) AS grade FROM n""")
def mth_14_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses graded against the newest export of their question."""
    q = resolve.latest(table(spark, sf_dir, "questions"), ["question_id"], ["exposure_count", "created_at"]).select("question_id", "correct_answer")
    i = table(spark, sf_dir, "interactions").select("interaction_id", "question_id", "question_type", "response").distinct()
    return i.join(q, "question_id").select("interaction_id", L.grade(F.col("question_type"), F.col("response"), F.col("correct_answer")).alias("grade"))


# ---------------------------------------------------------------- retrieval

_TOKENS = """
{name} AS (SELECT id, CASE WHEN length(w) <= 4 THEN w WHEN w LIKE '%ses' OR w LIKE '%xes' OR w LIKE '%zes' OR w LIKE '%ches' OR w LIKE '%shes' THEN left(w, length(w) - 2)
  WHEN w LIKE '%ies' AND length(w) > 5 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS t
  FROM (SELECT id, unnest(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[a-z0-9_]+')) AS w FROM {src}) z WHERE w NOT IN ({stop}))
"""
_DOC_TOKENS = _TOKENS.format(name="dt", src="(SELECT doc_id AS id, text FROM documents)", stop=_quoted(T.STOP_TOKENS))
_QUERY_TOKENS = _TOKENS.format(name="qt", src="(SELECT item_id AS id, text FROM eval_items)", stop=_quoted(T.STOP_TOKENS))
_BM25 = f"""{_DOC_TOKENS}, {_QUERY_TOKENS},
nd AS (SELECT count(*) AS n_docs FROM documents), ln AS (SELECT d.doc_id AS id, count(dt.t) AS len FROM documents d LEFT JOIN dt ON dt.id = d.doc_id GROUP BY 1), av AS (SELECT avg(len) AS avg_len FROM ln),
tf AS (SELECT id, t, count(*) AS tf FROM dt GROUP BY 1, 2), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT id AS query, t FROM qt), nq AS (SELECT query, count(*) AS nq FROM q GROUP BY 1),
bm AS (SELECT q.query, tf.id, count(*) AS matched, max(nq.nq) AS nq, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * greatest(ln.len, 1) / avg_len))) / max(nq.nq) AS score
  FROM q JOIN tf USING (t) JOIN df USING (t) JOIN ln ON ln.id = tf.id JOIN nq ON nq.query = q.query CROSS JOIN nd CROSS JOIN av GROUP BY 1, 2)"""
_COS = """
w AS (SELECT tf.id, tf.t, (1 + ln(tf.tf)) * ln(1.0 + n_docs / df) AS w FROM tf JOIN df USING (t) CROSS JOIN nd), nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
qw AS (SELECT z.id AS query, z.t, (1 + ln(z.tf)) * ln(1.0 + n_docs / coalesce(df, 1)) AS w FROM (SELECT id, t, count(*) AS tf FROM qt GROUP BY 1, 2) z LEFT JOIN df USING (t) CROSS JOIN nd), qn AS (SELECT query, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
cs AS (SELECT qw.query, w.id, sum(qw.w * w.w) / (max(nm.norm) * max(qn.norm)) AS score FROM qw JOIN w USING (t) JOIN nm ON nm.id = w.id JOIN qn ON qn.query = qw.query GROUP BY 1, 2)"""
_RANK = "SELECT query, id, round(score, 9) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id DESC) AS INTEGER) AS rank FROM {src}) z WHERE rank <= {k}"


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    # Tokens are read by several passes, so they are made once.
    return stored(retrieval.tokenised(d, F.col("doc_id"), F.col("text"))), stored(retrieval.tokenised(q, F.col("item_id"), F.col("text")))


def _scored(df: DataFrame) -> DataFrame:
    return df.select("query", "id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {_BM25}, h AS (SELECT * FROM bm WHERE matched >= greatest(1, nq // 2)) {_RANK.format(src='h', k=8)}")
def top_05_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best documents of each evaluation item; half of its terms must occur."""
    return _scored(retrieval.bm25(*_chunks(spark, sf_dir)))


@query(f"WITH {_BM25} {_RANK.format(src='bm', k=20)}")
def top_06_bm25_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(retrieval.bm25(*_chunks(spark, sf_dir), k=20, half_match=False))


@query(f"WITH {_BM25}, {_COS} {_RANK.format(src='cs', k=20)}")
def top_07_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(retrieval.cosine(*_chunks(spark, sf_dir)))


_GRAPH = """
nm2 AS (SELECT concept_id, lower(canonical_name) AS name FROM concepts WHERE length(canonical_name) > 0), qd AS (SELECT DISTINCT id AS query, t FROM qt WHERE length(t) > 0),
seed AS (SELECT DISTINCT query, concept_id AS c FROM qd JOIN nm2 ON contains(name, t) OR contains(t, name)),
ed AS (SELECT source_concept_id AS u, target_concept_id AS v FROM prerequisite_links UNION SELECT target_concept_id, source_concept_id FROM prerequisite_links),
o1 AS (SELECT DISTINCT query, c AS seed, v FROM seed JOIN ed ON c = u), o2 AS (SELECT DISTINCT query, ed.v FROM o1 JOIN ed ON o1.v = ed.u WHERE ed.v <> o1.seed),
rc AS (SELECT query, c, max(s) AS s FROM (SELECT query, c, 1.0 AS s FROM seed UNION ALL SELECT query, v, 0.6 FROM o1 UNION ALL SELECT query, v, 0.3 FROM o2) z GROUP BY 1, 2),
gr AS (SELECT query, d.doc_id AS id, CAST(max(s) AS DOUBLE) AS score FROM rc JOIN (SELECT DISTINCT doc_id, unnest(concept_ids) AS c FROM documents) d ON d.c = rc.c GROUP BY 1, 2)"""


def _graph(spark: SparkSession, sf_dir: str, queries: DataFrame) -> DataFrame:
    c = table(spark, sf_dir, "concepts").select("concept_id", F.col("canonical_name").alias("name"))
    e = table(spark, sf_dir, "prerequisite_links").select(F.col("source_concept_id").alias("u"), F.col("target_concept_id").alias("v")).distinct()
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct("concept_ids")).alias("concept_id"))
    return retrieval.graph_channel(queries, c, e, d)


@query(f"WITH {_QUERY_TOKENS}, {_GRAPH} SELECT query, id, score FROM gr")
def grf_12_graph_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir, _chunks(spark, sf_dir)[1])


@query(f"""WITH {_BM25}, {_COS}, {_GRAPH}, rb AS ({_RANK.format(src='bm', k=20)}), rv AS ({_RANK.format(src='cs', k=20)}), rg AS ({_RANK.format(src='gr', k=1000000000)}),
f AS (SELECT query, id, sum(s) AS score FROM (SELECT query, id, 1.0::DOUBLE / (60 + rank) AS s FROM rb UNION ALL SELECT query, id, 0.8::DOUBLE / (60 + rank) FROM rv UNION ALL SELECT query, id, 0.7::DOUBLE / (60 + rank) FROM rg) z GROUP BY 1, 2)
{_RANK.format(src='f', k=8)}""")
def top_08_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, queries = _chunks(spark, sf_dir)
    chunks = retrieval.Index(chunks)
    g = _graph(spark, sf_dir, queries)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").desc())
    channels = {"lexical": retrieval.bm25(chunks, queries, k=20, half_match=False), "vector": retrieval.cosine(chunks, queries), "graph": g.withColumn("rank", F.row_number().over(w))}
    return _scored(retrieval.fuse(channels))
