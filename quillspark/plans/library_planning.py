"""Diagnosis, verification, paths and learner views, each with the SQL that must agree with it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import learning as L
from quillspark.operators import cohort, planning, resolve
from quillspark.operators.hierarchy import hierarchy
from quillspark.operators.tracing import trajectory
from quillspark.plans.library import _GAPS, _IG, _QUESTIONS, ANSWERS, ROSTER, STATES, answers, query, roster, states
from quillspark.plans.library_text import _REACH, doc_links
from quillspark.session import stored, table, tables_dir, unsent
from quillspark.sources import store

UNSURE = _GAPS.split("\ndn AS")[0].rstrip().rstrip(",")


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree, node, ancestor): all a concept rests on within its document; not itself, even on a cycle."""
    h = hierarchy(doc_links(spark, sf_dir).select(F.lit("p").alias("hierarchy"), "tree", F.col("target").alias("parent"), F.col("source").alias("child")))
    return h.select("tree", "node", F.explode("descendants").alias("ancestor")).filter("node != ancestor")


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.latest(table(spark, sf_dir, "questions"), ["question_id"], ["exposure_count", "created_at"])


def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(learner_id, concept_id, n): wrong responses a learner gave twice or more to the same question."""
    i = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND correctness < 0.5 AND response IS NOT NULL AND question_id IS NOT NULL")
    i = i.select("learner_id", "interaction_id", "question_id", "response", F.explode(F.array_distinct("concept_ids")).alias("concept_id")).distinct()
    twice = i.groupBy("learner_id", "concept_id", "question_id", "response").agg(F.count("*").alias("k")).filter("k >= 2")
    return twice.groupBy("learner_id", "concept_id").agg(F.count("*").alias("n"))


def goals(spark: SparkSession, sf_dir: str, s: DataFrame) -> DataFrame:
    return planning.targets(s, doc_links(spark, sf_dir))


def _hypotheses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s, up = stored(states(spark, sf_dir)), stored(ancestors(spark, sf_dir))
    return s, up, planning.hypotheses(s, goals(spark, sf_dir, s), up, supported(spark, sf_dir))


GOALS = f"""{UNSURE}, {_REACH},
hm AS (SELECT c AS concept_id, min(tree) AS tree FROM (SELECT tree, a AS c FROM l UNION ALL SELECT tree, b FROM l) z GROUP BY 1),
tg AS (SELECT learner_id, arg_min(hm.tree, (mastery, u.concept_id)) AS tree, arg_min(u.concept_id, (mastery, u.concept_id)) AS target FROM u JOIN hm ON hm.concept_id = u.concept_id GROUP BY 1)"""
HYPOTHESES = f"""{GOALS},
sup AS (SELECT learner_id, concept_id, count(*) AS n FROM (SELECT learner_id, c AS concept_id, question_id, response FROM (SELECT DISTINCT learner_id, interaction_id, question_id, response, unnest(list_distinct(concept_ids)) AS c
  FROM interactions WHERE learner_id IS NOT NULL AND correctness < 0.5 AND response IS NOT NULL AND question_id IS NOT NULL) z GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2) y GROUP BY 1, 2),
hc AS (SELECT learner_id, tree, target, target AS concept_id FROM tg UNION SELECT tg.learner_id, tg.tree, target, r.a FROM tg JOIN r ON r.tree = tg.tree AND r.b = tg.target),
hw AS (SELECT hc.learner_id, hc.tree, hc.target, hc.concept_id, (1.0::DOUBLE - coalesce(u.mastery, 0.3::DOUBLE)) * (0.5::DOUBLE + 0.5::DOUBLE * coalesce(u.un, 0.85::DOUBLE)) + 0.1::DOUBLE + 0.3::DOUBLE * coalesce(sup.n, 0) AS w
  FROM hc LEFT JOIN u ON u.learner_id = hc.learner_id AND u.concept_id = hc.concept_id LEFT JOIN sup ON sup.learner_id = hc.learner_id AND sup.concept_id = hc.concept_id),
hy AS (SELECT *, round(w / sum(w) OVER (PARTITION BY learner_id, tree, target), 4) AS prior FROM hw)"""


@query(f"WITH RECURSIVE {HYPOTHESES} SELECT learner_id, tree, target, concept_id, prior FROM hy")
def mth_05_hypothesis_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the gap behind each learner's weakest concept may lie, by the learner's own mastery, uncertainty and repeated errors."""
    return _hypotheses(spark, sf_dir)[2].select("learner_id", "tree", "target", "concept_id", "prior")


GAINS = f"""{HYPOTHESES}, {_QUESTIONS}, qs AS (SELECT document_id AS tree, question_id, concept_ids[1] AS asked FROM q WHERE len(concept_ids) > 0),
gx AS (SELECT hy.learner_id, hy.tree, hy.target, qs.question_id, qs.asked, prior / sum(prior) OVER (PARTITION BY hy.learner_id, hy.tree, hy.target, qs.question_id) AS p,
  greatest(0.001::DOUBLE, least(0.999::DOUBLE, CASE WHEN qs.asked = hy.concept_id OR r.a IS NOT NULL THEN 0.25::DOUBLE WHEN k.mastery IS NOT NULL THEN k.mastery * 0.9::DOUBLE + (1.0::DOUBLE - k.mastery) * 0.25::DOUBLE ELSE 0.9::DOUBLE END)) AS ok
  FROM hy JOIN qs ON qs.tree = hy.tree LEFT JOIN r ON r.tree = hy.tree AND r.b = qs.asked AND r.a = hy.concept_id LEFT JOIN u k ON k.learner_id = hy.learner_id AND k.concept_id = qs.asked),
gs AS (SELECT learner_id, tree, target, question_id, asked, round(greatest(0, sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END)), 6) AS h, sum(p * ok) AS py, sum(p * (1.0 - ok)) AS pn,
  sum(CASE WHEN p > 0 THEN p * ok * log2(p * ok) ELSE 0 END) AS ly, sum(CASE WHEN p > 0 THEN p * (1.0 - ok) * log2(p * (1.0 - ok)) ELSE 0 END) AS ln_ FROM gx GROUP BY 1, 2, 3, 4, 5),
gg AS (SELECT learner_id, tree, target, question_id, asked, h AS prior_entropy, round(py + 1e-9, 4) AS marginal_correct,
  greatest(0, round(h - py * round(greatest(0, log2(py) - ly / py), 6) - pn * round(greatest(0, log2(pn) - ln_ / pn), 6), 6)) AS gain FROM gs)"""


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, up, h = _hypotheses(spark, sf_dir)
    q = newest(spark, sf_dir).filter(F.size("concept_ids") > 0).select(F.col("document_id").alias("tree"), "question_id", F.element_at("concept_ids", 1).alias("asked"))
    return planning.question_gains(h, q, up, s)


@query(f"WITH RECURSIVE {GAINS} SELECT learner_id, question_id, asked, gain, prior_entropy, marginal_correct FROM gg")
def mth_04_hypothesis_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question of the learner's document would tell about where the gap lies."""
    return _gains(spark, sf_dir).select("learner_id", "question_id", "asked", "gain", "prior_entropy", "marginal_correct")


@query(f"WITH RECURSIVE {GAINS} SELECT learner_id, tree, target, arg_min(question_id, (-gain, question_id)) AS question_id, max(gain) AS gain, count(*) AS candidates FROM gg GROUP BY 1, 2, 3")
def top_10_root_gap_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question that tells most about where a learner's gap lies."""
    return planning.best_question(_gains(spark, sf_dir)).select("learner_id", "tree", "target", "question_id", "gain", "candidates")


_TURNS = """, tq AS (SELECT tg.learner_id, tg.tree, i.interaction_id, i.ts, i.correctness >= 0.5 AS correct, qs.asked FROM tg JOIN (SELECT DISTINCT learner_id, interaction_id, question_id, ts, correctness FROM interactions WHERE correctness IS NOT NULL AND NOT isnan(correctness)) i ON i.learner_id = tg.learner_id JOIN qs ON qs.question_id = i.question_id AND qs.tree = tg.tree),
tn AS (SELECT *, row_number() OVER (PARTITION BY learner_id, tree ORDER BY ts, interaction_id) AS turn FROM tq)"""


@query(f"""WITH RECURSIVE {HYPOTHESES}, {_QUESTIONS}, qs AS (SELECT document_id AS tree, question_id, concept_ids[1] AS asked FROM q WHERE len(concept_ids) > 0){_TURNS},
bl AS (SELECT hy.learner_id, hy.tree, hy.target, hy.concept_id, hy.prior, list(CASE WHEN tn.correct THEN k ELSE 1.0::DOUBLE - k END ORDER BY tn.turn) FILTER (tn.turn IS NOT NULL) AS likes FROM
  (SELECT hy.*, tn.turn, CASE WHEN tn.asked = hy.concept_id OR r.a IS NOT NULL THEN 0.25::DOUBLE ELSE 0.9::DOUBLE END AS k FROM hy LEFT JOIN tn ON tn.learner_id = hy.learner_id AND tn.tree = hy.tree AND tn.turn <= 5 LEFT JOIN r ON r.tree = hy.tree AND r.b = tn.asked AND r.a = hy.concept_id) hy
  LEFT JOIN tn ON tn.learner_id = hy.learner_id AND tn.tree = hy.tree AND tn.turn = hy.turn GROUP BY 1, 2, 3, 4, 5),
bh AS (SELECT learner_id, tree, target, list(concept_id ORDER BY concept_id) AS c, list(prior ORDER BY concept_id) AS p0, list(likes ORDER BY concept_id) AS ks, max(coalesce(len(likes), 0)) AS n FROM bl GROUP BY 1, 2, 3),
bt AS (SELECT *, list_transform(generate_series(1, n), lambda t: list_transform(ks, lambda k: k[t])) AS turns FROM bh),
bs AS (SELECT *, list_reduce(list_prepend(p0 || [0.0::DOUBLE, 0.0::DOUBLE], turns), lambda s, y: CASE WHEN s[len(s) - 1] = 1 THEN s ELSE
  list_transform([list_transform(generate_series(1, len(s) - 2), lambda i: s[i] * y[i])], lambda z: list_transform([list_transform(z, lambda v: round(v / CASE WHEN list_sum(z) > 0 THEN list_sum(z) ELSE 1 END, 4))],
  lambda p: p || [CASE WHEN list_max(p) >= 0.75 OR round(list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN -v * log2(v) ELSE 0 END)), 6) <= 0.4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, s[len(s)] + 1])[1])[1] END) AS s FROM bt),
be AS (SELECT learner_id, target, c, s, CAST(s[len(s)] AS INTEGER) AS asked, round(list_sum(list_transform(s[1 : len(s) - 2], lambda v: CASE WHEN v > 0 THEN -v * log2(v) ELSE 0 END)), 6) AS entropy, list_max(s[1 : len(s) - 2]) AS top FROM bs)
SELECT learner_id, target, concept_id, posterior, CASE WHEN asked = 0 THEN 'active' WHEN posterior >= 0.75 THEN 'confirmed' WHEN posterior <= 0.05 THEN 'eliminated' ELSE 'active' END AS status, asked, entropy, top >= 0.75 OR entropy <= 0.4 OR asked >= 5 AS complete
FROM (SELECT learner_id, target, asked, entropy, top, unnest(c) AS concept_id, unnest(s[1 : len(s) - 2]) AS posterior FROM be) z""")
def mth_06_07_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses after the learner's first five answers in the document, and whether the diagnosis is complete."""
    s, up, h = _hypotheses(spark, sf_dir)
    q = newest(spark, sf_dir).filter(F.size("concept_ids") > 0).select(F.col("document_id").alias("tree"), "question_id", F.element_at("concept_ids", 1).alias("asked"))
    i = table(spark, sf_dir, "interactions").filter("correctness IS NOT NULL AND NOT isnan(correctness)").select("learner_id", "interaction_id", "question_id", "ts", "correctness").distinct()
    mine = i.join(goals(spark, sf_dir, s).select("learner_id", "tree"), "learner_id").join(unsent(q), ["tree", "question_id"])
    w = Window.partitionBy("learner_id", "tree").orderBy("ts", "interaction_id")
    turns = mine.withColumn("turn", F.row_number().over(w)).filter("turn <= 5").select("learner_id", "tree", "asked", (F.col("correctness") >= 0.5).alias("correct"), "turn")
    b = planning.beliefs(h, turns, up)
    return b.select("learner_id", "target", "concept_id", "posterior", "status", "asked", "entropy", "complete")


# ---------------------------------------------------------------- verification


def claims(s: DataFrame) -> DataFrame:
    """Self-assessments, made up from the states: what is known and how sure."""
    status = F.when(F.col("attempts") % 3 == 0, "KNOW").when(F.col("attempts") % 3 == 1, "DONT_KNOW").otherwise("UNANSWERED")
    sure = F.when(F.col("correct") % 3 == 0, "LOW").when(F.col("correct") % 3 == 1, "MEDIUM").otherwise("HIGH")
    return s.select("learner_id", "concept_id", status.alias("status"), sure.alias("confidence"))


CLAIMS = """cl AS (SELECT learner_id, concept_id, mastery, attempts, CASE attempts % 3 WHEN 0 THEN 'KNOW' WHEN 1 THEN 'DONT_KNOW' ELSE 'UNANSWERED' END AS status, CASE correct % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM states),
vf AS (SELECT learner_id, concept_id, mastery, attempts, status, confidence, CASE status || confidence WHEN 'UNANSWEREDLOW' THEN 1.0 WHEN 'KNOWLOW' THEN 0.9 WHEN 'KNOWMEDIUM' THEN 0.8 WHEN 'KNOWHIGH' THEN 0.7 WHEN 'UNANSWEREDMEDIUM' THEN 0.6 WHEN 'UNANSWEREDHIGH' THEN 0.55 ELSE 0.5 END::DOUBLE AS priority,
  CASE WHEN status = 'KNOW' AND confidence = 'HIGH' THEN 1 ELSE 2 END AS cap FROM cl WHERE status <> 'DONT_KNOW')"""


@query(f"WITH {STATES}, {CLAIMS} SELECT learner_id, concept_id, status, priority, cap FROM vf")
def set_03_mth_09_19_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each learner's quiz has to verify, with the priority and the number of questions of each concept."""
    return planning.to_verify(claims(states(spark, sf_dir))).select("learner_id", "concept_id", "status", "priority", "cap")


CANDIDATES = f"""{STATES}, {CLAIMS}, {_QUESTIONS}, cq AS (SELECT question_id, coalesce(difficulty, 0.5) AS difficulty, information_value, concept_ids[1] AS first, unnest(list_distinct(concept_ids)) AS concept_id FROM q WHERE len(options) >= 2),
cd AS (SELECT learner_id, question_id, max(priority) AS priority, round(2.0::DOUBLE + 2.0::DOUBLE * count(*) - 1.5::DOUBLE * abs(max(difficulty) - 0.5::DOUBLE), 6) AS score FROM cq JOIN vf USING (concept_id) GROUP BY 1, 2)"""


@query(f"WITH {CANDIDATES} SELECT learner_id, question_id, priority, score FROM cd")
def set_04_top_24_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.candidates_beside(planning.to_verify(claims(states(spark, sf_dir))), newest(spark, sf_dir))


@query()
def top_11_quiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verification quiz of each learner: greedy by priority and score within the caps."""
    return planning.quizzes(planning.to_verify(claims(states(spark, sf_dir))), newest(spark, sf_dir))


@query(f"""WITH {STATES}, {CLAIMS}, k AS (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY priority DESC, concept_id) AS rn FROM vf) SELECT learner_id, string_agg(concept_id, ',' ORDER BY rn) AS concept_ids FROM k WHERE rn <= 4 GROUP BY 1""")
def top_23_verification_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four concepts to verify first."""
    w = Window.partitionBy("learner_id").orderBy(F.col("priority").desc(), "concept_id")
    v = planning.to_verify(claims(states(spark, sf_dir))).withColumn("rn", F.row_number().over(w)).filter("rn <= 4")
    return v.groupBy("learner_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "concept_id"))), lambda x: x["concept_id"]), ",").alias("concept_ids"))


_ASKED = """, ak AS (SELECT learner_id, question_id FROM (SELECT *, row_number() OVER (PARTITION BY learner_id ORDER BY ts, interaction_id) AS rn FROM (SELECT DISTINCT learner_id, interaction_id, question_id, ts FROM interactions WHERE learner_id IS NOT NULL AND question_id IS NOT NULL) z) y WHERE rn <= 3 GROUP BY 1, 2)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND question_id IS NOT NULL").select("learner_id", "interaction_id", "question_id", "ts").distinct()
    w = Window.partitionBy("learner_id").orderBy("ts", "interaction_id")
    return i.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("learner_id", "question_id").distinct()


@query(f"""WITH {CANDIDATES}{_ASKED}, us AS (SELECT learner_id, c AS concept_id, count(*) AS used FROM (SELECT ak.learner_id, ak.question_id, unnest(list_distinct(q.concept_ids)) AS c FROM ak JOIN q USING (question_id)) z GROUP BY 1, 2)
SELECT learner_id, concept_id, used FROM us""")
def win_17_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked so far by concept, of each learner's first three answers."""
    q = newest(spark, sf_dir).select("question_id", F.explode(F.array_distinct("concept_ids")).alias("concept_id"))
    return _asked(spark, sf_dir).join(q, "question_id").groupBy("learner_id", "concept_id").agg(F.count("*").alias("used"))


@query(f"""WITH {CANDIDATES}{_ASKED}, us AS (SELECT learner_id, c AS concept_id, count(*) AS used FROM (SELECT ak.learner_id, ak.question_id, unnest(list_distinct(q.concept_ids)) AS c FROM ak JOIN q USING (question_id)) z GROUP BY 1, 2),
nx AS (SELECT vf.learner_id, cq.question_id, cq.first, cq.information_value, max(priority) AS priority, sum(CASE WHEN vf.attempts = 0 THEN 0.5 WHEN vf.attempts < 3 THEN 0.1 ELSE 0 END)::DOUBLE AS bonus, bool_and(coalesce(us.used, 0) >= cap) AS spent
  FROM cq JOIN vf USING (concept_id) LEFT JOIN us ON us.learner_id = vf.learner_id AND us.concept_id = vf.concept_id WHERE NOT EXISTS (SELECT 1 FROM ak WHERE ak.learner_id = vf.learner_id AND ak.question_id = cq.question_id) GROUP BY 1, 2, 3, 4),
base AS (SELECT nx.learner_id, nx.question_id, nx.priority, nx.bonus, nx.information_value, coalesce(s.mastery, 0.3::DOUBLE) AS p FROM nx LEFT JOIN states s ON s.learner_id = nx.learner_id AND s.concept_id = nx.first WHERE NOT spent), {_IG},
sc AS (SELECT learner_id, question_id, priority, round(round(gain, 6) + bonus, 6) AS score FROM i)
SELECT learner_id, arg_min(question_id, (-priority, -score, question_id)) AS question_id, arg_min(score, (-priority, -score, question_id)) AS score FROM sc GROUP BY 1""")
def top_12_mth_10_next_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next question of each learner's verification after three answers, by live mastery."""
    s = stored(states(spark, sf_dir))
    n = planning.verified_next(planning.to_verify(claims(s)), newest(spark, sf_dir), s, _asked(spark, sf_dir))
    return n.select("learner_id", "question_id", "score")


@query(f"""WITH {STATES}, {CLAIMS}, sc AS (SELECT learner_id, concept_id, round(avg(correctness), 4) AS own FROM (SELECT DISTINCT learner_id, concept_id, interaction_id, correctness FROM a WHERE NOT isnan(correctness)) z GROUP BY 1, 2), ov AS (SELECT learner_id, round(avg(correctness), 4) AS mean FROM (SELECT DISTINCT learner_id, interaction_id, correctness FROM interactions WHERE learner_id IS NOT NULL AND correctness IS NOT NULL AND NOT isnan(correctness)) z GROUP BY 1),
x AS (SELECT vf.learner_id, vf.concept_id, vf.status, vf.confidence, coalesce(sc.own, ov.mean) AS m FROM vf JOIN ov USING (learner_id) LEFT JOIN sc ON sc.learner_id = vf.learner_id AND sc.concept_id = vf.concept_id)
SELECT learner_id, concept_id, m AS mean_score, CASE WHEN confidence = 'HIGH' THEN 'C' ELSE 'U' END || CASE WHEN m >= 0.5 THEN 'C' ELSE 'I' END AS calibration,
CASE WHEN status = 'KNOW' AND m >= 0.5 THEN 'confirmed' WHEN status = 'KNOW' THEN 'contradicted' WHEN m >= 0.7 THEN 'contradicted' WHEN m < 0.5 THEN 'confirmed' END AS verdict FROM x""")
def agg_12_claim_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence against competence of what was to be verified."""
    s = states(spark, sf_dir)
    a = answers(spark, sf_dir).filter("NOT isnan(correctness)").select("learner_id", "concept_id", "interaction_id", F.col("correctness").alias("score")).distinct()
    i = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND correctness IS NOT NULL AND NOT isnan(correctness)").select("learner_id", "interaction_id", "correctness").distinct()
    c = planning.calibration(claims(s), a, i.groupBy("learner_id").agg(F.avg("correctness").alias("mean_score")))
    return c.select("learner_id", "concept_id", "mean_score", "calibration", "verdict")


@query(f"WITH {STATES} SELECT learner_id, concept_id, CASE WHEN attempts < 3 THEN 'insufficient' WHEN mastery >= 0.5 THEN 'verified_strong' ELSE 'likely_weak' END AS verdict FROM states")
def agg_13_evidence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states(spark, sf_dir).select("learner_id", "concept_id", F.when(F.col("attempts") < 3, "insufficient").when(F.col("mastery") >= 0.5, "verified_strong").otherwise("likely_weak").alias("verdict"))


@query(f"""WITH {STATES}, {CLAIMS}, k AS (SELECT learner_id, concept_id, status FROM cl UNION ALL SELECT learner_id, 'foreign', 'KNOW' FROM cl GROUP BY 1), al AS (SELECT r.learner_id, c.concept_id FROM (SELECT DISTINCT learner_id FROM cl) r CROSS JOIN concepts c)
SELECT al.learner_id, count(*) FILTER (coalesce(k.status, 'UNANSWERED') = 'KNOW') AS know, count(*) FILTER (k.status = 'DONT_KNOW') AS dont_know, count(*) FILTER (coalesce(k.status, 'UNANSWERED') = 'UNANSWERED') AS unanswered, 1::BIGINT AS foreign_ids FROM al LEFT JOIN k ON k.learner_id = al.learner_id AND k.concept_id = al.concept_id GROUP BY 1""")
def qc_15_16_18_self_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-assessments by learner: unknown concepts pruned and counted, those left open unanswered; counts, no learner-concept product."""
    known = table(spark, sf_dir, "concepts").select("concept_id", F.lit(1).alias("known")).distinct()
    c = claims(states(spark, sf_dir)).select("learner_id", "concept_id", "status")
    c = c.unionByName(c.select("learner_id", F.lit("foreign").alias("concept_id"), F.lit("KNOW").alias("status")).distinct())
    n = known.agg(F.count("*").alias("all_"))
    g = c.join(known, "concept_id", "left").groupBy("learner_id").agg(F.count_if(F.col("known").isNotNull() & (F.col("status") == "KNOW")).alias("know"), F.count_if(F.col("known").isNotNull() & (F.col("status") == "DONT_KNOW")).alias("dont_know"), F.count_if(F.col("known").isNull()).alias("foreign_ids"))
    return g.join(F.broadcast(n)).select("learner_id", "know", "dont_know", (F.col("all_") - F.col("know") - F.col("dont_know")).alias("unanswered"), "foreign_ids")  # one row


# ---------------------------------------------------------------- paths


SUBJECT = f"""{GOALS}, nd AS (SELECT tree, a AS concept_id FROM l UNION SELECT tree, b FROM l),
sj AS (SELECT tg.learner_id, tg.tree, nd.concept_id, coalesce(u.mastery, 0.3::DOUBLE) AS m, coalesce(u.attempts, 0) AS att, coalesce(u.un, 0.85::DOUBLE) AS un FROM tg JOIN nd ON nd.tree = tg.tree LEFT JOIN u ON u.learner_id = tg.learner_id AND u.concept_id = nd.concept_id),
sg AS (SELECT sj.*, att < 3 OR un > 0.4 OR m < 0.5 OR EXISTS (SELECT 1 FROM l JOIN sj p ON p.tree = l.tree AND p.concept_id = l.a WHERE l.tree = sj.tree AND l.b = sj.concept_id AND p.learner_id = sj.learner_id AND p.m < 0.5) AS gap, NOT EXISTS (SELECT 1 FROM l WHERE l.tree = sj.tree AND l.b = sj.concept_id) AS foundational FROM sj)"""


def _subject(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, links = stored(states(spark, sf_dir)), doc_links(spark, sf_dir)
    return planning.subject_states(s, planning.targets(s, links), links), links


@query(f"WITH RECURSIVE {SUBJECT} SELECT learner_id, tree, concept_id, m AS mastery, gap, foundational FROM sg")
def jn_28_29_mth_21_subject_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All concepts of a learner's document with the state they have or start from, and whether they are gaps."""
    s, links = _subject(spark, sf_dir)
    return planning.subject_gaps(s, links).select("learner_id", "tree", "concept_id", "mastery", "gap", "foundational")


@query()
def top_15_learning_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's path: gaps, prerequisites first, ten steps at most."""
    return planning.learning_paths(*_subject(spark, sf_dir))


@query(f"""WITH RECURSIVE {SUBJECT}, gp AS (SELECT learner_id, tree, concept_id, foundational FROM sg WHERE gap), ready AS (SELECT * FROM gp WHERE NOT EXISTS (SELECT 1 FROM l JOIN gp p ON p.learner_id = gp.learner_id AND p.tree = l.tree AND p.concept_id = l.a WHERE l.tree = gp.tree AND l.b = gp.concept_id)),
f AS (SELECT learner_id, min(concept_id) AS concept_id FROM ready GROUP BY 1 UNION ALL SELECT learner_id, min(concept_id) FROM gp WHERE learner_id NOT IN (SELECT learner_id FROM ready) GROUP BY 1)
SELECT gp.learner_id, gp.tree, gp.concept_id, CASE WHEN gp.foundational THEN 'FOUNDATIONAL_START' ELSE 'PREREQUISITE_REMEDIATION' END AS target_type FROM gp JOIN f ON f.learner_id = gp.learner_id AND f.concept_id = gp.concept_id""")
def top_16_next_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of each learner's path."""
    return planning.next_targets(planning.learning_paths(*_subject(spark, sf_dir)))


@query(f"""WITH RECURSIVE {SUBJECT} SELECT learner_id, tree, count(*) AS concepts, count(*) FILTER (gap) AS gaps, least(10, count(*) FILTER (gap)) AS steps, 0::BIGINT AS unknown_steps, 0::BIGINT AS repeated_steps FROM sg GROUP BY 1, 2""")
def qc_17_path_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths have known steps only, none twice, and as many as there are gaps up to ten."""
    s, links = _subject(spark, sf_dir)
    s = stored(s)
    g = planning.subject_gaps(s, links).groupBy("learner_id", "tree").agg(F.count("*").alias("concepts"), F.count_if("gap").alias("gaps"))
    p = planning.learning_paths(s, links).filter("place > 0").join(s.select("learner_id", "tree", "concept_id", F.lit(1).alias("known")), ["learner_id", "tree", "concept_id"], "left")
    c = p.groupBy("learner_id", "tree").agg(F.count("*").alias("steps"), F.count_if(F.col("known").isNull()).alias("unknown_steps"), (F.count("*") - F.count_distinct("concept_id")).alias("repeated_steps"))
    return g.join(c, ["learner_id", "tree"], "left").fillna(0, ["steps", "unknown_steps", "repeated_steps"])


# ---------------------------------------------------------------- learner and class views


@query(f"""WITH {STATES}, n AS (SELECT count(DISTINCT concept_id) AS n FROM concepts), k AS (SELECT s.* FROM states s WHERE concept_id IN (SELECT concept_id FROM concepts)),
g AS (SELECT learner_id, count(*) AS explored, count(*) FILTER (mastery >= 0.75) AS mastered, count(*) FILTER (mastery >= 0.4 AND mastery < 0.75) AS developing, sum(mastery) AS sm FROM k GROUP BY 1)
SELECT learner_id, n AS total_concepts, explored AS explored_concepts, mastered AS mastered_concepts, developing AS developing_concepts, n - explored AS unexplored_concepts, round((sm + 0.3::DOUBLE * (n - explored)) / n, 3) AS average_mastery, round(explored / n, 3) AS exploration_rate,
CASE WHEN explored / n > 0.6 THEN 'HIGH' WHEN explored / n > 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS overall_confidence FROM g, n""")
def agg_06_learner_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.learner_progress(states(spark, sf_dir), table(spark, sf_dir, "concepts"))


@query(f"""WITH {STATES}, r AS (SELECT DISTINCT learner_id FROM interactions WHERE learner_id IS NOT NULL), g AS (SELECT learner_id, count(*) AS observed, sum(attempts) AS att FROM states WHERE concept_id IN (SELECT concept_id FROM concepts) GROUP BY 1)
SELECT learner_id, coalesce(observed, 0) AS observed_concepts, CAST(coalesce(att, 0) AS BIGINT) AS attempts, CASE WHEN att IS NULL THEN 'UNINITIALIZED' WHEN att < 3 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'INITIALIZED' END AS status FROM r LEFT JOIN g USING (learner_id)""")
def agg_14_knowledge_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every learner met, also those without one graded answer."""
    r = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL").select("learner_id").distinct()
    return cohort.sufficiency(states(spark, sf_dir), r, table(spark, sf_dir, "concepts"))


@query(f"WITH {STATES}, {ROSTER} SELECT class_id, count(*) AS enrolled, count(*) FILTER (learner_id IN (SELECT learner_id FROM states WHERE attempts > 0)) AS active FROM roster GROUP BY 1")
def agg_02_active_learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = states(spark, sf_dir).filter("attempts > 0").select("learner_id", F.lit(1).alias("on")).distinct()
    return roster(spark, sf_dir).join(active, "learner_id", "left").groupBy("class_id").agg(F.count("*").alias("enrolled"), F.count("on").alias("active"))


@query(f"""WITH {STATES}, {ROSTER}, t AS (SELECT class_id, min(c.concept_id) AS concept_id FROM roster, concepts c GROUP BY 1)
SELECT r.class_id, t.concept_id, count(*) FILTER (coalesce(s.mastery, 0.3) < 0.4) AS struggling, count(*) FILTER (coalesce(s.mastery, 0.3) >= 0.4) AS mastered FROM roster r JOIN t ON t.class_id = r.class_id LEFT JOIN states s ON s.learner_id = r.learner_id AND s.concept_id = t.concept_id GROUP BY 1, 2""")
def set_10_mastered_minus_struggling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrolled learners less those who struggle with the class's target."""
    target = table(spark, sf_dir, "concepts").agg(F.min("concept_id").alias("concept_id"))
    goal = states(spark, sf_dir).join(F.broadcast(target), "concept_id").select("learner_id", "mastery")  # one row
    r = roster(spark, sf_dir).join(goal, "learner_id", "left").join(F.broadcast(target))
    weak = F.coalesce("mastery", F.lit(0.30)) < 0.4
    return r.groupBy("class_id", "concept_id").agg(F.count_if(weak).alias("struggling"), F.count_if(~weak).alias("mastered"))


@query(f"""WITH {STATES}, d AS (SELECT DISTINCT document_id, unnest(concept_ids) AS concept_id FROM questions WHERE document_id IS NOT NULL), x AS (SELECT s.learner_id, d.document_id, s.concept_id, s.mastery, row_number() OVER (PARTITION BY s.learner_id, d.document_id ORDER BY s.mastery, s.concept_id) AS rn FROM states s JOIN d USING (concept_id))
SELECT learner_id, document_id, string_agg(concept_id, ',' ORDER BY rn) AS concept_ids FROM x WHERE rn <= 3 GROUP BY 1, 2""")
def top_13_mini_quiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three weakest concepts of each learner in each document: what a short quiz asks about."""
    d = table(spark, sf_dir, "questions").filter("document_id IS NOT NULL").select("document_id", F.explode("concept_ids").alias("concept_id")).distinct()
    return cohort.weakest_by_document(states(spark, sf_dir), d)


@query(f"""WITH {_QUESTIONS}, v AS (SELECT *, concept_ids[1] AS concept_id FROM q WHERE lower(validation_status) = 'valid' AND question_type = 'mcq' AND len(concept_ids) > 0), f AS (SELECT document_id, concept_id, min(question_id) AS question_id FROM v GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY concept_id) AS INTEGER) AS place FROM f)
SELECT document_id, place, concept_id, question_id FROM k WHERE place <= 10""")
def top_19_final_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid choice question of each of a document's first ten concepts."""
    v = newest(spark, sf_dir).filter((F.lower("validation_status") == "valid") & (F.col("question_type") == "mcq") & (F.size("concept_ids") > 0)).withColumn("concept_id", F.element_at("concept_ids", 1))
    w = Window.partitionBy("document_id").orderBy("concept_id")
    return v.groupBy("document_id", "concept_id").agg(F.min("question_id").alias("question_id")).withColumn("place", F.row_number().over(w)).filter("place <= 10").select("document_id", "place", "concept_id", "question_id")


@query(f"""WITH {_QUESTIONS}, x AS (SELECT DISTINCT i.learner_id, q.document_id, i.interaction_id, i.ts, i.question_id, i.correctness, q.concept_ids[1] AS concept_id FROM interactions i JOIN q USING (question_id) WHERE i.learner_id IS NOT NULL AND i.correctness IS NOT NULL AND NOT isnan(i.correctness) AND len(q.concept_ids) > 0),
l AS (SELECT learner_id, document_id, concept_id, arg_max(correctness, (ts, interaction_id)) >= 0.5 AS ok FROM x GROUP BY 1, 2, 3)
SELECT x.learner_id, x.document_id, round(100.0 * count(*) FILTER (correctness >= 0.5) / count(*), 1) AS score, 100.0 * count(*) FILTER (correctness >= 0.5) / count(*) >= 70 AS passed, max(k.right_) AS concepts_right, max(k.all_) AS concepts FROM x JOIN (SELECT learner_id, document_id, count(*) FILTER (ok) AS right_, count(*) AS all_ FROM l GROUP BY 1, 2) k ON k.learner_id = x.learner_id AND k.document_id = x.document_id GROUP BY 1, 2""")
def agg_11_assessment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of each learner in each document as an assessment: share right, passed from 70, concepts by their last answer."""
    q = newest(spark, sf_dir).filter(F.size("concept_ids") > 0).select("question_id", "document_id", F.element_at("concept_ids", 1).alias("concept_id"))
    i = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND correctness IS NOT NULL AND NOT isnan(correctness)").select("learner_id", "interaction_id", "ts", "question_id", "correctness").distinct()
    x = i.join(q, "question_id").groupBy("learner_id", "document_id", "concept_id").agg(F.count("*").alias("n"), F.count_if(F.col("correctness") >= 0.5).alias("k"), (F.max_by("correctness", F.struct("ts", "interaction_id")) >= 0.5).alias("ok"))
    g = x.groupBy("learner_id", "document_id").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count_if("ok").alias("concepts_right"), F.count("*").alias("concepts"))
    share = 100.0 * F.col("k") / F.col("n")
    return g.select("learner_id", "document_id", F.round(share, 1).alias("score"), (share >= 70).alias("passed"), "concepts_right", "concepts")


@query(f"""WITH {STATES}, e AS (SELECT DISTINCT source_concept_id AS source, target_concept_id AS target FROM prerequisite_links), f AS (SELECT DISTINCT learner_id, c AS target FROM (SELECT learner_id, unnest(concept_ids) AS c FROM interactions WHERE learner_id IS NOT NULL AND correctness < 0.5) z)
SELECT f.learner_id, f.target AS failed_concept, e.source AS prerequisite, coalesce(s.mastery, 0.3::DOUBLE) AS mastery, coalesce(s.attempts, 0) AS attempts FROM f JOIN e USING (target) LEFT JOIN states s ON s.learner_id = f.learner_id AND s.concept_id = e.source WHERE coalesce(s.mastery, 0.3) < 0.5 OR coalesce(s.attempts, 0) = 0""")
def jn_10_verification_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites of failed concepts that are weak or were never tried."""
    e = table(spark, sf_dir, "prerequisite_links").select(F.col("source_concept_id").alias("prerequisite"), F.col("target_concept_id").alias("failed_concept")).distinct()
    f = table(spark, sf_dir, "interactions").filter("learner_id IS NOT NULL AND correctness < 0.5").select("learner_id", F.explode("concept_ids").alias("failed_concept")).distinct()
    s = states(spark, sf_dir).select("learner_id", F.col("concept_id").alias("prerequisite"), "mastery", "attempts")
    x = f.join(e, "failed_concept").join(s, ["learner_id", "prerequisite"], "left").fillna(0.30, ["mastery"]).fillna(0, ["attempts"])
    return x.filter("mastery < 0.5 OR attempts = 0").select("learner_id", "failed_concept", "prerequisite", "mastery", "attempts")


@query(f"""WITH {_QUESTIONS}, c AS (SELECT question_id, count(DISTINCT citation_id) AS n FROM source_citations WHERE question_id IS NOT NULL GROUP BY 1), a AS (SELECT question_id, count(DISTINCT interaction_id) AS asked FROM interactions WHERE question_id IS NOT NULL GROUP BY 1)
SELECT q.question_id, CASE WHEN coalesce(c.n, 0) = 0 THEN 'INVALID' ELSE upper(q.validation_status) END AS status, coalesce(c.n, 0) > 0 AND upper(q.validation_status) = 'VALID' AS grounded, coalesce(a.asked, 0) = 0 AND upper(q.validation_status) = 'VALID' AS eligible FROM q LEFT JOIN c USING (question_id) LEFT JOIN a USING (question_id)""")
def prj_40_41_45_question_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without a citation are invalid; grounded ones are valid with a citation, eligible ones valid and never asked."""
    c = table(spark, sf_dir, "source_citations").filter("question_id IS NOT NULL").groupBy("question_id").agg(F.count_distinct("citation_id").alias("n"))
    a = table(spark, sf_dir, "interactions").filter("question_id IS NOT NULL").select("question_id", F.lit(1).alias("asked")).distinct()
    x = newest(spark, sf_dir).select("question_id", "validation_status").join(c, "question_id", "left").join(a, "question_id", "left").fillna(0, ["n"])
    s = F.upper("validation_status")
    return x.select("question_id", F.when(F.col("n") == 0, "INVALID").otherwise(s).alias("status"), ((F.col("n") > 0) & (s == "VALID")).alias("grounded"), (F.col("asked").isNull() & (s == "VALID")).alias("eligible"))


@query(f"WITH {_QUESTIONS}, x AS (SELECT document_id, chapter_id, question_id, unnest(list_distinct(concept_ids)) AS concept_id FROM q) SELECT chapter_id, concept_id, count(*) AS questions, min(question_id) AS first_question FROM x WHERE chapter_id IS NOT NULL GROUP BY 1, 2")
def prj_44_questions_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = newest(spark, sf_dir).filter("chapter_id IS NOT NULL").select("chapter_id", "question_id", F.explode(F.array_distinct("concept_ids")).alias("concept_id"))
    return x.groupBy("chapter_id", "concept_id").agg(F.count("*").alias("questions"), F.min("question_id").alias("first_question"))


@query("""WITH s AS (SELECT session_id, learner_id, count(DISTINCT interaction_id) AS asked, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM interactions WHERE session_id IS NOT NULL AND learner_id IS NOT NULL GROUP BY 1, 2)
SELECT session_id, learner_id, asked, round(us / 1000000.0, 1)::DOUBLE AS elapsed_seconds, CASE WHEN asked >= 25 THEN 'MAX_QUESTIONS' WHEN us >= 1800000000 THEN 'TIME_LIMIT' END AS stop_reason FROM s""")
def mth_08_arr_08_stop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an assessment over a session's answers had to stop: 25 questions or 1,800 seconds."""
    s = table(spark, sf_dir, "interactions").filter("session_id IS NOT NULL AND learner_id IS NOT NULL").groupBy("session_id", "learner_id").agg(F.count_distinct("interaction_id").alias("asked"), (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))).alias("us"))
    return s.select("session_id", "learner_id", "asked", F.round(F.col("us") / 1e6, 1).alias("elapsed_seconds"), F.when(F.col("asked") >= 25, "MAX_QUESTIONS").when(F.col("us") >= 1_800_000_000, "TIME_LIMIT").alias("stop_reason"))


@query(f"""WITH {_QUESTIONS}, i AS (SELECT DISTINCT interaction_id, question_id, response FROM interactions WHERE response IS NOT NULL)
SELECT interaction_id, CASE WHEN TRY_CAST(response AS DOUBLE) IS NOT NULL AND regexp_full_match(response, '[01](\\.\\d+)?') AND CAST(response AS DOUBLE) <= 1 THEN CAST(response AS DOUBLE) WHEN response = 'I don''t know' THEN 0.0 WHEN response = q.correct_answer THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM i JOIN q USING (question_id)""")
def mth_15_server_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number within 0..1 passes through, not knowing is 0, otherwise the exact answer counts."""
    i = table(spark, sf_dir, "interactions").filter("response IS NOT NULL").select("interaction_id", "question_id", "response").distinct()
    x = i.join(newest(spark, sf_dir).select("question_id", "correct_answer"), "question_id")
    n = F.when(F.col("response").rlike(r"^[01](\.\d+)?$"), F.col("response").try_cast("double"))
    return x.select("interaction_id", F.when(n <= 1, n).when(F.col("response") == "I don't know", 0.0).when(F.col("response") == F.col("correct_answer"), 1.0).otherwise(0.0).alias("score"))


@query(f"""WITH {ANSWERS}, b AS (SELECT DISTINCT learner_id, concept_id, interaction_id, ts, correctness FROM a WHERE NOT isnan(correctness)), o AS (SELECT learner_id, concept_id, list(CASE WHEN correctness >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY ts, interaction_id) AS obs FROM b GROUP BY 1, 2),
s AS (SELECT learner_id, concept_id, k AS step, list_reduce(list_prepend(0.30::DOUBLE, obs[1:k]), lambda p, x: (CASE WHEN x = 1 THEN p * 0.95::DOUBLE / (p * 0.95::DOUBLE + (1.0::DOUBLE - p) * 0.33::DOUBLE) ELSE p * 0.05::DOUBLE / (p * 0.05::DOUBLE + (1.0::DOUBLE - p) * 0.67::DOUBLE) END) * 0.95::DOUBLE + 0.05::DOUBLE) AS p FROM (SELECT learner_id, concept_id, obs, unnest(generate_series(0, least(20, len(obs)))) AS k FROM o) z)
SELECT learner_id, concept_id, CAST(step AS INTEGER) AS step, round(p, 3) AS mastery FROM s""")
def win_05_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastery before and after each of a learner's first twenty answers on a concept (what a chart shows)."""
    a = answers(spark, sf_dir).filter("NOT isnan(correctness)")
    t = trajectory(a, F.col("learner_id"), F.col("concept_id"), F.col("interaction_id"), F.col("ts"), F.col("correctness"), first=20)
    return t.select(F.col("entity").alias("learner_id"), F.col("item").alias("concept_id"), "step", F.round("mastery", 3).alias("mastery"))


@query(f"""WITH {GOALS.replace(_REACH, _REACH.split(", r AS (")[0])}, {_QUESTIONS}, dn AS (SELECT DISTINCT learner_id, question_id FROM interactions WHERE learner_id IS NOT NULL AND question_id IS NOT NULL),
x AS (SELECT tg.learner_id, q.question_id, q.information_value, coalesce(q.exposure_count, 0) AS ex, unnest(q.concept_ids) AS c FROM tg JOIN q ON q.document_id = tg.tree WHERE len(q.concept_ids) > 0 AND NOT EXISTS (SELECT 1 FROM dn WHERE dn.learner_id = tg.learner_id AND dn.question_id = q.question_id)),
base AS (SELECT x.learner_id, x.question_id, x.information_value, x.ex, avg(coalesce(u.mastery, 0.3::DOUBLE)) AS p, avg(coalesce(u.un, 0.85::DOUBLE)) AS un FROM x LEFT JOIN u ON u.learner_id = x.learner_id AND u.concept_id = x.c GROUP BY 1, 2, 3, 4), {_IG},
sk AS (SELECT learner_id, question_id, round(0.5::DOUBLE * gain + 0.3::DOUBLE * un + 0.2::DOUBLE / (1.0 + ex) + 1e-9, 4) AS score FROM i)
SELECT learner_id, arg_min(question_id, (-score, question_id)) AS question_id, max(score) AS score FROM sk GROUP BY 1""")
def top_09_22_next_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next question of each learner in their document that was not asked yet: gain, uncertainty and freshness by the learner's own states."""
    s = stored(states(spark, sf_dir))
    return planning.next_questions(goals(spark, sf_dir, s), newest(spark, sf_dir), s, table(spark, sf_dir, "interactions").select("learner_id", "question_id"), L.information_gain)


@query(f"WITH {STATES} SELECT learner_id, concept_id, round(mastery, 4) AS mastery, attempts FROM states")
def src_20_22_23_state_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States written as a version, and read back through the active pointer."""
    root = f"{tables_dir(spark)}/states-{uuid.uuid4().hex}"
    s = states(spark, sf_dir).select("learner_id", "concept_id", F.round("mastery", 4).alias("mastery"), "attempts")
    store.write_version(s.limit(0), root, "v1")
    store.write_version(s, root, "v2")
    return store.read_active(spark, root)


@query("""WITH c AS (SELECT document_id, page, citation_id, block_id, row_number() OVER (PARTITION BY document_id, page ORDER BY citation_id DESC, coalesce(block_id, '') DESC) AS rn FROM source_citations WHERE page IS NOT NULL) SELECT document_id, page, citation_id FROM c WHERE rn = 1""")
def src_27_28_29_page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each page after two deliveries: the last one by key wins."""
    c = table(spark, sf_dir, "source_citations").filter("page IS NOT NULL").select("document_id", "page", "citation_id")
    even = F.pmod(F.xxhash64("citation_id"), F.lit(2)) == 0
    first = store.upsert(c.limit(0), c.filter(even), ["document_id", "page"], F.col("citation_id"))
    return store.upsert(first, c.filter(~even), ["document_id", "page"], F.col("citation_id"))
