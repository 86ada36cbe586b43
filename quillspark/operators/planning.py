"""Diagnosis of root gaps, verification quizzes and learning paths, for all learners at once.

A learner's subject is one tree of prerequisites, so every join below is bounded by (learner, node of that tree);
choices are sorts or arg-max aggregates, and only the greedy quiz and the prerequisite-first order run as folds over
sorted rows, holding one learner at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import learning as L
from quillspark.operators import beside
from quillspark.operators.graph import topological_order
from quillspark.session import stored, unsent

# A learner without a state, and the parameters of diagnosis.
PRIOR_MASTERY, PRIOR_UNCERTAINTY = 0.30, 0.85
GUESS, SLIP = 0.25, 0.10
CONFIRMED, ELIMINATED, LEAST_ENTROPY, BUDGET = 0.75, 0.05, 0.40, 5
# Order and number of questions by claim and confidence.
PRIORITY = {("UNANSWERED", "LOW"): 1.0, ("KNOW", "LOW"): 0.9, ("KNOW", "MEDIUM"): 0.8, ("KNOW", "HIGH"): 0.7, ("UNANSWERED", "MEDIUM"): 0.6, ("UNANSWERED", "HIGH"): 0.55}
CAPS = {("KNOW", "HIGH"): 1}
MOST_QUESTIONS, MOST_STEPS, ENOUGH_EVIDENCE = 10, 10, 3
# A Parquet dictionary holds 1 MB: some 50,000 ids.
LEARNERS_A_TILE, QUESTIONS_A_TILE = 1_000, 40_000


def targets(states: DataFrame, links: DataFrame) -> DataFrame:
    """(learner_id, tree, target): each learner's weakest attempted concept that has links, in the least tree that holds it."""
    homes = links.select("tree", F.explode(F.array("source", "target")).alias("concept_id")).groupBy("concept_id").agg(F.min("tree").alias("tree"))
    return states.join(homes, "concept_id").groupBy("learner_id").agg(F.min_by(F.struct("tree", "concept_id"), F.struct("mastery", "concept_id")).alias("t")).select("learner_id", "t.tree", F.col("t.concept_id").alias("target"))


def hypotheses(states: DataFrame, goals: DataFrame, ancestors: DataFrame, supported: DataFrame | None = None) -> DataFrame:
    """Where the gap behind a failed target may lie: (learner_id, tree, target, concept_id, mastery, uncertainty, prior).

    goals (learner_id, tree, target), ancestors (tree, node, ancestor), supported (learner_id, concept_id, n). The
    target and all it rests on, once each, weigh (1 - mastery)(0.5 + 0.5 uncertainty) + 0.1 + 0.3 per supported
    misconception; priors sum to 1 up to their four decimals. A concept without a state has the prior one.
    """
    own = goals.withColumn("concept_id", F.col("target"))
    all_ = own.unionByName(goals.join(unsent(ancestors), (goals["tree"] == ancestors["tree"]) & (F.col("target") == F.col("node"))).select(goals["learner_id"], goals["tree"], "target", F.col("ancestor").alias("concept_id"))).distinct()
    h = all_.join(unsent(states.select("learner_id", "concept_id", "mastery", "uncertainty")), ["learner_id", "concept_id"], "left").fillna(PRIOR_MASTERY, ["mastery"]).fillna(PRIOR_UNCERTAINTY, ["uncertainty"])
    extra = F.lit(0.0)
    if supported is not None:
        h = h.join(supported.select("learner_id", "concept_id", F.col("n").alias("signs")), ["learner_id", "concept_id"], "left")
        extra = 0.3 * F.coalesce("signs", F.lit(0))
    h = h.withColumn("w", (1.0 - F.col("mastery")) * (0.5 + 0.5 * F.col("uncertainty")) + 0.1 + extra)
    total = F.sum("w").over(Window.partitionBy("learner_id", "tree", "target"))  # as many rows as a tree has nodes
    return h.withColumn("prior", F.round(F.col("w") / total, 4)).select("learner_id", "tree", "target", "concept_id", "mastery", "uncertainty", "prior")


def _explains(ancestors: DataFrame) -> DataFrame:
    """(tree, asked, concept_id): a gap in concept_id makes a question on ``asked`` a guess."""
    return unsent(ancestors.select("tree", F.col("node").alias("asked"), F.col("ancestor").alias("concept_id"), F.lit(True).alias("explains")))


def question_gains(hyp: DataFrame, questions: DataFrame, ancestors: DataFrame, states: DataFrame, guess: float = GUESS, slip: float = SLIP) -> DataFrame:
    """Expected fall of entropy over a learner's hypotheses by each question of the tree.

    questions (tree, question_id, asked). A question is guessed where the gap lies in its concept or below it;
    else the learner's own mastery of it decides, or 1 - slip without a state. One pass: the entropy after an answer
    follows from the sums of p and p log p.
    """
    known = states.select("learner_id", F.col("concept_id").alias("asked"), F.col("mastery").alias("asked_mastery"))
    x = hyp.join(unsent(questions), "tree").join(_explains(ancestors), ["tree", "asked", "concept_id"], "left").join(unsent(known), ["learner_id", "asked"], "left")
    m = F.col("asked_mastery")
    right = F.when((F.col("asked") == F.col("concept_id")) | F.coalesce("explains", F.lit(False)), F.lit(guess)).when(m.isNotNull(), m * (1.0 - slip) + (1.0 - m) * guess).otherwise(F.lit(1.0 - slip))
    x = x.withColumn("right", F.greatest(F.lit(0.001), F.least(F.lit(0.999), right)))
    w = Window.partitionBy("learner_id", "tree", "target", "question_id")
    x = x.withColumn("p", F.col("prior") / F.sum("prior").over(w))
    log = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))
    yes, no = F.col("p") * F.col("right"), F.col("p") * (1.0 - F.col("right"))
    g = x.groupBy("learner_id", "tree", "target", "question_id", "asked").agg(F.sum(-log(F.col("p"))).alias("h"), F.sum(yes).alias("py"), F.sum(log(yes)).alias("ly"), F.sum(no).alias("pn"), F.sum(log(no)).alias("ln"))
    after = lambda s, lo: F.when(s > 0, s * F.round(F.greatest(F.lit(0.0), F.log2(s) - lo / s), 6)).otherwise(F.lit(0.0))
    gain = F.greatest(F.lit(0.0), F.round(F.round(F.greatest(F.lit(0.0), F.col("h")), 6) - after(F.col("py"), F.col("ly")) - after(F.col("pn"), F.col("ln")), 6))
    return g.select("learner_id", "tree", "target", "question_id", "asked", F.round(F.greatest(F.lit(0.0), F.col("h")), 6).alias("prior_entropy"), F.round(F.col("py") + 1e-9, 4).alias("marginal_correct"), gain.alias("gain"))


def best_question(gains: DataFrame) -> DataFrame:
    """The question of most gain for each learner and target; ties go to the smaller id."""
    return gains.groupBy("learner_id", "tree", "target").agg(F.min_by(F.struct("question_id", "asked", "gain"), F.struct(-F.col("gain"), F.col("question_id"))).alias("b"), F.count("*").alias("candidates")).select("learner_id", "tree", "target", "b.*", "candidates")


def beliefs(hyp: DataFrame, answers: DataFrame, ancestors: DataFrame, guess: float = GUESS, slip: float = SLIP, budget: int = BUDGET) -> DataFrame:
    """Hypotheses after a learner's answers: posterior, status, whether the diagnosis is complete and its outcome.

    answers (learner_id, tree, asked, correct boolean, turn int), turns from 1; those beyond the budget are not asked.
    Each answer updates all hypotheses by Bayes' rule, rounded to four decimals; asking ends once the first
    hypothesis reaches CONFIRMED or the entropy LEAST_ENTROPY, so later answers change nothing.
    """
    x = hyp.join(answers.filter(F.col("turn") <= budget), ["learner_id", "tree"], "left").join(_explains(ancestors), ["tree", "asked", "concept_id"], "left")
    right = F.when((F.col("asked") == F.col("concept_id")) | F.coalesce("explains", F.lit(False)), F.lit(guess)).otherwise(F.lit(1.0 - slip))
    x = x.withColumn("like", F.when(F.col("correct"), right).otherwise(1.0 - right))
    per = x.groupBy("learner_id", "tree", "target", "concept_id", "prior").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("turn", "like")))), lambda s: s["like"]).alias("likes"))
    rows = per.groupBy("learner_id", "tree", "target").agg(F.array_sort(F.collect_list(F.struct("concept_id", "prior", "likes"))).alias("h"))
    start = F.struct(F.transform("h", lambda s: s["prior"]).alias("p"), F.lit(False).alias("stop"), F.lit(0).alias("asked"))
    entropy = lambda p: F.round(F.aggregate(p, F.lit(0.0), lambda a, v: a + F.when(v > 0, -v * F.log2(v)).otherwise(F.lit(0.0))), 6)

    def step(state: Column, k: Column) -> Column:
        raw = F.zip_with(state["p"], F.col("h"), lambda p, s: p * F.element_at(s["likes"], k))
        total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
        p = F.transform(raw, lambda v: F.round(v / F.when(total > 0, total).otherwise(F.lit(1.0)), 4))
        stop = (F.array_max(p) >= CONFIRMED) | (entropy(p) <= LEAST_ENTROPY)
        return F.when(state["stop"], state).otherwise(F.struct(p.alias("p"), stop.alias("stop"), (state["asked"] + 1).alias("asked")))

    n = F.size(F.element_at(F.col("h"), 1)["likes"])
    turns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    done = rows.withColumn("r", F.aggregate(turns, start, step)).withColumn("entropy", entropy(F.col("r.p")))
    over = (F.array_max("r.p") >= CONFIRMED) | (F.col("entropy") <= LEAST_ENTROPY) | (F.col("r.asked") >= budget)
    flat = done.select("learner_id", "tree", "target", F.col("r.asked").alias("asked"), "entropy", over.alias("complete"), F.explode(F.arrays_zip(F.transform("h", lambda s: s["concept_id"]).alias("c"), F.col("r.p").alias("p"))).alias("x"))
    p = F.round(F.col("x.p"), 4)
    status = F.when(p >= CONFIRMED, "confirmed").when(p <= ELIMINATED, "eliminated").otherwise("active")
    return flat.select("learner_id", "tree", "target", F.col("x.c").alias("concept_id"), p.alias("posterior"), F.when(F.col("asked") > 0, status).otherwise("active").alias("status"), "asked", "entropy", "complete")


# ---------------------------------------------------------------- verification of what learners claim


def claim_priority(status: Column, confidence: Column) -> Column:
    out = F.lit(0.5)
    for (s, c), v in PRIORITY.items():
        out = F.when((status == s) & (confidence == c), v).otherwise(out)
    return out


def claim_cap(status: Column, confidence: Column) -> Column:
    out = F.lit(2)
    for (s, c), v in CAPS.items():
        out = F.when((status == s) & (confidence == c), v).otherwise(out)
    return out


def to_verify(claims: DataFrame) -> DataFrame:
    """claims (learner_id, concept_id, status, confidence) that are known or unanswered, with priority and cap; unknown status and confidence count as UNANSWERED and MEDIUM."""
    s = F.when(F.col("status").isin("KNOW", "DONT_KNOW"), F.col("status")).otherwise("UNANSWERED")
    c = F.when(F.col("confidence").isin("LOW", "MEDIUM", "HIGH"), F.col("confidence")).otherwise("MEDIUM")
    v = claims.withColumn("status", s).withColumn("confidence", c).filter("status != 'DONT_KNOW'")
    return v.select("learner_id", "concept_id", "status", "confidence", claim_priority(F.col("status"), F.col("confidence")).alias("priority"), claim_cap(F.col("status"), F.col("confidence")).alias("cap"))


def quiz_candidates(verify: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions with two options or more that touch what is verified: (learner_id, question_id, priority, score, concepts array<struct<concept_id, cap>>).

    score is 1 + 2 per concept verified + 1 - 1.5 |difficulty - 0.5|.
    """
    q = questions.filter(F.size("options") >= 2).select("question_id", F.coalesce("difficulty", F.lit(0.5)).alias("difficulty"), F.explode(F.array_distinct("concept_ids")).alias("concept_id"))
    g = q.join(verify, "concept_id").groupBy("learner_id", "question_id").agg(F.max("priority").alias("priority"), F.count("*").alias("matching"), F.max("difficulty").alias("difficulty"), F.array_sort(F.collect_list(F.struct("concept_id", "cap"))).alias("concepts"))
    return g.select("learner_id", "question_id", "priority", F.round(2.0 + 2.0 * F.col("matching") - 1.5 * F.abs(F.col("difficulty") - 0.5), 6).alias("score"), "concepts")


def quiz(candidates: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """(learner_id, place, question_id): by priority and score, ties by id, at most ``most``; a question is left out where all its concepts have reached their caps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, used, n = None, {}, 0
        for b in batches:
            out = []
            for learner, question, concepts in zip(*(b.column(k).to_pylist() for k in range(3))):
                if learner != who:
                    who, used, n = learner, {}, 0
                if n >= most or all(used.get(c["concept_id"], 0) >= c["cap"] for c in concepts):
                    continue
                n += 1
                for c in concepts:
                    used[c["concept_id"]] = used.get(c["concept_id"], 0) + 1
                out.append((learner, n, question))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string()))], names=["learner_id", "place", "question_id"])

    rows = candidates.repartition("learner_id").sortWithinPartitions("learner_id", F.col("priority").desc(), F.col("score").desc(), "question_id")
    return rows.select("learner_id", "question_id", "concepts").mapInArrow(run, "learner_id string, place int, question_id string")


def _scored(questions: DataFrame) -> str:
    """A bank of the questions with two options or more; ``scores`` holds the score by the number of concepts verified, from 1."""
    score = lambda n: F.round(2.0 + 2.0 * n - 1.5 * F.abs(F.coalesce("difficulty", F.lit(0.5)) - 0.5), 6)
    return beside.bank_of(questions.filter(F.size("options") >= 2), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.array_distinct("concept_ids")))), score).alias("scores"))


def _scores(bank: beside.Bank) -> np.ndarray:
    lists = bank.table["scores"].combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=1)) + 1))
    out[np.repeat(np.arange(len(size)), size), 1 + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def quizzes(verify: DataFrame, questions: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """The rows of ``quiz`` of the ``quiz_candidates`` without listing these: each learner's questions are looked up in the bank beside the learner, without those that others of the same concepts always come before.

    questions has one row a question_id.
    """
    path = _scored(questions)

    def work(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        bank = beside.Bank(beside.read(path))
        scores = _scores(bank)
        left = np.zeros(len(bank.first), np.int64)
        mine = np.zeros(len(bank.first), bool)
        over = np.full(len(bank.first), -np.inf)
        caps = -1
        for t in tables:
            concept, priority, cap = beside.coded(t["concept_id"], bank.at), t["priority"].to_numpy(), t["cap"].to_numpy()
            names, begin = beside.runs(t["learner_id"])
            if cap.max() > caps:
                caps = int(cap.max())
                bank.shorten(scores, caps)
            who, places, which = [], [], []
            for name, a, b in zip(names, begin[:-1], begin[1:]):
                known = concept[a:b] >= 0
                c = concept[a:b][known]
                left[c], mine[c], over[c] = cap[a:b][known], True, priority[a:b][known]
                n, q = 0, bank.shortlist(c)
                held = mine[bank.concepts[q]]
                order = np.lexsort((q, -scores[q, held.sum(1)], -over[bank.concepts[q]].max(1)))
                q, held = q[order], held[order]
                while n < most and len(q):
                    open_ = (held & (left[bank.concepts[q]] > 0)).any(1)
                    k = int(open_.argmax())
                    if not open_[k]:
                        break
                    n += 1
                    who.append(name)
                    places.append(n)
                    which.append(q[k])
                    left[bank.concepts[q[k]][held[k]]] -= 1
                    q, held = q[k + 1 :], held[k + 1 :]
                over[c] = -np.inf
                mine[c] = False
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(places, pa.int32()), bank.ids.take(pa.array(np.array(which)))], names=["learner_id", "place", "question_id"])

    return beside.by_learner(verify.select("learner_id", "concept_id", "priority", "cap"), work, "learner_id string, place int, question_id string", "concept_id")


def candidates_beside(verify: DataFrame, questions: DataFrame) -> DataFrame:
    """(learner_id, question_id, priority, score) of ``quiz_candidates`` without a join; questions has one row a question_id.

    Nearly every question meets every learner, so the rows are never shuffled, and they are made in an order that their
    file holds in few bytes. A task has some learners and some questions, few enough for the dictionaries of its file,
    and gives both lists for each set of concepts; their pairs are unrolled as they are written, question by question,
    so that ids and scores come in runs and the learners of a set in the same sequence again.
    """
    spark = verify.sparkSession
    v = stored(verify.select("learner_id", "concept_id", "priority"))
    bank = spark.read.parquet(_scored(questions))
    parts, slices = 1 + v.agg(F.count_distinct("learner_id")).first()[0] // LEARNERS_A_TILE, 1 + bank.count() // QUESTIONS_A_TILE
    own = beside.kept_parts(v, "verify", parts, "learner_id")
    bank = beside.kept_parts(bank.withColumn("concepts", F.array_sort("concepts")), "slices", slices, "concepts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            t, q = beside.read_part(own, k // slices), beside.read_part(bank, k % slices)
            if t is not None and q is not None:
                yield from _met(t, beside.Bank(q))

    tiles = spark.range(0, parts * slices, 1, parts * slices)
    x = tiles.mapInArrow(work, "learners array<struct<learner_id: string, priority: double, n: int>>, questions array<struct<question_id: string, scores: array<double>>>")
    x = x.select("learners", F.explode("questions").alias("q")).select("q", F.explode("learners").alias("l"))
    return x.select("l.learner_id", "q.question_id", "l.priority", F.get("q.scores", F.col("l.n") - 1).alias("score"))


def _met(own: pa.Table, bank: beside.Bank) -> Iterator[pa.RecordBatch]:
    """For each set of concepts the learners who verify any of them, by number and highest priority, and its questions."""
    ids = own["learner_id"].unique()
    who, concept, priority = beside.coded(own["learner_id"], {v: k for k, v in enumerate(ids.to_pylist())}), beside.coded(own["concept_id"], bank.at), own["priority"].to_numpy()
    order = np.lexsort((who, -priority, concept))
    order = order[concept[order] >= 0]
    who, priority, first = who[order], priority[order], beside.offsets(concept[order], len(bank.at))
    none = len(bank.at)
    rank = np.append(np.argsort(np.argsort(-np.diff(first), kind="stable")), none)  # most verified first: sets that share them follow one another
    back = np.append(np.argsort(rank[:-1]), none)
    sets = np.sort(rank[bank.concepts], 1)
    order = np.lexsort(sets.T[::-1])
    sets = back[sets[order]]
    begin = np.flatnonzero(np.append(True, (sets[1:] != sets[:-1]).any(1)))
    lists = bank.table["scores"].combine_chunks()

    def given(learners: list, questions: list) -> pa.RecordBatch:
        w, p, n = (np.concatenate([x[i] for x in learners]) for i in range(3))
        q = np.concatenate(questions)
        l_ = pa.StructArray.from_arrays([ids.take(pa.array(w)), pa.array(p), pa.array(n.astype(np.int32))], ["learner_id", "priority", "n"])
        q_ = pa.StructArray.from_arrays([bank.ids.take(pa.array(q)), lists.take(pa.array(q))], ["question_id", "scores"])
        at = [pa.array(np.cumsum([0, *map(len, x)]), pa.int32()) for x in ([x[0] for x in learners], questions)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at[0], l_), pa.ListArray.from_arrays(at[1], q_)], names=["learners", "questions"])

    learners, questions, held = [], [], 0
    for a, b in zip(begin, np.append(begin[1:], len(sets))):
        c = sets[a][sets[a] != none]
        w, p = (np.concatenate([x[first[k] : first[k + 1]] for k in c] or [x[:0]]) for x in (who, priority))
        if not len(w):
            continue
        n = np.ones(len(w), np.int64)
        if len(c) > 1:
            w, which, n = np.unique(w, return_inverse=True, return_counts=True)
            top = np.full(len(w), -np.inf)
            np.maximum.at(top, which, p)
            k = np.lexsort((w, -top, n))
            w, p, n = w[k], top[k], n[k]
        for i in range(a, b, 1_000):
            q = order[i : min(b, i + 1_000)]
            learners.append((w, p, n))
            questions.append(q)
            held += len(w) + len(q)
            if held >= 50_000:
                yield given(learners, questions)
                learners, questions, held = [], [], 0
    if learners:
        yield given(learners, questions)


def next_verification(verify: DataFrame, questions: DataFrame, states: DataFrame, asked: DataFrame, gain, most: int = MOST_QUESTIONS) -> DataFrame:
    """The next question of each learner given what was answered: most (priority, gain + bonus), ties by id.

    asked (learner_id, question_id); ``gain`` builds the information gain from mastery and discrimination. A concept
    without an attempt adds 0.5, one with fewer than ENOUGH_EVIDENCE 0.1. Learners with ``most`` answers, or whose
    questions all reached their concepts' caps, have no row.
    """
    q = questions.filter(F.size("options") >= 2).select("question_id", "information_value", F.get("concept_ids", F.lit(0)).alias("first"), F.explode(F.array_distinct("concept_ids")).alias("concept_id")).filter("first IS NOT NULL")
    used = asked.distinct().join(questions.select("question_id", F.explode(F.array_distinct("concept_ids")).alias("concept_id")), "question_id").groupBy("learner_id", "concept_id").agg(F.count("*").alias("used"))
    full = asked.distinct().groupBy("learner_id").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("learner_id")
    own = states.select("learner_id", "concept_id", "mastery", "attempts")
    x = q.join(verify.join(full, "learner_id", "left_anti"), "concept_id").join(asked.distinct(), ["learner_id", "question_id"], "left_anti")
    x = x.join(own.select("learner_id", "concept_id", "attempts"), ["learner_id", "concept_id"], "left").join(used, ["learner_id", "concept_id"], "left")
    bonus = F.when(F.coalesce("attempts", F.lit(0)) == 0, 0.5).when(F.col("attempts") < ENOUGH_EVIDENCE, 0.1).otherwise(0.0)
    g = x.groupBy("learner_id", "question_id", "first", "information_value").agg(F.max("priority").alias("priority"), F.sum(bonus).alias("bonus"), F.min(F.coalesce("used", F.lit(0)) >= F.col("cap")).alias("spent")).filter("NOT spent")
    g = g.join(own.select("learner_id", F.col("concept_id").alias("first"), "mastery"), ["learner_id", "first"], "left")
    score = F.round(F.round(gain(F.coalesce("mastery", F.lit(PRIOR_MASTERY)), F.coalesce("information_value", F.lit(1.0))), 6) + F.col("bonus"), 6)
    return g.withColumn("score", score).groupBy("learner_id").agg(F.min_by(F.struct("question_id", "priority", "score"), F.struct(-F.col("priority"), -F.col("score"), F.col("question_id"))).alias("b")).select("learner_id", "b.*")


def verified_next(verify: DataFrame, questions: DataFrame, states: DataFrame, asked: DataFrame, gains=L.information_gains, most: int = MOST_QUESTIONS) -> DataFrame:
    """The rows of ``next_verification`` without pairing learners and questions in a join: each learner's are looked up in the bank beside the learner, from the highest priority down to the first with a question left.

    questions has one row a question_id; verify and states have one row a (learner_id, concept_id). ``gains`` gives
    the information gain of arrays and never falls where a question's information_value rises: of questions on the
    same concepts, those below the first one left are looked at only where that one's score is the best.
    """
    first = F.get("concept_ids", F.lit(0))
    path = beside.bank_of(questions, first.alias("lead"), (F.coalesce(F.size("options") >= 2, F.lit(False)) & first.isNotNull()).alias("open"), F.coalesce("information_value", F.lit(1.0)).cast("double").alias("value"))
    none_of = lambda *names: [F.lit(None).cast({"cap": "int", "attempts": "long"}.get(c, "double")).alias(c) for c in names]
    rows = verify.select("learner_id", "concept_id", F.lit(0).alias("kind"), "priority", "cap", *none_of("mastery", "attempts"))
    rows = rows.unionByName(states.select("learner_id", "concept_id", F.lit(1).alias("kind"), *none_of("priority", "cap"), "mastery", F.col("attempts").cast("long").alias("attempts")))
    rows = rows.unionByName(asked.select("learner_id", F.col("question_id").alias("concept_id"), F.lit(2).alias("kind"), *none_of("priority", "cap", "mastery", "attempts")).distinct())

    def work(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        bank = beside.Bank(beside.read(path))
        lead, value = beside.coded(bank.table["lead"], bank.at), bank.table["value"].to_numpy()
        none = len(bank.first) - 1  # the concept nobody has
        # Open questions on the same concepts side by side, those of most value first; the first stands for all of them.
        kept = np.flatnonzero(bank.table["open"].to_numpy())
        alike = np.column_stack([lead[kept], np.sort(bank.concepts[kept], 1)])
        order = np.lexsort((kept, -value[kept], *alike.T))
        kept, alike = kept[order], alike[order]
        new = np.flatnonzero(np.concatenate([[True], (alike[1:] != alike[:-1]).any(1)])) if len(kept) else np.zeros(0, np.int64)
        ends = np.append(new[1:], len(kept))
        group = np.full(len(lead), -1)
        group[kept] = np.repeat(np.arange(len(new)), ends - new)
        heads = kept[new]
        stands = np.zeros(len(lead), bool)
        stands[heads] = True
        bank.only(stands)
        now = np.arange(len(lead))
        mastery, extra = np.full(none + 1, PRIOR_MASTERY), np.zeros(none + 1)
        left, used = np.zeros(none + 1, np.int64), np.zeros(none + 1, np.int64)

        def scores(q: np.ndarray) -> np.ndarray:
            return _rounded(_rounded(gains(mastery[lead[q]], value[q])) + extra[bank.concepts[q]].sum(1))

        for t in tables:
            kind = t["kind"].to_numpy()
            concept, ids = beside.coded(t["concept_id"], bank.at), t["concept_id"]
            priority, cap, own, tries = (t[c].to_numpy() for c in ("priority", "cap", "mastery", "attempts"))
            tries = np.nan_to_num(tries)
            names, begin = beside.runs(t["learner_id"])
            who, which, over, best = [], [], [], []
            for name, a, b in zip(names, begin[:-1], begin[1:]):
                k = kind[a:b]
                if (k == 2).sum() >= most or not (k == 0).any():
                    continue
                known = concept[a:b] >= 0
                at = a + np.flatnonzero((k == 0) & known)
                have = a + np.flatnonzero((k == 1) & known)
                done = np.array([x for x in (bank.place(ids[int(i)].as_py()) for i in a + np.flatnonzero(k == 2)) if x >= 0], np.int64)
                c, s = concept[at], concept[have]
                extra[c] = 0.5  # without an attempt
                extra[s] = np.where(extra[s] > 0, np.where(tries[have] == 0, 0.5, np.where(tries[have] < ENOUGH_EVIDENCE, 0.1, 0.0)), 0.0)
                mastery[s] = np.where(np.isnan(own[have]), PRIOR_MASTERY, own[have])
                np.add.at(used, bank.concepts[done].ravel(), 1)
                used[none] = 0
                left[c] = cap[at] - used[c]
                gone = np.unique(group[done[group[done] >= 0]])
                for g in gone:
                    rest = kept[new[g] : ends[g]]
                    rest = rest[~np.isin(rest, done)]
                    now[heads[g]] = rest[0] if len(rest) else -1
                for p, q in bank.levels(c, priority[at]):
                    q = now[q[(left[bank.concepts[q]] > 0).any(1)]]
                    q = q[q >= 0]
                    if len(q):
                        score = scores(q)
                        g = group[q[score >= score.max() - 2e-6]]
                        q = np.sort(kept[beside.spread(new[g], ends[g])])
                        q = q[~np.isin(q, done)]
                        score = scores(q)
                        i = int(score.argmax())  # the first of the best, as q is in order of id
                        who.append(name)
                        which.append(q[i])
                        over.append(p)
                        best.append(score[i])
                        break
                now[heads[gone]] = heads[gone]
                extra[c], left[c], mastery[s] = 0.0, 0, PRIOR_MASTERY
                used[bank.concepts[done].ravel()] = 0
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), bank.ids.take(pa.array(np.array(which))), pa.array(over, pa.float64()), pa.array(best, pa.float64())], names=["learner_id", "question_id", "priority", "score"])

    return beside.by_learner(rows, work, "learner_id string, question_id string, priority double, score double", "kind", "concept_id")


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves upward."""
    return np.floor(x * 1e6 + 0.5) / 1e6


def calibration(claims: DataFrame, scores: DataFrame, overall: DataFrame) -> DataFrame:
    """Confidence against competence of what is verified: (learner_id, concept_id, mean_score, calibration, verdict).

    scores (learner_id, concept_id, score) of the quiz, overall (learner_id, mean_score) for concepts no question
    touched. CC, CI, UC, UI: confident or not, correct or not (0.5); a claim to know is confirmed from 0.5 on, else
    contradicted; what was left open is contradicted from 0.7 on and confirmed below 0.5.
    """
    per = scores.groupBy("learner_id", "concept_id").agg(F.round(F.avg("score"), 4).alias("own"))
    x = to_verify(claims).join(overall, "learner_id").join(per, ["learner_id", "concept_id"], "left").withColumn("mean", F.coalesce("own", F.round("mean_score", 4)))
    right, know = F.col("mean") >= 0.5, F.col("status") == "KNOW"
    verdict = F.when(know & right, "confirmed").when(know, "contradicted").when(F.col("mean") >= 0.7, "contradicted").when(~right, "confirmed")
    return x.select("learner_id", "concept_id", F.col("mean").alias("mean_score"), F.concat(F.when(F.col("confidence") == "HIGH", "C").otherwise("U"), F.when(right, "C").otherwise("I")).alias("calibration"), verdict.alias("verdict"))


# ---------------------------------------------------------------- paths


def subject_states(states: DataFrame, goals: DataFrame, links: DataFrame) -> DataFrame:
    """(learner_id, tree, concept_id, mastery, attempts, uncertainty) of all nodes of a learner's tree, the prior state where there is none."""
    nodes = links.select("tree", F.explode(F.array("source", "target")).alias("concept_id")).distinct()
    s = goals.select("learner_id", "tree").distinct().join(nodes, "tree").join(states.select("learner_id", "concept_id", "mastery", "attempts", "uncertainty"), ["learner_id", "concept_id"], "left")
    return s.select("learner_id", "tree", "concept_id", F.coalesce("mastery", F.lit(PRIOR_MASTERY)).alias("mastery"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("uncertainty", F.lit(PRIOR_UNCERTAINTY)).alias("uncertainty"))


def subject_gaps(subject: DataFrame, links: DataFrame) -> DataFrame:
    """subject with ``gap`` and ``foundational``: thin evidence, low mastery, a weak prerequisite, or a broad one that is either of the first."""
    pre = links.select("tree", "source", "target").distinct()
    weak = pre.join(subject.filter("mastery < 0.5").select("learner_id", "tree", F.col("concept_id").alias("source")), ["tree", "source"]).select("learner_id", "tree", F.col("target").alias("concept_id"), F.lit(True).alias("weak")).distinct()
    above = pre.select("tree", F.col("target").alias("concept_id"), F.lit(False).alias("root")).distinct()
    thin = (F.col("attempts") < ENOUGH_EVIDENCE) | (F.col("uncertainty") > 0.4)
    x = subject.join(weak, ["learner_id", "tree", "concept_id"], "left").join(above, ["tree", "concept_id"], "left")
    return x.withColumn("gap", thin | (F.col("mastery") < 0.5) | F.coalesce("weak", F.lit(False))).withColumn("foundational", F.coalesce("root", F.lit(True))).drop("weak", "root")


def learning_paths(subject: DataFrame, links: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """(learner_id, tree, place, concept_id, foundational, mastery, status): gaps in an order in which prerequisites come first, the least id that is ready first, ``most`` at most.

    The first step is IN_PROGRESS, the others PENDING. A learner without a gap has one row of place 0, status PATH_COMPLETE.
    """
    g = subject_gaps(subject, links)
    need = g.filter("gap")
    key = F.concat_ws("\x1f", "learner_id", "tree")
    inner = need.select("learner_id", "tree", F.col("concept_id").alias("source")).join(links.select("tree", "source", "target").distinct(), ["tree", "source"]).join(need.select("learner_id", "tree", F.col("concept_id").alias("target")), ["learner_id", "tree", "target"])
    order = topological_order(inner.select(key.alias("tree"), "source", "target").unionByName(need.select(key.alias("tree"), F.col("concept_id").alias("source"), F.lit(None).cast("string").alias("target"))))
    order = order.filter(F.col("place") < most).select(F.split_part("tree", F.lit("\x1f"), F.lit(1)).alias("learner_id"), F.split_part("tree", F.lit("\x1f"), F.lit(2)).alias("tree"), F.col("node").alias("concept_id"), (F.col("place") + 1).alias("place"))
    steps = order.join(g.select("learner_id", "tree", "concept_id", "foundational", "mastery"), ["learner_id", "tree", "concept_id"]).withColumn("status", F.when(F.col("place") == 1, "IN_PROGRESS").otherwise("PENDING"))
    whole = g.groupBy("learner_id", "tree").agg(F.count_if("gap").alias("n")).filter("n = 0").select("learner_id", "tree", F.lit(None).cast("string").alias("concept_id"), F.lit(0).alias("place"), F.lit(None).cast("boolean").alias("foundational"), F.lit(None).cast("double").alias("mastery"), F.lit("PATH_COMPLETE").alias("status"))
    return steps.select(*whole.columns).unionByName(whole).select("learner_id", "tree", "place", "concept_id", "foundational", "mastery", "status")


def next_targets(paths: DataFrame) -> DataFrame:
    """(learner_id, tree, concept_id, target_type) of each path's first step that is not done."""
    first = paths.filter(F.col("status").isin("PENDING", "IN_PROGRESS")).groupBy("learner_id", "tree").agg(F.min_by(F.struct("concept_id", "foundational"), "place").alias("b"))
    return first.select("learner_id", "tree", "b.concept_id", F.when(F.col("b.foundational"), "FOUNDATIONAL_START").otherwise("PREREQUISITE_REMEDIATION").alias("target_type"))


def next_questions(goals: DataFrame, questions: DataFrame, states: DataFrame, asked: DataFrame, gain) -> DataFrame:
    """(learner_id, question_id, score): of the questions of the learner's tree (document_id) that were not asked, most 0.5 gain + 0.3 uncertainty + 0.2 / (1 + exposure); ties by id.

    Mastery and uncertainty are means over a question's concepts, prior values where there is no state; ``gain``
    builds the information gain from mastery and discrimination. Learners meet the questions of one tree only.
    """
    q = questions.filter(F.size("concept_ids") > 0).select(F.col("document_id").alias("tree"), "question_id", F.coalesce("information_value", F.lit(1.0)).alias("value"), F.coalesce("exposure_count", F.lit(0)).alias("exposure"), F.explode("concept_ids").alias("concept_id"))
    done = asked.filter("learner_id IS NOT NULL AND question_id IS NOT NULL").distinct()
    x = goals.select("learner_id", "tree").join(q, "tree").join(done, ["learner_id", "question_id"], "left_anti")
    x = x.join(states.select("learner_id", "concept_id", "mastery", "uncertainty"), ["learner_id", "concept_id"], "left")
    g = x.groupBy("learner_id", "question_id", "value", "exposure").agg(F.avg(F.coalesce("mastery", F.lit(PRIOR_MASTERY))).alias("m"), F.avg(F.coalesce("uncertainty", F.lit(PRIOR_UNCERTAINTY))).alias("u"))
    s = g.select("learner_id", "question_id", F.round(0.5 * gain(F.col("m"), F.col("value")) + 0.3 * F.col("u") + 0.2 / (1.0 + F.col("exposure")) + 1e-9, 4).alias("score"))
    return s.groupBy("learner_id").agg(F.min_by(F.struct("question_id", "score"), F.struct(-F.col("score"), F.col("question_id"))).alias("b")).select("learner_id", "b.*")
