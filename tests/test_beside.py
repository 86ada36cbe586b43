"""What a learner's states meet is worked out beside the learner, against plain loops; no join carries it through a shuffle."""

import random

from quillspark.operators import cohort, planning
from quillspark.session import stored


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some_states(spark, seed, learners=6, concepts=12):
    rng = random.Random(seed)
    rows = [(f"l{i}", f"c{k}", round(rng.random(), 4), rng.randrange(1, 6), round(rng.random(), 4)) for i in range(learners) for k in range(concepts) if rng.random() < 0.6]
    return rng, rows, spark.createDataFrame(rows, "learner_id string, concept_id string, mastery double, attempts long, uncertainty double")


def some_links(rng, n=60, concepts=14):
    return [(rng.choice([None, *(f"c{k}" for k in range(concepts))]), rng.choice([None, *(f"c{k}" for k in range(concepts))])) for _ in range(n)] + [("c1", "c2")] * 3


def weak_prerequisites(states, links):
    have = {(w, c): m for w, c, m, *_ in states}
    return {(w, c): (sum(a == c for a, _ in links), sum(have.get((w, a), 0.3) < 0.5 for a in {a for a, b in links if b == c})) for w, c, *_ in states}


def test_gaps_meet_links_beside_their_learner(spark):
    rng, states, sdf = some_states(spark, 1)
    links = some_links(rng)
    g = cohort.gaps(sdf, spark.createDataFrame(links, "source string, target string"))
    assert "Join" not in plan(g)
    want = weak_prerequisites(states, links)
    thin = {(w, c): n < 3 or u > 0.4 for w, c, _, n, u in states}
    low = {(w, c): m < 0.5 for w, c, m, *_ in states}
    got = {(r.learner_id, r.concept_id): (r.downstream, r.weak_prerequisites) for r in g.collect()}
    assert got == {k: v for k, v in want.items() if thin[k] or low[k] or v[1]}
    none = cohort.gaps(sdf, spark.createDataFrame([], "source string, target string")).collect()
    assert {(r.learner_id, r.concept_id) for r in none} == {k for k in want if thin[k] or low[k]} and not any(r.downstream or r.weak_prerequisites for r in none)


def test_gap_reasons_follow_states_and_links(spark):
    rng, states, sdf = some_states(spark, 2)
    links = some_links(rng)
    want = weak_prerequisites(states, links)
    g = cohort.gaps(sdf, spark.createDataFrame(links, "source string, target string"))
    assert "Join" not in plan(g)
    got = {(r.learner_id, r.concept_id): (r.reasons, r.gap_type) for r in g.collect()}
    for w, c, m, n, u in states:
        thin, low, (down, weak) = n < 3 or u > 0.4, m < 0.5, want[w, c]
        why = [k for k, v in (("INSUFFICIENT_EVIDENCE", thin), ("LOW_MASTERY", low), ("WEAK_PREREQUISITE", weak > 0), ("HIGH_DOWNSTREAM_IMPACT", (low or thin) and down >= 2)) if v]
        kind = "LOW_MASTERY" if low else "INSUFFICIENT_EVIDENCE" if thin else "WEAK_PREREQUISITE"
        assert got.get((w, c)) == ((",".join(why), kind) if why else None)


def ancestors_and_states(spark):
    rng, states, sdf = some_states(spark, 3)
    anc = spark.createDataFrame([("t", f"c{k}", f"c{j}") for k in range(12) for j in range(k) if rng.random() < 0.5], "tree string, node string, ancestor string")
    goals = planning.targets(sdf, spark.createDataFrame([("t", "c1", "c5"), ("t", "c2", "c7")], "tree string, source string, target string"))
    return sdf, stored(anc), planning.hypotheses(sdf, goals, stored(anc))


def test_question_gains_broadcast_no_table_by_its_file(spark):
    sdf, anc, h = ancestors_and_states(spark)
    q = stored(spark.createDataFrame([("t", f"q{k}", f"c{k}") for k in range(8)], "tree string, question_id string, asked string"))
    assert "BroadcastHashJoin" not in plan(h)
    gains = planning.question_gains(h, q, anc, stored(sdf))
    assert all(0 <= r.gain <= r.prior_entropy + 1e-6 for r in gains.collect())
    assert "BroadcastHashJoin" not in plan(gains) and gains.count() == 8 * h.select("learner_id").distinct().count()


def test_best_question_is_over_all_questions_of_the_tree(spark):
    sdf, anc, h = ancestors_and_states(spark)
    q = stored(spark.createDataFrame([("t", f"q{k}", f"c{k}") for k in range(8)], "tree string, question_id string, asked string"))
    best = planning.best_question(planning.question_gains(h, q, anc, stored(sdf)))
    assert "BroadcastHashJoin" not in plan(best) and {r.candidates for r in best.collect()} == {8}


def test_beliefs_broadcast_no_table_by_its_file(spark):
    _, anc, h = ancestors_and_states(spark)
    turns = spark.createDataFrame([("l0", "t", "c5", False, 1), ("l1", "t", "c7", True, 1)], "learner_id string, tree string, asked string, correct boolean, turn int")
    b = planning.beliefs(h, turns, anc)
    assert "BroadcastHashJoin" not in plan(b) and b.count() == h.count()
    asked = {r.learner_id: r.asked for r in b.collect()}
    assert all(n == int(w in ("l0", "l1")) for w, n in asked.items())


def claims_and_bank(spark, seed):
    rng = random.Random(seed)
    claims = [(f"l{i}", f"c{k}", rng.choice(["KNOW", "DONT_KNOW", "UNANSWERED"]), rng.choice(["LOW", "MEDIUM", "HIGH"])) for i in range(5) for k in range(12) if rng.random() < 0.8]
    questions = [(f"q{i:02d}", rng.choice([None, ["a"], ["a", "b"], ["a", "b", "c"]]), rng.choice([None, round(rng.random(), 2)]), rng.choice([None, [None, "c1"], [f"c{rng.randrange(14)}" for _ in range(rng.randrange(0, 5))]]), rng.choice([None, 0.7, 1.3])) for i in range(80)]
    verify = planning.to_verify(spark.createDataFrame(claims, "learner_id string, concept_id string, status string, confidence string"))
    return rng, verify, spark.createDataFrame(questions, "question_id string, options array<string>, difficulty double, concept_ids array<string>, information_value double")


def test_quizzes_are_those_of_all_candidates(spark):
    for seed, most in ((5, 10), (6, 3)):
        _, verify, q = claims_and_bank(spark, seed)
        quiz = planning.quizzes(verify, q, most)
        assert "Join" not in plan(quiz)
        got = sorted(map(tuple, quiz.collect()))
        assert got == sorted(map(tuple, planning.quiz(planning.quiz_candidates(verify, q), most).collect())) and got
    assert planning.quizzes(verify, q.limit(0)).count() == 0 and planning.quizzes(verify.limit(0), q).count() == 0


def test_quizzes_read_once_keep_within_what_was_to_be_verified(spark):
    _, verify, q = claims_and_bank(spark, 8)
    quiz = planning.quizzes(verify, q)
    assert "Join" not in plan(quiz)
    wanted = {(r.learner_id, r.concept_id) for r in verify.collect()}
    bank = {r.question_id: r.concept_ids for r in q.collect()}
    rows = quiz.collect()
    assert rows and all(any((r.learner_id, c) in wanted for c in bank[r.question_id]) for r in rows)
    assert len({(r.learner_id, r.question_id) for r in rows}) == len(rows)


def test_candidates_are_listed_beside_the_learner(spark):
    _, verify, q = claims_and_bank(spark, 7)
    c = planning.candidates_beside(verify, q)
    assert "Join" not in plan(c) and "HashAggregate" not in plan(c)
    got = sorted(map(tuple, c.collect()))
    assert got == sorted(tuple(r)[:4] for r in planning.quiz_candidates(verify, q).collect()) and got
