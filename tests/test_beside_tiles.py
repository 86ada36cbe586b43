"""Results as large as learners times questions or documents: whole in however many parts, and in runs that a file holds in few bytes."""

import random

from quillspark.operators import cohort, planning
from tests.test_beside import claims_and_bank, plan, some_states


def turns(values):
    """How often a value is not the one before it."""
    return sum(a != b for a, b in zip(values, values[1:]))


def test_candidates_are_whole_in_however_many_tiles(spark, monkeypatch):
    _, verify, q = claims_and_bank(spark, 11)
    want = sorted(tuple(r)[:4] for r in planning.quiz_candidates(verify, q).collect())
    monkeypatch.setattr(planning, "LEARNERS_A_TILE", 2)
    monkeypatch.setattr(planning, "QUESTIONS_A_TILE", 7)
    c = planning.candidates_beside(verify, q)
    assert sorted(map(tuple, c.collect())) == want and want
    assert "Exchange" not in plan(c) and c.rdd.getNumPartitions() > 9
    assert planning.candidates_beside(verify, q.limit(0)).count() == 0 and planning.candidates_beside(verify.limit(0), q).count() == 0


def test_candidates_follow_one_another_by_question(spark):
    rng = random.Random(12)
    claims = [(f"l{i:03d}", f"c{k}", rng.choice(["KNOW", "UNANSWERED"]), rng.choice(["LOW", "HIGH"])) for i in range(150) for k in range(8)]
    verify = planning.to_verify(spark.createDataFrame(claims, "learner_id string, concept_id string, status string, confidence string"))
    q = spark.createDataFrame([(f"q{i:03d}", ["a", "b"], rng.random(), rng.sample([f"c{k}" for k in range(9)], rng.randrange(1, 4))) for i in range(200)], "question_id string, options array<string>, difficulty double, concept_ids array<string>")
    rows = planning.candidates_beside(verify, q).collect()
    assert sorted(tuple(r) for r in rows) == sorted(tuple(r)[:4] for r in planning.quiz_candidates(verify, q).collect())
    assert turns([r.question_id for r in rows]) < 200 and turns([(r.priority, r.score) for r in rows]) < len(rows) / 8


def test_weakest_concepts_are_whole_in_however_many_tasks(spark, monkeypatch):
    rng, states, sdf = some_states(spark, 13, learners=9)
    docs = sorted({(f"d{rng.randrange(30)}", f"c{rng.randrange(15)}") for _ in range(200)})
    want = {}
    for w, c, m, *_ in states:
        for d, k in docs:
            if k == c:
                want.setdefault((w, d), []).append((m, c))
    want = sorted((w, d, ",".join(c for _, c in sorted(v)[:3])) for (w, d), v in want.items())
    documents = spark.createDataFrame(docs, "document_id string, concept_id string")
    for settings in ({}, {"LEARNERS_A_TASK": 2, "BATCH": 3, "DICTIONARY": 40}, {"PAIRS_A_TASK": 1, "BATCH": 7}):
        for k, v in settings.items():
            monkeypatch.setattr(cohort, k, v)
        x = cohort.weakest_by_document(sdf, documents)
        assert sorted(map(tuple, x.collect())) == want and "Exchange" not in plan(x)
        assert not settings or x.rdd.getNumPartitions() > 4
        monkeypatch.undo()
    assert cohort.weakest_by_document(sdf.limit(0), documents).count() == 0 and cohort.weakest_by_document(sdf, documents.limit(0)).count() == 0


def test_weakest_concepts_come_in_runs(spark):
    rng, states, sdf = some_states(spark, 14, learners=20, concepts=8)
    docs = sorted({(f"d{i}", f"c{rng.randrange(10)}") for i in range(300) for _ in range(3)})
    rows = cohort.weakest_by_document(sdf, spark.createDataFrame(docs, "document_id string, concept_id string")).collect()
    texts = len({(r.learner_id, r.concept_ids) for r in rows})
    assert turns([(r.learner_id, r.concept_ids) for r in rows]) == texts - 1 and len(rows) > 2 * texts
