"""Queries that list what a learner's states meet, beside the learner: against plain joins, and with no join in their plans."""

import random

import numpy as np

from quillspark.functions import learning as L
from quillspark.operators import cohort, planning
from quillspark.plans import library_knowledge, library_planning
from tests.fixtures import SMALL
from tests.test_beside import claims_and_bank, plan, some_states


def test_next_verification_is_that_of_all_pairs(spark):
    for seed, most in ((5, 10), (9, 6)):
        rng, verify, q = claims_and_bank(spark, seed)
        states = spark.createDataFrame([(f"l{i}", f"c{k}", round(rng.random(), 4), rng.choice([None, 0, 1, 2, 3, 9])) for i in range(6) for k in range(14) if rng.random() < 0.8], "learner_id string, concept_id string, mastery double, attempts long")
        asked = spark.createDataFrame([(f"l{rng.randrange(5)}", rng.choice([None, "none", *(f"q{k:02d}" for k in range(80))])) for _ in range(30)] * 2, "learner_id string, question_id string")
        n = planning.verified_next(verify, q, states, asked, most=most)
        assert "Join" not in plan(n)
        got = sorted(map(tuple, n.collect()))
        assert got == sorted(map(tuple, planning.next_verification(verify, q, states, asked, L.information_gain, most).collect())) and got
    assert planning.verified_next(verify, q.limit(0), states, asked).count() == 0 and planning.verified_next(verify.limit(0), q, states, asked).count() == 0


def test_next_verification_joins_no_states_with_questions(spark):
    n = library_planning.top_12_mth_10_next_verification(spark, str(SMALL))
    assert "Join" not in plan(n) and n.count() > 0


def test_gains_never_fall_where_a_question_tells_more():
    p = np.arange(1, 100)[:, None] / 100
    g = L.information_gains(p, np.arange(1, 400)[None, :] / 100)
    assert (np.diff(g, axis=1) >= -1e-12).all() and g.max() < 1


def test_weak_upstream_concepts_are_counted_beside_their_learner(spark):
    rng, states, sdf = some_states(spark, 4)
    up = [(f"t{t}", f"c{k}", rng.sample([f"c{j}" for j in range(15)], rng.randrange(0, 6))) for t in range(7) for k in range(14) if rng.random() < 0.7]
    x = cohort.upstream_weak(sdf, spark.createDataFrame(up, "tree string, concept_id string, above array<string>"))
    assert "Join" not in plan(x)
    have = {(w, c): m for w, c, m, *_ in states}
    want = sorted((t, w, c, len(a), sum(have.get((w, v), 0.3) < 0.5 for v in a)) for (w, c), m in have.items() if m < 0.5 for t, k, a in up if k == c and a)
    assert sorted(map(tuple, x.collect())) == want and want
    assert "Join" not in plan(library_knowledge.grf_13_upstream_weak(spark, str(SMALL)))


def test_weakest_concepts_of_documents_are_chosen_beside_the_learner(spark):
    rng, states, sdf = some_states(spark, 5)
    docs = sorted({(f"d{rng.randrange(9)}", f"c{rng.randrange(15)}") for _ in range(60)})
    x = cohort.weakest_by_document(sdf, spark.createDataFrame([*docs, (None, "c1"), ("d1", None)], "document_id string, concept_id string"))
    assert "Join" not in plan(x)
    want = {}
    for w, c, m, *_ in states:
        for d, k in docs:
            if k == c:
                want.setdefault((w, d), []).append((m, c))
    assert {(r.learner_id, r.document_id): r.concept_ids for r in x.collect()} == {k: ",".join(c for _, c in sorted(v)[:3]) for k, v in want.items()}
    assert "Join" not in plan(library_planning.top_13_mini_quiz(spark, str(SMALL)))
