import math
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.operators.features import feature_table, widen
from quillspark.operators.hierarchy import Ranges, hierarchy, ranges
from quillspark.operators.sessions import sessionize

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
EVENTS = "learner_id string, interaction_id string, ts timestamp, time_taken_seconds double, kinds array<string>, score double, entity int"


def events(spark, rows):
    return spark.createDataFrame([(w, i, BASE + timedelta(seconds=t) if t is not None else None, d, k, s, 0) for w, i, t, d, k, s in rows], EVENTS)


def sessions_of(df):
    s = sessionize(df, F.col("learner_id"), F.col("interaction_id"), F.col("ts"), F.col("time_taken_seconds"))
    return {(r.entity, r.first_id, r.last_id, r.answers, r.duration_seconds) for r in s.collect()}


def brute_sessions(rows):
    by = defaultdict(set)
    for w, i, t, d, *_ in rows:
        if w is not None and t is not None:
            by[w].add((t, i, 0.0 if d is None or math.isnan(d) or d < 0 else d))
    out = set()
    for w, es in by.items():
        run = []
        for t, i, d in sorted(es):
            if run and t - d - run[-1][0] > 1800:
                out.add((w, run[0][1], run[-1][1], len(run), run[-1][0] - min(x[0] - x[2] for x in run)))
                run = []
            run.append((t, i, d))
        out.add((w, run[0][1], run[-1][1], len(run), run[-1][0] - min(x[0] - x[2] for x in run)))
    return out


def test_sessions_match_brute_force_with_a_hot_learner(spark):
    rng = random.Random(1)
    rows = [("hot" if n % 3 else f"l{n % 7}", f"i{n:04d}", rng.randrange(0, 400_000), rng.choice([None, -1.0, 20.0, 500.0, float("nan")]), [], 0.0) for n in range(900)]
    rows += rows[:50] + [(None, "x", 5, 1.0, [], 0.0), ("l1", "y", None, 1.0, [], 0.0)]
    assert sessions_of(events(spark, rows).repartition(7)) == brute_sessions(rows)


def test_sessions_edge_cases(spark):
    assert sessions_of(events(spark, [])) == set()
    # Ties go by id; exactly the gap does not split; a long answer bridges it.
    rows = [("a", "2", 0, None, [], 0.0), ("a", "1", 0, None, [], 0.0), ("a", "3", 1800, 0.0, [], 0.0), ("a", "4", 3601, 0.0, [], 0.0), ("a", "5", 9000, 5000.0, [], 0.0)]
    assert sessions_of(events(spark, rows)) == brute_sessions(rows)
    assert {x[1:4] for x in brute_sessions(rows)} == {("1", "3", 3), ("4", "5", 2)}


def test_feature_table_counts_each_answer_once(spark):
    rng = random.Random(2)
    rows = [("hot" if n % 2 else f"l{n % 5}", f"i{n:04d}", n, rng.choice([None, -2.0, 10.0]), rng.choice([[], None, ["a|x"], ["a|x", "b|y", "b|y"], ["c|z", None]]), rng.choice([None, 1.0, float("nan")])) for n in range(600)]
    rows += rows[:80] + [(None, "q", 3, 1.0, ["a|x"], 1.0)]
    got = feature_table(events(spark, rows).repartition(6), F.col("learner_id"), F.col("kinds"), F.col("interaction_id"), F.col("ts"), F.col("time_taken_seconds"), F.col("score")).collect()
    want = defaultdict(lambda: [0, 0, 0.0, 0.0])
    for w, i, t, d, k, s in {(w, i, t, d if d is not None else None, tuple(k or ()), None if s is None or math.isnan(s) else s) for w, i, t, d, k, s in rows}:
        for kind in {x for x in k if x} if w else ():
            c = want[w, kind]
            c[0] += 1
            c[1] = max(c[1], t)
            c[2] += d if d and d > 0 else 0.0
            c[3] += s or 0.0
    base = int(BASE.timestamp())
    flat = {(r.entity, k): [v.n, v.last_us // 1_000_000 - base, v.seconds, v.score] for r in got for k, v in r.features.items()}
    assert flat == dict(want)
    assert len({r.entity for r in got}) == len(got)
    assert all(r.events == sum(v.n for v in r.features.values()) and r.kinds == len(r.features) for r in got)


def test_widen_gives_columns(spark):
    f = feature_table(events(spark, [("a", "1", 0, 2.0, ["k"], 1.0)]), F.col("learner_id"), F.col("kinds"), F.col("interaction_id"), F.col("ts"), F.col("time_taken_seconds"), F.col("score"))
    r = widen(f, ["k", "none"]).first()
    assert (r["n__k"], r["seconds__k"], r["n__none"], r["last_us__none"]) == (1, 2.0, 0, None)
    assert feature_table(events(spark, []), F.col("learner_id"), F.col("kinds"), F.col("interaction_id"), F.col("ts"), F.col("time_taken_seconds"), F.col("score")).collect() == []


def reach(links):
    down = defaultdict(set)
    for a, b in links:
        down[a].add(b)
    nodes = {x for ab in links for x in ab}
    out = {}
    for v in nodes:
        seen, todo = set(), list(down[v])
        while todo:
            w = todo.pop()
            if w not in seen:
                seen.add(w)
                todo += down[w]
        out[v] = seen
    return out


@pytest.mark.parametrize("bound", [200_000, 0])
def test_hierarchy_against_brute_force(spark, bound):
    """Bound 0 sends every tree through the distributed rounds."""
    rng = random.Random(5)
    rows, want = [], {}
    for t in range(4 if bound else 2):
        links = set()
        for k in range(1, 14):
            links.add((f"n{rng.randrange(0, k):02d}", f"n{k:02d}"))
        links |= {("n03", "n12"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("n05", "c1"), ("c2", "z1"), ("z1", "z2"), ("s", "s"), ("z2", "e1"), ("e1", "e2"), ("e2", "e1")}
        rows += [("h", f"t{t}", a, b) for a, b in links] * 2 + [("h", f"t{t}", "alone", None)]
        r = reach(links)
        for v, d in r.items():
            cyc = min(x for x in d if v in r[x]) if v in d else None
            want[f"t{t}", v] = (sorted(d), cyc)
        want[f"t{t}", "alone"] = ([], None)
    df = spark.createDataFrame(rows, "hierarchy string, tree string, parent string, child string")
    got = hierarchy(df, max_local_links=bound).collect()
    assert {(r.tree, r.node): (sorted(r.descendants), r.cycle_id) for r in got} == want
    by = {(r.tree, r.node): r for r in got}
    parents = defaultdict(set)
    for _, t, a, b in rows:
        if b is not None:
            parents[t, b].add(a)
    for (t, v), r in by.items():
        if r.state == "rooted":
            assert r.path[-1] == v and r.path[0] == r.root and r.depth == len(r.path) - 1
            assert r.depth == 0 or r.path[-2] == min(parents[t, v])
            inside = [x for x in got if x.tree == t and x.state == "rooted" and r.preorder <= x.preorder < r.preorder + r.subtree_size]
            assert {x.node for x in inside} == {x.node for x in got if x.tree == t and x.path and v in x.path}
        else:
            assert r.path is None and r.root is None
    assert by["t0", "z1"].state == "below_cycle" and by["t0", "n05"].state == "rooted"


def test_hierarchy_nulls_and_empty(spark):
    schema = "hierarchy string, tree string, parent string, child string"
    assert hierarchy(spark.createDataFrame([], schema)).collect() == []
    got = hierarchy(spark.createDataFrame([(None, None, "a", "b"), ("h", "t", None, "x"), ("h", "t", None, None)], schema)).collect()
    assert {(r.tree, r.node, r.depth) for r in got} == {("", "a", 0), ("", "b", 1), ("t", "x", 0)}


def test_hierarchy_is_the_same_in_a_task_and_in_rounds(spark):
    rng = random.Random(6)
    rows = []
    for t in range(3):
        rows += [("h", f"t{t}", f"n{rng.randrange(0, k):03d}", f"n{k:03d}") for k in range(1, 40)]
        rows += [("h", f"t{t}", f"n{rng.randrange(0, 20):03d}", f"n{rng.randrange(20, 40):03d}") for _ in range(8)]
        rows += [("h", f"t{t}", f"x{k}", f"x{(k + 1) % 4}") for k in range(4)] + [("h", f"t{t}", "x1", "n039"), ("h", f"t{t}", "other", None)]
    df = spark.createDataFrame(rows, "hierarchy string, tree string, parent string, child string")
    near, far = ({(r.tree, r.node): r for r in hierarchy(df, max_local_links=b).collect()} for b in (1000, 0))
    assert near == far
    narrow = {(r.tree, r.node): r for r in ranges(df, max_local_links=0).collect()}
    assert all(r.asDict() == {k: v for k, v in near[n].asDict().items() if k not in ("path", "descendants")} for n, r in narrow.items())


def test_a_long_chain_needs_memory_in_proportion():
    import tracemalloc

    tracemalloc.start()
    r = Ranges([(f"n{k:06d}", f"n{k + 1:06d}") for k in range(200_000)])
    rows = r.unrolled()
    assert [len(next(rows)[-2]) for _ in range(3)] == [1, 2, 3] and r.spans(100_000) == [(100_000, 200_001)]
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
