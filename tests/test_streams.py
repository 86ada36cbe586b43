"""Streams over several files and triggers, with late and repeated rows."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from quillspark.streaming import answers as S

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)
ROW = "interaction_id string, learner_id string, session_id string, concept_ids array<string>, correctness double, score double, ts timestamp, metadata string"


def rows(spark, items):
    """(id, hours, arrival hours or None, right)."""
    stamp = lambda h: (BASE + timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    return spark.createDataFrame([(i, "l", "s", ["c", "c"], right, float(k), BASE + timedelta(hours=h), None if a is None else f'{{"received_at":"{stamp(a)}"}}') for k, (i, h, a, right) in enumerate(items)], ROW)


def test_redeliveries_are_answered_for_a_day(spark, tmp_path):
    df = S.received(rows(spark, [("a", 0, 0, 1.0), ("a", 0, 10, 1.0), ("a", 0, 23, 1.0), ("a", 0, 25, 1.0), ("a", 0, 48, 1.0), ("b", 1, None, 0.0), (None, 2, 2, 1.0), ("c", 3, 90, 1.0)]))
    s = S.read_arrivals(spark, S.in_order_of_arrival(df, str(tmp_path / "in"), 5))
    got = sorted((r.token, round((r.at.replace(tzinfo=timezone.utc) - BASE).total_seconds() / 3600) if r.at.tzinfo is None else 0, r.replayed, r.response) for r in S.run_to_table(S.idempotent(s, "interaction_id", "received", "score"), str(tmp_path / "o")).collect())
    assert [(t, rep, resp) for t, _, rep, resp in got] == [("a", False, "0.0"), ("a", True, "0.0"), ("a", True, "0.0"), ("a", False, "3.0"), ("a", True, "3.0"), ("b", False, "5.0"), ("c", False, "7.0")]


def test_mastery_counts_redeliveries_once_within_a_day(spark, tmp_path):
    df = S.received(rows(spark, [("a", 0, 0, 1.0), ("b", 1, 5, 0.0), ("a", 0, 6, 1.0), ("a", 0, 40, 1.0), ("d", 2, 41, None)]))
    s = S.read_arrivals(spark, S.in_order_of_arrival(df, str(tmp_path / "in"), 3))
    r = S.run_to_table(S.mastery_stream(s, at="received"), str(tmp_path / "o"), "update", ["learner_id", "concept_id"], "attempts").collect()
    p = 0.3
    for right in (True, False, True):
        a, b = (0.95 * p, 0.33 * (1 - p)) if right else (0.05 * p, 0.67 * (1 - p))
        p = round(max(0.01, min(0.99, a / (a + b) * 0.95 + 0.05)), 4)
    assert [(x.attempts, x.correct, x.mastery) for x in r] == [(3, 2, p)]


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    df = rows(spark, [("a", 0, 0, 1.0), ("b", 60, 60, 1.0), ("c", 61, 61, 1.0), ("late", 1, 100, 1.0), ("in time", 50, 101, 1.0)])
    s = S.read_arrivals(spark, S.in_order_of_arrival(S.received(df), str(tmp_path / "in"), 4)).withWatermark("ts", S.LATE)
    out = S.run_to_table(S.activity(s).select("start", "answers"), str(tmp_path / "o"), "update", ["start"], "answers")
    assert sorted(r.answers for r in out.collect()) == [1, 3]  # the late row's day is closed


def test_sessions_complete_and_expire(spark, tmp_path):
    df = S.received(rows(spark, [(f"i{k}", 0, 0.001 * k, 1.0) for k in range(30)]).unionByName(rows(spark, [("z", 0, 0, 1.0)]).withColumn("session_id", F.lit("short"))).unionByName(rows(spark, [("y", 30, 30, 0.0), ("x", 40, 40, 0.0)]).withColumn("session_id", F.lit("other"))))
    s = S.read_arrivals(spark, S.in_order_of_arrival(df, str(tmp_path / "in"), 3))
    out = S.run_to_table(S.session_states(s, at="received"), str(tmp_path / "o"), "update").collect()
    seen = {}
    for r in out:
        seen.setdefault(r.session_id, set()).add((r.answers, r.status))
    assert (30, "COMPLETED") in seen["s"] and (1, "ACTIVE") in seen["short"] and (1, "EXPIRED") in seen["short"] and (30, "EXPIRED") not in seen["s"]
    assert S.in_order_of_arrival(df.limit(0), str(tmp_path / "none")) and spark.read.parquet(str(tmp_path / "none")).count() == 0
