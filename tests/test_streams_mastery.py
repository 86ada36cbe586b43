"""Keys of running mastery are folded a bucket at a time."""

from quillspark.streaming import answers as S
from tests.test_streams import rows


def test_mastery_keys_share_few_states(spark, tmp_path):
    df = S.received(rows(spark, [(f"i{k % 3000}", 0, k // 3000 * 20, 1.0) for k in range(9000)]))
    df = df.selectExpr("* EXCEPT (learner_id)", "concat('l', interaction_id) AS learner_id")
    s = S.read_arrivals(spark, S.in_order_of_arrival(df, str(tmp_path / "in"), 3))
    out = S.run_to_table(S.mastery_stream(s, at="received"), str(tmp_path / "o"), "update", ["learner_id", "concept_id"], "attempts")
    assert out.count() == 3000 and {(r.attempts, r.correct) for r in out.select("attempts", "correct").distinct().collect()} == {(2, 2)}
    assert spark.read.format("statestore").load(str(tmp_path / "o" / "checkpoint")).count() <= S.BUCKETS
