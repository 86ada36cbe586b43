"""Deliveries are dealt to files in one pass, and tokens answered by bucket."""

from pyspark.sql import functions as F

from quillspark.streaming import answers as S
from tests.test_streams import rows


def test_all_files_are_written_by_one_job_of_one_read(spark, tmp_path):
    df = S.received(rows(spark, [(f"i{k}", 0, k % 17, 1.0) for k in range(60)]))
    sc = spark.sparkContext
    sc.setJobGroup("files", "files")
    folder = S.in_order_of_arrival(df, str(tmp_path / "in"), 6)
    sc.setJobGroup("other", "other")
    assert len(sc.statusTracker().getJobIdsForGroup("files")) <= 4  # 7 with a job a file
    got = spark.read.parquet(folder)
    assert got.count() == 60 and got.select("arrival").distinct().count() == 6
    spans = sorted(got.groupBy("arrival").agg(F.min("received").alias("a"), F.max("received").alias("b")).collect(), key=lambda r: r.arrival)
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))


def test_tokens_share_few_states(spark, tmp_path):
    df = S.received(rows(spark, [(f"i{k % 3000}", 0, k // 3000 * 20, 1.0) for k in range(9000)]))
    s = S.read_arrivals(spark, S.in_order_of_arrival(df, str(tmp_path / "in"), 3))
    out = S.run_to_table(S.idempotent(s, "interaction_id", "received", "score"), str(tmp_path / "o"))
    assert {(r.n, r.replayed) for r in out.groupBy("token").agg(F.count("*").alias("n"), F.count_if("replayed").alias("replayed")).collect()} == {(3, 1)}
    states = spark.read.format("statestore").load(str(tmp_path / "o" / "checkpoint"))
    assert states.count() <= S.BUCKETS
