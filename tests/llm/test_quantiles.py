import math

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm.quantiles import exact_percentiles, histogram, merge_histograms, select_ranks


def test_percentiles_are_exact_order_statistics(spark):
    rng = np.random.default_rng(3)
    v = [*rng.normal(size=500).tolist(), *([0.25] * 100), -0.0, 0.0, float("inf"), float("-inf"), 5e-324, -1e300]
    df = spark.createDataFrame([("g", x) for x in v] + [("one", 7.0), ("g", None), ("g", float("nan")), (None, 1.0)], "concept string, x double")
    got = {(r.concept, r.percent): (r.n, r.lower, r.upper) for r in exact_percentiles(df, "concept", F.col("x"), [0.0, 5.0, 50.0, 99.0, 100.0]).collect()}
    s = sorted(v)
    for p in (0.0, 5.0, 50.0, 99.0, 100.0):
        want = s[max(1, math.ceil(p * len(s) / 100)) - 1]
        assert got["g", p] == (len(s), want, want)
        assert got["one", p] == (1, 7.0, 7.0)
    assert len(got) == 10


def test_daily_histograms_combine_within_their_bound(spark):
    rng = np.random.default_rng(4)
    v = rng.uniform(0.01, 0.99, 400)
    df = spark.createDataFrame([(f"d{i % 5}", "c", float(x)) for i, x in enumerate(v)], "day string, c string, x double")
    whole = merge_histograms(histogram(df, ["day", "c"], F.col("x")), ["c"])
    for r in select_ranks(whole, "c", [10.0, 50.0, 90.0], digits=2).collect():
        want = np.sort(v)[math.ceil(r.percent * 4) - 1]
        assert r.lower <= want <= r.upper and r.upper - r.lower <= want * 2**-19


def test_empty_percentiles(spark):
    assert exact_percentiles(spark.createDataFrame([], "g string, x double"), "g", F.col("x"), [50.0]).collect() == []
