"""Percentiles of very large numeric columns by radix selection.

A double becomes a 64-bit integer of the same order. Each pass counts one 16-bit digit per group, and only
rows whose higher digits lead to a wanted rank take part in the next pass; the counts are partial sums before the
shuffle, so a hot group is no heavier than any other. Stopping after ``digits`` passes bounds the error: the true
value lies between the two ends of the digit that was reached. Histograms of leading digits add up, so days and
partitions can be summarised apart and combined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType

from quillspark.session import cut, stored


@pandas_udf(LongType())
def order_key(v: pd.Series) -> pd.Series:
    """Signed integers in the order of the doubles; -0.0 counts as 0.0, null stays null."""
    x = v.to_numpy(dtype="float64", na_value=np.nan) + 0.0
    b = x.view(np.int64)
    return pd.Series(b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).where(v.notna())


@pandas_udf(DoubleType())
def key_value(k: pd.Series) -> pd.Series:
    """The double of an order key."""
    b = k.to_numpy(dtype="int64")
    return pd.Series((b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def _rank(percent: Column, n: Column) -> Column:
    """Rank of a percentile, from 1: the least r with r/n >= percent/100."""
    return F.greatest(F.lit(1), F.ceil(percent * n / 100.0)).cast("long")


def select_ranks(rows: DataFrame, group: str, percents: list[float], digits: int = 4) -> DataFrame:
    """rows: (group, key long, n long), keys as often as they like. Gives group, percent, n, lower, upper (values).

    With 4 digits lower = upper = the exact value; with d digits they share their first 16*d bits, so for d = 2
    upper - lower <= 2**-20 of the value.
    """
    shift = lambda d: 64 - 16 * d
    sizes = rows.groupBy(group).agg(F.sum("n").alias("total"))
    at = sizes.withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents]))).withColumn("rest", _rank(F.col("percent"), F.col("total"))).withColumn("prefix", F.lit(0).cast("long"))
    at = cut(at)  # |groups| x |percents| rows
    for d in range(1, digits + 1):
        digit = F.shiftright("key", shift(d)) if d == 1 else F.shiftright("key", shift(d)).bitwiseAND(F.lit(0xFFFF))
        prefix = F.lit(0).cast("long") if d == 1 else F.shiftright("key", shift(d - 1))
        body = rows.select(group, prefix.alias("prefix"), digit.cast("long").alias("digit"), "n")
        if d > 1:
            body = body.join(at.select(group, "prefix").distinct(), [group, "prefix"], "left_semi")
        hist = body.groupBy(group, "prefix", "digit").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(group, "prefix").orderBy("digit")  # at most 65,536 rows a window
        hist = hist.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n")).drop("n")
        at = (
            at.join(hist, [group, "prefix"])
            .filter((F.col("rest") > F.col("before")) & (F.col("rest") <= F.col("upto")))
            .select(group, "percent", "total", (F.col("rest") - F.col("before")).alias("rest"), (F.col("digit") if d == 1 else F.shiftleft("prefix", 16).bitwiseOR(F.col("digit"))).alias("prefix"))
        )
        if d < digits:
            at = cut(at)
    s = shift(digits)
    low = F.shiftleft("prefix", s) if s else F.col("prefix")
    high = low.bitwiseOR(F.lit((1 << s) - 1)) if s else low
    return at.select(group, "percent", F.col("total").alias("n"), key_value(low).alias("lower"), key_value(high).alias("upper"))


def exact_percentiles(df: DataFrame, group: str, value: Column, percents: list[float], digits: int = 4) -> DataFrame:
    """Percentiles of ``value`` per ``group``: group, percent, n, lower, upper.

    Defined cases: null and NaN values and rows of a null group are left out; infinities take part, in order;
    equal values are counted each; an empty table gives no row; other columns are not read.
    """
    v = value.cast("double")
    rows = df.select(F.col(group), v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v") & F.col(group).isNotNull())
    return select_ranks(stored(rows.select(group, order_key("v").alias("key"), F.lit(1).cast("long").alias("n"))), group, percents, digits)


def histogram(df: DataFrame, keys: list[str], value: Column, bits: int = 32) -> DataFrame:
    """A mergeable summary: (keys, key, n), ``key`` being the order key cut to its ``bits`` leading bits."""
    v = value.cast("double")
    rows = df.select(*keys, v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    k = F.shiftleft(F.shiftright(order_key("v"), 64 - bits), 64 - bits)
    return rows.select(*keys, k.alias("key")).groupBy(*keys, "key").agg(F.count("*").alias("n"))


def merge_histograms(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Add summaries of several days or partitions up to the coarser ``keys``."""
    return hist.groupBy(*keys, "key").agg(F.sum("n").alias("n"))
