"""Terms and names that hold each other, without comparing all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(text):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda k: F.substr(text, k, F.lit(GRAM))))


def holding(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name): pairs in small letters of which one is a part of the other; terms (term), names (name), both of three letters or more.

    The shorter one's first three letters stand somewhere in the longer one, so pairs meet on three-letter grams and
    the substring test runs on what meets. Repeated and null rows change nothing.
    """
    t = terms.select(F.lower(F.trim("term")).alias("term")).filter(F.length("term") >= GRAM).distinct()
    n = names.select(F.lower(F.trim("name")).alias("name")).filter(F.length("name") >= GRAM).distinct()
    head = lambda c: F.substr(F.col(c), F.lit(1), F.lit(GRAM)).alias("g")
    a = t.select("term", head("term")).join(n.select("name", F.explode(_grams(F.col("name"))).alias("g")), "g").filter(F.contains("name", F.col("term")))
    b = n.select("name", head("name")).join(t.select("term", F.explode(_grams(F.col("term"))).alias("g")), "g").filter(F.contains("term", F.col("name")))
    return a.select("term", "name").unionByName(b.select("term", "name")).distinct()


def best_names(terms: DataFrame, names: DataFrame) -> DataFrame:
    """Per term the name it means: (term, name_id, name, exact). names (name_id, name): the same name first, then one that holds it or that it holds; the least id first."""
    p = holding(terms, names).join(names.select("name_id", F.lower(F.trim("name")).alias("name")).distinct(), "name").withColumn("exact", F.col("term") == F.col("name"))
    return p.groupBy("term").agg(F.min_by(F.struct("name_id", "name", "exact"), F.struct(~F.col("exact"), F.col("name_id"), F.col("name"))).alias("b")).select("term", "b.*")
