"""Concepts found in text, and relations read off the words between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import is_hedged

REACH = 400
# Phrases by relation, in order of precedence; "whole" ones count anywhere in the text.
WHOLE_RECALL = ["recall", "before studying", "before learning"]
UNDERSTAND, UNDERSTAND_WITH = "to understand", ["know", "understand", "recall"]
PREREQUISITE = ["prerequisite", "is required for", "is required to", "is needed for", "is necessary for", "foundation for", "foundation of"]
WHOLE_PREREQUISITE = ["is a prerequisite for", "is a prerequisite of", "is required for"]
REQUIRES = ["requires", "depends on", "builds on", "relies on", "necessitates", "is based on", "extends"]
WHOLE_REQUIRES = ["requires", "depends on", "builds on", "relies on"]
BETWEEN = {
    "INSTANCE_OF": ["is an example of", "is an instance of", "is exemplified by", "such as"],
    "IS_A": ["is a type of", "is a kind of", "is a form of", "is categorized as"],
    "PART_OF": ["is part of", "is a component of", "is composed of", "subsystem of", "consists of"],
    "EXPLAINS": ["explains", "clarifies", "describes", "details", "outlines"],
    "CAUSES": ["causes", "leads to", "results in", "produces", "triggers"],
    "CONTRASTS_WITH": ["contrasts with", "differs from", "in contrast to", "as opposed to", "unlike"],
    "APPLIES_TO": ["applies to", "is applied to", "is applied in", "is used in", "utilized in"],
}


def _any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def mentions(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """First place of each concept in each text: (id, concept_id, start, term), start from 1.

    texts (id, text); terms (concept_id, term, ord): ord 0 is the name, aliases follow; the first term that occurs
    counts, also inside a longer word. Texts and concepts meet on any word of any of the concept's terms, and only
    what meets is searched, so no text is held against every concept. A concept none of whose words stands whole in
    a text is not found there.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[a-z0-9_-]{2,}"), F.lit(0)))
    t = terms.select("concept_id", F.lower(F.trim("term")).alias("term"), "ord").filter(F.length("term") > 0)
    low = texts.select("id", F.lower("text").alias("low")).filter("low IS NOT NULL")
    meet = low.select("id", F.explode(words(F.col("low"))).alias("token")).join(t.select("concept_id", F.explode(words(F.col("term"))).alias("token")).distinct(), "token").select("id", "concept_id").distinct()
    hits = meet.join(t, "concept_id").join(low, "id").withColumn("start", F.expr("instr(low, term)")).filter("start > 0")
    return hits.groupBy("id", "concept_id").agg(F.min_by(F.struct("start", "term"), F.struct("ord", "term")).alias("m")).select("id", "concept_id", "m.start", "m.term")


def relations(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(id, source, relation, target): distinct, of ordered pairs of mentions at most REACH letters apart.

    Hedged texts are passed over. The first rule that holds decides; prerequisite rules may be met by the whole
    text, the others only by the words between. Both readings of a pair are tried, as their rules differ.
    """
    low = texts.select("id", F.lower("text").alias("low")).filter(F.col("low").isNotNull() & ~is_hedged(F.col("low")))
    m = found.select("id", "concept_id", "start", (F.col("start") + F.length("term")).alias("end"))
    a, b = (m.select("id", *[F.col(c).alias(f"{c}_{x}") for c in ("concept_id", "start", "end")]) for x in ("a", "b"))
    p = a.join(b, "id").filter((F.col("concept_id_a") != F.col("concept_id_b")) & (F.col("start_a") != F.col("start_b")) & (F.abs(F.col("start_a") - F.col("start_b")) <= REACH)).join(low, "id")
    forward = F.col("start_a") < F.col("start_b")
    first_start, first_end, second = F.when(forward, F.col("start_a")).otherwise(F.col("start_b")), F.when(forward, F.col("end_a")).otherwise(F.col("end_b")), F.greatest("start_a", "start_b")
    begin = F.when(first_end <= second, first_end).otherwise(first_start)
    p = p.withColumn("mid", F.substr("low", begin, second - begin)).withColumn("fw", forward)
    whole, mid = F.col("low"), F.col("mid")
    rule = (
        F.when(_any(whole, WHOLE_RECALL), "R")
        .when(F.contains(whole, F.lit(UNDERSTAND)) & _any(whole, UNDERSTAND_WITH), "R")
        .when(_any(mid, PREREQUISITE) | _any(whole, WHOLE_PREREQUISITE), "P")
        .when(_any(mid, REQUIRES) | F.col("fw") & _any(whole, WHOLE_REQUIRES), "R")
    )
    for name, phrases in BETWEEN.items():
        rule = rule.when(_any(mid, phrases), name)
    p = p.withColumn("rule", rule).filter("rule IS NOT NULL")
    earlier, later = F.when(F.col("fw"), F.col("concept_id_a")).otherwise(F.col("concept_id_b")), F.when(F.col("fw"), F.col("concept_id_b")).otherwise(F.col("concept_id_a"))
    back = F.col("rule") == "R"
    return p.select("id", F.when(back, later).otherwise(earlier).alias("source"), F.when(F.col("rule").isin("R", "P"), "PREREQUISITE_OF").otherwise(F.col("rule")).alias("relation"), F.when(back, earlier).otherwise(later).alias("target")).distinct()


def agreement(found: DataFrame, golden: DataFrame) -> DataFrame:
    """Per id: true positives, false positives, false negatives of (id, item) pairs against golden ones."""
    f = found.select("id", "item").distinct().withColumn("f", F.lit(1))
    g = golden.select("id", "item").distinct().withColumn("g", F.lit(1))
    j = f.join(g, ["id", "item"], "full_outer")
    return j.groupBy("id").agg(F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str], strictly_before: bool = True) -> DataFrame:
    """left with the ``take`` columns of the last right row of the same key before (or at) its time, prefixed ``prev_``.

    One sort of both sides together; rows of equal time are ordered right after left when strictly before.
    """
    side = F.lit(1 if strictly_before else 0)
    l = left.select(*left.columns, F.struct(*[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take]).alias("__r"), F.lit(False).alias("__has"), (1 - side).alias("__o"))  # noqa: E741
    r = right.select(*[F.col(c) if c in (*by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.struct(*take).alias("__r"), F.lit(True).alias("__has"), side.alias("__o"))
    w = Window.partitionBy(*by).orderBy(at, "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = l.unionByName(r).withColumn("__p", F.last(F.when(F.col("__has"), F.col("__r")), ignorenulls=True).over(w)).filter("NOT __has")
    return u.select(*left.columns, *[F.col(f"__p.{c}").alias(f"prev_{c}") for c in take])
