"""Rules on terms, names and notation, case by case."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import notation as N
from quillspark.functions import terms as X
from quillspark.functions import text as T
from quillspark.operators import matching


def each(spark, values, build):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r.out for r in df.select("v", build(F.col("v")).alias("out")).collect()}


def test_verbs_have_their_forms():
    assert {"distributes", "distributing", "distributed", "running", "built", "begun", "committed", "identifies", "identified", "writing", "written", "occurred", "processes", "shown", "paid"} <= set(X.ACTIONS)
    assert "runned" not in X.ACTIONS and "presents" in X.INSIDE and "present" not in X.INSIDE


def test_trimming_and_filters(spark):
    got = each(spark, ["The Zorblax Protocol", "What", "Rules of", "the law of the", "Binary Search", "", None], X.trimmed)
    assert got == {"The Zorblax Protocol": "Zorblax Protocol", "What": "", "Rules of": "Rules", "the law of the": "law", "Binary Search": "Binary Search", "": "", None: None}
    bad = ["distributes load", "quickly", "static", "ab", "message presents data", "queue that waits", "term of art", "Search:", "a[1]", "load balancing with", "many"]
    good = ["Binary search", "Thermal equilibrium", "Ohm's law", "state machine"]
    got = each(spark, bad + good, X.is_fragment)
    assert all(got[b] for b in bad) and not any(got[g] for g in good)
    got = each(spark, ["Thus", "Hence the", "The", "Thus entropy", "However since"], X.is_discourse)
    assert got == {"Thus": True, "Hence the": True, "The": False, "Thus entropy": False, "However since": True}


def test_person_names(spark):
    text = "Team: Marla Quist Odell C B (1AB23CD456). Tolliver, R., & Brandt, J. wrote the Paper (ABC123)."
    keys = each(spark, [text], X.person_keys)[text]
    assert {"marla", "quist", "odell", "tolliver", "brandt"} <= set(keys) and "paper" not in keys
    df = spark.createDataFrame([("Quist Odell",), ("The Odell Model",), ("The",)], "t string").withColumn("k", F.array(*[F.lit(k) for k in keys]))
    assert {r.t: r.p for r in df.select("t", X.is_person(F.col("t"), F.col("k")).alias("p")).collect()} == {"Quist Odell": True, "The Odell Model": False, "The": False}


@pytest.mark.parametrize("a, b, near, variants", [("Newton's First Law", "Newton's Second Law", True, False), ("Newton’s 2nd Law", "newton's second law", False, True), ("speed", "velocity", True, False), ("Velocity", "velocity", False, True), ("Kinetic Energy", "potential energy", True, False), ("mass", "entropy", False, False), ("Chapter II", "chapter 2", False, True)])
def test_near_misses_and_variants(spark, a, b, near, variants):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(X.is_near_miss(F.col("a"), F.col("b")).alias("n"), X.are_variants(F.col("a"), F.col("b")).alias("v")).first()
    assert (r.n, r.v) == (near, variants)


def test_equivalents(spark):
    got = each(spark, ["Rate of change of velocity", "LAW OF INERTIA", "Gauss' law", "heat"], X.equivalent)
    assert got == {"Rate of change of velocity": "Acceleration", "LAW OF INERTIA": "Newton's First Law of Motion", "Gauss' law": "Gauss's Law", "heat": None}


def test_names_that_hold_each_other(spark):
    terms = spark.createDataFrame([("thermal energy",), ("Energy",), ("xy",), (None,), ("flux",), ("abc",)], "term string")
    names = [("1", "Geothermal Energy"), ("2", "energy"), ("3", "the flux law"), ("4", "flux"), ("5", None)]
    got = {(r.term, r.name_id, r.exact) for r in matching.best_names(terms, spark.createDataFrame(names, "name_id string, name string")).collect()}
    assert got == {("thermal energy", "1", False), ("energy", "2", True), ("flux", "4", True)}
    assert matching.best_names(terms.limit(0), spark.createDataFrame(names, "name_id string, name string")).collect() == []


def test_notation(spark):
    f = lambda a, b: N.equivalence(a, b)
    df = spark.createDataFrame([("F = m a", "f = M A"), ("v = u + at", "v = v_0 + a t"), ("s = u t", "d = u t"), ("E = m c^2", "V = I R")], "a string, b string")
    assert [r.s for r in df.select(f(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 0.95, 0.95, 0.1]
    assert each(spark, ["Y = C + I + G + NX", "(x^n)' = n x^(n-1)", "p = q"], N.law) == {"Y = C + I + G + NX": "macro_gdp_expenditure", "(x^n)' = n x^(n-1)": "derivative_power_rule", "p = q": None}
    r = df.limit(2).select(N.differences(F.col("a"), F.col("b")).alias("d")).collect()
    assert "v_" in r[1].d or r[1].d == ""
    glossary = F.create_map(F.lit("a"), F.lit("area"))
    assert each(spark, ["a"], lambda c: N.meaning(c, "mechanics", glossary)) == {"a": "area"} and each(spark, ["a", "Q x"], lambda c: N.meaning(c, "mechanics")) == {"a": "acceleration", "Q x": "qx"}


def test_accents_and_compatible_characters(spark):
    words = {"Dvořák": "dvorak", "Ťuhýk": "tuhyk", "ğüzel": "guzel", "Erdős": "erdo", "étude": "etude", "ﬁeld": "field", "Ångström": "angstrom"}
    got = each(spark, list(words), T.search_tokens)
    assert got == {k: [v] for k, v in words.items()}
    assert each(spark, ["Ｆｕｌｌ ｗｉｄｔｈ!", "x² ﬁt"], T.matching_key) == {"Ｆｕｌｌ ｗｉｄｔｈ!": "full width", "x² ﬁt": "x2 fit"}


def test_mentions_inside_words_and_by_any_alias(spark):
    from quillspark.operators.relations import mentions

    texts = spark.createDataFrame([(1, "The geothermal energy of the rock."), (2, "Entropies of heat death."), (3, None)], "id int, text string")
    terms = spark.createDataFrame([("c1", "thermal energy", 0), ("c2", "entropy", 0), ("c2", "heat death", 1), ("c3", "rock music", 0)], "concept_id string, term string, ord int")
    assert {(r.id, r.concept_id, r.start, r.term) for r in mentions(texts, terms).collect()} == {(1, "c1", 8, "thermal energy"), (2, "c2", 14, "heat death")}
