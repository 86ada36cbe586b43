import pytest
from pyspark.sql import functions as F

from quillspark.functions import geometry as G
from quillspark.operators import layout
from quillspark.operators import relations as R


def rel(spark, text, terms=(("f", "force", 0), ("m", "motion", 0), ("m", "movement", 1))):
    t = spark.createDataFrame([(1, text)], "id long, text string")
    c = spark.createDataFrame(list(terms), "concept_id string, term string, ord int")
    return {(r.source, r.relation, r.target) for r in R.relations(t, R.mentions(t, c)).collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Force is a prerequisite for motion.", {("f", "PREREQUISITE_OF", "m")}),
        ("Motion requires force.", {("f", "PREREQUISITE_OF", "m")}),
        ("Before studying motion, look at force.", {("f", "PREREQUISITE_OF", "m")}),
        ("To understand motion you must know force.", {("f", "PREREQUISITE_OF", "m")}),
        ("A force is a type of movement.", {("f", "IS_A", "m")}),
        ("Force causes motion.", {("f", "CAUSES", "m")}),
        ("Force does not require motion, it is optional.", set()),
        ("Force and motion.", set()),
        ("Force causes " + "x" * 500 + " motion.", set()),
        (None, set()),
        ("", set()),
    ],
)
def test_relations(spark, text, want):
    assert rel(spark, text) == want


def test_mentions_take_the_name_before_aliases(spark):
    t = spark.createDataFrame([(1, "The movement of motion"), (2, "a movement"), (3, "emotion")], "id long, text string")
    c = spark.createDataFrame([("m", "Motion", 0), ("m", "movement", 1), ("n", "", 0), ("n", None, 1)], "concept_id string, term string, ord int")
    assert {(r.id, r.concept_id, r.start, r.term) for r in R.mentions(t, c).collect()} == {(1, "m", 17, "motion"), (2, "m", 3, "movement")}


def test_agreement(spark):
    f = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (1, "a")], "id long, item string")
    g = spark.createDataFrame([(1, "a"), (1, "z"), (3, "y")], "id long, item string")
    assert {tuple(r) for r in R.agreement(f, g).collect()} == {(1, 1, 1, 1), (2, 0, 1, 0), (3, 0, 0, 1)}


def test_asof_join(spark):
    l = spark.createDataFrame([("a", 5, "x"), ("a", 10, "y"), ("b", 1, "z"), (None, 3, "n")], "k string, t int, v string")  # noqa: E741
    r = spark.createDataFrame([("a", 5, 1.0), ("a", 7, None), ("b", 2, 3.0)], "k string, t int, s double")
    got = {(x.v, x.prev_t, x.prev_s) for x in R.asof_join(l, r, ["k"], "t", ["t", "s"]).collect()}
    assert got == {("x", None, None), ("y", 7, None), ("z", None, None), ("n", None, None)}
    at = {(x.v, x.prev_s) for x in R.asof_join(l, r, ["k"], "t", ["s"], strictly_before=False).collect()}
    assert ("x", 1.0) in at


def test_boxes(spark):
    b = G.box(F.lit(10.0), F.lit(20.0), F.lit(110.004), F.lit(900.0))
    turn = lambda r, bottom=False: tuple(spark.range(1).select(G.normalised(b, F.lit(600.0), F.lit(800.0), F.lit(r), bottom).alias("x")).first().x)
    assert turn(0) == (10.0, 20.0, 110.0, 800.0)
    assert turn(0, True) == (10.0, 0.0, 110.0, 780.0)
    assert turn(90) == (0.0, 10.0, 780.0, 110.0)
    assert turn(180) == (490.0, 0.0, 590.0, 780.0)
    assert turn(270) == (20.0, 490.0, 800.0, 590.0)
    s = spark.range(1).select(G.scaled(G.box(*[F.lit(500.0)] * 4), F.lit(1000.0), F.lit(1000.0), F.lit(600.0), F.lit(800.0)).alias("x"), G.coverage(F.array(F.lit(3.0), F.lit(9.0)), F.lit(10.0)).alias("c")).first()
    assert tuple(s.x) == (300.0, 400.0, 300.0, 400.0) and s.c == 1.0


def test_ocr_words_become_blocks(spark):
    w = [("D", 0, 50.0, 12.0, 90.0, 20.0, "world", 0.9), ("D", 0, 0.0, 10.0, 40.0, 20.0, "hello", 0.5), ("D", 0, 0.0, 30.0, 40.0, 40.0, "again", 0.1), ("D", 0, 0.0, 100.0, 40.0, 110.0, "far", 0.9), ("D", 1, 0.0, 0.0, 9.0, 9.0, "page", None)]
    df = spark.createDataFrame(w, "document_id string, page int, x0 double, y0 double, x1 double, y1 double, text string, confidence double")
    got = [(r.page, r.block, r.text, r.low_confidence, r.y1) for r in layout.ocr_blocks(df).orderBy("page", "block").collect()]
    assert got == [(0, 1, "hello world again", True, 40.0), (0, 2, "far", False, 110.0), (1, 1, "page", True, 9.0)]
    assert layout.ocr_blocks(df.limit(0)).collect() == []


def test_captions_and_page_types(spark):
    a = spark.createDataFrame([("D", 0, "a1", 100.0, 200.0), ("D", 0, "a2", 500.0, 600.0)], "document_id string, page int, asset_id string, y0 double, y1 double")
    b = spark.createDataFrame([("D", 0, "b1", 2, 220.0, 230.0, "Figure 1 shows"), ("D", 0, "b0", 1, 60.0, 80.0, "Table 2"), ("D", 0, "b3", 3, 610.0, 620.0, "Other")], "document_id string, page int, block_id string, position int, y0 double, y1 double, text string")
    assert {(r.asset_id, r.caption_id) for r in layout.captions(a, b).collect()} == {("a1", "b0"), ("a2", None)}
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0), (90, 0.0, 0.2, 0.3, 0), (90, 0.0, 0.2, 0.1, 0), (0, 0.0, 0.2, 0.9, 0), (90, 0.5, 0.2, 0.1, 0), (20, 0.5, 0.2, 0.1, 0)], "chars int, garbage double, ink double, cover double, vectors int")
    assert [r.page_type for r in layout.page_types(p).collect()] == ["blank", "hybrid", "native", "scanned", "scanned", "native"]
