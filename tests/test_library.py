import io
import random
import zipfile
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.functions import learning as L
from quillspark.functions import text as T
from quillspark.operators import cohort, graph, layout, resolve, retrieval
from quillspark.operators.tracing import GRID, calibration, misconceptions, trace
from quillspark.sources.documents import grid_markdown, is_supported, read_documents, validated
from quillspark.sources.store import read_active, read_records, unseen, upsert, write_records, write_version
from quillspark.streaming import answers as S

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)


def fold(obs, t=0.05, s=0.05, g=0.33, digits=True):
    p = 0.30
    for o in obs:
        a, b = (1 - s, g) if o else (s, 1 - g)
        post = p * a / (p * a + (1 - p) * b)
        p = max(0.01, min(0.99, post + (1 - post) * t))
        p = round(p * 10_000) / 10_000 if digits else p
    return p


def test_trace_of_a_key_split_over_tasks(spark):
    rng = random.Random(1)
    rows = [("hot", "c", f"i{n:05d}", n // 2, rng.choice([0.0, 0.4, 0.5, 1.0])) for n in range(3000)] + [(f"l{n % 9}", "c", f"j{n:05d}", n, rng.choice([0.0, 1.0])) for n in range(90)]
    extra = [(None, "c", "x", 1, 1.0), ("l1", None, "x", 1, 1.0), ("l1", "c", "x", 1, None), ("l1", "c", "y", 1, float("nan"))]
    df = spark.createDataFrame([(a, b, c, BASE + timedelta(seconds=d), e) for a, b, c, d, e in rows + rows[:100] + extra], "learner string, concept string, id string, ts timestamp, score double").repartition(7)
    got = {r.entity: r for r in trace(df, F.col("learner"), F.col("concept"), F.col("id"), F.col("ts"), F.col("score")).collect()}
    by = defaultdict(list)
    for a, _, i, t, s in sorted(rows, key=lambda r: (r[3], r[2])):
        by[a].append(int(s >= 0.5))
    assert set(got) == set(by)
    for k, obs in by.items():
        r = got[k]
        assert (r.mastery, r.attempts, r.correct, r.recent) == (fold(obs), len(obs), sum(obs), "".join(map(str, obs[-10:])))
    assert trace(df.limit(0), F.col("learner"), F.col("concept"), F.col("id"), F.col("ts"), F.col("score")).collect() == []


def test_bkt_sanity(spark):
    """Known sequences move mastery the right way and stay within bounds."""
    for seq, low, high in (([1] * 5, 0.9, 0.99), ([0] * 5, 0.01, 0.15), ([0, 0, 1, 1, 1, 1], 0.7, 0.99), ([1, 1, 1, 0], 0.3, 0.95)):
        assert low <= fold(seq) <= high
    r = spark.range(1).select(L.bkt_step(F.lit(0.3), F.lit(True)).alias("up"), L.bkt_step(F.lit(0.3), F.lit(False)).alias("down"), L.binary_entropy(F.lit(0.5)).alias("h"), L.noisy_or(F.array(F.lit(0.5), F.lit(0.5))).alias("n"), L.noisy_or(F.array().cast("array<double>")).alias("z")).first()
    assert r.up > 0.3 > r.down and r.h == 1.0 and r.n == 0.75 and r.z == 0.0


def test_calibration_matches_a_plain_fold(spark):
    rng = random.Random(2)
    rows = [(f"l{n % 5}", "c", f"i{n:04d}", BASE + timedelta(seconds=n), float(rng.random() < 0.6)) for n in range(120)]
    df = spark.createDataFrame(rows + rows[:7], "l string, c string, i string, t timestamp, s double")
    got = {(r.transit, r.slip, r.guess): r for r in calibration(df, F.col("l"), F.col("c"), F.col("i"), F.col("t"), F.col("s")).collect()}
    assert len(got) == len(GRID["transit"]) * len(GRID["slip"]) * len(GRID["guess"])
    for t, s, g in ((0.05, 0.05, 0.33), (0.3, 0.2, 0.15)):
        err = []
        for k in range(5):
            p = 0.3
            for j, o in enumerate(int(r[4]) for r in rows if r[0] == f"l{k}"):
                if j:
                    err.append((p * (1 - s) + (1 - p) * g - o) ** 2)
                a, b = (1 - s, g) if o else (s, 1 - g)
                post = p * a / (p * a + (1 - p) * b)
                p = max(0.01, min(0.99, post + (1 - post) * t))
        assert got[t, s, g].predictions == len(err) and got[t, s, g].rmse == pytest.approx((sum(err) / len(err)) ** 0.5)


def test_misconceptions_rise_fall_and_resolve(spark):
    seq = {"a": "W", "b": "WW", "c": "WWRR", "d": "RW", "e": "WR", "f": "WRWWW", "g": "R"}
    rows = [("l", k, BASE + timedelta(seconds=n), f"{k}{n}", x == "W") for k, v in seq.items() for n, x in enumerate(v)]
    got = {r.misconception_id: (round(r.confidence, 4), r.frequency, r.status) for r in misconceptions(spark.createDataFrame(rows + rows[:2], "learner_id string, misconception_id string, at timestamp, event_id string, wrong boolean")).collect()}
    assert got == {"a": (0.4, 1, "SUSPECTED"), "b": (0.65, 2, "SUPPORTED"), "c": (0.05, 2, "RESOLVED"), "d": (0.4, 1, "SUSPECTED"), "e": (0.1, 1, "RESOLVED"), "f": (0.85, 4, "SUPPORTED")}


def test_cohort_percentiles_are_by_place_with_missing_learners(spark):
    states = spark.createDataFrame([("a", "x", 0.9, 2), ("b", "x", 0.2, 1)], "learner_id string, concept_id string, mastery double, attempts long")
    roster = spark.createDataFrame([("k", "s", i) for i in "abcd"], "class_id string, subject_id string, learner_id string")
    concepts = spark.createDataFrame([("s", "x"), ("s", "y")], "subject_id string, concept_id string")
    r = {x.concept_id: x for x in cohort.concept_distribution(states, roster, concepts).collect()}
    assert (r["x"].enrolled, r["x"].p25_mastery, r["x"].p75_mastery, r["x"].median_mastery, r["x"].mean_mastery, r["x"].mean_attempts) == (4, 0.3, 0.9, 0.3, 0.425, 0.75)
    assert (r["y"].mean_mastery, r["y"].share_struggling) == (0.3, 1.0)


def test_bm25_prefers_rare_terms_and_breaks_ties_by_id(spark):
    docs = spark.createDataFrame([(1, "cells divide"), (2, "cells divide"), (3, "the mitochondria"), (4, None)], "id long, text string")
    q = spark.createDataFrame([(7, "Cell division: cells divide"), (8, "the"), (9, None)], "id long, text string")
    c, k = (retrieval.tokenised(x, F.col("id"), F.col("text")) for x in (docs, q))
    got = [(r.query, r.id, r["rank"]) for r in retrieval.bm25(c, k).orderBy("query", "rank").collect()]
    assert got == [(7, 2, 1), (7, 1, 2)]
    fused = retrieval.fuse({"lexical": retrieval.bm25(c, k), "vector": retrieval.cosine(c, k)}).orderBy("rank").collect()
    assert [r.id for r in fused] == [2, 1] and fused[0].score == pytest.approx(1.8 / 61, abs=1e-8)


def test_graph_channel_scores_by_distance(spark):
    q = spark.createDataFrame([(1, ["cell"])], "id long, tokens array<string>")
    c = spark.createDataFrame([("a", "Cells"), ("b", "Energy"), ("d", "Heat")], "concept_id string, name string")
    e = spark.createDataFrame([("a", "b"), ("d", "b")], "u string, v string")
    d = spark.createDataFrame([(10, "a"), (11, "b"), (12, "d"), (13, "z")], "id long, concept_id string")
    assert {(r.id, r.score) for r in retrieval.graph_channel(q, c, e, d).collect()} == {(10, 1.0), (11, 0.6), (12, 0.3)}


def test_topological_order_is_least_and_survives_cycles(spark):
    rows = [("t", "b", "c"), ("t", "a", "c"), ("t", "c", "d"), ("t", "x", "y"), ("t", "y", "x"), ("t", "y", "e"), ("u", "p", "q"), ("u", None, "q")]
    got = {(r.tree, r.place): (r.node, r.acyclic) for r in graph.topological_order(spark.createDataFrame(rows, "tree string, source string, target string")).collect()}
    assert [got["t", i] for i in range(7)] == [("a", True), ("b", True), ("c", True), ("d", True), ("e", False), ("x", False), ("y", False)]
    assert [got["u", i][0] for i in range(2)] == ["p", "q"]


def test_layout(spark):
    cols = "document_id string, page int, block_id string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double, text string, position int"
    two = [("a", 10, 100, 280, 110), ("b", 320, 100, 590, 110), ("c", 10, 200, 280, 210), ("d", 320, 200, 590, 210), ("w", 10, 150, 590, 160)]
    rows = [("D", 0, i, float(x0), float(y0), float(x1), float(y1), 600.0, 800.0, i, n) for n, (i, x0, y0, x1, y1) in enumerate(two)]
    got = layout.reading_order(spark.createDataFrame(rows, cols)).orderBy("position").collect()
    assert [r.block_id for r in got] == ["a", "b", "w", "c", "d"]
    pages = []
    for p in range(4):
        pages += [("D", p, f"h{p}", 0.0, 10.0, 100.0, 30.0, 600.0, 800.0, "Physics", 0), ("D", p, f"n{p}", 0.0, 780.0, 20.0, 795.0, 600.0, 800.0, str(p), 2), ("D", p, f"b{p}", 0.0, 300.0, 500.0, 400.0, 600.0, 800.0, "goes on" if p else "It does", 1)]
    marks = {r.block_id: r.furniture for r in layout.running_furniture(spark.createDataFrame(pages, cols)).collect()}
    assert (marks["h0"], marks["n3"], marks["b1"]) == ("header", "page_number", None)
    body = spark.createDataFrame([x for x in pages if x[2].startswith("b")], cols)
    assert {(r.block_id, r.continues_to) for r in layout.continuity(body).collect()} == {("b0", "b1"), ("b1", "b2"), ("b2", "b3")}
    sizes = spark.createDataFrame([("D", 0, 10.0), ("D", 1, 12.04), ("D", 2, 12.0), ("D", 3, 10.0)], "document_id string, position int, size double")
    assert layout.body_font_size(sizes).first().body_size == 10.0


def test_chunks_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for d in range(3):
        for i in range(120):
            rows.append((f"d{d}", i, None if i % 7 else f"s{i // 30}", rng.random() < 0.1, " ".join(["w"] * rng.choice([0, 5, 60, 200, 500]))))
    df = spark.createDataFrame(rows, "document_id string, position int, section_id string, is_heading boolean, text string").repartition(5)
    got = sorted((r.document_id, r.first_position, r.last_position, r.blocks, r.tokens) for r in layout.chunks(df).collect())
    want = []
    for d in range(3):
        cur, tokens, sec, known = [], 0, None, None
        for _, i, s, h, text in (r for r in rows if r[0] == f"d{d}"):
            if not text:
                continue
            known = s or known
            t = max(1, int(len(text.split()) * 1.3))
            if cur and (h and tokens >= 80 or sec is not None and known != sec or tokens + t > 500):
                want.append((f"d{d}", cur[0], cur[-1], len(cur), tokens))
                cur, tokens = [], 0
            cur.append(i)
            tokens += t
            sec = known
        want.append((f"d{d}", cur[0], cur[-1], len(cur), tokens))
    assert got == sorted(want)


def test_nesting(spark):
    rows = [("D", 1, "a", 1), ("D", 2, "b", 2), ("D", 3, "c", 3), ("D", 4, "d", 2), ("D", 5, "e", 1), ("D", 6, "f", 3)]
    got = {r.section_id: r.parent_id for r in layout.nest(spark.createDataFrame(rows, "document_id string, position int, section_id string, level int")).collect()}
    assert got == {"a": None, "b": "a", "c": "b", "d": "a", "e": None, "f": "e"}


def test_text_functions(spark):
    f = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert f(T.search_tokens(F.lit("The Classes of naïve boxes, studies & bias"))) == ["class", "naive", "box", "study", "bias"]
    assert f(T.search_tokens(F.lit(None).cast("string"))) == []
    assert f(T.entity_key(F.lit("Newton's Second Law, part II"))) == "newton 2 law part 2"
    assert f(T.fold_plural(F.lit("linear analyses"))) == "linear analys" and f(T.fold_plural(F.lit("calculus"))) == "calculus"
    assert f(T.rejoin_hyphens(F.lit("inter-\nnational x-\n1"))) == "international x-\n1"
    assert f(T.fold_ligatures(F.lit("ﬁnd ﬂow"))) == "find flow"
    assert f(T.markdown_table(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2"))))) == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert f(T.is_markdown_table(F.lit("| a |\n| --- |"))) and not f(T.is_markdown_table(F.lit("a | b")))
    assert f(T.is_bibliography(F.lit("Malkov, Y. A. (2020). Graphs."))) and not f(T.is_bibliography(F.lit("It was 2020.")))
    assert f(T.is_ocr_garbage(F.lit("Clot2"))) and f(T.is_ocr_garbage(F.lit("Pfgh x"))) and not f(T.is_ocr_garbage(F.lit("SQL base")))
    assert f(T.is_grounded(F.lit("bc"), F.lit("abcd"), F.lit(1), F.lit(3))) and not f(T.is_grounded(F.lit("zz"), F.lit("abcd"), F.lit(1), F.lit(3)))
    assert f(T.unit_interval(F.lit("1.7"))) == 1.0 and f(T.unit_interval(F.lit("x"))) == 0.5
    assert f(T.keywords(F.lit("Force is measured, Force in newton units."))) == ["Force", "measured"]
    assert f(T.options_clean(F.array(F.lit(" a "), F.lit(""), F.lit(None)))) == ["a"]
    g = lambda k, r, e: f(L.grade(F.lit(k), F.lit(r), F.lit(e)))
    assert (g("mcq", " A", "a"), g("true_false", "yes", "True"), g("numerical", "10.1 m", "10"), g("numerical", "11", "10"), g("numerical", "x", "10"), g("short_answer", "the rod bends", "rod bends quickly")) == (1.0, 1.0, 1.0, 0.0, 0.0, 0.67)
    assert f(L.grade(F.lit("mcq"), F.lit(None).cast("string"), F.lit("a"))) == 0.0


def test_resolution(spark):
    m = spark.createDataFrame([("Derivative", 3), ("derivatives", 1), ("Derivatives", 1), (None, 1), ("!!", 2)], "surface string, n long")
    r = resolve.clusters(m).collect()
    assert [(x.entity_key, x.canonical, x.surfaces, x.mentions) for x in r] == [("derivative", "Derivative", 3, 5)]
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x")], "k string, v int, t string")
    new = spark.createDataFrame([("a", 1, "y"), ("b", 4, "y"), ("c", 0, "y")], "k string, v int, t string")
    assert {(r.k, r.t) for r in upsert(old, new, ["k"], F.col("v")).collect()} == {("a", "y"), ("b", "x"), ("c", "y")}


def _docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Forces", "Heading1") + "".join(p(f"line {i}") for i in range(40)) + "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr><w:tr><w:tc>" + p("1") + "</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _pptx() -> bytes:
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    sp = lambda t, x, y, ph="": f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide2.xml", f"<p:sld {ns}><p:cSld><p:spTree>{sp('two', 0, 0)}</p:spTree></p:cSld></p:sld>")
        z.writestr("ppt/slides/slide1.xml", f"<p:sld {ns}><p:cSld><p:spTree>{sp('low', 0, 900)}{sp('right', 500, 100)}{sp('left', 10, 100)}{sp('Title', 0, 5000, '<p:ph type=' + chr(34) + 'title' + chr(34) + '/>')}</p:spTree></p:cSld></p:sld>")
        z.writestr("ppt/notesSlides/notesSlide1.xml", f"<p:notes {ns}><a:t>say this</a:t></p:notes>")
    return out.getvalue()


def test_document_sources(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx())
    (tmp_path / "b.pptx").write_bytes(_pptx())
    (tmp_path / "c.md").write_text("# Head\n\n- item\n" + "x" * 100 + "\n" * 60 + "end")
    (tmp_path / "d.docx").write_bytes(b"not a zip file")
    (tmp_path / "e.xyz").write_bytes(b"?")
    got = defaultdict(list)
    for r in read_documents(spark, str(tmp_path)).orderBy("path", "position").collect():
        got[r.path[-6:]].append((r.page, r.role, r.text, r.error))
    assert got["a.docx"][0][:3] == (0, "heading", "Forces") and got["a.docx"][-1][1:3] == ("table", "| a | b |\n| --- | --- |\n| 1 |  |") and got["a.docx"][-1][0] == 1
    assert [x[:3] for x in got["b.pptx"]] == [(0, "heading", "Title"), (0, "body", "left"), (0, "body", "right"), (0, "body", "low"), (0, "speaker_notes", "say this"), (1, "body", "two")]
    md = [v for k, v in got.items() if k.endswith("c.md")][0]
    assert [x[1] for x in md] == ["heading", "list", "body", "body", "body"] and md[-1][0] == 1
    assert got["d.docx"][0][3] and [v for k, v in got.items() if k.endswith("e.xyz")][0][0][3] == "unsupported format"
    files = spark.read.format("binaryFile").load(str(tmp_path))
    status = {r.path[-6:]: r.status for r in validated(files, least_bytes=5).collect()}
    assert (status["a.docx"], status["d.docx"], status["/e.xyz"[-6:]]) == ("valid", "bad_magic", "unsupported")
    assert spark.range(1).select(is_supported(F.lit("x/Y.PDF")).alias("x")).first().x and grid_markdown([]) == ""


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    write_records(df, str(tmp_path / "j"))
    (tmp_path / "j" / "bad.json").write_text('{"k": "c", "v": \n')
    good, bad = read_records(spark, str(tmp_path / "j"), df.schema)
    assert {tuple(r) for r in good.collect()} == {("a", 1), ("b", 2)} and bad.count() == 1
    for v in ("v1", "v2"):
        write_version(df.withColumn("ver", F.lit(v)), str(tmp_path / "s"), v)
    assert {r.ver for r in read_active(spark, str(tmp_path / "s")).collect()} == {"v2"}
    seen = df.filter("k = 'a'").select(F.sha2("k", 256).alias("content_hash"))
    assert [r.k for r in unseen(df, F.col("k"), seen).collect()] == ["b"]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"i{n:04d}", f"l{n % 4}", ["c"] if n % 3 else ["c", "d"], float(rng.random() < 0.5), 1.0, BASE + timedelta(minutes=7 * n)) for n in range(300)]
    df = spark.createDataFrame(rows + rows[:40], "interaction_id string, learner_id string, concept_ids array<string>, correctness double, score double, ts timestamp")
    path = str(tmp_path / "interactions.parquet")
    df.coalesce(1).write.parquet(path)
    stream = lambda: S.once(S.read_answers(spark, path), late="30 days")
    got = S.run_to_table(S.mastery_stream(stream()), str(tmp_path / "m"), "update", ["learner_id", "concept_id"], "attempts")
    batch = trace(df.withColumn("c", F.explode("concept_ids")), F.col("learner_id"), F.col("c"), F.col("interaction_id"), F.col("ts"), F.col("correctness"))
    assert {(r.learner_id, r.concept_id, r.mastery, r.attempts) for r in got.collect()} == {(r.entity, r.item, r.mastery, r.attempts) for r in batch.collect()}
    days = S.run_to_table(S.activity(stream()).select("start", "answers"), str(tmp_path / "d"), "update", ["start"])
    assert sum(r.answers for r in days.collect()) == 300
    sess = S.run_to_table(S.gap_sessions(S.once(S.read_answers(spark, path), late="1 minute"), "8 minutes").select("learner_id", "start", "end", "answers"), str(tmp_path / "g"), "append")
    assert sess.count() > 0
