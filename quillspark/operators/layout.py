"""Blocks, sections and chunks of documents: reading order, running furniture, continuity, nesting, chunking."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import token_estimate

MIN_TOKENS, MAX_TOKENS = 80, 500
MAX_LEVELS = 6


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks (document_id, page, block_id, x0, y0, x1, y1, page_width) with ``position`` from 1 a page.

    Two columns when at least two blocks lie on either side of the middle: blocks wider than 0.65 of the page part
    it into bands, within a band left comes before right; otherwise from top to bottom, then left to right.
    """
    page = Window.partitionBy("document_id", "page")
    mid = F.col("page_width") / 2
    wide = (F.col("x1") - F.col("x0")) > 0.65 * F.col("page_width")
    side = F.when(wide, "full").when(F.col("x1") <= mid + 20, "left").when(F.col("x0") >= mid - 20, "right").otherwise("left")
    b = blocks.withColumn("side", side)
    b = b.withColumn("two", (F.count_if(F.col("side") == "left").over(page) >= 2) & (F.count_if(F.col("side") == "right").over(page) >= 2))
    # The band of a block: full-width blocks that begin above it or with it; such a block closes its own band.
    above = F.count_if(F.col("side") == "full").over(page.orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    b = b.withColumn("band", F.when(F.col("side") == "full", above).otherwise(F.count_if(F.col("side") == "full").over(page.orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow)) + 1))
    place = F.when(F.col("side") == "left", 0).when(F.col("side") == "right", 1).otherwise(2)
    keys = [F.when(F.col("two"), F.col("band")).otherwise(0), F.when(F.col("two"), place).otherwise(0), F.col("y0"), F.when(F.col("two"), 0.0).otherwise(F.col("x0")), F.col("block_id")]
    return b.withColumn("position", F.row_number().over(page.orderBy(*keys))).drop("side", "two", "band")


def running_furniture(blocks: DataFrame) -> DataFrame:
    """blocks (document_id, page, block_id, y0, y1, page_height, text) with ``furniture``: page_number, header, footer or null.

    A text in the top or bottom 12 percent repeats when it stands on at least max(2, 0.3 of the pages); nothing is
    marked in documents of one page.
    """
    t = F.trim("text")
    band = F.when(F.col("y1") <= 0.12 * F.col("page_height"), "header").when(F.col("y0") >= 0.88 * F.col("page_height"), "footer")
    b = blocks.withColumn("band", band).withColumn("t", t)
    pages = b.groupBy("document_id").agg(F.count_distinct("page").alias("pages"))
    counts = b.filter("band IS NOT NULL AND t != ''").groupBy("document_id", "band", "t").agg(F.count("*").alias("times"))
    out = b.join(pages, "document_id").join(counts, ["document_id", "band", "t"], "left")
    number = F.col("band").isNotNull() & F.col("t").rlike(r"(?i)^(\d+|page\s+\d+(\s+of\s+\d+)?)$")
    mark = F.when(F.col("pages") < 2, None).when(number, "page_number").when(F.col("times") >= F.greatest(F.lit(2), F.floor(0.3 * F.col("pages"))), F.col("band"))
    return out.withColumn("furniture", mark).select(*blocks.columns, "furniture")


def body_font_size(spans: DataFrame) -> DataFrame:
    """spans (document_id, position, size) -> the most frequent size to one decimal; ties go to the one seen first."""
    s = spans.filter("size IS NOT NULL").groupBy("document_id", F.round("size", 1).alias("size")).agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return s.groupBy("document_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body_size"))


def continuity(blocks: DataFrame) -> DataFrame:
    """blocks (document_id, page, position, block_id, text) of body text -> (document_id, block_id, continues_to) across pages.

    A page's last block goes on in the next page's first when it lacks a closing mark and that one starts small.
    """
    t = F.trim("text")
    b = blocks.select("document_id", "page", "position", "block_id", t.alias("t")).filter("t != ''")
    ends = b.groupBy("document_id", "page").agg(F.max_by(F.struct("block_id", "t"), "position").alias("last"), F.min_by(F.struct("block_id", "t"), "position").alias("first"))
    nxt = ends.select("document_id", (F.col("page") - 1).alias("page"), F.col("first.block_id").alias("continues_to"), F.col("first.t").alias("next_text"))
    return ends.join(nxt, ["document_id", "page"]).filter(~F.col("last.t").rlike(r"[.!?:;]$") & F.col("next_text").rlike(r"^\p{Ll}")).select("document_id", F.col("last.block_id").alias("block_id"), "continues_to")


def forward_fill(blocks: DataFrame, partition: list[str], order: list[str], column: str, into: str) -> DataFrame:
    """The latest non-null value of ``column`` up to each row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn(into, F.last(column, ignorenulls=True).over(w))


def nest(headings: DataFrame) -> DataFrame:
    """headings (document_id, position, section_id, level) with ``parent_id``: the nearest earlier one of a smaller level.

    Levels beyond MAX_LEVELS count as that level, null ones as 1.
    """
    w = Window.partitionBy("document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    lv = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(MAX_LEVELS))
    h = headings.withColumn("lv", lv)
    seen = [F.last(F.when(F.col("lv") == k, F.struct(F.col("position").alias("p"), F.col("section_id").alias("s"))), ignorenulls=True).over(w) for k in range(1, MAX_LEVELS)]
    best = None
    for k, s in enumerate(seen, 1):
        c = F.when(F.col("lv") > k, s)
        best = c if best is None else F.greatest(best, c)
    return h.withColumn("parent_id", best["s"]).drop("lv")


def _chunker(min_tokens: int, max_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted blocks of (document, section run); holds one open chunk."""
        key, first, last, n, tokens = None, None, None, 0, 0
        out: list[tuple] = []

        def close() -> None:
            if n:
                out.append((key[0], key[1], first, last, n, tokens))

        def flush() -> pa.RecordBatch:
            c = list(zip(*out)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.int64())], names=["document_id", "run", "first_position", "last_position", "blocks", "tokens"])

        for b in batches:
            for doc, seg, pos, heading, t in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (doc, seg) != key or heading and tokens >= min_tokens or n and tokens + t > max_tokens:
                    close()
                    key, first, n, tokens = (doc, seg), pos, 0, 0
                n, tokens, last = n + 1, tokens + t, pos
            if len(out) > 10_000:
                yield flush()
                out = []
        close()
        if out:
            yield flush()

    return run


def chunks(blocks: DataFrame, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """blocks (document_id, position, section_id, is_heading, text) -> (document_id, run, first_position, last_position, blocks, tokens).

    Blank blocks are left out. A chunk ends before a heading once it has ``min_tokens``, where the section changes,
    and before a block that would take it beyond ``max_tokens``. Runs of one section are independent of each other,
    so a long document spreads over tasks by its sections. A null section continues the one before.
    """
    t = F.trim(F.coalesce("text", F.lit("")))
    b = forward_fill(blocks.filter(F.length(t) > 0), ["document_id"], ["position"], "section_id", "section")
    w = Window.partitionBy("document_id").orderBy("position")
    change = F.coalesce((F.col("section") != F.lag("section").over(w)).cast("int"), F.lit(0))
    b = b.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = b.select(F.col("document_id").cast("string").alias("document_id"), F.col("run").cast("long").alias("run"), F.col("position").cast("long").alias("position"), F.coalesce("is_heading", F.lit(False)).alias("h"), token_estimate(t).alias("t"))
    return rows.repartition("document_id", "run").sortWithinPartitions("document_id", "run", "position").mapInArrow(_chunker(min_tokens, max_tokens), "document_id string, run bigint, first_position bigint, last_position bigint, blocks int, tokens bigint")


def captions(assets: DataFrame, blocks: DataFrame, reach: float = 50.0) -> DataFrame:
    """assets (document_id, page, asset_id, y0, y1) with ``caption_id``: the first block in reading order that begins like a caption and lies within ``reach`` above or below.

    blocks (document_id, page, block_id, position, y0, y1, text). An equi-join on the page with a range condition.
    """
    c = blocks.filter(F.trim("text").rlike(r"(?i)^(figure|fig\.|table)\s+[0-9A-Za-z]+")).select("document_id", "page", "block_id", "position", F.col("y0").alias("by0"), F.col("y1").alias("by1"))
    near = assets.join(c, ["document_id", "page"]).filter((F.abs(F.col("by0") - F.col("y1")) <= reach) | (F.abs(F.col("y0") - F.col("by1")) <= reach))
    best = near.groupBy("document_id", "page", "asset_id").agg(F.min_by("block_id", "position").alias("caption_id"))
    return assets.join(best, ["document_id", "page", "asset_id"], "left")


def ocr_blocks(words: DataFrame, scale: float = 1.0, line_gap: float = 15.0, block_gap: float = 25.0, low: float = 0.60) -> DataFrame:
    """words (document_id, page, x0, y0, x1, y1, text, confidence) of one page each to blocks.

    Words sorted by (y0, x0) join a line while they begin within ``line_gap`` of its first word; a line joins a block
    while it begins within ``block_gap`` below the block's lowest edge. A page's words stream through one task.
    """
    out = "document_id string, page int, block int, text string, confidence double, low_confidence boolean, x0 double, y0 double, x1 double, y1 double"

    def run(batches):
        key, line, block, n = None, [], [], 0
        done: list[tuple] = []

        def close_block() -> None:
            nonlocal block, n
            if block:
                n += 1
                conf = sum(w[5] for w in block) / len(block)
                done.append((*key, n, " ".join(w[4] for w in block), round(conf, 4), conf < low, *(f(w[i] for w in block) / scale for i, f in ((0, min), (1, min), (2, max), (3, max)))))
            block = []

        def close_line() -> None:
            nonlocal line, block
            if line and block and min(w[1] for w in line) - max(w[3] for w in block) >= block_gap * scale:
                close_block()
            block += line
            line = []

        def flush() -> pa.RecordBatch:
            names = [c.split()[0] for c in out.split(", ")]
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()] + [pa.float64()] * 4
            cols = list(zip(*done)) if done else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for b in batches:
            for doc, page, *w in zip(*(b.column(i).to_pylist() for i in range(8))):
                if (doc, page) != key:
                    close_line()
                    close_block()
                    key, n = (doc, page), 0
                if line and abs(w[1] - line[0][1]) >= line_gap * scale:
                    close_line()
                line.append(w)
            if len(done) > 5000:
                yield flush()
                done.clear()
        close_line()
        close_block()
        if done:
            yield flush()

    w = words.select(F.col("document_id").cast("string"), F.col("page").cast("int"), *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")], F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    return w.repartition("document_id", "page").sortWithinPartitions("document_id", "page", "y0", "x0").mapInArrow(run, out)


def page_types(pages: DataFrame, blank_ink: float = 0.005, garbled: float = 0.15, scanned_cover: float = 0.5) -> DataFrame:
    """pages (.., chars, garbage, ink, cover, vectors) with ``page_type`` by the first rule: blank, hybrid, native, scanned."""
    c, g, i, v = F.col("chars"), F.col("garbage"), F.col("ink"), F.col("cover")
    kind = (
        F.when((i < blank_ink) & (c < 10) & (F.col("vectors") < 5), "blank")
        .when((c > 0) & (g < garbled) & (v >= 0.25), "hybrid")
        .when((c > 0) & (g < garbled), "native")
        .when((c == 0) & (v >= scanned_cover), "scanned")
        .when((c >= 50) & (g >= garbled), "scanned")
        .when(c > 0, "native")
        .otherwise("scanned")
    )
    return pages.withColumn("page_type", kind)
