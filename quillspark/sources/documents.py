"""Document files to blocks: text, Markdown, Word and PowerPoint, read as binary files and parsed in the tasks.

Other formats (pdf, images) need a parser that the caller passes in as ``readers[suffix] = bytes -> rows``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The suffixes that are documents, and page sizes of formats without pages.
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "webp", "bmp", "tiff", "tif", "txt", "md", "markdown", "rst", "docx", "pptx")
BLOCKS_PER_PAGE, LINES_PER_PAGE, WRAP = 34, 50, 92
BLOCKS = "path string, page int, position int, role string, text string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
Row = tuple[int, str, str]


def is_supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*SUFFIXES)


def grid_markdown(rows: list[list[str]]) -> str:
    """Rows padded to the widest, as a markdown table."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def read_text(data: bytes) -> list[Row]:
    """Lines wrapped at WRAP letters, LINES_PER_PAGE a page."""
    out: list[Row] = []
    n = 0
    for line in data.decode("utf-8", errors="replace").splitlines():
        pieces = [line[i : i + WRAP] for i in range(0, len(line), WRAP)] or [""]
        for p in pieces:
            role = "heading" if re.match(r"#{1,6}\s", p) else "list" if re.match(r"\s*([-*•]|\d+[.)])\s", p) else "body"
            if p.strip():
                out.append((n // LINES_PER_PAGE, role, p))
            n += 1
    return out


def read_docx(data: bytes) -> list[Row]:
    """Paragraphs by style, then tables as markdown; BLOCKS_PER_PAGE a page."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    found: list[tuple[str, str]] = []
    tables = []
    for el in body if body is not None else ():
        if el.tag == f"{_W}p":
            text = "".join(t.text or "" for t in el.iter(f"{_W}t")).strip()
            style = el.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            if text:
                found.append(("heading" if name.startswith(("heading", "title")) else "list" if "list" in name else "body", text))
        elif el.tag == f"{_W}tbl":
            tables.append([["".join(t.text or "" for t in c.iter(f"{_W}t")).strip() for c in r.iter(f"{_W}tc")] for r in el.iter(f"{_W}tr")])
    found += [("table", grid_markdown(t)) for t in tables if t]
    return [(i // BLOCKS_PER_PAGE, role, text) for i, (role, text) in enumerate(found)]


def read_pptx(data: bytes) -> list[Row]:
    """A page per slide: shapes from top to bottom, then left to right, tables as markdown, speaker notes last."""
    z = zipfile.ZipFile(io.BytesIO(data))
    number = lambda n: int(re.search(r"(\d+)\.xml$", n).group(1))
    out: list[Row] = []
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
    for page, name in enumerate(slides):
        shapes = []
        for sp in ElementTree.fromstring(z.read(name)).iter():
            if sp.tag not in (f"{_P}sp", f"{_P}graphicFrame"):
                continue
            off = next(sp.iter(f"{_A}off"), None)
            at = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)
            kind = next(sp.iter(f"{_P}ph"), None)
            title = kind is not None and kind.get("type") in ("title", "ctrTitle")
            table = next(sp.iter(f"{_A}tbl"), None)
            if table is not None:
                text = grid_markdown([["".join(t.text or "" for t in c.iter(f"{_A}t")) for c in r.iter(f"{_A}tc")] for r in table.iter(f"{_A}tr")])
                shapes.append((at, "table", text))
            else:
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in sp.iter(f"{_A}p")).strip()
                if text:
                    shapes.append(((-1, -1) if title else at, "heading" if title else "body", text))
        out += [(page, role, text) for _, role, text in sorted(shapes, key=lambda s: s[0])]
        notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
        if notes in z.namelist():
            text = "\n".join(t.text or "" for t in ElementTree.fromstring(z.read(notes)).iter(f"{_A}t")).strip()
            if text:
                out.append((page, "speaker_notes", text))
    return out


READERS: dict[str, Callable[[bytes], list[Row]]] = {"txt": read_text, "md": read_text, "markdown": read_text, "rst": read_text, "docx": read_docx, "pptx": read_pptx}


def read_documents(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], list[Row]]] | None = None) -> DataFrame:
    """BLOCKS rows of all files under ``path``; a file that can't be read gives one row with its error."""
    table = READERS | (readers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                suffix = name.rpartition(".")[2].lower()
                try:
                    if suffix not in table:
                        raise ValueError(f"no reader for {suffix}" if suffix in SUFFIXES else "unsupported format")
                    rows = [(name, page, i, role, text, None) for i, (page, role, text) in enumerate(table[suffix](bytes(data)))]
                except Exception as e:  # noqa: BLE001
                    rows = [(name, None, None, None, None, str(e)[:200] or type(e).__name__)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")]).astype({"page": "Int32", "position": "Int32"})

    return files.mapInPandas(run, BLOCKS)


def validated(files: DataFrame, max_bytes: int = 100_000_000, least_bytes: int = 10) -> DataFrame:
    """binaryFile rows with ``status``: unsupported, too_large, too_small, bad_magic or valid, by the first rule that holds."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    magic = F.when(suffix == "pdf", F.hex(F.substring("content", 1, 4)) == "25504446").when(suffix.isin("docx", "pptx"), F.hex(F.substring("content", 1, 2)) == "504B").otherwise(F.lit(True))
    return files.withColumn("status", F.when(~suffix.isin(*SUFFIXES), "unsupported").when(F.col("length") > max_bytes, "too_large").when(F.col("length") < least_bytes, "too_small").when(~magic, "bad_magic").otherwise("valid"))
