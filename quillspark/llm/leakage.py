"""Evaluation texts leaking into training text.

Documents and test items are winnowed: of every stretch of ``min_words`` words at least one hashed run of half that
length is kept, so a document that holds so many consecutive words of an item shares a kept run with it. Joining the
kept runs names, for each document, the items it may hold; a fixed-size filter of the items' runs goes ahead and
spares most documents the join. A generalised suffix automaton of just these items then streams the document's words
through once and tracks the longest match that ends at each. It is one pass over the corpus however many items there
are, and nothing that grows with items or documents reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.broken_pairs import SuffixAutomaton
from quillspark.llm.words import WORD, words
from quillspark.session import stored

MIN_WORDS = 12
FILTER_SLOTS = 1 << 22  # of the filter ahead of the join: a fixed size
KEPT_AUTOMATA = 256  # a task holds for further documents with the same items


class ItemAutomaton(SuffixAutomaton):
    """Of many items: words of different items never match across, as a separator no text has stands between."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int) -> None:
        seq: list[str] = []
        for n, (_, w) in enumerate(items):
            seq += [*w, f"\0{n}"]
        super().__init__(seq)
        marks: list[set[int]] = [set() for _ in self.next]
        for item, w in items:
            v = 0
            for c in w:
                v = self.next[v][c]
                u = v
                while u > 0 and self.len[u] >= min_words and item not in marks[u]:
                    marks[u].add(item)
                    u = self.link[u]
        self.holds = [tuple(sorted(m)) for m in marks]
        self.min_words = min_words

    def matches(self, seq: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) wherever a match of at least min_words words ends."""
        nxt, link, length, least = self.next, self.link, self.len, self.min_words
        root = nxt[0]
        v = n = 0
        for i, c in enumerate(seq):
            if not v:
                v = root.get(c, 0)
                n = 1 if v else 0
            else:
                to = nxt[v].get(c)
                while to is None and v:
                    v = link[v]
                    n = length[v]
                    to = nxt[v].get(c)
                if to is None:
                    v = n = 0
                    continue
                v = to
                n += 1
            if n >= least:
                yield i, n, v

    def longest_by_item(self, seq: list[str]) -> dict[int, int]:
        best: dict[int, int] = {}
        for _, n, v in self.matches(seq):
            u = v
            while u > 0 and self.len[u] >= self.min_words:
                for item in self.holds[u]:
                    if best.get(item, 0) < n:
                        best[item] = n
                u = self.link[u]
                n = min(n, self.len[u])
        return best


def winnow(hashes: np.ndarray, min_words: int) -> np.ndarray:
    """Distinct kept runs of a text, given its words' hashes: the least of each window of neighbouring runs."""
    run = (min_words + 1) // 2
    window = min_words - run + 1
    n = len(hashes) - run + 1
    if n < window:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(run):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, window).min(1)).view(np.int64)


def _winnower(min_words: int, shared=None):
    """(key, text) -> (key, run); runs that the filter rules out are left away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        keep = shared.value if shared is not None else None

        def place(w: str) -> int:
            if len(memo) > 500_000:
                memo.clear()
            memo[w] = h = xxhash.xxh64_intdigest(w.encode())
            return h

        for b in batches:
            keys, runs = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                if len(w) < min_words:
                    continue
                got = winnow(np.array([memo[x] if x in memo else place(x) for x in w], np.uint64), min_words)
                if keep is not None:
                    got = got[keep[got & (FILTER_SLOTS - 1)]]
                if len(got):
                    keys.append(np.full(len(got), k, np.int64))
                    runs.append(got)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(runs))], names=["key", "run"])

    return run


def _suspects(docs: DataFrame, items: DataFrame, min_words: int) -> DataFrame:
    """docs (key, text, ...), items (item_id, text) -> (key, suspects array<struct<item_id, text>>) of documents that may hold one."""
    spark = docs.sparkSession
    items = stored(items.filter("item_id IS NOT NULL AND text IS NOT NULL").distinct().withColumn("at", F.xxhash64("item_id", "text")))
    known = stored(items.select("at", "text").mapInArrow(_winnower(min_words), "key bigint, run bigint").distinct())
    slots = known.select(F.col("run").bitwiseAND(F.lit(FILTER_SLOTS - 1)).alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)  # at most FILTER_SLOTS rows
    keep = np.zeros(FILTER_SLOTS, bool)
    keep[slots] = True
    found = docs.select("key", "text").mapInArrow(_winnower(min_words, spark.sparkContext.broadcast(keep)), "key bigint, run bigint")
    pairs = found.join(known.select("run", F.col("key").alias("at")), "run").select("key", "at").distinct()
    return pairs.join(items, "at").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("suspects"))


def _automata(min_words: int):
    """A maker of automata that keeps the last ones."""
    kept: dict[tuple, ItemAutomaton] = {}

    def of(suspects: list[dict]) -> ItemAutomaton:
        key = tuple((s["item_id"], s["text"]) for s in suspects)
        if key not in kept:
            if len(kept) >= KEPT_AUTOMATA:
                kept.clear()
            kept[key] = ItemAutomaton([(i, words(t)) for i, t in key], min_words)
        return kept[key]

    return of


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of one key have the same id and text, or share the suspects of both, which the automaton tells apart."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id bigint, item_id bigint, longest int): items of which a document holds ``min_words`` consecutive words, and how many at most.

    Defined cases: null and empty texts hold nothing; items shorter than ``min_words`` never leak; items with one
    text leak together; rows with a null item id are left out; repeated document rows give one row; whole texts
    are read; no items or no documents give no row; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _automata(min_words)
        for b in batches:
            rows = [(d, i, n) for d, t, s in zip(*(b.column(k).to_pylist() for k in range(3))) for i, n in of(s).longest_by_item(words(t)).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "longest"])

    rows = _keyed(docs, doc_id, text).filter("text IS NOT NULL")
    want = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    out = rows.join(_suspects(rows, want, min_words), "key").select("doc_id", "text", "suspects").mapInArrow(scan, "doc_id bigint, item_id bigint, longest int")
    return out.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, max_coverage: float = 0.5) -> DataFrame:
    """Every document: (doc_id, n_words, removed_words, dropped, clean_text).

    Leaked spans of at least ``min_words`` words are cut out; a document of which more than ``max_coverage`` lies
    in such spans is dropped (its clean_text is null). A null text stays null, with 0 words.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _automata(min_words)
        for b in batches:
            total, gone, drop, kept = [], [], [], []
            for t, suspects in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans = [(end - n + 1, end + 1) for end, n, _ in of(suspects).matches(words(t))] if suspects else []
                # Offsets in the text as it stands: lower-casing may change its length.
                at = [m.span() for m in WORD.finditer(t)] if t else []
                if spans and len(at) != len(words(t)):
                    t = t.lower()
                    at = [m.span() for m in WORD.finditer(t)]
                inside = bytearray(len(at))
                for a, e in spans:
                    inside[a:e] = b"\1" * (e - a)
                n = sum(inside)
                total.append(len(at))
                gone.append(n)
                drop.append(bool(at) and n > max_coverage * len(at))
                if t is None or drop[-1]:
                    kept.append(None)
                    continue
                piece, pos, i = [], 0, 0
                while i < len(at):
                    if inside[i]:
                        j = i
                        while j < len(at) and inside[j]:
                            j += 1
                        piece.append(t[pos : at[i][0]])
                        pos, i = at[j - 1][1], j
                    else:
                        i += 1
                kept.append("".join([*piece, t[pos:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int32()), pa.array(gone, pa.int32()), pa.array(drop, pa.bool_()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "removed_words", "dropped", "clean_text"])

    rows = _keyed(docs, doc_id, text)
    want = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    out = rows.join(_suspects(rows.filter("text IS NOT NULL"), want, min_words), "key", "left").select("doc_id", "text", "suspects")
    return out.mapInArrow(clean, "doc_id bigint, n_words int, removed_words int, dropped boolean, clean_text string")
