"""Mixing sources to target weights by the cube method.

The largest mix that every source can fill gives each source a factor: so many whole copies of all its documents,
and a fractional inclusion probability for one more. The flight phase moves these probabilities, three documents at
a time, along the null space of the two balancing equations (tokens and documents per source) until each is 0 or 1;
it runs in every group of documents on its own with constant memory and leaves at most two documents a source, which
fly on in ever fewer groups. Only the last two of a source are landed, by giving up first the document count, then
tokens. Groups are made by hashes of the documents' ids and flown in order of id, so the same documents always give the
same mix, however they lie in files and partitions.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import stored

#: Fixed value: the public pattern that splits text for byte_bpe_50k.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
GROUP = 50_000  # documents that fly together at first
FAN_IN = 256
EPS = 1e-9


def source_name(source: Column) -> Column:
    """Spelling aside: small letters, spaces and hyphens as underscores; null and blank stay null."""
    name = F.regexp_replace(F.lower(F.trim(source.cast("string"))), r"[\s\-_]+", "_")
    return F.when(F.length(name) > 0, name)


def with_tokens(df: DataFrame, text: str, tokenizer: str, pattern: str = PATTERN) -> DataFrame:
    """df without its text but with n_tokens bigint, of whole texts; null and empty texts have 0. ``tokenizer`` is the path of a vocabulary file of lines of base64 and rank."""
    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary, of fixed size
    keep = [c for c in df.columns if c not in (text, "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    src = df.select(*keep, F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + ["n_tokens bigint"]))


def _step(units: list[list], seed: int, equations: int) -> None:
    """Move the probabilities of the units in the null space of their first balancing equations until one is decided."""
    t = [float(u[1]) for u in units]
    if equations == 2:
        d = [t[1] - t[2], t[2] - t[0], t[0] - t[1]]
        if max(map(abs, d)) == 0.0:
            d = [1.0, -1.0, 0.0]
    else:
        d = [t[1], -t[0]] if t[0] or t[1] else [1.0, -1.0]
    up = min((1 - u[2]) / x if x > 0 else -u[2] / x for u, x in zip(units, d) if x)
    down = min(u[2] / x if x > 0 else (u[2] - 1) / x for u, x in zip(units, d) if x)
    draw = xxhash.xxh64_intdigest(repr([u[0] for u in units]).encode(), seed) / 2.0**64
    by = up if draw * (up + down) < down else -down
    for u, x in zip(units, d):
        u[2] = min(1.0, max(0.0, u[2] + by * x))


def _decided(p: float) -> bool:
    return p < EPS or p > 1 - EPS


def fly(stream: Iterator[tuple], seed: int) -> Iterator[tuple]:
    """(source, id, tokens, p) -> the same with p decided, but for at most two a source, which come last."""
    waiting: dict[str, list[list]] = {}
    for source, doc, tokens, p in stream:
        if _decided(p):
            yield source, doc, tokens, float(round(p))
            continue
        units = waiting.setdefault(source, [])
        units.append([doc, tokens, p])
        while len(units) == 3:
            _step(units, seed, 2)
            for u in [u for u in units if _decided(u[2])]:
                units.remove(u)
                yield source, u[0], u[1], float(round(u[2]))
    for source, units in waiting.items():
        for u in units:
            yield source, u[0], u[1], u[2]


def land(units: list[list], seed: int) -> list[list]:
    """Decide the last two of a source: keep the tokens' balance while two are left, then draw."""
    open_ = [u for u in units if not _decided(u[2])]
    while open_:
        if len(open_) >= 2:
            _step(open_[:2], seed, 1)
        else:
            u = open_[0]
            u[2] = float(xxhash.xxh64_intdigest(repr(u[0]).encode(), seed) / 2.0**64 < u[2])
        open_ = [u for u in open_ if not _decided(u[2])]
    return units


_SCHEMA = "source string, doc_id bigint, n_tokens bigint, p double, part int"


def _flight(seed: int, last: bool):
    """Rows sorted by group (part), source and id -> the same with p decided, but for at most two a group and source; with ``last`` for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32()))], names=["source", "doc_id", "n_tokens", "p", "part"])

        out: list[tuple] = []
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5))))
        for part, group in groupby(rows, key=lambda r: r[4]):
            rest: dict[str, list[list]] = {}
            for source, doc, tokens, p in fly((r[:4] for r in group), seed):
                if last and not _decided(p):
                    rest.setdefault(source, []).append([doc, tokens, p])
                    continue
                out.append((source, doc, tokens, p, part))
                if len(out) == 10_000:
                    yield flush(out)
                    out = []
            for source, units in rest.items():
                out += [(source, *u, part) for u in land(units, seed)]
        if out:
            yield flush(out)

    return run


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: float | None) -> tuple[float, dict[str, float]]:
    """(tokens of the mix, factor by source): shares of targets without tokens go to the others in proportion."""
    live = [(s, w, r) for s, w, r in targets if totals.get(s, 0) > 0 and w > 0 and r > 0]
    weight = sum(w for _, w, _ in live)
    if not live:
        return 0.0, {}
    most = min(r * totals[s] * weight / w for s, w, r in live)
    size = most if total_tokens is None else min(most, total_tokens)
    return size, {s: min(float(r), size * w / weight / totals[s]) for s, w, r in live}


class Mixture:
    """``mix`` (doc_id, source, n_tokens, copies) and ``report`` of a mix of ``docs`` to ``targets`` (source, target_share, max_repeats).

    ``total_tokens`` asks for a size; left out, the mix is the largest that every source can fill without repeating
    a document more than max_repeats times. Defined cases: null, empty and token-less texts and documents whose
    source is null or has no target are not mixed; a target without documents gets nothing and the others share
    its part in proportion; repeated target rows: the first by share counts; repeated document rows are documents
    of their own; empty tables give an empty mix; other columns are not read.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, seed: int = 42, *, tokenizer: str) -> None:
        want = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max_by("max_repeats", "target_share").alias("max_repeats"), F.max("target_share").alias("target_share"))
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")).join(want.select("source"), "source", "left_semi").filter("length(text) > 0")
        sized = stored(with_tokens(rows.select("source", "doc_id", "text"), "text", tokenizer).filter("n_tokens > 0"))
        totals = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row per target
        goals = [(r["source"], r["target_share"], r["max_repeats"] or 0) for r in want.collect()]
        self.size, factors = plan(totals, goals, total_tokens)
        spark = docs.sparkSession
        factor = spark.createDataFrame([(s, int(math.floor(f + EPS)), max(0.0, f - math.floor(f + EPS))) for s, f in sorted(factors.items())], "source string, whole int, p double")
        # A row per target: as small as the targets.
        start = sized.join(F.broadcast(factor.select("source", "p")), "source").select("source", "doc_id", "n_tokens", "p")
        groups = max(1, math.ceil(sized.count() / GROUP))
        rest = start.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
        settled, level = None, 0
        while True:
            flown = stored(rest.repartition("part").sortWithinPartitions("part", "source", "doc_id", "n_tokens").mapInArrow(_flight(seed + level, groups == 1), _SCHEMA))
            done = flown.filter(f"p < {EPS} OR p > {1 - EPS}")
            settled = done if settled is None else settled.unionByName(done)
            if groups == 1:
                break
            groups, level = -(-groups // FAN_IN), level + 1
            rest = flown.filter(f"p >= {EPS} AND p <= {1 - EPS}").withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        mixed = settled.join(F.broadcast(factor.select("source", "whole")), "source").select("doc_id", "source", "n_tokens", (F.col("whole") + F.round("p").cast("int")).alias("copies"))
        self.mix = mixed.filter("copies > 0")
        have = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"), F.max("copies").alias("most_copies"))
        full = want.join(have, "source", "left").fillna(0, ["documents", "tokens", "mixed_tokens", "mixed_documents", "most_copies"])
        # One row per target, so this window without a partition is small.
        self.report = full.withColumn("all_tokens", F.sum("mixed_tokens").over(Window.partitionBy())).select("source", "target_share", F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(F.lit(0.0)).alias("actual_share"), "max_repeats", "most_copies", "documents", "tokens", "mixed_documents", "mixed_tokens")
