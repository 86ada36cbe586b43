"""Per-entity feature table.

One range exchange on (entity, type, event id) buckets and sorts the events; a hot entity spreads over as many
buckets as it needs. Each sorted bucket is streamed once: runs of one (entity, type) become a counter, two totals
and a latest time, and all runs of an entity leave as one wide row. Only the entity cut by a bucket's border
(at most two rows a bucket) is put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import stored

ENTRY = "struct<type:string,n:bigint,last_us:bigint,seconds:double,score:double>"
_CELL = pa.struct([("type", pa.string()), ("n", pa.int64()), ("last_us", pa.int64()), ("seconds", pa.float64()), ("score", pa.float64())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (entity, type, event_id, at_us, seconds, score) -> (entity, cells, edge); holds one entity's runs at a time."""
    held: list[dict] = []  # runs of the entity still open, one per type
    held_entity, last, first_out = None, None, True

    def out(entities: list, cells: list[list[dict]], last_one: bool) -> pa.RecordBatch:
        nonlocal first_out
        edge = [False] * len(entities)
        if entities and first_out:
            edge[0], first_out = True, False
        if entities and last_one:
            edge[-1] = True
        return pa.RecordBatch.from_arrays([pa.array(entities, pa.string()), pa.array(cells, pa.list_(_CELL)), pa.array(edge)], names=["entity", "cells", "edge"])

    for b in batches:
        if not b.num_rows:
            continue
        e, t, i = (np.asarray(b.column(k).to_pylist(), dtype=object) for k in range(3))
        at, sec, sco = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
        pe, pt, pi = (np.concatenate([[last[k] if last else None], x[:-1]]) for k, x in enumerate((e, t, i)))
        same = (e == pe) & (t == pt)
        keep = ~(same & (i == pi) & np.array([x is not None for x in i]))
        last = (e[-1], t[-1], i[-1])
        run = ~same
        run[0] = True
        starts = np.flatnonzero(run)
        n = np.add.reduceat(keep.astype(np.int64), starts)
        late = np.maximum.reduceat(at, starts)
        s1 = np.add.reduceat(np.where(keep, sec, 0.0), starts)
        s2 = np.add.reduceat(np.where(keep, sco, 0.0), starts)
        done_e: list = []
        done_c: list = []
        for who, kind, c, l, x, y in zip(e[starts], t[starts], n.tolist(), late.tolist(), s1.tolist(), s2.tolist()):
            if who != held_entity:
                if held_entity is not None:
                    done_e.append(held_entity)
                    done_c.append(held)
                held_entity, held = who, []
            if held and held[-1]["type"] == kind:
                cell = held[-1]
                cell["n"] += c
                cell["last_us"] = max(cell["last_us"], l)
                cell["seconds"] += x
                cell["score"] += y
            else:
                held.append({"type": kind, "n": c, "last_us": l, "seconds": x, "score": y})
        if done_e:
            yield out(done_e, done_c, False)
    if held_entity is not None:
        yield out([held_entity], [held], True)


def feature_table(df: DataFrame, entity: Column, types: Column, event_id: Column, at: Column, seconds: Column, score: Column) -> DataFrame:
    """One row per entity: entity, events (typed events), kinds, last_us, features map<type, struct<n, last_us, seconds, score>>.

    ``types`` is an array<string> column: an event counts once in each distinct type it names. Defined cases: a
    null entity or time and a null type are left out; a null or empty array gives no event; rows repeating
    (entity, type, event_id) count once, a null event_id each time; null, NaN or negative seconds and null or NaN
    scores add 0; an empty table gives no row; other columns are not read.
    """
    num = lambda c: F.when(F.isnan(c.cast("double")) | c.isNull() | (c < 0), F.lit(0.0)).otherwise(c.cast("double"))
    events = (
        df.select(entity.cast("string").alias("entity"), F.explode(F.array_distinct(types)).alias("type"), event_id.cast("string").alias("event_id"), F.unix_micros(at.cast("timestamp")).alias("at_us"), num(seconds).alias("seconds"), num(score).alias("score"))
        .filter(F.col("entity").isNotNull() & F.col("type").isNotNull() & F.col("at_us").isNotNull())
    )
    keys = ["entity", "type", "event_id"]
    wide = stored(events.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_stream, f"entity string, cells array<{ENTRY}>, edge boolean"))
    cut = wide.filter("edge").select("entity", F.explode("cells").alias("c")).groupBy("entity", F.col("c.type").alias("type"))
    joined = cut.agg(F.sum("c.n").alias("n"), F.max("c.last_us").alias("last_us"), F.sum("c.seconds").alias("seconds"), F.sum("c.score").alias("score"))
    joined = joined.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("type", "n", "last_us", "seconds", "score"))).alias("cells"))
    rows = wide.filter("NOT edge").select("entity", "cells").unionByName(joined)
    total = lambda f, zero, op: F.aggregate("cells", F.lit(zero).cast("long"), lambda a, x: op(a, x[f]))
    return rows.select(
        "entity",
        total("n", 0, lambda a, x: a + x).alias("events"),
        F.size("cells").alias("kinds"),
        total("last_us", -(2**62), F.greatest).alias("last_us"),
        F.map_from_entries(F.transform("cells", lambda c: F.struct(c["type"], F.struct(c["n"].alias("n"), c["last_us"].alias("last_us"), c["seconds"].alias("seconds"), c["score"].alias("score"))))).alias("features"),
    )


def widen(features: DataFrame, types: list[str]) -> DataFrame:
    """Real columns n__T, last_us__T, seconds__T and score__T for the listed types; 0 or null where an entity has none."""
    cell = lambda t: F.try_element_at("features", F.lit(t))
    cols = ["entity"]
    for t in types:
        cols += [F.coalesce(cell(t)["n"], F.lit(0)).alias(f"n__{t}"), cell(t)["last_us"].alias(f"last_us__{t}"), F.coalesce(cell(t)["seconds"], F.lit(0.0)).alias(f"seconds__{t}"), F.coalesce(cell(t)["score"], F.lit(0.0)).alias(f"score__{t}")]
    return features.select(*cols)
