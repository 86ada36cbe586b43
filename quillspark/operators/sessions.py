"""Grouping activity into sessions.

A range exchange on (entity, time, event id) splits any hot entity over tasks, a secondary sort orders each
partition, and one linear scan with constant memory emits sessions as they close. Only the first and the last
session of a partition may continue in a neighbour; these at most two rows a partition are stitched afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import stored

SCANNED = (
    "entity string, first_id string, last_id string, first_begin long, first_us long, start_us long, end_us long, "
    "answers long, active_us long, part int, seq long, edge boolean"
)


def _scanner(gap_us: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_row: dict | None = None
        last_key: tuple | None = None
        seq = 0

        def frame(rows: pd.DataFrame, ends: bool) -> pd.DataFrame:
            nonlocal seq
            n = len(rows)
            rows = rows.assign(part=np.int32(part), seq=np.arange(seq, seq + n), edge=False)
            edge = np.zeros(n, bool)
            if seq == 0 and n:
                edge[0] = True
            if ends and n:
                edge[-1] = True
            rows["edge"] = edge
            seq += n
            return rows

        for pdf in batches:
            if not len(pdf):
                continue
            who, eid = pdf["entity"].to_numpy(), pdf["event_id"].to_numpy()
            at, dur = pdf["at_us"].to_numpy(), pdf["dur_us"].to_numpy()
            prev_who = np.concatenate([[last_key[0] if last_key else None], who[:-1]])
            prev_id = np.concatenate([[last_key[2] if last_key else None], eid[:-1]])
            prev_at = np.concatenate([[last_key[1] if last_key else 0], at[:-1]])
            keep = ~((who == prev_who) & (at == prev_at) & (eid == prev_id) & pd.notna(eid))
            last_key = (who[-1], at[-1], eid[-1])
            # A dropped copy has the same entity and time as the row before it, so the gaps of the others stand.
            who, eid, at, dur = who[keep], eid[keep], at[keep], dur[keep]
            prev_who, prev_at = prev_who[keep], prev_at[keep]
            if not len(who):
                continue
            begin = at - dur
            new = (who != prev_who) | (begin - prev_at > gap_us)
            heads = np.flatnonzero(new)
            if not len(heads) or heads[0] != 0:
                heads = np.concatenate([[0], heads])
                joins = True
            else:
                joins = False
            tails = np.concatenate([heads[1:], [len(who)]]) - 1
            rows = pd.DataFrame(
                {
                    "entity": who[heads],
                    "first_id": eid[heads],
                    "last_id": eid[tails],
                    "first_begin": begin[heads],
                    "first_us": at[heads],
                    "start_us": np.minimum.reduceat(begin, heads),
                    "end_us": at[tails],
                    "answers": tails - heads + 1,
                    "active_us": np.add.reduceat(dur, heads),
                }
            )
            if open_row is not None:
                if joins:
                    rows.loc[0, ["first_id", "first_begin", "first_us"]] = [open_row["first_id"], open_row["first_begin"], open_row["first_us"]]
                    rows.loc[0, "start_us"] = min(open_row["start_us"], rows.loc[0, "start_us"])
                    rows.loc[0, "answers"] += open_row["answers"]
                    rows.loc[0, "active_us"] += open_row["active_us"]
                else:
                    rows = pd.concat([pd.DataFrame([open_row]), rows], ignore_index=True)
            open_row = rows.iloc[-1].to_dict()
            if len(rows) > 1:
                yield frame(rows.iloc[:-1], ends=False)
        if open_row is not None:
            yield frame(pd.DataFrame([open_row]), ends=True)

    return scan


def sessionize(df: DataFrame, entity: Column, event_id: Column, at: Column, seconds: Column, gap_seconds: float = 1800.0) -> DataFrame:
    """One row per session: entity, session_no, first_id, last_id, start, end, duration_seconds, active_seconds, answers.

    An event lasts from ``at - seconds`` to ``at``; a session ends where the entity's next event, in order of
    (at, event_id), begins more than ``gap_seconds`` after the last one's ``at``. Defined cases: a null, NaN,
    infinite or negative duration counts as 0; rows with a null entity or time belong to no session; rows that
    repeat (entity, at, event_id) count once; a null event_id is an event of its own; ties in time are ordered
    by event_id; an empty table gives no row; other columns, whatever their names, are not read.
    """
    d = seconds.cast("double")
    events = df.select(
        entity.cast("string").alias("entity"),
        event_id.cast("string").alias("event_id"),
        F.unix_micros(at.cast("timestamp")).alias("at_us"),
        F.when((d > 0) & (d < 1e12), F.round(d * 1e6).cast("long")).otherwise(F.lit(0)).alias("dur_us"),
    ).filter(F.col("entity").isNotNull() & F.col("at_us").isNotNull())
    keys = ["entity", "at_us", "event_id"]
    gap_us = int(gap_seconds * 1e6)
    scanned = stored(events.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(_scanner(gap_us), SCANNED))
    # At most two rows a partition from here to the union.
    w = Window.partitionBy("entity").orderBy("part", "seq")
    edges = scanned.filter("edge").withColumn("new", (F.col("first_begin") - F.lag("end_us").over(w) > gap_us).cast("int"))
    edges = edges.withColumn("chain", F.sum(F.coalesce("new", F.lit(1))).over(w))
    stitched = edges.groupBy("entity", "chain").agg(
        F.min_by("first_id", F.struct("part", "seq")).alias("first_id"),
        F.max_by("last_id", F.struct("part", "seq")).alias("last_id"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.sum("answers").alias("answers"),
        F.sum("active_us").alias("active_us"),
    )
    cols = ["entity", "first_id", "last_id", "start_us", "end_us", "answers", "active_us"]
    whole = scanned.filter("NOT edge").select(cols).unionByName(stitched.select(cols))
    return whole.select(
        "entity",
        "first_id",
        "last_id",
        F.timestamp_micros("start_us").alias("start"),
        F.timestamp_micros("end_us").alias("end"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_seconds"),
        (F.col("active_us") / 1e6).alias("active_seconds"),
        "answers",
    )
