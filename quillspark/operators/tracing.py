"""Knowledge tracing over ordered answers.

A learner's answers to a concept are folded in order of (time, id). A range exchange splits even a single hot
(learner, concept) over tasks: as mastery lives on a grid of four decimals, a stretch of answers is a map of that
grid onto itself, and maps of neighbouring stretches compose. Each task folds its runs outright, keeps the map of
its first run only, and at most two rows a task are put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.learning import MASTERY_CEILING, MASTERY_FLOOR, P_GUESS, P_INIT, P_SLIP, P_TRANSIT, diagnostic_confidence, uncertainty
from quillspark.session import stored

RECENT = 10
_PIECE = "entity string, item string, part int, seq int, edge boolean, grid binary, state int, attempts long, correct long, recent string, last_us long"


def step_maps(transit: float, slip: float, guess: float) -> np.ndarray:
    """Both answers' steps as maps of grid places 0..9800 (0.0100..0.9900)."""
    p = (np.arange(9801) + 100) / 10_000
    out = np.empty((2, 9801), np.int16)
    for right in (0, 1):
        a, b = (1 - slip, guess) if right else (slip, 1 - guess)
        seen = p * a + (1 - p) * b
        post = np.where(seen > 0, p * a / np.where(seen > 0, seen, 1), p)
        nxt = np.clip(post + (1 - post) * transit, MASTERY_FLOOR, MASTERY_CEILING)
        out[right] = np.rint(nxt * 10_000).astype(np.int64) - 100
    return out


def _folder(maps: np.ndarray, start: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tables = [m.tolist() for m in maps]
        key = last_id = None
        grid = np.arange(9801, dtype=np.int16)
        state, n, good, recent, last, seq = start, 0, 0, "", 0, 0
        rows: list[tuple] = []

        def close(edge: bool) -> None:
            nonlocal seq
            first = seq == 0
            rows.append((key[0], key[1], part, seq, edge or first, grid.tobytes() if first else None, state, n, good, recent, last))
            seq += 1

        def frame() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECE.split(", ")])

        for pdf in batches:
            for who, what, at, eid, right in zip(pdf["entity"].tolist(), pdf["item"].tolist(), pdf["at_us"].tolist(), pdf["event_id"].tolist(), pdf["right"].tolist()):
                if key is None or who != key[0] or what != key[1]:
                    if key is not None:
                        close(False)
                    key, last_id = (who, what), None
                    state, n, good, recent = start, 0, 0, ""
                elif last_id == (at, eid) and eid is not None:
                    continue
                last_id = (at, eid)
                right = int(right)
                if seq == 0:
                    grid = maps[right][grid]
                state = tables[right][state]
                n += 1
                good += right
                recent = (recent + "01"[right])[-RECENT:]
                last = at
            if len(rows) > 20_000:
                yield frame()
                rows.clear()
        if key is not None:
            close(True)
        if rows:
            yield frame()

    return fold


def _stitcher(start: int):
    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        """The pieces of one (entity, item), at most one a partition."""
        pdf = pdf.sort_values(["part", "seq"])
        state, recent = start, ""
        for g, s, r in zip(pdf["grid"], pdf["state"], pdf["recent"]):
            state = int(np.frombuffer(g, np.int16)[state]) if g is not None else s
            recent = (recent + r)[-RECENT:]
        f = pdf.iloc[[0]].assign(state=state, attempts=pdf["attempts"].sum(), correct=pdf["correct"].sum(), recent=recent, last_us=pdf["last_us"].max())
        return f[["entity", "item", "state", "attempts", "correct", "recent", "last_us"]]

    return stitch


def trace(df: DataFrame, entity: Column, item: Column, event_id: Column, at: Column, score: Column, p_init: float = P_INIT, transit: float = P_TRANSIT, slip: float = P_SLIP, guess: float = P_GUESS) -> DataFrame:
    """One row per (entity, item): mastery, attempts, correct, recent (last 10 as 0 and 1), uncertainty, confidence, last_us.

    A score of 0.5 or more is evidence of knowing; mastery is rounded to four decimals at every step. Defined
    cases: rows with a null entity, item, time or score, and NaN scores, are left out; rows repeating (entity,
    item, time, event_id) count once; ties in time are ordered by event_id; an empty table gives no row.
    """
    s = score.cast("double")
    events = df.select(entity.cast("string").alias("entity"), item.cast("string").alias("item"), F.unix_micros(at.cast("timestamp")).alias("at_us"), event_id.cast("string").alias("event_id"), (s >= 0.5).alias("right"), F.isnan(s).alias("nan"))
    events = events.filter("entity IS NOT NULL AND item IS NOT NULL AND at_us IS NOT NULL AND right IS NOT NULL AND NOT nan").drop("nan")
    keys = ["entity", "item", "at_us", "event_id"]
    start = round(p_init * 10_000) - 100
    maps = step_maps(transit, slip, guess)
    pieces = stored(events.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(_folder(maps, start), _PIECE))
    cols = ["entity", "item", "state", "attempts", "correct", "recent", "last_us"]
    joined = pieces.filter("edge").groupBy("entity", "item").applyInPandas(_stitcher(start), "entity string, item string, state int, attempts long, correct long, recent string, last_us long")
    out = pieces.filter("NOT edge").select(cols).unionByName(joined)
    mastery = (F.col("state") + 100) / 10_000.0
    n, k = F.length("recent"), F.length(F.replace("recent", F.lit("0"), F.lit("")))
    return out.select("entity", "item", mastery.alias("mastery"), "attempts", "correct", "recent", F.round(uncertainty(n, k, mastery), 4).alias("uncertainty"), F.round(diagnostic_confidence(n, k), 4).alias("confidence"), "last_us")


def recent_failures(df: DataFrame, partition: list[str], order: list[str], failed: Column, back: int = 3) -> DataFrame:
    """Adds ``recent_failures``: failures among this and the ``back`` - 1 rows before it."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(back - 1), 0)
    return df.withColumn("recent_failures", F.sum(failed.cast("int")).over(w))


GRID = {"transit": (0.05, 0.10, 0.15, 0.20, 0.25, 0.30), "slip": (0.05, 0.08, 0.10, 0.12, 0.15, 0.20), "guess": (0.15, 0.20, 0.25, 0.30, 0.33)}


def calibration(df: DataFrame, entity: Column, item: Column, event_id: Column, at: Column, score: Column, p_init: float = P_INIT) -> DataFrame:
    """(transit, slip, guess, predictions, rmse): one-step-ahead error of every parameter set of GRID.

    All sets and all runs of a batch run side by side, one step for the next answer of each. Keys are hashed, so a
    (learner, concept) stays in one task and streams through it with the memory of a batch.
    """
    grid = np.array(np.meshgrid(*GRID.values(), indexing="ij")).reshape(3, -1)
    tr, sl, gu = grid

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(len(tr)), 0
        held: tuple | None = None  # the key, p and answers of the run that the last batch ended in
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf["entity"].str.cat(pdf["item"], "\x1f").to_numpy()
            right = pdf["right"].to_numpy(bool)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            p = np.full((len(start), len(tr)), p_init)
            before = np.zeros(len(start), np.int64)
            if held is not None and held[0] == key[0]:
                p[0], before[0] = held[1], held[2]
            # All runs of the batch take their next answer together, the longest first.
            order = np.argsort(-size, kind="stable")
            for step in range(int(size.max())):
                k = order[: np.searchsorted(-size[order], -step, "left")]
                r = right[start[k] + step][:, None]
                q = p[k]
                known = before[k] + step > 0
                total += (((q * (1 - sl) + (1 - q) * gu - r) ** 2)[known]).sum(0)
                count += int(known.sum())
                yes, no = q * np.where(r, 1 - sl, sl), (1 - q) * np.where(r, gu, 1 - gu)
                post = yes / (yes + no)
                p[k] = np.clip(post + (1 - post) * tr, MASTERY_FLOOR, MASTERY_CEILING)
            held = (key[-1], p[-1], int(before[-1] + size[-1]))
        yield pd.DataFrame({"transit": tr, "slip": sl, "guess": gu, "squares": total, "n": count})

    s = score.cast("double")
    rows = df.select(entity.cast("string").alias("entity"), item.cast("string").alias("item"), F.unix_micros(at.cast("timestamp")).alias("at_us"), event_id.cast("string").alias("event_id"), (s >= 0.5).alias("right"), F.isnan(s).alias("nan")).filter("entity IS NOT NULL AND item IS NOT NULL AND at_us IS NOT NULL AND right IS NOT NULL AND NOT nan").drop("nan")
    rows = rows.repartition("entity", "item")
    once = rows.filter("event_id IS NOT NULL").dropDuplicates(["entity", "item", "at_us", "event_id"]).unionByName(rows.filter("event_id IS NULL"))
    parts = once.repartition("entity", "item").sortWithinPartitions("entity", "item", "at_us", "event_id").mapInPandas(run, "transit double, slip double, guess double, squares double, n long")
    return parts.groupBy("transit", "slip", "guess").agg(F.sum("n").alias("predictions"), F.sqrt(F.sum("squares") / F.sum("n")).alias("rmse"))


def misconceptions(events: DataFrame) -> DataFrame:
    """events (learner_id, misconception_id, at, event_id, wrong boolean) -> one row per pair: confidence, frequency, status.

    The first wrong answer starts at 0.4 SUSPECTED; each further one adds 0.25 (at most 0.98) and makes it SUPPORTED;
    a right answer takes 0.30 off: below 0.15 it is RESOLVED, below 0.65 SUPPORTED falls back to SUSPECTED. RESOLVED
    ones take no more counter-evidence; right answers before the first wrong one do nothing. The fold streams over
    sorted rows with constant memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rec = None, None
        rows: list[tuple] = []
        for pdf in batches:
            for who, what, wrong in zip(pdf["learner_id"].tolist(), pdf["misconception_id"].tolist(), pdf["wrong"].tolist()):
                if (who, what) != key:
                    if rec:
                        rows.append((*key, *rec))
                    key, rec = (who, what), None
                if wrong:
                    if rec is None:
                        rec = [0.4, 1, "SUSPECTED"]
                    else:
                        rec = [min(0.98, rec[0] + 0.25), rec[1] + 1, "SUPPORTED"]
                elif rec and rec[2] != "RESOLVED":
                    rec[0] = max(0.0, round(rec[0] - 0.30, 4))
                    if rec[0] < 0.15:
                        rec[2] = "RESOLVED"
                    elif rec[2] == "SUPPORTED" and rec[0] < 0.65:
                        rec[2] = "SUSPECTED"
            yield pd.DataFrame(rows, columns=["learner_id", "misconception_id", "confidence", "frequency", "status"])
            rows.clear()
        if rec:
            yield pd.DataFrame([(*key, *rec)], columns=["learner_id", "misconception_id", "confidence", "frequency", "status"])

    e = events.filter("learner_id IS NOT NULL AND misconception_id IS NOT NULL AND wrong IS NOT NULL")
    e = e.dropDuplicates(["learner_id", "misconception_id", "at", "event_id"])
    return e.repartition("learner_id", "misconception_id").sortWithinPartitions("learner_id", "misconception_id", "at", "event_id").select("learner_id", "misconception_id", "wrong").mapInPandas(run, "learner_id string, misconception_id string, confidence double, frequency int, status string")


def trajectory(df: DataFrame, entity: Column, item: Column, event_id: Column, at: Column, score: Column, first: int | None = None, p_init: float = P_INIT, transit: float = P_TRANSIT, slip: float = P_SLIP, guess: float = P_GUESS) -> DataFrame:
    """(entity, item, step, mastery): mastery before the first and after each answer, not rounded; of the ``first`` answers where given.

    Rows repeating (entity, item, time, event_id) count once. The fold streams over sorted rows with constant memory.
    """
    s = score.cast("double")
    events = df.select(entity.cast("string").alias("entity"), item.cast("string").alias("item"), at.alias("at"), event_id.alias("event_id"), (s >= 0.5).alias("right")).dropna(subset=["entity", "item", "at", "right"]).dropDuplicates(["entity", "item", "at", "event_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, p, n = None, p_init, 0
        for pdf in batches:
            rows = []
            for e, i, right in zip(pdf["entity"].tolist(), pdf["item"].tolist(), pdf["right"].tolist()):
                if (e, i) != key:
                    key, p, n = (e, i), p_init, 0
                    rows.append((e, i, 0, p))
                n += 1
                if first is not None and n > first:
                    continue
                known, not_known = (p * (1 - slip), (1 - p) * guess) if right else (p * slip, (1 - p) * (1 - guess))
                post = known / (known + not_known)
                p = post * (1 - transit) + transit
                rows.append((e, i, n, p))
            yield pd.DataFrame(rows, columns=["entity", "item", "step", "mastery"])

    return events.repartition("entity", "item").sortWithinPartitions("entity", "item", "at", "event_id").select("entity", "item", "right").mapInPandas(run, "entity string, item string, step int, mastery double")
