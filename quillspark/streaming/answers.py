"""Structured Streaming over the answer stream; the same expressions as in batch where Spark allows it."""

from __future__ import annotations

import pickle
import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from quillspark.functions.learning import P_GUESS, P_INIT, P_SLIP, P_TRANSIT
from quillspark.operators.tracing import step_maps

LATE = "24 hours"
BUCKETS = 1024


def read_answers(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream of the interactions stored under ``path``, new files as they come."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(re.sub(r"\.(\w+)$", r"[.]\1", path))  # as a pattern: a single file is read as well as a folder


def once(stream: DataFrame, late: str = LATE, at: str = "ts") -> DataFrame:
    """Each interaction_id once within the watermark on ``at``; redeliveries later than that pass as new."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(["interaction_id"])


def received(df: DataFrame) -> DataFrame:
    """df with ``received``, when a row was delivered: metadata's received_at, else the time of the answer."""
    at = F.get_json_object("metadata", "$.received_at").try_cast("timestamp")
    return df.withColumn("received", F.coalesce(at, F.col("ts").cast("timestamp")))


def in_order_of_arrival(df: DataFrame, folder: str, files: int = 6) -> str:
    """Write df as ``files`` files in order of ``received``, as they would have come in, each by one task; gives the folder."""
    at = F.unix_micros("received").cast("double")
    bounds = sorted(set(df.select(at.alias("t")).approxQuantile("t", [k / files for k in range(1, files)], 0.001))) if files > 1 else []
    files = len(bounds) + 1  # no rows, no bounds
    arrival = F.lit(files - 1)
    for k in reversed(range(len(bounds))):
        arrival = F.when(at <= bounds[k], k).otherwise(arrival)
    rows = (df.filter(at.isNotNull()) if bounds else df).withColumn("arrival", arrival).repartitionById(files, F.col("arrival")).sortWithinPartitions("arrival", "received")
    rows.write.mode("append").partitionBy("arrival").parquet(folder)
    if not bounds:  # also a table without rows has its folder
        df.limit(0).coalesce(1).write.mode("append").parquet(f"{folder}/arrival=0")
    # A stream takes files by their times, which may be equal for files written at once.
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    first = int(time.time() * 1000) - 1000 * (files + 1)
    for k in range(files):
        part = spark._jvm.org.apache.hadoop.fs.Path(root, f"arrival={k}")
        for s in fs.listStatus(part) if fs.exists(part) else []:
            fs.setTimes(s.getPath(), first + 1000 * k, -1)
    return folder


def read_arrivals(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(folder).drop("arrival").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(folder)


def idempotent(stream: DataFrame, token: str, at: str, payload: str, ttl: str = LATE) -> DataFrame:
    """(token, at, replayed, response) of every delivery with a token, in order of ``at``.

    The first delivery is processed and its payload kept for ``ttl``; deliveries within it are answered by the kept
    payload (replayed), the next one beyond it is processed anew. A token's state is dropped once the watermark
    passes its end. Deliveries must come in order of ``at`` up to an hour.
    """
    life = int(pd.Timedelta(ttl).value // 1000)

    def answer(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {t: (u, k) for t, u, k in zip(*state.get)} if state.exists else {}
        out = []
        if not state.hasTimedOut:
            for token_, t, value in sorted((r for pdf in pdfs for r in zip(pdf["token"].tolist(), pdf["us"].tolist(), pdf["payload"].tolist())), key=lambda r: r[1]):
                until, kept = held.get(token_, (-(2**62), None))
                replayed = t <= until
                if not replayed:
                    held[token_] = until, kept = t + life, value
                out.append((token_, t, replayed, kept))
        now = state.getCurrentWatermarkMs()
        held = {t: x for t, x in held.items() if x[0] // 1000 >= now}
        if held:
            state.update((list(held), [int(u) for u, _ in held.values()], [k for _, k in held.values()]))
            state.setTimeoutTimestamp(max(min(u for u, _ in held.values()) // 1000 + 1, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["token", "us", "replayed", "response"])

    rows = stream.filter(F.col(token).isNotNull()).withWatermark(at, "1 hour").select(F.col(token).alias("token"), F.col(at).alias("at"), F.unix_micros(at).alias("us"), F.col(payload).cast("string").alias("payload"))
    # Tokens are answered a bucket at a time: a call for each token would cost more than its answer.
    out = rows.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(answer, "token string, us long, replayed boolean, response string", "tokens array<string>, until array<long>, kept array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("token", F.timestamp_micros("us").alias("at"), "replayed", "response")


def activity(stream: DataFrame, width: str = "1 day", slide: str | None = None, at: str = "ts") -> DataFrame:
    """Answers, right answers and total score per window of ``at``; windows tumble, or slide if told to."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.groupBy(w).agg(F.count("*").alias("answers"), F.count_if(F.col("correctness") >= 0.5).alias("right"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "answers", "right", "score")


def gap_sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions by gaps between answer times."""
    s = stream.filter("learner_id IS NOT NULL").groupBy("learner_id", F.session_window("ts", gap)).agg(F.count("*").alias("answers"))
    return s.select("learner_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "answers")


_OUT = "learner_id string, concept_id string, mastery double, attempts long, correct long"


def mastery_stream(stream: DataFrame, at: str = "ts", ttl: str = LATE, p_init: float = P_INIT, transit: float = P_TRANSIT, slip: float = P_SLIP, guess: float = P_GUESS) -> DataFrame:
    """Running mastery per (learner, concept): within a trigger answers are taken in order of (``at``, interaction_id).

    A redelivered interaction counts once within ``ttl`` of the delivery that counted; the ids of that time are the
    only part of a key's state that is not of fixed size. An answer older than what its key has already folded is
    folded in as it comes; a batch recompute gives the order by time. Keys are folded a bucket at a time, with one
    packed state a bucket: a call for each key would cost more than its answers.
    """
    maps = step_maps(transit, slip, guess).tolist()
    start = round(p_init * 10_000) - 100
    life = int(pd.Timedelta(ttl).value // 1000)

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys = pickle.loads(state.get[0]) if state.exists else {}  # (learner, concept) -> place, attempts, correct, times by id
        last = {}
        for who, what, t, i, right in sorted((r for pdf in pdfs for r in zip(*(pdf[c].tolist() for c in ("learner_id", "concept_id", "us", "interaction_id", "right")))), key=lambda r: r[2:]):
            k = (who, what)
            last[k] = t
            place, n, good, held = keys.get(k) or (start, 0, 0, {})
            if i in held and t <= held[i] + life:
                continue
            held[i] = t
            keys[k] = maps[int(right)][place], n + 1, good + int(right), held
        for k, t in last.items():
            place, n, good, held = keys[k]
            keys[k] = place, n, good, {i: u for i, u in held.items() if u + life >= t}
        state.update((pickle.dumps(keys),))
        yield pd.DataFrame([(*k, (keys[k][0] + 100) / 10_000, *keys[k][1:3]) for k in last], columns=["learner_id", "concept_id", "mastery", "attempts", "correct"])

    rows = stream.filter("learner_id IS NOT NULL AND correctness IS NOT NULL AND NOT isnan(correctness) AND interaction_id IS NOT NULL")
    rows = rows.select("learner_id", F.explode(F.array_distinct("concept_ids")).alias("concept_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), "interaction_id", (F.col("correctness") >= 0.5).alias("right")).filter("us IS NOT NULL")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("learner_id", "concept_id"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(fold, _OUT, "keys binary", "update", GroupStateTimeout.NoTimeout)


def session_states(stream: DataFrame, at: str = "ts", most: int = 25, idle: str = "30 minutes") -> DataFrame:
    """(learner_id, session_id, answers, right, first, last, status): COMPLETED from ``most`` answers on, EXPIRED once ``idle`` has passed since the last one by the watermark, else ACTIVE; a row with every change."""
    rest = int(pd.Timedelta(idle).value // 1_000_000)

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, good, first, last, status = state.get if state.exists else (0, 0, 2**62, -(2**62), "ACTIVE")
        if state.hasTimedOut:
            status = "EXPIRED" if status == "ACTIVE" else status
            state.remove()
        else:
            for pdf in pdfs:
                n += len(pdf)
                good += int((pdf["correctness"] >= 0.5).sum())
                first, last = min(first, int(pdf["us"].min())), max(last, int(pdf["us"].max()))
            status = "COMPLETED" if n >= most else "ACTIVE"
            state.update((int(n), int(good), int(first), int(last), status))
            state.setTimeoutTimestamp(max(last // 1000 + rest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, n, good, first, last, status)], columns=["learner_id", "session_id", "answers", "right", "first_us", "last_us", "status"])

    rows = stream.filter("learner_id IS NOT NULL AND session_id IS NOT NULL").withWatermark(at, "1 hour").select("learner_id", "session_id", at, F.unix_micros(at).alias("us"), "correctness")
    return rows.groupBy("learner_id", "session_id").applyInPandasWithState(fold, "learner_id string, session_id string, answers long, right long, first_us long, last_us long, status string", "n long, good long, first long, last long, status string", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Drive a stream over all that is there and give its result as a batch DataFrame from a table under ``folder``.

    Update-mode results keep the last row of each key by ``order`` (rising with every update).
    """
    spark = stream.sparkSession
    out, cp = f"{folder}/table", f"{folder}/checkpoint"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("int")).write.mode("overwrite").parquet(f"{out}/batch-{epoch}")  # a replayed epoch writes the same place

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", cp).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("epoch", IntegerType())])
    got = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    if keys:
        cols = [c for c in stream.columns if c not in keys]
        got = got.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct("epoch", *([order] if order else []))).alias("r")).select(*keys, "r.*")
        return got
    return got.drop("epoch")
