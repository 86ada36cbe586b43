"""Cohort analytics without a learner x concept product: missing states are counted, not built."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import beside
from quillspark.session import stored

MISSING = 0.30


def concept_distribution(states: DataFrame, roster: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per (class_id, concept_id): enrolled, mean, median, p25, p75, shares at or above 0.70 and below 0.40, mean attempts.

    states (learner_id, concept_id, mastery, attempts), unique; roster (class_id, subject_id, learner_id), unique;
    concepts (subject_id, concept_id): a class has the concepts of its subject. A learner without a state stands at 0.30 with no attempt. p25 and p75 are the values at places
    floor(0.25 n) and floor(0.75 n) from 0 in sorted order.
    """
    size = roster.groupBy("class_id", "subject_id").agg(F.count("*").alias("n"))
    own = states.join(roster, "learner_id").join(concepts.select("subject_id", "concept_id").distinct(), ["subject_id", "concept_id"], "left_semi")
    cells = own.groupBy("class_id", "concept_id", "mastery").agg(F.count("*").alias("w"), F.sum("attempts").alias("attempts"))
    pairs = size.join(concepts.select("subject_id", "concept_id").distinct(), "subject_id").drop("subject_id")
    seen = cells.groupBy("class_id", "concept_id").agg(F.sum("w").alias("seen"))
    missing = pairs.join(seen, ["class_id", "concept_id"], "left").select("class_id", "concept_id", F.lit(MISSING).alias("mastery"), (F.col("n") - F.coalesce("seen", F.lit(0))).alias("w"), F.lit(0).cast("long").alias("attempts")).filter("w > 0")
    all_ = cells.unionByName(missing).groupBy("class_id", "concept_id", "mastery").agg(F.sum("w").alias("w"), F.sum("attempts").alias("attempts")).join(size.drop("subject_id"), "class_id")
    w = Window.partitionBy("class_id", "concept_id").orderBy("mastery")  # distinct masteries of four decimals: at most 9,801 rows
    all_ = all_.withColumn("upto", F.sum("w").over(w))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("mastery")))
    n = F.col("n")
    share = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0)) / F.max("n")
    return all_.groupBy("class_id", "concept_id").agg(
        F.max("n").alias("enrolled"),
        F.round(F.sum(F.col("mastery") * F.col("w")) / F.max("n"), 10).alias("mean_mastery"),
        F.round((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2, 10).alias("median_mastery"),
        at(F.floor(0.25 * n)).alias("p25_mastery"),
        at(F.floor(0.75 * n)).alias("p75_mastery"),
        F.round(share(F.col("mastery") >= 0.70), 6).alias("share_mastered"),
        F.round(share(F.col("mastery") < 0.40), 6).alias("share_struggling"),
        F.round(F.sum("attempts") / F.max("n"), 10).alias("mean_attempts"),
    )


def bottlenecks(states: DataFrame, roster: DataFrame, edges: DataFrame, weak: float = 0.50) -> DataFrame:
    """Per class and link (subject_id, source, target) of its subject: learners weak in both, and their share, by inclusion and exclusion of the strong."""
    strong = states.filter(F.col("mastery") >= weak).join(roster, "learner_id").select("class_id", "learner_id", "concept_id")
    size = roster.groupBy("class_id", "subject_id").agg(F.count("*").alias("n"))
    alone = strong.groupBy("class_id", "concept_id").agg(F.count("*").alias("k"))
    both = (
        strong.join(edges.select("source", "target").distinct(), F.col("concept_id") == F.col("source")).select("class_id", "learner_id", "source", "target")
        .join(strong.select(F.col("class_id").alias("c2"), F.col("learner_id").alias("l2"), F.col("concept_id").alias("t2")), (F.col("learner_id") == F.col("l2")) & (F.col("class_id") == F.col("c2")) & (F.col("target") == F.col("t2")))
        .groupBy("class_id", "source", "target").agg(F.count("*").alias("kb"))
    )
    grid = edges.join(size, "subject_id")
    s = alone.select("class_id", F.col("concept_id").alias("source"), F.col("k").alias("ks"))
    t = alone.select("class_id", F.col("concept_id").alias("target"), F.col("k").alias("kt"))
    z = lambda c: F.coalesce(c, F.lit(0))
    out = grid.join(s, ["class_id", "source"], "left").join(t, ["class_id", "target"], "left").join(both, ["class_id", "source", "target"], "left")
    out = out.withColumn("affected", F.col("n") - z("ks") - z("kt") + z("kb")).filter("affected > 0")
    return out.select("class_id", "source", "target", "affected", F.round(F.col("affected") / F.col("n"), 2).alias("severity"))


def learner_rollup(states: DataFrame) -> DataFrame:
    """Per learner: attempted concepts, counts by level, attempts, accuracy, weakest concept (ties by id)."""
    return states.groupBy("learner_id").agg(
        F.count("*").alias("concepts"),
        F.count_if(F.col("mastery") >= 0.70).alias("mastered"),
        F.count_if((F.col("mastery") >= 0.40) & (F.col("mastery") < 0.70)).alias("developing"),
        F.count_if(F.col("mastery") < 0.40).alias("struggling"),
        F.sum("attempts").alias("attempts"),
        F.round(F.sum("correct") / F.sum("attempts"), 6).alias("accuracy"),
        F.min_by("concept_id", F.struct("mastery", "concept_id")).alias("weakest"),
        F.round(F.avg("mastery"), 10).alias("mean_mastery"),
    )


def mastery_audit(states: DataFrame) -> DataFrame:
    """Per concept: learners, mean, population variance (0 below two), shares below 0.40, between and from 0.70."""
    n = F.count("*")
    return states.groupBy("concept_id").agg(
        n.alias("learners"),
        F.round(F.avg("mastery"), 10).alias("mean_mastery"),
        F.round(F.coalesce(F.var_pop("mastery"), F.lit(0.0)), 10).alias("variance"),
        F.round(F.count_if(F.col("mastery") < 0.40) / n, 6).alias("low"),
        F.round(F.count_if((F.col("mastery") >= 0.40) & (F.col("mastery") < 0.70)) / n, 6).alias("mid"),
        F.round(F.count_if(F.col("mastery") >= 0.70) / n, 6).alias("high"),
    )


def rollup(states: DataFrame, roster: DataFrame) -> DataFrame:
    """Learners and mean mastery by class and concept, by class, and over all."""
    return (
        states.join(roster, "learner_id").rollup("class_id", "concept_id")
        .agg(F.count("*").alias("states"), F.round(F.avg("mastery"), 10).alias("mean_mastery"), F.grouping_id().cast("int").alias("level"))
    )


def with_prerequisites(states: DataFrame, links: DataFrame) -> DataFrame:
    """states with ``downstream`` (links from the concept, repeats counted) and ``weak_prerequisites`` (distinct ones below 0.5; without a state they stand at 0.30).

    A learner's weak prerequisites are all of a concept's less the learner's strong ones, so only links between
    states that the learner has are looked at, in the task that holds the learner.
    """
    path = beside.kept(links.groupBy("source", "target").agg(F.count("*").alias("n")), "links")

    def work(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = beside.read(path)
        names = sorted({v for c in ("source", "target") for v in t[c].unique().to_pylist() if v is not None})
        at = {v: k for k, v in enumerate(names)}
        n = len(names)
        source, target = beside.coded(t["source"], at), beside.coded(t["target"], at)
        down = np.append(np.bincount(source[source >= 0], t["n"].to_numpy()[source >= 0], n).astype(np.int64), 0)
        needs = np.append(np.bincount(target[target >= 0], minlength=n), 0)
        both = (source >= 0) & (target >= 0)
        source, target = source[both], target[both]
        order = np.argsort(source, kind="stable")
        target, first = target[order], beside.offsets(source[order], n)
        for own in tables:
            concept, mastery = beside.coded(own["concept_id"], at), own["mastery"].to_numpy()
            weak = needs[concept]
            _, begin = beside.runs(own["learner_id"])
            for a, b in zip(begin[:-1], begin[1:]):
                c = concept[a:b]
                strong = c[(mastery[a:b] >= 0.5) & (c >= 0)]
                met = target[beside.spread(first[strong], first[strong + 1])]
                if len(met):
                    weak[a:b] -= np.append(np.bincount(met, minlength=n), 0)[c]
            out = own.append_column("downstream", pa.array(down[concept])).append_column("weak_prerequisites", pa.array(weak))
            yield from out.combine_chunks().to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.schema.fields)
    return beside.by_learner(states, work, f"{kinds}, downstream long, weak_prerequisites long")


BATCH = 40_000  # rows that a task gives at a time
# Learners of a task, and the most it holds of them times documents; bytes of text that a Parquet dictionary holds.
LEARNERS_A_TASK, PAIRS_A_TASK, DICTIONARY = 250, 10_000_000, 1_000_000


def upstream_weak(states: DataFrame, up: DataFrame) -> DataFrame:
    """(tree, learner_id, concept_id, upstream, weak) for each state below 0.5 and tree in which its concept rests on others: how many, and how many of them are below 0.5 for the learner; without a state they stand at 0.30.

    states (learner_id, concept_id, mastery), unique; up (tree, concept_id, above), the concepts it rests on, each
    once. Rows are made in the task that holds the learner: they are as many as learners' weak concepts times their trees.
    """
    path = beside.kept(up.select("tree", "concept_id", "above").filter(F.size("above") > 0), "up")

    def work(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = beside.read(path).combine_chunks()
        lists = t["above"].combine_chunks()
        names = sorted(v for v in {*t["concept_id"].unique().to_pylist(), *lists.flatten().unique().to_pylist()} if v is not None)
        at = {v: k for k, v in enumerate(names)}
        node, above, bounds = beside.coded(t["concept_id"], at), beside.coded(lists.flatten(), at).astype(np.int32), lists.offsets.to_numpy()
        order = np.argsort(node, kind="stable")
        first = beside.offsets(node[order], len(names))
        above = above[beside.spread(bounds[order], bounds[order + 1])]
        size = np.diff(bounds)[order].astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        trees, upstream = t["tree"].combine_chunks().take(pa.array(order)), pa.array(size)
        low = np.ones(len(names) + 1, np.int64)

        def given(parts: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts)], names=["tree", "learner_id", "concept_id", "upstream", "weak"])

        for own in tables:
            concept, mastery = beside.coded(own["concept_id"], at), own["mastery"].to_numpy()
            who, begin = beside.runs(own["learner_id"])
            parts, held = [], 0
            for name, a, b in zip(who, begin[:-1], begin[1:]):
                c, m = concept[a:b], mastery[a:b]
                strong = c[(m >= 0.5) & (c >= 0)]
                low[strong] = 0
                for k in c[(m < 0.5) & (c >= 0)]:
                    x, y = first[k], first[k + 1]
                    if x == y:
                        continue
                    weak = np.add.reduceat(low[above[start[x] : start[y]]], start[x:y] - start[x])
                    for i in range(0, y - x, BATCH):
                        n = min(BATCH, y - x - i)
                        parts.append((trees.slice(x + i, n), pa.repeat(pa.scalar(name, pa.string()), n), pa.repeat(pa.scalar(names[k], pa.string()), n), upstream.slice(x + i, n), pa.array(weak[i : i + n])))
                        held += n
                        if held >= BATCH:
                            yield given(parts)
                            parts, held = [], 0
                low[strong] = 1
            if parts:
                yield given(parts)

    return beside.by_learner(states.select("learner_id", "concept_id", "mastery"), work, "tree string, learner_id string, concept_id string, upstream long, weak long")


def weakest_by_document(states: DataFrame, documents: DataFrame, most: int = 3) -> DataFrame:
    """(learner_id, document_id, concept_ids): of a learner's concepts in each document the ``most`` of least mastery, ties by id, joined by commas in that order.

    states (learner_id, concept_id, mastery), unique; documents (document_id, concept_id), distinct. Rows are nearly as
    many as learners times documents, so they are never shuffled: a task has some learners, and gives each of a learner's
    texts with all its documents, to be unrolled as they are written. The texts of most documents come first, as many
    as the dictionary of the task's file holds, and the others by learner.
    """
    spark = states.sparkSession
    s = stored(states.select("learner_id", "concept_id", "mastery"))
    path = beside.kept(documents.select("document_id", "concept_id").dropna(), "documents")
    n = max(1, spark.read.parquet(path).agg(F.count_distinct("document_id")).first()[0])
    parts = 1 + s.agg(F.count_distinct("learner_id")).first()[0] // max(1, min(LEARNERS_A_TASK, PAIRS_A_TASK // n))
    mine = beside.kept_parts(s, "learners", parts, "learner_id", "learner_id", "mastery", "concept_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = beside.read(path)
        ids = t["document_id"].unique().sort()
        names = sorted(t["concept_id"].unique().to_pylist())
        at = {v: k for k, v in enumerate(names)}
        doc, concept = beside.coded(t["document_id"], {v: k for k, v in enumerate(ids.to_pylist())}), beside.coded(t["concept_id"], at)
        order = np.argsort(concept, kind="stable")
        doc, first = doc[order], beside.offsets(concept[order], len(names))
        for part in (k for b in batches for k in b.column(0).to_pylist()):
            own = beside.read_part(mine, part)
            if own is None:
                continue
            code = beside.coded(own["concept_id"], at)
            who, begin = beside.runs(own["learner_id"])
            whose, sizes, texts, docs = [], [], [], []
            for w, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
                c = code[a:b][code[a:b] >= 0]  # the weakest first
                taken, key = np.zeros(len(ids), np.int8), np.zeros(len(ids), np.int64)
                for rank, k in enumerate(c.tolist(), 1):
                    d = doc[first[k] : first[k + 1]]
                    d = d[taken[d] < most]
                    taken[d] += 1
                    key[d] = key[d] * (len(c) + 1) + rank
                met = np.flatnonzero(taken)
                met = met[np.argsort(key[met], kind="stable")]
                kinds, size = np.unique(key[met], return_counts=True)
                for v in kinds.tolist():
                    ranks = []
                    while v:
                        v, r = divmod(v, len(c) + 1)
                        ranks.append(names[c[r - 1]])
                    texts.append(",".join(reversed(ranks)))
                whose.append(np.full(len(kinds), w))
                sizes.append(size)
                docs.append(met.astype(np.int32))
            if texts:
                yield from _by_text(pa.array(who, pa.string()), np.concatenate(whose), np.concatenate(sizes), pa.array(texts, pa.string()), np.concatenate(docs), ids)

    x = spark.range(0, parts, 1, parts).mapInArrow(work, "learner_id string, concept_ids string, documents array<string>")
    return x.select("learner_id", F.explode("documents").alias("document_id"), "concept_ids")


def _by_text(who: pa.Array, whose: np.ndarray, sizes: np.ndarray, texts: pa.Array, docs: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """Learners' texts with their documents, which lie one text after the other in ``docs``; at most ``BATCH`` documents a row."""
    starts = np.cumsum(sizes) - sizes
    longest = np.argsort(-sizes, kind="stable")
    late = np.empty(len(sizes), bool)
    late[longest] = np.cumsum(4 + np.array([len(v.encode()) for v in texts.to_pylist()])[longest]) > DICTIONARY
    order = np.argsort(late, kind="stable")
    pieces = -(-sizes[order] // BATCH)
    order, piece = np.repeat(order, pieces), beside.spread(np.zeros(len(pieces), np.int64), pieces)
    starts = starts[order] + piece * BATCH
    ends = np.minimum(starts + BATCH, np.cumsum(sizes)[order])
    total = np.cumsum(ends - starts)
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1], BATCH), "right"), len(order)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = pa.array(np.append(0, np.cumsum(ends[a:b] - starts[a:b])), pa.int32())
        k = order[a:b]
        yield pa.RecordBatch.from_arrays([who.take(pa.array(whose[k])), texts.take(pa.array(k)), pa.ListArray.from_arrays(at, ids.take(pa.array(docs[beside.spread(starts[a:b], ends[a:b])])))], names=["learner_id", "concept_ids", "documents"])


def gaps(states: DataFrame, links: DataFrame) -> DataFrame:
    """Gaps of learners' attempted concepts: reasons in order, main type, weak prerequisites, downstream count.

    states (learner_id, concept_id, mastery, attempts, uncertainty); links (source, target), repeats kept:
    downstream counts them, prerequisites don't. A prerequisite without a state stands at 0.30.
    """
    g = with_prerequisites(states, links)
    thin = (F.col("attempts") < 3) | (F.col("uncertainty") > 0.4)
    low = F.col("mastery") < 0.5
    weak_ = F.col("weak_prerequisites") > 0
    broad = (low | thin) & (F.col("downstream") >= 2)
    reasons = F.array_compact(F.array(F.when(thin, "INSUFFICIENT_EVIDENCE"), F.when(low, "LOW_MASTERY"), F.when(weak_, "WEAK_PREREQUISITE"), F.when(broad, "HIGH_DOWNSTREAM_IMPACT")))
    kind = F.when(low, "LOW_MASTERY").when(thin, "INSUFFICIENT_EVIDENCE").when(weak_, "WEAK_PREREQUISITE").otherwise("HIGH_DOWNSTREAM_IMPACT")
    return g.withColumn("reasons", F.array_join(reasons, ",")).filter("reasons != ''").withColumn("gap_type", kind)


def learner_progress(states: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per learner over all of a subject's concepts: explored, mastered (0.75), developing (0.4), mean mastery with 0.30 for what was not tried, and how much was explored."""
    all_ = concepts.select("concept_id").distinct()
    n = all_.agg(F.count("*").alias("n"))
    g = states.join(all_, "concept_id", "left_semi").groupBy("learner_id").agg(F.count("*").alias("explored"), F.count_if(F.col("mastery") >= 0.75).alias("mastered"), F.count_if((F.col("mastery") >= 0.4) & (F.col("mastery") < 0.75)).alias("developing"), F.sum("mastery").alias("sm"))
    rate = F.col("explored") / F.col("n")
    return g.join(F.broadcast(n)).select(  # one row
        "learner_id", F.col("n").alias("total_concepts"), F.col("explored").alias("explored_concepts"), F.col("mastered").alias("mastered_concepts"), F.col("developing").alias("developing_concepts"), (F.col("n") - F.col("explored")).alias("unexplored_concepts"),
        F.round((F.col("sm") + MISSING * (F.col("n") - F.col("explored"))) / F.col("n"), 3).alias("average_mastery"), F.round(rate, 3).alias("exploration_rate"), F.when(rate > 0.6, "HIGH").when(rate > 0.2, "MEDIUM").otherwise("LOW").alias("overall_confidence"),
    )


def sufficiency(states: DataFrame, learners: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per learner: observed concepts, attempts, and UNINITIALIZED (none), INSUFFICIENT_EVIDENCE (below 3) or INITIALIZED."""
    g = states.filter("attempts > 0").join(concepts.select("concept_id").distinct(), "concept_id", "left_semi").groupBy("learner_id").agg(F.count("*").alias("observed_concepts"), F.sum("attempts").alias("attempts"))
    x = learners.join(g, "learner_id", "left").fillna(0, ["observed_concepts", "attempts"])
    return x.withColumn("status", F.when(F.col("attempts") == 0, "UNINITIALIZED").when(F.col("attempts") < 3, "INSUFFICIENT_EVIDENCE").otherwise("INITIALIZED"))


def minutes(total: Column, bottleneck: Column) -> tuple[Column, Column, Column]:
    """A lesson's time: at most 15 or 30 % for a prerequisite, at most 25 or 65 % of the rest for instruction, at least 5 for a check."""
    first = F.when(bottleneck, F.least(F.lit(15), F.floor(0.30 * total))).otherwise(F.lit(0)).cast("int")
    rest = total - first
    teach = F.least(F.lit(25), F.floor(0.65 * rest)).cast("int")
    return first, teach, F.greatest(F.lit(5), rest - teach).cast("int")
