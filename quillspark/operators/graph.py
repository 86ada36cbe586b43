"""Prerequisite graph operators beside the hierarchy."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def foundations(links: DataFrame) -> DataFrame:
    """(tree, node) without a prerequisite of its own; links (tree, source, target)."""
    nodes = links.select("tree", F.col("source").alias("node")).unionByName(links.select("tree", F.col("target").alias("node"))).distinct()
    return nodes.join(links.select("tree", F.col("target").alias("node")), ["tree", "node"], "left_anti")


def degrees(links: DataFrame) -> DataFrame:
    """Per (tree, node): downstream (repeats counted), prerequisites (distinct) and dependents (distinct)."""
    out = links.groupBy("tree", F.col("source").alias("node")).agg(F.count("*").alias("downstream"), F.count_distinct("target").alias("dependents"))
    into = links.groupBy("tree", F.col("target").alias("node")).agg(F.count_distinct("source").alias("prerequisites"))
    return out.join(into, ["tree", "node"], "full_outer").fillna(0, ["downstream", "dependents", "prerequisites"])


def validation(links: DataFrame, concepts: DataFrame, cyclic: DataFrame) -> DataFrame:
    """Per tree: links, repeated links, self-links, links to unknown concepts, nodes on cycles. cyclic (tree, node)."""
    known = concepts.select("concept_id").distinct()
    ends = links.withColumn("n", F.lit(1)).join(known.select(F.col("concept_id").alias("source"), F.lit(1).alias("ks")), "source", "left").join(known.select(F.col("concept_id").alias("target"), F.lit(1).alias("kt")), "target", "left")
    pairs = ends.groupBy("tree", "source", "target").agg(F.count("*").alias("n"), F.max(F.col("ks").isNull() | F.col("kt").isNull()).alias("broken"))
    per = pairs.groupBy("tree").agg(F.sum("n").alias("links"), F.sum(F.col("n") - 1).alias("repeated"), F.count_if(F.col("source") == F.col("target")).alias("self_links"), F.count_if("broken").alias("broken"))
    c = cyclic.groupBy("tree").agg(F.count("*").alias("on_cycles"))
    return per.join(c, "tree", "left").fillna(0, ["on_cycles"])


def _kahn(links: list[tuple[str, str]]) -> list[tuple[str, int, bool]]:
    """(node, place, whether its order is free of cycles): always the least node that is ready; the rest sorted behind."""
    down: dict[str, set[str]] = {}
    wait: dict[str, int] = {}
    for a, b in set(links):
        wait.setdefault(a, 0)
        if b is None:
            continue
        wait.setdefault(b, 0)
        down.setdefault(a, set()).add(b)
        wait[b] += 1
    ready = [v for v, n in wait.items() if not n]
    heapq.heapify(ready)
    order = []
    while ready:
        v = heapq.heappop(ready)
        order.append(v)
        for w in down.get(v, ()):
            wait[w] -= 1
            if not wait[w]:
                heapq.heappush(ready, w)
    done = set(order)
    rest = sorted(v for v in wait if v not in done)
    return [(v, i, True) for i, v in enumerate(order)] + [(v, len(order) + i, False) for i, v in enumerate(rest)]


def topological_order(links: DataFrame) -> DataFrame:
    """(tree, node, place, acyclic): the lexicographically least order in which prerequisites come first; a null target only names its node.

    The order of one tree is sequential by its definition; a task keeps the distinct links of one tree at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch:
            n, p, a = zip(*_kahn(held))
            return pa.RecordBatch.from_arrays([pa.array([key] * len(n), pa.string()), pa.array(n, pa.string()), pa.array(p, pa.int32()), pa.array(a, pa.bool_())], names=["tree", "node", "place", "acyclic"])

        for b in batches:
            for t, x, y in zip(*(b.column(k).to_pylist() for k in range(3))):
                if held and t != key:
                    yield flush()
                    held = []
                key = t
                held.append((x, y))
        if held:
            yield flush()

    rows = links.select("tree", "source", "target").dropna(subset=["tree", "source"]).distinct().repartition("tree").sortWithinPartitions("tree")
    return rows.mapInArrow(run, "tree string, node string, place int, acyclic boolean")


def _per_tree(links: DataFrame, pick) -> DataFrame:
    """Links of one tree at a time, sorted, through ``pick``: what it keeps of them. Which links stay depends on those before, so a tree is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> pa.RecordBatch | None:
            kept = pick(held)
            return pa.RecordBatch.from_arrays([pa.array([key] * len(kept), pa.string()), pa.array([x for x, _ in kept], pa.string()), pa.array([y for _, y in kept], pa.string())], names=["tree", "source", "target"]) if kept else None

        for b in batches:
            for t, x, y in zip(*(b.column(k).to_pylist() for k in range(3))):
                if held and t != key:
                    if (out := flush()) is not None:
                        yield out
                    held = []
                key = t
                held.append((x, y))
        if held and (out := flush()) is not None:
            yield out

    rows = links.select("tree", "source", "target").dropna().distinct().repartition("tree").sortWithinPartitions("tree", "source", "target")
    return rows.mapInArrow(run, "tree string, source string, target string")


def _reaches(down: dict[str, list[str]], start: str, goal: str) -> bool:
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        if v == goal:
            return True
        for w in down.get(v, ()):
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return False


def added_in_order(links: DataFrame) -> DataFrame:
    """(tree, source, target): links that close no cycle when they are added one by one in order of their ends."""

    def pick(held: list[tuple[str, str]]) -> list[tuple[str, str]]:
        down: dict[str, list[str]] = {}
        kept = []
        for a, b in held:
            if a != b and not _reaches(down, b, a):
                down.setdefault(a, []).append(b)
                kept.append((a, b))
        return kept

    return _per_tree(links, pick)


def sanitised(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """(tree, source, target): known ends only, no self-link, each once, and acyclic; as long as a walk in order of names closes a cycle, the link that closes it goes."""
    k = concepts.select("concept_id").distinct()
    known = links.join(k.select(F.col("concept_id").alias("source")), "source", "left_semi").join(k.select(F.col("concept_id").alias("target")), "target", "left_semi").filter("source != target")

    def pick(held: list[tuple[str, str]]) -> list[tuple[str, str]]:
        down: dict[str, list[str]] = {}
        for a, b in held:
            down.setdefault(a, []).append(b)
        state: dict[str, int] = {}
        gone: set[tuple[str, str]] = set()
        for start in sorted({v for link in held for v in link}):
            work = [(start, iter(down.get(start, ())))] if not state.get(start) else []
            state.setdefault(start, 1)
            while work:
                v, rest = work[-1]
                for w in rest:
                    if state.get(w, 0) == 1 and any(u == w for u, _ in work):
                        gone.add((v, w))  # w is open on the walk: this link closes a cycle
                    elif not state.get(w):
                        state[w] = 1
                        work.append((w, iter(down.get(w, ()))))
                        break
                else:
                    state[v] = 2
                    work.pop()
        return [x for x in held if x not in gone]

    return _per_tree(known, pick)


def topic_links(edges: DataFrame, topics: DataFrame) -> DataFrame:
    """(source, target, links) between different topics; edges (s, t) of concepts, topics (topic, concept_id)."""
    a = topics.select(F.col("concept_id").alias("s"), F.col("topic").alias("source"))
    b = topics.select(F.col("concept_id").alias("t"), F.col("topic").alias("target"))
    return edges.join(a, "s").join(b, "t").filter("source != target").groupBy("source", "target").agg(F.count("*").alias("links"))


def modules(topics: DataFrame, group: str, topic: str, above: int = 16, least: int = 6, most: int = 12, per: int = 8) -> DataFrame:
    """(group, topic, module): more than ``above`` topics of a group are put together in order to n // ``per`` modules, between ``least`` and ``most``; fewer stay one each."""
    w = Window.partitionBy(group)
    n, i = F.col("n"), F.col("i")
    x = topics.select(group, topic).distinct().withColumn("i", F.row_number().over(w.orderBy(topic)) - 1).withColumn("n", F.count("*").over(w))
    m = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(n / per)))
    size = F.greatest(F.lit(1), F.floor((n + m - 1) / m))
    return x.select(group, topic, F.when(n > above, F.floor(i / size) + 1).otherwise(i + 1).cast("int").alias("module"))


def spread(items: DataFrame, item: str, topics: int) -> DataFrame:
    """(item, topic): items in order over ``topics`` topics, floor(i / n * topics). Places are counted in sorted parts, so no task sees all items."""
    parted = items.select(item).distinct().repartitionByRange(item).withColumn("part", F.spark_partition_id())
    sizes = parted.groupBy("part").agg(F.count("*").alias("k"))
    before = sizes.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("k").over(Window.partitionBy()))  # a row per part
    w = Window.partitionBy("part").orderBy(item)
    i = F.row_number().over(w) - 1 + F.col("before")
    return parted.join(before, "part").select(item, F.floor(i / F.col("n").cast("double") * topics).cast("int").alias("topic"))
