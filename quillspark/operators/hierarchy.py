"""Parent-child links to full hierarchies, by nested-set ranges.

Subtree sizes are summed upward, sibling preorder ranges handed downward by prefix sums, and ancestors and
descendants are read off these ranges; what the walk from the roots does not reach lies on a cycle or below one. A
node with several parents hangs below its smallest parent; its other links add its range to what those parents
reach. ``ranges`` gives one narrow row a node, so its size is that of the input; ``hierarchy`` unrolls the ranges
into paths and descendants, row by row in preorder, holding one open path and one row's spans at a time.

A tree whose links fit a task (``max_local_links``; whole numbers of a few dozen bytes each) is solved in one; a
larger one by rounds of joins with the same results in the same order: doubling gives depths, sizes and preorder in
a logarithm of the depth, siblings are summed in sorted parts so that no parent's children share a task, and
chains are contracted before the walk from the roots.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut, stored

K = ["hierarchy", "tree"]
RANGES = "hierarchy string, tree string, node string, state string, root string, parent string, depth int, preorder int, subtree_size int, cycle_id string"
NODES = RANGES + ", path array<string>, descendants array<string>"
_TYPES = [pa.string()] * 6 + [pa.int32()] * 3 + [pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
_NAMES = [c.split()[0] for c in NODES.split(", ")]
MAX_LOCAL_LINKS = 1_000_000
BATCH_ITEMS = 200_000  # of path and descendant entries in a batch handed on


def _components(nodes: list[int], down: list[list[int]]) -> list[list[int]]:
    """Strongly connected components among ``nodes``; no recursion."""
    inside, number, low, stack, on, out = set(nodes), {}, {}, [], set(), []
    for start in nodes:
        if start in number:
            continue
        work = [(start, iter(down[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        on.add(start)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in inside:
                    continue
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(down[w])))
                    break
                if w in on:
                    low[v] = min(low[v], number[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == number[v]:
                    comp = []
                    while not comp or comp[-1] != v:
                        comp.append(stack.pop())
                        on.discard(comp[-1])
                    out.append(comp)
    return out


class Ranges:
    """Nested-set ranges of one tree; nodes are numbered by name, and nodes without a root get single places behind the trees."""

    def __init__(self, links: list[tuple[str | None, str | None]]) -> None:
        self.names = sorted({v for link in links for v in link if v is not None})
        at = {v: k for k, v in enumerate(self.names)}
        n = len(self.names)
        down: list[list[int]] = [[] for _ in range(n)]
        wait, self.home = [0] * n, [-1] * n
        for a, b in sorted({(at[a], at[b]) for a, b in links if a is not None and b is not None}):
            down[a].append(b)
            wait[b] += 1
            if self.home[b] < 0:
                self.home[b] = a  # links come by name, so this is the smallest parent
        below = [v for v in range(n) if not wait[v]]
        for v in below:
            for w in down[v]:
                wait[w] -= 1
                if not wait[w]:
                    below.append(w)
        self.size, self.pre, self.depth, self.root = [1] * n, [-1] * n, [-1] * n, [-1] * n
        for v in reversed(below):  # upward
            if self.home[v] >= 0:
                self.size[self.home[v]] += self.size[v]
        free, top = [0] * n, 0
        kids: list[list[int]] = [[] for _ in range(n)]
        roots = []
        for v in sorted(below):
            (kids[self.home[v]] if self.home[v] >= 0 else roots).append(v)
        for v in roots:
            self.pre[v], top = top, top + self.size[v]
            self.depth[v], self.root[v] = 0, v
        level = roots
        while level:  # downward
            nxt = []
            for p in level:
                free[p] = self.pre[p] + 1
                for v in kids[p]:
                    self.pre[v], free[p] = free[p], free[p] + self.size[v]
                    self.depth[v], self.root[v] = self.depth[p] + 1, self.root[p]
                nxt += kids[p]
            level = nxt
        self.cycle: dict[int, int] = {}
        rest = [v for v in range(n) if self.pre[v] < 0]
        for comp in _components(rest, down):
            if len(comp) > 1 or comp[0] in down[comp[0]]:
                self.cycle.update(dict.fromkeys(comp, min(comp)))
        for v in rest:
            self.pre[v], top, self.home[v] = top, top + 1, -1
        self.place = [0] * n
        for v in range(n):
            self.place[self.pre[v]] = v
        extra = sorted((self.pre[v], self.pre[w]) for v in range(n) for w in down[v] if self.home[w] != v)
        self.extra_from, self.extra_to = [e[0] for e in extra], [e[1] for e in extra]

    def row(self, v: int) -> tuple:
        name = lambda k: self.names[k] if k >= 0 else None
        rooted = self.depth[v] >= 0
        state = "cycle" if v in self.cycle else "rooted" if rooted else "below_cycle"
        return (self.names[v], state, name(self.root[v]), name(self.home[v]), self.depth[v] if rooted else None, self.pre[v] if rooted else None, self.size[v] if rooted else None, name(self.cycle.get(v, -1)))

    def spans(self, v: int) -> list[tuple[int, int]]:
        """The disjoint ranges of all that can be reached from v, its own first; ranges nest or are apart, so one held place means a held range."""
        own = (self.pre[v], self.pre[v] + self.size[v])
        held = [own]
        work = [own]
        while work:
            a, b = work.pop()
            for k in range(bisect_left(self.extra_from, a), bisect_left(self.extra_from, b)):
                p = self.extra_to[k]
                i = bisect_left(held, (p + 1,)) - 1
                if i >= 0 and held[i][0] <= p < held[i][1]:
                    continue
                e = p + self.size[self.place[p]]
                j = i + 1
                while j < len(held) and held[j][0] < e:  # smaller ranges inside the new one
                    j += 1
                held[i + 1 : j] = [(p, e)]
                work.append((p, e))
        return held

    def unrolled(self) -> Iterator[tuple]:
        """Rows with path and descendants, in preorder."""
        path: list[str] = []
        for v in self.place:
            d = self.depth[v]
            if d >= 0:
                del path[d:]
                path.append(self.names[v])
            itself = v in self.cycle
            reach = [self.names[self.place[k]] for a, b in self.spans(v) for k in range(a, b) if itself or k != self.pre[v]]
            yield (*self.row(v), list(path) if d >= 0 else None, reach)


def _solver(unroll: bool):
    """Links sorted by tree -> rows of RANGES or NODES."""
    names, types = (_NAMES, _TYPES) if unroll else (_NAMES[:-2], _TYPES[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def trees() -> Iterator[tuple[tuple, list]]:
            key, links = None, []
            for b in batches:
                for h, t, p, c in zip(*(b.column(k).to_pylist() for k in range(4))):
                    if links and (h, t) != key:
                        yield key, links
                        links = []
                    key = (h, t)
                    links.append((p, c))
            if links:
                yield key, links

        rows, items = [], 0
        for key, links in trees():
            r = Ranges(links)
            for row in r.unrolled() if unroll else map(r.row, range(len(r.names))):
                rows.append((*key, *row))
                items += 1 + (len(row[-1]) + len(row[-2] or ()) if unroll else 0)
                if items > BATCH_ITEMS:
                    yield flush(rows)
                    rows, items = [], 0
        if rows:
            yield flush(rows)

    return run


def _doubled(state: DataFrame, value: str, up: bool) -> DataFrame:
    """state (K, node, anc, value) with the values summed along the way to the root; with ``up`` those of each node's subtree instead.

    After round r a node's ``anc`` lies 2**r above, and its value holds that many nodes of the way (or levels of the
    subtree); only a logarithm of the depth in rounds is needed, each a join of as many rows as there are nodes.
    """
    state = cut(state)
    while not state.filter("anc IS NOT NULL").isEmpty():
        above = state.select(*K, F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col(value).alias("v2"))
        far = state.join(above, [*K, "anc"], "left")
        if up:
            got = state.filter("anc IS NOT NULL").groupBy(*K, F.col("anc").alias("node")).agg(F.sum(value).alias("got"))
            far = far.join(got, [*K, "node"], "left").select(*K, "node", F.col("anc2").alias("anc"), (F.col(value) + F.coalesce("got", F.lit(0))).alias(value))
        else:
            far = far.select(*K, "node", F.col("anc2").alias("anc"), (F.col(value) + F.coalesce("v2", F.lit(0))).alias(value))
        state = cut(far)
    return state.drop("anc")


def _before(rows: DataFrame, group: list[str], order: str, value: str, out: str) -> DataFrame:
    """rows with ``out``, the sum of ``value`` over earlier rows of the group; a group is summed in sorted parts, so it may be of any size."""
    parted = stored(rows.repartitionByRange(*[F.col(c) for c in (*group, order)]).withColumn("part", F.spark_partition_id()))
    sums = parted.groupBy(*group, "part").agg(F.sum(value).alias("s"))
    w = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    offset = sums.select(*group, "part", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("offset"))
    inner = Window.partitionBy(*group, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*group, "part")]
    return parted.withColumn("inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).alias("x").join(offset.alias("o"), same).select("x.*", (F.col("offset") + F.col("inner")).alias(out)).drop("inner", "part")


def _rooted(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(K, node) of all nodes that hang below no cycle. Chains of nodes with one parent count as that chain's head, and heads are walked round by round."""
    ways = links.groupBy(*K, F.col("child").alias("node")).agg(F.count("*").alias("ways"), F.min("parent").alias("only"))
    n = stored(nodes.join(ways, [*K, "node"], "left").select(*K, "node", F.coalesce("ways", F.lit(0)).alias("ways"), "only"))
    # Jump along only parents until a head, which has none or several; who never gets there is on or below a cycle.
    state = cut(n.select(*K, "node", F.when(F.col("ways") == 1, F.col("only")).otherwise(F.col("node")).alias("head"), (F.col("ways") != 1).alias("done")))
    while True:
        above = state.select(*K, F.col("node").alias("head"), F.col("head").alias("head2"), F.col("done").alias("done2"))
        nxt = cut(state.join(above, [*K, "head"]).select(*K, "node", F.col("head2").alias("head"), (F.col("done") | F.col("done2")).alias("done"), (~F.col("done") & F.col("done2")).alias("moved")))
        moved = not nxt.filter("moved").isEmpty()
        state = nxt.drop("moved")
        if not moved:
            break
    state = state.filter("done").select(*K, "node", "head")
    heads = n.filter("ways > 1").select(*K, "node", "ways")
    feeds = stored(links.join(heads.select(*K, F.col("node").alias("child")), [*K, "child"]).join(state.select(*K, F.col("node").alias("parent"), "head"), [*K, "parent"]).groupBy(*K, "head", "child").agg(F.count("*").alias("by")))
    done = front = cut(n.filter("ways = 0").select(*K, F.col("node").alias("head")))
    wait = cut(heads)
    while True:
        freed = feeds.join(front, [*K, "head"]).groupBy(*K, F.col("child").alias("node")).agg(F.sum("by").alias("freed"))
        wait = cut(wait.filter("ways > 0").join(freed, [*K, "node"], "left").select(*K, "node", (F.col("ways") - F.coalesce("freed", F.lit(0))).alias("ways")))
        front = wait.filter("ways = 0").select(*K, F.col("node").alias("head"))
        if front.isEmpty():
            break
        done = cut(done.unionByName(front))
    return cut(state.join(done, [*K, "head"], "left_semi").select(*K, "node"))


def _cycles(links: DataFrame, core: DataFrame) -> DataFrame:
    """(K, node, cycle_id) of the components in ``core``: colour by the least ancestor, then go back from it."""
    left, found = cut(core), None
    while not left.isEmpty():
        inner = cut(links.join(left.select(*K, F.col("node").alias("parent")), [*K, "parent"]).join(left.select(*K, F.col("node").alias("child")), [*K, "child"]).select(*K, "parent", "child"))
        colour = cut(left.withColumn("colour", F.col("node")))
        while True:
            passed = inner.join(colour.select(*K, F.col("node").alias("parent"), "colour"), [*K, "parent"]).groupBy(*K, F.col("child").alias("node")).agg(F.min("colour").alias("got"))
            nxt = cut(colour.join(passed, [*K, "node"], "left").select(*K, "node", F.least("colour", F.coalesce("got", "colour")).alias("colour"), (F.col("got") < F.col("colour")).alias("moved")))
            colour, still = nxt.drop("moved"), nxt.filter("moved").isEmpty()
            if still:
                break
        same = cut(inner.join(colour.select(*K, F.col("node").alias("parent"), F.col("colour").alias("pc")), [*K, "parent"]).join(colour.select(*K, F.col("node").alias("child"), F.col("colour").alias("cc")), [*K, "child"]).filter("pc = cc").select(*K, "parent", "child", F.col("pc").alias("colour")))
        back = front = cut(colour.filter("node = colour"))
        while True:
            front = cut(same.join(front.select(*K, F.col("node").alias("child")), [*K, "child"], "left_semi").select(*K, F.col("parent").alias("node"), "colour").distinct().join(back, [*K, "node"], "left_anti"))
            if front.isEmpty():
                break
            back = cut(back.unionByName(front))
        back = back.withColumnRenamed("colour", "cycle_id")
        found = back if found is None else found.unionByName(back)
        left = cut(left.join(back, [*K, "node"], "left_anti"))
    if found is None:
        return core.withColumn("cycle_id", F.lit(None).cast("string")).limit(0)
    alone = found.groupBy(*K, "cycle_id").count().filter("count = 1")
    loops = links.filter("parent = child").select(*K, F.col("parent").alias("node")).distinct()
    single = found.join(alone.drop("count"), [*K, "cycle_id"], "left_semi").join(loops, [*K, "node"], "left_anti")
    return cut(found.join(single, [*K, "node"], "left_anti").select(*K, "node", "cycle_id"))


def _large_ranges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """RANGES of trees beyond a task."""
    rooted = _rooted(links, nodes)
    cyc = _cycles(links, nodes.join(rooted, [*K, "node"], "left_anti"))
    up = stored(rooted.join(links.groupBy(*K, F.col("child").alias("node")).agg(F.min("parent").alias("anc")), [*K, "node"], "left"))
    depth = _doubled(up.withColumn("depth", F.when(F.col("anc").isNull(), 0).otherwise(1)), "depth", False)
    size = _doubled(up.withColumn("subtree_size", F.lit(1)), "subtree_size", True)
    sized = up.join(size, [*K, "node"])
    step = _before(sized, [*K, "anc"], "node", "subtree_size", "step")
    pre = _doubled(step.select(*K, "node", "anc", (F.col("step") + F.when(F.col("anc").isNull(), 0).otherwise(1)).alias("preorder")), "preorder", False)
    tops = cut(up.select(*K, "node", F.coalesce("anc", "node").alias("root"), F.col("anc").isNull().alias("done")))
    while not tops.filter("NOT done").isEmpty():
        above = tops.select(*K, F.col("node").alias("root"), F.col("root").alias("root2"), F.col("done").alias("done2"))
        tops = cut(tops.join(above, [*K, "root"]).select(*K, "node", F.col("root2").alias("root"), (F.col("done") | F.col("done2")).alias("done")))
    known = sized.withColumnRenamed("anc", "parent").join(depth, [*K, "node"]).join(pre, [*K, "node"]).join(tops.drop("done"), [*K, "node"])
    state = F.when(F.col("cycle_id").isNotNull(), "cycle").when(F.col("root").isNotNull(), "rooted").otherwise("below_cycle")
    return nodes.join(known, [*K, "node"], "left").join(cyc, [*K, "node"], "left").select(*K, "node", state.alias("state"), "root", "parent", *[F.col(c).cast("int").alias(c) for c in ("depth", "preorder", "subtree_size")], "cycle_id")


def _large_unrolled(links: DataFrame, base: DataFrame) -> DataFrame:
    """NODES of trees beyond a task: ways are put together by doubling, ranges reached over other links by rounds over those links alone."""
    way = cut(base.filter("depth IS NOT NULL").select(*K, "node", F.col("parent").alias("anc"), F.array("node").alias("path")))
    while not way.filter("anc IS NOT NULL").isEmpty():
        above = way.select(*K, F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("path").alias("path2"))
        way = cut(way.join(above, [*K, "anc"], "left").select(*K, "node", F.col("anc2").alias("anc"), F.concat(F.coalesce("path2", F.array().cast("array<string>")), "path").alias("path")))
    up = cut(way.select(*K, F.col("node").alias("to"), F.explode("path").alias("node")))  # ranges, unrolled: as large as the result
    alone = base.filter("depth IS NULL").select(*K, F.col("node").alias("to"), "node")
    own = up.unionByName(alone)
    tree = base.select(*K, F.col("parent"), F.col("node").alias("child")).filter("parent IS NOT NULL")
    other = links.join(tree, [*K, "parent", "child"], "left_anti")
    enter = cut(own.join(other.select(*K, F.col("parent").alias("to"), F.col("child").alias("entry")), [*K, "to"]).select(*K, "node", "entry").distinct())
    new = enter
    while True:
        new = cut(new.join(enter.select(*K, F.col("node").alias("entry"), F.col("entry").alias("next")), [*K, "entry"]).select(*K, "node", F.col("next").alias("entry")).distinct().join(enter, [*K, "node", "entry"], "left_anti"))
        if new.isEmpty():
            break
        enter = cut(enter.unionByName(new))
    through = enter.join(own.select(*K, F.col("node").alias("entry"), "to"), [*K, "entry"]).select(*K, "node", "to")
    reach = own.filter("node != `to`").unionByName(through).distinct()
    # Rooted nodes in preorder, then the others by name, as their single places lie.
    placed = base.select(*K, F.col("node").alias("to"), F.coalesce("preorder", F.lit(2**31 - 1)).alias("at"))
    lists = reach.join(placed, [*K, "to"]).groupBy(*K, "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "to"))), lambda x: x["to"]).alias("descendants"))
    return base.join(way.drop("anc"), [*K, "node"], "left").join(lists, [*K, "node"], "left").withColumn("descendants", F.coalesce("descendants", F.array().cast("array<string>"))).select(*_NAMES)


def _solved(links: DataFrame, max_local_links: int, unroll: bool) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = links.select(name("hierarchy"), name("tree"), F.col("parent").cast("string").alias("parent"), F.col("child").cast("string").alias("child")).filter("parent IS NOT NULL OR child IS NOT NULL").distinct()
    rows = stored(rows)
    big = rows.groupBy(*K).agg(F.count("*").alias("n")).filter(F.col("n") > max_local_links).select(*K)
    has_big = not big.isEmpty()
    small = rows.join(big, K, "left_anti") if has_big else rows
    local = small.repartition(*K).sortWithinPartitions(*K).mapInArrow(_solver(unroll), NODES if unroll else RANGES)
    if not has_big:
        return local
    large = stored(rows.join(big, K, "left_semi"))
    whole = large.filter("parent IS NOT NULL AND child IS NOT NULL")
    names = stored(large.select(*K, F.col("parent").alias("node")).unionByName(large.select(*K, F.col("child").alias("node"))).filter("node IS NOT NULL").distinct())
    base = stored(_large_ranges(whole, names))
    return local.unionByName(_large_unrolled(whole, base) if unroll else base)


def ranges(links: DataFrame, max_local_links: int = MAX_LOCAL_LINKS) -> DataFrame:
    """links (hierarchy, tree, parent, child) -> one row per node, columns RANGES.

    state is ``rooted``, ``cycle`` (can be reached from itself; cycle_id is the least node of its component) or
    ``below_cycle`` (no root: parent, depth, root, preorder and subtree_size are null). A rooted node's tree
    descendants are those of a preorder within preorder + 1 .. preorder + subtree_size - 1, its ancestors those
    whose range holds its own.
    Defined cases: a link with a null child or a null parent only names its other node; repeated links count once;
    a self-link is a cycle of one; a null hierarchy or tree counts as the empty name; an empty table gives no row;
    other columns are not read.
    """
    return _solved(links, max_local_links, False)


def hierarchy(links: DataFrame, max_local_links: int = MAX_LOCAL_LINKS) -> DataFrame:
    """``ranges`` with two more columns: path (root to node; null without a root) and descendants, all nodes that can be reached, a cycle's node itself included, rooted ones in preorder and then the others by name.

    The result is as large as the paths and descendants are: a chain of n links has n * n / 2 entries of each.
    """
    return _solved(links, max_local_links, True)


def is_ancestor(above: Column, below: Column) -> Column:
    """Whether one node's range (structs of root, preorder, subtree_size of one tree) holds another's."""
    return (above["preorder"] < below["preorder"]) & (below["preorder"] < above["preorder"] + above["subtree_size"])
