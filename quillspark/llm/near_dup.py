"""Near-duplicate records with small edits, by count-vector R-trees.

Words are hashed into GROUPS groups and a record becomes the point of its group counts. The overlap of two records
is at most the sum of their coordinates' minima, and that of a record with anything in a tree's node at most the
sum of minima with the node's upper corner, so nodes below the overlap that the threshold demands are passed over.
The forest has one tree per word among a record's rarest: records of similarity t or more share one of their few
rarest words, so no pair is lost by searching trees apart. Where a word has more than BLOCK records, its tree is
parted by the second word the records share, and where that is not enough by the third: similar records also share
their second and third common word within a few places more. So a record stands in a bounded number of trees of a
bounded size, whatever the number of records; only what shares three words with more than BLOCK others is cut into
blocks that are searched pairwise. Within a tree points lie in the order of their rarest words' groups, so that a
leaf holds like records and its corner is tight. Pairs that survive are verified on the word sets. Exact copies
travel as one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import cut, stored

SLOTS = 1 << 20  # of the word frequencies that order words by rarity: a fixed size
GROUPS = 1024
BLOCK = 4096
DEPTH = 3  # words by which a tree is parted at most
PAIR_SLOTS = 1 << 22  # of the frequencies of words together: a fixed size
FANOUT = 16
PART = 1000  # ids of a class in one part, so that the pairs of a large class spread over tasks
SMALL = 48  # up to so many points a tree is a single leaf


def word_set(text: Column) -> Column:
    """Sorted distinct words (maximal runs of letters and digits after lower-casing); empty for null."""
    return F.coalesce(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))), F.array().cast("array<string>"))


def _needed(m, n, t: float):
    """Least overlap of sets of m and n words that are t similar."""
    return np.ceil(t / (1 + t) * (m + n) - 1e-9)


def _mixed(key: int, h: int) -> int:
    """The key of one word more, as a signed 64-bit number."""
    x = ((key ^ (h & 0xFFFFFFFFFFFFFFFF)) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 29
    return x - (1 << 64) if x >> 63 else x


def _ordered(col: pa.ListArray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of the records, rarest first: offsets, row, rank, word, frequency."""
    off = col.offsets.to_numpy().astype(np.int64)
    h = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]] if len(off) else np.zeros(0, np.int64)
    off = off - off[0]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    freq = seen[h & (SLOTS - 1)]
    order = np.lexsort((h, freq, row))
    rank = np.arange(len(h)) - off[row]
    return off, row, rank, h[order], freq[order]


def _probe(m: np.ndarray, t: float) -> np.ndarray:
    """Of how many rarest words similar records share one."""
    return m - np.ceil(t * m - 1e-9).astype(np.int64) + 1


def _parted(h: list[int], first: int, n_first: int, probe: int, tables: list[np.ndarray], block: int) -> Iterator[tuple[int, int, int]]:
    """Trees of a record under its word ``first``: (key, frequency, words of the key). More words follow where a tree is too large and ``tables`` tell of them."""
    work = [(first, h[first], n_first, 1)]
    while work:
        last, key, n, depth = work.pop()
        if n < 2:
            continue  # leads nowhere
        if n <= block or depth > len(tables):
            yield key, n, depth
            continue
        table = tables[depth - 1]
        for j in range(last + 1, min(len(h), probe + depth)):
            k = _mixed(key, h[j])
            work.append((j, k, int(table[k & (PAIR_SLOTS - 1)]), depth + 1))


def _counter(shared, t: float, block: int):
    """Counts of the keys of one word more than ``shared`` has tables for, where the tree above is too large."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tables = shared.value
        sums = np.zeros(PAIR_SLOTS, np.int64)
        for b in batches:
            off, row, rank, h, freq = _ordered(b.column(1), seen)
            probe = _probe(np.diff(off), t)
            for i in np.flatnonzero((rank < probe[row]) & (freq > block)):
                r = row[i]
                words, p = h[off[r] : off[r + 1]].tolist(), int(probe[r])
                work = [(int(rank[i]), words[rank[i]], 1)]
                while work:
                    last, key, depth = work.pop()
                    for j in range(last + 1, min(len(words), p + depth)):
                        k = _mixed(key, words[j])
                        if depth > len(tables):
                            sums[k & (PAIR_SLOTS - 1)] += 1
                        elif tables[depth - 1][k & (PAIR_SLOTS - 1)] > block:
                            work.append((j, k, depth + 1))
        k = np.flatnonzero(sums)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(sums[k])], names=["slot", "n"])

    return count


def _poster(shared, t: float, block: int):
    """(cid, hashes) -> postings: bucket, lo, hi (blocks), side, cid, size, pos, groups."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tables = shared.value
        for b in batches:
            off, row, rank, h, freq = _ordered(b.column(1), seen)
            if not h.size:
                continue
            m = np.diff(off)
            cid = b.column(0).to_numpy()
            group = ((h >> 40) & (GROUPS - 1)).astype(np.uint16)
            packed = [group[off[r] : off[r + 1]].tobytes() for r in range(len(m))]
            probe = _probe(m, t)
            within = rank < probe[row]
            one = np.flatnonzero(within & (freq > 1) & (freq <= block))
            keys, many, at = [h[one]], [np.ones(len(one), np.int64)], [one]
            for i in np.flatnonzero(within & (freq > block)):
                r = row[i]
                got = list(_parted(h[off[r] : off[r + 1]].tolist(), int(rank[i]), int(freq[i]), int(probe[r]), tables, block))
                keys.append(np.array([g[0] for g in got], np.int64))
                many.append(np.array([-(-g[1] // block) for g in got], np.int64))
                at.append(np.full(len(got), i))
            key, blocks, at = np.concatenate(keys), np.concatenate(many), np.concatenate(at)
            rows = row[at]
            rep = np.repeat(np.arange(len(at)), blocks)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            own = (((cid[rows] >> 20) & 0x7FFFFFFF) % blocks)[rep]
            lo, hi = np.minimum(own, other), np.maximum(own, other)
            r = rows[rep]
            for s in range(0, len(r), 20_000):
                k = slice(s, s + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[rep][k]), pa.array(lo[k].astype(np.int32)), pa.array(hi[k].astype(np.int32)), pa.array(own[k].astype(np.int32)), pa.array(cid[r][k]), pa.array(m[r][k].astype(np.int32)), pa.array(rank[at][rep][k].astype(np.int32)), pa.array([packed[x] for x in r[k]], pa.binary())],
                    names=["bucket", "lo", "hi", "side", "cid", "size", "pos", "groups"],
                )

    return post


def _points(groups: list[bytes]) -> np.ndarray:
    k = len(groups)
    lens = np.array([len(g) // 2 for g in groups])
    flat = np.frombuffer(b"".join(groups), np.uint16).astype(np.int64) + np.repeat(np.arange(k) * GROUPS, lens)
    counts = np.bincount(flat, minlength=k * GROUPS).reshape(k, GROUPS)
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 256 else np.int32)


def _bound(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of all rows of q with all rows of p: a product per count layer."""
    out = np.zeros((len(q), len(p)), np.float32)
    for layer in range(1, int(min(q.max(initial=0), p.max(initial=0))) + 1):
        a, b = q >= layer, p >= layer
        use = np.flatnonzero(a.any(0) & b.any(0))
        if not len(use):
            break
        out += a[:, use].astype(np.float32) @ b[:, use].astype(np.float32).T
    return out


def tree_pairs(cid: np.ndarray, size: np.ndarray, pos: np.ndarray, side: np.ndarray, groups: list[bytes], t: float, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket whose points' bound reaches the overlap they need; the smaller set is the query."""
    order = np.array(sorted(range(len(cid)), key=lambda i: (groups[i], cid[i])), np.int64)  # like records side by side
    cid, size, pos, side = cid[order], size[order], pos[order], side[order]
    place = np.empty(len(cid), np.int64)
    place[np.lexsort((cid, pos, size))] = np.arange(len(cid))  # the smaller set is the query
    pts = _points([groups[i] for i in order])
    index = np.flatnonzero(pos <= size - np.ceil(2 * t / (1 + t) * size - 1e-9))
    if not len(index):
        return cid[:0], cid[:0]

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes, and places of the shared word, leave room for the overlap needed; ordered, each pair once."""
        ok = (size[a] >= t * size[b] - 1e-9) & (np.minimum(size[a] - pos[a], size[b] - pos[b]) >= _needed(size[a], size[b], t)) & (place[a] < place[b])
        return ok & (side[a] != side[b]) if cross else ok

    k = len(cid)
    if k <= SMALL:
        a, b = np.repeat(index, k), np.tile(np.arange(k), len(index))
        keep = fits(a, b)
        a, b = a[keep], b[keep]
    else:
        # Bulk-loaded: leaves of FANOUT points, nodes of FANOUT leaves; corners are upper bounds.
        leaves = [np.arange(s, min(s + FANOUT, k)) for s in range(0, k, FANOUT)]
        corner = np.maximum.reduceat(pts, np.arange(0, k, FANOUT), axis=0)
        nodes = np.maximum.reduceat(corner, np.arange(0, len(leaves), FANOUT), axis=0)
        least, most = np.minimum.reduceat(size, np.arange(0, k, FANOUT)), np.maximum.reduceat(size, np.arange(0, k, FANOUT))
        under = np.minimum.reduceat(least, np.arange(0, len(leaves), FANOUT))
        got_a, got_b = [], []
        for s in range(0, len(index), 512):
            q = index[s : s + 512]
            room = _bound(pts[q], nodes)
            need = t / (1 + t) * (size[q][:, None] + np.maximum(size[q][:, None], under[None, :])) - 1e-6
            qi, ni = np.nonzero(room >= need)
            if not len(qi):
                continue
            lone = np.unique(ni)
            kids = np.concatenate([np.arange(x * FANOUT, min((x + 1) * FANOUT, len(leaves))) for x in lone])
            open_node = np.zeros((len(q), len(nodes)), bool)
            open_node[qi, ni] = True
            room = _bound(pts[q], corner[kids])
            need = t / (1 + t) * (size[q][:, None] + np.maximum(size[q][:, None], least[kids][None, :])) - 1e-6
            hit = (room >= need) & open_node[:, kids // FANOUT] & (t * least[kids][None, :] <= size[q][:, None] + 1e-9) & (most[kids][None, :] >= size[q][:, None])
            qi, li = np.nonzero(hit)
            if not len(qi):
                continue
            leaf = kids[li]
            a = np.repeat(q[qi], FANOUT)
            b = (leaf[:, None] * FANOUT + np.arange(FANOUT)[None, :]).ravel()
            a, b = a[b < k], b[b < k]
            keep = fits(a, b)
            got_a.append(a[keep])
            got_b.append(b[keep])
        a = np.concatenate(got_a) if got_a else index[:0]
        b = np.concatenate(got_b) if got_b else index[:0]
    good = []
    for s in range(0, len(a), 20_000):
        x, y = a[s : s + 20_000], b[s : s + 20_000]
        good.append(np.minimum(pts[x], pts[y]).sum(1, dtype=np.int32) >= _needed(size[x], size[y], t))
    keep = np.concatenate(good) if good else np.zeros(0, bool)
    a, b = cid[a[keep]], cid[b[keep]]
    return np.minimum(a, b), np.maximum(a, b)


def _searcher(t: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted postings; a run of one (bucket, lo, hi) is at most two blocks."""
        held: list[list] = []
        key = None

        def run() -> pa.RecordBatch | None:
            cols = [np.concatenate([h[i] for h in held]) for i in range(4)]
            if len(cols[0]) < 2:
                return None
            groups = [g for h in held for g in h[4]]
            a, b = tree_pairs(*cols, groups, t, key[1] != key[2])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]) if len(a) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy() for i in range(3)]
            side, cid, size, pos = (batch.column(i).to_numpy() for i in (3, 4, 5, 6))
            groups = batch.column(7).to_pylist()
            change = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0) | (np.diff(keys[2]) != 0)) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            for s, e in zip(bounds, bounds[1:]):
                k = (keys[0][s], keys[1][s], keys[2][s])
                if k != key:
                    if held and (out := run()) is not None:
                        yield out
                    key, held = k, []
                held.append([cid[s:e], size[s:e], pos[s:e], side[s:e], groups[s:e]])
        if held and (out := run()) is not None:
            yield out

    return search


class NearDuplicates:
    """``members`` (id, cid, key, copy; ids of one copy have the same text), ``classes`` (cid, words) of distinct word sets, ``pairs`` (a, b) of classes at least ``threshold`` similar (Jaccard).

    Defined cases: null and empty texts, and texts without a word, are in no pair; rows with a null id are left
    out; an id with several texts takes part with each; repeated rows count once; equal word sets, whatever the
    texts, are one class; an empty table gives nothing; other columns are not read.
    """

    def __init__(self, df: DataFrame, record_id: Column, text: Column, threshold: float = 0.75) -> None:
        sc = df.sparkSession.sparkContext
        rows = df.select(record_id.cast("string").alias("id"), word_set(text.cast("string")).alias("words"), F.md5(text.cast("string")).alias("copy")).filter(F.col("id").isNotNull() & (F.size("words") > 0))
        rows = rows.withColumn("key", F.sha2(F.array_join("words", " "), 256)).withColumn("cid", F.xxhash64("key"))
        self.members = stored(rows.select("id", "cid", "key", "copy").distinct())
        # The key keeps classes apart should two share a cid; pairs are verified on words in any case.
        self.classes = stored(rows.dropDuplicates(["key"]).select("cid", "key", "words"))
        hashed = self.classes.select("cid", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
        counted = hashed.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.count("*").alias("n")).toPandas()  # at most SLOTS rows
        frequency = np.zeros(SLOTS, np.int64)
        frequency[counted["slot"].to_numpy()] = counted["n"].to_numpy()
        tables: list[np.ndarray] = []
        hot = frequency.max(initial=0) > BLOCK
        while hot and len(tables) < DEPTH - 1:
            sums = hashed.mapInArrow(_counter(sc.broadcast((frequency, tables)), threshold, BLOCK), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most PAIR_SLOTS rows
            table = np.zeros(PAIR_SLOTS, np.int64)
            table[sums["slot"].to_numpy(np.int64)] = sums["n"].to_numpy()
            tables = [*tables, table]
            hot = table.max(initial=0) > BLOCK
        posts = hashed.mapInArrow(_poster(sc.broadcast((frequency, tables)), threshold, BLOCK), "bucket bigint, lo int, hi int, side int, cid bigint, size int, pos int, groups binary")
        found = posts.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(_searcher(threshold), "a bigint, b bigint").distinct()
        side = lambda x: self.classes.select(F.col("cid").alias(x), F.col("key").alias(f"key_{x}"), F.col("words").alias(f"words_{x}"))
        both = found.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("words_a", "words_b")))
        both = both.filter(F.col("common") >= threshold * (F.size("words_a") + F.size("words_b") - F.col("common")))
        self.pairs = stored(both.select("key_a", "key_b", (F.col("common") / (F.size("words_a") + F.size("words_b") - F.col("common"))).alias("similarity")))

    def id_pairs(self, most_copies: int | None = None) -> DataFrame:
        """(id_a, id_b) of all different ids, id_a < id_b, copies within a class included.

        The pairs of copies grow with the square of their number. A caller who does not want them names
        ``most_copies``: where more ids than that have exactly the same text, the least stands for them in all pairs
        and each other is paired with it alone. Different texts are never merged, even of the same words.
        """
        m, star = self.members, None
        if most_copies is not None:
            sizes = m.groupBy("key", "copy").agg(F.count("*").alias("n"), F.min("id").alias("rep")).filter(F.col("n") > most_copies)
            m = stored(m.join(sizes, ["key", "copy"], "left"))
            star = m.filter("id != rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
            m = m.filter("rep IS NULL OR id = rep")
        m = stored(m.select("key", "id").withColumn("parts", F.ceil(F.count("*").over(Window.partitionBy("key")) / PART).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")))
        parts = m.groupBy("key").agg(F.first("parts").alias("parts"), F.count("*").alias("n"))
        several = parts.filter("n > 1").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))
        links = self.pairs.select("key_a", "key_b").unionByName(several)
        for x in "ab":
            links = links.join(parts.select(F.col("key").alias(f"key_{x}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{x}")), f"key_{x}")
        for x in "ab":
            links = links.join(m.select(F.col("key").alias(f"key_{x}"), F.col("part").alias(f"part_{x}"), F.col("id").alias(f"id_{x}")), [f"key_{x}", f"part_{x}"])
        # A class is linked with itself in both orders.
        pairs = links.filter("id_a < id_b OR key_a != key_b AND id_a != id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        return (pairs if star is None else pairs.unionByName(star)).distinct()

    def groups(self) -> DataFrame:
        """One row per (id, class): id, class_id, group_id (least class of its connected component), links (classes similar to its own)."""
        edges = self.pairs.select(F.col("key_a").alias("u"), F.col("key_b").alias("v"))
        both = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        label = cut(both.groupBy("u").agg(F.min("v").alias("l")).select("u", F.least("u", "l").alias("l")))
        while True:
            near = both.join(label.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("lv"))
            step = label.join(near, "u").select("u", F.least("l", "lv").alias("l"), F.col("l").alias("was"))
            jump = step.join(step.select(F.col("u").alias("l"), F.col("l").alias("ll")), "l", "left").select("u", F.least("l", F.coalesce("ll", "l")).alias("l"), "was")
            nxt = cut(jump)
            moved = not nxt.filter("l != was").isEmpty()
            label = nxt.select("u", "l")
            if not moved:
                break
        links = both.groupBy("u").count().select(F.col("u").alias("key"), F.col("count").alias("links"))
        return (
            self.members.select("id", "key").distinct().join(label.select(F.col("u").alias("key"), F.col("l").alias("group_id")), "key", "left").join(links, "key", "left")
            .select("id", F.substring("key", 1, 16).alias("class_id"), F.substring(F.coalesce("group_id", "key"), 1, 16).alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
        )
