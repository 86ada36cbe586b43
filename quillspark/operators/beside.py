"""A learner's rows beside a table that every learner meets: links, questions, documents.

Joined by concept, each state meets all that touches its concept, and that many rows would be shuffled and sorted to
be counted by learner again. Here the rows are placed by learner once, each task reads the common table from the
shared folder as whole numbers, and what a learner meets is worked out where the learner's rows are.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import tables_dir


def kept(df: DataFrame, name: str) -> str:
    """df as a table of the shared folder that tasks read themselves; gives its place."""
    path = f"{tables_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def read(path: str) -> pa.Table:
    """The table of ``kept``, in a task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    if re.match(r"^\w+:", path) and not path.startswith("file:"):
        system, path = fs.FileSystem.from_uri(path)
    else:
        system, path = fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pq.read_table(path, filesystem=system)


def kept_parts(df: DataFrame, name: str, n: int, by: str, *order: str) -> str:
    """``kept`` in n parts by the hash of a column, each sorted, for ``read_part``."""
    path = f"{tables_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.withColumn("part", F.pmod(F.xxhash64(by), F.lit(n))).repartition("part").sortWithinPartitions("part", *order).write.partitionBy("part").parquet(path)
    return path


def read_part(path: str, k: int) -> pa.Table | None:
    """Part k of ``kept_parts``, in a task; None if it has no row."""
    try:
        return read(f"{path}/part={k}")
    except FileNotFoundError:
        return None


def coded(values: pa.ChunkedArray, at: dict[str, int]) -> np.ndarray:
    """The numbers of strings, -1 for those without one."""
    d = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).dictionary_encode()
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    own = np.array([at.get(v, -1) for v in d.dictionary.to_pylist()] + [-1], np.int64)
    return own[d.indices.fill_null(len(own) - 1).to_numpy(zero_copy_only=False)]


def offsets(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each number begin in sorted ``keys``."""
    return np.searchsorted(keys, np.arange(n + 1))


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    size = ends - starts
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size)


def by_learner(rows: DataFrame, work: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str, *order: str) -> DataFrame:
    """rows placed by learner_id and sorted; ``work`` gets tables that hold whole learners."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            names = b.column("learner_id")
            last = names[-1].as_py()
            if held and held[0].column("learner_id")[0].as_py() == last:
                held.append(b)
                continue
            cut = bisect_first(names, last)
            if held or cut:
                yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        if held:
            yield pa.Table.from_batches(held)

    return rows.repartition("learner_id").sortWithinPartitions("learner_id", *order).mapInArrow(lambda batches: work(whole(batches)), schema)


def bisect_first(names: pa.Array, last: str) -> int:
    """The first place of ``last`` in names that end in its run."""
    low, high = 0, len(names) - 1
    while low < high:
        mid = (low + high) // 2
        if names[mid].as_py() == last:
            high = mid
        else:
            low = mid + 1
    return low


def runs(names: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """Learners of a table of whole learners, and where their rows begin."""
    d = names.combine_chunks().dictionary_encode()
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    k = d.indices.to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return [d.dictionary[int(k[i])].as_py() for i in begin], np.append(begin, len(k))


class Bank:
    """A question bank as whole numbers: questions in order of id, the concepts of each, and the questions of each concept."""

    def __init__(self, t: pa.Table) -> None:
        t = t.sort_by("question_id").combine_chunks()
        self.table, self.ids = t, t["question_id"].combine_chunks()
        lists = t["concepts"].combine_chunks()
        names = sorted(v for v in lists.flatten().unique().to_pylist() if v is not None)
        self.at = {v: k for k, v in enumerate(names)}
        concept = coded(lists.flatten(), self.at)
        question = np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy()))
        question, concept = question[concept >= 0], concept[concept >= 0]
        size = np.bincount(question, minlength=t.num_rows)
        place = np.arange(len(question)) - np.repeat(np.cumsum(size) - size, size)
        self.concepts = np.full((t.num_rows, max(1, int(size.max(initial=1)))), len(names))  # filled up with a concept nobody has
        self.concepts[question, place] = concept
        order = np.argsort(concept, kind="stable")
        self.asks, self.first = question[order], offsets(concept[order], len(names))

    def place(self, question_id: str | None) -> int:
        """Where the question of an id is, -1 where there is none."""
        if question_id is None:
            return -1
        k = bisect_left(range(len(self.ids)), question_id, key=lambda i: self.ids[i].as_py())
        return k if k < len(self.ids) and self.ids[k].as_py() == question_id else -1

    def only(self, mask: np.ndarray) -> None:
        """Concepts lead to the questions of the mask only; all questions keep their places and concepts."""
        none = len(self.first) - 1
        concept = np.repeat(np.arange(none), np.diff(self.first))[mask[self.asks]]
        self.asks, self.first = self.asks[mask[self.asks]], offsets(concept, none)

    def shorten(self, scores: np.ndarray, most: int) -> None:
        """Prepare ``shortlist``: no concept is asked about more than ``most`` times; scores by (question, concepts verified).

        Of the questions on one concept alone the first ``most`` can be taken, and a question of which only that
        concept is verified can be taken if it comes before the last of these. Others are met by two concepts.
        """
        none = len(self.first) - 1
        n = (self.concepts != none).sum(1)
        question = self.asks
        concept = np.repeat(np.arange(none), np.diff(self.first))
        order = np.lexsort((question, -scores[question, 1], concept))
        question, concept = question[order], concept[order]
        alone = n[question] == 1
        upto = np.cumsum(alone)
        before = np.concatenate([[0], upto])[self.first[:-1]] if none else upto
        keep = upto - alone - before[concept] < most
        self.short, self.short_first = question[keep], offsets(concept[keep], none)
        pairs = [np.zeros(0, np.int64)]
        whose = [np.zeros(0, np.int64)]
        rows = np.sort(self.concepts, 1)
        for i in range(rows.shape[1]):
            for j in range(i + 1, rows.shape[1]):
                q = np.flatnonzero(rows[:, j] < none)
                pairs.append(rows[q, i] * none + rows[q, j])
                whose.append(q)
        key, q = np.concatenate(pairs), np.concatenate(whose)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_q = key[order], q[order]

    def shortlist(self, c: np.ndarray) -> np.ndarray:
        """All questions that may be taken for a learner who verifies the concepts c, in order of id."""
        if len(c) > 3_000:  # pairs would be millions
            return self.touching(c)
        c = np.sort(c)
        i, j = np.triu_indices(len(c), 1)
        key = c[i] * (len(self.first) - 1) + c[j]
        two = self.pair_q[spread(np.searchsorted(self.pair_key, key), np.searchsorted(self.pair_key, key, "right"))]
        return np.unique(np.concatenate([self.short[spread(self.short_first[c], self.short_first[c + 1])], two]))

    def touching(self, concepts: np.ndarray) -> np.ndarray:
        """Questions of any of the concepts, each once, in order of id."""
        return np.unique(self.asks[spread(self.first[concepts], self.first[concepts + 1])])

    def levels(self, concept: np.ndarray, priority: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """From the highest priority down: the questions whose highest priority it is; concepts are a learner's known numbers."""
        over = np.full(len(self.first), -np.inf)
        over[concept] = priority
        for p in sorted(set(priority.tolist()), reverse=True):
            q = self.touching(concept[priority == p])
            yield p, q[over[self.concepts[q]].max(1) == p]


def bank_of(questions: DataFrame, *columns) -> str:
    """questions (question_id, concept_ids), one row a question_id, kept with further columns for ``Bank``."""
    q = questions.select("question_id", F.array_distinct("concept_ids").alias("concepts"), *columns)
    return kept(q.filter(F.size("concepts") > 0), "bank")
