"""Reading level of each document, by harmonic iterations on a document-word graph.

Documents and words are the nodes; an edge weighs the word's rarity within each sentence it stands in, every full
sentence weighing the same. Graded examples
are clamped to their level, and in each round every word takes the mean of its documents and every other document
the mean of its words, so difficulty spreads from the examples over the whole corpus. The examples' edges together
weigh as much as the corpus's, whatever its size. Word nodes are hashed into
SLOTS places: a round sends one vector of that size to the tasks, and each task adds up its documents into one, so
edges are never shuffled. The examples' own free scores give the cuts between the levels, which settle where the
corpus is thinnest near them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.words import WORD, language
from quillspark.session import stored

SENTENCE = re.compile(r"[.!?]+\s|[\r\n]+")
SLOTS = 1 << 18
LEVELS = ("primary", "middle", "secondary", "tertiary")
ROUNDS, TOLERANCE = 100, 0.0001  # the rounds end once no word moves by more; their number only guards against none such
COMMON = 0.005  # share of the documents at which a word carries half its weight
BIN, FULL_WORDS = 0.01, 80  # of the corpus's scores, by which the cuts are settled
SHORT = 4.0  # words from which a sentence counts in full
PRIOR = 0.5  # full sentences' worth of the mean level that each word starts with
_EDGES = "doc_id bigint, grade double, n_words int, lang string, slots array<int>, sentences array<int>"

_WEIGHED = "doc_id bigint, grade double, n_words int, lang string, slots array<int>, weights array<float>"


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, int] = {}

    def place(word: str) -> int:
        if len(memo) > 500_000:
            memo.clear()
        memo[word] = xxhash.xxh64_intdigest(word.encode()) & (SLOTS - 1)
        return memo[word]

    for b in batches:
        n, langs, slots, sentences = [], [], [], []
        for t in b.column(2).to_pylist():
            w: list[str] = []
            c: list[int] = []
            of: list[int] = []
            k = 0
            for sentence in SENTENCE.split(t.lower()) if t else ():
                said = WORD.findall(sentence)
                if said:
                    w += said
                    c += [memo[x] if x in memo else place(x) for x in said]
                    of += [k] * len(said)
                    k += 1
            n.append(len(w))
            langs.append(language(w))
            slots.append(c)
            sentences.append(of)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(langs, pa.string()), pa.array(slots, pa.list_(pa.int32())), pa.array(sentences, pa.list_(pa.int32()))], names=["doc_id", "grade", "n_words", "lang", "slots", "sentences"])


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def _weigher(shared):
    """Edges of words by sentence -> distinct edges of a document with their weights, which no round changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for b in batches:
            slots, off = _flat(b.column(4))
            sentence, _ = _flat(b.column(5))
            m = np.diff(off)
            doc = np.repeat(np.arange(len(m)), m)
            many = np.zeros(len(m), np.int64)
            many[m > 0] = sentence[off[1:][m > 0] - 1] + 1
            of = sentence + (np.cumsum(many) - many)[doc]
            w = rarity[slots]
            total = np.bincount(of, w)
            full = np.minimum(1.0, np.bincount(of) / SHORT)  # a heading of a word or two is no sentence
            w = w * (full / np.where(total > 0, total, 1.0))[of]
            pair, at = np.unique(doc * np.int64(SLOTS) + slots, return_inverse=True)
            weight = np.bincount(at, w, minlength=len(pair)).astype(np.float32)
            ends = np.searchsorted(pair // SLOTS, np.arange(len(m) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in ((pair % SLOTS).astype(np.int32), weight)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), *lists], names=["doc_id", "grade", "n_words", "lang", "slots", "weights"])

    return run


def _free_scores(b: pa.RecordBatch, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted means of the documents' words; the slots, documents and weights of all edges."""
    slots, off = _flat(b.column(4))
    w, _ = _flat(b.column(5))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    top = np.bincount(doc, w * level[slots], minlength=len(off) - 1)
    all_ = np.bincount(doc, w, minlength=len(off) - 1)
    return np.divide(top, all_, out=np.full(len(all_), np.nan), where=all_ > 0), slots, doc, w


def _round(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, first, pull = shared.value
        top, all_ = np.zeros(SLOTS), np.zeros(SLOTS)
        for b in batches:
            score, slots, doc, w = _free_scores(b, level)
            grade = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            graded = ~np.isnan(grade)
            score = np.where(graded, grade, score)
            w = np.where(graded[doc], pull * w, w)
            use = graded[doc] if first else ~np.isnan(score[doc])
            top += np.bincount(slots[use], w[use] * score[doc][use], minlength=SLOTS)
            all_ += np.bincount(slots[use], w[use], minlength=SLOTS)
        k = np.flatnonzero(all_)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(top[k]), pa.array(all_[k])], names=["slot", "top", "total"])

    return run


def _cuts(scores: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Between neighbouring levels, the cut with fewest examples on the wrong side, in the middle of its gap."""
    cuts = []
    for g in range(len(LEVELS) - 1):
        low, high = scores[grades <= g], scores[grades > g]
        s = np.sort(scores)
        mids = np.concatenate([[s[0] - 1e-6], (s[1:] + s[:-1]) / 2, [s[-1] + 1e-6]]) if len(s) else np.array([g + 0.5])
        wrong = np.array([(low > m).sum() + (high <= m).sum() for m in mids])
        best = mids[wrong == wrong.min()]
        cuts.append(float(best[len(best) // 2]))
    return np.maximum.accumulate(np.array(cuts))


def _settle(cuts: np.ndarray, scores: np.ndarray, grades: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Move each cut to where the corpus is thinnest between the examples' means; bins count documents by BIN.

    A cut stays within the middle three fifths between the two means; of equally thin places, which a small corpus
    has many of, the nearest to the examples' cut counts. The rule is the same for any number of documents.
    """
    width = np.arange(-8, 9)
    kernel = np.exp(-0.5 * (width / 2.5) ** 2)
    smooth = np.convolve(bins, kernel / kernel.sum(), "same")
    at = (np.arange(len(bins)) + 0.5) * BIN
    out = cuts.copy()
    for g in range(len(cuts)):
        if not (grades == g).any() or not (grades == g + 1).any():
            continue
        low, high = scores[grades == g].mean(), scores[grades == g + 1].mean()
        inside = (at >= low + 0.2 * (high - low)) & (at <= high - 0.2 * (high - low))
        if not inside.any():
            continue
        least = smooth[inside].min()
        thin = at[inside][smooth[inside] <= least + 1e-9]
        out[g] = thin[np.argmin(np.abs(thin - cuts[g]))]
    return np.maximum.accumulate(out)


def reading_levels(docs: DataFrame, graded: DataFrame, doc_id: Column, text: Column, sample_text: Column, level: Column, lang: str = "en", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, lang, difficulty, reading_level), one row per document row; difficulty runs from 0 to 3.

    The language is voted from the text. Defined cases: null and empty texts have 0 words and no language; only
    documents in the examples' language take part and get a difficulty and a level, for others both are null;
    documents without a known word sit at the examples' mean; examples with a null text or an unknown level are
    not used; without any example difficulty and level are null; whole texts are read; repeated rows stay.
    Whatever the number of documents, ``graded`` is read as a table and only its scores are collected (one number
    per example).
    """
    sc = docs.sparkSession.sparkContext
    grade = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level.cast("string")) - 1
    a = docs.select(doc_id.cast("long").alias("doc_id"), F.lit(None).cast("double").alias("grade"), text.cast("string").alias("text"))
    g = graded.select(F.lit(None).cast("long").alias("doc_id"), grade.cast("double").alias("grade"), sample_text.cast("string").alias("text")).filter("grade >= 0 AND text IS NOT NULL")
    edges = stored(a.unionByName(g).mapInArrow(_tokenise, _EDGES))
    mine = edges.filter((F.col("lang") == lang) & (F.size("slots") > 0))
    df = mine.select(F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).toPandas()  # at most SLOTS rows
    total, examples = mine.agg(F.count("*"), F.count("grade")).first()
    pull = max(1.0, (total - examples) / max(1, examples))
    seen = np.zeros(SLOTS)
    seen[df["slot"].to_numpy(np.int64)] = df["n"].to_numpy()
    # Common words tell little, and so do those of very few documents, such as names.
    share = np.maximum(seen, 1.0) / max(1, total)
    rarity = np.log1p(1.0 / share) * share / (share + COMMON)
    mine = stored(mine.mapInArrow(_weigher(sc.broadcast(rarity)), _WEIGHED))
    mean = (len(LEVELS) - 1) / 2
    level_of, top, weight = np.full(SLOTS, mean), np.full(SLOTS, mean), np.ones(SLOTS)
    for r in range(rounds):
        sums = mine.mapInArrow(_round(sc.broadcast((level_of, r == 0, pull))), "slot int, top double, total double").groupBy("slot").agg(F.sum("top").alias("top"), F.sum("total").alias("total")).toPandas()  # at most SLOTS rows
        k = sums["slot"].to_numpy(np.int64)
        weight = np.full(SLOTS, PRIOR)
        top = weight * mean
        top[k] += sums["top"].to_numpy()
        weight[k] += sums["total"].to_numpy()
        nxt = top / weight
        moved = np.abs(nxt - level_of)[seen > 0].max(initial=0.0)
        level_of = nxt
        if r and moved < TOLERANCE:
            break
    shared = sc.broadcast((top, weight, pull))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, weights, by = shared.value
        for b in batches:
            s, slots, doc, w = _free_scores(b, tops / weights)
            # An example's free score leaves out what it gave to its words itself.
            grade = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            own = np.where(np.isnan(grade[doc]), 0.0, by * w)
            rest = np.maximum(weights[slots] - own, 1e-9)
            lone = np.divide(tops[slots] - np.where(own > 0, own * np.nan_to_num(grade[doc]), 0.0), rest)
            all_ = np.bincount(doc, w, minlength=len(s))
            s = np.divide(np.bincount(doc, w * np.clip(lone, 0, len(LEVELS) - 1), minlength=len(s)), all_, out=np.full(len(s), np.nan), where=all_ > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(s, mask=np.isnan(s))], names=["doc_id", "grade", "n_words", "lang", "free"])

    others = edges.filter((F.coalesce("lang", F.lit("")) != lang) | (F.size("slots") == 0)).select("doc_id", "grade", "n_words", "lang", F.lit(None).cast("double").alias("free"))
    scored = mine.mapInArrow(score, "doc_id bigint, grade double, n_words int, lang string, free double").unionByName(others)
    known = scored.filter("grade IS NOT NULL AND free IS NOT NULL").select("grade", "free").toPandas()
    out = scored.filter("grade IS NULL")
    if not len(known):
        return out.select("doc_id", "n_words", "lang", F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("string").alias("reading_level"))
    x, y = known["free"].to_numpy(), known["grade"].to_numpy()
    seen_at = scored.filter(f"grade IS NULL AND free IS NOT NULL AND n_words >= {FULL_WORDS}").groupBy(F.floor(F.col("free") / BIN).cast("int").alias("b")).agg(F.count("*").alias("n")).toPandas()  # at most len(LEVELS) / BIN rows
    bins = np.zeros(int(len(LEVELS) / BIN) + 1)
    bins[seen_at["b"].to_numpy(np.int64)] = seen_at["n"].to_numpy()
    cuts = _settle(_cuts(x, y), x, y, bins).tolist()
    # Difficulty: cuts map to 0.5, 1.5 and 2.5, linear between and beyond them.
    lo, hi = float(np.mean(x[y == y.min()])), float(np.mean(x[y == y.max()]))
    knots = [min(lo, cuts[0] - 1e-6), *cuts, max(hi, cuts[-1] + 1e-6)]
    marks = [0.0, 0.5, 1.5, 2.5, 3.0]
    free = F.col("free")
    part = lambda i: F.lit(marks[i]) + (free - knots[i]) / max(1e-9, knots[i + 1] - knots[i]) * (marks[i + 1] - marks[i])
    difficulty = F.when(free <= cuts[0], part(0)).when(free <= cuts[1], part(1)).when(free <= cuts[2], part(2)).otherwise(part(3))
    name = F.when(free.isNull(), None).when(free <= cuts[0], LEVELS[0]).when(free <= cuts[1], LEVELS[1]).when(free <= cuts[2], LEVELS[2]).otherwise(LEVELS[3])
    return out.select("doc_id", "n_words", "lang", F.when(free.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(3.0), difficulty))).alias("difficulty"), name.alias("reading_level"))
