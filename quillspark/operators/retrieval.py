"""Ranked retrieval of many queries over all chunks: BM25, sub-linear TF-IDF cosine, graph neighbours, rank fusion.

Postings of query terms only are joined, partial sums run before the shuffle, and row_number limits become group
limits ahead of the exchange, so a query that matches everything still ships k rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import search_tokens
from quillspark.session import stored, unsent

K1, B = 1.5, 0.75
RRF_K, WEIGHTS = 60, {"lexical": 1.0, "vector": 0.8, "graph": 0.7}


def tokenised(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """(id, tokens); ids keep their type."""
    return df.select(key.alias("id"), search_tokens(text).alias("tokens"))


def _postings(chunks: DataFrame) -> DataFrame:
    """(id, len, term, tf); chunks are placed by id once, so that their terms are counted where they are."""
    rows = chunks.repartition("id").select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return rows.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


class Index:
    """Postings, document frequencies and totals of (id, tokens) chunks, made once for all channels.

    A term that every chunk has meets its frequency in SALTS parts, by id.
    """

    SALTS = 16

    def __init__(self, chunks: DataFrame) -> None:
        self.chunks = chunks
        self.n_docs, self.avg_len = chunks.agg(F.count("*"), F.avg(F.size("tokens"))).first()
        self.postings = stored(_postings(chunks).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(self.SALTS)).cast("int")))
        self.df = stored(self.postings.groupBy("term").agg(F.count("*").alias("df")))
        self._norms: DataFrame | None = None

    def salted(self, df: DataFrame) -> DataFrame:
        return unsent(df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(self.SALTS - 1)))))

    def norms(self) -> DataFrame:
        """(id, norm) of the weights of all a chunk's terms."""
        if self._norms is None:
            w = _weight(F.col("tf"), F.log(1.0 + F.lit(float(self.n_docs)) / F.col("df")))
            self._norms = stored(self.postings.join(self.salted(self.df), ["term", "salt"]).groupBy("id").agg(F.sqrt(F.sum(w * w)).alias("norm")))
        return self._norms


def _weight(tf: Column, idf: Column) -> Column:
    return (1.0 + F.log(tf)) * idf


def top(scored: DataFrame, k: int) -> DataFrame:
    """(query, id, score) -> the k best a query with their rank; ties go to the larger id."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").desc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(chunks: DataFrame | Index, queries: DataFrame, k: int = 8, half_match: bool = True) -> DataFrame:
    """(query, id, score, rank): BM25 over distinct query terms, divided by their number; half of them must match unless told not to.

    Defined cases: null texts have no tokens and match nothing; a query without tokens has no result; empty tables
    give no row.
    """
    x = chunks if isinstance(chunks, Index) else Index(chunks)
    terms = queries.select(F.col("id").alias("query"), F.explode(F.array_distinct("tokens")).alias("term"), F.size(F.array_distinct("tokens")).alias("nq"))
    hits = x.postings.join(x.salted(x.df.join(terms, "term")), ["term", "salt"])
    idf = F.log(1 + (F.lit(x.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.greatest(F.col("len"), F.lit(1)) / F.lit(x.avg_len or 1.0))
    scored = hits.groupBy("query", "id", "nq").agg(F.count("*").alias("matched"), F.sum(idf * (F.col("tf") * (K1 + 1)) / norm).alias("s"))
    if half_match:
        scored = scored.filter(F.col("matched") >= F.greatest(F.lit(1), F.floor(F.col("nq") / 2)))
    return top(scored.select("query", "id", F.round(F.col("s") / F.col("nq"), 9).alias("score")), k)


def cosine(chunks: DataFrame | Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query, id, score, rank): cosine of (1 + ln tf) * ln(1 + N/df) weights; a term no chunk has counts as df 1."""
    x = chunks if isinstance(chunks, Index) else Index(chunks)
    n = F.lit(float(x.n_docs))
    q = _postings(queries).join(unsent(x.df), "term", "left").withColumn("idf", F.log(1.0 + n / F.coalesce("df", F.lit(1)))).withColumn("qw", _weight(F.col("tf"), F.col("idf")))
    q_norms = q.groupBy(F.col("id").alias("query")).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    wanted = x.salted(q.filter("df IS NOT NULL").select(F.col("id").alias("query"), "term", "qw", "idf"))
    dots = x.postings.select("id", "term", "salt", "tf").join(wanted, ["term", "salt"]).groupBy("query", "id").agg(F.sum(_weight(F.col("tf"), F.col("idf")) * F.col("qw")).alias("dot"))
    scored = dots.join(unsent(x.norms()), "id").join(q_norms, "query").select("query", "id", F.round(F.col("dot") / (F.col("norm") * F.col("q_norm")), 9).alias("score"))
    return top(scored, k)


def _naming(tokens: DataFrame, concepts: DataFrame) -> DataFrame:
    """(t, concept_id) where a token is a part of a name or a name of it; those shorter than three letters meet on themselves."""
    names = concepts.select("concept_id", F.lower("name").alias("name")).filter("length(name) > 0")
    words = tokens.filter("length(t) > 0")
    cut = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda i: F.substr(c, i, F.lit(n))))
    parts = lambda c: F.array_union(F.array_union(cut(c, 1), cut(c, 2)), cut(c, 3))
    a = words.select("t", F.left("t", F.lit(3)).alias("g")).join(names.select("concept_id", "name", F.explode(parts(F.col("name"))).alias("g")), "g").filter(F.contains("name", F.col("t")))
    b = names.select("concept_id", "name", F.left("name", F.lit(3)).alias("g")).join(words.select("t", F.explode(parts(F.col("t"))).alias("g")), "g").filter(F.contains("t", F.col("name")))
    return a.select("t", "concept_id").unionByName(b.select("t", "concept_id")).distinct()


def graph_channel(queries: DataFrame, concepts: DataFrame, edges: DataFrame, chunk_concepts: DataFrame) -> DataFrame:
    """(query, id, score): 1.0 for chunks of concepts a query token names, 0.6 one link away, 0.3 two links away.

    concepts (concept_id, name); edges (u, v), walked both ways; chunk_concepts (id, concept_id). A token names a
    concept if one is part of the other's letters; names and tokens meet on parts of three letters, not pairwise.
    """
    tokens = queries.select(F.col("id").alias("query"), F.explode(F.array_distinct("tokens")).alias("t"))
    seeds = tokens.join(_naming(tokens.select("t").distinct(), concepts), "t").select("query", F.col("concept_id").alias("seed")).distinct()
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    one = seeds.join(both, F.col("seed") == F.col("u")).select("query", "seed", F.col("v").alias("c")).distinct()
    two = one.join(both, F.col("c") == F.col("u")).filter("v != seed").select("query", F.col("v").alias("c")).distinct()
    reached = seeds.select("query", F.col("seed").alias("c"), F.lit(1.0).alias("s")).unionByName(one.select("query", "c", F.lit(0.6).alias("s"))).unionByName(two.select("query", "c", F.lit(0.3).alias("s")))
    reached = reached.groupBy("query", "c").agg(F.max("s").alias("s"))
    return reached.join(chunk_concepts.withColumnRenamed("concept_id", "c"), "c").groupBy("query", "id").agg(F.max("s").alias("score"))


def fuse(channels: dict[str, DataFrame], k: int = 8, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Reciprocal rank fusion of (query, id, rank) channels."""
    parts = [c.select("query", "id", (F.lit(weights[name]) / (RRF_K + F.col("rank"))).alias("s")) for name, c in channels.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return top(union.groupBy("query", "id").agg(F.round(F.sum("s"), 9).alias("score")), k)
