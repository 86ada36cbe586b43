"""Entity resolution, evidence aggregation and quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.learning import noisy_or
from quillspark.functions.text import content_words, entity_key, fingerprint, fold_plural


def clusters(mentions: DataFrame) -> DataFrame:
    """mentions (surface, n) -> per entity key with plurals folded: canonical surface (most mentions, ties by name), surfaces, mentions."""
    m = mentions.filter("surface IS NOT NULL").withColumn("entity_key", fold_plural(entity_key(F.col("surface")))).filter("entity_key != ''")
    s = m.groupBy("entity_key", "surface").agg(F.sum("n").alias("n"))
    return s.groupBy("entity_key").agg(F.min_by("surface", F.struct(-F.col("n"), F.col("surface"))).alias("canonical"), F.count("*").alias("surfaces"), F.sum("n").alias("mentions"))


def edges_merged(links: DataFrame) -> DataFrame:
    """Links of one (tree, source, target) as one: noisy-or of their confidences, distinct evidence, repeats."""
    conf = F.array_sort(F.collect_list(F.coalesce("confidence", F.lit(0.0))))
    g = links.groupBy("tree", "source", "target").agg(conf.alias("c"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("evidence_ids", F.array().cast("array<string>")))))).alias("e"), F.count("*").alias("repeats"))
    return g.select("tree", "source", "target", F.round(noisy_or(F.col("c")), 6).alias("confidence"), F.size("e").cast("long").alias("evidence"), "repeats")


def first_by_fingerprint(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per fingerprint of letters and digits: the least key, and how many keys share it."""
    return df.groupBy(fingerprint(F.coalesce(F.col(text), F.lit(""))).alias("fingerprint")).agg(F.min(key).alias("kept"), F.count_distinct(key).alias("copies"))


def completeness(concepts: DataFrame) -> DataFrame:
    """One row: concepts, active ones, with a description, with an alias, share with a description in percent."""
    described = F.length(F.trim(F.coalesce("description", F.lit("")))) > 0
    n = F.count("*")
    return concepts.agg(n.alias("concepts"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(described).alias("described"), F.count_if(F.size(F.coalesce("aliases", F.array().cast("array<string>"))) > 0).alias("aliased"), F.round(100.0 * F.count_if(described) / F.greatest(n, F.lit(1)), 2).alias("described_pct"))


def ngram_counts(tokens: DataFrame, stop: list[str], longest: int = 3) -> DataFrame:
    """tokens (id, tokens) -> (n, gram, occurrences, documents); grams of two and more may not begin or end with a stop word.

    Documents are placed by id once, so that their grams are counted where they are, and only distinct ones of a
    document reach the one shuffle by gram.
    """
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size("tokens") >= n, F.transform(F.sequence(F.lit(1), F.size("tokens") - n + 1), lambda i: F.slice("tokens", i, n))).otherwise(F.array().cast("array<array<string>>"))))
    rows = tokens.repartition("id").select("id", F.explode(grams).alias("g")).filter((F.size("g") == 1) | (~F.element_at("g", 1).isin(stop) & ~F.element_at("g", -1).isin(stop)))
    per = rows.groupBy("id", F.size("g").alias("n"), F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("k"))
    return per.groupBy("n", "gram").agg(F.sum("k").alias("occurrences"), F.count("*").alias("documents"))


def question_checks(questions: DataFrame, concepts: DataFrame, citations: DataFrame) -> DataFrame:
    """Per question: what its checks object to (comma-joined), from structure, options, concepts and cited words.

    A repeated export counts with its largest exposure_count.
    """
    q = questions.groupBy("question_id").agg(F.max_by(F.struct("question_type", "question_text", "options", "correct_answer", "concept_ids"), F.struct("exposure_count", "created_at")).alias("q")).select("question_id", "q.*")
    known = concepts.filter(F.coalesce("status", F.lit("")) != "rejected").select("concept_id").distinct()
    bad = q.select("question_id", F.explode("concept_ids").alias("concept_id")).join(known, "concept_id", "left_anti").select("question_id").distinct().withColumn("unknown", F.lit(True))
    cited = citations.filter(F.length(F.trim(F.coalesce("quote", F.lit("")))) > 0).select("question_id").distinct().withColumn("cited", F.lit(True))
    x = q.join(bad, "question_id", "left").join(cited, "question_id", "left")
    opts = F.coalesce("options", F.array().cast("array<string>"))
    mcq = F.col("question_type") == "mcq"
    reasons = F.array_compact(F.array(
        F.when(F.size(content_words(F.coalesce("question_text", F.lit("")))) < 3, "short_text"),
        F.when(mcq & (F.size(opts) < 2), "few_options"),
        F.when(mcq & (F.size(F.array_distinct(opts)) < F.size(opts)), "repeated_options"),
        F.when(mcq & ~F.coalesce(F.array_contains(opts, F.col("correct_answer")), F.lit(False)), "answer_not_an_option"),
        F.when(F.size(F.coalesce("concept_ids", F.array().cast("array<string>"))) == 0, "no_concept"),
        F.when(F.col("unknown"), "unknown_concept"),
        F.when(F.col("cited").isNull(), "no_citation"),
    ))
    return x.select("question_id", F.array_join(reasons, ",").alias("objections"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order, nulls first; a keyed upsert of append-only data, combined before the shuffle.

    Of rows equal in the order any one is kept.
    """
    rank = F.struct(*[x for o in order for x in (F.col(o).isNotNull(), F.col(o))])
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__r")).select(*[F.col(c) if c in keys else F.col(f"__r.`{c}`").alias(c) for c in df.columns])
