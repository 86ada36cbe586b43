"""Checks and payloads of records as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import content_words

# How a sentence that describes begins.
DESCRIBES = r"^(a |an |the |is |are |refers to|is defined|is called|means |consists of)"
PLACEHOLDERS = ["...", "string", "todo", "tbd", "n/a", "placeholder"]


def bad_span(block: Column, start: Column, end: Column, excerpt: Column) -> Column:
    """Whether a span leaves its block or its excerpt does not stand there; false for an unknown block."""
    bad = (start < 0) | (end > F.length(block)) | (start > end) | ((excerpt != "") & ~F.contains(block, excerpt))
    return block.isNotNull() & F.coalesce(bad, F.lit(False))


def question_objections(text: Column, kind: Column, options: Column, answer: Column, difficulty: Column) -> Column:
    n = F.coalesce(F.size(options), F.lit(0))
    offered = F.array_contains(options, answer) | F.coalesce(F.ascii(answer) - 65 < n, F.lit(False)) & answer.rlike("^[A-Z]$") | F.coalesce(F.when(answer.rlike(r"^(0|[1-9]\d{0,3})$"), answer.cast("int") < n), F.lit(False))
    mcq = kind == "mcq"
    return F.array_compact(
        F.array(
            F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 5, "short_text"),
            F.when(mcq & (n < 2), "few_options"),
            F.when(mcq & (n >= 2) & (F.size(F.array_distinct(options)) < n), "repeated_options"),
            F.when(mcq & (F.coalesce(answer, F.lit("")) == ""), "no_answer"),
            F.when(mcq & (answer != "") & (n > 0) & ~F.coalesce(offered, F.lit(False)), "answer_not_offered"),
            F.when((kind == "true_false") & ~F.coalesce(F.lower(answer).isin("true", "false", "1", "0", "t", "f"), F.lit(False)), "no_boolean"),
            F.when((difficulty < 0) | (difficulty > 1), "difficulty_range"),
        )
    )


def coverage(evidence: Column, text: Column) -> Column:
    """Share of a text's sentences backed by ``evidence`` records."""
    sentences = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    return F.when(evidence <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), evidence / F.greatest(F.lit(1), F.size(sentences))))


def evidence_prompt(entries: Column, most: int) -> Column:
    """entries array<struct<citation_id, page, t>> in order, labelled [E1] and so on, as many as ``most`` letters hold; the first is cut to it."""
    pieces = F.transform(entries, lambda e, i: F.concat(F.lit("[E"), (i + 1).cast("string"), F.lit("] page "), (F.coalesce(e["page"], F.lit(0)) + 1).cast("string"), F.lit("\n"), e["t"], F.lit("\n")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(a: Column, piece: Column) -> Column:
        room = a["used"] + F.length(piece) <= most
        first = F.size(a["out"]) == 0
        return F.when(a["full"], a).when(room, F.struct(F.array_append(a["out"], piece).alias("out"), (a["used"] + F.length(piece)).alias("used"), F.lit(False).alias("full"))).otherwise(F.struct(F.when(first, F.array(F.left(piece, F.lit(most)))).otherwise(a["out"]).alias("out"), a["used"].alias("used"), F.lit(True).alias("full")))

    return F.array_join(F.aggregate(pieces, start, add)["out"], "\n")


def best_passage(text: Column, query: Column, most: int = 400) -> Column:
    """The window of a text that shares most content words with a query, the first of equals; ``most`` letters."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    flat = F.array_join(words, " ")
    width, wanted = max(1, most // 6), content_words(query)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - width + 1), F.lit(max(1, width // 4)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(width)), " "))
    scored = F.transform(windows, lambda w, i: F.struct(F.size(F.array_intersect(wanted, content_words(w))).alias("n"), (-i).alias("k"), w.alias("w")))
    return F.when(F.length(flat) <= most, flat).when(F.size(wanted) == 0, F.left(flat, F.lit(most))).otherwise(F.left(F.array_max(scored)["w"], F.lit(most)))


def description(excerpts: Column) -> Column:
    """A sentence that defines, else the first excerpt of more than 40 letters, else nothing; 300 letters at most."""
    sentences = F.flatten(F.transform(excerpts, lambda x: F.split(F.replace(x, F.lit("\n"), F.lit(" ")), r"\. ")))
    defining = F.filter(F.transform(sentences, lambda s: F.regexp_replace(F.trim(s), r"\.+$", "")), lambda s: (F.length(s) > 25) & F.lower(s).rlike(DESCRIBES))
    longer = F.filter(F.transform(excerpts, F.trim), lambda s: F.length(s) > 40)
    cut = lambda s: F.when(F.length(s) <= 300, s).otherwise(F.concat(F.left(s, F.lit(299)), F.lit("…")))
    return F.when(F.size(defining) > 0, cut(F.element_at(defining, 1))).when(F.size(longer) > 0, cut(F.element_at(longer, 1))).otherwise(F.lit(""))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def json_object(reply: Column) -> Column:
    """The object in a model's reply: of a fenced block, the whole, or between the outermost braces; a list is wrapped as items; null where nothing parses."""
    fenced = F.transform(F.regexp_extract_all(reply, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1)), _bare)
    outer = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    tried = F.concat(fenced, F.array(_bare(reply), outer))
    good = F.filter(tried, lambda c: (c.startswith("{") & F.json_object_keys(c).isNotNull()) | (c.startswith("[") & F.json_array_length(c).isNotNull()))
    first = F.get(good, 0)
    return F.when(first.startswith("["), F.concat(F.lit('{"items":'), first, F.lit("}"))).otherwise(first)


def template_objections(obj: Column, template: dict[str, str]) -> Column:
    """What an object lacks of a template of names and types (string, number, list): missing, wrong_type, empty, placeholder."""
    out = []
    for name, kind in template.items():
        v = F.get_json_object(obj, f"$.{name}")
        ok = {"number": v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "list": F.json_array_length(v).isNotNull()}.get(kind, F.lit(True))
        why = F.when(v.isNull(), "missing").when(~ok, "wrong_type").when((F.trim(v) == "") | (v == "[]"), "empty").when(F.lower(F.trim(v)).isin(PLACEHOLDERS), "placeholder")
        out.append(F.when(why.isNotNull(), F.concat(F.lit(f"{name}: "), why)))
    return F.array_compact(F.array(*out))
