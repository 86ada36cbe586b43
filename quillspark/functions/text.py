"""Text functions as Column builders; all of them stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no signal in search.
STOP_TOKENS = """
a an the and or but if then than that this these those of in on at to for from by with is are was were be been being
as it its it's their there here they them we our you your he she his her i me my not no nor so such can could may might
must shall should will would do does did done have has had having what which who whom whose when where why how also very
much many more most some any each other another into over under about after before between during through against above
below up down out off again further once because while both few only own same too s t just don now
""".split()


def _decomposed() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks that are a base letter with marks, and their base letters, by Unicode's own decomposition."""
    marked = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for r in ((0xC0, 0x250), (0x386, 0x500), (0x1E00, 0x2000)) for c in range(*r)]
    pairs = [(c, d[0]) for c, d in marked if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def _compatible() -> tuple[str, str]:
    """Characters that stand for one other by Unicode's compatibility: full width, superscripts, odd spaces."""
    pairs = [(chr(c), d) for r in ((0xA0, 0x100), (0x2000, 0x2100), (0x3000, 0x3001), (0xFF01, 0xFFEF)) for c in range(*r) if len(d := unicodedata.normalize("NFKC", chr(c))) == 1 and d != chr(c)]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, BARE = _decomposed()
COMPATIBLE, PLAIN = _compatible()
# Ligatures.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Phrases that negate or hedge a requirement.
HEDGES = ["do not need", "does not require", "not necessary", "no prior knowledge", "optional", "not a prerequisite", "without requiring", "not needed", "might require", "could depend"]
# Marks of a reference line.
CITATION_MARKS = [" et al.", " et al,", "&", "doi:", "isbn", "arxiv", "sigmod", "neurips", "tpami", "vldb", "www.", "http://", "https://", "journal of", "proceedings of", "pp.", "vol.", "editors"]
# Roman numerals and number words of entity names.
NUMERALS = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10", "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5"}


def strip_accents(text: Column) -> Column:
    """Letters without their marks, composed or decomposed; ligatures as their letters."""
    return F.translate(F.regexp_replace(fold_ligatures(text), r"[\u0300-\u036F]", ""), ACCENTED, BARE)


def singular(token: Column) -> Column:
    """Plural folding of search tokens: longer than 4 letters, regular endings only."""
    n = F.length(token)
    two = F.lit(False)
    for end in ("ses", "xes", "zes", "ches", "shes"):
        two = two | token.endswith(end)
    return (
        F.when(n <= 4, token)
        .when(two, F.left(token, n - 2))
        .when(token.endswith("ies") & (n > 5), F.concat(F.left(token, n - 3), F.lit("y")))
        .when(token.endswith("s") & ~token.endswith("ss"), F.left(token, n - 1))
        .otherwise(token)
    )


def search_tokens(text: Column) -> Column:
    """Lower-case tokens of letters, digits and underscores without accents and stop words, plurals folded."""
    raw = F.regexp_extract_all(F.lower(strip_accents(F.coalesce(text, F.lit("")))), F.lit(r"[a-z0-9_]+"), F.lit(0))
    kept = F.filter(raw, lambda t: ~t.isin(STOP_TOKENS))
    return F.transform(kept, singular)


def matching_key(text: Column) -> Column:
    """Lower-case text without punctuation, spaces squeezed; compatible characters count as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.translate(fold_ligatures(text), COMPATIBLE, PLAIN)), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def entity_key(text: Column) -> Column:
    """Key of an entity's name: no possessive, no punctuation, numerals as digits."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"['’]s\b", "")
    words = F.filter(F.split(F.regexp_replace(bare, r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(table[w], w)), " ")


def fold_plural(key: Column) -> Column:
    """Fold the last word of an entity key; us, is, ss and short words stay."""
    tail = F.regexp_extract(key, r"(\S+)$", 1)
    head = F.left(key, F.length(key) - F.length(tail))
    n = F.length(tail)
    odd = tail.endswith("us") | tail.endswith("is") | tail.endswith("ss")
    es = tail.endswith("es") & F.substring(tail, -3, 1).isin("s", "x", "z") | tail.endswith("ches") | tail.endswith("shes")
    one = (
        F.when(tail.endswith("ies") & (n > 5), F.concat(F.left(tail, n - 3), F.lit("y")))
        .when(es, F.left(tail, n - 2))
        .when(tail.endswith("s"), F.left(tail, n - 1))
        .otherwise(tail)
    )
    return F.when((n <= 4) | odd | ~tail.rlike(r"^\p{L}+$"), key).otherwise(F.concat(head, one))


def fold_ligatures(text: Column) -> Column:
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def rejoin_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, r"\b([a-zA-Z]{2,})-\n([a-zA-Z]{2,})\b", "$1$2")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(word_count(text) * F.lit(1.3))).cast("int")


def shorten(text: Column, limit: int = 320) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.left(flat, F.lit(limit - 1))), F.lit("…")))


def script(text: Column) -> Column:
    """Devanagari, Latin, both or neither."""
    d, latin = text.rlike(r"[ऀ-ॿ]"), text.rlike(r"[A-Za-z]")
    return F.when(d & latin, "mixed").when(d, "hi").when(latin, "en").otherwise("unknown")


def stable_id(raw: Column, prefix: str, length: int = 12) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(raw, 256), 1, length))


def fingerprint(text: Column) -> Column:
    """sha256 of the letters and digits in small letters."""
    return F.sha2(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", ""), 256)


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 3))


def slug(name: Column) -> Column:
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_-]+", "_"), r"^_+|_+$", ""))


def anonymous_number(text: Column) -> Column:
    """A label number of a name: sum of its letters' codes, within 100..999."""
    return (F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: a + F.ascii(c)) % 900 + 100).cast("int")


def citation_stems(text: Column) -> Column:
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{3,}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.filter(w, lambda x: ~x.isin(STOP_TOKENS)), lambda x: F.left(x, F.lit(5)))))


def garbage_ratio(text: Column) -> Column:
    bad = F.regexp_count(text, F.lit(r"[�-\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return F.when(F.length(text) > 0, bad / F.length(text)).otherwise(F.lit(0.0))


def is_hedged(text: Column) -> Column:
    out = F.lit(False)
    for h in HEDGES:
        out = out | F.contains(F.lower(text), F.lit(h))
    return out


def text_role(text: Column) -> Column:
    """Role by the first rule that holds."""
    t = F.lower(F.trim(text))
    has = lambda s: F.contains(t, F.lit(s))
    return (
        F.when(t.startswith("definition") | has("is defined as") | has("refers to"), "definition")
        .when(t.startswith("example") | has("for example"), "example")
        .when(t.startswith("theorem"), "theorem")
        .when(has("exercise") | t.startswith("q") | has("question"), "exercise")
        .when(has("objective") | has("able to"), "learning_objective")
        .when(has("prerequisite") | has("before studying"), "prerequisite_statement")
        .otherwise("explanation")
    )


def structure_tag(text: Column) -> Column:
    """Structural tag of a block by the first pattern that holds; null for none. Fixed patterns."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"(\.{3,}|…)\s*\d+\s*$") | t.rlike(r"(?i)^(contents|table of contents)$"), "toc")
        .when(t.rlike(r"^[A-Z][a-zA-Z0-9\s\-]{2,30}\s*[:\-—]\s+[A-Z]") & (F.length(t) < 250), "glossary_entry")
        .when(t.rlike(r"^(\[\d+\]|\d+\.)\s+[A-Z][a-z]+,") | t.rlike(r"(?i)^(references|bibliography)$"), "bibliography")
        .when(t.rlike(r"(?i)^(example|worked example)\s+\d+(\.\d+)*"), "worked_example")
        .when(t.rlike(r"(?i)^(exercise|problem|practice question)\s+\d+(\.\d+)*"), "exercise")
        .when(t.rlike(r"(?i)^(note|remember|key point|tip|warning):\s+"), "sidebar")
    )


def keywords(text: Column) -> Column:
    """Words of over 3 letters that have a capital or over 6 letters, in order, once each."""
    w = F.transform(F.split(F.trim(text), r"\s+"), lambda x: F.regexp_replace(x, r"^[.,!?:;()\[\]{}]+|[.,!?:;()\[\]{}]+$", ""))
    return F.array_distinct(F.filter(w, lambda x: (F.length(x) > 3) & (x.rlike(r"^\p{Lu}") | (F.length(x) > 6))))


def is_ocr_garbage(term: Column) -> Column:
    return F.exists(F.filter(F.split(term, r"\s+"), lambda w: w != ""), lambda w: w.rlike(r"\d") | (F.regexp_count(w, F.lit(r"\p{L}")) >= 4) & ~w.rlike(r"(?i)[aeiouy]"))


def is_title_block(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) > 0) & (F.length(t) <= 200) & (word_count(t) <= 14) & ~t.rlike(r"[.;,]$")


def is_markdown_table(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(x)), lambda x: x != "")
    piped = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|"))))
    return (piped >= 2) & (F.exists(lines, lambda x: x.rlike(r"^\|[\s\-:|]+\|$")) | (piped >= 0.6 * F.size(lines)))


def is_bibliography(text: Column) -> Column:
    t = F.lower(text)
    marks = F.lit(False)
    for m in CITATION_MARKS:
        marks = marks | F.contains(t, F.lit(m))
    return t.rlike(r"\(\s*(19|20)\d{2}\s*\)") & (marks | t.rlike(r"\b[a-z]+,\s+[a-z]\.\s*[a-z]?\.?"))


def is_grounded(excerpt: Column, block: Column, start: Column, end: Column) -> Column:
    """The span lies in the block and the excerpt is in the block or is the span."""
    inside = (start >= 0) & (end <= F.length(block)) & (start <= end)
    return inside & ((F.length(excerpt) == 0) | F.contains(block, excerpt) | (F.substr(block, start + 1, end - start) == excerpt))


def markdown_table(matrix: Column) -> Column:
    """array<array<string>> -> a markdown table: header, rule, rows."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(matrix[0], lambda c: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(matrix, 2, F.greatest(F.lit(0), F.size(matrix) - 1)), row)
    return F.when(F.size(matrix) > 0, F.array_join(F.concat(F.array(row(matrix[0]), rule), body), "\n"))


def options_clean(options: Column) -> Column:
    return F.filter(F.transform(options, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def unit_interval(raw: Column, default: float = 0.5) -> Column:
    v = raw.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


# ---------------------------------------------------------------- blocks of pages

_EDGES = r"^[ \t\r\n]+|[ \t\r\n]+$"
# Orders to a model hidden in documents.
INJECTIONS = r"ignore\s+(all\s+)?previous\s+instructions|disregard\s+(all\s+)?prior\s+prompts|system\s+prompt:|you\s+are\s+now\s+an?\s+AI|override\s+system\s+rules|developer\s+mode\s+enabled"
# Symbols with a name in LaTeX.
LATEX = {"√": "\\sqrt", "∫": "\\int", "∑": "\\sum", "α": "\\alpha", "β": "\\beta", "θ": "\\theta", "π": "\\pi", "λ": "\\lambda", "Δ": "\\Delta"}
DOMAINS = ["physics", "calculus", "biology", "chemistry", "finance", "economics", "computer science"]


def block_type(text: Column, size: Column, font: Column, body: Column) -> tuple[Column, Column]:
    """(type, role) of a block by its mark, font, size against the body's, weight and number."""
    s, f = F.regexp_replace(text, _EDGES, ""), F.lower(font)
    ratio, bold = size / F.greatest(body, F.lit(1.0)), f.rlike("bold|black")
    item, code = s.rlike(r"^(\d+[.)]|[a-zA-Z][.)]|[•◦–—*-])\s+"), f.rlike("mono|courier|code")
    heading = (ratio >= 1.15) | bold | (s.rlike(r"^\d+(\.\d+)*\s+[A-Z]") & (F.length(s) < 100))
    level = F.when((ratio >= 1.6) | ((ratio >= 1.3) & bold), "heading_l1").when((ratio >= 1.25) | bold, "heading_l2").otherwise("heading_l3")
    return F.when(item, "list_item").when(code, "code").when(heading, "heading").otherwise("paragraph"), F.when(item | code, None).when(heading, level).otherwise("body")


def structure_role(text: Column, y0: Column, page_height: Column) -> Column:
    """Role of a block in a textbook, null for plain text; the first rule that holds counts."""
    s = F.regexp_replace(text, _EDGES, "")
    return (
        F.when(s == "", None)
        .when((y0 >= 0.85 * page_height) & s.rlike(r"^([*\d†‡§]+|\(\d+\))\s+[A-Z]"), "footnote")
        .when(s.rlike(r"(\.{3,}|…)\s*\d+\s*$") | s.rlike(r"(?i)^(Contents|Table of Contents)$"), "toc")
        .when(s.rlike(r"^[A-Z][a-zA-Z0-9\s-]{2,30}\s*[:—-]\s+[A-Z]") & (F.length(s) < 250), "glossary_entry")
        .when(s.rlike(r"^(\[\d+\]|\d+\.)\s+[A-Z][a-z]+,") | s.rlike(r"(?i)^(References|Bibliography)$"), "bibliography")
        .when(s.rlike(r"(?i)^(Example|Worked Example)\s+\d+"), "worked_example")
        .when(s.rlike(r"(?i)^(Exercise|Problem|Practice Question)\s+\d+"), "exercise")
        .when(s.rlike(r"(?i)^(Note|Remember|Key Point|Tip|Warning):\s+"), "sidebar")
    )


def is_math_block(text: Column, font: Column) -> Column:
    s = F.regexp_replace(text, _EDGES, "")
    symbols = F.regexp_count(s, F.lit(r"[∀-⋿⨀-⫿℀-⅏Ͱ-Ͽ=+\-*/^√]"))
    return (s != "") & (F.lower(font).rlike("math|cmex|cmsy|symbol") | (symbols / F.length(s) >= 0.25) | s.rlike(r"^(\([0-9]+(\.[0-9]+)*\)|Eq\.\s*[0-9]+)$"))


def as_latex(text: Column) -> Column:
    """Symbols by name between dollar signs; null where a text is longer than 150 letters or three lines."""
    s = F.regexp_replace(text, _EDGES, "")
    out = s
    for symbol, name in LATEX.items():
        out = F.replace(out, F.lit(symbol), F.lit(name))
    return F.when((F.length(s) <= 150) & (F.regexp_count(s, F.lit("\n")) < 3), F.concat(F.lit("$$"), out, F.lit("$$")))


def block_warnings(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, white: Column) -> Column:
    s = F.regexp_replace(text, _EDGES, "")
    hidden = (s != "") & ((x1 < 0) | (x0 > width) | (y1 < 0) | (y0 > height) | white)
    return F.array_compact(F.array(F.when(hidden, "HIDDEN_TEXT_DETECTED"), F.when(s.rlike(f"(?i){INJECTIONS}"), "POSSIBLE_PROMPT_INJECTION")))


def role_weight(role: Column) -> Column:
    """Weight of a block's text in extraction; 0 leaves it out."""
    return F.when(role.isin("page_number", "header", "footer", "watermark", "bibliography", "boilerplate"), 0.0).when(role == "glossary", 1.5).when(role.isin("toc_entry", "index_entry"), 0.1).otherwise(1.0)


def title_profile(title: Column) -> tuple[Column, Column]:
    """(genre, domain) by words of the title; the first that occurs counts, a null title is a textbook's."""
    low = F.lower(title)
    genre = F.when(low.rlike("exam|paper|test"), "question_paper").when(low.rlike("slide|lecture"), "slides").when(low.rlike("worksheet|exercise"), "worksheet").otherwise("textbook")
    domain = F.lit(None).cast("string")
    for d in reversed(DOMAINS):
        domain = F.when(F.contains(low, F.lit(d)), d).otherwise(domain)
    return genre, domain


def vision_need(chars: Column, garbage: Column, ink: Column, cover: Column, paths: Column, garbled: float = 0.15) -> tuple[Column, Column]:
    """(reason, complexity) of a page that has to be seen: a diagram, a garbled text layer, a figure; null and 0 for others."""
    diagram = (paths > 35) & (cover >= 0.15)
    broken = (garbage >= garbled) & (chars >= 50)
    figure = (cover >= 0.40) & (chars < 100) & (ink > 0.05)
    one = F.lit(1.0)
    score = F.when(diagram, F.least(one, 0.4 + paths / 100.0 * 0.3 + cover * 0.3)).when(broken, F.least(one, 0.6 + garbage * 0.4)).when(figure, F.least(one, 0.5 + cover * 0.5)).otherwise(0.0)
    return F.when(diagram, "diagram").when(broken, "garbled").when(figure, "figure"), score
