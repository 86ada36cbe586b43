"""Symbols and formulas: what they mean, and which formulas say the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols by domain, and laws by the patterns they are written in.
SYMBOLS = {
    "economics": {"Y": "national_income", "GDP": "national_income", "C": "consumption", "I": "investment", "G": "government_spending", "NX": "net_exports", "X-M": "net_exports"},
    "computer_science": {"O(n)": "asymptotic_upper_bound", "Theta(n)": "asymptotic_tight_bound", "\\Theta(n)": "asymptotic_tight_bound", "BFS": "breadth_first_search", "DFS": "depth_first_search"},
    "kinematics": {"u": "initial_velocity", "v_0": "initial_velocity", "v0": "initial_velocity", "v": "final_velocity", "a": "acceleration", "t": "time", "\\Delta t": "time", "s": "displacement", "d": "displacement", "x": "displacement", "\\Delta x": "displacement"},
    "calculus": {"dy/dx": "derivative", "f'(x)": "derivative", "\\frac{dy}{dx}": "derivative", "\\int": "integral"},
    "mechanics": {"F": "force", "\\Sigma F": "net_force", "F_net": "net_force", "m": "mass", "a": "acceleration"},
}
LAWS = {
    "macro_gdp_expenditure": r"Y\s*=\s*C\s*\+\s*I\s*\+\s*G\s*\+\s*NX|GDP\s*=\s*C\s*\+\s*I\s*\+\s*G\s*\+\s*\(?\s*X\s*-\s*M\s*\)?",
    "merge_sort_recurrence": r"T\(n\)\s*=\s*2\s*T\(n/2\)\s*\+\s*O\(n\)|T\(n\)\s*=\s*2\s*T\(n/2\)\s*\+\s*(?:\\Theta|Theta)\s*\(n\)",
    "kinematics_velocity_time": r"v\s*=\s*u\s*\+\s*a\s*\*?\s*t|v\s*=\s*v_?0\s*\+\s*a\s*\*?\s*(?:\\Delta|Delta)?\s*t",
    "derivative_power_rule": r"d/dx\s*\[?x\^n\]?\s*=\s*n\s*x\^\(n-1\)|\(x\^n\)'\s*=\s*n\s*x\^\(n-1\)",
    "newton_second_law": r"F\s*=\s*m\s*\*?\s*a|F_net\s*=\s*m\s*\*?\s*a",
}
# Weights of a resource's score.
WEIGHTS = {"concept": 0.35, "notation": 0.30, "prerequisite": 0.15, "fit": 0.10, "quality": 0.10}
EQUAL_SHARE = 0.70


def meaning(symbol: Column, domain: str | None = None, glossary: Column | None = None) -> Column:
    """A symbol's meaning: by the document's glossary, by its domain, by any domain in order, else itself in small letters without spaces."""
    raw = F.trim(symbol)
    bare = F.replace(raw, F.lit(" "), F.lit(""))
    tables = ([SYMBOLS[domain]] if domain in SYMBOLS else []) + list(SYMBOLS.values())
    found = [] if glossary is None else [glossary[raw], glossary[bare]]
    for t in tables:
        spaced = t | {k.replace(" ", ""): v for k, v in t.items()}
        m = F.create_map(*[F.lit(x) for kv in spaced.items() for x in kv])
        found += [m[raw], m[bare]]
    return F.coalesce(*found, F.lower(bare))


def variables(formula: Column) -> Column:
    """Sorted distinct identifiers of a formula."""
    bare = F.regexp_replace(F.regexp_replace(formula, r"[0-9+\-*/=()^,;\[\]{}]", " "), r"\\(?:frac|sqrt|sin|cos|tan|log|ln|lim|sum|int|Theta|Delta)", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(bare, r"\s+"), lambda t: t != "")))


def law(formula: Column) -> Column:
    """The first law whose patterns a formula matches, null for none."""
    clean = F.replace(F.replace(F.trim(formula), F.lit("\\,"), F.lit("")), F.lit("\\ "), F.lit(""))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LAWS.items()):
        out = F.when(clean.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def meanings(formula: Column, domain: str | None = None) -> Column:
    return F.array_distinct(F.transform(variables(formula), lambda v: meaning(v, domain)))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def equivalence(a: Column, b: Column, domain: str | None = None) -> Column:
    """1 for the same formula, 0.95 for one law, 0.7 + 0.25 of the share of meanings where that is 0.7 or more, else 0.1."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    ma, mb = meanings(a, domain), meanings(b, domain)
    share = jaccard(ma, mb)
    alike = (F.size(ma) > 0) & (F.size(mb) > 0) & (share >= EQUAL_SHARE)
    return F.when(flat(a) == flat(b), 1.0).when(law(a) == law(b), 0.95).when(alike, F.round(0.70 + 0.25 * share, 2)).otherwise(F.lit(0.10))


def differences(a: Column, b: Column, domain: str | None = None) -> Column:
    """The first two symbols (in order of name) that b writes otherwise than a, as ``b for meaning (a)``."""
    va, vb = variables(a), variables(b)
    each = F.flatten(F.transform(va, lambda x: F.transform(F.filter(vb, lambda y: (meaning(x, domain) == meaning(y, domain)) & (x != y)), lambda y: F.concat(y, F.lit(" for "), F.replace(meaning(x, domain), F.lit("_"), F.lit(" ")), F.lit(" ("), x, F.lit(")")))))
    return F.array_join(F.slice(each, 1, 2), ", ")


def resource_score(concept: Column, notation: Column, prerequisites: Column, mastery: Column, difficulty: Column, confidence: Column, transcript: Column, digits: int | None = 3) -> Column:
    """Weighted score of a resource; ``prerequisites`` is the number it reviews."""
    before = F.when(prerequisites > 0, F.least(F.lit(1.0), 0.5 + 0.25 * prerequisites)).otherwise(F.lit(0.5))
    fit = F.when(mastery < 0.40, F.when(difficulty <= 0.55, 1.0).otherwise(0.60)).when(mastery >= 0.70, F.when(difficulty >= 0.50, 1.0).otherwise(0.70)).otherwise(F.lit(0.80))
    quality = confidence * F.when(transcript, 1.0).otherwise(0.6)
    w = WEIGHTS
    s = w["concept"] * concept + w["notation"] * notation + w["prerequisite"] * before + w["fit"] * fit + w["quality"] * quality
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
    return s if digits is None else F.round(s, digits)
