"""Numeric functions of knowledge tracing, item selection and grading, as Column builders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of knowledge tracing.
P_INIT, P_TRANSIT, P_SLIP, P_GUESS = 0.30, 0.05, 0.05, 0.33
MASTERY_FLOOR, MASTERY_CEILING = 0.01, 0.99


def bkt_step(p: Column, correct: Column, transit: float = P_TRANSIT, slip: float = P_SLIP, guess: float = P_GUESS) -> Column:
    """One Bayesian update and transition, kept within the floor and the ceiling."""
    known = F.when(correct, 1.0 - slip).otherwise(slip)
    unknown = F.when(correct, guess).otherwise(1.0 - guess)
    seen = p * known + (1.0 - p) * unknown
    post = F.when(seen > 0, p * known / seen).otherwise(p)
    return F.greatest(F.lit(MASTERY_FLOOR), F.least(F.lit(MASTERY_CEILING), post + (1.0 - post) * transit))


def uncertainty(n: Column, correct: Column, mastery: Column) -> Column:
    """From the number and share of correct ones among recent answers, and the mastery reached."""
    share = correct / n
    volatility = 1.0 - 2.0 * F.abs(0.5 - share)
    weight = 1.0 / (1.0 + 0.35 * n)
    u = 0.45 * weight + 0.35 * volatility * (1.0 - 0.5 * (1.0 - weight)) + 0.20 * 4.0 * mastery * (1.0 - mastery)
    return F.when(n > 0, F.greatest(F.lit(0.01), F.least(F.lit(0.99), u))).otherwise(F.lit(0.85))


def diagnostic_confidence(n: Column, correct: Column) -> Column:
    c = 0.3 + 0.65 * (F.abs(correct / n - 0.5) * 2.0) * F.least(F.lit(1.0), n / 5.0)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(F.lit(0.5))


def plog2p(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def binary_entropy(p: Column) -> Column:
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1.0 - 1e-7), p))
    return -(q * F.log2(q) + (1.0 - q) * F.log2(1.0 - q))


def information_gain(p: Column, discrimination: Column, guess: float = 0.25, slip: float = 0.10) -> Column:
    """Expected fall of the entropy of one concept's mastery by an answer; discrimination sharpens guess and slip."""
    d = F.greatest(F.lit(0.1), F.least(F.lit(2.0), discrimination))
    s = F.greatest(F.lit(0.02), F.least(F.lit(0.40), F.lit(slip) / d))
    g = F.greatest(F.lit(0.05), F.least(F.lit(0.45), F.lit(guess) / d))
    right = p * (1.0 - s) + (1.0 - p) * g
    p_right = F.when(right > 0, p * (1.0 - s) / right).otherwise(p)
    p_wrong = F.when(right < 1, p * s / (1.0 - right)).otherwise(p)
    return F.greatest(F.lit(0.0), binary_entropy(p) - right * binary_entropy(p_right) - (1.0 - right) * binary_entropy(p_wrong))


def information_gains(p: np.ndarray, discrimination: np.ndarray, guess: float = 0.25, slip: float = 0.10) -> np.ndarray:
    """``information_gain`` of arrays, for what is worked out within a task."""

    def entropy(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 1e-7, 1.0 - 1e-7)
        return -(x * np.log2(x) + (1.0 - x) * np.log2(1.0 - x))

    d = np.clip(discrimination, 0.1, 2.0)
    s, g = np.clip(slip / d, 0.02, 0.40), np.clip(guess / d, 0.05, 0.45)
    right = p * (1.0 - s) + (1.0 - p) * g  # guess and slip keep it off 0 and 1
    return np.maximum(0.0, entropy(p) - right * entropy(p * (1.0 - s) / right) - (1.0 - right) * entropy(p * s / (1.0 - right)))


def item_score(gain: Column, unsure: Column, exposure: Column) -> Column:
    return 0.5 * gain + 0.3 * unsure + 0.2 / (1.0 + exposure)


def gap_priority(mastery: Column, unsure: Column, weak: Column, downstream: Column) -> Column:
    s = 0.35 * (1.0 - mastery) + 0.20 * unsure + F.when(weak, 0.25).otherwise(0.0) + 0.15 * F.least(F.lit(1.0), downstream / 5.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def grade(kind: Column, response: Column, expected: Column, tolerance: float = 0.02) -> Column:
    """Score 0..1: exact choice, true/false words, numbers within the tolerance, share of expected words."""
    r, e = F.lower(F.trim(response)), F.lower(F.trim(expected))
    yes = ["true", "t", "yes", "1"]
    no = ["false", "f", "no", "0"]
    rn, en = F.regexp_extract(r, r"^[+-]?\d+(\.\d+)?", 0).try_cast("double"), F.regexp_extract(e, r"^[+-]?\d+(\.\d+)?", 0).try_cast("double")
    near = F.when(en == 0, F.abs(rn) <= 1e-5).otherwise(F.abs(rn - en) <= tolerance * F.abs(en))
    w = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    share = F.when(F.size(w(e)) > 0, F.size(F.array_intersect(w(r), w(e))) / F.size(w(e))).otherwise(F.lit(0.0))
    score = (
        F.when(kind == "mcq", (r == e).cast("double"))
        .when(kind == "true_false", ((r.isin(yes) & e.isin(yes)) | (r.isin(no) & e.isin(no))).cast("double"))
        .when(kind == "numerical", near.cast("double"))
        .otherwise(F.round(share, 2))
    )
    return F.when(response.isNull() | expected.isNull(), F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0)))


def noisy_or(confidences: Column, cap: float = 0.99) -> Column:
    """1 - prod(1 - c) of an array, at most the cap; 0 for none."""
    return F.least(F.lit(cap), 1.0 - F.aggregate(confidences, F.lit(1.0), lambda a, x: a * (1.0 - x)))
