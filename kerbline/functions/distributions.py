"""Expressions over class distributions, given as arrays of probabilities in class order."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

LN3 = math.log(3)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def entropy(p: Column, eps: float = 1e-12) -> Column:
    """-sum p ln(p + eps), in nats; eps is added, not clipped to."""
    return -_sum(F.transform(p, lambda x: x * F.ln(x + F.lit(eps))))


def normalised_entropy(p: Column, eps: float = 1e-12, classes: int | None = 3) -> Column:
    """-sum q ln q over ln n with q = max(p, eps); n is ``classes``, or each array's size when None."""
    n = F.size(p) if classes is None else F.lit(classes)
    return -_sum(F.transform(p, lambda x: F.greatest(x, F.lit(eps)) * F.ln(F.greatest(x, F.lit(eps))))) / F.ln(n)


def renormalised_entropy(p: Column, eps: float = 1e-9) -> Column:
    """Normalised entropy after eps is added to every class and the sum brought back to one."""
    q = F.transform(p, lambda x: x + F.lit(eps))
    total = _sum(q)
    return -_sum(F.transform(q, lambda x: x / total * F.ln(x / total))) / F.ln(F.size(p))


def margin(p: Column) -> Column:
    """Largest minus second largest."""
    ordered = F.sort_array(p, asc=False)
    return ordered[0] - ordered[1]


def argmax(p: Column) -> Column:
    """Index of the maximum, from 0; the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def is_uncertain(h: Column, gap: Column, votes: Column, max_entropy: float = 1.0, min_margin: float = 0.1, min_votes: int = 3) -> Column:
    """Strictly too much entropy, too little margin, or too few votes."""
    return (h > max_entropy) | (gap < min_margin) | (votes < min_votes)


def sample_weight(h: Column, mode: str = "inv_entropy") -> Column:
    """1 - min(max(h / ln 3, 0), 1) by inverse entropy; 1 in any other mode."""
    return 1 - F.least(F.greatest(h / F.lit(LN3), F.lit(0.0)), F.lit(1.0)) if mode == "inv_entropy" else F.lit(1.0)


def confidence(h: Column) -> Column:
    return F.when(h < 0.5, "high").when(h < 0.9, "medium").otherwise("low")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Stable softmax of logits / temperature."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    # a value that a lambda uses for each element is bound by a lambda of its own, or it is computed again for each
    shares = lambda e: bound(_sum(e), lambda total: F.transform(e, lambda x: x / total))
    raised = lambda z: bound(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp((x - top) / t)))
    return bound(bound(logits, raised), shares)


def one_hot(index: Column, n: int = 3) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def squared_error(p: Column, y: Column) -> Column:
    """sum over classes of (p - y)^2: one row's Brier term."""
    return _sum(F.zip_with(p, y, lambda a, b: (a - b) * (a - b)))


def complete(p_yes: Column, given: Column | None = None, unsure_share: float = 0.25) -> Column:
    """A given (no, unsure, yes), else one completed from p_yes: a quarter of the rest is unsure."""
    rest = F.greatest(F.lit(0.0), 1 - p_yes)
    made = F.array(rest - rest * unsure_share, rest * unsure_share, p_yes)
    return made if given is None else F.coalesce(given, made)


def cost_linear(length: Column, p_yes: Column, beta: float | Column = 8.0) -> Column:
    return length * (1 + beta * (1 - p_yes))


def cost_logbarrier(length: Column, p_yes: Column, lam: float | Column = 50.0) -> Column:
    return length + lam * (-F.ln(F.greatest(p_yes, F.lit(1e-6))))


def cost_risk_split(length: Column, p_no: Column, p_unsure: Column, beta_no: float = 8.0, beta_unsure: float = 4.0) -> Column:
    return length * (1 + beta_no * p_no + beta_unsure * p_unsure)
