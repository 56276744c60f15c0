"""Dirichlet-multinomial fits of vote counts, from counts of counts.

The likelihood of all items depends on how many items have each count of a
class, and each total, and on nothing else.  These numbers come from one
aggregation; Newton steps on them need no item again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _shifted(x: np.ndarray, small, large) -> np.ndarray:
    """A function of the polygamma family: terms of the recurrence up to 6, and the expansion from there."""
    x, out = np.asarray(x, float).copy(), np.zeros(np.shape(x))
    for _ in range(6):
        low = x < 6
        out[low] += small(x[low])
        x[low] += 1
    return out + large(x)


def digamma(x: np.ndarray) -> np.ndarray:
    return _shifted(x, lambda v: -1 / v, lambda v: np.log(v) - 0.5 / v - (1 / 12 - (1 / 120 - (1 / 252 - 1 / (240 * v**2)) / v**2) / v**2) / v**2)


def trigamma(x: np.ndarray) -> np.ndarray:
    return _shifted(x, lambda v: 1 / v**2, lambda v: 1 / v + 0.5 / v**2 + (1 / 6 - (1 / 30 - (1 / 42 - 1 / (30 * v**2)) / v**2) / v**2) / v**3)


def log_likelihood(alpha: np.ndarray, classes: list[tuple[np.ndarray, np.ndarray]], totals: tuple[np.ndarray, np.ndarray]) -> float:
    """Of the counts given the totals, without the multinomial coefficients.  Pairs are (count, items that have it)."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    whole = alpha.sum()
    out = float((totals[1] * (math.lgamma(whole) - lgamma(totals[0] + whole))).sum())
    return out + sum(float((w * (lgamma(n + a) - math.lgamma(a))).sum()) for a, (n, w) in zip(alpha, classes, strict=True))


def newton(classes: list[tuple[np.ndarray, np.ndarray]], totals: tuple[np.ndarray, np.ndarray], rounds: int = 200, tolerance: float = 1e-10, most: float = 1e6) -> tuple[np.ndarray, float, int]:
    """(alpha, log-likelihood, steps) of greatest likelihood, alpha within (0, ``most``].

    The Hessian is a diagonal and one rank, so a step costs as much as a gradient.
    A step that leaves the range or does not gain is halved; where the surface is not concave, it follows the gradient.
    """
    weight = totals[1].sum()
    mean = np.array([max((n * w).sum() / max((totals[0] * totals[1]).sum(), 1e-300), 1e-6) for n, w in classes])
    log_a = np.log(mean / mean.sum() * 5.0)  # steps are taken in log alpha, which keeps it positive
    value = log_likelihood(np.exp(log_a), classes, totals)
    for step in range(1, rounds + 1):
        a = np.exp(log_a)
        whole = a.sum()
        shared = float((totals[1] * (digamma(whole) - digamma(totals[0] + whole))).sum())
        shared2 = float((totals[1] * (trigamma(whole) - trigamma(totals[0] + whole))).sum())
        g = np.array([shared + float((w * (digamma(n + x) - digamma(x))).sum()) for x, (n, w) in zip(a, classes, strict=True)])
        q = np.array([float((w * (trigamma(n + x) - trigamma(x))).sum()) for x, (n, w) in zip(a, classes, strict=True)])
        grad = g * a
        hessian = np.diag(q * a * a + grad) + shared2 * np.outer(a, a)
        try:
            move = -np.linalg.solve(hessian, grad)
        except np.linalg.LinAlgError:
            move = grad / weight
        if move @ grad <= 0:
            move = grad / max(weight, 1.0)
        scale = 1.0
        while scale > 1e-12:
            tried = np.minimum(log_a + scale * np.clip(move, -3, 3), math.log(most))
            new = log_likelihood(np.exp(tried), classes, totals)
            if new >= value - 1e-12 * abs(value):
                break
            scale /= 2
        moved = float(np.abs(tried - log_a).max())
        log_a, value = tried, new
        if moved < tolerance:
            break
    return np.exp(log_a), value, step


def dirichlet_fit(rows: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """Per key: items, alpha by class (``a_<class>``), their sum as ``concentration``, and the mean log-likelihood of an item.

    ``rows``: keys and a count for each class; items without votes tell nothing and are left out.
    A concentration at the limit of 1e6 says that votes spread no more than a multinomial does.
    """
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    voted = rows.where(total > 0).select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("which"), v.cast("long").alias("n")) for i, v in enumerate([*(F.col(c) for c in classes), total])))).alias("c"))
    counted = voted.groupBy(*keys, "c.which", "c.n").agg(F.count("*").alias("items"))  # as many rows as there are different counts
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name in keys}
    out = [*keys, "items", *(f"a_{c}" for c in classes), "concentration", "log_likelihood"]

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        pairs = [(p["n"].to_numpy(float), p["items"].to_numpy(float)) for p in (own[own["which"] == i] for i in range(len(classes) + 1))]
        alpha, value, _ = newton(pairs[:-1], pairs[-1])
        items = pairs[-1][1].sum()
        return pd.DataFrame([[*own[keys].iloc[0], int(items), *alpha, alpha.sum(), value / items]], columns=out)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "items long", *(f"`a_{c}` double" for c in classes), "concentration double", "log_likelihood double"])
    return counted.groupBy(*keys).applyInPandas(fit, schema)
