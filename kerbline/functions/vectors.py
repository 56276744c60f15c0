"""Vectors as array<float> or array<double>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kerbline.functions.distributions import _sum


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector has no length."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def linear(weights: Column, bias: Column, x: Column) -> Column:
    """W x + b for weights as an array of rows."""
    return F.zip_with(F.transform(weights, lambda row: dot(row, x)), bias, lambda a, b: a + b)


def pooled(tokens: Column, mask: Column, floor: float = 0.02) -> Column:
    """Mask-weighted mean of token vectors, of unit length; plain mean where the mask's mean is under ``floor``."""
    n = F.size(tokens)
    cover = _sum(mask) / n
    w = F.when(cover < floor, F.transform(mask, lambda _: F.lit(1.0))).otherwise(mask)
    zero = F.transform(tokens[0], lambda _: F.lit(0.0))
    scaled = F.zip_with(tokens, w, lambda t, k: F.transform(t, lambda x: x.cast("double") * k))
    return l2_normalise(F.transform(F.aggregate(scaled, zero, lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b)), lambda x: x / _sum(w)))
