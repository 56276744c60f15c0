"""Ranks and orders of whole tables without a task that sees all rows.

What asks for values only (percentiles, mean ranks, the k-th value) works on counts by value: rows
are counted before the shuffle, so a value that half the table holds is one
row, and running sums over the values tell every place.  Values are cut into
ranges once they are many.

What asks for rows (``placed``) cuts them into ranges, counts the ranges' rows, and adds
a row's place in its range.  Ranges are ordinary columns, so every evaluation gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.plans.scratch import Scratch

#: Ranges that an order is cut into.
RANGES = 200
#: Values of one range of counts.
RANGE_VALUES = 200_000


def bounds_of(rows: DataFrame, value: str, ranges: int = RANGES) -> list[float]:
    """Values that cut ``rows`` into about equal ranges: at most ``ranges`` numbers, from an approximate sketch."""
    if ranges < 2:
        return []
    found = rows.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.5 / ranges)
    return sorted(set(found))


def range_of(value: Column, bounds: list[float]) -> Column:
    """How many bounds lie below or at the value, found by halves; null as the lowest."""

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= float(bounds[middle]), half(middle + 1, high)).otherwise(half(low, middle))

    return half(0, len(bounds))


def _offsets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _range, _before): rows of the same keys in lower ranges; a row for each key and range."""
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.withColumn("_before", F.sum("_size").over(before.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select(
        *keys, "_range", F.coalesce("_before", F.lit(0)).alias("_before")
    )


def placed(rows: DataFrame, keys: list[str], range_col: Column, order: list, out: str = "place") -> DataFrame:
    """``rows`` with their place from 0 in ``order`` within ``keys``; ``range_col`` must not fall along the order."""
    cut = rows.withColumn("_range", range_col)
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    same = [*keys, "_range"]
    return cut.withColumn("_own", own).join(_offsets(cut, keys), same).withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_range", "_own", "_before")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys of which nulls are equal."""
    renamed = b.withColumnsRenamed({k: f"_{k}_" for k in keys})
    return a.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys]).drop(*(f"_{k}_" for k in keys))


def running(counts: DataFrame, keys: list[str], value: str, distinct: int, n: str = "n") -> DataFrame:
    """Counts by value, with ``before``, the rows of lower values of the same keys, and ``total``, all rows of the keys.

    ``counts`` has one row for each keys and value, so however often a value
    occurs it is one row here; ``distinct`` is how many rows that are.  Beyond ``RANGE_VALUES``
    of them, a task sees the values of a range.
    """
    bounds = bounds_of(counts, value, -(-distinct // RANGE_VALUES)) if distinct > RANGE_VALUES else []
    cut = counts.withColumn("_range", range_of(F.col(value), bounds))
    same = [*keys, "_range"]
    lower = F.sum(n).over(Window.partitionBy(*same).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    sizes = cut.groupBy(*same).agg(F.sum(n).alias("_size"))  # a row for each range of each key
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = sizes.select(*same, F.coalesce(F.sum("_size").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.sum("_size").over(group).alias("total"))
    placed_values = cut.withColumn("_lower", F.coalesce(lower, F.lit(0)))
    return same_keys(placed_values, offsets, same).withColumn("before", F.col("_offset") + F.col("_lower")).drop("_range", "_lower", "_offset")


def value_counts(rows: DataFrame, keys: list[str], value: str, *more: Column) -> tuple[DataFrame, int]:
    """(keys, value, n, more): rows by value, written; and how many values there are.  ``more`` are further sums by value."""
    out, seen = Scratch(rows.sparkSession, "value-counts").write_observed(rows.groupBy(*keys, value).agg(F.count("*").alias("n"), *more), "counts")
    return out, seen["rows"]


def quantile(total: Column, before: Column, n: Column, value: Column, q: float) -> Column:
    """The percentile of a group by linear interpolation, as an aggregate over ``running`` counts."""
    at = (total - 1) * q
    low, high = F.floor(at), F.ceil(at)
    share = at - low
    holds = lambda place: (before <= place) & (place < before + n)
    return F.sum(F.when(holds(low), value * (1 - share)).otherwise(0.0) + F.when(holds(high), value * share).otherwise(0.0))


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Per key the exact percentiles of ``value`` by linear interpolation, nulls left out; keys without values are missing."""
    counts, distinct = value_counts(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), keys, "_v")
    at = running(counts, keys, "_v", distinct)
    return at.groupBy(*keys).agg(*(quantile(F.col("total"), F.col("before"), F.col("n"), F.col("_v"), q).alias(name) for name, q in wanted.items()))


def mean_ranks(counts: DataFrame, keys: list[str], value: str, distinct: int, out: str) -> DataFrame:
    """``running`` counts with ``out``, the rank from 1 that equal values share."""
    return running(counts, keys, value, distinct).withColumn(out, F.col("before") + (F.col("n") + 1) / 2).drop("before", "total")


def kth(rows: DataFrame, value: str, k: int):
    """The ``k``-th value in ascending order, from 0, and how many rows lie below it; None beyond the rows."""
    counts, distinct = value_counts(rows.select(value), [], value)
    found = running(counts, [], value, distinct).where((F.col("before") <= k) & (F.col("before") + F.col("n") > k)).select(value, "before").first()
    return (found[0], found[1]) if found else None
