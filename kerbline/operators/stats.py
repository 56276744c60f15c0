"""Rank statistics, percentiles and reports over groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.plans.ranks import mean_ranks, percentiles, quantile, running, same_keys, value_counts


def _t_sf(t: float, df: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def spearman(rows: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Per key: n, rho and its two-sided p; null under ``least`` pairs or without variation.  Works on counts of equal pairs."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_u"), F.col(y).alias("_v"))
    pairs, distinct = value_counts(both, [*keys, "_u"], "_v")
    ranked = pairs
    for value, rank in (("_u", "_x"), ("_v", "_y")):
        ranks = mean_ranks(pairs.groupBy(*keys, value).agg(F.sum("n").alias("n")), keys, value, distinct, rank).drop("n")
        ranked = same_keys(ranked, ranks, [*keys, value])
    n = F.sum("n")
    # the mean rank is known, so gaps from it are added up
    gap = lambda c: F.col(c) - F.col("_middle")
    totals = pairs.groupBy(*keys).agg(((F.sum("n") + 1) / 2).alias("_middle"))
    near = same_keys(ranked, totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))  # one row
    product = lambda a, b: F.sum(F.col("n") * gap(a) * gap(b))
    rho = F.try_divide(product("_x", "_y"), F.sqrt(product("_x", "_x")) * F.sqrt(product("_y", "_y")))
    found = near.groupBy(*keys).agg(n.alias("n"), rho.alias("rho")).withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [None if pd.isna(r) or n < 3 else 0.0 if abs(r) >= 1 else _t_sf(r * math.sqrt((n - 2) / (1 - r * r)), n - 2) for n, r in zip(b["n"], b["rho"], strict=True)]
            yield b.assign(p=pd.Series(p, dtype=float, index=b.index))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return found.mapInPandas(tail, f"{kinds}, p double")


def wilcoxon_sums(rows: DataFrame, keys: list[str], diff: str, least: int = 3) -> DataFrame:
    """Per key: pairs with a difference, the sum of positive ranks, and the variance of it with ties; null sums under ``least`` pairs."""
    moved = rows.where(F.col(diff) != 0).select(*keys, F.abs(diff).alias("_a"), (F.col(diff) > 0).cast("long").alias("_up"))
    counts, distinct = value_counts(moved, keys, "_a", F.sum("_up").alias("_up"))
    ranked, t = mean_ranks(counts, keys, "_a", distinct, "_r"), F.col("n").cast("double")
    found = ranked.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.col("_up") * F.col("_r")).alias("w_plus"), F.sum(t * t * t - t).alias("_ties")).withColumnRenamed("_n", "n")
    n = F.col("n")
    return found.select(
        *keys, "n", F.when(n >= least, F.col("w_plus")).alias("w_plus"), F.when(n >= least, n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48).alias("variance"), (F.col("_ties") > 0).alias("tied")
    )


def wilcoxon(rows: DataFrame, keys: list[str], diff: str, alternative: str = "greater", exact_up_to: int = 50) -> DataFrame:
    """One-sided signed-rank test per key: n, w_plus, p.  Exact for few untied pairs, else by the normal approximation."""

    def exact_tail(n: int, w: float) -> float:
        ways = [1.0] + [0.0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        total = 2.0**n
        return sum(ways[math.ceil(w) :]) / total if alternative == "greater" else sum(ways[: math.floor(w) + 1]) / total

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, w, var, tied in zip(b["n"], b["w_plus"], b["variance"], b["tied"], strict=True):
                if pd.isna(w):
                    out.append(None)
                elif n <= exact_up_to and not tied:
                    out.append(exact_tail(int(n), float(w)))
                else:
                    z = (w - n * (n + 1) / 4) / math.sqrt(var) * (1 if alternative == "greater" else -1)
                    out.append(0.5 * math.erfc(z / math.sqrt(2)))
            yield b.drop(columns=["variance", "tied"]).assign(p=pd.Series(out, dtype=float, index=b.index))

    sums = wilcoxon_sums(rows, keys, diff)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name not in ("variance", "tied"))
    return sums.mapInPandas(tail, f"{kinds}, p double")


QUANTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


def _measures(below: float, above: float) -> list[Column]:
    """n, mean, percentiles by linear interpolation, and shares below and at or above two limits, over running counts of ``_v``."""
    n, v = F.sum("n"), F.col("_v")
    share = lambda these: 100 * F.sum(F.when(these, F.col("n")).otherwise(0)) / n
    at = (F.col("total"), F.col("before"), F.col("n"), v)
    return [n.alias("_rows"), (F.sum(v * F.col("n")) / n).alias("mean"), *(quantile(*at, q).alias(name) for name, q in QUANTILES.items()), share(v < below).alias("pct_below"), share(v >= above).alias("pct_above")]


def summary(rows: DataFrame, keys: list[str], value: str, below: float = 0.5, above: float = 0.8) -> DataFrame:
    """n, mean, percentiles by linear interpolation, and shares below and at or above two limits; all but n are null for keys without values."""
    counts, distinct = value_counts(rows.select(*keys, F.col(value).cast("double").alias("_v")), keys, "_v")
    at = running(counts.where("_v is not null"), keys, "_v", distinct)
    found = at.groupBy(*keys).agg(*_measures(below, above)).withColumnRenamed("_rows", "n")
    every = counts.select(*keys).distinct() if keys else counts.agg(F.count("*").alias("_one"))
    joined = every.join(found.withColumnsRenamed({k: f"_{k}_" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys] or F.lit(True), "left")  # without keys both are one row
    return joined.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "mean", *QUANTILES, "pct_below", "pct_above")


def score_report(scores: DataFrame, value: str = "p_yes", below: float = 0.5, above: float = 0.8) -> DataFrame:
    """By source and aid (level 0), by source (1), by aid (2) and over all (3): ``summary`` of each, and ``pct_of_whole``, the share of an aid's rows or of all.

    Rows are counted by source, aid and value once; the levels are grouping sets over those counts.
    """
    named = scores.where(F.col(value).isNotNull()).select(F.coalesce("source", F.lit("unknown")).alias("source"), "aid", F.col(value).cast("double").alias("_v"))
    counts, distinct = value_counts(named, ["source", "aid"], "_v")
    sets = [[F.col(c) for c in s] for s in (("source", "aid", "_v"), ("aid", "_v"), ("source", "_v"), ("_v",))]
    # the value is in every set, so its bit is 0 and the others count 2 and 4
    levels = counts.groupingSets(sets, "source", "aid", "_v").agg((F.grouping_id() / 2).cast("long").alias("level"), F.sum("n").alias("_n")).withColumnRenamed("_n", "n")
    keys = ["level", "source", "aid"]
    report = running(levels, keys, "_v", 4 * distinct).groupBy(*keys).agg(*_measures(below, above)).withColumnRenamed("_rows", "n")
    by_aid = F.col("level").isin(0, 2)
    whole = Window.partitionBy(by_aid, F.when(by_aid, F.col("aid")))  # a row for each group
    return report.withColumn("pct_of_whole", 100 * F.col("n") / F.max(F.when(F.col("level") >= 2, F.col("n"))).over(whole))


def source_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count("*").alias("n"))


def sweep_summary(rows: DataFrame, by: str, *values: str) -> DataFrame:
    """Mean, least and most over the other keys, for each value of the swept parameter."""
    return rows.groupBy(by).agg(*(f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))


def outside_support(distances: DataFrame, group: str, reference, value: str = "dist", q: float = 0.9) -> DataFrame:
    """Per group the share (in %) of distances above the reference group's percentile."""
    limit = percentiles(distances.where(F.col(group) == reference), [], value, {"_limit": q})
    return distances.join(F.broadcast(limit), how="cross").groupBy(group).agg(F.count("*").alias("n"), (100 * F.avg((F.col(value) > F.col("_limit")).cast("double"))).alias("pct_outside"))  # one row


def dimension_scale(items: DataFrame, vec: str = "vec") -> DataFrame:
    """(dim, divisor): the population standard deviation of each dimension, 1 where it is 0."""
    each = items.select(F.posexplode(vec).alias("dim", "x"))
    deviation = F.stddev_pop(F.col("x").cast("double"))
    return each.groupBy("dim").agg(F.when(deviation < 1e-12, 1.0).otherwise(deviation).alias("divisor"))


#: Vectors of a block of items, and of the reference set, that a task compares at once.
BLOCK_ITEMS, BLOCK_REFERENCE = 4096, 8192
#: Distances that a task holds at a time (16 MB).
STRIP = 2_000_000


def _units(table: pa.Table) -> np.ndarray:
    v = table["v"].combine_chunks()
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 0))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, np.nan)


def _nearest_in_block(left: pa.Table, right: pa.Table, self_pairs: bool = False) -> pa.Table:
    """(k, dist): each item's least cosine distance in one block of the reference; items are taken by strips, so a block's whole product is never held."""
    if not len(left) or not len(right):
        return pa.table({"k": left["k"].slice(0, 0), "dist": pa.array([], pa.float64())})
    items, others = _units(left), _units(right).T
    names, other_names = left["k"].to_numpy(), right["k"].to_numpy()
    most = np.empty(len(items))
    step = max(1, STRIP // len(right))
    for at in range(0, len(items), step):
        cosine = items[at : at + step] @ others
        if not self_pairs:
            cosine[names[at : at + step, None] == other_names[None, :]] = np.nan
        np.fmax.reduce(cosine, axis=1, initial=-np.inf, out=most[at : at + step])  # passes over what is no number
    return pa.table({"k": left["k"], "dist": pa.array(1 - most, pa.float64(), mask=np.isinf(most))})


def nearest_reference(items: DataFrame, reference: DataFrame, key: str = "key", vec: str = "vec", self_pairs: bool = False) -> DataFrame:
    """Least cosine distance of each item to a reference set, itself left out.

    Exact: items and reference are dealt to numbered blocks of bounded size,
    every block of the one meets every block of the other once, and a meeting is
    a matrix product that gives one row for each item.  Vectors of length 0 have
    the distance null, and are nobody's neighbour.
    """
    kind = dict(items.dtypes)[key]
    n = {side: max(1, -(-df.count() // size)) for side, df, size in (("i", items, BLOCK_ITEMS), ("r", reference, BLOCK_REFERENCE))}

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.lit(n[own])).cast("int").alias(own)
        return df.select(F.col(key).alias("k"), F.transform(vec, lambda x: x.cast("double")).alias("v"), mine, F.explode(F.sequence(F.lit(0), F.lit(n[other] - 1))).alias(other))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest_in_block(left, right, self_pairs)

    pairs = dealt(items, "i", "r").groupBy("i", "r").cogroup(dealt(reference, "r", "i").groupBy("i", "r")).applyInArrow(meet, f"k {kind}, dist double")
    return pairs.groupBy(F.col("k").alias(key)).agg(F.min("dist").alias("dist"))
