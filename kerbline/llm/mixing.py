"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic, in tokens.  The
fit rakes the cells to each margin's target in turn until all margins hold; a
document's weight is the product of its categories' factors.  Sampling
probabilities are the weights times one constant, cut at 1, with the constant
solved so that the expected tokens meet the budget.  Whether a document is taken
depends on its id and the seed only.

Null categories are a category of their own.  Null and empty texts have no
tokens; they get the weight of their categories.  Very long texts count whole.
Targets for categories that no document has are left out and the rest scaled to
one; categories without a target keep, together, the share they have.  Repeated
rows count each, and rows with one id are all sampled or none; ties can't arise,
as each row is judged by itself.  An empty table gives an empty one.  Extra
columns pass unchanged whatever their names; one named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from kerbline.plans.scratch import Scratch

MARGINS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
#: Cells that are raked in memory; more are raked by aggregations.
LOCAL_CELLS = 200_000


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def format_topic(text: Column, tokens: Column) -> Column:
    """A coarse topic by what a text is made of: tables, marked, contact, numeric, long or short prose."""
    t = F.coalesce(text, F.lit(""))
    lost = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    return (
        F.when(tokens == 0, "empty")
        .when(lost("|") * 20 >= tokens, "tables")
        .when(lost("#*$%&<>") * 20 >= tokens, "marked")
        .when(F.contains(t, F.lit("@")), "contact")
        .when(lost("0123456789") * 50 >= F.length(t), "numeric")
        .when(tokens >= 250, "long prose")
        .otherwise("short prose")
    )


@dataclass(frozen=True)
class tempered:
    """Targets in proportion to the observed share to the power ``alpha``: below 1, small categories gain."""

    alpha: float

    def __call__(self, shares: Mapping[str, float]) -> dict[str, float]:
        return {k: v**self.alpha for k, v in shares.items()}

    def column(self, share: Column) -> Column:
        """The same from a column of shares."""
        return F.pow(share, F.lit(float(self.alpha)))


def full_target(shares: Mapping[str, float], wanted) -> dict[str, float]:
    """A share for every observed category, summing to one."""
    goal = wanted(shares) if callable(wanted) else dict(wanted)
    named = {k: float(goal[k]) for k in shares if k in goal and shares[k] > 0}
    free = sum(v for k, v in shares.items() if k not in goal)
    total = sum(named.values())
    scale = (1 - free) / total if total else 0.0
    return {k: named[k] * scale if k in named else (v if k not in goal else 0.0) for k, v in shares.items()}


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], sweeps: int, tolerance: float) -> tuple[list[np.ndarray], float]:
    """Factors of each margin's categories, and the largest relative miss of a margin."""
    factors = [np.ones(len(t)) for t in targets]
    total, miss = tokens.sum(), 0.0
    for _ in range(sweeps):
        for k, (code, target) in enumerate(zip(codes, targets, strict=True)):
            rest = tokens * np.prod([f[c] for j, (f, c) in enumerate(zip(factors, codes, strict=True)) if j != k], axis=0)
            mass = np.bincount(code, rest, len(target))
            factors[k] = np.where(mass > 0, target * total / np.where(mass > 0, mass, 1), 1.0)
        fitted = tokens * np.prod([f[c] for f, c in zip(factors, codes, strict=True)], axis=0)
        miss = max(
            (float(np.max(np.abs(np.bincount(c, fitted, len(t)) - t * total)[t > 0] / (t[t > 0] * total), initial=0)) for c, t in zip(codes, targets, strict=True)), default=0.0
        )
        if miss < tolerance:
            break
    return factors, miss


def rake_distributed(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, sweeps: int, tolerance: float = 0.0) -> tuple[DataFrame, float]:
    """The same fit by aggregations, for more cells than one machine should hold: cells with ``weight``, and the miss.

    ``targets[m]`` has (m, goal), goal in tokens.  It ends by the same tolerance
    as ``rake``: the largest relative miss of a margin after a sweep.
    """
    now, miss = cells.withColumn("weight", F.lit(1.0)), 0.0

    def masses(margin: str, goal: DataFrame) -> DataFrame:
        mass = now.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("weight")).alias("mass"))
        return mass.join(goal, mass[margin].eqNullSafe(goal[margin])).select(mass[margin].alias("_m"), "mass", "goal")

    for _ in range(sweeps):
        for margin, goal in targets.items():
            factor = masses(margin, goal).select("_m", F.when(F.col("mass") > 0, F.col("goal") / F.col("mass")).otherwise(1.0).alias("factor"))
            now = now.join(factor, now[margin].eqNullSafe(factor["_m"])).select(*cells.columns, (F.col("weight") * F.col("factor")).alias("weight"))
        now = scratch.write(now, "raked")
        missed = (masses(m, g).where("goal > 0").agg(F.max(F.abs(F.col("mass") - F.col("goal")) / F.col("goal"))).first()[0] for m, g in targets.items())
        miss = max((x for x in missed if x is not None), default=0.0)
        if miss < tolerance:
            break
    return now, miss


def scale_for(tokens: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """The constant c with sum(tokens * min(1, c * weight)) = budget; infinite where the budget takes everything."""
    order = np.argsort(-weight, kind="stable")
    t, w = tokens[order].astype(float), weight[order]
    able = w > 0
    if budget >= t[able].sum():
        return float("inf")
    # with the first i cells cut at 1, c = (budget - their tokens) / (the others' weighted tokens)
    cut = np.r_[0.0, np.cumsum(t)]
    rest = np.r_[np.cumsum((t * w)[::-1])[::-1], 0.0]
    for i in range(len(t)):
        if rest[i] > 0:
            c = (budget - cut[i]) / rest[i]
            if c * w[i] <= 1:
                return float(max(c, 0.0))
    return float("inf")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key, by 52 bits of an md5; the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


DEFAULT_TARGETS = {"source": tempered(0.7), "lang": tempered(0.8), "topic": tempered(0.9)}


def mix(
    docs: DataFrame, scratch: Scratch, targets: Mapping | None = None, keep: float = 0.8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
    topic: Column | None = None, sweeps: int = 60, tolerance: float = 1e-9, local_cells: int = LOCAL_CELLS, out: str = "mix",
) -> DataFrame:
    """Every row of ``docs`` with a struct ``out``: topic, n_tokens, weight, p, sampled and miss.

    ``miss`` is the fit's: by how much, relatively, the worst margin lies off its target, under
    ``tolerance`` for a fit that has converged; targets that no weights can meet together leave more.

    ``targets``: for source, lang and topic each a mapping from category to share,
    or a function from observed shares to such a mapping.  ``keep``: the share of
    all tokens to take.  A column named ``out`` is replaced.
    """
    wanted = dict(DEFAULT_TARGETS) | dict(targets or {})
    # rows travel as one struct, so that their names can't clash with those used here; texts are measured once
    given = docs.drop(out)
    text = F.col(text_col).cast("string")
    kinds = [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *([] if topic is None else [topic.cast("string").alias("topic")])]
    counted = given.select(F.struct(*(F.col(f"`{c}`") for c in given.columns)).alias("row"), text.alias("text"), *kinds, token_count(text).alias("tokens"))
    if topic is None:
        counted = counted.withColumn("topic", format_topic(F.col("text"), F.col("tokens")))
    measured = scratch.write(counted.drop("text"), "measured")
    cells, seen = scratch.write_observed(measured.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    shares = {m: cells.groupBy(m).agg(F.sum("tokens").alias("t")) for m in MARGINS}
    if seen["rows"] <= local_cells:
        rows = cells.collect()  # at most local_cells rows of counts
        tokens = np.array([r.tokens for r in rows], float)
        codes, goals = [], []
        for m in MARGINS:
            names = {v: i for i, v in enumerate(dict.fromkeys(r[m] for r in rows))}
            code = np.array([names[r[m]] for r in rows], int)
            mass = np.bincount(code, tokens, len(names)) if len(rows) else np.zeros(0)
            whole = mass.sum() or 1.0
            goal = full_target({k: mass[i] / whole for k, i in names.items()}, wanted[m])
            codes.append(code)
            goals.append(np.array([goal[k] for k in names]))
        factors, miss = rake(tokens, codes, goals, sweeps, tolerance)
        weight = np.prod([f[c] for f, c in zip(factors, codes, strict=True)], axis=0) if len(rows) else np.zeros(0)
        scale = scale_for(tokens, weight, keep * tokens.sum())
        p = np.minimum(1.0, np.where(weight > 0, weight * scale if np.isfinite(scale) else 1.0, 0.0))
        table = docs.sparkSession.createDataFrame(
            [(*(r[m] for m in MARGINS), float(w), float(q)) for r, w, q in zip(rows, weight, p, strict=True)], "_s string, _l string, _t string, weight double, p double"
        )
    else:
        total = cells.agg(F.sum("tokens")).first()[0] or 0
        goals = {}
        for m, share in shares.items():
            goal = wanted[m]
            if hasattr(goal, "column"):
                joined = share.withColumn("want", F.when(F.col("t") > 0, goal.column(F.col("t") / F.lit(float(total or 1)))))
            else:
                if callable(goal):
                    goal = goal({r[m]: r.t / (total or 1) for r in share.collect()})  # any function needs the margin's shares at once
                given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in goal.items()], f"{m} string, want double").withColumnRenamed(m, "_m")
                joined = share.join(given, share[m].eqNullSafe(given["_m"]), "left").select(m, "t", F.when(F.col("t") > 0, F.col("want")).alias("want"))
            sums = joined.agg(F.sum(F.when(F.col("want").isNull(), F.col("t")).otherwise(0)).alias("free"), F.sum("want").alias("named")).first()
            ratio = (total - (sums.free or 0)) / sums.named if sums.named else 0.0
            goals[m] = joined.select(m, F.coalesce(F.col("want") * ratio, F.col("t").cast("double")).alias("goal"))
        raked, miss = rake_distributed(cells, goals, scratch, sweeps, tolerance)
        scale = _scale_distributed(raked, keep * total)
        table = raked.select(*(F.col(m).alias(f"_{m[0]}") for m in MARGINS), "weight", F.least(F.lit(1.0), F.col("weight") * scale).alias("p"))
    same = [F.col(m).eqNullSafe(F.col(f"_{m[0]}")) for m in MARGINS]
    joined = measured.join(table, same[0] & same[1] & same[2], "left")
    inside = F.struct("topic", F.col("tokens").alias("n_tokens"), "weight", "p", (uniform(F.col("row")[id_col], seed) < F.col("p")).alias("sampled"), F.lit(float(miss)).alias("miss"))
    return joined.select("row.*", inside.alias(out))


def _scale_distributed(raked: DataFrame, budget: float, steps: int = 60) -> float:
    """``scale_for`` by halving an interval; each step is one sum over the cells."""
    low, high = 0.0, 1.0
    spent = lambda c: raked.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * c))).first()[0] or 0.0
    while spent(high) < budget and high < 1e12:
        high *= 4
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if spent(mid) < budget else (low, mid)
        if high - low < 1e-9 * high:
            break
    return high
