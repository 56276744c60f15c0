"""Feature vectors from token vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.functions.vectors import l2_normalise


def pooled_tokens(tokens: DataFrame, item: str = "item_id", vec: str = "vec", mask: str = "mask", floor: float = 0.02) -> DataFrame:
    """(item, coverage, pooled, plain): the mask-weighted and the plain mean of an item's token vectors, of unit length.

    Where the mask's mean is under ``floor`` the plain mean stands for both.  Tokens are rows;
    sums by dimension are made before the shuffle, so an item may have any number of tokens.
    """
    x, m = F.col("v").cast("double"), F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    each = tokens.select(item, m.alias("m"), F.posexplode(vec).alias("dim", "v"))
    sums = each.groupBy(item, "dim").agg(F.sum(x * F.col("m")).alias("masked"), F.sum(x).alias("all"), F.sum("m").alias("weight"), F.avg("m").alias("coverage"), F.count("*").alias("n"))
    weighted = F.when(F.col("coverage") < floor, F.col("all") / F.col("n")).otherwise(F.col("masked") / F.greatest("weight", F.lit(1e-6)))
    rows = sums.groupBy(item).agg(F.max("coverage").alias("coverage"), F.array_sort(F.collect_list(F.struct("dim", weighted.alias("a"), (F.col("all") / F.col("n")).alias("b")))).alias("d"))  # one vector
    return rows.select(item, "coverage", l2_normalise(F.transform("d", lambda s: s["a"])).alias("pooled"), l2_normalise(F.transform("d", lambda s: s["b"])).alias("plain"))
