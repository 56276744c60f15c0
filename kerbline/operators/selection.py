"""Sampling, top-k, acquisition, k-centres and waypoint choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.functions import distributions as D
from kerbline.functions.vectors import euclidean
from kerbline.plans.ranks import bounds_of, kth, placed, range_of
from kerbline.plans.scratch import Scratch


def mixed_int(key: Column, seed: int = 42) -> Column:
    """A pseudo-random order of integer keys by integer arithmetic only, the same in any engine."""
    a = (key * 1103515 + seed * 12345) % 2147483647
    return ((a * 48271) % 2147483647 * 16807) % 2147483647


def sample_n(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, fixed by key and seed."""
    return rows.orderBy(mixed_int(F.col(key), seed), key).limit(n)


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in their source's order, which some columns must give; 0 keeps all."""
    return rows.orderBy(*order).limit(n) if n else rows


def sample_fraction(rows: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """A share of rows fixed by key and seed; no shuffle."""
    return rows.where(mixed_int(F.col(key), seed) < int(fraction * 2147483647))


def balanced_top(rows: DataFrame, per_class: int, class_col: str, *order: str | Column) -> DataFrame:
    """Up to ``per_class`` rows of each class in the given order; 0 keeps all."""
    if per_class == 0:
        return rows
    w = Window.partitionBy(class_col).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_class).drop("_n")


def ranked_top(rows: DataFrame, n: int, score: str, key: str) -> DataFrame:
    """The ``n`` highest scores, ties by key, with ``rank`` from 1."""
    best = rows.orderBy(F.desc(score), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))  # over n rows only


def top_fraction(rows: DataFrame, fraction: float, least: int, score: str, key: str) -> DataFrame:
    """The highest scores: max(least, floor(fraction * rows)) of them, ties by ``key``, which tells rows apart; null scores last.

    The lowest score that is taken, and of its ties the last key, come from counts by value; rows are only filtered.
    """
    size = max(least, int(rows.count() * fraction))
    low = F.coalesce(-F.col(score).cast("double"), F.lit(float("inf")))
    cut = kth(rows.select(low.alias("_low")), "_low", size - 1) if size else (float("-inf"), 0)
    if cut is None:
        return rows
    ties = rows.where(low == cut[0])
    last = kth(ties.select(F.col(key).alias("_key")), "_key", size - cut[1] - 1) if size else None
    return rows.where((low < cut[0]) | ((low == cut[0]) & (F.col(key) <= F.lit(last[0] if last else None))))


def every_kth(values: Column, step: Column | int) -> Column:
    return F.filter(values, lambda _, i: i % step == 0)


def consecutive(values: Column) -> Column:
    """array<struct<a, b>> of neighbours."""
    n = F.size(values) - 1
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def acquisition(predictions: DataFrame, item: str = "item_id") -> DataFrame:
    """Per item: entropy of the mean distribution, mean over classes of the std across aids, and their product."""
    means = predictions.groupBy(item).agg(*(f(F.col("probs")[i]).alias(f"{n}{i}") for i in range(3) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    h = D.normalised_entropy(F.array("m0", "m1", "m2"))
    d = (F.col("s0") + F.col("s1") + F.col("s2")) / 3
    return means.select(item, h.alias("entropy"), d.alias("disagreement"), (h * d).alias("hybrid"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    v = column.combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _nearest_of(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each key of ``left`` with its Euclidean distance to the nearest vector of ``right``.

    Products tell which come into question; differences, summed in order, decide.
    """
    if not len(left) or not len(right):
        return pa.table({"k": left["k"].slice(0, 0), "d": pa.array([], pa.float64())})
    a, b = _matrix(left["v"]), _matrix(right["v"])
    sizes, least = (b * b).sum(axis=1), np.full(len(a), np.inf)
    for at in range(0, len(a), 500):
        x = a[at : at + 500]
        own = (x * x).sum(axis=1)
        rough = own[:, None] + sizes[None, :] - 2 * (x @ b.T)
        slack = 1e-12 * x.shape[1] * (own + sizes.max())
        i, j = np.nonzero(rough <= (rough.min(axis=1) + slack)[:, None])
        for part in range(0, len(i), 100_000):
            p, q = i[part : part + 100_000], j[part : part + 100_000]
            np.minimum.at(least, at + p, np.cumsum((x[p] - b[q]) ** 2, axis=1)[:, -1])
    return pa.table({"k": left["k"], "d": pa.array(np.sqrt(least), pa.float64())})


def greedy_k_centre(pool: DataFrame, labelled: DataFrame, n: int, scratch: Scratch, key: str = "key", vec: str = "vec", block: int = 10_000) -> DataFrame:
    """``n`` pool items, each the farthest from all labelled and chosen ones: (rank, key, distance), ties by key.

    A distance column follows the choices; a round is one projection and one
    maximum, and only the chosen vector comes to the driver.  All labelled vectors
    count; they and the pool are dealt to numbered blocks of about ``block``, and
    every block of the one meets every block of the other in a matrix product.
    """
    spark = pool.sparkSession
    seeds, seen = scratch.write_observed(labelled.select(F.transform(vec, lambda x: x.cast("double")).alias("v")).where("v is not null").distinct(), "seeds")
    rows, counted = scratch.write_observed(pool.select(F.col(key), F.col(vec)), "pool")
    n_pool, n_seeds = max(1, -(-counted["rows"] // block)), max(1, -(-seen["rows"] // block))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = rows.where(F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.transform(vec, lambda x: x.cast("double")).alias("v"), F.pmod(F.xxhash64(key), F.lit(n_pool)).cast("int").alias("i"), every(n_seeds, "j"))
    other = seeds.select("v", every(n_pool, "i"), F.pmod(F.xxhash64("v"), F.lit(n_seeds)).cast("int").alias("j"))
    kind = dict(pool.dtypes)[key]
    met = own.groupBy("i", "j").cogroup(other.groupBy("i", "j")).applyInArrow(_nearest_of, f"k {kind}, d double")
    near = met.groupBy(F.col("k").alias(key)).agg(F.min("d").alias("d"))
    state = scratch.write(rows.join(near, key, "left").select(key, vec, "d"), "k-centre")
    if not seen["rows"]:
        state = state.where("d is not null")
    chosen = []
    for rank in range(1, n + 1):
        top = state.orderBy(F.desc("d"), key).limit(1).collect()  # one row
        if not top:
            break
        chosen.append((rank, top[0][key], float(top[0]["d"])))
        centre = F.array(*(F.lit(float(x)) for x in top[0][vec]))
        state = state.where(F.col(key) != top[0][key]).withColumn("d", F.least("d", euclidean(F.col(vec), centre)))
        if rank % 10 == 0:
            state = scratch.write(state, "k-centre")
    return spark.createDataFrame(chosen, f"rank int, `{key}` {kind}, distance double")


def waypoints(candidates: DataFrame, n: int, route_id: str = "route_id") -> DataFrame:
    """Up to ``n`` waypoints per route, one from each of n equal parts, panoramas not repeated.

    ``candidates``: route_id, total (edges of the route), edge_idx, dist, panos
    (in order of preference), excluded (panoramas used before).  A part takes its
    nearest candidate with an unused panorama; if there is none, one that this
    route has not used.  The choice is sequential, so a route is one group, of at
    most its own edges.
    """
    out = f"`{route_id}` {dict(candidates.dtypes)[route_id]}, segment int, edge_idx int, pano string"

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        total, excluded = int(g["total"].iloc[0]), g["excluded"].iloc[0]
        used = set(excluded if excluded is not None else ())
        own: set[str] = set()
        rows = []
        ordered = g.sort_values(["dist", "edge_idx"], kind="stable")
        for part in range(n):
            inside = ordered[(ordered["edge_idx"] >= part * total // n) & (ordered["edge_idx"] < (part + 1) * total // n)]
            options = [(r.edge_idx, p) for r in (inside if len(inside) else ordered).itertuples() for p in r.panos]
            pick = next((x for x in options if x[1] not in used), None) or next((x for x in options if x[1] not in own), None)
            if pick:
                used.add(pick[1])
                own.add(pick[1])
                rows.append((g[route_id].iloc[0], part, int(pick[0]), pick[1]))
        return pd.DataFrame(rows, columns=[route_id, "segment", "edge_idx", "pano"])

    return candidates.groupBy(route_id).applyInPandas(choose, out)


def beta_draws(params: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` clipped Beta(a, b) draws per row of (aid, a, b), fixed by aid and seed: (aid, i, p_yes)."""
    import zlib

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                values = np.random.default_rng([seed, zlib.crc32(r.aid.encode())]).beta(r.a, r.b, n)
                yield pd.DataFrame({"aid": r.aid, "i": np.arange(n), "p_yes": np.clip(values, 0.01, 0.99)})

    return params.select("aid", "a", "b").mapInPandas(draw, "aid string, i int, p_yes double")


def beta_of_f1(f1: Column) -> tuple[Column, Column]:
    """Beta parameters for scores of a model of this macro-F1: the better, the nearer to one."""
    return F.greatest(F.lit(1.0), f1 * 10), F.greatest(F.lit(1.0), (1 - f1) * 10)


def simulated_scores(edges: DataFrame, quality: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """Every edge with a score for each aid, drawn with replacement from ``n`` Beta draws of the aid: u, v, k, aid, p_yes.

    ``quality``: aid, f1.  Which draw an edge takes follows from a hash of edge, aid
    and seed, so neither partitions nor order matter.  Draws are ``n`` rows an aid.
    """
    a, b = beta_of_f1(F.coalesce("f1", F.lit(0.5)))
    draws = beta_draws(quality.select("aid", a.alias("a"), b.alias("b")), n, seed)
    asked = edges.select("u", "v", "k").join(quality.select("aid"), how="cross")  # a row for each edge and aid is the result
    asked = asked.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "u", "v", "k", "aid"), F.lit(n)).cast("int"))
    return asked.join(draws, ["aid", "i"]).select("u", "v", "k", "aid", "p_yes")


def endpoints(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """One origin from the south-west and one destination from the north-east quartile; any two nodes where one is empty."""
    q = nodes.agg(*(F.percentile(c, p).alias(f"{c}{i}") for c in ("lat", "lon") for i, p in ((1, 0.25), (3, 0.75))))
    tagged = nodes.join(F.broadcast(q), how="cross")  # one row
    order = F.struct(mixed_int(F.col("node"), seed).alias("h"), "node")
    far = F.struct(mixed_int(F.col("node"), seed + 1).alias("h"), "node")
    sw = (F.col("lat") <= F.col("lat1")) & (F.col("lon") <= F.col("lon1"))
    ne = (F.col("lat") >= F.col("lat3")) & (F.col("lon") >= F.col("lon3"))
    return tagged.agg(
        F.coalesce(F.min(F.when(sw, order)), F.min(order))["node"].alias("o"), F.coalesce(F.min(F.when(ne, far)), F.max(order))["node"].alias("d")
    )
