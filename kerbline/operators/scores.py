"""Edge scores: joins on undirected keys with a match guard, worst-barrier aggregation, fallback by source."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions.constants import AID_KEYS, PRIORS, passability_table, prior_table
from kerbline.operators.spatial import nearest_within, within


class MatchRateError(ValueError):
    """Too few edges have a score: the score file is likely for another graph."""


def join_scores(edges: DataFrame, scores: DataFrame, value: str = "p_yes", default: float | None = None, try_reverse: bool = True) -> DataFrame:
    """Edges (u, v, k) with the score stored under (u, v, k), else under (v, u, k), else ``default`` or the aid's prior; and ``matched``."""
    turned = lambda u, v, turn: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.lit(turn).alias("turn"))
    ways = F.array(turned("u", "v", 0), turned("v", "u", 1)) if try_reverse else F.array(turned("u", "v", 0))
    both = scores.where(F.col("aid").isin(AID_KEYS)).select(F.explode(ways).alias("_w"), "k", "aid", F.col(value).alias("_s"))
    both = both.where("_w.turn = 0 or _w.u <> _w.v").select("_w.*", "k", "aid", "_s")
    # one row for an edge, whose scores by aid stay side by side: edges meet them before they are listed by aid
    found = []
    for i, aid in enumerate(AID_KEYS):
        for turn in (0, 1) if try_reverse else (0,):
            own = (F.col("aid") == aid) & (F.col("turn") == turn)
            # of equal keys a null goes first, as in a minimum of structs; a key with a null counts as found
            found += [F.min(F.when(own, F.col("_s"))).alias(f"_s{i}_{turn}"), F.max(F.when(own, F.col("_s").isNull().cast("int"))).alias(f"_n{i}_{turn}")]
    best = both.groupBy("u", "v", "k").agg(*found)
    rest = [c for c in edges.columns if c not in ("u", "v", "k")]
    joined = edges.join(best, ["u", "v", "k"], "left")

    def of_aid(i: int, aid: str) -> Column:
        turns = [(F.col(f"_n{i}_{t}"), F.col(f"_s{i}_{t}")) for t in ((0, 1) if try_reverse else (0,))]
        score = F.coalesce(*(F.when(n.isNotNull(), F.struct(F.when(n == 0, s).alias("s"))) for n, s in turns))
        return F.struct(F.lit(aid).alias("aid"), score.isNotNull().alias("matched"), F.coalesce(score["s"], F.lit(PRIORS[aid] if default is None else default)).alias("s"))

    listed = joined.select("u", "v", "k", *rest, F.explode(F.array(*(of_aid(i, aid) for i, aid in enumerate(AID_KEYS)))).alias("_a"))
    return listed.select("u", "v", "k", *rest, F.col("_a.aid").alias("aid"), F.col("_a.matched").alias("matched"), F.col("_a.s").alias(value))


def match_rate(joined: DataFrame) -> float:
    """Share of distinct edges with a score; one aggregation."""
    row = joined.groupBy("u", "v", "k").agg(F.bool_or("matched").alias("m")).agg(F.avg(F.col("m").cast("double")).alias("r")).first()
    return float(row.r) if row.r is not None else 0.0


def checked(joined: DataFrame, fail_below: float = 0.5, warn_below: float = 0.9) -> DataFrame:
    """The joined edges; an error below one match rate, a warning below another.  Runs one job."""
    rate = match_rate(joined)
    if rate < fail_below:
        raise MatchRateError(f"only {rate:.1%} of edges have a score")
    if rate < warn_below:
        warnings.warn(f"{1 - rate:.1%} of edges have no score and get a default", stacklevel=2)
    return joined


def way_matches(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Each label on every edge of its way; an edge may have several way ids."""
    ways = edges.select("u", "v", "k", F.explode("way_ids").alias("way_id")).distinct()
    return labels.join(ways, "way_id").select("label_id", "label_type", "u", "v", "k")


def node_labels_to_edges(snapped: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels snapped to nodes, fanned out to incident edges; a self-loop gets a label from each end."""
    at = lambda end: edges.join(snapped.withColumnRenamed("node", end), end).select("label_id", "label_type", "u", "v", "k")
    return at("u").unionByName(at("v"))


def edge_labels(labels: DataFrame, edges: DataFrame, nodes: DataFrame, snap_radius_m: float = 50.0) -> DataFrame:
    """(label, edge) by way id, and for labels without a matching way by the nearest node in reach."""
    by_way = way_matches(labels, edges)
    left = labels.join(by_way.select("label_id").distinct(), "label_id", "left_anti")
    places = nodes.select("node", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    snapped = nearest_within(left.select("label_id", "label_type", "lat", "lon"), places, snap_radius_m, "label_id", "node").select("label_id", "label_type", "node")
    return by_way.unionByName(node_labels_to_edges(snapped, edges))


def label_counts(labels: DataFrame, edges: DataFrame, nodes: DataFrame, snap_radius_m: float = 50.0) -> DataFrame:
    """(u, v, k, label_type, n): ``edge_labels`` counted by edge and type, from counts by way and by node; no pair of a label and an edge is made."""
    ways = edges.select("u", "v", "k", F.explode("way_ids").alias("way_id")).distinct()
    by_way = labels.groupBy("way_id", "label_type").agg(F.count("*").alias("n"))
    left = labels.join(ways.select("way_id").distinct(), "way_id", "left_anti")
    places = nodes.select("node", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    snapped = nearest_within(left.select("label_id", "label_type", "lat", "lon"), places, snap_radius_m, "label_id", "node")
    by_node = snapped.groupBy("node", "label_type").agg(F.count("*").alias("n"))
    at = lambda end: edges.join(by_node.withColumnRenamed("node", end), end).select("u", "v", "k", "label_type", "n")
    every = ways.join(by_way, "way_id").select("u", "v", "k", "label_type", "n").unionByName(at("u")).unionByName(at("v"))
    return every.groupBy("u", "v", "k", "label_type").agg(F.sum("n").alias("n"))


def worst_barrier(matched: DataFrame, edges: DataFrame, sep: str | None = None) -> DataFrame:
    """Per edge and aid the least passability of its labels (unknown types as the prior); the prior without labels.

    ``matched``: a row per label and edge, or counts ``n`` by edge and type (``label_counts``).
    Long form: u, v, k, aid, p_yes, n_labels, label_types, source.  With ``sep`` label_types is one string, which
    is written from the counts, once for all aids of an edge.
    """
    spark = edges.sparkSession
    counts = matched if "n" in matched.columns else matched.groupBy("u", "v", "k", "label_type").agg(F.count("*").alias("n"))
    kinds = matched.select("label_type").distinct()
    aids = F.broadcast(prior_table(spark))  # five rows
    known = F.broadcast(passability_table(spark))  # 45 rows
    # a type's passabilities for all aids stay side by side: no row per edge, type and aid
    own = kinds.join(aids, how="cross").join(known, ["label_type", "aid"], "left")
    told = own.groupBy("label_type").agg(*(F.max(F.when(F.col("aid") == aid, F.coalesce("p_yes", "prior"))).alias(f"_p{i}") for i, aid in enumerate(AID_KEYS)))
    typed = counts.join(told.withColumnRenamed("label_type", "_t"), F.col("label_type").eqNullSafe(F.col("_t")))
    per_edge = typed.groupBy("u", "v", "k").agg(
        F.sum("n").cast("int").alias("n_labels"),
        F.sort_array(F.collect_list(F.when(F.col("label_type").isNotNull(), F.struct("label_type", F.col("n").cast("int").alias("n"))))).alias("types"),  # as many as there are types
        *(F.min(f"_p{i}").alias(f"_p{i}") for i in range(len(AID_KEYS))),
    )
    if sep is None:
        listed = F.coalesce(F.flatten(F.transform("types", lambda x: F.array_repeat(x["label_type"], x["n"]))), F.array().cast("array<string>"))
    else:
        again = lambda x: F.concat(F.call_function("repeat", F.concat(x["label_type"], F.lit(sep)), x["n"] - 1), x["label_type"])
        listed = F.coalesce(F.array_join(F.transform("types", again), sep), F.lit(""))
    every = edges.select("u", "v", "k").join(per_edge.withColumn("label_types", listed).drop("types"), ["u", "v", "k"], "left")
    of_aid = [F.struct(F.lit(aid).alias("aid"), F.when(F.col(f"_p{i}").isNotNull(), F.least(F.lit(1.0), F.col(f"_p{i}"))).otherwise(F.lit(float(PRIORS[aid]))).alias("p_yes")) for i, aid in enumerate(AID_KEYS)]
    none = F.array().cast("array<string>") if sep is None else F.lit("")
    long = every.select("u", "v", "k", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.coalesce("label_types", none).alias("label_types"), F.when(F.col("n_labels").isNull(), "prior").otherwise("labels").alias("source"), F.explode(F.array(*of_aid)).alias("_a"))
    return long.select("u", "v", "k", "_a.aid", "_a.p_yes", "n_labels", "label_types", "source")


def mean_of_images(edges_mid: DataFrame, images: DataFrame, radius_m: float = 30.0) -> DataFrame:
    """Per edge and aid the mean prediction of images near its midpoint; a missing prediction counts 0.5.

    ``edges_mid``: u, v, k, lat, lon; ``images``: image_id, p_lat, p_lon, aid, p_yes.
    """
    near = within(edges_mid, images, radius_m)
    return near.groupBy("u", "v", "k", "aid").agg(F.avg(F.coalesce("p_yes", F.lit(0.5))).alias("p_yes"), F.countDistinct("image_id").alias("n_images"))


def cover(edges: DataFrame, from_labels: DataFrame, inferred: DataFrame) -> DataFrame:
    """Scores by labels, else by inference, else the prior, with their source.  Inputs: (u, v, k, aid, p_yes)."""
    aids = F.broadcast(prior_table(edges.sparkSession))  # five rows
    keys = ["u", "v", "k", "aid"]
    a, b = from_labels.select(*keys, F.col("p_yes").alias("_a")), inferred.select(*keys, F.col("p_yes").alias("_b"))
    joined = edges.select("u", "v", "k").join(aids, how="cross").join(a, keys, "left").join(b, keys, "left")
    return joined.select(*keys, F.coalesce("_a", "_b", "prior").alias("p_yes"), F.when(F.col("_a").isNotNull(), "labels").when(F.col("_b").isNotNull(), "inference").otherwise("prior").alias("source"))


def to_wide(scores: DataFrame) -> DataFrame:
    """One row per edge, one column per aid."""
    return scores.groupBy("u", "v", "k").agg(*(F.max(F.when(F.col("aid") == aid, F.col("p_yes"))).alias(aid) for aid in AID_KEYS))
