"""Connected components by alternating large-star and small-star.

Both steps are a minimum per node (combined before the shuffle) and a join back,
so a node with very many neighbours is never gathered in one place.  Each round
is written to the shared scratch folder; only a count and a checksum of the
edges come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.plans.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of these; all edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that occurs in ``links``; component is the smallest id reachable.

    Links to oneself and repeated links do no harm; null ends are left out.
    """
    mark = F.expr("bit_xor(xxhash64(u, v))").alias("mark")
    start = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct()
    edges, before = scratch.write_observed(start, "edges", mark)
    while before["rows"]:
        following, now = scratch.write_observed(_small_star(_large_star(edges)), "edges", mark)
        scratch.drop(edges)
        edges = following
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def join_groups(
    members: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, sketch: DataFrame | None = None, near: Callable[[str, str, Column], Column] | None = None,
    dense: Callable[[DataFrame], DataFrame] | None = None, dense_from: int = 48, rounds: int = 2,
    finer: tuple[int, Callable[[DataFrame], DataFrame], Callable[[str, str], Column]] | None = None, complete: bool = True,
) -> DataFrame:
    """Components of the verified links among items that share a bucket, without listing all pairs of a bucket.

    ``members``: (bucket, id), the candidates: every link must have some bucket
    in common.  Rows with a column ``full`` that is false are only compared with first members.  ``verify(pairs)`` keeps the true links of pairs (a, b), a < b.
    ``sketch`` (id, sk) and ``near(sk of a, sk of b, members of the bucket)`` rule
    pairs out inside the joins; a link is found only if they let it pass.  Members
    count as 1 where they are compared with first members.

    Each member is first checked against its buckets' first members, the one it
    shares most buckets with before the others; ids found connected are not
    compared again.  Later rounds choose other members to check against, up to ``rounds`` or
    until one finds nothing.  What is still open is compared completely, but for pairs already in one component:
    by ``dense`` for clusters around the first member of buckets with at least
    ``dense_from`` members, pair by pair for the rest.

    ``finer`` is (size, sketches, near): there, pairs in buckets of at least that size must be
    near by sketches of their own as well, (id, fk) made for the ids in such buckets.

    Without ``complete`` what is still open after the rounds stays so, for a caller that compares it in another way.

    Null ids and null buckets are left out; repeated rows do no harm; an empty
    table gives an empty one.
    """
    members = members.select("bucket", "id", *(F.col(c) for c in ("full",) if "full" in members.columns))
    links: list[DataFrame] = []
    checked: list[DataFrame] = []
    components: DataFrame | None = None

    def component_of(rows: DataFrame, key: str, out: str) -> DataFrame:
        if components is None:
            return rows.withColumn(out, F.col(key))
        c = components.select(F.col("id").alias(key), F.col("component").alias(out))
        return rows.join(c, key, "left").withColumn(out, F.coalesce(out, key))

    def open_buckets() -> tuple[DataFrame, int]:
        """Members of buckets that hold more than one component, with their components and the bucket's size."""
        rows = component_of(members, "id", "c")
        mixed = rows.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low < high").select("bucket", "size")
        found = rows.join(mixed, "bucket").select("bucket", "id", "c", "size", (F.col("full") if "full" in members.columns else F.lit(True)).alias("full"))
        found = found.withColumn("sk", F.lit(0)) if sketch is None else found.join(sketch.select("id", "sk"), "id")
        table, seen = scratch.write_observed(found, "open")
        return table, seen["rows"]

    def alike(a: str, b: str, size: Column | None = None) -> Column:
        return near(a, b, F.lit(1) if size is None else size) if near else F.lit(True)

    def connect(found: DataFrame, label: str) -> int:
        nonlocal components
        table, seen = scratch.write_observed(found, label)
        if seen["rows"]:
            links.append(table)
            scratch.drop(components)
            components = scratch.write(connected_components(reduce(DataFrame.unionByName, links), scratch), "components")
        return seen["rows"]

    def settle(pairs: DataFrame) -> int:
        """Verify pairs that were not verified before, and connect what the true links connect; how many of these there were."""
        for done in checked:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        table, seen = scratch.write_observed(pairs.select("a", "b"), "pairs")
        if not seen["rows"]:
            return 0
        checked.append(table)
        return connect(verify(table), "links")

    n = 1
    for turn in range(rounds):
        rows, n = open_buckets()
        if not n:
            break
        order = F.col("id") if turn == 0 else F.xxhash64(F.lit(turn), "id")
        first = F.min(F.struct(order.alias("o"), F.col("id").alias("lead"), F.col("c").alias("lead_c"), F.col("sk").alias("lead_sk"))).alias("m")
        leaders = rows.groupBy("bucket").agg(first).select("bucket", "m.lead", "m.lead_c", "m.lead_sk")
        met = rows.join(leaders, (rows["bucket"] == leaders["bucket"]) & (F.col("c") != F.col("lead_c")) & alike("sk", "lead_sk"))
        stars = met.select("id", F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
        if turn == 0:
            stars = scratch.write(stars.groupBy("id", "a", "b").agg(F.count("*").alias("shared")), "stars")
            settle(stars.groupBy("id").agg(F.max(F.struct("shared", "a", "b")).alias("best")).select("best.a", "best.b").distinct())
            stars = component_of(component_of(stars, "a", "ca"), "b", "cb").where("ca <> cb")
        new = settle(stars.select("a", "b").distinct())
        scratch.drop(rows)
        if turn and not new:
            break
    if n and complete:
        rows, n = open_buckets()
        rows = rows.where("full").drop("full")
        if n and dense is not None:
            large = rows.where(F.col("size") >= dense_from)
            hubs = large.groupBy("bucket").agg(F.min(F.struct("id", "sk")).alias("h")).select("bucket", F.col("h.id").alias("hub"), F.col("h.sk").alias("hub_sk"))
            close = large.join(hubs, (large["bucket"] == hubs["bucket"]) & (F.col("id") != F.col("hub")) & alike("sk", "hub_sk"))
            clusters = connected_components(close.select(F.col("hub").alias("a"), F.col("id").alias("b")), scratch).select("id", F.col("component").alias("cluster"))
            connect(dense(component_of(clusters, "id", "c")), "links")
            rows = component_of(rows.drop("c").join(clusters, "id", "left").withColumn("cluster", F.coalesce("cluster", "id")), "id", "c")
        else:
            rows = rows.withColumn("cluster", F.col("id"))
        if n:
            apart = (F.col("id") < F.col("id_b")) & (F.col("c") != F.col("c_b")) & (F.col("cluster") != F.col("cluster_b"))
            if finer:
                least, sketches, near_too = finer
                own = scratch.write(sketches(rows.where(F.col("size") >= least).select("id").distinct()), "finer")
                rows = rows.join(own, "id", "left")
                apart &= (F.col("size") < least) | near_too("fk", "fk_b")
            other = rows.select(*(F.col(c).alias(f"{c}_b") for c in ("bucket", "id", "c", "cluster", "sk", *(["fk"] if finer else []))))
            met = rows.join(other, (F.col("bucket") == F.col("bucket_b")) & apart & alike("sk", "sk_b", F.col("size")))
            settle(met.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct())
    if components is None:
        return members.select("id", F.col("id").alias("component")).limit(0)
    return components
