"""Shortest and minimax routes over street graphs.

Two designs for two shapes of the problem.  Many origin-destination pairs over a
city graph of bounded size: the graph goes to every executor (its edge count is
checked) and pairs are routed in parallel.  A larger graph, for pairs or for one
origin: rounds of relaxation by joins and minima, bucket by bucket of cost, until
all destinations are settled.  Each round writes what it changed to shared storage.

Over a larger graph pairs are first routed on its short edges alone, as many as the
first design takes.  A route found there is the graph's when it costs less than any
way over an edge left out would; the other pairs are routed by joins.

An edge table has (u, v, k, length, cost[, p_no]); it is undirected.  Of parallel
edges the one with the least cost is travelled (least length for the bottleneck
objective), then the lowest k, and the route keeps its k.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions import distributions as D
from kerbline.operators.spatial import nearest_planar
from kerbline.plans.ranks import bounds_of, percentiles, placed, range_of
from kerbline.plans.scratch import Scratch

#: Edges that a graph sent to every executor may have (about 200 MB there).
MAX_LOCAL_EDGES = 2_000_000
#: Short edges of a larger graph that are sent at once, in such bounds (without lengths, 16 bytes an arc: about 100 MB there).
NEAR = 1.5
#: Arcs a node from which a search takes nodes by levels of cost instead of one by one.
DENSE = 16
#: Classes of cost to an octave, by which short edges are counted.
CLASSES = 16
#: Mean arcs that a bucket of labels is wide.
BUCKET = 8.0
#: A bucket is wider by this factor than the one before, up to the width of ``BUCKET``.
GROWTH = 1.25
#: Labels (origins times nodes) that one pass of relaxation may hold on the shared disk.
LABELS = 4_000_000
STEP = "array<struct<u:bigint,v:bigint,k:int>>"


def objective_cost(objective: str, p_yes: Column, dist: Column | None = None, length: str = "length", **params) -> Column:
    """The additive cost of an edge; the bottleneck objective costs its p_no."""
    p = D.complete(p_yes, dist)
    n = F.col(length)
    if objective == "linear":
        return D.cost_linear(n, p[2], params.get("beta", 8.0))
    if objective == "logbarrier":
        return D.cost_logbarrier(n, p[2], params.get("lam", 50.0))
    if objective == "risk_split":
        return D.cost_risk_split(n, p[0], p[1], params.get("beta_no", 8.0), params.get("beta_unsure", 4.0))
    if objective == "bottleneck":
        return p[0]
    raise ValueError(f"unknown objective {objective}")


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, self-loops once; columns a, b beside the edge's own."""
    there = edges.withColumns({"a": F.col("u"), "b": F.col("v")})
    return there.unionByName(edges.where("u <> v").withColumns({"a": F.col("v"), "b": F.col("u")}))


def cheapest_parallel(edges: DataFrame, by: str = "cost") -> DataFrame:
    """One edge per pair of nodes: least ``by``, then lowest k."""
    rest = [c for c in edges.columns if c not in ("u", "v", by, "k")]
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    one = edges.groupBy(lo.alias("u"), hi.alias("v")).agg(F.min(F.struct(by, "k", *rest)).alias("e"))
    return one.select("u", "v", "e.*")


class _Graph:
    """Adjacency in flat arrays, a node's arcs by cost."""

    def __init__(self, nodes: np.ndarray, start: np.ndarray, to: np.ndarray, cost: np.ndarray, k: np.ndarray, length: np.ndarray | None = None):
        self.nodes, self.start, self.to, self.cost, self.k, self.length = nodes, start, to, cost, k, length
        self.search: tuple | None = None
        self.least = float(cost.min()) if len(cost) else 0.0
        self.reached = 0.0
        self.ends: list[tuple[float, np.ndarray]] | None = None

    @classmethod
    def of(cls, u: np.ndarray, v: np.ndarray, k: np.ndarray, cost: np.ndarray, length: np.ndarray | None = None) -> _Graph:
        nodes = np.unique(np.r_[u, v])
        u, v = (np.searchsorted(nodes, x).astype(np.int32) for x in (u, v))
        a = np.r_[u, v]
        order = np.lexsort((np.r_[cost, cost], a))
        start = np.searchsorted(a[order], np.arange(len(nodes) + 1))
        twice = lambda x, kind: np.r_[x, x].astype(kind)[order]
        return cls(nodes, start, np.r_[v, u][order], twice(cost, float), twice(k, np.int32), None if length is None else twice(length, float))

    def parts(self) -> tuple:
        return self.nodes, self.start, self.to, self.cost, self.k, self.length

    def _place(self, n: int) -> int | None:
        i = int(np.searchsorted(self.nodes, n))
        return i if i < len(self.nodes) and self.nodes[i] == n else None

    def _by_levels(self) -> bool:
        """Whether nodes may be settled many at a time: dense graphs whose least cost counts beside any route's."""
        n = len(self.nodes)
        return len(self.to) >= DENSE * n and self.least > 1e-13 * n * float(self.cost.max())

    def route(self, o: int, d: int, minimax: bool) -> list[dict] | None:
        """Steps of the best route; empty for o = d; None without a route.  Equal costs go to the lower node.

        The last origin's search is kept and goes on from where it stopped, so
        pairs of one origin cost one search together.
        """
        source, goal = self._place(o), self._place(d)
        if source is None or goal is None:
            return None
        if not minimax and self.ends is None and len(self.to):
            self.ends = []
            if self._by_levels():
                # arcs under a bound that grows from some DENSE a node; a route under the bound has no other arcs
                bound = float(np.partition(self.cost, DENSE * len(self.nodes) // 2)[DENSE * len(self.nodes) // 2])
                while bound < float(self.cost.max()):
                    bound *= 2
                    self.ends.append((bound, self.start[:-1] + np.diff(np.r_[0, np.cumsum(self.cost < bound)][self.start])))
                self.ends.append((math.inf, self.start[1:]))
        return self._settled_by_levels(source, goal) if not minimax and self.ends else self._settled_one_by_one(source, goal, minimax)

    def _grow(self, search: list, end: np.ndarray, bound: float, goal: int | None = None) -> None:
        """Take a search (costs, settled, open nodes) on over each node's arcs before ``end``, up to the bound or to where the goal is settled."""
        dist, settled, front = search
        while len(front) and (goal is None or not settled[goal]):
            low = float(dist[front].min())
            if low >= bound:
                break
            # no other node can still lead to one that lies within the least cost of the first
            now = (dist[front] == low) | (dist[front] < low + self.least)
            at, front = front[now], front[~now]
            settled[at] = True
            n = end[at] - self.start[at]
            arcs = np.repeat(self.start[at] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            to, cost = self.to[arcs], np.repeat(dist[at], n) + self.cost[arcs]
            better = cost < dist[to]
            to, cost = to[better], cost[better]
            fresh = np.unique(to[np.isinf(dist[to])])
            np.minimum.at(dist, to, cost)
            front = np.r_[front, fresh]
        search[2] = front

    def _begun(self, source: int) -> list:
        dist = np.full(len(self.nodes), np.inf)
        dist[source] = 0.0
        return [dist, np.zeros(len(self.nodes), bool), np.array([source])]

    def within(self, o: int, most: float) -> np.ndarray:
        """What every node costs from ``o``, ``most`` where it is that or more."""
        source = self._place(o)
        if source is None:
            return np.full(len(self.nodes), most)
        search = self._begun(source)
        self._grow(search, self.start[1:], most)
        return np.minimum(search[0], most)

    def _settled_by_levels(self, source: int, goal: int) -> list[dict] | None:
        if self.search is None or self.search[0] != source:
            self.search = source, {}
        for turn, (bound, end) in enumerate(self.ends):
            searches = self.search[1]
            if turn not in searches:
                searches[turn] = self._begun(source)
            self._grow(searches[turn], end, bound, goal)
            dist, settled, _ = searches[turn]
            if settled[goal] and dist[goal] < bound:
                break
        else:
            return None
        self.reached = dist[goal]
        steps, x = [], goal
        while x != source:
            arcs = np.arange(self.start[x], end[x])
            before = self.to[arcs]
            arcs = arcs[(dist[before] < dist[x]) & (dist[before] + self.cost[arcs] == dist[x])]
            before = self.to[arcs]
            i = arcs[np.lexsort((before, dist[before]))[0]]  # the one settled first
            steps.append({"u": int(self.nodes[self.to[i]]), "v": int(self.nodes[x]), "k": int(self.k[i])})
            x = int(self.to[i])
        return steps[::-1]

    def _settled_one_by_one(self, source: int, goal: int, minimax: bool) -> list[dict] | None:
        if self.search is None or self.search[0] != (source, minimax):
            self.search = (source, minimax), {source: (0.0, 0.0)}, {}, [(0.0, 0.0, source)], set()
        _, best, came, queue, settled = self.search
        while queue and goal not in settled:
            c, n, x = heapq.heappop(queue)
            if x in settled:
                continue
            settled.add(x)
            for i in range(self.start[x], self.start[x + 1]):
                y = int(self.to[i])
                new = (max(c, self.cost[i]), n + self.length[i]) if minimax else (c + self.cost[i], 0.0)
                if y not in best or new < best[y]:
                    best[y] = new
                    came[y] = (x, i)
                    heapq.heappush(queue, (*new, y))
        if goal not in settled:
            return None
        self.reached = best[goal][0]
        steps, x = [], goal
        while x != source:
            before, i = came[x]
            steps.append({"u": int(self.nodes[before]), "v": int(self.nodes[x]), "k": int(self.k[i])})
            x = before
        return steps[::-1]


def _solver(shared, names: list[str], minimax: bool, cost: str | None = None):
    """A function for mapInPandas that routes rows on broadcast graphs by the values of ``names``; with what routes cost as the column ``cost``."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graphs: dict[tuple, _Graph] = {}
        for batch in batches:
            steps, costs = [], []
            for key, o, d in zip(batch[names].itertuples(index=False, name=None) if names else [()] * len(batch), batch["o"], batch["d"], strict=True):
                if key not in graphs:
                    graphs[key] = _Graph(*shared.value[key])
                found = None if pd.isna(o) or pd.isna(d) else graphs[key].route(int(o), int(d), minimax)
                steps.append(found)
                costs.append(None if found is None else float(graphs[key].reached))
            yield batch.assign(steps=steps, **({cost: pd.Series(costs, batch.index, float)} if cost else {}))

    return solve


def route_pairs(
    pairs: DataFrame, edges: DataFrame, keys: list[str] = (), minimax: bool = False, max_edges: int = MAX_LOCAL_EDGES, scratch: Scratch | None = None, single: bool = False
) -> DataFrame:
    """Each (pair_idx, o, d) with ``steps`` (null without a route), for every value of ``keys`` in ``edges``.

    The graph is collected and sent to executors only when it has at most
    ``max_edges`` edges.  Over a larger one pairs are routed on its short edges and what is left by joins where ``scratch`` is
    given, and it is an error where it isn't.  ``single``: ``edges`` has one edge per pair of nodes, u < v.
    """
    one = edges if single else cheapest_parallel_by(edges, list(keys), "length" if minimax else "cost")
    if scratch is not None and one.limit(max_edges + 1).count() > max_edges:
        asked = _asked(pairs, one, list(keys), scratch)
        found = route_pairs_joined(asked, one, list(keys), minimax, scratch) if minimax else _route_large(asked, one, lambda: one, list(keys), scratch, int(max_edges * NEAR))
        return asked.join(found, "_r", "left").select(*pairs.columns, *(k for k in keys if k not in pairs.columns), "steps")
    rows = one.select(*keys, "u", "v", "k", "cost", "length").limit(max_edges + 1).toArrow()
    if rows.num_rows > max_edges:
        raise ValueError(f"over {max_edges} edges: give a scratch folder")
    spark, rows = edges.sparkSession, rows.to_pandas()
    parts = {k if isinstance(k, tuple) else (k,): g for k, g in rows.groupby(list(keys))} if keys else {(): rows}
    settings = spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in k) for k in parts] or [], one.select(*keys).schema) if keys else None
    asked = pairs.join(F.broadcast(settings), how="cross") if keys else pairs  # a row per objective and aid
    shared = spark.sparkContext.broadcast({k: _Graph.of(*(g[c].to_numpy() for c in ("u", "v", "k", "cost", "length"))).parts() for k, g in parts.items()})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields) + f", steps {STEP}"
    return _spread(asked, list(keys)).mapInPandas(_solver(shared, list(keys), minimax), schema)


def _spread(asked: DataFrame, keys: list[str]) -> DataFrame:
    """Few rows, much work each; all pairs of an origin, which are one search, in one task."""
    return asked.repartition(asked.sparkSession.sparkContext.defaultParallelism, *keys, "o").sortWithinPartitions(*keys, "o", "pair_idx")


def _asked(pairs: DataFrame, edges: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """The pairs for each setting in ``edges``, numbered by ``_r``."""
    every = pairs.join(edges.select(*keys).distinct(), how="cross") if keys else pairs
    return scratch.write(every.withColumn("_r", F.monotonically_increasing_id()), "asked")


def _near_bounds(classes: list, keys: list[str], budget: int) -> dict[tuple, tuple[float, float]]:
    """By setting, the cost up to which ``budget`` edges decide, and the least cost of an edge.

    ``classes``: edges by setting, whether an end of a pair is theirs, and class of cost, with their number ``n`` and ``least``.
    A way over an edge between nodes that are no pair's end has an edge before and one after it, so under a bound
    such edges need only be there up to the bound less twice the least cost.
    """
    out: dict[tuple, tuple[float, float]] = {}
    by_key: dict[tuple, list] = {}
    for r in classes:
        by_key.setdefault(tuple(r[k] for k in keys), []).append(r)
    for key, rows in by_key.items():
        least = min(r["least"] for r in rows)
        if least < 0 or any(r["least"] is None for r in rows):
            continue
        inner, own = (np.array([(r["least"], r["n"]) for r in rows if r["at_end"] == x]).reshape(-1, 2) for x in (False, True))
        count = lambda b: inner[inner[:, 0] < b - 2 * least, 1].sum() + own[own[:, 0] < b, 1].sum()  # noqa: E731, B023
        fits = [b for b in (*own[:, 0], *(inner[:, 0] + 2 * least), math.inf) if count(b) <= budget]
        if fits and count(max(fits)):
            out[key] = float(max(fits)), least
    return out


def _route_large(asked: DataFrame, weighed: DataFrame, one: Callable[[], DataFrame], keys: list[str], scratch: Scratch, budget: int) -> DataFrame:
    """(_r, steps) of the rows of ``asked`` that have a route by least sum of costs, over a graph of any size.

    Rows are routed on at most ``budget`` short edges of each setting, setting after setting.  A route that costs less than any way over an edge left
    out is the graph's, with all routes that cost as much beside it.  Of the rest, rows with a route are routed on all edges that may lie on a
    better one, and rows without by joins over ``one()``.  ``weighed``: keys, u, v, k, cost and length, parallel edges or not.
    """
    spark = asked.sparkSession
    ends = scratch.write(asked.select(F.explode(F.array(F.col("o").cast("long"), F.col("d").cast("long"))).alias("n")).where("n is not null").distinct(), "ends")
    flagged = weighed.join(ends.select(F.col("n").alias("u"), F.lit(True).alias("_eu")), "u", "left").join(ends.select(F.col("n").alias("v"), F.lit(True).alias("_ev")), "v", "left").withColumn("at_end", F.coalesce("_eu", "_ev", F.lit(False))).drop("_eu", "_ev")
    octave = F.when(F.col("cost") > 0, F.floor(F.log2("cost") * CLASSES).cast("int"))
    classes = flagged.groupBy(*keys, "at_end", octave.alias("class")).agg(F.count("*").alias("n"), F.min("cost").alias("least")).collect()  # as many as there are classes of cost
    bounds = _near_bounds(classes, keys, budget)

    def of_settings(values: dict[tuple, tuple], names: list[str]) -> DataFrame:
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in weighed.select(*keys).schema] + [f"{n} double" for n in names]
        return spark.createDataFrame([(*k, *map(float, v)) for k, v in values.items()], ", ".join(kinds))

    def meet(rows: DataFrame, values: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(values), keys) if keys else rows.join(F.broadcast(values), how="cross")  # one row a setting

    def on_short(rows: DataFrame, table: DataFrame, key: tuple, solve: Callable, schema: str) -> DataFrame:
        """``rows`` of a setting by ``solve``, with its edges in ``table`` (of at most ``budget``) on every executor."""
        own = reduce(Column.__and__, (F.col(k) == F.lit(x) for k, x in zip(keys, key, strict=True)), F.lit(True))
        edges = table.where(own).select("u", "v", "k", "cost").toArrow()
        shared = spark.sparkContext.broadcast({key: _Graph.of(*(edges[c].to_numpy() for c in ("u", "v", "k", "cost"))).parts()})
        del edges
        some = rows.where(own).withColumn("pair_idx", F.col("_r"))
        out = scratch.write(_spread(some, keys).mapInPandas(solve(shared), schema.format(*(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema))), "near-routes")
        shared.destroy()
        return out

    def routed(rows: DataFrame, table: DataFrame, settings: list[tuple]) -> DataFrame:
        narrow = rows.select(*keys, "_r", "o", "d")
        schema = ", ".join(["{}"] * (len(keys) + 4)) + f", steps {STEP}, _cost double"
        return reduce(DataFrame.unionByName, [on_short(narrow, table, key, lambda shared: _solver(shared, keys, False, "_cost"), schema).select(*keys, "_r", "steps", "_cost") for key in settings])

    if not bounds:
        return route_pairs_joined(asked, one(), keys, False, scratch)
    limits = of_settings({k: (b, b - 2 * least) for k, (b, least) in bounds.items()}, ["_b", "_i"])
    short = meet(flagged, limits).where(F.col("cost") < F.when(F.col("at_end"), F.col("_b")).otherwise(F.col("_i")))
    near = scratch.write(cheapest_parallel_by(short, keys, "cost"), "near")
    first = meet(routed(asked, near, list(bounds)), limits)
    first = scratch.write(first.select(*keys, "_r", "steps", "_cost", (F.col("_cost") < F.col("_b") * (1 - 1e-9)).alias("sure")), "first")
    done = [first.where("sure").select("_r", "steps")]
    left = asked.join(first.where("sure").select("_r"), "_r", "left_anti").join(first.select("_r", "_cost"), "_r", "left")
    left, seen = scratch.write_observed(left, "open", F.count("_cost").alias("known"))
    if seen["known"]:
        # a route that was found costs at most so much: edges that lie too far from the pairs' ends can't be on a better one
        some = left.where("_cost is not null").select(*keys, "_r", "o", "d", "_cost")
        most = {tuple(r[k] for k in keys): r["most"] for r in some.groupBy(*keys).agg(F.max("_cost").alias("most")).collect() if r["most"] is not None}
        # what leaves the short edges costs the bound less one edge at least
        caps = {k: bounds[k][0] - bounds[k][1] for k in most}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.select(*keys).schema) + (", " if keys else "") + "n bigint, f double, g double"
        far = reduce(DataFrame.unionByName, [on_short(some, near, key, lambda shared, key=key: _reach(shared, key, keys, caps[key]), schema) for key in most])
        far = scratch.write(far.groupBy(*keys, "n").agg(F.min("f").alias("f"), F.min("g").alias("g")), "reach")
        met = meet(weighed.select(*keys, "u", "v", "k", "cost", "length"), of_settings({k: (caps[k] - m, caps[k], m * 1e-9) for k, m in most.items()}, ["_f", "_g", "_slack"]))
        for c in ("u", "v"):
            met = met.join(far.select(*keys, F.col("n").alias(c), F.col("f").alias(f"f_{c}"), F.col("g").alias(f"g_{c}")), [*keys, c], "left").withColumns({f"f_{c}": F.coalesce(f"f_{c}", "_f"), f"g_{c}": F.coalesce(f"g_{c}", "_g")})
        able = met.where(F.col("cost") + F.least(F.col("f_u") + F.col("g_v"), F.col("f_v") + F.col("g_u")) <= F.col("_slack"))
        between, counted = scratch.write_observed(cheapest_parallel_by(able, keys, "cost"), "between")
        if counted["rows"] <= budget:
            done.append(routed(some, between, list(most)).where("steps is not null").select("_r", "steps"))
        else:
            done.append(route_pairs_joined(some, between, keys, False, scratch))
    if seen["rows"] > seen["known"]:
        # an end without any edge has no route
        there = scratch.write(flagged.where("at_end").select(*keys, F.explode(F.array("u", "v")).alias("n")).join(ends, "n", "left_semi").distinct(), "there")
        rest = left.where("_cost is null").drop("_cost").join(there.withColumnRenamed("n", "o"), [*keys, "o"], "left_semi").join(there.withColumnRenamed("n", "d"), [*keys, "d"], "left_semi")
        rest, seen = scratch.write_observed(rest, "rest")
        if seen["rows"]:
            done.append(route_pairs_joined(rest, one(), keys, False, scratch))
    return reduce(DataFrame.unionByName, done)


def _reach(shared, key: tuple, keys: list[str], cap: float):
    """A function for mapInPandas: by node the least cost from a row's origin less the row's route's, ``f``, and from a row's destination, ``g``; costs of ``cap`` and more as the cap."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, f, g, known = _Graph(*shared.value[key]), None, None, {}
        for batch in batches:
            for o, d, cost in zip(batch["o"], batch["d"], batch["_cost"], strict=True):
                if ("o", o) not in known:
                    known = {x: y for x, y in known.items() if x[0] == "d"} if len(known) < 64 else {}
                    known["o", o] = graph.within(int(o), cap)
                if ("d", d) not in known:
                    known["d", d] = graph.within(int(d), cap)
                one, two = known["o", o] - cost, known["d", d]
                f, g = (one, two) if f is None else (np.minimum(f, one), np.minimum(g, two))
        if f is not None:
            yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "n": graph.nodes, "f": f, "g": g})

    return solve


def routes_under(
    pairs: DataFrame, edges: DataFrame, name: str, costs: dict[object, Column], scratch: Scratch, *more: str, max_edges: int = MAX_LOCAL_EDGES
) -> tuple[DataFrame, DataFrame]:
    """Each pair's route under several costs, by the setting's name, as a table of those that have one; and the edges, by setting, that routes take (``travelled_by``).

    Over a large graph the edges are stored once and not for every setting, and only what may lie on a route is weighed.
    """
    stored, seen = scratch.write_observed(edges, "graph")
    if seen["rows"] * len(costs) <= max_edges:
        every = scratch.write(travelled_by(stored, name, costs, *more), "edges")
        return scratch.write(route_pairs(pairs, every, [name], max_edges=max_edges, scratch=scratch, single=True).where("steps is not null"), "routes"), every
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    listed = F.explode(F.array(*(F.struct(F.lit(x).alias(name), c.cast("double").alias("cost")) for x, c in costs.items())))
    weighed = stored.select(lo.alias("u"), hi.alias("v"), "k", "length", listed.alias("_s")).select(f"_s.{name}", "u", "v", "k", "length", "_s.cost")
    settings = pairs.sparkSession.createDataFrame([(x,) for x in costs], weighed.select(name).schema)
    asked = _asked(pairs, settings, [name], scratch)
    found = _route_large(asked, weighed, lambda: scratch.write(travelled_by(stored, name, costs), "edges"), [name], scratch, int(max_edges * NEAR))
    routes = scratch.write(asked.join(found, "_r").drop("_r").where("steps is not null"), "routes")
    taken = routes.select(F.explode("steps").alias("s")).select(F.least("s.u", "s.v").alias("u"), F.greatest("s.u", "s.v").alias("v")).distinct()
    # steps of the pairs alone: the edges are read once more for them
    own = stored.withColumns({"u": lo, "v": hi}).join(scratch.write(taken, "taken"), ["u", "v"], "left_semi")
    return routes, scratch.write(travelled_by(own, name, costs, *more), "edges")


class _Labels:
    """Least labels ``c`` by ``names``, as the tables of what each round changed.

    A change is written once; tables of like size are merged, so a label is
    written again as often as the logarithm of the changes, and not in every round.
    """

    def __init__(self, names: list[str], scratch: Scratch):
        self.names, self.scratch = names, scratch
        self.tables: list[tuple[DataFrame, int]] = []
        self.merged: list[DataFrame] = []

    def now(self, tables: list[DataFrame] | None = None) -> DataFrame:
        every = reduce(DataFrame.unionByName, tables or [t for t, _ in self.tables])
        return every.groupBy(*self.names).agg(F.min(F.struct("c", "pred", "k")).alias("n")).select(*self.names, "n.*")

    def add(self, table: DataFrame, rows: int) -> None:
        """Take up a round's changes.  What was merged the last time is no longer read by then."""
        self.scratch.drop(*self.merged)
        self.merged = []
        self.tables.append((table, rows))
        while len(self.tables) > 1 and self.tables[-2][1] < 2 * self.tables[-1][1]:
            (one, n), (two, m) = self.tables[-2:]
            self.tables[-2:] = [(self.scratch.write(self.now([one, two]), "labels"), n + m)]
            self.merged += [one, two]


def _relaxed(
    start: DataFrame, arcs: DataFrame, same: list[str], step: Column, scratch: Scratch, goals: DataFrame | None = None, width: tuple[float, float] | None = None, max_rounds: int = 100_000
) -> DataFrame:
    """Least labels ``c`` of (same, node) from ``start``, with the arc (pred, k) of the last improvement, over arcs (a, b, w, k).

    ``same``: columns that a label and an arc must share; the other label columns pass on.
    With ``width`` (the first bucket's and the widest) labels are relaxed in buckets: those under a bound, until none of them
    changes any more; they are settled, and the bound moves on, by ``GROWTH`` times as much as before.  A label that
    lies beyond the bound is not offered until its bucket comes, so no arc as long as the bound is looked at before.
    With ``goals`` (the columns of a label but ``c``) an origin whose goals are all settled takes
    no further part, and only its settled labels are given out.
    """
    names = [c for c in start.columns if c != "c"]
    origin = [c for c in names if c != "node"]
    labels = _Labels(names, scratch)
    first, seen = scratch.write_observed(start.withColumns({"pred": F.lit(None).cast("long"), "k": F.lit(None).cast("int")}), "labels", F.min("c").alias("least"), F.max("c").alias("most"))
    if not seen["rows"]:
        return first
    labels.add(first, seen["rows"])
    most = seen["most"]
    longest = arcs.agg(F.max("w")).first()[0] if width else None
    by = width[0] if width else math.inf
    bound, front, lower = seen["least"] + by, first, None
    left = scratch.write(goals.select(*names).distinct(), "goals") if goals is not None else None
    gone: list[DataFrame] = []
    for _ in range(max_rounds):
        here = front.where(F.col("c") < bound).drop("pred", "k").withColumnRenamed("node", "a")
        short = arcs if math.isinf(bound) else arcs.where(F.col("w") < bound)
        moved = here.join(short, [*same, "a"]).select(*(F.col("b").alias("node") if c == "node" else F.col(c) for c in names), step.alias("c"), F.col("a").alias("pred"), "k").where(F.col("c") < bound)
        if lower is not None:  # what lies under it was offered in its own bucket
            moved = moved.where(F.col("c") >= lower)
            lower = None
        offered = scratch.write(moved.groupBy(*names).agg(F.min(F.struct("c", "pred", "k")).alias("n")).select(*names, "n.*"), "offered")
        every = reduce(DataFrame.unionByName, [t for t, _ in labels.tables])
        known = every.join(offered.select(*names), names, "left_semi").groupBy(*names).agg(F.min("c").alias("old"))
        better = offered.join(known, names, "left").where("old is null or c < old").drop("old")
        front, seen = scratch.write_observed(better, "front", F.max("c").alias("most"))
        scratch.drop(offered)
        if seen["rows"]:
            labels.add(front, seen["rows"])
            most = max(most, seen["most"])
            continue
        # the bucket is settled: goals that it reached go, and what it settled offers the labels of the next one
        if math.isinf(bound) or longest is None or bound > most + longest:
            break
        now = labels.now()
        if left is not None:
            open_goals = left.join(now.select(*names), names, "left_anti")
            before_left, (left, seen) = left, scratch.write_observed(open_goals, "goals")
            ended = scratch.write(before_left.select(*origin).distinct().join(left.select(*origin).distinct(), origin, "left_anti").withColumn("_bound", F.lit(float(bound))), "ended")
            gone.append(ended)
            if not seen["rows"]:
                break
            now = now.join(left.select(*origin).distinct(), origin, "left_semi")
        front = now.where(F.col("c") + longest >= bound)
        lower, by = bound, min(by * GROWTH, width[1])
        bound += by
    else:
        raise RuntimeError("no fixed point within the allowed rounds")
    out = labels.now()
    if gone:
        ends = reduce(DataFrame.unionByName, gone)
        out = out.join(ends, origin, "left").where("_bound is null or c < _bound").drop("_bound")
    return scratch.write(out, "settled")


def _widths(arcs: DataFrame, keys: list[str]) -> tuple[float, float]:
    """Widths of the first and of the widest bucket: the first is about as wide as the fourth of a node's shortest arcs, which in a street graph are all."""
    nodes = arcs.select(*keys, "a").distinct().count()
    total, mean = arcs.agg(F.count("*"), F.avg("w")).first()
    if not total or not mean:
        return 1.0, math.inf
    few = min(1.0, 4 * nodes / total)
    short = arcs.agg(F.percentile_approx("w", F.lit(few))).first()[0]
    widest = BUCKET * mean
    return (widest if few == 1.0 else min(widest, max(short, mean * few) * 1.0001)), widest


def route_pairs_joined(asked: DataFrame, one: DataFrame, keys: list[str], minimax: bool, scratch: Scratch) -> DataFrame:
    """(_r, steps) of the rows of ``asked`` that have a route on a graph of any size: origins are relaxed together by joins and minima, and steps are read back by joins.

    ``one`` has one edge per pair of nodes (and keys).  Minimax routes are
    shortest among the arcs by which the least maximum is reached.  Of equal
    predecessors the one settled first counts, as in the local design.
    Origins are taken in as many passes as ``LABELS`` needs; of a pass only its routes stay on the disk.
    """
    arcs = scratch.write(both_ways(one).select(*keys, "a", "b", F.col("cost").alias("w"), "length", "k"), "arcs")
    origins, settings = asked.select(*keys, "o").distinct().count(), arcs.select(*keys).distinct().count() if keys else 1
    n_labels = origins * arcs.select(*keys, "a").distinct().count() // max(1, settings)
    n_passes, widths = max(1, -(-n_labels // LABELS)), _widths(arcs, keys)
    if n_passes == 1:
        return _joined_steps(asked, arcs, keys, minimax, scratch, widths)
    parts = []
    for i in range(n_passes):
        own = Scratch(asked.sparkSession, "pass")
        some = asked.where(F.pmod(F.xxhash64(F.col("o").cast("long")), F.lit(n_passes)) == i)
        parts.append(scratch.write(_joined_steps(some, arcs, keys, minimax, own, widths), "routed"))
        own.keep_only()
    return reduce(DataFrame.unionByName, parts)


def _joined_steps(asked: DataFrame, arcs: DataFrame, keys: list[str], minimax: bool, scratch: Scratch, widths: tuple[float, float]) -> DataFrame:
    """(_r, steps) of the rows of ``asked`` that have a route."""
    names = [*keys, "o", "node"]
    start = asked.select(*keys, F.col("o").cast("long").alias("o"), F.col("o").cast("long").alias("node")).distinct()
    start = start.join(arcs.select(*keys, F.col("a").alias("node")).distinct(), [*keys, "node"], "left_semi").select(*names, F.lit(0.0).alias("c"))
    goals = asked.select(*keys, F.col("o").cast("long").alias("o"), F.col("d").cast("long").alias("node")).where("node is not null")
    label = _relaxed(start, arcs.drop("length"), keys, F.greatest("c", "w") if minimax else F.col("c") + F.col("w"), scratch, goals, widths)
    into, join_keys = arcs, keys
    if minimax:
        ends = {c: label.select(*keys, "o", F.col("node").alias(c), F.col("c").alias(f"c_{c}")) for c in "ab"}
        most = label.agg(F.max("c")).first()[0]
        tight = arcs.where(F.col("w") <= F.lit(most)).join(ends["a"], [*keys, "a"]).join(ends["b"], [*keys, "o", "b"]).where((F.greatest("c_a", "w") == F.col("c_b")) & (F.col("b") != F.col("o")))
        into = scratch.write(tight.select(*keys, "o", "a", "b", F.col("length").alias("w"), "k", F.col("c_a").alias("first")), "tight")
        join_keys = [*keys, "o"]
        label = _relaxed(start, into.drop("first"), join_keys, F.col("c") + F.col("w"), scratch, goals, _widths(into, join_keys))
    else:
        into = into.withColumn("first", F.lit(0.0))
    # routes are read from their ends: of the arcs by which a node's label is reached the one whose own end was settled first
    known = label.select(*keys, "o", F.col("node").alias("a"), F.col("c").alias("c_a"))
    found = asked.select(*keys, "_r", F.col("o").cast("long").alias("o"), F.col("d").cast("long").alias("node")).join(label.select(*names, "c"), names)
    found = now = scratch.write(found, "found")
    steps = []
    while True:
        at = now.select(*names, "c").distinct().where("node <> o").withColumnRenamed("node", "b")
        back = at.join(into, [*join_keys, "b"]).where(F.col("w") <= F.col("c")).join(known, [*keys, "o", "a"]).where(F.col("c_a") + F.col("w") == F.col("c"))
        # arcs that add nothing could lead round in a circle; for nodes that have only these the last improvement's arc is taken
        best = back.where("c_a < c").groupBy(*keys, "o", F.col("b").alias("node")).agg(F.min(F.struct("first", "c_a", "a", "k")).alias("m"))
        last = label.join(at.select(*keys, "o", F.col("b").alias("node")), names, "left_semi").select(*names, "pred", "k")
        arc = last.join(best, names, "left").select(*names, F.coalesce("m.a", "pred").alias("pred"), F.when(F.col("m").isNotNull(), F.col("m.k")).otherwise(F.col("k")).alias("k"))
        step = now.drop("c").join(arc, names).where("pred is not null").select(*keys, "o", "_r", F.col("pred").alias("node"), F.col("node").alias("v"), "k", F.lit(-len(steps)).alias("pos"))
        step = step.join(label.select(*names, "c"), names)
        table, seen = scratch.write_observed(step, "steps")
        if not seen["rows"]:
            break
        steps.append(table)
        now = table.select(*keys, "o", "_r", "node", "c")
    out = found.select("_r")
    if steps:
        rows = reduce(DataFrame.unionByName, steps).groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("node").alias("u"), "v", "k"))).alias("s"))  # one route
        out = out.join(rows, "_r", "left").select("_r", F.coalesce(F.transform("s", lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"), x["k"].cast("int").alias("k"))), F.array().cast(STEP)).alias("steps"))
    else:
        out = out.withColumn("steps", F.array().cast(STEP))
    return out


def cheapest_parallel_by(edges: DataFrame, keys: list[str], by: str) -> DataFrame:
    rest = [c for c in ("cost", "length") if c != by]
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    one = edges.groupBy(*keys, lo.alias("u"), hi.alias("v")).agg(F.min(F.struct(by, "k", *rest)).alias("e"))
    return one.select(*keys, "u", "v", "e.*")


def distances_from(edges: DataFrame, source: int, scratch: Scratch, minimax: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """(node, cost, pred, k) of every node that ``source`` reaches, by rounds of relaxation; for graphs of any size.

    Only nodes whose cost fell in the last round relax their neighbours.  ``pred``
    is the lowest of equal predecessors.
    """
    arcs = scratch.write(both_ways(cheapest_parallel(edges.select("u", "v", "k", "cost"))).select("a", "b", F.col("cost").alias("w"), "k"), "arcs")
    start = edges.sparkSession.createDataFrame([(source, 0.0)], "node long, c double")
    step = F.greatest("c", "w") if minimax else F.col("c") + F.col("w")
    return _relaxed(start, arcs, [], step, scratch, max_rounds=max_rounds).select("node", F.col("c").alias("cost"), "pred", "k")


def route_steps(routes: DataFrame, *keys: str) -> DataFrame:
    """One row per step of each route: keys, pos, u, v, k."""
    return routes.select(*keys, F.posexplode("steps").alias("pos", "s")).select(*keys, "pos", "s.u", "s.v", "s.k")


def route_stats(routes: DataFrame, edges: DataFrame, keys: list[str], prior: Column | float = 0.5, edge_keys: list[str] = ()) -> DataFrame:
    """Per route: length, unweighted mean p_yes (the prior without edges), steps.  ``edges``: edge_keys, u, v, k, length, p_yes."""
    steps = route_steps(routes.where("steps is not null"), *keys)
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    own = edges.select(*edge_keys, lo.alias("_u"), hi.alias("_v"), F.col("k").alias("_k"), "length", "p_yes")
    canon = steps.withColumns({"_u": lo, "_v": hi, "_k": F.col("k")}).drop("u", "v", "k")
    joined = canon.join(own, [*edge_keys, "_u", "_v", "_k"])
    agg = joined.groupBy(*keys).agg(F.sum("length").alias("length"), F.avg("p_yes").alias("p_yes"), F.count("*").alias("n_steps"))
    every = routes.where("steps is not null").select(*keys)
    p = F.lit(prior) if isinstance(prior, float) else prior
    return every.join(agg, keys, "left").select(*keys, F.coalesce("length", F.lit(0.0)).alias("length"), F.coalesce("p_yes", p).alias("p_yes"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"))


def travelled_by(edges: DataFrame, name: str, costs: dict[object, Column], *more: str) -> DataFrame:
    """``travelled`` under several costs, by the setting's name, from one aggregation of the edges."""
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    least = [F.min(F.struct(c.cast("double").alias("cost"), "k", "length", *more)).alias(f"e{i}") for i, c in enumerate(costs.values())]
    one = edges.groupBy(lo.alias("u"), hi.alias("v")).agg(*least)
    rows = F.array(*(F.struct(F.lit(x).alias(name), F.col(f"e{i}").alias("e")) for i, x in enumerate(costs)))
    return one.select("u", "v", F.explode(rows).alias("s")).select(f"s.{name}", "u", "v", "s.e.*")


def travelled(edges: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """The edge that a route takes between two nodes, with the columns ``more``: least cost, then lowest k, then least length."""
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    one = edges.groupBy(*keys, lo.alias("u"), hi.alias("v")).agg(F.min(F.struct("cost", "k", "length", *more)).alias("e"))
    return one.select(*keys, "u", "v", "e.*")


def cross_evaluate(pairs: DataFrame, edges: DataFrame, scratch: Scratch, a: str = "p_a", b: str = "p_b", beta: float = 8.0) -> DataFrame:
    """Routes by length and by the linear cost under two scores, each reported under both; a row for each routed pair.

    ``edges``: u, v, k, length and both scores.  Lengths, detours of the scored
    routes in %, every route's mean score under ``a``, the scored routes' under
    ``b``, the gap of the first score between them, and whether they are one route.
    """
    rules = {"std": F.col("length"), **{r: objective_cost("linear", F.col(p), beta=beta) for r, p in (("a", a), ("b", b))}}
    routes, every = routes_under(pairs, edges.withColumns({"p_a": F.col(a), "p_b": F.col(b)}), "rule", rules, scratch, "p_a", "p_b")
    stats = None
    for name in ("a", "b"):
        one = route_stats(routes, every.withColumn("p_yes", F.col(f"p_{name}")), ["pair_idx", "rule"], edge_keys=["rule"])
        one = one.select("pair_idx", "rule", *(["length"] if name == "a" else []), F.col("p_yes").alias(f"by_{name}"))
        stats = one if stats is None else stats.join(one, ["pair_idx", "rule"])
    found = stats.join(routes.select("pair_idx", "rule", "steps"), ["pair_idx", "rule"])
    of = lambda rule, c: F.max(F.when(F.col("rule") == rule, F.col(c)))
    path = lambda rule: F.max_by(F.transform("steps", lambda s: s["v"]), F.when(F.col("rule") == rule, 1))  # noqa: E731  the one row of the rule
    wide = found.groupBy("pair_idx").agg(
        *(of(r, "length").alias(f"{r}_length") for r in ("std", "a", "b")), *(of(r, "by_a").alias(f"{r}_by_a") for r in ("std", "a", "b")), *(of(r, "by_b").alias(f"{r}_by_b") for r in ("a", "b")), (path("a") == path("b")).alias("same_route"),
    )
    longer = lambda r: 100 * (F.col(f"{r}_length") - F.col("std_length")) / F.nullif(F.col("std_length"), F.lit(0.0))
    return wide.withColumns({"a_detour_pct": longer("a"), "b_detour_pct": longer("b"), "gap": F.col("a_by_a") - F.col("b_by_a")})


def routed_sweep(pairs: DataFrame, edges: DataFrame, betas: list[float], scratch: Scratch, score: str = "p_yes") -> DataFrame:
    """Per pair and barrier cost: the scored route's detour in % of the shortest one (0 where that has no length) and its gain of mean score."""
    weighed = {float(x): objective_cost("linear", F.col(score), beta=float(x)) for x in [0.0, *betas]}
    routes, every = routes_under(pairs, edges.withColumn("p_yes", F.col(score)), "beta", weighed, scratch, "p_yes")
    stats = scratch.write(route_stats(routes, every, ["beta", "pair_idx"], edge_keys=["beta"]), "stats")
    base = stats.where("beta = 0").select("pair_idx", F.col("length").alias("std_length"), F.col("p_yes").alias("std_p"))
    detour = F.when(F.col("std_length") > 0, 100 * (F.col("length") - F.col("std_length")) / F.col("std_length")).otherwise(0.0)
    return stats.where("beta > 0").join(base, "pair_idx").select("beta", "pair_idx", detour.alias("delta_dist_pct"), (F.col("p_yes") - F.col("std_p")).alias("delta_access"))


def edge_set(steps: Column) -> Column:
    """Undirected edges of a route, each once."""
    return F.array_distinct(F.transform(steps, lambda s: F.struct(F.least(s["u"], s["v"]).alias("a"), F.greatest(s["u"], s["v"]).alias("b"))))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 1 when both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(n, F.lit(0)))


def monte_carlo_summary(compared: DataFrame, keys: list[str], improved_over: float = 0.001, digits: int = 4) -> DataFrame:
    """Per key from (std_length, std_p, acc_length, acc_p): n, % improved, mean, median and quartiles of the gain, mean % detour."""
    gain = F.col("acc_p") - F.col("std_p")
    detour = 100 * (F.col("acc_length") - F.col("std_length")) / F.greatest(F.col("std_length"), F.lit(1.0))
    r = lambda c, name: F.round(c, digits).alias(name)
    means = compared.groupBy(*keys).agg(
        F.count("*").alias("n"), r(100 * F.avg((gain > improved_over).cast("double")), "pct_improved"), r(F.avg(gain), "mean_gain"), r(F.avg(detour), "mean_detour_pct")
    )
    spread = percentiles(compared.select(*keys, gain.alias("_gain")), keys, "_gain", {"median_gain": 0.5, "p25_gain": 0.25, "p75_gain": 0.75})
    return means.join(spread.select(*keys, *(r(F.col(c), c) for c in ("median_gain", "p25_gain", "p75_gain"))), keys, "left")


def routable(pairs: DataFrame, records: DataFrame, value: str, key: str = "pair_idx") -> DataFrame:
    """Pairs for which some record of another router has a value."""
    return pairs.join(records.where(F.col(value).isNotNull()).select(key).distinct(), key, "left_semi")


def no_path_counts(routes: DataFrame, *keys: str) -> DataFrame:
    return routes.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("steps").isNull()).alias("no_path"))


def stitch(waypoints: DataFrame, edges: DataFrame, route_id: str = "route_id") -> DataFrame:
    """Ordered node waypoints (array) chained by shortest routes; null when a part has none or fewer than two waypoints are left."""
    lists = waypoints.select(route_id, F.array_distinct("nodes").alias("nodes")).where(F.size("nodes") >= 2)
    legs = lists.select(route_id, F.posexplode(F.zip_with(F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("nodes", F.lit(2), F.size("nodes") - 1), lambda a, b: F.struct(a.alias("o"), b.alias("d")))).alias("leg", "x"))
    pairs = legs.select(route_id, "leg", F.col("x.o").alias("o"), F.col("x.d").alias("d"), F.xxhash64(route_id, "leg").alias("pair_idx"))
    routed = route_pairs(pairs, edges, scratch=Scratch(edges.sparkSession, "stitch"))
    whole = routed.groupBy(route_id).agg(
        F.bool_and(F.col("steps").isNotNull()).alias("ok"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("leg", "steps"))), lambda x: x["steps"])).alias("steps")
    )
    return waypoints.select(route_id).join(whole, route_id, "left").select(route_id, F.when(F.col("ok"), F.col("steps")).alias("steps"))


def snapped(lines: DataFrame, nodes: DataFrame, parts: int = 10, route_id: str = "route_id") -> DataFrame:
    """Polylines as ordered nodes: (route_id, nodes), from ``coords``, an array<struct<lat, lon>>.

    Every k-th vertex from the first, k being a ``parts``-th of their number, goes to its nearest node
    by squared degrees; a node that came before is left out.  ``nodes``: node, lat, lon.
    """
    every = F.greatest(F.lit(1), F.floor(F.size("coords") / parts).cast("int"))
    picked = lines.where(F.size("coords") > 1).select(route_id, F.posexplode("coords").alias("pos", "c"), every.alias("_k")).where(F.col("pos") % F.col("_k") == 0)
    points = picked.select(F.struct(route_id, "pos").alias("_at"), F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"))
    near = nearest_planar(points, nodes.select("node", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "_at", "node")
    listed = near.groupBy(F.col(f"_at.{route_id}").alias(route_id)).agg(F.array_sort(F.collect_list(F.struct(F.col("_at.pos").alias("pos"), "node"))).alias("s"))  # some ten of a line
    return listed.select(route_id, F.array_distinct(F.transform("s", lambda x: x["node"])).alias("nodes"))


def snapped_routes(lines: DataFrame, nodes: DataFrame, edges: DataFrame, parts: int = 10, route_id: str = "route_id") -> DataFrame:
    """Lines of another router brought onto the graph: route_id, length and mean p_yes of the stitched shortest legs, steps, and whether there is such a route.

    ``edges``: u, v, k, length, p_yes.
    """
    scratch = Scratch(edges.sparkSession, "snapped")
    one = scratch.write(travelled(edges.withColumn("cost", F.col("length")), [], "p_yes"), "edges")
    routes = scratch.write(stitch(snapped(lines, nodes, parts, route_id), one, route_id), "routes")
    stats = route_stats(routes.where(F.size("steps") > 0), one, [route_id])
    every = lines.select(route_id).join(stats, route_id, "left")
    return every.select(route_id, "length", "p_yes", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), F.col("length").isNotNull().alias("routed"))


def external_report(snapped_lines: DataFrame, reported: DataFrame, route_id: str = "route_id") -> DataFrame:
    """One row: lines of another router, those brought onto the graph, and the mean gap in % of their length from what it reported (``length``)."""
    both = snapped_lines.join(reported.select(route_id, F.col("length").alias("_told")), route_id, "left")
    gap = 100 * F.try_divide(F.col("length") - F.col("_told"), F.col("_told"))
    return both.agg(F.count("*").alias("n"), F.count_if("routed").alias("routed"), F.avg(gap).alias("mean_gap_pct"), F.avg("p_yes").alias("mean_p_yes"))


def sample_pairs(nodes: DataFrame, n: int, min_dist_m: float, seed: int = 42, attempts: int = 20) -> DataFrame:
    """The first ``n`` of attempts * n hashed candidate pairs that lie at least ``min_dist_m`` apart: (pair_idx, o, d)."""
    from kerbline.functions.geo import haversine_m

    spark = nodes.sparkSession
    ranked = placed(nodes.select("node", "lat", "lon"), [], range_of(F.col("node"), bounds_of(nodes, "node")), ["node"], "i").withColumn("i", F.col("i") + 1)
    total = nodes.count()
    pick = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(max(total, 1))) + 1
    drawn = spark.range(attempts * n).select("id", pick(1).alias("i1"), pick(2).alias("i2"))
    one, two = (ranked.select(*(F.col(c).alias(f"{c}{k}") for c in ranked.columns)) for k in (1, 2))
    far = drawn.join(one, "i1").join(two, "i2").where((F.col("i1") != F.col("i2")) & (haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) >= min_dist_m))
    kept = far.orderBy("id").limit(n)
    return kept.select("id", F.col("node1").alias("o"), F.col("node2").alias("d")).withColumn("pair_idx", F.col("id").cast("int")).select("pair_idx", "o", "d")
