"""Points to the nearest or to all places within a radius, through cells of space.

A distance condition alone would compare every pair.  Here each place is filed
under a cell and each point looks into the cells that its radius can reach, so
the join is an equi-join on cells and the exact distance decides what stays.
Points of the earth are filed by where they lie in space, in cubes as wide as the
radius: the straight line is never longer than the way along the ground, so what
is in reach lies in a neighbouring cube, at the poles and over the date line as
anywhere else.

Cells follow density.  Where a cell's points and places make more pairs than one
task should see, both are dealt over blocks and every block of points meets
every block of places.  Where only the nearest are wanted, cells are split until they hold few
places, a point looks as far as the smallest cell around it that holds enough, and what may be
near a cell is listed once for its points; so the pairs looked at follow the points, and not
points times places.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.functions.constants import EARTH_RADIUS_M
from kerbline.functions.geo import haversine_m
from kerbline.plans.scratch import Scratch

#: Places, and points, of one block of a cell: a task's keys give at most the square of it in pairs each.
SIDE = 2000
#: Tasks that pairs are dealt over at most; each has about the pairs of one block, or more where this would take more tasks.
MOST_TASKS = 4096
#: Wider cells grow by this factor from level to level; narrower ones are cut by the other.
GROWTH, SPLIT = 4.0, 2.0
#: Where the nearest k are wanted, cells with over k / FEW places are cut, until no more than a TAIL-th of the places is in such cells.
FEW, TAIL = 4, 10
#: Cells so many times as wide hold in their neighbours all that k places around a cell leave to look at: more than 2 * sqrt(3).
REACH = 4


@dataclass(frozen=True)
class Space:
    """Coordinates to file by, the distance that decides, the widest coordinate difference of two things at a distance, and the smallest cell worth making."""

    coordinates: Callable[[Column, Column], list[Column]]
    distance: Callable[[Column, Column, Column, Column], Column]
    spread: Callable[[float], float]
    limit: Callable[[float], float]
    least: float
    most: float
    radius: float | None = None

    def cell(self, lat: Column, lon: Column, step: float) -> list[Column]:
        return [F.floor(x / step).cast("long") for x in self.coordinates(lat, lon)]

    @property
    def names(self) -> list[str]:
        return [f"_c{i}" for i in range(2 if self.radius is None else 3)]

    def around(self, cells: DataFrame, step: float | Column) -> DataFrame:
        """A row for each neighbour of a cell, itself included; on the sphere, of those that its surface meets."""
        shifts = F.array(*(F.struct(*(F.lit(d).cast("long").alias(n) for n, d in zip(self.names, ds, strict=True))) for ds in itertools.product((-1, 0, 1), repeat=len(self.names))))
        near = cells.withColumn("_s", F.explode(shifts)).withColumns({n: F.col(n) + F.col(f"_s.{n}") for n in self.names}).drop("_s")
        if self.radius is None:
            return near
        low, high, slack = F.lit(0.0), F.lit(0.0), 1.0
        for n in self.names:
            a, b = F.col(n) * step, (F.col(n) + 1) * step
            low += F.when((a <= 0) & (b >= 0), 0.0).otherwise(F.least(a * a, b * b))
            high += F.greatest(a * a, b * b)
        return near.where((low <= (self.radius + slack) ** 2) & (high >= (self.radius - slack) ** 2))


def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    a, o = F.radians(lat), F.radians(lon)
    return [EARTH_RADIUS_M * F.cos(a) * F.cos(o), EARTH_RADIUS_M * F.cos(a) * F.sin(o), EARTH_RADIUS_M * F.sin(a)]


def _squared_degrees(lat: Column, lon: Column, p_lat: Column, p_lon: Column) -> Column:
    return (p_lat - lat) * (p_lat - lat) + (p_lon - lon) * (p_lon - lon)


def _ground(line: float) -> float:
    """Metres along the ground that a straight line of ``line`` metres can span."""
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, line / (2 * EARTH_RADIUS_M)))


#: Metres on the earth, and squared differences of degrees on a flat map.
SPHERE = Space(_on_sphere, haversine_m, lambda r: r, _ground, 0.01, 2.1 * EARTH_RADIUS_M, EARTH_RADIUS_M)
FLAT = Space(lambda lat, lon: [lat, lon], _squared_degrees, math.sqrt, lambda step: step * step, 1e-7, 800.0)

POINT, PLACE = ("lat", "lon"), ("p_lat", "p_lon")


def _filed(rows: DataFrame, space: Space, step: float, at: tuple[str, str]) -> DataFrame:
    return rows.withColumns(dict(zip(space.names, space.cell(F.col(at[0]), F.col(at[1]), step), strict=True)))


def _pairs(points: DataFrame, places: DataFrame, reach: float, space: Space) -> DataFrame:
    """All (point, place) pairs with ``dist`` at most ``reach``."""
    step = min(max(space.spread(reach), space.least), space.most) * (1 + 1e-9) + space.least * 1e-4
    names = space.names
    filed, own = _filed(places, space, step, PLACE), _filed(points, space, step, POINT)
    probing = space.around(own, step)
    met = space.around(own.groupBy(*names).agg(F.count("*").alias("_n")), step).groupBy(*names).agg(F.sum("_n").alias("_points"))
    cells = filed.groupBy(*names).agg(F.count("*").alias("_places")).join(met, names).withColumn("_n", F.col("_points") * F.col("_places"))
    total, most = cells.agg(F.sum(F.col("_n").cast("double")), F.max("_n")).first()
    keys = names
    if (most or 0) > SIDE * SIDE:
        dense = cells.where(F.col("_n") > SIDE * SIDE)
        blocks = lambda c: F.ceil(F.col(c) / SIDE).cast("int")
        dense = Scratch(points.sparkSession, "dense-cells").write(dense.select(*names, blocks("_points").alias("_bp"), blocks("_places").alias("_bq")), "cells")

        def dealt(rows: DataFrame, columns: list[str], own_block: str, other_block: str, counts: tuple[str, str]) -> DataFrame:
            mine = F.pmod(F.xxhash64(*columns), F.coalesce(F.col(counts[0]), F.lit(1))).cast("int")
            every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(counts[1]), F.lit(1)) - 1))
            return rows.join(dense, names, "left").withColumn(own_block, mine).withColumn(other_block, every).drop("_bp", "_bq")

        probing = dealt(probing, points.columns, "_p", "_q", ("_bp", "_bq"))
        filed = dealt(filed, places.columns, "_q", "_p", ("_bq", "_bp"))
        keys = [*names, "_p", "_q"]
    # few rows make many pairs: as many partitions as these need, which are not merged for being small
    parts = min(MOST_TASKS, math.ceil((total or 0) / (SIDE * SIDE)))
    if parts > 1:
        probing, filed = probing.repartition(parts, *keys), filed.repartition(parts, *keys).hint("shuffle_hash")
    d = space.distance(*(F.col(c) for c in (*POINT, *PLACE)))
    return probing.join(filed, keys).drop(*keys).withColumn("dist", d).where(F.col("dist") <= reach)


def within(points: DataFrame, places: DataFrame, radius_m: float) -> DataFrame:
    """All (point, place) pairs at most ``radius_m`` apart, with ``dist``, anywhere on the earth.

    Points have (lat, lon), places (p_lat, p_lon); other columns pass.  Rows without a position meet nothing.
    """
    return _pairs(points, places, radius_m, SPHERE)


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows to join by sorting.  Files and shuffles of points and cells are far smaller than their rows in memory, so Spark's size check would have the driver broadcast millions of them."""
    return rows.hint("merge")


def _levels(places: DataFrame, space: Space, start: float, k: int, top: float) -> tuple[list[float], int, DataFrame, bool]:
    """Widths of cells, narrowest first; how many are no wider than ``start``; the cells by level that with their neighbours hold ``k`` places; whether the narrowest are still crowded.

    Wider cells go up to ``top`` and come from the counts; narrower ones are made only inside cells with over
    ``k / FEW`` places, until a ``TAIL``-th of the places at most lies in such cells, and none in cells with over ``SIDE``.
    """
    scratch = Scratch(places.sparkSession, "cells")
    names, step, inside, few = space.names, start, places.select(*PLACE), max(1, k // FEW)
    counted = lambda rows, width: _filed(rows, space, width, PLACE).groupBy(*names).agg(F.count("*").alias("_n"))
    first = scratch.write(counted(inside, step), "counts")
    steps, found = [start], [first]
    total = first.agg(F.sum("_n")).first()[0] or 0
    while True:
        some, most = found[0].where(F.col("_n") > few).agg(F.sum("_n"), F.max("_n")).first()
        crowded = (most or 0) > SIDE
        if step / SPLIT < space.least or not (crowded or (some or 0) * TAIL > total):
            break
        inside = _filed(inside, space, step, PLACE).join(_sorted(found[0].where(F.col("_n") > few).select(*names)), names, "left_semi").select(*PLACE)
        step /= SPLIT
        steps, found = [step, *steps], [scratch.write(counted(inside, step), "counts"), *found]
    narrow = len(steps)
    wide = [start * GROWTH**i for i in range(1, 64) if start * GROWTH ** (i - 1) < top]
    tables = [t.withColumn("_level", F.lit(i)) for i, t in enumerate(found)]
    if wide:
        grown = F.explode(F.array(*(F.struct(F.lit(narrow + i).alias("_level"), *(F.floor(F.col(n) / GROWTH ** (i + 1)).cast("long").alias(n) for n in names)) for i in range(len(wide)))))
        tables.append(first.select("_n", grown.alias("_g")).select("_g.*", "_n").groupBy("_level", *names).agg(F.sum("_n").alias("_n")).select(*names, "_n", "_level"))
    steps += wide
    width = F.array(*(F.lit(x) for x in steps))[F.col("_level")]
    near = space.around(reduce(DataFrame.unionByName, tables), width).groupBy("_level", *names).agg(F.sum("_n").alias("_n"))
    return steps, narrow, scratch.write(near.where(F.col("_n") >= k).select("_level", *names), "enough"), crowded


def _k_nearest(points: DataFrame, places: DataFrame, k: int, point_id: str, place_order: str, space: Space, start: float, reach: float | None) -> list[DataFrame]:
    """Pairs that hold the ``k`` nearest of every point (in ``reach``, if given): of each list of places that a point looks through its ``k`` nearest.

    A cell around the point that with its neighbours holds k places bounds how far the k-th can be: two cells in each direction.
    The places so near to a cell are listed once for all of its points.
    """
    top = space.most if reach is None else min(space.spread(reach), space.most)
    steps, narrow, enough, crowded = _levels(places, space, start, k, top)
    if crowded:
        places = _distinct_spots(places, k, place_order)
    names, scratch = space.names, Scratch(points.sparkSession, "nearest")
    cells = lambda i: F.struct(F.lit(i).alias("_level"), *(c.alias(n) for n, c in zip(names, space.cell(F.col("lat"), F.col("lon"), steps[i]), strict=True)))

    def settled(rows: DataFrame, levels: range) -> DataFrame:
        """The points with the narrowest of these levels that has enough places around them; null without one."""
        own = rows.select(point_id, F.explode(F.array(*(cells(i) for i in levels))).alias("_o")).select(point_id, "_o.*")
        look = own.join(_sorted(enough), ["_level", *names], "left_semi").groupBy(point_id).agg(F.min("_level").alias("_level"))
        return scratch.write(rows.join(_sorted(look), point_id, "left"), "levels")

    parts = [settled(points, range(narrow))]
    if narrow < len(steps):
        parts.append(settled(parts[0].where("_level is null").select(*points.columns), range(narrow, len(steps))))
    out = []
    for n, at in enumerate(parts):
        for (level,) in at.select("_level").distinct().collect():  # as many as there are levels
            if level is None and n + 1 < len(parts):
                continue
            some = at.where(F.col("_level").eqNullSafe(F.lit(level))).select(*points.columns)
            if level is None:
                out.append(_pairs(some, places, min(x for x in (reach, space.limit(2 * space.most)) if x is not None), space).select(*points.columns, *places.columns, "dist"))
            else:
                out.append(_listed(some, places, k, place_order, steps[level], reach, space))
    return [reduce(DataFrame.unionByName, out)] if out else [_pairs(points, places, space.limit(start), space)]


def _listed(points: DataFrame, places: DataFrame, k: int, place_order: str, step: float, reach: float | None, space: Space) -> DataFrame:
    """Each point with its ``k`` nearest of every list of places that may be among its k nearest, where its cell of width ``step`` and the neighbours hold k.

    Cells meet places through cells ``REACH`` times as wide; lists have about ``SIDE`` places at most.
    """
    names = space.names
    own = _filed(points, space, step, POINT)
    wide = [F.floor(F.col(n) / REACH).cast("long").alias(n) for n in names]
    filed = _filed(places, space, step, PLACE).select(*places.columns, *wide).where(F.col(names[0]).isNotNull())
    lists = space.around(filed.groupBy(*names).agg(F.count("*").alias("_n")), step * REACH).groupBy(*names).agg(F.ceil(F.sum("_n") / SIDE).cast("int").alias("_lists"))
    asked = own.select(*names).distinct().select(*(F.col(n).alias(f"{n}_own") for n in names), *wide).join(_sorted(lists), names)
    met = space.around(filed, step * REACH).join(_sorted(asked), names)
    apart = F.lit(0.0)
    for n, x in zip(names, space.coordinates(*(F.col(c) for c in PLACE)), strict=True):
        low = F.col(f"{n}_own") * step
        gap = F.greatest(low - x, x - (low + step), F.lit(0.0))
        apart += gap * gap
    furthest = 2 * step * math.sqrt(len(names)) * (1 + 1e-9) + space.least * 1e-4
    part = F.pmod(F.xxhash64(*places.columns), F.col("_lists"))
    of_cell = met.where(apart <= furthest**2).groupBy(*(F.col(f"{n}_own").alias(n) for n in names), part.alias("_part")).agg(F.collect_list(F.struct(*places.columns)).alias("_places"))
    rest = [c for c in places.columns if c != place_order]
    far = lambda p: F.struct(space.distance(*(F.col(c) for c in POINT), *(p[c] for c in PLACE)).alias("dist"), *(p[c].alias(c) for c in (place_order, *rest)))
    every = F.transform("_places", far)
    best = F.array(F.array_min(every)) if k == 1 else F.slice(F.array_sort(every), 1, k)
    found = own.join(_sorted(of_cell), names).select(*points.columns, F.explode(best).alias("_b"))
    found = found.select(*points.columns, *(F.col("_b")[c].alias(c) for c in (*places.columns, "dist")))
    return found if reach is None else found.where(F.col("dist") <= reach)


def _candidates(points: DataFrame, places: DataFrame, k: int, point_id: str, place_order: str, radius: float, space: Space) -> list[DataFrame]:
    """Pairs in the radius among which each point's ``k`` nearest are."""
    return _k_nearest(points, places, k, point_id, place_order, space, max(space.spread(radius), space.least), radius)


def _distinct_spots(places: DataFrame, k: int, place_order: str) -> DataFrame:
    """Without places that ``k`` others on the very same spot precede; first within parts of a spot, then of what is left."""
    part = F.pmod(F.xxhash64(*places.columns), F.lit(64))
    first = lambda rows, keys: rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(place_order))).where(F.col("_n") <= k).drop("_n")
    return first(first(places.withColumn("_part", part), [*PLACE, "_part"]).drop("_part"), list(PLACE))


def _best(pairs: DataFrame, point_id: str, place_order: str) -> DataFrame:
    best = F.min(F.struct("dist", place_order, *(c for c in pairs.columns if c not in (point_id, "dist", place_order)))).alias("b")
    return pairs.groupBy(point_id).agg(best).select(point_id, "b.*")


def _ranked(pairs: DataFrame, k: int, point_id: str, place_order: str) -> DataFrame:
    w = Window.partitionBy(point_id).orderBy("dist", place_order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_within(points: DataFrame, places: DataFrame, radius_m: float, point_id: str, place_order: str) -> DataFrame:
    """The nearest place of each point that has one in reach; of equals the first by ``place_order``.  Combined before the shuffle."""
    return reduce(DataFrame.unionByName, [_best(p, point_id, place_order) for p in _candidates(points, places, 1, point_id, place_order, radius_m, SPHERE)])


def k_within(points: DataFrame, places: DataFrame, radius_m: float, k: int, point_id: str, place_order: str) -> DataFrame:
    """Up to ``k`` nearest places in reach, with ``rank`` from 1."""
    return reduce(DataFrame.unionByName, [_ranked(p, k, point_id, place_order) for p in _candidates(points, places, k, point_id, place_order, radius_m, SPHERE)])


def k_nearest(points: DataFrame, places: DataFrame, k: int, point_id: str, place_order: str, start_m: float = 250.0) -> DataFrame:
    """The ``k`` nearest places of every point, however far, with ``rank`` from 1; fewer only where there are no more.

    Each point looks as far as the smallest cell around it with ``k`` places says it must.
    """
    found = _k_nearest(points, places, k, point_id, place_order, SPHERE, start_m, None)
    return reduce(DataFrame.unionByName, [_ranked(p, k, point_id, place_order) for p in found])


def first_valid(ranked: DataFrame, cache: DataFrame, point_id: str, place_key: str) -> DataFrame:
    """Of each point's ranked places the first whose cached status is a hit; misses and places not in the cache are passed over."""
    ok = cache.where("status = 'hit'").select(place_key).distinct()
    valid = ranked.join(ok, place_key, "left_semi")
    rest = [c for c in valid.columns if c not in (point_id, "rank")]
    return valid.groupBy(point_id).agg(F.min(F.struct("rank", *rest)).alias("b")).select(point_id, "b.*")


def nearest_planar(points: DataFrame, places: DataFrame, point_id: str, place_order: str, start: float = 0.005) -> DataFrame:
    """Nearest by squared difference of degrees; of equals the first by ``place_order``."""
    found = _k_nearest(points, places, 1, point_id, place_order, FLAT, start, None)
    return reduce(DataFrame.unionByName, [_best(p, point_id, place_order) for p in found])


def labels_on_routes(midpoints: DataFrame, labels: DataFrame, radius_m: float, route_id: str = "route_id", label_id: str = "label_id") -> DataFrame:
    """Per route: labels near any of its midpoints, each once; their number, mean severity (0 without) and types."""
    near = within(midpoints, labels, radius_m).groupBy(route_id, label_id).agg(F.first("severity").alias("severity"), F.first("label_type").alias("label_type"))
    # types are counted, so that no route's labels are gathered one by one
    kinds = near.groupBy(route_id, "label_type").agg(F.count("*").alias("n"), F.sum("severity").alias("total"), F.count("severity").alias("told"))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("label_type").isNotNull(), F.struct("label_type", F.col("n").cast("int").alias("n"))))), lambda x: F.array_repeat(x["label_type"], x["n"])))
    found = kinds.groupBy(route_id).agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("told")).alias("mean_severity"), listed.alias("types"))
    every = midpoints.select(route_id).distinct()
    return every.join(found, route_id, "left").select(
        route_id, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_severity", F.lit(0.0)).alias("mean_severity"), F.coalesce("types", F.array().cast("array<string>")).alias("types")
    )


def area_fractions(pixels: DataFrame, classes: list[int], height: int, width: int, grid: int, image: str = "image_id", kind: str = "class_id") -> DataFrame:
    """Per image and cell of a grid x grid raster: the share of its pixels (image, y, x, class) that are of ``classes``.

    Where cells don't end on pixels, a pixel counts whole in every cell that it reaches into.
    """

    def cells(at: str, size: int) -> Column:
        return F.explode(F.sequence(F.floor(F.col(at) * grid / size), F.ceil((F.col(at) + 1) * grid / size) - 1))

    placed = pixels.withColumn("row", cells("y", height)).withColumn("col", cells("x", width))
    return placed.groupBy(image, "row", "col").agg(F.avg(F.col(kind).isin(classes).cast("double")).alias("fraction"))
