"""Polygons as flat arrays [x0, y0, x1, y1, ...], and panoramic projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _every_other(flat: Column, odd: int) -> Column:
    return F.filter(flat, lambda _, i: i % 2 == odd)


def xs(flat: Column) -> Column:
    return _every_other(flat, 0)


def ys(flat: Column) -> Column:
    return _every_other(flat, 1)


def area(flat: Column) -> Column:
    """Shoelace area; 0 below three points."""
    x, y, n = xs(flat), ys(flat), F.floor(F.size(flat) / 2).cast("int")
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: x[i] * y[(i + 1) % n] - x[(i + 1) % n] * y[i])
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, c: acc + c)) / 2)


def bbox(flat: Column) -> Column:
    """[xmin, ymin, width, height]."""
    x, y = xs(flat), ys(flat)
    return F.array(F.array_min(x), F.array_min(y), F.array_max(x) - F.array_min(x), F.array_max(y) - F.array_min(y))


def projected(flat: Column, pano_w: int, pano_h: int, width: int, height: int, angle_rad: float, fov_deg: float = 90.0) -> Column:
    """Panorama pixels to a rectilinear view: array<struct<x, y>> truncated to whole pixels; null where behind the camera."""
    focal = width / (2 * math.tan(math.radians(fov_deg) / 2))

    def one(x: Column, y: Column) -> Column:
        theta = (x / pano_w - 0.5) * (2 * math.pi) - angle_rad
        phi = (y / pano_h - 0.5) * math.pi
        z = F.cos(phi) * F.cos(theta)
        px = (F.lit(focal) * F.cos(phi) * F.sin(theta) / z + width / 2).cast("int")
        py = (F.lit(focal) * F.sin(phi) / z + height / 2).cast("int")
        return F.when(z > 0, F.struct(px.alias("x"), py.alias("y")))

    return F.zip_with(xs(flat), ys(flat), one)


def projected_strict(flat: Column, pano_w: int, pano_h: int, width: int, height: int, angle_rad: float, fov_deg: float = 90.0, margin: int = 2) -> Column:
    """Flat projected polygon; null when any visible point leaves the margin or fewer than three are visible."""
    points = F.filter(projected(flat, pano_w, pano_h, width, height, angle_rad, fov_deg), lambda p: p.isNotNull())
    inside = lambda p: (p["x"] >= margin) & (p["x"] < width - margin) & (p["y"] >= margin) & (p["y"] < height - margin)
    return F.when(F.forall(points, inside) & (F.size(points) >= 3), F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"]))))


def projected_clipped(flat: Column, pano_w: int, pano_h: int, width: int, height: int, angle_rad: float, fov_deg: float = 90.0, margin: int = 10, most_clipped: int = 5) -> Column:
    """Flat projected polygon with points outside the margin clipped to the view; null when over ``most_clipped`` are clipped or hidden."""
    every = projected(flat, pano_w, pano_h, width, height, angle_rad, fov_deg)
    points = F.filter(every, lambda p: p.isNotNull())
    outside = lambda p: ~((p["x"] >= margin) & (p["x"] < width - margin) & (p["y"] >= margin) & (p["y"] < height - margin))
    clipped = F.size(F.filter(every, lambda p: p.isNull() | outside(p)))
    cut = lambda v, most: F.least(F.greatest(v, F.lit(0)), F.lit(most - 1))
    place = lambda p: F.when(outside(p), F.array(cut(p["x"], width), cut(p["y"], height))).otherwise(F.array(p["x"], p["y"]))
    return F.when((F.size(points) >= 3) & (clipped <= most_clipped), F.flatten(F.transform(points, place)))


def inverse_map(x: Column, y: Column, pano_w: int, pano_h: int, width: int, height: int, angle_rad: float, fov_deg: float = 90.0) -> Column:
    """struct(x, y): the panorama pixel that a view pixel shows."""
    focal = width / (2 * math.tan(math.radians(fov_deg) / 2))
    px, py = x - width / 2, y - height / 2
    theta = F.atan2(px, F.lit(focal)) + angle_rad
    phi = F.atan(py / F.sqrt(px * px + focal * focal))
    return F.struct(((theta / math.pi / 2 + 0.5) * pano_w).alias("x"), ((phi / (math.pi / 2) / 2 + 0.5) * pano_h).alias("y"))


def label_confidence(agree: Column, disagree: Column, unsure: Column) -> Column:
    """agree over all validations; 0 without any."""
    return F.coalesce(F.try_divide(agree, agree + disagree + unsure), F.lit(0.0))


def area_ratio_ok(after: Column, before: Column, low: float = 0.7, high: float = 1.3) -> Column:
    return F.coalesce(F.try_divide(after, before).between(low, high), F.lit(False))
