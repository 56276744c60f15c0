"""Polygon annotations by image: projected to a view, checked by area, grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.functions import polygons as G


def deprojected(annotations: DataFrame, pano_w: int, pano_h: int, width: int, height: int, angle_rad: float, low: float = 0.7, high: float = 1.3, **view) -> DataFrame:
    """Annotations (image_id, id, category_id, polygon) with ``projected`` (null where it doesn't fit the view), both areas, their ratio, and whether it lies within limits."""
    shown = annotations.withColumn("projected", G.projected_strict(F.col("polygon"), pano_w, pano_h, width, height, angle_rad, **view))
    before, after = G.area(F.col("polygon")), G.area(F.transform("projected", lambda x: x.cast("double")))
    areas = shown.withColumns({"area_before": before, "area_after": F.when(F.col("projected").isNotNull(), after)})
    return areas.withColumn("ratio", F.try_divide("area_after", "area_before")).withColumn("ok", F.coalesce(G.area_ratio_ok(F.col("area_after"), F.col("area_before"), low, high), F.lit(False)))


def grouped(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every image (``id`` and its own columns) with its annotations, in the order of their ids; images without any have none.

    ``n_shown`` and ``n_ok`` count those that fit the view and keep their area.
    Collected is one image's annotations.
    """
    own = F.struct("id", "category_id", "projected", "area_before", "area_after", "ratio", "ok")
    by = annotations.groupBy("image_id").agg(F.sort_array(F.collect_list(own)).alias("annotations"), F.count_if(F.col("projected").isNotNull()).alias("n_shown"), F.count_if("ok").alias("n_ok"))
    none = F.array().cast(dict(by.dtypes)["annotations"])
    found = images.join(by, images["id"] == by["image_id"], "left").drop("image_id")
    return found.withColumns({"annotations": F.coalesce("annotations", none), "n_shown": F.coalesce("n_shown", F.lit(0)), "n_ok": F.coalesce("n_ok", F.lit(0))})
