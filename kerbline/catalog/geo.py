"""Spatial joins and edge scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog.common import EDGES, HAV, LABELS, NODES, PRIORS_SQL, edges, labels, nodes, passability_sql, r6, table
from kerbline.functions import geo
from kerbline.operators import scores as SC, spatial as SP
from kerbline.plans.scratch import Scratch


def _places(spark, sf_dir):
    return nodes(spark, sf_dir).select("node", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))


def _points(spark, sf_dir):
    return labels(spark, sf_dir).select("label_id", "lat", "lon")


def distances(spark, sf_dir):
    a = nodes(spark, sf_dir)
    b = a.select((F.col("node") - 1).alias("node"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    c = [F.col(x) for x in ("lat", "lon", "lat2", "lon2")]
    return a.join(b, "node").select("node", F.round(geo.haversine_m(*c), 3).alias("dist"), F.round(geo.bearing_deg(*c), 3).alias("bearing"))


def in_bounds(spark, sf_dir):
    return labels(spark, sf_dir).where(geo.in_bounds(F.col("lat"), F.col("lon"), 40.42, 40.45, -79.95, -79.92, 500)).select("label_id")


def midpoints(spark, sf_dir):
    e = edges(spark, sf_dir).select("u", "v", "k")
    at = lambda n, c: nodes(spark, sf_dir).select(F.col("node").alias(n), F.col("lat").alias(f"{c}lat"), F.col("lon").alias(f"{c}lon"))
    points = F.when(F.col("k") == 1, F.array(*(F.struct(F.lit(-79.0 - i).alias("lon"), F.lit(40.0 + i).alias("lat")) for i in range(4))))
    m = geo.polyline_midpoint(points, F.col("ulat"), F.col("ulon"), F.col("vlat"), F.col("vlon"))
    return e.join(at("u", "u"), "u").join(at("v", "v"), "v").withColumn("m", m).select("u", "v", "k", r6(F.col("m.lat"), "lat"), r6(F.col("m.lon"), "lon"))


def radius_pairs(spark, sf_dir):
    return SP.within(_points(spark, sf_dir), _places(spark, sf_dir), 300.0).select("label_id", "node", F.round("dist", 3).alias("dist"))


def nearest_node(spark, sf_dir):
    return SP.nearest_within(_points(spark, sf_dir), _places(spark, sf_dir), 500.0, "label_id", "node").select("label_id", "node", F.round("dist", 3).alias("dist"))


def k_in_radius(spark, sf_dir):
    return SP.k_within(_points(spark, sf_dir), _places(spark, sf_dir), 900.0, 3, "label_id", "node").select("label_id", "node", "rank", F.round("dist", 3).alias("dist"))


def k_nearest(spark, sf_dir):
    return SP.k_nearest(_points(spark, sf_dir), _places(spark, sf_dir), 8, "label_id", "node").select("label_id", "node", "rank", F.round("dist", 3).alias("dist"))


def first_valid(spark, sf_dir):
    ranked = SP.k_nearest(_points(spark, sf_dir), _places(spark, sf_dir), 8, "label_id", "node")
    cache = nodes(spark, sf_dir).select("node", F.when(F.col("node") % 3 == 0, "hit").when(F.col("node") % 3 == 1, "miss").otherwise("expired").alias("status"))
    return SP.first_valid(ranked, cache, "label_id", "node").select("label_id", "rank", "node")


def nearest_planar(spark, sf_dir):
    return SP.nearest_planar(_points(spark, sf_dir), _places(spark, sf_dir), "label_id", "node").select("label_id", "node")


def labels_on_routes(spark, sf_dir):
    mid = nodes(spark, sf_dir).select((F.col("node") % 12).alias("route_id"), "lat", "lon")
    neg = labels(spark, sf_dir).where(F.col("label_type").isin("Obstacle", "SurfaceProblem", "NoCurbRamp", "NoSidewalk"))
    return SP.labels_on_routes(mid, neg.select("label_id", "label_type", "severity", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), 250.0).select("route_id", "n", r6("mean_severity"), F.array_join("types", ",").alias("types"))


def edge_scoring(spark, sf_dir):
    e = Scratch(spark, "edge-scoring").write(edges(spark, sf_dir), "edges")
    s = SC.worst_barrier(SC.label_counts(labels(spark, sf_dir), e, nodes(spark, sf_dir), 200.0), e, ",")
    return s.select("u", "v", "k", "aid", "p_yes", "n_labels", "label_types", "source")


def _stored(spark, sf_dir):
    """Scores of some edges, some under the reversed key, some under both."""
    e = edges(spark, sf_dir).select("u", "v", "k", "p_yes")
    one = e.where("(u + v) % 3 < 2").select("u", "v", "k", F.lit("walker").alias("aid"), "p_yes")
    two = e.where("(u + v) % 3 > 0").select(F.col("v").alias("u"), F.col("u").alias("v"), "k", F.lit("walker").alias("aid"), (F.col("p_yes") / 2).alias("p_yes"))
    return one.unionByName(two).groupBy("u", "v", "k", "aid").agg(F.min("p_yes").alias("p_yes"))


def join_scores(spark, sf_dir):
    return SC.join_scores(edges(spark, sf_dir).select("u", "v", "k"), _stored(spark, sf_dir)).select("u", "v", "k", "aid", r6("p_yes"), "matched")


def join_scores_forward(spark, sf_dir):
    return SC.join_scores(edges(spark, sf_dir).select("u", "v", "k"), _stored(spark, sf_dir), default=0.6, try_reverse=False).select("u", "v", "k", "aid", r6("p_yes"), "matched")


def cover_by_source(spark, sf_dir):
    e = edges(spark, sf_dir)
    long = lambda cond, p: e.where(cond).select("u", "v", "k", F.lit("walker").alias("aid"), p.alias("p_yes"))
    s = SC.cover(e, long("u % 3 = 0", F.col("p_yes")), long("v % 2 = 0", F.lit(0.25)))
    return s.select("u", "v", "k", "aid", r6("p_yes"), "source")


def mean_of_images(spark, sf_dir):
    n = nodes(spark, sf_dir).select(F.col("node").alias("u"), (F.col("node") + 1).alias("v"), F.lit(0).alias("k"), "lat", "lon")
    k = F.col("label_id")
    images = labels(spark, sf_dir).select(k.alias("image_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), F.lit("walker").alias("aid"), F.when(k % 4 != 0, (k % 11) / 10).alias("p_yes"))
    return SC.mean_of_images(n, images, 250.0).select("u", "v", "k", "aid", r6("p_yes"), "n_images")


def scores_wide(spark, sf_dir):
    w = SC.to_wide(SC.join_scores(edges(spark, sf_dir).select("u", "v", "k"), _stored(spark, sf_dir)))
    return w.select("u", "v", "k", *(r6(c) for c in w.columns[3:]))


def area_fractions(spark, sf_dir):
    """Parts as pixels of 7 x 11 rasters, pooled to 3 x 3 cells."""
    k = F.col("p_partkey")
    pixels = table(spark, sf_dir, "part").select(F.floor(k / 77).alias("image_id"), F.floor(k % 77 / 11).alias("y"), (k % 11).alias("x"), (F.col("p_size") % 5).alias("class_id"))
    return SP.area_fractions(pixels, [1, 3], 7, 11, 3).select("image_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), r6("fraction"))


def routable_nodes(spark, sf_dir):
    """Nodes for which a label of another source has a severity above 3."""
    from kerbline.operators.routing import routable

    records = labels(spark, sf_dir).select((F.col("label_id") % 200).alias("pair_idx"), F.when(F.col("severity") > 3, F.col("severity")).alias("p"))
    return routable(nodes(spark, sf_dir).select(F.col("node").alias("pair_idx")), records, "p")


QUERIES = {
    "area_fractions": area_fractions, "routable_nodes": routable_nodes,
    "haversine_bearing": distances, "in_bounds": in_bounds, "edge_midpoints": midpoints, "radius_pairs": radius_pairs, "nearest_node": nearest_node, "k_in_radius": k_in_radius, "k_nearest": k_nearest,
    "first_valid_of_nearest": first_valid, "nearest_planar": nearest_planar, "labels_on_routes": labels_on_routes, "edge_scoring": edge_scoring, "join_scores": join_scores,
    "join_scores_forward": join_scores_forward, "cover_by_source": cover_by_source, "mean_of_images": mean_of_images, "scores_wide": scores_wide,
}

_PAIRS = f"{LABELS}, {NODES}, pairs AS (SELECT l.label_id, n.node, {HAV.format(a='l', b='n')} AS dist FROM labels_geo l, nodes n)"
_RANKED = f"{_PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY dist, node) AS rank FROM pairs)"
_STORED = f"""{EDGES}, stored AS (SELECT u, v, k, min(p) AS p FROM (SELECT u, v, k, p_yes AS p FROM edges WHERE (u + v) % 3 < 2 UNION ALL SELECT v, u, k, p_yes / 2 FROM edges WHERE (u + v) % 3 > 0) GROUP BY 1, 2, 3)"""
_JOINED = f"""{_STORED}, {PRIORS_SQL}, joined AS (SELECT e.u, e.v, e.k, a.aid, CASE WHEN a.aid = 'walker' THEN coalesce(f.p, r.p) END AS p, CASE WHEN a.aid = 'walker' THEN f.p END AS fp, a.prior
  FROM edges e CROSS JOIN priors a LEFT JOIN stored f ON f.u = e.u AND f.v = e.v AND f.k = e.k LEFT JOIN stored r ON r.u = e.v AND r.v = e.u AND r.k = e.k)"""

SQL = {
    "area_fractions": """WITH p AS (SELECT p_partkey // 77 AS image_id, p_partkey % 77 // 11 AS y, p_partkey % 11 AS x, p_size % 5 IN (1, 3) AS is_in FROM part), c AS (SELECT unnest(range(3)) AS i)
SELECT image_id, r.i::INT AS "row", q.i::INT AS col, round(avg(is_in::INT), 6) AS fraction FROM p JOIN c r ON y >= floor(r.i * 7 / 3) AND y < ceil((r.i + 1) * 7 / 3) JOIN c q ON x >= floor(q.i * 11 / 3) AND x < ceil((q.i + 1) * 11 / 3) GROUP BY 1, 2, 3""",
    "routable_nodes": f"WITH {NODES}, {LABELS} SELECT node AS pair_idx FROM nodes WHERE node IN (SELECT label_id % 200 FROM labels_geo WHERE severity > 3)",
    "haversine_bearing": f"""WITH {NODES}, p AS (SELECT a.node, {HAV.format(a='a', b='b')} AS d, atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon))) AS t
  FROM nodes a JOIN nodes b ON b.node = a.node + 1) SELECT node, round(d, 3) AS dist, round((degrees(t) + 360) % 360, 3) AS bearing FROM p""",
    "in_bounds": f"""WITH {LABELS} SELECT label_id FROM labels_geo WHERE lat BETWEEN 40.42 - 500 / 111000.0 AND 40.45 + 500 / 111000.0
  AND lon BETWEEN -79.95 - 500 / 111000.0 / cos(radians((40.42 + 40.45) / 2)) AND -79.92 + 500 / 111000.0 / cos(radians((40.42 + 40.45) / 2))""",
    "edge_midpoints": f"WITH {EDGES}, {NODES} SELECT u, v, k, round(CASE k WHEN 1 THEN 42.0 ELSE (a.lat + b.lat) / 2 END, 6) AS lat, round(CASE k WHEN 1 THEN -81.0 ELSE (a.lon + b.lon) / 2 END, 6) AS lon FROM edges JOIN nodes a ON a.node = u JOIN nodes b ON b.node = v",
    "radius_pairs": f"WITH {_PAIRS} SELECT label_id, node, round(dist, 3) AS dist FROM pairs WHERE dist <= 300",
    "nearest_node": f"WITH {_RANKED} SELECT label_id, node, round(dist, 3) AS dist FROM ranked WHERE rank = 1 AND dist <= 500",
    "k_in_radius": f"WITH {_RANKED} SELECT label_id, node, rank::INT AS rank, round(dist, 3) AS dist FROM ranked WHERE rank <= 3 AND dist <= 900",
    "k_nearest": f"WITH {_RANKED} SELECT label_id, node, rank::INT AS rank, round(dist, 3) AS dist FROM ranked WHERE rank <= 8",
    "first_valid_of_nearest": f"WITH {_RANKED} SELECT label_id, min(rank)::INT AS rank, arg_min(node, rank) AS node FROM ranked WHERE rank <= 8 AND node % 3 = 0 GROUP BY 1",
    "nearest_planar": f"WITH {LABELS}, {NODES}, r AS (SELECT label_id, node, row_number() OVER (PARTITION BY label_id ORDER BY (n.lat - l.lat) * (n.lat - l.lat) + (n.lon - l.lon) * (n.lon - l.lon), node) AS i FROM labels_geo l, nodes n) SELECT label_id, node FROM r WHERE i = 1",
    "labels_on_routes": f"""WITH {LABELS}, {NODES}, near AS (SELECT DISTINCT n.node % 12 AS route_id, l.label_id, l.label_type, l.severity FROM labels_geo l, nodes n WHERE l.label_type IN ('Obstacle', 'SurfaceProblem', 'NoCurbRamp', 'NoSidewalk') AND {HAV.format(a='n', b='l')} <= 250)
SELECT r.route_id, count(label_id) AS n, round(coalesce(avg(severity), 0), 6) AS mean_severity, coalesce(string_agg(label_type, ',' ORDER BY label_type), '') AS types FROM (SELECT DISTINCT node % 12 AS route_id FROM nodes) r LEFT JOIN near USING (route_id) GROUP BY 1""",
    "edge_scoring": f"""WITH {EDGES}, {LABELS}, {NODES}, {PRIORS_SQL}, {passability_sql()}, ways AS (SELECT DISTINCT u, v, k, unnest(way_ids) AS way_id FROM edges),
by_way AS (SELECT label_id, label_type, u, v, k FROM labels_geo JOIN ways USING (way_id)), rest AS (SELECT * FROM labels_geo WHERE label_id NOT IN (SELECT label_id FROM by_way)),
d AS (SELECT l.label_id, l.label_type, n.node, {HAV.format(a='l', b='n')} AS dist FROM rest l, nodes n), snapped AS (SELECT label_id, any_value(label_type) AS label_type, arg_min(node, (dist, node)) AS node FROM d WHERE dist <= 200 GROUP BY 1),
matched AS (SELECT * FROM by_way UNION ALL SELECT label_id, label_type, u, v, k FROM snapped JOIN edges ON u = node UNION ALL SELECT label_id, label_type, u, v, k FROM snapped JOIN edges ON v = node),
per AS (SELECT u, v, k, count(*) AS n, string_agg(label_type, ',' ORDER BY label_type) AS t FROM matched GROUP BY 1, 2, 3),
least_ AS (SELECT u, v, k, a.aid, least(1.0, min(coalesce(kn.p, a.prior))) AS p FROM matched m CROSS JOIN priors a LEFT JOIN known kn ON kn.label_type = m.label_type AND kn.aid = a.aid GROUP BY 1, 2, 3, 4)
SELECT e.u, e.v, e.k, a.aid, coalesce(l.p, a.prior)::DOUBLE AS p_yes, coalesce(per.n, 0)::INT AS n_labels, coalesce(per.t, '') AS label_types, CASE WHEN per.n IS NULL THEN 'prior' ELSE 'labels' END AS source
FROM edges e CROSS JOIN priors a LEFT JOIN per ON per.u = e.u AND per.v = e.v AND per.k = e.k LEFT JOIN least_ l ON l.u = e.u AND l.v = e.v AND l.k = e.k AND l.aid = a.aid""",
    "join_scores": f"WITH {_JOINED} SELECT u, v, k, aid, round(coalesce(p, prior)::DOUBLE, 6) AS p_yes, p IS NOT NULL AS matched FROM joined",
    "join_scores_forward": f"WITH {_JOINED} SELECT u, v, k, aid, round(coalesce(fp, 0.6)::DOUBLE, 6) AS p_yes, fp IS NOT NULL AS matched FROM joined",
    "cover_by_source": f"""WITH {EDGES}, {PRIORS_SQL} SELECT u, v, k, aid, round(CASE WHEN aid = 'walker' AND u % 3 = 0 THEN p_yes WHEN aid = 'walker' AND v % 2 = 0 THEN 0.25 ELSE prior END::DOUBLE, 6) AS p_yes,
  CASE WHEN aid = 'walker' AND u % 3 = 0 THEN 'labels' WHEN aid = 'walker' AND v % 2 = 0 THEN 'inference' ELSE 'prior' END AS source FROM edges CROSS JOIN priors""",
    "mean_of_images": f"WITH {_PAIRS} SELECT node AS u, node + 1 AS v, 0 AS k, 'walker' AS aid, round(avg(CASE WHEN label_id % 4 = 0 THEN 0.5 ELSE (label_id % 11) / 10 END), 6) AS p_yes, count(DISTINCT label_id) AS n_images FROM pairs WHERE dist <= 250 GROUP BY 1",
    "scores_wide": f"""WITH {_JOINED}, f AS (SELECT u, v, k, aid, coalesce(p, prior)::DOUBLE AS x FROM joined) SELECT u, v, k, {", ".join(f"round(max(CASE aid WHEN '{a}' THEN x END), 6) AS {a}" for a in ("walking_cane", "walker", "mobility_scooter", "manual_wheelchair", "motorized_wheelchair"))} FROM f GROUP BY 1, 2, 3""",
}
