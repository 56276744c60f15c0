"""Answers, names, prompts; polygons and projections; sequences."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kerbline.catalog.common import r6, table
from kerbline.functions import polygons as G, text as T
from kerbline.operators import selection as S
from kerbline.sources import writers as W


def answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z0-9 .,!?]", " ").alias("t"))
    t = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("Unsure, "), "t")).when(F.col("conv_id") % 5 == 1, F.concat(F.lit("Yes "), "t")).otherwise(F.col("t"))
    return c.select("conv_id", "turn", T.parse_answer(t).alias("answer"), T.parse_response(t).alias("response"), T.unparsed(t).alias("unparsed"))


def cleaned(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = F.array(*(F.lit(x) for x in (" Yes", "maybe ", "CANNOT", "cannot_go", "n", "Y", "banana", None)))[(F.col("c_custkey") % 8).cast("int")]
    return c.select("c_custkey", T.normalise_selection(raw).alias("selection"), T.aid_key(F.initcap(F.lower("c_mktsegment"))).alias("key"))


def names(spark, sf_dir):
    k = F.col("c_custkey")
    path = F.concat(F.lit("a/b/"), F.array(F.lit("GSV-new_york-"), F.lit("gsv-oslo-"), F.lit("photo-"))[(k % 3).cast("int")], k, F.lit(".png"))
    reasoned = F.concat(F.lit("<think>no "), k, F.lit("</think> yes "))
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), T.city_of(path).alias("city"), T.title_city(F.lit("new_york")).alias("title"), T.last_segment(path).alias("file"), T.asset_path(path).alias("asset"),
        T.safe_id(F.concat(F.lit("s/é-_"), k, F.lit(" x.y"))).alias("safe"), T.after_reasoning(reasoned).alias("tail"), T.fill_prompt("Can {aid} pass {aid}?", F.col("c_mktsegment")).alias("prompt"),
    )


def _polygon():
    k = F.col("p_partkey")
    n = k % 5 + 2
    return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.array((k * 3 + i * i * 7) % 50 + 500.0, (k * 5 + i * 11) % 40 + 480.0)))


def polygon_measures(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", _polygon().alias("g"))
    b = G.bbox(F.col("g"))
    return p.select("p_partkey", r6(G.area(F.col("g")), "area"), *(r6(b[i], n) for i, n in enumerate(("x", "y", "w", "h"))), G.area_ratio_ok(G.area(F.col("g")), F.lit(300.0)).alias("ratio_ok"))


def polygon_projection(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", _polygon().alias("g"))
    args = (1000, 1000, 640, 640)
    return p.select("p_partkey", F.array_join(G.projected_strict(F.col("g"), *args, 0.2), ",").alias("strict"), F.array_join(G.projected_clipped(F.col("g"), *args, 0.9), ",").alias("clipped"))


def inverse_projection(spark, sf_dir):
    """The panorama pixels that the view's pixels show, of pixels given by the parts' keys and sizes."""
    g = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 640).alias("x"), (F.col("p_partkey") * 11 % 480 + F.col("p_size") % 7).alias("y"))
    m = G.inverse_map(F.col("x"), F.col("y"), 2000, 1000, 640, 480, 0.5)
    return g.select("p_partkey", "x", "y", r6(m["x"], "pano_x"), r6(m["y"], "pano_y"))


def confidence(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), r6(G.label_confidence(k % 3, k % 4, k % 2), "confidence"))


def sequences(spark, sf_dir):
    s = F.sequence(F.lit(1), (F.col("p_size") % 9 + 2).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.every_kth(s, 3), ",").alias("kth"), F.array_join(F.transform(S.consecutive(s), lambda x: x["a"] * 100 + x["b"]), ",").alias("pairs"))


def latest_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("s "), F.col("user_id")).alias("session_id"), F.col("event_id").alias("received_at"), F.col("event_type").alias("body"))
    return W.latest_by_session(e)


def union_of_keys(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return W.union_rows(r.select(F.col("r_name").alias("name"), "r_regionkey"), n.select(F.col("n_name").alias("name"), "n_nationkey"))


def table_lines(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 2).alias("bal"))
    return W.table_lines(n, "c_mktsegment", "n")


QUERIES = {
    "parse_answers": answers, "normalise_selection": cleaned, "names_and_paths": names, "polygon_measures": polygon_measures, "polygon_projection": polygon_projection, "inverse_projection": inverse_projection,
    "label_confidence": confidence, "sequences": sequences, "latest_sessions": latest_sessions, "union_of_keys": union_of_keys, "table_lines": table_lines,
}

_FOCAL = 320 / math.tan(math.radians(45))
_POLY = """g AS (SELECT p_partkey, i, (p_partkey * 3 + i * i * 7) % 50 + 500.0 AS x, (p_partkey * 5 + i * 11) % 40 + 480.0 AS y, p_partkey % 5 + 2 AS n FROM part, range(7) t(i) WHERE i < p_partkey % 5 + 2)"""


def _projected(angle: float) -> str:
    return f"""s AS (SELECT *, ((x / 1000 - 0.5) * 2 * pi() - {angle})::DOUBLE AS t, ((y / 1000 - 0.5) * pi())::DOUBLE AS f FROM g),
q AS (SELECT *, CASE WHEN cos(f) * cos(t) > 0 THEN trunc({_FOCAL} * cos(f) * sin(t) / (cos(f) * cos(t)) + 320)::INT END AS a, CASE WHEN cos(f) * cos(t) > 0 THEN trunc({_FOCAL} * sin(f) / (cos(f) * cos(t)) + 320)::INT END AS b FROM s)"""


SQL = {
    "parse_answers": r"""WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z0-9 .,!?]', ' ', 'g') AS t FROM conversations), d AS (SELECT conv_id, turn, lower(CASE conv_id % 5 WHEN 0 THEN 'Unsure, ' || t WHEN 1 THEN 'Yes ' || t ELSE t END) AS t FROM c),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[^a-z0-9_]+'), lambda x: x IN ('yes', 'no', 'unsure'))[1] AS w, trim(t) AS s FROM d)
SELECT conv_id, turn, (CASE WHEN w = 'no' THEN 0 WHEN w = 'unsure' THEN 1 WHEN w = 'yes' THEN 2 WHEN contains(t, 'yes') THEN 2 WHEN contains(t, 'no') THEN 0 ELSE 1 END)::INT AS answer,
  (CASE WHEN starts_with(s, 'yes') THEN 2 WHEN starts_with(s, 'no') THEN 0 WHEN contains(s, 'unsure') OR contains(s, 'uncertain') OR contains(s, 'unclear') THEN 1 WHEN contains(s, 'yes') THEN 2 WHEN contains(s, 'no') THEN 0 ELSE 2 END)::INT AS response,
  NOT (contains(t, 'yes') OR contains(t, 'no') OR contains(t, 'unsure')) AS unparsed FROM w""",
    "normalise_selection": "SELECT c_custkey, (['yes', 'unsure', 'no', 'no', 'no', 'yes', 'banana', 'nan'])[(c_custkey % 8 + 1)::INT] AS selection, lower(c_mktsegment) AS key FROM customer",
    "names_and_paths": """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m, (['GSV-new_york-', 'gsv-oslo-', 'photo-'])[(c_custkey % 3 + 1)::INT] || c_custkey || '.png' AS file FROM customer)
SELECT k, (['newyork', 'oslo', 'unknown'])[(k % 3 + 1)::INT] AS city, 'New York' AS title, file, 'assets/images/' || file AS asset, 's-_' || k || 'xy' AS safe, 'yes' AS tail, 'Can ' || m || ' pass ' || m || '?' AS prompt FROM c""",
    "polygon_measures": f"""WITH {_POLY}, e AS (SELECT a.p_partkey, a.n, a.x, a.y, a.x * b.y - b.x * a.y AS c FROM g a JOIN g b ON a.p_partkey = b.p_partkey AND b.i = (a.i + 1) % a.n),
m AS (SELECT p_partkey, CASE WHEN any_value(n) < 3 THEN 0 ELSE abs(sum(c)) / 2 END AS area, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h FROM e GROUP BY 1)
SELECT p_partkey, round(area::DOUBLE, 6) AS area, round(x::DOUBLE, 6) AS x, round(y::DOUBLE, 6) AS y, round(w::DOUBLE, 6) AS w, round(h::DOUBLE, 6) AS h, area / 300 BETWEEN 0.7 AND 1.3 AS ratio_ok FROM m""",
    "polygon_projection": f"""WITH {_POLY}, {_projected(0.2)}, r AS (SELECT p_partkey, string_agg(a || ',' || b, ',' ORDER BY i) FILTER (a IS NOT NULL) AS t, count(a) AS n, bool_and(a >= 2 AND a < 638 AND b >= 2 AND b < 638) FILTER (a IS NOT NULL) AS ok FROM q GROUP BY 1),
{_projected(0.9).replace("s AS", "s2 AS").replace("q AS", "q2 AS").replace("FROM s)", "FROM s2)")}, o AS (SELECT *, a IS NOT NULL AND NOT (a >= 10 AND a < 630 AND b >= 10 AND b < 630) AS outside FROM q2),
z AS (SELECT p_partkey, string_agg(CASE WHEN outside THEN least(greatest(a, 0), 639) || ',' || least(greatest(b, 0), 639) ELSE a || ',' || b END, ',' ORDER BY i) FILTER (a IS NOT NULL) AS t, count(a) AS n, count(*) FILTER (outside OR a IS NULL) AS c FROM o GROUP BY 1)
SELECT r.p_partkey, CASE WHEN r.n >= 3 AND r.ok THEN r.t END AS strict, CASE WHEN z.n >= 3 AND z.c <= 5 THEN z.t END AS clipped FROM r JOIN z USING (p_partkey)""",
    "inverse_projection": f"""WITH g AS (SELECT p_partkey, p_partkey * 37 % 640 AS x, p_partkey * 11 % 480 + p_size % 7 AS y FROM part)
SELECT p_partkey, x, y, round(((atan2(x - 320, {_FOCAL}) + 0.5) / pi() / 2 + 0.5) * 2000, 6) AS pano_x, round((atan((y - 240) / sqrt((x - 320) * (x - 320) + {_FOCAL} * {_FOCAL})) / (pi() / 2) / 2 + 0.5) * 1000, 6) AS pano_y FROM g""",
    "label_confidence": "SELECT p_partkey AS k, round(CASE WHEN p_partkey % 3 + p_partkey % 4 + p_partkey % 2 = 0 THEN 0 ELSE (p_partkey % 3) / (p_partkey % 3 + p_partkey % 4 + p_partkey % 2) END, 6) AS confidence FROM part",
    "sequences": """SELECT p_partkey, array_to_string(list_filter(range(1, p_size % 9 + 3), lambda x: x % 3 = 1), ',') AS kth, array_to_string(list_transform(range(1, p_size % 9 + 2), lambda x: x * 101 + 1), ',') AS pairs FROM part""",
    "latest_sessions": "SELECT 's' || user_id AS session_id, max(event_id) AS received_at, arg_max(event_type, event_id) AS body FROM events GROUP BY user_id",
    "union_of_keys": "SELECT r_name AS name, r_regionkey, NULL::INT AS n_nationkey FROM region UNION ALL SELECT n_name, NULL, n_nationkey FROM nation",
    "table_lines": r"SELECT c_mktsegment || ' & ' || count(*) || ' \\' AS line FROM customer GROUP BY c_mktsegment",
}
