"""Test tables as the library's entities, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbline.functions.constants import AID_KEYS, PASSABILITY, PRIORS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as votes: type is the aid, id modulo 52 the image, value the selection."""
    e = table(spark, sf_dir, "events")
    pick = F.when(F.col("value") < 20.5, "no").when(F.col("value") < 55.1, "unsure").otherwise("yes")
    return e.select("event_id", F.col("user_id").alias("pid"), F.col("event_type").alias("aid"), (F.col("event_id") % 52).alias("image_id"), pick.alias("selection"), "ts", "value")


VOTES = """votes AS (SELECT event_id, user_id AS pid, event_type AS aid, event_id % 52 AS image_id,
  CASE WHEN value < 20.5 THEN 'no' WHEN value < 55.1 THEN 'unsure' ELSE 'yes' END AS selection, ts, value FROM events)"""

TALLY = """counted AS (SELECT image_id, aid, count(*) FILTER (selection = 'no') AS "no", count(*) FILTER (selection = 'unsure') AS unsure,
  count(*) FILTER (selection = 'yes') AS yes FROM votes GROUP BY image_id, aid),
shared AS (SELECT *, "no" + unsure + yes AS total_votes, "no" / ("no" + unsure + yes) AS p_no, unsure / ("no" + unsure + yes) AS p_unsure, yes / ("no" + unsure + yes) AS p_yes FROM counted),
scored AS (SELECT *, -(p_no * ln(p_no + 1e-12) + p_unsure * ln(p_unsure + 1e-12) + p_yes * ln(p_yes + 1e-12)) AS entropy,
  greatest(p_no, p_unsure, p_yes) - (p_no + p_unsure + p_yes - greatest(p_no, p_unsure, p_yes) - least(p_no, p_unsure, p_yes)) AS margin,
  CASE WHEN p_no >= p_unsure AND p_no >= p_yes THEN 'no' WHEN p_unsure >= p_yes THEN 'unsure' ELSE 'yes' END AS best FROM shared),
tallies AS (SELECT *, (entropy > 1.0 OR round(margin, 9) < 0.10 OR total_votes < 3) AS is_uncertain, 'p_' || best AS argmax_label FROM scored)"""


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


#: Points around one city, by modular arithmetic of a key.
def lat_of(key: Column) -> Column:
    return F.lit(40.40) + (key * 7919 % 10007) / 100000.0


def lon_of(key: Column) -> Column:
    return F.lit(-79.99) + (key * 6101 % 9973) / 100000.0


LAT = "(40.40 + ({k} * 7919 % 10007) / 100000.0)::DOUBLE"
LON = "(-79.99 + ({k} * 6101 % 9973) / 100000.0)::DOUBLE"
KINDS = ["CurbRamp", "NoCurbRamp", "Obstacle", "SurfaceProblem", "NoSidewalk", "Crosswalk", "Signal"]


def kind_of(key: Column) -> Column:
    return F.array(*(F.lit(k) for k in KINDS))[(key % 7).cast("int")]


KIND = "(['CurbRamp','NoCurbRamp','Obstacle','SurfaceProblem','NoSidewalk','Crosswalk','Signal'])[(({k}) % 7 + 1)::INT]"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as label points."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("label_id"), kind_of(k).alias("label_type"), lat_of(k).alias("lat"), lon_of(k).alias("lon"), (k % 5 + 1).cast("double").alias("severity"), (k % 3000).alias("way_id"))


LABELS = f"labels_geo AS (SELECT c_custkey AS label_id, {KIND.format(k='c_custkey')} AS label_type, {LAT.format(k='c_custkey')} AS lat, {LON.format(k='c_custkey')} AS lon, (c_custkey % 5 + 1)::DOUBLE AS severity, c_custkey % 3000 AS way_id FROM customer)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as street nodes."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("node"), lat_of(k + 50000).alias("lat"), lon_of(k + 50000).alias("lon"))


NODES = f"nodes AS (SELECT s_suppkey AS node, {LAT.format(k='(s_suppkey + 50000)')} AS lat, {LON.format(k='(s_suppkey + 50000)')} AS lon FROM supplier)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier pairs met in lineitem as a multigraph: u, v, k, length, p_yes, way_ids."""
    li = table(spark, sf_dir, "lineitem")
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    raw = li.crossJoin(F.broadcast(n)).select(  # one row
        F.col("l_suppkey").alias("u"), (F.col("l_partkey") % F.col("n") + 1).alias("v"), (F.col("l_linenumber") % 2).cast("int").alias("k"), F.col("l_quantity").alias("length"), F.col("l_discount").alias("d"), F.col("l_orderkey").alias("o")
    )
    return raw.groupBy("u", "v", "k").agg(F.min("length").alias("length"), (1 - 8 * F.min("d")).alias("p_yes"), F.array(F.min("o") % 3000, F.max("o") % 3000).alias("way_ids"))


EDGES = """edges AS (SELECT l_suppkey AS u, l_partkey % (SELECT count(*) FROM supplier) + 1 AS v, (l_linenumber % 2)::INT AS k, min(l_quantity) AS length,
  1 - 8 * min(l_discount) AS p_yes, [min(l_orderkey) % 3000, max(l_orderkey) % 3000] AS way_ids FROM lineitem GROUP BY 1, 2, 3)"""

HAV = "(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)))))"


PRIORS_SQL = f"priors AS (SELECT * FROM (VALUES {', '.join(f"('{aid}', {p})" for aid, p in PRIORS.items())}) t(aid, prior))"


def passability_sql() -> str:
    rows = ", ".join(f"('{kind}', '{aid}', {p})" for kind, ps in PASSABILITY.items() for aid, p in zip(AID_KEYS, ps, strict=True))
    return f"known AS (SELECT * FROM (VALUES {rows}) t(label_type, aid, p))"
