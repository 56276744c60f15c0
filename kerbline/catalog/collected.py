"""Caches, tiles, concentration fits, simulated scores, snapped lines, annotations, pooled tokens, experiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog.common import LABELS, VOTES, edges, labels, nodes, r6, table, votes
from kerbline.catalog.measures import PRED, _class_sql, predictions
from kerbline.catalog.routes import graph
from kerbline.catalog.texts import _POLY, _polygon, _projected
from kerbline.functions.constants import CLASSES
from kerbline.operators import annotations as A, concentration as C, features as X, metrics as M, routing as R, selection as S
from kerbline.operators.cache import FetchCache
from kerbline.plans.scratch import Scratch
from kerbline.sources.label_source import LabelSource


def fetch_cache(spark, sf_dir):
    """Pages as fetched items over three batches, one of them repeated, looked up after some entries ran out."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page-"), F.col("page_id")).alias("key"), F.when(F.col("page_id") % 5 > 0, F.col("html").cast("binary")).alias("payload"))
    cache = FetchCache(spark, f"{Scratch(spark, 'fetch-cache').root}/entries", ttl=2000)
    first, second = p.where("page_id % 4 < 2"), p.where("page_id % 4 in (1, 2)")
    cache.store(first, "1", 1000)
    cache.store(second.withColumn("payload", F.lit(b"again")), "2", 2000)  # what is held stays
    cache.store(first, "1", 1000)
    found = cache.lookup(p.select("page_id", "key"), 3500)
    return found.select("page_id", "status", F.octet_length("payload").cast("long").alias("bytes"), "fetched_at")


def label_tiles(spark, sf_dir):
    """Labels written as tiles of JSON lines at two endpoints, and a box of them read through the source."""
    place = lambda c: F.floor(F.col(c) / 0.02).cast("string")
    rows = labels(spark, sf_dir).select(F.concat_ws("_", place("lat"), place("lon")).alias("tile"), F.to_json(F.struct("label_id", "label_type", "severity", "lat", "lon")).alias("value"))
    root = Scratch(spark, "label-tiles").root
    rows.write.partitionBy("tile").text(f"{root}/whole")
    rows.where(F.hash("tile") % 2 == 0).write.partitionBy("tile").text(f"{root}/half")
    spark.dataSource.register(LabelSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("kerbline_labels").option("path", f"{root}/half,{root}/whole").load()
    return read.where("lat >= 40.42 and lat <= 40.45 and lon >= -79.95 and lon <= -79.92").select("label_id", "label_type", "severity")


def dirichlet_fit(spark, sf_dir):
    """Concentration of votes about images, by aid."""
    from kerbline.operators.tally import tally

    out = C.dirichlet_fit(tally(votes(spark, sf_dir)), ["aid"], list(CLASSES))
    return out.select("aid", "items", *(r6(c) for c in out.columns[2:]))


def simulated_scores(spark, sf_dir):
    """Scores for all edges, drawn by how well each aid is predicted."""
    quality = M.classification(predictions(spark, sf_dir), ["aid"], "label", "pred").select("aid", F.col("macro_f1").alias("f1"))
    return S.simulated_scores(edges(spark, sf_dir), quality).select("u", "v", "k", "aid", r6("p_yes"))


def _lines(spark, sf_dir):
    """Every 25 labels in order as one polyline."""
    at = labels(spark, sf_dir).select(F.floor((F.col("label_id") - 1) / 25).alias("route_id"), F.struct("label_id", "lat", "lon").alias("p"))
    coords = F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return at.groupBy("route_id").agg(coords.alias("coords"))


def snapped_routes(spark, sf_dir):
    g = graph(spark, sf_dir).select("u", "v", "k", "length", "p_yes")
    return R.snapped_routes(_lines(spark, sf_dir), nodes(spark, sf_dir), g).select("route_id", r6("length"), r6("p_yes"), "n_steps", "routed")


def _annotations(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 500).alias("image_id"), (F.col("p_size") % 4).cast("int").alias("category_id"), _polygon().alias("polygon"))


def annotations_by_image(spark, sf_dir):
    """Images with their projected annotations, nested, told as text."""
    images = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 520).alias("id")).distinct()
    done = A.grouped(images, A.deprojected(_annotations(spark, sf_dir), 1000, 1000, 640, 640, 0.2))
    told = F.transform("annotations", lambda a: F.concat_ws(":", a["id"], a["category_id"], F.coalesce(F.array_join(a["projected"], ","), F.lit("-")), F.coalesce(F.round(a["area_after"], 3).cast("string"), F.lit("-")), a["ok"]))
    return done.select("id", "n_shown", "n_ok", F.size("annotations").alias("n"), F.array_join(told, ";").alias("told"))


def pooled_tokens(spark, sf_dir):
    """Every 20 vectors as the tokens of one picture."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("item_id"), F.col("embedding").alias("vec"), F.when(F.floor(F.col("vec_id") / 20) % 4 == 0, 0.001).otherwise((F.col("vec_id") % 7) / 8).alias("mask"))
    out = X.pooled_tokens(e)
    return out.select("item_id", r6("coverage"), F.posexplode(F.arrays_zip("pooled", "plain")).alias("dim", "z")).select("item_id", "coverage", "dim", r6(F.col("z.pooled"), "pooled"), r6(F.col("z.plain"), "plain"))


def constant_baseline(spark, sf_dir):
    out = M.against_constant(predictions(spark, sf_dir), ["aid"], 2, "label", "pred")
    told = out.select("aid", "n", *(r6(c) for c in ("accuracy", "macro_f1", "balanced_accuracy", "constant_f1", "constant_balanced")))
    # gains are those of the figures as told
    return told.withColumns({"f1_gain": r6(F.col("macro_f1") - F.col("constant_f1"), "f1_gain"), "balanced_gain": r6(F.col("balanced_accuracy") - F.col("constant_balanced"), "balanced_gain")})


def _folds(spark, sf_dir):
    """Predictions with images dealt to runs and folds."""
    return predictions(spark, sf_dir).withColumns({"run": F.concat(F.lit("r"), F.col("image_id") % 3), "fold": F.col("image_id") % 4})


def fold_table(spark, sf_dir):
    out = M.fold_table(_folds(spark, sf_dir), "run", "aid", "fold", "label", "pred")
    return out.select("run", "aid", "fold", r6("macro_f1"), r6("balanced_accuracy"), "n_test")


def experiment_table(spark, sf_dir):
    return M.experiment_table(fold_table(spark, sf_dir), "run", "aid", ["click", "view", "purchase"], ["macro_f1", "balanced_accuracy"], 6)


QUERIES = {
    "fetch_cache": fetch_cache, "label_tiles": label_tiles, "dirichlet_fit": dirichlet_fit, "simulated_scores": simulated_scores, "snapped_routes": snapped_routes, "annotations_by_image": annotations_by_image,
    "pooled_tokens": pooled_tokens, "constant_baseline": constant_baseline, "fold_table": fold_table, "experiment_table": experiment_table,
}

_FOLDS = f"""{PRED}, runs AS (SELECT *, 'r' || image_id % 3 AS run, image_id % 4 AS fold FROM pred)"""
_BY_FOLD = f"by_fold AS (WITH {_class_sql('runs', 'run, aid, fold', 'label', 'pred')})"
_CELLS = ", ".join(f"round(max(CASE WHEN aid = '{a}' THEN {v} END), 6) AS {v}_{a}" for v in ("macro_f1", "balanced_accuracy") for a in ("click", "view", "purchase"))
_OVERALL = ", ".join(f"round(avg({v}), 6) AS {v}_overall, round(stddev_pop({v}), 6) AS {v}_std" for v in ("macro_f1", "balanced_accuracy"))

SQL = {
    "fetch_cache": """SELECT page_id, CASE WHEN page_id % 4 <> 2 THEN 'miss' ELSE 'hit' END AS status, CASE WHEN page_id % 4 = 2 THEN 5::BIGINT END AS bytes, CASE WHEN page_id % 4 = 2 THEN 2000::BIGINT END AS fetched_at FROM pages""",
    "label_tiles": f"WITH {LABELS} SELECT label_id, label_type, severity FROM labels_geo WHERE lat BETWEEN 40.42 AND 40.45 AND lon BETWEEN -79.95 AND -79.92",
    "annotations_by_image": f"""WITH {_POLY}, {_projected(0.2)},
edge AS (SELECT a.p_partkey, sum(a.x * b.y - b.x * a.y) AS c FROM g a JOIN g b ON a.p_partkey = b.p_partkey AND b.i = (a.i + 1) % a.n GROUP BY 1),
seen AS (SELECT p_partkey, i, a, b, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY p_partkey) AS m, bool_and(a >= 2 AND a < 638 AND b >= 2 AND b < 638) OVER (PARTITION BY p_partkey) AS inside FROM q WHERE a IS NOT NULL),
shown AS (SELECT p_partkey, string_agg(a || ',' || b, ',' ORDER BY j) AS t FROM seen WHERE m >= 3 AND inside GROUP BY 1),
after AS (SELECT x.p_partkey, abs(sum(x.a * y.b - y.a * x.b)) / 2 AS area FROM seen x JOIN seen y ON x.p_partkey = y.p_partkey AND y.j = (x.j + 1) % x.m GROUP BY 1),
n AS (SELECT p_partkey, any_value(n) AS n FROM g GROUP BY 1),
one AS (SELECT p.p_partkey AS id, p.p_partkey % 500 AS image_id, p.p_size % 4 AS category_id, s.t, CASE WHEN s.t IS NOT NULL THEN f.area::DOUBLE END AS area_after, CASE WHEN n.n < 3 THEN 0 ELSE abs(e.c) / 2 END AS area_before
  FROM part p JOIN n USING (p_partkey) JOIN edge e USING (p_partkey) LEFT JOIN shown s USING (p_partkey) LEFT JOIN after f USING (p_partkey)),
ok AS (SELECT *, coalesce(area_after / nullif(area_before, 0) BETWEEN 0.7 AND 1.3, false) AS ok FROM one),
i AS (SELECT DISTINCT p_partkey % 520 AS id FROM part)
SELECT i.id, count(t) AS n_shown, count(*) FILTER (ok) AS n_ok, count(ok.id)::INT AS n, coalesce(string_agg(ok.id || ':' || category_id || ':' || coalesce(t, '-') || ':' || coalesce(round(area_after, 3)::VARCHAR, '-') || ':' || ok, ';' ORDER BY ok.id), '') AS told
FROM i LEFT JOIN ok ON ok.image_id = i.id GROUP BY i.id""",
    "pooled_tokens": """WITH t AS (SELECT floor(vec_id / 20)::BIGINT AS item_id, vec_id, embedding, CASE WHEN floor(vec_id / 20) % 4 = 0 THEN 0.001 ELSE (vec_id % 7) / 8 END::DOUBLE AS m FROM embeddings),
c AS (SELECT item_id, avg(m) AS coverage, sum(m) AS w, count(*) AS n FROM t GROUP BY 1), d AS (SELECT item_id, m, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM t),
s AS (SELECT item_id, dim, coverage, CASE WHEN coverage < 0.02 THEN sum(x) / any_value(n) ELSE sum(x * m) / greatest(any_value(w), 1e-6) END AS a, sum(x) / any_value(n) AS b FROM d JOIN c USING (item_id) GROUP BY item_id, dim, coverage),
l AS (SELECT item_id, sqrt(sum(a * a)) AS na, sqrt(sum(b * b)) AS nb FROM s GROUP BY 1) SELECT item_id, round(coverage, 6) AS coverage, dim, round(a / na, 6) AS pooled, round(b / nb, 6) AS plain FROM s JOIN l USING (item_id)""",
    "constant_baseline": f"""WITH {PRED}, fixed AS (SELECT aid, label, 2 AS pred FROM pred), own AS (WITH {_class_sql('pred', 'aid', 'label', 'pred')}), base AS (WITH {_class_sql('fixed', 'aid', 'label', 'pred')})
SELECT aid, own.n, own.accuracy, own.macro_f1, own.balanced_accuracy, base.macro_f1 AS constant_f1, base.balanced_accuracy AS constant_balanced,
  round(own.macro_f1 - base.macro_f1, 6) AS f1_gain, round(own.balanced_accuracy - base.balanced_accuracy, 6) AS balanced_gain FROM own JOIN base USING (aid)""",
    "fold_table": f"WITH {_FOLDS}, {_BY_FOLD} SELECT run, aid, fold, macro_f1, balanced_accuracy, n AS n_test FROM by_fold",
    "experiment_table": f"WITH {_FOLDS}, {_BY_FOLD}, m AS (SELECT run, aid, avg(macro_f1) AS macro_f1, avg(balanced_accuracy) AS balanced_accuracy FROM by_fold WHERE aid IN ('click', 'view', 'purchase') GROUP BY 1, 2) SELECT run, {_CELLS}, {_OVERALL} FROM m GROUP BY run",
}
