"""Metrics over predicted distributions, reports over groups, rank statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog.common import VOTES, r6, table, votes
from kerbline.functions import distributions as D
from kerbline.operators import metrics as M, stats as S


def predictions(spark, sf_dir):
    """Shares among even users as predictions, among odd users as truth; cells with both."""
    v = votes(spark, sf_dir)
    share = lambda even, c: F.try_divide(F.count_if((F.col("pid") % 2 == even) & (F.col("selection") == c)), F.count_if(F.col("pid") % 2 == even))
    g = v.groupBy("image_id", "aid").agg(*(share(e, c).alias(f"{n}_{c}") for e, n in ((0, "p"), (1, "y")) for c in ("no", "unsure", "yes")))
    both = g.where("p_no is not null and y_no is not null")
    rows = both.select("image_id", "aid", F.array("p_no", "p_unsure", "p_yes").alias("p"), F.array("y_no", "y_unsure", "y_yes").alias("y"))
    return rows.withColumn("label", D.argmax(F.col("y"))).withColumn("pred", D.argmax(F.col("p")))


PRED = f"""{VOTES}, g AS (SELECT image_id, aid, count(*) FILTER (pid % 2 = 0) n0, count(*) FILTER (pid % 2 = 1) n1,
  count(*) FILTER (pid % 2 = 0 AND selection = 'no') a0, count(*) FILTER (pid % 2 = 0 AND selection = 'unsure') a1, count(*) FILTER (pid % 2 = 0 AND selection = 'yes') a2,
  count(*) FILTER (pid % 2 = 1 AND selection = 'no') b0, count(*) FILTER (pid % 2 = 1 AND selection = 'unsure') b1, count(*) FILTER (pid % 2 = 1 AND selection = 'yes') b2 FROM votes GROUP BY 1, 2),
pred AS (SELECT image_id, aid, a0 / n0 p0, a1 / n0 p1, a2 / n0 p2, b0 / n1 y0, b1 / n1 y1, b2 / n1 y2,
  CASE WHEN b0 >= b1 AND b0 >= b2 THEN 0 WHEN b1 >= b2 THEN 1 ELSE 2 END AS label, CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS pred FROM g WHERE n0 > 0 AND n1 > 0)"""


def brier_and_entropy(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("aid").agg(r6(M.brier_soft(), "brier_soft"), r6(M.brier_hard(), "brier_hard"), r6(M.entropy_correlation(), "entropy_corr"), F.count("*").alias("n"))


def calibration(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    a, b = M.calibration_error(rows, ["aid"]), M.calibration_error(rows, ["aid"], include_one=True).withColumnRenamed("ece", "ece_closed")
    return a.join(b, "aid").select("aid", r6("ece"), r6("ece_closed"))


def classification(spark, sf_dir):
    return M.classification(predictions(spark, sf_dir), ["aid"], "label", "pred").select("aid", "n", *(r6(c) for c in ("accuracy", "macro_f1", "balanced_accuracy")))


def classification_binary(spark, sf_dir):
    return M.classification(table(spark, sf_dir, "labels"), [], "quality", "toxic").select("n", *(r6(c) for c in ("accuracy", "macro_f1", "balanced_accuracy")))


def confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "yes").otherwise("no").alias("truth"), F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("pred"))
    return M.confusion(rows, ["no", "yes"])


def group_mean_std(spark, sf_dir):
    return M.mean_std(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice").select("o_orderpriority", r6("o_totalprice_mean"), r6("o_totalprice_std"))


def nan_mean_std(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("x"))
    return M.mean_std(o, ["o_orderpriority"], "x", skip_nan=True).select("o_orderpriority", r6("x_mean"), r6("x_std"))


def two_level_mean(spark, sf_dir):
    return M.two_level_mean(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderstatus"], "o_totalprice").select("o_orderstatus", r6("o_totalprice"))


def majority_class(spark, sf_dir):
    return M.majority(predictions(spark, sf_dir), ["image_id"], "label")


def paired_wins(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_discount").alias("x"))
    return M.paired_wins(o, "seed", "variant", "A", "x").select("variant", "n", "wins", r6("mean_delta"), r6("std_delta"))


def seed_spread(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("seed")).agg(F.round(F.avg("l_quantity"), 6).alias("x"))
    return M.spread(o, ["l_returnflag"], "x", "seed").select("l_returnflag", r6("low"), r6("high"), r6("spread"), "best")


def pivot_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = M.pivot_mean(o, "c_mktsegment", "o_orderstatus", ["F", "O", "P"], "o_totalprice", ["MACHINERY", "BUILDING"])
    return wide.select(F.col("c_mktsegment").alias("segment"), *(r6(c, f"s_{c.lower()}") for c in ("F", "O", "P")), r6("mean"))


def reduction(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("raw"), F.percentile("o_totalprice", 0.5).alias("ts"))
    return o.select("o_orderpriority", r6(M.reduction_percent(F.col("raw"), F.col("ts")), "reduction_pct"))


def percentile_summary(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").withColumn("p", 1 - 10 * F.col("l_discount"))
    s = S.summary(o, ["l_returnflag"], "p")
    return s.select("l_returnflag", "n", *(r6(c) for c in s.columns[2:]))


def _scores(spark, sf_dir):
    e = votes(spark, sf_dir)
    source = F.array(F.lit("labels"), F.lit("inference"), F.lit("prior"), F.lit(None))[(F.col("event_id") % 4).cast("int")]
    return e.select("aid", source.alias("source"), (F.col("value") / 500).alias("p_yes"))


def score_report(spark, sf_dir):
    return S.score_report(_scores(spark, sf_dir)).select("source", "aid", "level", "n", *(r6(c) for c in ("mean", *S.QUANTILES, "pct_below", "pct_above", "pct_of_whole")))


def source_counts(spark, sf_dir):
    return S.source_counts(_scores(spark, sf_dir))


def beta_sweep(spark, sf_dir):
    beta = spark.createDataFrame([(float(b),) for b in (1, 2, 4, 8, 16)], "beta double")
    per = _scores(spark, sf_dir).crossJoin(beta).groupBy("beta", "aid").agg(F.avg(F.col("p_yes") * (1 + F.col("beta") * (1 - F.col("p_yes")))).alias("cost"))
    return S.sweep_summary(per, "beta", "cost").select("beta", *(r6(f"{n}_cost") for n in ("mean", "min", "max")))


def outside_support(spark, sf_dir):
    return S.outside_support(votes(spark, sf_dir).withColumnRenamed("value", "dist"), "aid", "click").select("aid", "n", r6("pct_outside"))


def _cells(spark, sf_dir):
    return votes(spark, sf_dir).groupBy("aid", "image_id").agg(F.round(F.avg((F.col("selection") == "yes").cast("double")), 3).alias("x"), F.round(F.avg((F.col("selection") == "no").cast("double")), 3).alias("y"))


def spearman(spark, sf_dir):
    return S.spearman(_cells(spark, sf_dir), ["aid"], "x", "y").select("aid", "n", r6("rho"))


def wilcoxon(spark, sf_dir):
    sums = S.wilcoxon_sums(_cells(spark, sf_dir).withColumn("d", F.round(F.col("x") - F.col("y"), 3)), ["aid"], "d")
    return sums.select("aid", "n", r6("w_plus"), r6("variance"), "tied")


def wilcoxon_p(spark, sf_dir):
    return S.wilcoxon(_cells(spark, sf_dir).withColumn("d", F.round(F.col("x") - F.col("y"), 3)), ["aid"], "d").select("aid", "n", "w_plus", "p")


def paired_by_name(spark, sf_dir):
    """Mean prices by customer for two order states, of customers that have both."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("name"), "o_orderstatus").agg(F.avg(F.col("o_totalprice").cast("double")).alias("x"))
    return M.paired_by(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "name", "x").select("name", r6("soft"), r6("hard"), r6("reduction_pct"))


def seed_lists(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("seed")).agg(F.avg(F.col("l_discount").cast("double")).alias("x"))
    out = M.by_seed(li, ["l_returnflag"], "seed", "x")
    return out.select("l_returnflag", "n", r6("mean"), r6("std"), F.array_join(F.transform("values", lambda v: F.format_number(v, 5)), ",").alias("by_seed"))


QUERIES = {
    "paired_by_name": paired_by_name, "seed_lists": seed_lists,
    "brier_and_entropy": brier_and_entropy, "calibration_error": calibration, "classification_metrics": classification, "classification_binary": classification_binary, "confusion_matrix": confusion,
    "group_mean_std": group_mean_std, "nan_mean_std": nan_mean_std, "two_level_mean": two_level_mean, "majority_class": majority_class, "paired_wins": paired_wins, "seed_spread": seed_spread,
    "pivot_report": pivot_report, "reduction_percent": reduction, "percentile_summary": percentile_summary, "score_report": score_report, "source_counts": source_counts, "beta_sweep": beta_sweep,
    "outside_support": outside_support, "spearman": spearman, "wilcoxon_sums": wilcoxon, "wilcoxon_p": wilcoxon_p,
}

_H = "-({0} * ln({0}) + {1} * ln({1}) + {2} * ln({2})) / ln(3)"
_HP = _H.format(*(f"greatest(p{i}, 1e-12)" for i in range(3)))
_HY = _H.format(*(f"greatest(y{i}, 1e-12)" for i in range(3)))


def _class_sql(source: str, keys: str, truth: str, pred: str) -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""s AS (SELECT {k}{truth} AS c, 1 AS t, 0 AS p, CASE WHEN {truth} = {pred} THEN 1 ELSE 0 END AS h FROM {source} UNION ALL SELECT {k}{pred}, 0, 1, 0 FROM {source}),
b AS (SELECT {k}c, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM s GROUP BY {k}c)
SELECT {k}sum(t)::BIGINT AS n, round(sum(h) / sum(t), 6) AS accuracy, round(avg(2 * h / (t + p)), 6) AS macro_f1, round(avg(CASE WHEN t > 0 THEN h / t END), 6) AS balanced_accuracy FROM b {g}"""


_ECE = """bins AS (SELECT aid, {bin} AS bin, count(*) AS n, avg(greatest(p0, p1, p2)) AS conf, avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END) AS acc FROM pred GROUP BY 1, 2)"""
_SCORES = f"{VOTES}, scores AS (SELECT aid, CASE event_id % 4 WHEN 0 THEN 'labels' WHEN 1 THEN 'inference' WHEN 2 THEN 'prior' END AS source, value / 500 AS p_yes FROM votes)"
_CELLS = f"{VOTES}, cells AS (SELECT aid, image_id, round(avg(CASE WHEN selection = 'yes' THEN 1.0 ELSE 0 END), 3) AS x, round(avg(CASE WHEN selection = 'no' THEN 1.0 ELSE 0 END), 3) AS y FROM votes GROUP BY 1, 2)"

SQL = {
    "brier_and_entropy": f"""WITH {PRED} SELECT aid, round(avg((p0 - y0) ^ 2 + (p1 - y1) ^ 2 + (p2 - y2) ^ 2), 6) AS brier_soft,
  round(avg((p0 - (label = 0)::INT) ^ 2 + (p1 - (label = 1)::INT) ^ 2 + (p2 - (label = 2)::INT) ^ 2), 6) AS brier_hard, round(corr({_HP}, {_HY}), 6) AS entropy_corr, count(*) AS n FROM pred GROUP BY aid""",
    "calibration_error": f"""WITH {PRED}, {_ECE.format(bin="floor(greatest(p0, p1, p2) * 10)")}, closed AS (SELECT aid, least(floor(greatest(p0, p1, p2) * 10), 9) AS bin, count(*) AS n, avg(greatest(p0, p1, p2)) AS conf, avg(CASE WHEN pred = label THEN 1.0 ELSE 0 END) AS acc FROM pred GROUP BY 1, 2)
SELECT aid, round((SELECT sum(CASE WHEN bin < 10 THEN n * abs(acc - conf) ELSE 0 END) / sum(n) FROM bins WHERE bins.aid = k.aid), 6) AS ece, round((SELECT sum(n * abs(acc - conf)) / sum(n) FROM closed WHERE closed.aid = k.aid), 6) AS ece_closed FROM (SELECT DISTINCT aid FROM pred) k""",
    "classification_metrics": f"WITH {PRED}, {_class_sql('pred', 'aid', 'label', 'pred')}",
    "classification_binary": f"WITH {_class_sql('labels', '', 'quality', 'toxic')}",
    "confusion_matrix": """WITH g AS (SELECT * FROM (VALUES ('no'), ('yes')) a(truth), (VALUES ('no'), ('yes')) b(pred)), l AS (SELECT CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS truth, CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END AS pred FROM labels)
SELECT truth, pred, (SELECT count(*) FROM l WHERE l.truth = g.truth AND l.pred = g.pred) AS n FROM g""",
    "group_mean_std": "SELECT o_orderpriority, round(avg(o_totalprice), 6) AS o_totalprice_mean, round(stddev_pop(o_totalprice), 6) AS o_totalprice_std FROM orders GROUP BY 1",
    "nan_mean_std": "SELECT o_orderpriority, round(avg(o_totalprice), 6) AS x_mean, round(stddev_pop(o_totalprice), 6) AS x_std FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1",
    "two_level_mean": "WITH m AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) SELECT o_orderstatus, round(avg(m), 6) AS o_totalprice FROM m GROUP BY 1",
    "majority_class": f"WITH {PRED}, c AS (SELECT image_id, label, count(*) AS n FROM pred GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, label) AS i FROM c) SELECT image_id, label::INT AS label FROM r WHERE i = 1",
    "paired_by_name": """WITH m AS (SELECT o_custkey AS name, o_orderstatus AS s, avg(o_totalprice::DOUBLE) AS x FROM orders GROUP BY 1, 2)
SELECT a.name, round(a.x, 6) AS soft, round(b.x, 6) AS hard, round(100 * (b.x - a.x) / b.x, 6) AS reduction_pct FROM m a JOIN m b ON a.name = b.name AND a.s = 'F' AND b.s = 'O'""",
    "seed_lists": """WITH m AS (SELECT l_returnflag, l_linenumber AS seed, avg(l_discount::DOUBLE) AS x FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, string_agg(printf('%.5f', x), ',' ORDER BY seed) AS by_seed FROM m GROUP BY 1""",
    "paired_wins": """WITH m AS (SELECT l_returnflag AS variant, l_linenumber AS seed, avg(l_discount) AS x FROM lineitem GROUP BY 1, 2), d AS (SELECT a.variant, a.x - b.x AS d FROM m a JOIN m b ON a.seed = b.seed AND b.variant = 'A' WHERE a.variant <> 'A')
SELECT variant, count(*) AS n, count(*) FILTER (d < 0) AS wins, round(avg(d), 6) AS mean_delta, round(stddev_pop(d), 6) AS std_delta FROM d GROUP BY 1""",
    "seed_spread": """WITH m AS (SELECT l_returnflag, l_linenumber AS seed, round(avg(l_quantity), 6) AS x FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY x DESC, seed) AS i FROM m)
SELECT l_returnflag, round(min(x), 6) AS low, round(max(x), 6) AS high, round(max(x) - min(x), 6) AS spread, max(CASE WHEN i = 1 THEN seed END)::INT AS best FROM r GROUP BY 1""",
    "pivot_report": """WITH m AS (SELECT c_mktsegment AS segment, o_orderstatus AS s, avg(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT segment, round(max(CASE s WHEN 'F' THEN x END), 6) AS s_f, round(max(CASE s WHEN 'O' THEN x END), 6) AS s_o, round(max(CASE s WHEN 'P' THEN x END), 6) AS s_p, round(avg(x), 6) AS mean FROM m GROUP BY 1""",
    "reduction_percent": "SELECT o_orderpriority, round(100 * (avg(o_totalprice) - quantile_cont(o_totalprice, 0.5)) / avg(o_totalprice), 6) AS reduction_pct FROM orders GROUP BY 1",
    "percentile_summary": """WITH l AS (SELECT l_returnflag, 1 - 10 * l_discount AS p FROM lineitem) SELECT l_returnflag, count(*) AS n, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.1), 6) AS p10, round(quantile_cont(p, 0.25), 6) AS p25,
  round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.75), 6) AS p75, round(quantile_cont(p, 0.9), 6) AS p90, round(100 * avg((p < 0.5)::INT), 6) AS pct_below, round(100 * avg((p >= 0.8)::INT), 6) AS pct_above FROM l GROUP BY 1""",
    "score_report": f"""WITH {_SCORES}, n AS (SELECT aid, coalesce(source, 'unknown') AS source, p_yes FROM scores)
SELECT *, round(100.0 * n / max(CASE WHEN level >= 2 THEN n END) OVER (PARTITION BY level IN (0, 2), CASE WHEN level IN (0, 2) THEN aid END), 6) AS pct_of_whole FROM (
SELECT source, aid, grouping(source, aid)::BIGINT AS level, count(*) AS n, round(avg(p_yes), 6) AS mean, round(quantile_cont(p_yes, 0.1), 6) AS p10, round(quantile_cont(p_yes, 0.25), 6) AS p25,
  round(quantile_cont(p_yes, 0.5), 6) AS median, round(quantile_cont(p_yes, 0.75), 6) AS p75, round(quantile_cont(p_yes, 0.9), 6) AS p90, round(100 * avg((p_yes < 0.5)::INT), 6) AS pct_below, round(100 * avg((p_yes >= 0.8)::INT), 6) AS pct_above
FROM n GROUP BY GROUPING SETS ((source, aid), (aid), (source), ()))""",
    "source_counts": f"WITH {_SCORES} SELECT coalesce(source, '?') AS source, count(*) AS n FROM scores GROUP BY 1",
    "beta_sweep": f"""WITH {_SCORES}, b AS (SELECT unnest([1.0, 2.0, 4.0, 8.0, 16.0])::DOUBLE AS beta), m AS (SELECT beta, aid, avg(p_yes * (1 + beta * (1 - p_yes))) AS cost FROM scores, b GROUP BY 1, 2)
SELECT beta, round(avg(cost), 6) AS mean_cost, round(min(cost), 6) AS min_cost, round(max(cost), 6) AS max_cost FROM m GROUP BY 1""",
    "outside_support": f"WITH {VOTES}, l AS (SELECT quantile_cont(value, 0.9) AS q FROM votes WHERE aid = 'click') SELECT aid, count(*) AS n, round(100 * avg((value > q)::INT), 6) AS pct_outside FROM votes, l GROUP BY 1",
    "spearman": f"""WITH {_CELLS}, r AS (SELECT aid, rank() OVER (PARTITION BY aid ORDER BY x) + (count(*) OVER (PARTITION BY aid, x) - 1) / 2 AS a, rank() OVER (PARTITION BY aid ORDER BY y) + (count(*) OVER (PARTITION BY aid, y) - 1) / 2 AS b FROM cells)
SELECT aid, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""",
    "wilcoxon_sums": f"""WITH {_CELLS}, d AS (SELECT aid, round(x - y, 3) AS d FROM cells), r AS (SELECT aid, d, rank() OVER (PARTITION BY aid ORDER BY abs(d)) + (count(*) OVER (PARTITION BY aid, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY aid, abs(d)) AS t FROM d WHERE d <> 0)
SELECT aid, count(*) AS n, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 6) AS w_plus, round(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24 - sum(t * t - 1) / 48, 6) AS variance, sum(t * t - 1) > 0 AS tied FROM r GROUP BY 1""",
}
