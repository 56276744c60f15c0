"""Vectors, sampling, folds, probes and pseudo-labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline.catalog.common import KIND, kind_of, r6, table, votes
from kerbline.catalog.measures import PRED, predictions
from kerbline.functions import distributions as D, vectors as X
from kerbline.operators import probes as P, selection as S, stats
from kerbline.plans.scratch import Scratch


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label")


def normalised(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("u", X.l2_normalise(F.col("vec")))
    return v.select("key", r6(X.norm(F.col("vec")), "norm"), r6(F.col("u")[0], "first"), r6(X.dot(F.col("u"), F.col("u")), "unit"))


def support_distance(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return stats.nearest_reference(v, v.where("label = 0")).select("key", r6("dist"))


def dimension_scale(spark, sf_dir):
    return stats.dimension_scale(vectors(spark, sf_dir)).select("dim", r6("divisor"))


def softmax(spark, sf_dir):
    """Shares of all dimensions: the first, the largest and where it is, and their entropy."""
    v = vectors(spark, sf_dir).withColumn("p", D.softmax(F.transform("vec", lambda x: x.cast("double")), 0.5))
    entropy = F.aggregate("p", F.lit(0.0), lambda a, x: a - x * F.ln(x))
    return v.select("key", r6(F.col("p")[0], "first"), r6(F.array_max("p"), "largest"), r6(entropy, "entropy"), D.argmax(F.col("p")).alias("best"))


def centroid_probe(spark, sf_dir):
    """Class scores by a linear map whose rows are the class means."""
    v = vectors(spark, sf_dir).where("label < 3")
    means = v.select("label", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("w"))
    w = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "w"))), lambda s: s["w"]).alias("W"))
    z = X.linear(F.col("W"), F.array(F.lit(0.0), F.lit(0.5), F.lit(-0.5)), F.col("vec"))
    return vectors(spark, sf_dir).crossJoin(F.broadcast(w)).select("key", z.alias("z")).select("key", *(r6(F.col("z")[i], f"z{i}") for i in range(3)))  # one row of weights


def acquisition(spark, sf_dir):
    p = predictions(spark, sf_dir).select(F.col("image_id").alias("item_id"), F.col("p").alias("probs"))
    return S.acquisition(p).select("item_id", *(r6(c) for c in ("entropy", "disagreement", "hybrid")))


def top_ranked(spark, sf_dir):
    return S.ranked_top(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("score")), 25, "score", "key")


def top_fraction(spark, sf_dir):
    return S.top_fraction(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("score")), 0.05, 10, "score", "key")


def balanced_top(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", kind_of(F.col("c_custkey")).alias("kind"), "c_acctbal")
    return S.balanced_top(c, 5, "kind", F.desc("c_acctbal"), "c_custkey")


def sampled(spark, sf_dir):
    return S.sample_n(table(spark, sf_dir, "customer").select("c_custkey"), 60, "c_custkey")


def sampled_fraction(spark, sf_dir):
    return S.sample_fraction(table(spark, sf_dir, "orders").select("o_orderkey"), 0.2, "o_orderkey", 7)


def k_centre(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return S.greedy_k_centre(v.where("label <> 0"), v.where("label = 0"), 12, Scratch(spark, "k-centre"))


def folds(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), (F.col("c_custkey") % 3).alias("label"))
    return P.stratified_folds(items, 5).join(P.plain_folds(items.select("item_id"), 5).withColumnRenamed("fold", "plain"), "item_id")


def leave_group_out(spark, sf_dir):
    out = P.leave_group_out(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return out.groupBy("held_out").agg(F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train"))


def pseudo_labels(spark, sf_dir):
    p = predictions(spark, sf_dir).select((F.col("image_id") * 10 + F.length("aid")).alias("item_id"), "aid", F.col("p").alias("probs"), F.when(F.col("image_id") % 8 > 0, kind_of(F.col("image_id") + 3)).alias("given_label"))
    return P.pseudo_rows(p, 0.98, True, 20).select("item_id", "aid", "pred", r6("entropy"), r6("sample_weight"))


def training_rows(spark, sf_dir):
    """Vectors joined to cells of votes: every vector is an image, and an event's number, modulo their number, says which it votes on."""
    v = vectors(spark, sf_dir).select(F.col("key").alias("image_id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    from kerbline.operators.tally import tally

    n = v.agg(F.max("image_id").alias("n"))  # one row
    cast = votes(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("image_id", F.col("event_id") % (F.col("n") + 1)).drop("n")
    t = tally(cast).join(v, "image_id")
    y, n = F.array("p_no", "p_unsure", "p_yes"), F.array(*(F.col(c).cast("double") for c in ("no", "unsure", "yes")))
    rows = t.select(F.col("image_id").alias("item_id"), "aid", "vec", y.alias("y"), n.alias("counts"), D.argmax(y).alias("label"), "sample_weight")
    return rows.join(P.plain_folds(rows.select("item_id").distinct(), 5), "item_id")


def cross_validated(spark, sf_dir):
    """Held-out Brier scores of soft and hard probes, with and without a tuned temperature."""
    from kerbline.operators import metrics as M

    grid = P.grid(spark, seed=[42, 43], loss=["soft_kl", "hard_ce", "multinomial"], weight_decay=[1e-4]).selectExpr("cast(seed as int) seed", "loss", "weight_decay")
    rows = Scratch(spark, "probes").write(training_rows(spark, sf_dir), "voted")
    raw, tuned = (P.cross_validate(rows, grid, Scratch(spark, "probes"), 5, temperature=t).groupBy("loss", "aid").agg(M.brier_soft("probs", "y").alias(n), F.count("*").alias(f"n_{n}")) for t, n in ((False, "raw"), (True, "tuned")))
    return raw.join(tuned, ["loss", "aid"])


def coupled_heads(spark, sf_dir):
    """Held-out Brier scores of independent and coupled heads of all aids."""
    from kerbline.operators import metrics as M

    heads = spark.createDataFrame([(42, h, r, 1e-4) for h, r in (("independent", 0), ("low_rank", 4), ("low_rank_per_aid", 4))], "seed int, head string, rank int, weight_decay double")
    return P.fit_heads(training_rows(spark, sf_dir), heads, Scratch(spark, "heads")).groupBy("head", "aid").agg(M.brier_soft("probs", "y").alias("brier"), F.count("*").alias("n"))


def benchmark_probe(spark, sf_dir):
    """A benchmark of many classes: held-out accuracy by weight decay."""
    v = vectors(spark, sf_dir).where("label is not null")
    classes = v.agg((F.max("label") + 1).alias("classes"))  # one row
    y = F.transform(F.sequence(F.lit(0), F.col("classes") - 1), lambda c: (c == F.col("label")).cast("double"))
    rows = v.crossJoin(F.broadcast(classes)).select(F.col("key").alias("item_id"), F.lit("all").alias("aid"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), y.alias("y"), y.alias("counts"), F.col("label").cast("int").alias("label"), F.lit(1.0).alias("sample_weight"))
    settings = spark.createDataFrame([(42, "independent", 0, w) for w in (0.0, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 1.0)], "seed int, head string, rank int, weight_decay double")
    done = P.fit_heads(rows.join(P.plain_folds(rows.select("item_id"), 5), "item_id"), settings, Scratch(spark, "benchmark"))
    return done.groupBy("weight_decay").agg(F.count("*").alias("n"), F.avg((D.argmax(F.col("probs")) == F.col("label")).cast("double")).alias("accuracy"))


def first_rows(spark, sf_dir):
    return S.first_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 40, "o_orderkey")


def inference(spark, sf_dir):
    w = P.fit_final(training_rows(spark, sf_dir), Scratch(spark, "inference"))
    items = vectors(spark, sf_dir).select(F.col("key").alias("item_id"), "vec")
    return P.summarise_predictions(P.apply_probes(items, w)).drop("vec", "probs")


def self_training(spark, sf_dir):
    """Held-out Brier scores and accuracy with and without pseudo-labels of the unvoted vectors."""
    from kerbline.operators import metrics as M

    rows = Scratch(spark, "self-training").write(training_rows(spark, sf_dir), "voted")
    pool = vectors(spark, sf_dir).join(rows.select(F.col("item_id").alias("key")).distinct(), "key", "left_anti").select(F.col("key").alias("item_id"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), kind_of(F.col("key")).alias("given_label"))
    done = P.self_trained(rows, pool, Scratch(spark, "self-training"), max_entropy=0.9, most=50)
    return done.groupBy("model", "aid").agg(F.count("*").alias("n"), M.brier_soft("probs", "y").alias("brier"), F.avg((D.argmax(F.col("probs")) == F.col("label")).cast("double")).alias("accuracy"))


QUERIES = {
    "vector_norms": normalised, "support_distance": support_distance, "dimension_scale": dimension_scale, "softmax_temperature": softmax, "centroid_probe": centroid_probe, "acquisition": acquisition, "top_ranked": top_ranked,
    "top_fraction": top_fraction, "balanced_top": balanced_top, "sample_n": sampled, "sample_fraction": sampled_fraction, "k_centre": k_centre, "folds": folds, "leave_group_out": leave_group_out, "pseudo_labels": pseudo_labels,
    "cross_validated": cross_validated, "probe_inference": inference, "self_training": self_training, "coupled_heads": coupled_heads, "benchmark_probe": benchmark_probe, "first_n": first_rows,
}

_VEC = "v AS (SELECT vec_id AS key, embedding::DOUBLE[] AS vec, label FROM embeddings)"
_MIX = "((({k} * 1103515 + {s} * 12345) % 2147483647 * 48271) % 2147483647 * 16807) % 2147483647"
_H = "-(greatest(p0, 1e-12) * ln(greatest(p0, 1e-12)) + greatest(p1, 1e-12) * ln(greatest(p1, 1e-12)) + greatest(p2, 1e-12) * ln(greatest(p2, 1e-12))) / ln(3)"

SQL = {
    "first_n": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 40",
    "vector_norms": f"WITH {_VEC}, n AS (SELECT key, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS n FROM v) SELECT key, round(n, 6) AS norm, round(vec[1] / n, 6) AS first, 1.0::DOUBLE AS unit FROM n",
    "support_distance": f"""WITH {_VEC}, n AS (SELECT key, label, list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y)))) AS u FROM v)
SELECT a.key, round(min(1 - list_dot_product(a.u, b.u)), 6) AS dist FROM n a JOIN n b ON b.label = 0 AND a.key <> b.key GROUP BY 1""",
    "dimension_scale": f"WITH {_VEC}, d AS (SELECT unnest(range(len(vec)))::INT AS dim, unnest(vec) AS x FROM v) SELECT dim, round(stddev_pop(x), 6) AS divisor FROM d GROUP BY 1",
    "softmax_temperature": f"""WITH {_VEC}, e AS (SELECT key, vec, list_transform(vec, lambda x: exp((x - list_max(vec)) / 0.5)) AS e FROM v), p AS (SELECT key, vec, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT key, round(p[1], 6) AS first, round(list_max(p), 6) AS largest, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) AS entropy, (list_position(p, list_max(p)) - 1)::INT AS best FROM p""",
    "centroid_probe": f"""WITH {_VEC}, d AS (SELECT key, label, unnest(range(len(vec))) AS dim, unnest(vec) AS x FROM v), m AS (SELECT label, dim, avg(x) AS m FROM d WHERE label < 3 GROUP BY 1, 2)
SELECT key, round(sum(x * m) FILTER (m.label = 0), 6) AS z0, round(sum(x * m) FILTER (m.label = 1) + 0.5, 6) AS z1, round(sum(x * m) FILTER (m.label = 2) - 0.5, 6) AS z2 FROM d JOIN m USING (dim) GROUP BY key""",
    "acquisition": f"""WITH {PRED}, m AS (SELECT image_id, avg(p0) p0, avg(p1) p1, avg(p2) p2, (stddev_pop(p0) + stddev_pop(p1) + stddev_pop(p2)) / 3 AS d FROM pred GROUP BY 1), h AS (SELECT image_id, {_H} AS h, d FROM m)
SELECT image_id AS item_id, round(h, 6) AS entropy, round(d, 6) AS disagreement, round(h * d, 6) AS hybrid FROM h""",
    "top_ranked": "SELECT o_orderkey AS key, o_totalprice AS score, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders ORDER BY score DESC, key LIMIT 25",
    "top_fraction": "SELECT key, score FROM (SELECT c_custkey AS key, c_acctbal AS score, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) WHERE i <= greatest(10, floor((SELECT count(*) FROM customer) * 0.05))",
    "balanced_top": f"SELECT c_custkey, kind, c_acctbal FROM (SELECT c_custkey, {KIND.format(k='c_custkey')} AS kind, c_acctbal, row_number() OVER (PARTITION BY c_custkey % 7 ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) WHERE i <= 5",
    "sample_n": f"SELECT c_custkey FROM customer ORDER BY {_MIX.format(k='c_custkey', s=42)}, c_custkey LIMIT 60",
    "sample_fraction": f"SELECT o_orderkey FROM orders WHERE {_MIX.format(k='o_orderkey', s=7)} < 429496729",
    "folds": f"""WITH i AS (SELECT c_custkey AS item_id, c_custkey % 3 AS label, {_MIX.format(k='c_custkey', s=42)} AS h FROM customer)
SELECT item_id, label, ((row_number() OVER (ORDER BY label, h, item_id) - 1) % 5)::INT AS fold, (ntile(5) OVER (ORDER BY h, item_id) - 1)::INT AS plain FROM i""",
    "leave_group_out": """WITH g AS (SELECT c_mktsegment AS held_out FROM customer GROUP BY 1 HAVING count(*) >= 2)
SELECT held_out, count(*) FILTER (c_mktsegment = held_out) AS test, count(*) FILTER (c_mktsegment <> held_out) AS train FROM customer, g GROUP BY 1""",
    "pseudo_labels": f"""WITH {PRED}, h AS (SELECT image_id * 10 + length(aid) AS item_id, aid, pred, CASE WHEN image_id % 8 > 0 THEN {KIND.format(k='image_id + 3')} END AS l, {_H} AS h FROM pred),
f AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY h, item_id) AS i FROM h WHERE h <= 0.98 AND NOT ((coalesce(l, '') = 'CurbRamp' AND pred = 0) OR (coalesce(l, '') <> 'CurbRamp' AND pred = 2)))
SELECT item_id, aid, pred::INT AS pred, round(h, 6) AS entropy, round(0.3 * (1 - h), 6) AS sample_weight FROM f WHERE i <= 20""",
}
