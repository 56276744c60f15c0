"""Linear probes on feature vectors: folds, fits of all settings at once, scores, pseudo-labels.

A fit is a seed, fold, aid, loss, weight decay and so on.  ``probe_fit`` runs all fits of
a table side by side across tasks; ``fit_probe`` is one fit of whole arrays, for
tables that a program holds itself.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.functions import distributions as D
from kerbline.functions.vectors import linear
from kerbline.operators.probe_fit import Fit, count_training, log_softmax, moments, pack, prepare, scored, train, tune
from kerbline.operators.selection import mixed_int
from kerbline.plans.ranks import RANGES, placed
from kerbline.plans.scratch import Scratch

LR, EPOCHS, WEIGHT_DECAY, SEED = 1e-3, 50, 1e-4, 42


def scale_of(x: np.ndarray, centre: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Shift and divisor per dimension: population std, 1 where it is 0; no shift unless asked for."""
    std = x.std(axis=0)
    return (x.mean(axis=0) if centre else np.zeros(x.shape[1])), np.where(std < 1e-12, 1.0, std)


def _digamma(x: np.ndarray) -> np.ndarray:
    x, out = x.astype(float).copy(), np.zeros_like(x, dtype=float)
    for _ in range(6):
        small = x < 6
        out[small] -= 1 / x[small]
        x[small] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def loss_and_grad(loss: str, z: np.ndarray, target: np.ndarray, counts: np.ndarray, weight: np.ndarray, log_conc: float = 0.0, n: float | None = None, unit: float | None = None) -> tuple[float, np.ndarray, float]:
    """(value, gradient on logits, gradient on the log concentration).

    The rows may be a part of the whole: ``n`` is how many rows there are in all,
    and ``unit`` their mean number of votes; values of the parts add up.
    """
    logp = log_softmax(z)
    p, n = np.exp(logp), n or len(z)
    if loss == "soft_kl":
        value = (weight * np.where(target > 0, target * (np.log(np.maximum(target, 1e-300)) - logp), 0).sum(1)).sum() / n
        return value, weight[:, None] * (p * target.sum(1, keepdims=True) - target) / n, 0.0
    if loss == "hard_ce":
        hard = np.eye(z.shape[1])[target.argmax(1)]
        return (weight * -(hard * logp).sum(1)).sum() / n, weight[:, None] * (p - hard) / n, 0.0
    total = counts.sum(1)
    if loss == "multinomial":
        unit = total.mean() if unit is None else unit
        return (-(counts * logp).sum(1) / unit).sum() / n, (p * total[:, None] - counts) / unit / n, 0.0
    if loss == "dirichlet":
        conc = math.exp(log_conc)
        a, big = p * conc, np.full(len(z), conc)
        ll = _lgamma(big) - _lgamma(total + big) + (_lgamma(counts + a) - _lgamma(a)).sum(1)
        da = -(_digamma(counts + a) - _digamma(a)) / total[:, None] / n
        shared = -(_digamma(big) - _digamma(total + big)) / total / n
        dz = conc * (p * da - p * (p * da).sum(1, keepdims=True))
        return (-ll / total).sum() / n, dz, float((da * a).sum() + (shared * conc).sum())
    raise ValueError(f"unknown loss {loss}")


def fit_probe(
    x: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, counts: np.ndarray | None = None, aid: np.ndarray | None = None,
    loss: str = "soft_kl", head: str = "independent", rank: int = 0, seed: int = SEED, weight_decay: float = WEIGHT_DECAY, lr: float = LR, epochs: int = EPOCHS,
) -> dict:
    """Fit W, b by Adam with L2 in the gradient, full batches.

    ``head``: independent (a map per aid), low_rank (one projection to ``rank``
    for all aids), low_rank_per_aid (a projection per aid).  With rank 0 and one
    aid this is a plain linear probe.  The result holds effective weights: W of
    shape (aids, classes, dimensions) and b of (aids, classes).
    """
    n, d, c = len(x), x.shape[1], target.shape[1]
    aid = np.zeros(n, int) if aid is None else aid
    aids = int(aid.max()) + 1 if n else 1
    weight = np.ones(n) if weight is None else weight
    counts = target if counts is None else counts
    rng = np.random.default_rng(seed)
    bound = lambda shape, fan: rng.uniform(-1, 1, shape) / math.sqrt(fan)
    low = rank > 0 or head != "independent"
    r = rank or 8
    par = {"b": np.zeros((aids, c))}
    if low:
        par["P"] = bound((aids if head == "low_rank_per_aid" else 1, r, d), d)
        par["W"] = bound((aids, c, r), r)
    else:
        par["W"] = bound((aids, c, d), d)
    if loss == "dirichlet":
        par["conc"] = np.array([math.log(200.0)])
    m, v = ({k: np.zeros_like(a) for k, a in par.items()} for _ in range(2))
    rows = [np.flatnonzero(aid == a) for a in range(aids)]
    value = float("nan")
    for step in range(1, epochs + 1):
        z, hidden = np.zeros((n, c)), {}
        for a, own in enumerate(rows):
            h = x[own]
            if low:
                hidden[a] = h = h @ par["P"][a if len(par["P"]) > 1 else 0].T
            z[own] = h @ par["W"][a].T + par["b"][a]
        value, dz, dconc = loss_and_grad(loss, z, target, counts, weight, float(par["conc"][0]) if "conc" in par else 0.0)
        grad = {k: weight_decay * a for k, a in par.items()}
        for a, own in enumerate(rows):
            g = dz[own]
            grad["b"][a] = grad["b"][a] + g.sum(0)
            if low:
                k = a if len(par["P"]) > 1 else 0
                grad["W"][a] = grad["W"][a] + g.T @ hidden[a]
                grad["P"][k] = grad["P"][k] + (g @ par["W"][a]).T @ x[own]
            else:
                grad["W"][a] = grad["W"][a] + g.T @ x[own]
        if "conc" in par:
            grad["conc"] = grad["conc"] + dconc
        for k in par:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            par[k] = par[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    w = par["W"] @ par["P"] if low else par["W"]
    return {"W": w, "b": par["b"], "loss": float(value), "log_conc": float(par["conc"][0]) if "conc" in par else None}


def predict(x: np.ndarray, model: dict, aid: np.ndarray | None = None, temperature: float = 1.0) -> np.ndarray:
    aid = np.zeros(len(x), int) if aid is None else aid
    z = np.einsum("nd,ncd->nc", x, model["W"][aid]) + model["b"][aid]
    return np.exp(log_softmax(z / temperature))


def tune_temperature(logits: np.ndarray, label: np.ndarray, low: float = 0.05, high: float = 20.0, tolerance: float = 1e-4) -> float:
    """The temperature of least negative log-likelihood, by golden-section search."""
    nll = lambda t: -log_softmax(logits / t)[np.arange(len(label)), label].mean()
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    x1, x2 = b - g * (b - a), a + g * (b - a)
    f1, f2 = nll(x1), nll(x2)
    while b - a > tolerance:
        if f1 < f2:
            b, x2, f2 = x2, x1, f1
            x1 = b - g * (b - a)
            f1 = nll(x1)
        else:
            a, x1, f1 = x1, x2, f2
            x2 = a + g * (b - a)
            f2 = nll(x2)
    return (a + b) / 2


# ---- folds -----------------------------------------------------------------------------------------------------------


def _span(h: Column) -> Column:
    """Ranges of equal width of ``mixed_int``, whose values are spread evenly over 31 bits."""
    return F.floor(h * RANGES / 2147483647).cast("int")


def stratified_folds(items: DataFrame, k: int, label: str = "label", key: str = "item_id", seed: int = SEED) -> DataFrame:
    """Items dealt to k folds so that each class is spread evenly; with fewer items than folds each is its own fold."""
    low = items.groupBy(label).agg(F.count("*").alias("_n"))  # a row for each class
    first = low.select(label, F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    h = mixed_int(F.col(key), seed)
    dealt = placed(items.join(first, items[label].eqNullSafe(first[label])).drop(first[label]), [label], _span(h), [h, key], "_place")
    return dealt.withColumn("fold", ((F.col("_first") + F.col("_place")) % k).cast("int")).select(*items.columns, "fold")


def plain_folds(items: DataFrame, k: int, key: str = "item_id", seed: int = SEED) -> DataFrame:
    """The same folds for every variant: k equal runs of a fixed order."""
    h = mixed_int(F.col(key), seed)
    n = items.agg(F.count("*").alias("_n"))  # one row
    dealt = placed(items, [], _span(h), [h, key], "_place").crossJoin(F.broadcast(n))
    # the first n mod k runs have one item more
    long, size = F.col("_n") % k, F.floor(F.col("_n") / k)
    run = F.when(F.col("_place") < long * (size + 1), F.floor(F.col("_place") / (size + 1))).otherwise(long + F.floor((F.col("_place") - long * (size + 1)) / F.greatest(size, F.lit(1))))
    return dealt.withColumn("fold", run.cast("int")).select(*items.columns, "fold")


def leave_group_out(rows: DataFrame, group: str, least: int = 2) -> DataFrame:
    """Each row once for each held-out group of at least ``least`` rows: held_out, is_test."""
    groups = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(F.col(group).alias("held_out"))
    return rows.join(groups, how="cross").withColumn("is_test", F.col(group) == F.col("held_out"))


def split_train(rows: DataFrame, folds: DataFrame, fold: int, key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(train, test) by membership in a fold."""
    test = folds.where(F.col("fold") == fold).select(key)
    return rows.join(test, key, "left_anti"), rows.join(test, key, "left_semi")


def grid(spark, **options: list) -> DataFrame:
    """All combinations of settings, one row each."""
    out = None
    for name, values in options.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.join(one, how="cross")
    return out


# ---- fitting across tasks -----------------------------------------------------------------------------------------------


def _table(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[str], dict, int, int]:
    """Blocks of the rows, the aids in order, moments by (place of aid, fold), how many numbers and classes there are."""
    held = rows if hasattr(rows, "scratch_path") else scratch.write(rows, "rows")
    found = held.groupBy("aid").agg(F.max(F.size("y")).alias("classes")).collect()  # a row for each aid
    aids = sorted(r["aid"] for r in found)
    blocks = pack(held, aids, scratch)
    if held is not rows:
        scratch.drop(held)
    known = moments(blocks)
    return blocks, aids, known, int(sum(m.n * len(m.mean) for m in known.values())), max((r["classes"] for r in found), default=0)


def cross_validate(rows: DataFrame, settings: DataFrame, scratch: Scratch, k: int = 5, centre: bool = False, temperature: bool = False, lr: float = LR, epochs: int = EPOCHS) -> DataFrame:
    """Held-out predictions of every setting x seed x fold x aid.

    ``rows``: item_id, aid, vec, y (soft target), counts, label, sample_weight, fold.
    ``settings``: seed, loss, weight_decay (one row per variant).  Output: the
    setting, fold, aid, item_id, label, y, probs, temperature.
    """
    blocks, aids, known, numbers, classes = _table(rows, scratch)
    keys = {"seed": "int", "loss": "string", "weight_decay": "double"}
    fits = [
        Fit(s.asDict(), [a], held, s["loss"], seed=s["seed"], weight_decay=s["weight_decay"], calibrate=temperature, classes=classes)
        for s in settings.select(*keys).collect() for held in range(k) for a in range(len(aids))
    ]
    return _fitted(blocks, [f for f in fits if prepare(f, known, centre)], aids, keys, numbers, lr, epochs)


def fit_heads(rows: DataFrame, settings: DataFrame, scratch: Scratch, k: int = 5, lr: float = LR, epochs: int = EPOCHS) -> DataFrame:
    """Held-out predictions of heads for all aids fitted together, for every setting x fold.

    ``rows`` as for ``cross_validate``.  ``settings``: seed, head (independent,
    low_rank or low_rank_per_aid), rank (0 for full), weight_decay.  Any
    number of classes and aids; one aid with ``head`` independent is a plain probe.
    Aids that a fold's training rows lack have no head and no predictions.
    """
    blocks, aids, known, numbers, classes = _table(rows, scratch)
    keys = {"seed": "int", "head": "string", "rank": "int", "weight_decay": "double"}
    fits = []
    for s in settings.select(*keys).collect():
        for held in range(k):
            own = sorted({a for a, f in known if f != held})
            fits.append(Fit(s.asDict(), own, held, "soft_kl", s["head"], s["rank"], s["seed"], s["weight_decay"], classes=classes))
    return _fitted(blocks, [f for f in fits if prepare(f, known)], aids, keys, numbers, lr, epochs).drop("temperature")


def _fitted(blocks: DataFrame, fits: list[Fit], aids: list[str], keys: dict[str, str], numbers: int, lr: float, epochs: int) -> DataFrame:
    count_training(blocks, fits)
    train(blocks, fits, numbers, loss_and_grad, epochs, lr)
    tune(blocks, fits)
    return scored(blocks, fits, aids, keys)


def fit_final(rows: DataFrame, scratch: Scratch, loss: str = "soft_kl", centre: bool = False, seed: int = SEED, weight_decay: float = WEIGHT_DECAY, lr: float = LR, epochs: int = EPOCHS) -> DataFrame:
    """Weights per aid on all rows: aid, W (class rows), b, shift, divisor.  This table is the checkpoint."""
    extra = {"counts": F.col("y"), "label": F.lit(0), "fold": F.lit(0)}
    whole = rows.withColumns({c: v for c, v in extra.items() if c not in rows.columns})
    blocks, aids, known, numbers, classes = _table(whole, scratch)
    fits = [Fit({}, [a], -1, loss, seed=seed, weight_decay=weight_decay, classes=classes) for a in range(len(aids))]
    fits = [f for f in fits if prepare(f, known, centre)]
    train(blocks, fits, numbers, loss_and_grad, epochs, lr)
    scratch.drop(blocks)
    done = [(aids[f.aids[0]], f.weights()[0][0].tolist(), f.weights()[1][0].tolist(), f.shift.tolist(), f.divisor.tolist()) for f in fits]
    return rows.sparkSession.createDataFrame(done, "aid string, W array<array<double>>, b array<double>, shift array<double>, divisor array<double>")


def apply_probes(items: DataFrame, weights: DataFrame, vec: str = "vec") -> DataFrame:
    """Every item with every aid's probabilities; the weights are one row per aid and stay in the JVM."""
    return _probed(items.join(F.broadcast(weights), how="cross"), vec)


def _probed(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows that have the weights of a probe beside their vector, with its probabilities in their place."""
    scaled = F.zip_with(F.zip_with(F.col(vec), F.col("shift"), lambda x, s: x.cast("double") - s), F.col("divisor"), lambda x, s: x / s)
    logits = D.bound(scaled, lambda x: linear(F.col("W"), F.col("b"), x))
    return rows.withColumn("probs", D.softmax(logits)).drop("W", "b", "shift", "divisor")


def summarise_predictions(scored: DataFrame) -> DataFrame:
    """Inference output: probabilities rounded, entropy, confidence, passable."""
    h = D.normalised_entropy(F.col("probs"), 1e-9, None)
    return scored.select(
        "*", *(F.round(F.col("probs")[i], 4).alias(f"p_{c}") for i, c in enumerate(("no", "unsure", "yes"))), F.round(h, 4).alias("entropy"),
        D.confidence(h).alias("confidence"), (F.col("probs")[2] >= 0.5).alias("passable"),
    )


def binary_by_mean(scored: DataFrame, item: str = "item_id") -> DataFrame:
    """Per item the mean p_yes over aids and whether it is at least a half."""
    return scored.groupBy(item).agg(F.avg(F.col("probs")[2]).alias("p_yes")).withColumn("pred", F.when(F.col("p_yes") >= 0.5, "yes").otherwise("no"))


def consistent(pred: Column, given_label: Column) -> Column:
    """A pseudo-label that an existing label does not contradict; without a label "yes" contradicts."""
    curb = F.coalesce(given_label == "CurbRamp", F.lit(False))
    return ~((curb & (pred == 0)) | (~curb & (pred == 2)))


def self_trained(rows: DataFrame, pool: DataFrame, scratch: Scratch, held: int = 0, options: dict | None = None, **rules) -> DataFrame:
    """Held-out predictions of a probe on real votes and of one fitted again with pseudo-labels of a pool: model, aid, item_id, y, label, probs.

    ``rows`` as for ``cross_validate``; fold ``held`` is left out of both fits.
    ``pool``: item_id, vec, and given_label where labels are checked.  ``rules``
    go to ``pseudo_rows``.  Without surviving pseudo-labels both fits are one.
    """
    rows = rows if hasattr(rows, "scratch_path") else scratch.write(rows, "voted")
    train, test = rows.where(F.col("fold") != held), rows.where(F.col("fold") == held)
    real = train.select("item_id", "aid", "vec", "y", "sample_weight")
    first = scratch.write(fit_final(real, scratch, **(options or {})), "first")
    kept = pseudo_rows(apply_probes(pool, first), **rules).select("item_id", "aid", "vec", "y", "sample_weight")
    again = scratch.write(fit_final(real.unionByName(kept), scratch, **(options or {})), "again")
    out = None
    for name, weights in (("votes", first), ("votes and pseudo-labels", again)):
        own = _probed(test.join(F.broadcast(weights), "aid")).select(F.lit(name).alias("model"), "aid", "item_id", "y", "label", "probs")  # a row for each aid
        out = own if out is None else out.unionByName(own)
    return out


def pseudo_rows(scored: DataFrame, max_entropy: float = 0.5, check_labels: bool = True, most: int = 0, weight: float = 0.3, item: str = "item_id") -> DataFrame:
    """Confident pool predictions as training rows: y, sample_weight = weight * (1 - entropy); the most confident ``most`` per aid, 0 for all."""
    h = D.normalised_entropy(F.col("probs"))
    kept = scored.withColumn("entropy", h).withColumn("pred", D.argmax(F.col("probs"))).where(F.col("entropy") <= max_entropy)
    if check_labels:
        kept = kept.where(consistent(F.col("pred"), F.col("given_label")))
    if most:
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("aid").orderBy("entropy", item))).where(F.col("_n") <= most).drop("_n")
    return kept.withColumn("y", F.col("probs")).withColumn("sample_weight", weight * (1 - F.col("entropy")))
