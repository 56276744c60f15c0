"""Evaluation of predicted distributions and labels; all by grouped aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions import distributions as D


def brier_soft(p: str = "p", y: str = "y") -> Column:
    return F.avg(D.squared_error(F.col(p), F.col(y)))


def brier_hard(p: str = "p", label: str = "label", n: int = 3) -> Column:
    return F.avg(D.squared_error(F.col(p), D.one_hot(F.col(label), n)))


def correlation(x: Column, y: Column, least_std: float = 1e-12) -> Column:
    """Pearson correlation; null when either side does not vary."""
    steady = (F.stddev_pop(x) < least_std) | (F.stddev_pop(y) < least_std)
    return F.when(~steady, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def entropy_correlation(p: str = "p", y: str = "y") -> Column:
    return correlation(D.normalised_entropy(F.col(p)), D.normalised_entropy(F.col(y)))


def calibration_error(rows: DataFrame, keys: list[str], p: str = "p", label: str = "label", bins: int = 10, include_one: bool = False) -> DataFrame:
    """ECE per key: weighted gap of accuracy and confidence over equal bins [low, high).

    Confidence 1.0 falls in no bin unless ``include_one``; it still counts in the total.
    """
    conf = F.array_max(F.col(p))
    bin_ = F.floor(conf * bins).cast("int")
    if include_one:
        bin_ = F.least(bin_, F.lit(bins - 1))
    hit = (D.argmax(F.col(p)) == F.col(label)).cast("double")
    per_bin = rows.select(*keys, bin_.alias("bin"), conf.alias("conf"), hit.alias("hit")).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("conf").alias("conf"), F.avg("hit").alias("acc"))
    gap = F.when(F.col("bin") < bins, F.col("n") * F.abs(F.col("acc") - F.col("conf"))).otherwise(0.0)
    return per_bin.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def classification(rows: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Per key: n, accuracy, macro-F1 over all classes seen on either side, balanced accuracy over classes in truth."""
    pairs = rows.groupBy(*keys, truth, pred).agg(F.count("*").alias("n"))
    sides = pairs.select(*keys, F.inline(F.array(
        F.struct(F.col(truth).alias("c"), F.col("n").alias("in_truth"), F.lit(0).cast("long").alias("in_pred"), F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(pred).alias("c"), F.lit(0).cast("long").alias("in_truth"), F.col("n").alias("in_pred"), F.lit(0).cast("long").alias("hit")),
    )))
    by_class = sides.groupBy(*keys, "c").agg(F.sum("in_truth").alias("in_truth"), F.sum("in_pred").alias("in_pred"), F.sum("hit").alias("hit"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("in_truth") + F.col("in_pred")), F.lit(0.0))
    recall = F.try_divide("hit", "in_truth")
    return by_class.groupBy(*keys).agg(
        F.sum("in_truth").alias("n"),
        F.try_divide(F.sum("hit"), F.sum("in_truth")).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
        F.avg(recall).alias("balanced_accuracy"),
    )


def confusion(rows: DataFrame, labels: list, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """A dense grid of counts in the given label order."""
    grid = F.explode(F.array(*(F.lit(x) for x in labels)))
    base = rows.sparkSession.range(1).select(grid.alias("truth")).select("truth", grid.alias("pred"))
    counted = rows.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("c"))
    return base.join(counted, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("c", F.lit(0)).alias("n"))


def mean_std(rows: DataFrame, keys: list[str], *values: str, skip_nan: bool = False) -> DataFrame:
    """Mean and population standard deviation; NaN is left out on request."""
    v = lambda c: F.nanvl(F.col(c), F.lit(None)) if skip_nan else F.col(c)
    return rows.groupBy(*keys).agg(*(x for c in values for x in (F.avg(v(c)).alias(f"{c}_mean"), F.stddev_pop(v(c)).alias(f"{c}_std"))))


def two_level_mean(rows: DataFrame, inner: list[str], outer: list[str], value: str) -> DataFrame:
    """Mean over the outer keys of the means over the inner ones."""
    return rows.groupBy(*outer, *inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias(value))


def majority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value, the lowest of equals."""
    return rows.groupBy(*keys).agg(F.mode(value, True).alias(value))


def paired_wins(rows: DataFrame, pair: str, variant: str, baseline: str, value: str) -> DataFrame:
    """Per variant: pairs, wins (below the baseline), mean and population std of the difference."""
    base = rows.where(F.col(variant) == baseline).select(pair, F.col(value).alias("_base"))
    d = rows.where(F.col(variant) != baseline).join(base, pair).select(variant, (F.col(value) - F.col("_base")).alias("d"))
    return d.groupBy(variant).agg(F.count("*").alias("n"), F.count_if(F.col("d") < 0).alias("wins"), F.avg("d").alias("mean_delta"), F.stddev_pop("d").alias("std_delta"))


def paired_by(left: DataFrame, right: DataFrame, on: str, value: str, names: tuple[str, str] = ("soft", "hard")) -> DataFrame:
    """Values of both tables for the names that both have, and the first's reduction of the second in %."""
    a, b = (t.select(on, F.col(value).alias(n)) for t, n in zip((left, right), names, strict=True))
    return a.join(b, on).withColumn("reduction_pct", reduction_percent(F.col(names[1]), F.col(names[0])))


def by_seed(rows: DataFrame, keys: list[str], seed: str, value: str) -> DataFrame:
    """Per key: seeds, mean and population std over seeds, and the list of values in the seeds' order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(seed, value))), lambda s: s[value])  # one value for each seed
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), listed.alias("values"))


def spread(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Minimum, maximum, their difference, and the name with the maximum (first by name)."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(name).alias("b")))["b"]
    return rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("spread"), best.alias("best"))


def pivot_mean(rows: DataFrame, row: str, column: str, columns: list, value: str, order: list[str] = ()) -> DataFrame:
    """Means by row and column with the row's mean over columns, preferred rows first, the others after them by name."""
    wide = rows.groupBy(row).pivot(column, columns).agg(F.avg(value))
    cells = [F.col(f"`{c}`") for c in columns]
    there = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cells[1:]), F.when(cells[0].isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cells[1:]), F.coalesce(cells[0], F.lit(0.0)))
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(row)) if order else F.lit(0)
    return wide.withColumn("mean", F.try_divide(total, there)).orderBy(F.when(place == 0, 2**31 - 1).otherwise(place), row)


def reduction_percent(raw: Column, scaled: Column) -> Column:
    """100 (raw - scaled) / raw; 0 where raw is 0."""
    return F.coalesce(F.try_divide(100 * (raw - scaled), raw), F.lit(0.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): Wilson interval; (0, 1) for n = 0."""
    empty = n == 0
    n = F.nullif(n, F.lit(0))
    p, z2 = k / n, z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    n_ok = lambda x, otherwise: F.when(empty, otherwise).otherwise(x)
    return F.struct(n_ok(F.greatest(F.lit(0.0), centre - half), 0.0).alias("low"), n_ok(F.least(F.lit(1.0), centre + half), 1.0).alias("high"))


def against_constant(rows: DataFrame, keys: list[str], constant: int, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """``classification`` with the macro-F1 and balanced accuracy of a predictor that always says ``constant``, and the gains over it."""
    own = classification(rows, keys, truth, pred)
    base = classification(rows.withColumn(pred, F.lit(constant).cast(dict(rows.dtypes)[truth])), keys, truth, pred).select(*keys, F.col("macro_f1").alias("constant_f1"), F.col("balanced_accuracy").alias("constant_balanced"))
    both = own.join(base, keys) if keys else own.crossJoin(F.broadcast(base))  # one row each
    return both.withColumns({"f1_gain": F.col("macro_f1") - F.col("constant_f1"), "balanced_gain": F.col("balanced_accuracy") - F.col("constant_balanced")})


def experiment_table(folds: DataFrame, run: str, part: str, parts: list[str], values: list[str], digits: int = 3) -> DataFrame:
    """A row for each run: per value, the mean over folds for each part, and the mean and population std over the parts that have any.

    ``folds``: run, part, and a column for each value, a row for each fold.  Columns are
    ``<value>_<part>``, ``<value>_overall`` and ``<value>_std``.
    """
    means = folds.where(F.col(part).isin(parts)).groupBy(run, part).agg(*(F.avg(v).alias(v) for v in values))
    cells = [F.round(F.max(F.when(F.col(part) == p, F.col(v))), digits).alias(f"{v}_{p}") for v in values for p in parts]
    overall = [x for v in values for x in (F.round(F.avg(v), digits).alias(f"{v}_overall"), F.round(F.stddev_pop(v), digits).alias(f"{v}_std"))]
    return means.groupBy(run).agg(*cells, *overall)


def fold_table(rows: DataFrame, run: str, part: str, fold: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """A row for each run, part and fold: macro-F1, balanced accuracy and rows tested."""
    return classification(rows, [run, part, fold], truth, pred).select(run, part, fold, "macro_f1", "balanced_accuracy", F.col("n").alias("n_test"))
