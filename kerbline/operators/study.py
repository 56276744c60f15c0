"""Study submissions: nested trials to rows, preferences, calibration and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.operators.metrics import wilson


def image_responses(submissions: DataFrame, trials: DataFrame, aid_names: Column | None = None) -> DataFrame:
    """One row per image trial that was not skipped, with the model's p_yes for the participant's aid, else overall.

    ``trials``: image_id, model_p_yes, given_class, per_aid_p_yes (map).
    """
    each = submissions.select("session_id", "aid", F.explode("image_trials").alias("t")).where(~F.coalesce("t.skipped", F.lit(False)))
    rows = each.select("session_id", "aid", "t.image_id", "t.response", F.col("t.response_time_ms").alias("response_ms"))
    joined = rows.join(trials, "image_id", "left")  # the study's fixed list of images
    return joined.select(
        "session_id", "aid", "image_id", "response", *((F.col("response") == r).cast("int").alias(r) for r in ("yes", "no", "unsure")),
        F.coalesce(F.element_at("per_aid_p_yes", F.col("aid")), "model_p_yes").alias("model_p_yes"), "given_class", "response_ms",
    )


def preferred_accessible(selected: Column, a_type: Column, b_type: Column) -> Column:
    """True, False, or null when no route was selected."""
    a, b = (selected == "route_a"), (selected == "route_b")
    return (
        F.when(a & (a_type == "accessible"), True).when(b & (b_type == "accessible"), True).when(selected.isin("route_a", "route_b"), False)
    )


def route_preferences(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: decided trials, how many preferred the accessible route, the share and its Wilson interval."""
    got = routes.where(F.col("preferred_accessible").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("preferred_accessible").alias("k"))
    return got.withColumn("share", F.try_divide("k", "n")).withColumn("ci", wilson(F.col("k"), F.col("n"))).select(*keys, "n", "k", "share", F.col("ci.low").alias("low"), F.col("ci.high").alias("high"))


def yes_rates(images: DataFrame) -> DataFrame:
    """Per image and aid: trials, share of yes, model p_yes; rows without an aid are left out."""
    return images.where("aid is not null").groupBy("image_id", "aid").agg(F.count("*").alias("n"), F.avg("yes").alias("yes_rate"), F.min("model_p_yes").alias("model_p_yes"))


def participants(submissions: DataFrame) -> DataFrame:
    """Per session: answered and skipped image and route trials."""
    done = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast(dict(submissions.dtypes)[c])), lambda t: ~F.coalesce(t["skipped"], F.lit(False)))).alias(f"n_{c}")
    gone = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast(dict(submissions.dtypes)[c])), lambda t: F.coalesce(t["skipped"], F.lit(False)))).alias(f"skipped_{c}")
    return submissions.select("session_id", done("image_trials"), gone("image_trials"), done("route_trials"), gone("route_trials"))


def usability(submissions: DataFrame, *questions: str) -> DataFrame:
    """Per question: answers and their mean, unanswered left out."""
    each = submissions.select(F.explode(F.map_filter("usability", lambda _, v: v.isNotNull())).alias("question", "score"))
    rows = each.where(F.col("question").isin(*questions)) if questions else each
    return rows.groupBy("question").agg(F.count("score").alias("n"), F.avg("score").alias("mean"))


def trials_for_aid(trials: DataFrame, aid: str) -> DataFrame:
    """Trials for an aid; all of them when it has none."""
    own = trials.where(F.col("aid") == aid)
    any_own = own.agg((F.count("*") > 0).alias("_any"))
    return trials.join(F.broadcast(any_own), how="cross").where((F.col("aid") == aid) | ~F.col("_any")).drop("_any")  # one row


def with_rewritten_paths(trials: DataFrame, column: str = "images") -> DataFrame:
    """Image paths of a nested array as paths inside the static bundle."""
    from kerbline.functions.text import asset_path

    return trials.withColumn(column, F.transform(column, asset_path))
