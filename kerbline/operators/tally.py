"""Votes to per-image class distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.functions import distributions as D
from kerbline.functions.constants import CLASSES


def tally(
    votes: DataFrame, target: str = "hard_relabel", weight: str = "inv_entropy", max_entropy: float = 1.0, min_margin: float = 0.1, min_votes: int = 3,
    aids: list[str] | None = None, compat: bool = False,
) -> DataFrame:
    """One row per image and aid: counts, shares, entropy, margin, uncertainty, label and weight.  One shuffle, combined first.

    Selections outside the three classes count nowhere; with no vote left the
    shares are null.  ``target``: hard_relabel labels uncertain rows unsure,
    hard_drop leaves them out, soft sets no label.  ``compat`` leaves certain
    rows' labels null, as published results have them.
    """
    rows = votes if aids is None else votes.where(F.col("aid").isin(aids))
    counted = rows.groupBy("image_id", "aid").agg(*(F.count_if(F.col("selection") == c).alias(c) for c in CLASSES))
    total = counted.withColumn("total_votes", sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0])))
    shared = total.select("*", *(F.try_divide(c, "total_votes").alias(f"p_{c}") for c in CLASSES))
    p = F.array(*(f"p_{c}" for c in CLASSES))
    there = F.col("total_votes") > 0
    scored = shared.select("*", F.when(there, D.entropy(p)).alias("entropy"), F.when(there, D.margin(p)).alias("margin"), F.when(there, D.argmax(p)).alias("_best"))
    flagged = scored.withColumn(
        "is_uncertain", F.coalesce(D.is_uncertain(F.col("entropy"), F.col("margin"), F.col("total_votes"), max_entropy, min_margin, min_votes), F.lit(True))
    ).withColumn("argmax_label", F.concat(F.lit("p_"), F.get(F.array(*(F.lit(c) for c in CLASSES)), F.col("_best"))))
    if target == "hard_drop":
        flagged = flagged.where("not is_uncertain")
    best = F.substring("argmax_label", 3, 10)
    name = {"hard_relabel": F.when(F.col("is_uncertain"), "unsure").otherwise(best), "hard_drop": best}.get(target, F.lit(None).cast("string"))
    number = F.array_position(F.array(*(F.lit(c) for c in CLASSES)), F.col("label_name")) - 1
    if compat:
        number = F.when(F.col("is_uncertain"), number)
    return (
        flagged.withColumn("label_name", name)
        .withColumn("label", number.cast("int"))
        .withColumn("sample_weight", D.sample_weight(F.col("entropy"), weight))
        .drop("_best")
    )


def class_distribution(tallies: DataFrame) -> DataFrame:
    """Per aid, how many images have each class as their argmax."""
    return tallies.groupBy("aid").agg(*(F.count_if(F.col("argmax_label") == f"p_{c}").alias(f"n_{c}") for c in CLASSES), F.count("*").alias("n"))


def entropy_histogram(tallies: DataFrame, bins: int = 12) -> DataFrame:
    """Counts by aid and bin of the renormalised entropy on [0, 1]; the last bin is closed."""
    h = D.renormalised_entropy(F.array("p_no", "p_unsure", "p_yes"))
    bin_ = F.least(F.greatest(F.floor(h * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return tallies.where("total_votes > 0").groupBy("aid", bin_.alias("bin")).agg(F.count("*").alias("n"))
