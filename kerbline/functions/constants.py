"""Fixed values that results must share with published ones, and their lookup DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Mobility aids, their keys and the spellings accepted in raw data.
AIDS = ["Walking cane", "Walker", "Mobility scooter", "Manual wheelchair", "Motorized wheelchair"]
AID_KEYS = ["walking_cane", "walker", "mobility_scooter", "manual_wheelchair", "motorized_wheelchair"]
AID_ALIASES = {
    "manual wheelchair": "Manual wheelchair",
    "manual_wheelchair": "Manual wheelchair",
    "motorized wheelchair": "Motorized wheelchair",
    "motorized_wheelchair": "Motorized wheelchair",
    "mobility scooter": "Mobility scooter",
    "mobility_scooter": "Mobility scooter",
    "walker": "Walker",
    "walking cane": "Walking cane",
    "walking_cane": "Walking cane",
    "cane": "Walking cane",
}
# Classes in their order (no = 0, unsure = 1, yes = 2).
CLASSES = ["no", "unsure", "yes"]
# Label type ids.
LABEL_TYPES = {1: "CurbRamp", 2: "NoCurbRamp", 3: "Obstacle", 4: "SurfaceProblem", 5: "NoSidewalk", 6: "Crosswalk", 7: "Signal"}
# Spellings of selections.
SELECTION_ALIASES = {"maybe": "unsure", "cannot": "no", "cannot_go": "no", "n": "no", "y": "yes"}
# Passability by label type, in the order of AID_KEYS.
PASSABILITY = {
    "CurbRamp": (0.92, 0.88, 0.85, 0.82, 0.84),
    "NoCurbRamp": (0.72, 0.45, 0.15, 0.05, 0.07),
    "Obstacle": (0.60, 0.45, 0.35, 0.25, 0.28),
    "SurfaceProblem": (0.65, 0.50, 0.40, 0.30, 0.38),
    "NoSidewalk": (0.50, 0.35, 0.20, 0.12, 0.15),
    "Crosswalk": (0.82, 0.78, 0.75, 0.72, 0.74),
    "Signal": (0.88, 0.85, 0.83, 0.80, 0.82),
    "Occlusion": (0.65, 0.65, 0.65, 0.65, 0.65),
    "Other": (0.65, 0.65, 0.65, 0.65, 0.65),
}
# Prior probability of "yes", in the order of AID_KEYS.
PRIORS = dict(zip(AID_KEYS, (0.75, 0.68, 0.60, 0.50, 0.55), strict=True))
EARTH_RADIUS_M = 6_371_000.0


def lookup(values: dict) -> Column:
    """A literal map column, for dictionaries of fixed size."""
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def passability_table(spark: SparkSession) -> DataFrame:
    """(label_type, aid, p_yes): 45 rows."""
    rows = [(kind, aid, p) for kind, ps in PASSABILITY.items() for aid, p in zip(AID_KEYS, ps, strict=True)]
    return spark.createDataFrame(rows, "label_type string, aid string, p_yes double")


def prior_table(spark: SparkSession) -> DataFrame:
    """(aid, prior): 5 rows."""
    return spark.createDataFrame(list(PRIORS.items()), "aid string, prior double")
