"""Raw survey documents to votes, dedup and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.functions.constants import AID_ALIASES, LABEL_TYPES, lookup
from kerbline.functions.text import first_number, first_text, last_segment, normalise_selection

VOTE_KEYS = ["pid", "aid", "image_id"]


def unwrap(value: Column, kind: str, path: str = "$") -> Column:
    """A typed JSON wrapper's value at ``path`` of a VARIANT: string, integer (written as a string), boolean, double; else null."""
    name = {"string": "stringValue", "bigint": "integerValue", "boolean": "booleanValue", "double": "doubleValue"}[kind]
    return F.try_variant_get(value, f"{path}.{name}", kind)


def survey_votes(docs: DataFrame, json_col: str = "doc", keep_log_types: list[str] | None = None) -> DataFrame:
    """Survey documents (VARIANT, with an ordinal) to votes.

    A group lists label ids on side A and side B: on both is Unsure, on A only
    Yes, on B only No.  Unknown aids and groups without any entry give no rows;
    unknown label types are "Unknown"; unknown groups are set -1.
    """
    d = F.col(json_col)
    text = lambda key: unwrap(d, "string", f"$.fields.{key}")
    head = docs.select(
        "ordinal",
        F.lower(F.coalesce(text("logType"), F.lit(""))).alias("log_type"),
        first_text(text("userId"), text("sessionId"), last_segment(F.try_variant_get(d, "$.name", "string"))).alias("pid"),
        lookup(AID_ALIASES)[F.lower(F.trim(F.coalesce(text("mobilityAid"), F.lit(""))))].alias("aid"),
        F.try_variant_get(d, "$.fields.imageSelections.mapValue.fields", "map<string,variant>").alias("groups"),
    ).where("aid is not null")
    if keep_log_types is not None:
        head = head.where(F.col("log_type").isin([x.lower() for x in keep_log_types]))
    groups = head.select("ordinal", "pid", "aid", F.explode("groups").alias("grp", "g"))
    body = groups.select("*", F.try_variant_get("g", "$.mapValue.fields", "map<string,variant>").alias("sides")).where("sides is not null")
    side = lambda s: F.try_variant_get(F.element_at("sides", F.concat("grp", F.lit(s))), "$.arrayValue.values", "array<variant>")
    tagged = lambda s: F.transform(F.coalesce(side(s), F.array().cast("array<variant>")), lambda e: F.struct(F.lit(s).alias("side"), e.alias("e")))
    entries = body.select("ordinal", "pid", "aid", "grp", F.explode(F.concat(tagged("A"), tagged("B"))).alias("x"))
    e = F.col("x.e")
    number = lambda key: unwrap(e, "bigint", f"$.mapValue.fields.{key}")
    listed = entries.select(
        "ordinal", "pid", "aid", "grp", F.col("x.side").alias("side"),
        first_number(number("LabelID"), number("labelId"), number("imageId")).alias("image_id"),
        first_number(number("LabelTypeID"), number("labelTypeId")).cast("int").alias("type_id"),
    ).where("image_id is not null")
    sided = listed.groupBy("ordinal", "pid", "aid", "grp", "image_id").agg(
        F.bool_or(F.col("side") == "A").alias("in_a"), F.bool_or(F.col("side") == "B").alias("in_b"), F.min_by("type_id", "side").alias("type_id")
    )
    digit = F.regexp_extract("grp", r"^group([0-8])$", 1)
    return sided.select(
        "ordinal", "pid", "aid",
        F.when(digit == "", -1).otherwise(F.try_to_number(digit, F.lit("9")).cast("int")).alias("image_set"),
        "image_id",
        F.coalesce(lookup(LABEL_TYPES)[F.col("type_id")], F.lit("Unknown")).alias("image_type"),
        classify_sides(F.col("in_a"), F.col("in_b")).alias("selection"),
    )


def classify_sides(in_a: Column, in_b: Column) -> Column:
    return F.when(in_a & in_b, "Unsure").when(in_a, "Yes").otherwise("No")


def keep_first(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_existing(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows, and new ones whose key is not there yet."""
    return existing.unionByName(new.join(existing.select(*keys).distinct(), keys, "left_anti"))


def clean_votes(raw: DataFrame, required: tuple[str, ...] = ("image_id", "aid")) -> DataFrame:
    """Normalised selections; rows without a required value go, and other columns too."""
    return raw.select(*required, normalise_selection(F.col("selection")).alias("selection")).dropna(subset=list(required))


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame itself, or an error that lists what it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
