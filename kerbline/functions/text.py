"""Answers, names and labels in text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kerbline.functions.constants import SELECTION_ALIASES, lookup


def normalise_selection(x: Column, aliases: dict[str, str] = SELECTION_ALIASES) -> Column:
    """Trimmed, lower case, aliases replaced; a missing value becomes the string "nan" and counts in no class."""
    t = F.lower(F.trim(F.coalesce(x, F.lit("nan"))))
    return F.coalesce(lookup(aliases)[t], t) if aliases else t


def parse_answer(x: Column, last_line: bool = False) -> Column:
    """0 no, 1 unsure, 2 yes: the first whole word among them, else substring yes, else substring no, else unsure."""
    t = F.lower(F.coalesce(x, F.lit("")))
    if last_line:
        t = F.element_at(F.split(F.rtrim(t), "\n"), -1)
    word = F.regexp_extract(t, r"(?U)(?:^|\W)(yes|no|unsure)(?=\W|$)", 1)
    return (
        F.when(word == "no", 0).when(word == "unsure", 1).when(word == "yes", 2)
        .when(F.contains(t, F.lit("yes")), 2).when(F.contains(t, F.lit("no")), 0).otherwise(1)
    )


def parse_response(x: Column) -> Column:
    """0 no, 1 unsure, 2 yes: by prefix, then by words of doubt, then by any keyword; yes if nothing is said."""
    t = F.trim(F.lower(F.coalesce(x, F.lit(""))))
    has = lambda w: F.contains(t, F.lit(w))
    return (
        F.when(F.startswith(t, F.lit("yes")), 2).when(F.startswith(t, F.lit("no")), 0)
        .when(has("unsure") | has("uncertain") | has("unclear"), 1)
        .when(has("yes"), 2).when(has("no"), 0).otherwise(2)
    )


def unparsed(x: Column) -> Column:
    """No keyword anywhere."""
    return ~F.lower(F.coalesce(x, F.lit(""))).rlike("yes|no|unsure")


def after_reasoning(x: Column, mark: str = "</think>") -> Column:
    """What follows the last reasoning mark, trimmed."""
    return F.trim(F.element_at(F.split(x, mark), -1))


def fill_prompt(template: Column | str, phrase: Column) -> Column:
    t = F.lit(template) if isinstance(template, str) else template
    return F.replace(t, F.lit("{aid}"), phrase)


def city_of(path: Column) -> Column:
    """City in a file name like gsv-some_city-12.png, underscores left out; unknown if there is none."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    city = F.replace(F.regexp_extract(name, r"^gsv-([a-z_]+)-\d", 1), F.lit("_"), F.lit(""))
    return F.when(city == "", "unknown").otherwise(city)


def title_city(x: Column) -> Column:
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def last_segment(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


def aid_key(x: Column) -> Column:
    return F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit("_"))


def safe_id(x: Column) -> Column:
    """Only letters, digits, - and _ stay."""
    return F.regexp_replace(x, "[^A-Za-z0-9_-]", "")


def asset_path(x: Column) -> Column:
    return F.concat(F.lit("assets/images/"), last_segment(x))


def first_text(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def first_number(*columns: Column) -> Column:
    """The first value that is neither null nor zero."""
    return F.coalesce(*(F.nullif(c, F.lit(0).cast("long")) for c in columns))
