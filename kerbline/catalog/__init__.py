"""Named queries over the test tables, each with the SQL it must equal where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kerbline.catalog import collected, geo, measures, models, routes, streams, surveys, texts

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (surveys, measures, geo, routes, models, texts, streams, collected)


def queries() -> dict[str, Query]:
    return {name: query for part in PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
