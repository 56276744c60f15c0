"""Small helpers for Arrow-batched functions over a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of one Arrow batch: some MB of usual texts, and bounded for long ones.
BATCH_ROWS = 2000


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough that a Python worker holds a few MB of text at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def texts(column: pa.Array) -> list[str]:
    """The column's strings, null as empty."""
    return [t or "" for t in column.to_pylist()]


def text_struct(schema: str, rows_of: Callable[[], Callable[[str], tuple]]) -> Callable[[Column], Column]:
    """A column function: text -> struct<schema>.

    ``rows_of()`` is called once in each task and returns the function applied
    to each text; its tuple has the struct's fields in order.
    """
    fields = T._parse_datatype_string(schema).fields

    @F.arrow_udf(schema)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = rows_of()
        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            rows = [one(t) for t in texts(batch)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
            yield pa.StructArray.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[f.name for f in fields]
            )

    return apply
