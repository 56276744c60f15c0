"""Writers: CSV, JSON, JSON with statistics, label lines, upserts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.functions.text import safe_id


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = False) -> bool:
    """Write the given columns (others are ignored); an empty frame writes nothing.  True if written."""
    out = df.select(*columns) if columns else df
    if out.isEmpty():
        return False
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True, escape='"')
    return True


def union_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns."""
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_with_meta(df: DataFrame, meta: DataFrame, path: str) -> None:
    """Data and its one-row statistics side by side, as Parquet and JSON."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    meta.write.mode("overwrite").json(f"{path}/meta")


def append_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append rows whose key is not stored yet; returns those."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key]).join(spark.read.parquet(path).select(key), key, "left_anti").select(*df.columns)
    fresh.write.mode("append").parquet(path)
    return fresh


def latest_by_session(rows: DataFrame, key: str = "session_id", received: str = "received_at") -> DataFrame:
    """One row per cleaned session id: the last received."""
    named = rows.withColumn(key, safe_id(F.col(key))).where(F.col(key) != "")
    rest = [c for c in named.columns if c not in (key, received)]
    return named.groupBy(key).agg(F.max(F.struct(received, *rest)).alias("r")).select(key, f"r.{received}", *(f"r.{c}" for c in rest)).select(*rows.columns)


def write_yolo(rows: DataFrame, path: str, width: int, height: int) -> None:
    """Lines of class and polygon, coordinates over the picture's size with six digits, a folder per file."""
    coords = F.transform("polygon", lambda x, i: F.format_string("%.6f", x / F.when(i % 2 == 0, width).otherwise(height)))
    line = F.concat_ws(" ", F.col("class").cast("string"), F.array_join(coords, " "))
    rows.select("file", line.alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def table_lines(df: DataFrame, *columns: str, sep: str = " & ", end: str = r" \\") -> DataFrame:
    """Rows as lines of a typeset table, numbers with four digits."""
    cell = lambda c: F.format_string("%.4f", c) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).cast("string")
    return df.select(F.concat(F.concat_ws(sep, *(F.coalesce(cell(c), F.lit("--")) for c in columns)), F.lit(end)).alias("line"))


def complete_folders(spark, path: str) -> list[str]:
    """Names of the folders below ``path`` whose write ended, in order."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(n for n in names if fs.exists(fs_path(f"{path}/{n}/_SUCCESS")))


def append_batch(rows: DataFrame, path: str, key: str, batch: str) -> DataFrame:
    """Append the rows whose key no other batch below ``path`` holds, as the folder of ``batch``; the table as it is then.

    A batch writes its own folder whole, so a retry after a broken or a finished
    write gives the same table.
    """
    spark = rows.sparkSession
    others = [f"{path}/{n}" for n in complete_folders(spark, path) if n != f"batch={batch}"]
    new = rows.dropDuplicates([key])
    if others:
        new = new.join(spark.read.schema(rows.schema).parquet(*others).select(key), key, "left_anti").select(*rows.columns)
    new.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return spark.read.schema(rows.schema).parquet(*others, f"{path}/batch={batch}")
