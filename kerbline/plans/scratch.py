"""Intermediate tables in the folder that the cluster shares.

Iterative operators cut their lineage by writing a Parquet table below
``spark.checkpoint.dir`` and reading it again.  A written table survives the
loss of any executor, is columnar, and is computed once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one in the warehouse where it is unset; executors share both."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


class Scratch:
    """Tables of one run of one operator, each below its own folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._written = 0
        self._paths: list[str] = []

    def write(self, df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return it as a scan of what was written."""
        self._written += 1
        path = f"{self.root}/{self._written:03d}-{label}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self._paths.append(path)
        return out

    def write_observed(self, df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
        """``write``, and in the same job the number of rows as ``rows`` and the given aggregates."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), label)
        return out, seen.get

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables of this run that no later plan reads; what is not one of them is passed over."""
        self._delete([p for p in self._paths if p in {getattr(df, "scratch_path", None) for df in tables}])

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables of this run but these, which hold what the operator returns."""
        self._delete([p for p in self._paths if p not in {getattr(df, "scratch_path", None) for df in tables}])

    def _delete(self, paths: list[str]) -> None:
        for path in paths:
            self._paths.remove(path)
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
