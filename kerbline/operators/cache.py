"""A persistent cache of fetched items, with hits, known misses and expiry.

Entries are Parquet rows (key, payload, fetched_at) in a folder for each batch.
A null payload is an entry too: the item is known to be gone, and is not
asked for again while the entry lasts.  A batch stores only keys that the other batches
don't hold, and writes its own folder, so a repeated batch changes nothing and a
batch that broke off leaves nothing that is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbline.sources.writers import complete_folders

ENTRY = "key string, payload binary, fetched_at long"


class FetchCache:
    """The cache below ``path``; an entry holds for ``ttl`` (in the unit of ``fetched_at``) after it was fetched, or for good."""

    def __init__(self, spark: SparkSession, path: str, ttl: int | None = None):
        self.spark, self.path, self.ttl = spark, path.rstrip("/"), ttl

    def _holds(self, now: int | Column) -> Column:
        return F.lit(True) if self.ttl is None else F.col("fetched_at") + self.ttl > now

    def entries(self, but: str | None = None) -> DataFrame:
        """The latest entry of each key, of all batches or all ``but`` one."""
        folders = [f"{self.path}/{n}" for n in complete_folders(self.spark, self.path) if n != but]
        if not folders:
            return self.spark.createDataFrame([], ENTRY)
        every = self.spark.read.schema(ENTRY).parquet(*folders)
        return every.groupBy("key").agg(F.max(F.struct("fetched_at", "payload")).alias("e")).select("key", "e.payload", "e.fetched_at")

    def lookup(self, wanted: DataFrame, now: int, but: str | None = None) -> DataFrame:
        """The rows of ``wanted`` (with ``key``) and their status: hit, expired (known to be gone) or miss, payload and fetched_at."""
        held = self.entries(but).where(self._holds(now))
        status = F.when(F.col("fetched_at").isNull(), "miss").when(F.col("payload").isNull(), "expired").otherwise("hit")
        return wanted.join(held, "key", "left").withColumn("status", status)

    def misses(self, wanted: DataFrame, now: int, but: str | None = None) -> DataFrame:
        """The keys that have to be fetched, each once."""
        held = self.entries(but).where(self._holds(now)).select("key")
        return wanted.select("key").where("key is not null").distinct().join(held, "key", "left_anti")

    def store(self, fetched: DataFrame, batch: str, now: int) -> None:
        """Keep what a batch fetched (key, payload or null) for keys that were missing; of a key's rows the first payload in order."""
        new = fetched.join(self.misses(fetched, now, f"batch={batch}"), "key", "left_semi")
        one = new.groupBy("key").agg(F.min(F.col("payload").cast("binary")).alias("payload"), F.lit(now).cast("long").alias("fetched_at"))
        one.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
