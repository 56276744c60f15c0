"""Vote and response streams: tallies, dedup, latest submission, windows, sessions, trial sequence.

Event time must be a timestamp: NTZ columns are cast first.  State is bounded by
watermarks where an operator keeps any.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbline.functions.constants import CLASSES
from kerbline.sources.writers import complete_folders


def with_event_time(stream: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def running_tally(votes: DataFrame) -> DataFrame:
    """Class counts per image and aid; for update or complete mode."""
    return votes.groupBy("image_id", "aid").agg(*(F.count_if(F.col("selection") == c).alias(c) for c in CLASSES))


def first_votes(votes: DataFrame, keys: list[str], column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Votes without later repeats of their key inside the watermark."""
    return with_event_time(votes, column, late).dropDuplicatesWithinWatermark(keys)


def earliest_votes(votes: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Per key the first vote in the given order, of what has arrived; for update or complete mode.  However votes arrive, the same one counts in the end."""
    rest = [c for c in votes.columns if c not in (*keys, *order)]
    return votes.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("v")).select(*keys, "v.*")


def windowed_counts(stream: DataFrame, keys: list[str], size: str, slide: str | None = None, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows."""
    w = F.window(column, size, slide) if slide else F.window(column, size)
    counted = with_event_time(stream, column, late).groupBy(w, *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Bursts of activity of each key, parted by ``gap``."""
    grouped = with_event_time(stream, column, late).groupBy(F.session_window(column, gap), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_latest(path: str, key: str = "session_id", received: str = "received_at", compact_at: int = 50):
    """A ``foreachBatch`` function: the stored rows keep the last received row of each key.

    A batch writes its own rows only, to a folder named by query and batch, so a
    repeated batch writes the same folder again and a query with a new checkpoint
    adds to what is there.  ``read_latest`` picks the last row of each key.  At
    ``compact_at`` folders they are merged into one; until the merged ones are
    deleted, rows stand twice, which does no harm.
    """
    from kerbline.sources.writers import latest_by_session

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        latest_by_session(batch, key, received).write.mode("overwrite").parquet(f"{path}/b-{query}-{batch_id}")
        old = complete_folders(spark, path)
        if len(old) >= compact_at:
            read_latest(spark, path, key, received).write.parquet(f"{path}/c-{uuid.uuid4().hex}")
            for name in old:
                target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    return write


def read_latest(spark, path: str, key: str = "session_id", received: str = "received_at") -> DataFrame:
    """The last received row of each key that ``upsert_latest`` stored."""
    from kerbline.sources.writers import latest_by_session

    return latest_by_session(spark.read.parquet(*(f"{path}/{n}" for n in complete_folders(spark, path))), key, received)


# The phases of a study session, in order.
PHASES = ["consent", "profile", "tutorial", "image", "route", "usability", "done"]


def trial_sequence(stream: DataFrame, key: str = "session_id", event: str = "phase") -> DataFrame:
    """Per key and batch: the furthest phase reached and how many events came out of order."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, odd = state.get if state.exists else (0, 0)
        for batch in batches:
            for phase in batch.sort_values("seq")[event]:
                place = PHASES.index(phase) if phase in PHASES else -1
                if place < at or place > at + 1:
                    odd += 1
                at = max(at, place)
        state.update((at, odd))
        yield pd.DataFrame({key: [k[0]], "phase": [PHASES[at]], "out_of_order": [odd]})

    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} string, phase string, out_of_order long", "reached int, odd long", "update", GroupStateTimeout.NoTimeout
    )
