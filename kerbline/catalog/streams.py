"""Streams over the events table, run until all available rows are read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kerbline.catalog.common import TALLY, VOTES, table, votes
from kerbline.plans.scratch import Scratch
from kerbline.streaming import study as ST2, votes as ST


def stream_of(spark, sf_dir):
    """Events as a stream of votes."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parquet*")
    pick = F.when(F.col("value") < 20.5, "no").when(F.col("value") < 55.1, "unsure").otherwise("yes")
    return e.select("event_id", F.col("user_id").alias("pid"), F.col("event_type").alias("aid"), (F.col("event_id") % 52).alias("image_id"), pick.alias("selection"), F.col("ts").cast("timestamp").alias("ts"), "value")


def replayed(spark, rows, time, files: int = 4, flush: str = "400 days"):
    """A table as a stream of several batches out of order, and then one row without values, later than all others, that moves the watermark past them."""
    folder = f"{Scratch(spark, 'replay').root}/files"
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(files)).cast("int")
    for k in range(files):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    rows.agg((F.max(time) + F.expr(f"INTERVAL {flush}")).alias(time)).select(*(F.col(c) if c == time else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def settled(stream, mode: str = "append", conf: dict | None = None):
    """The stream's rows once everything available is read, from a table in the shared folder."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    scratch = Scratch(spark, "stream")
    path = f"{scratch.root}/{uuid.uuid4().hex}"

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/{batch_id:06d}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
    return rows.withColumn("_batch", F.element_at(F.split("_metadata.file_path", "/"), -2).cast("int"))


def stream_tally(spark, sf_dir):
    """The last state of each cell."""
    rows = settled(ST.running_tally(stream_of(spark, sf_dir)), "update")
    return rows.groupBy("image_id", "aid").agg(*(F.max_by(c, "_batch").alias(c) for c in ("no", "unsure", "yes")))


def stream_windows(spark, sf_dir):
    rows = settled(ST.windowed_counts(stream_of(spark, sf_dir), ["aid"], "1 day", late="40 days"), "update")
    return rows.groupBy("start", "end", "aid").agg(F.max_by("n", "_batch").alias("n")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "aid", "n")


def stream_sliding(spark, sf_dir):
    rows = settled(ST.windowed_counts(stream_of(spark, sf_dir), [], "2 days", "1 day", late="40 days"), "update")
    return rows.groupBy("start", "end").agg(F.max_by("n", "_batch").alias("n")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


def stream_sessions(spark, sf_dir):
    """All sessions, those still open at the end too: each batch gives every session, and the last one counts."""
    rows = settled(ST.sessions(stream_of(spark, sf_dir), "pid", "6 hours", late="40 days"), "complete")
    last = rows.agg(F.max("_batch").alias("_last"))  # one row
    return rows.crossJoin(F.broadcast(last)).where("_batch = _last").select("pid", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


def stream_first_votes(spark, sf_dir):
    rows = settled(ST.first_votes(stream_of(spark, sf_dir), ["pid", "aid", "image_id"], late="60 days"))
    return rows.select("pid", "aid", "image_id")


PHASE = ["consent", "profile", "tutorial", "image", "route", "usability", "done"]


def stream_study(spark, sf_dir):
    """Events as phases of study sessions, replayed out of order: every session's furthest phase and its events out of order."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    phase = F.array(*(F.lit(p) for p in PHASE))[F.floor(F.sqrt(F.col("event_id") * 7919 % 49)).cast("int")]
    rows = e.select("event_id", F.col("user_id").alias("pid"), "ts", phase.alias("phase"))
    stream = replayed(spark, rows, "ts").withWatermark("ts", "60 days")
    done = settled(ST2.study_sessions(stream, "pid", "ts", "event_id", "phase", 6 * 3600 * 1000), conf=ST2.STATE_STORE)
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return done.where("pid is not null").select("pid", at("start"), at("end"), "reached", "out_of_order", "events", "ended")


def stream_upserts(spark, sf_dir):
    """The last event of each user, upserted batch by batch from events that arrive out of order."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("received_at"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    scratch = Scratch(spark, "upserts")
    stream = replayed(spark, rows, "ts").where("session_id is not null")
    sink = ST.upsert_latest(f"{scratch.root}/latest", compact_at=3)
    stream.writeStream.option("checkpointLocation", f"{scratch.root}/state").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    return ST.read_latest(spark, f"{scratch.root}/latest").select("session_id", "received_at", "event_type")


def stream_earliest_votes(spark, sf_dir):
    """The earliest vote of each user, aid and image, from events that arrive out of order."""
    rows = votes(spark, sf_dir).select("pid", "aid", "image_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "selection")
    done = settled(ST.earliest_votes(replayed(spark, rows, "ts").where("pid is not null"), ["pid", "aid", "image_id"], "ts", "event_id"), "update")
    return done.groupBy("pid", "aid", "image_id").agg(F.max_by(F.struct("event_id", "selection"), "_batch").alias("v")).select("pid", "aid", "image_id", "v.*")


QUERIES = {"stream_earliest_votes": stream_earliest_votes, "stream_study": stream_study, "stream_upserts": stream_upserts, "stream_tally": stream_tally, "stream_windows": stream_windows, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions, "stream_first_votes": stream_first_votes}
SQL = {
    "stream_earliest_votes": f"WITH {VOTES} SELECT pid, aid, image_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(selection, (ts, event_id)) AS selection FROM votes GROUP BY 1, 2, 3",
    "stream_study": """WITH p AS (SELECT user_id AS pid, ts, event_id, floor(sqrt(event_id * 7919 % 49))::INT AS place FROM events),
e AS (SELECT *, coalesce(epoch_ms(ts) > lag(epoch_ms(ts)) OVER w + 21600000 OR lag(place) OVER w = 6, true) AS fresh FROM p WINDOW w AS (PARTITION BY pid ORDER BY epoch_ms(ts), event_id)),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY pid ORDER BY epoch_ms(ts), event_id ROWS UNBOUNDED PRECEDING) AS i FROM e),
b AS (SELECT *, greatest(0, coalesce(max(place) OVER (PARTITION BY pid, i ORDER BY epoch_ms(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS seen FROM s)
SELECT pid, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", max(place)::INT AS reached, count(*) FILTER (place < seen OR place > seen + 1) AS out_of_order,
  count(*) AS events, CASE WHEN max(place) = 6 THEN 'done' ELSE 'idle' END AS ended FROM b GROUP BY pid, i""",
    "stream_upserts": "SELECT user_id::VARCHAR AS session_id, epoch_us(max(ts)) AS received_at, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "stream_tally": f'WITH {VOTES}, {TALLY} SELECT image_id, aid, "no", unsure, yes FROM tallies',
    "stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS aid, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding": "WITH d AS (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) SELECT strftime(s, '%Y-%m-%d') AS day, count(*) AS n FROM d GROUP BY 1",
    "stream_sessions": """WITH e AS (SELECT user_id AS pid, ts, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, true) AS fresh FROM events),
s AS (SELECT pid, ts, sum(fresh::INT) OVER (PARTITION BY pid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM e)
SELECT pid, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY pid, i""",
    "stream_first_votes": f"WITH {VOTES} SELECT DISTINCT pid, aid, image_id FROM votes",
}
