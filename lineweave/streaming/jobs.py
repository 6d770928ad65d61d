"""Structured Streaming over events: sliding quotas, dedup, leases that expire, late partners, counters.

Each stream reads new files of a folder, runs what is available, writes Parquet with a checkpoint in
the shared work folder, and ends.  What a batch twin would say in SQL is beside each; rows that the
watermark hasn't passed yet stay in state and aren't in the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.sources.tables import micros, table, work_dir

HOUR = 3_600_000_000
#: How late an event may be, and how long a lease lasts after its last sign of life.
LATE, LEASE = "1 day", "3 days"
DAY = 24 * HOUR


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream, with ``at`` in place of ts: the same clock time, read as UTC."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("at", F.timestamp_micros(micros("ts"))).drop("ts")


def available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream has to say about what is there now.  In append mode rows go straight to a
    table; in complete mode each batch replaces the last one, so a batch that is run again does too."""
    spark = stream.sparkSession
    path = work_dir(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/rows")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/rows"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_quota(spark, d):
    """Actions of a user in each 24 hours, every 12 hours, once the window is final."""
    e = event_stream(spark, d).withWatermark("at", LATE)
    w = e.groupBy(F.window("at", "24 hours", "12 hours").alias("w"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return available(w.select(F.unix_micros("w.start").alias("opens"), "user_id", "event_type", "n"))


def stream_dedup(spark, d):
    """One request for each user, kind and day; repeats join the one under way."""
    e = event_stream(spark, d).withColumn("day", F.floor(F.unix_micros("at") / DAY)).withWatermark("at", LATE)
    return available(e.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day"))


def stream_lease_expiry(spark, d):
    """Leases that have run out: a user's events with less than LEASE between them, and their count."""
    e = event_stream(spark, d).withWatermark("at", LATE)
    s = e.groupBy(F.session_window("at", LEASE).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return available(s.select("user_id", F.unix_micros("w.start").alias("claimed"), F.unix_micros("w.end").alias("expired"), "n"))


def stream_late_merge(spark, d):
    """Purchases with the clicks of the same user up to six hours before them, whichever comes first."""
    e = event_stream(spark, d)
    c = e.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("click"), F.col("at").alias("c_at")).withWatermark("c_at", LATE)
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), "at").withWatermark("at", LATE)
    both = p.join(c, F.expr("user_id = u AND c_at <= at AND c_at >= at - INTERVAL 6 HOURS"))
    return available(both.select("user_id", "purchase", "click"))


def stream_view_counts(spark, d):
    """Counters that new events add to."""
    return available(event_stream(spark, d).where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("views")), "complete")


#: What the watermark has passed when a stream has seen all events; it counts in milliseconds.
FINAL = f"(SELECT max(epoch_us(ts)) // 1000 * 1000 - {DAY} FROM events)"
QUERIES = {
    "stream_quota": (stream_quota, f"SELECT opens, user_id, event_type, count(*) AS n FROM (SELECT user_id, event_type, epoch_us(ts) // {12 * HOUR} * {12 * HOUR} - k * {12 * HOUR} AS opens FROM events, range(2) r(k)) WHERE opens + {DAY} <= {FINAL} GROUP BY 1, 2, 3"),
    "stream_dedup": (stream_dedup, f"SELECT DISTINCT user_id, event_type, epoch_us(ts) // {DAY} AS day FROM events"),
    "stream_lease_expiry": (stream_lease_expiry, f"WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < {3 * DAY} THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(t) AS claimed, max(t) + {3 * DAY} AS expired, count(*) AS n FROM s GROUP BY user_id, k HAVING max(t) + {3 * DAY} <= {FINAL}"),
    "stream_late_merge": (stream_late_merge, f"SELECT p.user_id, p.event_id AS purchase, c.event_id AS click FROM events p JOIN events c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click' AND c.ts <= p.ts AND epoch_us(p.ts) - epoch_us(c.ts) <= {6 * HOUR}"),
    "stream_view_counts": (stream_view_counts, "SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1"),
}
