"""Queries for the admission filter and the trailing window."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainfold.plans.base import query
from grainfold.session import scratch_path
from grainfold.streaming import admission

HOUR = 3600


@query("stm_window_hits", """SELECT DISTINCT user_id, ts, count(*) OVER (PARTITION BY user_id, ts) AS events,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS hits FROM events""")
def _(t):
    return admission.window_hits(t.events, "user_id", "ts", 24 * HOUR)


DAY = 24 * HOUR * 1_000_000

ADMISSION_SQL = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, []::BIGINT[] AS held, NULL::BOOLEAN AS admitted, NULL::INTEGER AS remaining, NULL::INTEGER AS retry_after
          FROM (SELECT DISTINCT user_id FROM e)
          UNION ALL
          SELECT user_id, i, event_id, CASE WHEN len(h) < 3 THEN list_append(h, u) ELSE h END, len(h) < 3, greatest(0, 2 - len(h))::INTEGER,
                 CASE WHEN len(h) < 3 THEN 0 ELSE greatest(1, (h[1] + {DAY} - u) // 1000000 + 1) END::INTEGER
          FROM (SELECT e.user_id, e.i, e.event_id, e.u, list_filter(s.held, lambda x: x > e.u - {DAY}) AS h FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
    SELECT event_id, user_id, admitted, remaining, retry_after FROM s WHERE i > 0"""


@query("stm_admission", ADMISSION_SQL)
def _(t):
    return admission.admit(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 24 * HOUR).select(
        "event_id", "user_id", "admitted", "remaining", F.col("retry_after"))


@query("stm_admission_stream", ADMISSION_SQL)
def _(t):
    """The same verdicts from a stream over the table: events in the order of their files, then one far behind all that moves the watermark."""
    spark = t.spark
    events = t.events.select("event_id", "user_id", "ts")
    source, sink, notes = (scratch_path(spark, f"admission-{part}") for part in ("in", "out", "notes"))
    events.write.parquet(source)
    last = events.agg((F.max("ts") + F.expr("INTERVAL 3680 DAYS")).alias("ts"), F.max("event_id").alias("event_id"))
    last.select((F.col("event_id") + 1).alias("event_id"), F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), F.col("ts").cast(events.schema["ts"].dataType)).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    judged = admission.admit_stream(stream, "user_id", "ts", "event_id", 3, 24 * HOUR, late="3650 days")
    run = judged.writeStream.format("parquet").option("path", sink).option("checkpointLocation", notes).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(judged.schema).parquet(sink).select("event_id", "user_id", "admitted", "remaining", "retry_after")
