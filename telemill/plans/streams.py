"""Queries of streams with state: sessions, bursts, arrivals, days by sessions and late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators import activity
from telemill.plans.adapters import ATTACKS, Tables
from telemill.plans.registry import query
from telemill.plans.storage import scratch_path
from telemill.sources import logs
from telemill.streaming import jobs


def attack_stream(t: Tables) -> DataFrame:
    """attacks as a stream over the events table; the pattern lets a single file be a source."""
    raw = jobs.read_table_stream(t.spark, f"{t.sf_dir}/events.parque[t]", t.table("events").schema)
    return t.spark.sql(ATTACKS, events=raw)


def _run(t: Tables, change: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """All rows that change(attacks as a stream) gives: one run over the events, and one when a heartbeat 60 days after the last of them has arrived."""
    path = scratch_path(t.spark, tag)
    beat = t.attacks.agg((F.max("event_time") + F.expr("INTERVAL 60 DAYS")).alias("event_time")).withColumn("source_ip", F.lit(jobs.HEARTBEAT))
    beat.limit(0).write.parquet(f"{path}-beats")
    stream = change(jobs.with_heartbeats(attack_stream(t), jobs.read_table_stream(t.spark, f"{path}-beats", beat.schema)))
    jobs.to_batches(stream, path, f"{path}-state").awaitTermination()
    beat.write.mode("append").parquet(f"{path}-beats")
    jobs.to_batches(stream, path, f"{path}-state").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path).drop("batch")


@query("st6_closed_sessions", """
WITH e AS (SELECT *, event_type = 'session.file_download' AND record_id % 3 = 0 AS closes FROM attacks),
p AS (SELECT *, lag(event_time) OVER w AS before, lag(closes) OVER w AS closed FROM e WINDOW w AS (PARTITION BY source_ip ORDER BY event_time, record_id)),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR closed OR event_time - before >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY source_ip ORDER BY event_time, record_id) AS s FROM p)
SELECT source_ip, min(event_time) AS start, max(event_time) AS "end", count(*) AS events, CASE WHEN bool_or(closes) THEN 'closed' ELSE 'timeout' END AS ending FROM s GROUP BY source_ip, s""")
def st6_closed(t: Tables) -> DataFrame:
    closes = (F.col("event_type") == "session.file_download") & (F.col("record_id") % 3 == 0)
    return _run(t, lambda df: jobs.closed_sessions(df, ["source_ip"], closes, "6 hours", "1 hour"), "sessions")


_BURSTS = """
WITH RECURSIVE kept AS (
    SELECT source_ip, dest_port, min(event_time) AS event_time FROM attacks GROUP BY ALL
    UNION ALL
    SELECT k.source_ip, k.dest_port, min(a.event_time) FROM kept k JOIN attacks a ON a.source_ip = k.source_ip AND a.dest_port = k.dest_port AND a.event_time >= k.event_time + INTERVAL {length} GROUP BY k.source_ip, k.dest_port
) SELECT source_ip, dest_port, event_time FROM kept"""


@query("st2_burst_stream", _BURSTS.format(length="60 SECONDS"))
def st2_minute(t: Tables) -> DataFrame:
    return _run(t, lambda df: jobs.first_of_bursts(df, ["source_ip", "dest_port"], "60 seconds"), "bursts").select("source_ip", "dest_port", "event_time")


@query("st2_long_bursts", _BURSTS.format(length="6 HOURS"))
def st2_hours(t: Tables) -> DataFrame:
    return _run(t, lambda df: jobs.first_of_bursts(df, ["source_ip", "dest_port"], "6 hours"), "bursts").select("source_ip", "dest_port", "event_time")


@query("st5_arrival_stream", "WITH d AS (SELECT DISTINCT source_ip, day FROM attacks) SELECT source_ip, day FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.source_ip = a.source_ip AND b.day < a.day AND b.day >= a.day - 7)")
def st5(t: Tables) -> DataFrame:
    return _run(t, jobs.arrivals_stream, "arrivals")


@query("st3_daily_stream", "SELECT day, source_ip, honeypot, count(*) AS event_count, count(*) FILTER (event_type LIKE 'login%') AS login_attempts, count(DISTINCT session_id) AS unique_sessions, min(event_time) AS first_event, max(event_time) AS last_event FROM attacks GROUP BY ALL")
def st3(t: Tables) -> DataFrame:
    return _run(t, jobs.daily_activity_by_sessions, "daily")


@query("st4_late_rows", "SELECT day, source_ip, honeypot, count(*) AS event_count, count(DISTINCT session_id) AS unique_sessions, max(event_time) AS last_event, bool_or(record_id % 10 = 7 AND day < DATE '2024-01-20') AS rewritten FROM attacks GROUP BY ALL")
def st4(t: Tables) -> DataFrame:
    """A tenth of the rows come after all others, most of them late; ``rewritten`` says whether the group has such rows."""
    path, target = scratch_path(t.spark, "arriving"), scratch_path(t.spark, "activity")
    rows = t.attacks.withColumn("part", F.when((F.col("record_id") % 10 == 7) & (F.col("day") < F.lit("2024-01-20").cast("date")), 1).otherwise(0))
    for part in (0, 1):
        rows.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{path}/in")
        stream = jobs.read_table_stream(t.spark, f"{path}/in", t.attacks.schema)
        jobs.late_rows_aside(stream, f"{path}/out", f"{path}/state").awaitTermination()
    daily = lambda df: activity.daily_activity(df)
    logs.write_days(daily(t.spark.read.parquet(f"{path}/out/timely")), target)
    jobs.backfill_late_days(t.spark, f"{path}/out", target, daily)
    late = t.spark.read.parquet(f"{path}/out/late").select("source_ip", "honeypot", F.to_date("event_time").alias("day")).distinct().withColumn("rewritten", F.lit(True))
    found = t.spark.read.parquet(target).withColumn("day", F.col("day").cast("date")).join(late, ["source_ip", "honeypot", "day"], "left")
    return found.select("day", "source_ip", "honeypot", "event_count", "unique_sessions", "last_event", F.coalesce("rewritten", F.lit(False)).alias("rewritten"))
