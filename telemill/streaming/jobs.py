"""Structured Streaming forms of ingest, deduplication, daily activity, sessions and indicator extraction.

Sinks are folders of Parquet with a batch number, written by foreachBatch: a batch that is run again replaces its own
folder, so every job can stop at any time and go on. Reading takes the last version of each key or merges all batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from telemill.operators.iocs import extract_iocs, merged_iocs
from telemill.operators.merge import merge_as_aggregate, merge_rules
from telemill.plans.storage import store
from telemill.sources.logs import insert_new, write_days
from telemill.streaming.ordered import CLOSED, Rule, burst_rule, in_order, session_rule


def read_text_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Lines of new files of a folder: (value, file_path)."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path).select("value", F.col("_metadata.file_path").alias("file_path"))


def read_table_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def to_batches(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "append") -> StreamingQuery:
    """Write each micro-batch, changed by a function, to ``path/batch=N``; process what there is and stop."""

    def write(df: DataFrame, number: int) -> None:
        change(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def ingest(events: DataFrame, path: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Append events that the target does not have, each key once; a batch that is run again gives the same rows."""

    def write(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        try:
            old = spark.read.parquet(path).filter(F.col("batch") != number)
        except Exception as e:  # the first batch has no target yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = None
        insert_new(old, df, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def deduplicated(events: DataFrame, delay: str = "60 seconds") -> DataFrame:
    """First event of each (source_ip, dest_port) within the delay; late events are dropped by the watermark."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["source_ip", "dest_port"])


def daily_activity_stream(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """daily_activity() by tumbling windows of a day, for output mode update or append."""
    day = F.window("event_time", "1 day")
    rows = events.filter("source_ip IS NOT NULL").withWatermark("event_time", delay).groupBy(day.alias("w"), "source_ip", "honeypot").agg(
        F.count("*").alias("event_count"), F.count_if(F.col("event_type").startswith("login")).alias("login_attempts"), F.size(F.collect_set("session_id")).cast("long").alias("unique_sessions"),
        F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"),
    )
    return rows.withColumn("day", F.to_date("w.start")).drop("w")


def daily_activity_by_sessions(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """daily_activity() as two aggregates in a row, for output mode append: a day comes out once, when the watermark is past it.

    The first has a row of state for each day, address, sensor and session, the second one for each day, address and
    sensor: no set of sessions is in any state.
    """
    keys = ["source_ip", "honeypot"]
    each = events.filter("source_ip IS NOT NULL").withWatermark("event_time", delay).groupBy(F.window("event_time", "1 day").alias("w"), *keys, "session_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type").startswith("login")).alias("logins"), F.min("event_time").alias("first"), F.max("event_time").alias("last"),
    )
    rows = each.groupBy(F.window(F.window_time("w"), "1 day").alias("w"), *keys).agg(
        F.sum("n").alias("event_count"), F.sum("logins").alias("login_attempts"), F.count("session_id").alias("unique_sessions"), F.min("first").alias("first_event"), F.max("last").alias("last_event"),
    )
    return rows.withColumn("day", F.to_date("w.start")).drop("w")


def with_heartbeats(events: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """events and rows that only carry event_time: they move the watermark on while sensors are quiet, so what is due comes out.

    Their source_ip is HEARTBEAT, the other columns are null; being ahead of all events they come out of no operator themselves.
    """
    return events.unionByName(heartbeats, allowMissingColumns=True)


HEARTBEAT = "heartbeat"


def arrivals_stream(events: DataFrame, quiet_days: int = 7, delay: str = "1 day") -> DataFrame:
    """arrivals(): (source_ip, day) without activity in the ``quiet_days`` days before, by an outer join of the stream with itself.

    Days of an address are made distinct within a watermark that must be a day at least, and meet those before them within an interval, so both sides
    forget what is older. A day comes out when the watermark is past all that could still precede it.
    """
    days = events.withWatermark("event_time", delay).withColumn("day", F.to_date("event_time")).dropDuplicatesWithinWatermark(["source_ip", "day"]).select("event_time", "source_ip", "day")
    before = days.select(F.col("event_time").alias("before_time"), F.col("source_ip").alias("before_ip"), F.col("day").alias("before_day"))
    span = f"INTERVAL {quiet_days + 1} DAYS"
    near = F.expr(f"source_ip = before_ip AND before_time >= event_time - {span} AND before_time < event_time + INTERVAL 1 DAY AND before_day < day AND before_day >= date_sub(day, {quiet_days})")
    return days.join(before, near, "left_outer").filter("before_ip IS NULL").select("source_ip", "day")


def late_rows_aside(events: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Split each micro-batch by the largest event_time of those before it: rows more than the delay behind it go to ``path/late``, others to ``path/timely``.

    ``path/marks`` keeps that time for each batch, so a batch that is run again splits in the same way.
    """

    def write(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        marks = spark.read.schema("event_time timestamp, batch int").parquet(f"{path}/marks").filter(F.col("batch") < number) if number else spark.createDataFrame([], "event_time timestamp")
        mark = marks.agg(F.max("event_time")).first()[0]
        late = F.lit(False) if mark is None else F.coalesce(F.col("event_time") < F.lit(mark) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        df.persist()
        try:
            df.filter(~late).write.mode("overwrite").parquet(f"{path}/timely/batch={number}")
            df.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            df.agg(F.max("event_time").alias("event_time")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        finally:
            df.unpersist()

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def backfill_late_days(spark: SparkSession, path: str, target: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Write change(events) of the days that late rows belong to over those days' partitions of ``target``; returns the days.

    Only those days of the timely rows are read for it.
    """
    late, timely = spark.read.parquet(f"{path}/late"), spark.read.parquet(f"{path}/timely")
    days = store(late.select(F.to_date("event_time").alias("day")).distinct(), "days")
    every = timely.unionByName(late).withColumn("_day", F.to_date("event_time"))
    again = every.join(F.broadcast(days.withColumnRenamed("day", "_day")), "_day", "left_semi").drop("_day", "batch")  # a row a day
    write_days(change(again), target)
    return days


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Rows of the last batch that has each key, from a folder that an update-mode job wrote."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return best.select(*keys, "x.*")


def recent_activity(events: DataFrame, width: str = "60 minutes", slide: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events of each sensor in sliding windows."""
    rows = events.withWatermark("event_time", delay).groupBy(F.window("event_time", width, slide).alias("w"), "honeypot").agg(F.count("*").alias("events"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "honeypot", "events")


def closed_sessions(events: DataFrame, keys: list[str], closes: Column, idle: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a stream by ``keys``: start, end, events and ending, ``closed`` by an event for which ``closes`` holds or ``timeout`` after a time without events.

    Events of one time are ordered by record_id. A session comes out when the watermark is past its end; see ordered.in_order.
    """
    rows = events.withColumn("_closes", F.coalesce(closes, F.lit(False)).cast("long"))
    found = in_order(rows, keys, ["record_id", "_closes"], _closing_last(idle), ["_start", "_end", "events", "_ending"], delay)
    ending = F.when(F.col("_ending") == CLOSED, "closed").otherwise("timeout")
    return found.select(*keys, F.timestamp_micros("_start").alias("start"), F.timestamp_micros("_end").alias("end"), "events", ending.alias("ending"))


def _closing_last(idle: str) -> Rule:
    own = session_rule(_micros(idle))
    return own._replace(event=lambda kept, e: own.event(kept, [e[0], e[2]]))


def first_of_bursts(events: DataFrame, keys: list[str], length: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """(keys, event_time, record_id) of events that come ``length`` or more after the last one that was kept, in order of time.

    An event that is dropped does not make a burst longer, unlike by a rule that compares each event with the one before
    it, by which a steady stream is one burst. dropDuplicatesWithinWatermark (see deduplicated) is cheaper, but what it keeps depends on how
    events are dealt to micro-batches.
    """
    found = in_order(events, keys, ["record_id"], burst_rule(_micros(length)), ["_time", "record_id"], delay)
    return found.select(*keys, F.timestamp_micros("_time").alias("event_time"), "record_id")


def _micros(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * 1_000_000 * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def sessions(events: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of an address that end after a gap: start, end and events."""
    rows = events.withWatermark("event_time", delay).groupBy(F.session_window("event_time", gap).alias("w"), "source_ip").agg(F.count("*").alias("events"))
    return rows.select("source_ip", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def ioc_batches(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Indicators of each micro-batch, merged within it."""
    return to_batches(events, path, checkpoint, lambda df: merged_iocs(extract_iocs(df)))


def merged_ioc_batches(spark: SparkSession, path: str) -> DataFrame:
    """The indicator table over all batches."""
    return merge_as_aggregate(spark.read.parquet(path).drop("batch"), **merge_rules("iocs"))
