"""Streams equal batches and can be run again."""

import datetime

import pytest
from pyspark.sql import functions as F

from telemill.operators.activity import daily_activity
from telemill.streaming import jobs

SCHEMA = "event_id long, event_time timestamp, source_ip string, dest_port int, honeypot string, event_type string, session_id string"


def events(spark, n=60):
    start = datetime.datetime(2026, 4, 20)
    return spark.createDataFrame([(k, start + datetime.timedelta(hours=k), f"203.0.113.{k % 5}", 22, "ab"[k % 2], "login.failed", f"s{k % 7}") for k in range(n)], SCHEMA)


def stream(spark, path):
    from pyspark.sql.types import _parse_datatype_string

    return jobs.read_table_stream(spark, path, _parse_datatype_string(SCHEMA), 1)


def test_daily_activity(spark, tmp_path):
    df = events(spark)
    for k in range(3):
        df.filter(f"event_id DIV 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    jobs.to_batches(jobs.daily_activity_stream(stream(spark, str(tmp_path / "in")), "30 days"), str(tmp_path / "out"), str(tmp_path / "state"), mode="update").awaitTermination()
    got = jobs.latest(spark, str(tmp_path / "out"), ["day", "source_ip", "honeypot"])
    assert sorted(map(str, got.select(*daily_activity(df).columns).collect())) == sorted(map(str, daily_activity(df).collect()))


def test_ingest_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (events(spark, 20), events(spark, 30)):  # the second holds the first again
        part.coalesce(1).write.mode("append").parquet(src)
        jobs.ingest(stream(spark, src), out, str(tmp_path / "state"), ["event_id"]).awaitTermination()
    assert spark.read.parquet(out).count() == 30
    jobs.ingest(stream(spark, src), out, str(tmp_path / "state2"), ["event_id"]).awaitTermination()  # all over again
    assert spark.read.parquet(out).select("event_id").distinct().count() == 30


def test_ingest_goes_on_after_a_failed_batch(spark, tmp_path, monkeypatch):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (events(spark, 20), events(spark, 30), events(spark, 40)):
        part.coalesce(1).write.mode("append").parquet(src)
    calls, insert = [], jobs.insert_new

    def once(*a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return insert(*a)

    monkeypatch.setattr(jobs, "insert_new", once)
    with pytest.raises(Exception, match="lost"):
        jobs.ingest(stream(spark, src), out, state, ["event_id"]).awaitTermination()
    assert 20 <= spark.read.parquet(out).count() < 40
    jobs.ingest(stream(spark, src), out, state, ["event_id"]).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == got.select("event_id").distinct().count() == 40 and len(calls) == 4


def test_dedup_within_delay(spark, tmp_path):
    start = datetime.datetime(2026, 4, 20)
    rows = [(k, start + datetime.timedelta(seconds=s), "203.0.113.1", 22, "a", "x", "s") for k, s in enumerate((0, 10, 300, 310, 600, 610))]
    for r in rows:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = jobs.deduplicated(stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = {r.event_id for r in spark.table("kept").collect()}
    assert kept & {0, 1} and kept & {4, 5} and len(kept) < 6  # state expires between batches


ORDERED = "record_id long, event_time timestamp, source_ip string, dest_port int, honeypot string, event_type string, session_id string"


def arriving(spark, path, rows, parts):
    """A folder whose files arrive one after another: rows (seconds, ip, type), those of parts[k] in file k."""
    start = datetime.datetime(2026, 4, 20)
    made = [(k, start + datetime.timedelta(seconds=s), ip, 22, "a", kind, f"s{k % 3}") for k, (s, ip, kind) in enumerate(rows)]
    for part in parts:
        spark.createDataFrame([made[k] for k in part], ORDERED).coalesce(1).write.mode("append").parquet(f"{path}/in")
    from pyspark.sql.types import _parse_datatype_string

    beat = spark.createDataFrame([(start + datetime.timedelta(days=400), jobs.HEARTBEAT)], "event_time timestamp, source_ip string")
    beat.limit(0).write.parquet(f"{path}/beats")
    return made, lambda beats=True: _stream_of(spark, path, _parse_datatype_string(ORDERED), beat.schema if beats else None)


def _stream_of(spark, path, schema, beats):
    rows = jobs.read_table_stream(spark, f"{path}/in", schema, 1)
    return rows if beats is None else jobs.with_heartbeats(rows, jobs.read_table_stream(spark, f"{path}/beats", beats))


def result(spark, stream, path):
    """All rows of a stream: one run over the events, and one when a heartbeat long after them has arrived."""
    jobs.to_batches(stream, f"{path}/out", f"{path}/state").awaitTermination()
    beat = spark.createDataFrame([(datetime.datetime(2027, 6, 1), jobs.HEARTBEAT)], "event_time timestamp, source_ip string")
    beat.write.mode("append").parquet(f"{path}/beats")
    jobs.to_batches(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").drop("batch").collect()


ROWS = [(0, "x", "login"), (40, "x", "login"), (50, "x", "session.closed"), (55, "x", "login"), (500, "x", "login"), (20, "y", "login"), (119, "y", "login"), (120, "y", "session.closed"), (121, "y", "session.closed"), (3000, "y", "login")]


@pytest.mark.parametrize("parts", [[range(10)], [[1, 0, 3], [2, 5, 4, 6], [8, 7], [9]]])
def test_sessions_end_by_close_or_timeout(spark, tmp_path, parts):
    made, stream = arriving(spark, str(tmp_path), ROWS, parts)
    closed = jobs.closed_sessions(stream(), ["source_ip"], F.col("event_type") == "session.closed", "100 seconds", "10 minutes")
    start = datetime.datetime(2026, 4, 20)
    at = lambda t: int((t - start).total_seconds())
    got = sorted((r.source_ip, at(r.start), at(r.end), r.events, r.ending) for r in result(spark, closed, str(tmp_path)))
    assert got == [("x", 0, 50, 3, "closed"), ("x", 55, 55, 1, "timeout"), ("x", 500, 500, 1, "timeout"), ("y", 20, 120, 3, "closed"), ("y", 121, 121, 1, "closed"), ("y", 3000, 3000, 1, "timeout")]


def test_open_sessions_wait_in_the_state(spark, tmp_path):
    _, stream = arriving(spark, str(tmp_path), ROWS[:5], [range(5)])
    closed = jobs.closed_sessions(stream(beats=False), ["source_ip"], F.col("event_type") == "session.closed", "100 seconds", "1 minute")
    got = [(r.events, r.ending) for r in result(spark, closed, str(tmp_path))]
    assert sorted(got) == [(1, "timeout"), (3, "closed")]  # the watermark, at 440, is past the second session's end and before the last event


@pytest.mark.parametrize("parts", [[range(8)], [[3, 0], [1, 2], [5, 4], [7, 6]]])
def test_bursts_by_the_last_kept_event(spark, tmp_path, parts):
    rows = [(s, "x", "login") for s in (0, 40, 60, 100, 119, 120, 500, 559)]
    made, stream = arriving(spark, str(tmp_path), rows, parts)
    got = result(spark, jobs.first_of_bursts(stream(), ["source_ip", "dest_port"], "60 seconds", "20 minutes"), str(tmp_path))
    assert sorted(r.record_id for r in got) == [0, 2, 5, 6]  # each event compared with the one before it would keep 0 and 6


@pytest.mark.parametrize("parts", [[range(7)], [[0], [1, 2], [3], [4, 5, 6]]])
def test_arrivals_by_a_join_of_the_stream_with_itself(spark, tmp_path, parts):
    day = 86400
    rows = [(d * day + s, ip, "login") for d, s, ip in ((0, 80000, "x"), (1, 10, "x"), (1, 20, "x"), (3, 0, "y"), (9, 86399, "x"), (10, 0, "y"), (17, 1, "x"))]
    made, stream = arriving(spark, str(tmp_path), rows, parts)
    got = sorted((r.source_ip, r.day.day - 20) for r in result(spark, jobs.arrivals_stream(stream()), str(tmp_path)) if r.day.month == 4)
    assert got == [("x", 0), ("x", 9), ("y", 3)]  # y is back after seven days, x on day 17 after eight (in May: day 7)
    from telemill.operators.activity import arrivals

    batch = spark.createDataFrame(made, ORDERED)
    assert sorted(map(tuple, arrivals(batch).collect())) == sorted((r.source_ip, r.day) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_days_by_sessions_equal_the_batch(spark, tmp_path):
    df = events(spark)
    for k in range(3):
        df.filter(f"event_id DIV 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    beat = spark.createDataFrame([], "event_time timestamp, source_ip string")
    beat.write.parquet(str(tmp_path / "beats"))
    rows = jobs.with_heartbeats(stream(spark, str(tmp_path / "in")), jobs.read_table_stream(spark, str(tmp_path / "beats"), beat.schema))
    got = result(spark, jobs.daily_activity_by_sessions(rows, "30 days").select(*daily_activity(df).columns), str(tmp_path))
    assert sorted(map(str, got)) == sorted(map(str, daily_activity(df).collect()))


def test_late_rows_go_aside_and_days_are_rewritten(spark, tmp_path):
    from telemill.sources.logs import write_days

    path, target = str(tmp_path), str(tmp_path / "activity")
    df = events(spark)  # 60 hours
    for part in ("event_id >= 30 AND event_id % 7 > 0", "event_id < 30 OR event_id % 7 = 0"):
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{path}/in")
        jobs.late_rows_aside(stream(spark, f"{path}/in"), f"{path}/out", f"{path}/state", "1 day").awaitTermination()
    late = {r.event_id for r in spark.read.parquet(f"{path}/out/late").collect()}
    assert late == {k for k in range(60) if (k < 30 or k % 7 == 0) and k < 59 - 24}
    write_days(daily_activity(spark.read.parquet(f"{path}/out/timely")), target)
    days = jobs.backfill_late_days(spark, f"{path}/out", target, daily_activity)
    assert days.count() == 2
    got = spark.read.parquet(target).withColumn("day", F.col("day").cast("date")).select(*daily_activity(df).columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, daily_activity(df).collect()))
    jobs.backfill_late_days(spark, f"{path}/out", target, daily_activity)  # again: the same
    assert spark.read.parquet(target).count() == len(got)


@pytest.mark.parametrize("buckets", [1, 3, 1024])
def test_keys_share_calls_and_states(spark, tmp_path, buckets):
    from telemill.streaming.ordered import burst_rule, in_order

    start = datetime.datetime(2026, 4, 20)
    rows = [(k, start + datetime.timedelta(seconds=70 * (k // 200) + k % 2), [None, 'a"b', "", "é"][k % 4], [None, 2**60 + 1, -1][k % 3], [0.1, None][k // 4 % 2]) for k in range(600)]
    schema = "record_id long, event_time timestamp, ip string, port long, x double"
    for part in (rows[1::2], rows[::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    beat = spark.createDataFrame([(start + datetime.timedelta(days=400),)], "event_time timestamp")
    beat.limit(0).write.parquet(str(tmp_path / "beats"))
    from pyspark.sql.types import _parse_datatype_string

    events = jobs.with_heartbeats(jobs.read_table_stream(spark, str(tmp_path / "in"), _parse_datatype_string(schema), 1), jobs.read_table_stream(spark, str(tmp_path / "beats"), beat.schema))
    found = in_order(events, ["ip", "port", "x"], ["record_id"], burst_rule(60_000_000), ["_time", "record_id"], "1 hour", buckets)
    assert found.schema["port"].dataType.simpleString() == "bigint" and found.schema["x"].dataType.simpleString() == "double"
    query = jobs.to_batches(found, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= min(buckets, 24)  # before: a row and a call for each of 24 keys
    got = result(spark, found, str(tmp_path))
    first = {}
    for r in rows:
        at = (*r[2:], r[0] // 200)
        first[at] = min(first.get(at, (r[1], r[0])), (r[1], r[0]))
    assert sorted((str(k[:3]), k[3], n) for k, (_, n) in first.items()) == sorted((str((r.ip, r.port, r.x)), r.record_id // 200, r.record_id) for r in got)
