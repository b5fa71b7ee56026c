"""Scans of sensor logs, bulk scans and tables, and the sinks beside them."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions.classify_inputs import banner_of
from telemill.operators.classify import scan_filter, scan_type
from telemill.operators.ranges import running_sum


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Text lines with where they are from: file_path, file_id, line_number (from 1), value; blank lines are left out.

    file_id is a hash of the path and the file's first line, so a file that is rotated and made anew is another
    file. Bytes that are no UTF-8 become replacement characters. Lines are numbered within the block that a task reads,
    and a block begins after the lines of those before it, which a table with one row a block gives: a file of many
    blocks never comes together.
    """
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    raw = reader.text(path).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_modification_time").alias("collected_at"), F.monotonically_increasing_id().alias("seq"))
    each = raw.groupBy("file_path", "block").agg(F.count("*").alias("n"), F.min_by("value", "seq").alias("head"))
    order = Window.partitionBy("file_path").orderBy("block")
    start = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    file_id = F.sha2(F.concat_ws("\n", "file_path", F.first("head").over(order)).cast("binary"), 256)
    each = each.select("file_path", "block", start.alias("start"), file_id.alias("file_id"))
    inside = F.row_number().over(Window.partitionBy("file_path", "block").orderBy("seq"))
    lines = raw.withColumn("inside", inside).join(each, ["file_path", "block"]).withColumn("line_number", (F.col("start") + F.col("inside")).cast("int"))
    return lines.filter(F.trim("value") != "").select("file_path", "file_id", "line_number", F.make_valid_utf8("value").alias("value"), "collected_at")


def new_lines(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """Lines that the stored (file_id, line_number) do not have: those appended since the last run."""
    return lines.join(stored.select("file_id", "line_number"), ["file_id", "line_number"], "left_anti")


def parse_json_lines(lines: DataFrame, schema: T.StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows with a struct ``e``, rows that are no JSON objects)."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("e", F.from_json(value, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("e").isNull() | F.col("e._bad").isNotNull()
    return parsed.filter(~broken), parsed.filter(broken).drop("e")


def connections_since(connections: DataFrame, mark: int) -> tuple[DataFrame, DataFrame]:
    """(connections with an id above the mark, one row with the new mark)."""
    new = connections.filter(F.col("connection") > mark)
    return new, new.agg(F.coalesce(F.max("connection"), F.lit(mark)).alias("mark"))


def read_relational(spark: SparkSession, url: str, table: str, key: str, mark: int, rows_per_task: int = 1_000_000, **options: str) -> DataFrame:
    """Rows of a JDBC table whose key is above the mark, read by several tasks at once, each a range of keys above the mark.

    The predicate and the ranges run in the database, as does the search for the largest key. Ranges are of equal
    width, about ``rows_per_task`` keys each; a key beyond the largest one found belongs to the last.
    """
    source = dict(url=url, dbtable=table, **options)
    above = F.col(key) > mark
    last = spark.read.format("jdbc").options(**source).load().filter(above).agg(F.max(key)).first()[0]
    if last is not None and last > mark + 1:
        tasks = max(1, -(-(int(last) - mark) // rows_per_task))
        source |= dict(partitionColumn=key, lowerBound=str(mark + 1), upperBound=str(last), numPartitions=str(tasks))
    return spark.read.format("jdbc").options(**source).load().filter(above)


def read_bulk_scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Bulk scans of JSON lines or CSV with a header, gzip or not, a file or a folder with both; the first character of each file decides."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.substring(F.trim("value"), 1, 1).alias("head"))
    # a row a file
    kinds = raw.filter("head <> ''").groupBy("file").agg(F.min_by("head", F.struct("block", "seq")).alias("head")).collect()
    files = {json: [r["file"] for r in kinds if (r["head"] == "{") == json] for json in (True, False)}
    rows = []
    if files[True]:
        rows.append(spark.read.schema(schema).json(files[True]))
    if files[False]:
        rows.append(spark.read.schema(schema).option("header", True).csv(files[False]))
    return spark.createDataFrame([], schema) if not rows else reduce(DataFrame.unionByName, rows)


def filtered_scan(records: DataFrame) -> DataFrame:
    """Records of interest of a bulk scan, enriched: port, banner (512 characters), device_type, country, asn and the raw fields."""
    banner = banner_of("value", "data", "banner")
    rows = records.withColumn("_text", banner).filter(scan_filter(F.coalesce("_text", F.lit("")), F.col("port")))
    return rows.withColumn("device_type", scan_type(F.coalesce("_text", F.lit("")), F.col("port"))).withColumn("banner", F.substring("_text", 1, 512)).drop("_text")


def within_budget(records: DataFrame, max_bytes: int, port: str = "port", order: str = "ip", size: Column | None = None) -> DataFrame:
    """Records of each port up to a number of bytes (of their JSON, or by ``size``), in order: the rows before which less has been taken.

    A port may have any number of records: it spans as many ordered ranges as it needs, and ranges beyond the budget are left out whole.
    """
    size = F.octet_length(F.to_json(F.struct(*records.columns))) if size is None else size
    rows = records.withColumn("_size", size).withColumn("_tie", F.xxhash64(*records.columns))
    return running_sum(rows, [port], [order, "_tie"], F.col("_size"), "_before", max_bytes).drop("_size", "_tie", "_before")


def write_filtered(records: DataFrame, path: str) -> None:
    records.write.option("compression", "gzip").json(path)


def unprocessed(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Files (path) that the manifest does not list, or all with force."""
    return files if force else files.join(manifest.select("path"), "path", "left_anti")


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """Landed scan documents as VARIANT rows (doc), one for each line."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("doc")).filter("doc IS NOT NULL")


def read_feed(spark: SparkSession, path: str, envelope: str) -> DataFrame:
    """Records of landed feed documents as VARIANT rows (doc): the elements of the envelope's array."""
    docs = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("whole")).filter("whole IS NOT NULL")
    return docs.select(F.explode(F.try_variant_get("whole", f"$.{envelope}", "array<variant>")).alias("doc"))


def insert_new(target: DataFrame | None, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the batch to append: first of each key, and not in the target; rows with a null in the key all pass."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    fresh = batch.filter(whole).dropDuplicates(key)
    if target is not None:
        fresh = fresh.join(target.select(*key), key, "left_anti")
    return fresh.unionByName(batch.filter(~whole))


def write_days(activity: DataFrame, path: str) -> None:
    """Replace the partitions of the days that the rows have, and no others."""
    activity.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def run_record(spark: SparkSession, run_id: str, task: str, started, completed, status: str, n_in: int | None, n_out: int | None, files: list[str], error: str | None = None) -> DataFrame:
    """One row for the table of runs."""
    from telemill.schemas import RUN

    return spark.createDataFrame([(run_id, task, started, completed, status, n_in, n_out, files, None, error)], RUN)


def logged_run(log_path: str, run_id: str, task: str, rows: DataFrame, change: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], files: list[str] | None = None) -> None:
    """Write change(rows) by ``write`` and keep a log of it: a row when it starts, another when it ends, whatever comes of it.

    Rows in and out are counted by observations in the same pass as the write, so they cost no job. An error is logged with its first line and
    raised again.
    """
    spark, now = rows.sparkSession, lambda: datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    started, seen, made = now(), Observation(), Observation()

    def log(status: str, *counts: int | None, completed=None, error: str | None = None) -> None:
        run_record(spark, run_id, task, started, completed, status, *counts, files or [], error).write.mode("append").parquet(log_path)

    log("running", None, None)
    try:
        write(change(rows.observe(seen, F.count(F.lit(1)).alias("n"))).observe(made, F.count(F.lit(1)).alias("n")))
    except Exception as e:
        log("failed", None, None, completed=now(), error=str(e).splitlines()[0] if str(e) else type(e).__name__)
        raise
    log("success", seen.get["n"], made.get["n"], completed=now())


def run_log(spark: SparkSession, log_path: str) -> DataFrame:
    """One row a run: the row of its end, or that of its start while there is none."""
    from telemill.schemas import RUN

    rows = spark.read.schema(RUN).parquet(log_path)
    rest = [c for c in rows.columns if c != "run_id"]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.col("completed_at").isNotNull()).alias("x")).select("run_id", "x.*")


def export_text(df: DataFrame, path: str) -> None:
    """Tab-separated text, columns in their order, nulls as \\N."""
    df.write.option("sep", "\t").option("nullValue", "\\N").csv(path)


def import_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "\\N").csv(path)


def changed_since(df: DataFrame, column: str, since) -> DataFrame:
    return df.filter(F.col(column) > F.lit(since))


def freshness(events: DataFrame, now, stale_after_minutes: int = 60) -> DataFrame:
    """Last event, events within the window before ``now`` and a status for each sensor."""
    start = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(stale_after_minutes)} MINUTES")
    out = events.groupBy("honeypot").agg(F.max("event_time").alias("last_event"), F.count_if(F.col("event_time") > start).alias("recent_events"))
    return out.withColumn("status", F.when(F.col("recent_events") > 0, "fresh").otherwise("stale"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
