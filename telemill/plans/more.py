"""Queries for merges of the remaining tables, campaign statistics, lifetimes and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.exprs import has_value, service_label, stable_id
from telemill.operators import activity, graph, linkage
from telemill.operators.classify import scan_type
from telemill.operators.iocs import credential_rows, extract_iocs, merged_iocs
from telemill.operators.merge import merge_as_aggregate, merge_rules
from telemill.operators.reporting import counted, top_per_group
from telemill.plans.adapters import Tables
from telemill.plans.analyses import _MEMBERS, _WEIGHED, _members
from telemill.plans.registry import query
from telemill.plans.reports import _IOCS
from telemill.plans.storage import scratch_path
from telemill.sources import logs


@query("m2_credential_merge", "SELECT username, password, min(event_time) AS first_seen, max(event_time) AS last_seen, count(*) AS attempt_count, count(*) FILTER (event_type = 'login.success') AS success_count FROM attacks WHERE event_type LIKE 'login.%' AND (username <> '' OR password <> '') GROUP BY ALL")
def m2(t: Tables) -> DataFrame:
    success = F.when(F.col("event_type") == "login.success", 1).otherwise(0).cast("long")
    rows = credential_rows(t.attacks).select("username", "password", F.col("event_time").alias("first_seen"), F.col("event_time").alias("last_seen"), F.lit(1).cast("long").alias("attempt_count"), success.alias("success_count"), "day")
    old = merge_as_aggregate(rows.filter("day < DATE '2024-01-10'"), **merge_rules("credentials"))
    return merge_as_aggregate(rows.filter("day >= DATE '2024-01-10'").drop("day"), **merge_rules("credentials"), old=old)


@query("m5_node_merge", "SELECT source_ip AS node_value, arg_min(honeypot, record_id) AS node_type, min(event_time) AS first_seen, max(event_time) AS last_seen, arg_max(hassh, record_id) FILTER (hassh IS NOT NULL) AS cluster_id FROM attacks GROUP BY source_ip")
def m5(t: Tables) -> DataFrame:
    rows = t.attacks.select(F.col("source_ip").alias("node_value"), F.col("honeypot").alias("node_type"), F.col("event_time").alias("first_seen"), F.col("event_time").alias("last_seen"), F.col("hassh").alias("cluster_id"), "record_id")
    return merge_as_aggregate(rows, **merge_rules("nodes", ["node_type", "first_seen", "last_seen", "cluster_id"]), seq="record_id")


@query("m6_edge_merge", "SELECT source_ip AS source_node_id, dest_port AS target_node_id, protocol AS edge_type, arg_max(record_id, record_id)::DOUBLE AS weight, arg_max(event_time, record_id) AS last_seen FROM attacks GROUP BY ALL")
def m6(t: Tables) -> DataFrame:
    rows = t.attacks.select(F.col("source_ip").alias("source_node_id"), F.col("dest_port").alias("target_node_id"), F.col("protocol").alias("edge_type"), F.col("record_id").cast("double").alias("weight"), F.col("event_time").alias("last_seen"), "record_id")
    return merge_as_aggregate(rows, **merge_rules("edges", ["weight", "last_seen"]), seq="record_id")


@query("m7_campaign_merge", "SELECT hassh AS cluster_id, arg_min(honeypot, record_id) AS name, max(event_time) AS last_seen, arg_min(protocol, record_id) AS primary_protocol, arg_max(record_id, record_id) AS event_count FROM attacks WHERE hassh IS NOT NULL GROUP BY hassh")
def m7(t: Tables) -> DataFrame:
    rows = t.attacks.filter("hassh IS NOT NULL").select(F.col("hassh").alias("cluster_id"), F.col("honeypot").alias("name"), F.col("event_time").alias("last_seen"), F.col("protocol").alias("primary_protocol"), F.col("record_id").alias("event_count"), "record_id")
    return merge_as_aggregate(rows, **merge_rules("campaigns", ["name", "last_seen", "primary_protocol", "event_count"]), seq="record_id")


@query("m8_query_run_audit", "SELECT source, snapshot_week, query_category AS query_id, arg_max(port, seq) AS results_total, max(snapshot_date) AS executed_at FROM devices GROUP BY ALL")
def m8(t: Tables) -> DataFrame:
    rows = t.devices.select("source", "snapshot_week", F.col("query_category").alias("query_id"), F.col("port").alias("results_total"), F.col("snapshot_date").alias("executed_at"), "seq")
    return merge_as_aggregate(rows, **merge_rules("query_runs", ["results_total", "executed_at"]), seq="seq")


@query("g1_signals", "SELECT DISTINCT source_ip, download_url, file_hash, hassh FROM attacks WHERE coalesce(download_url, file_hash, hassh) IS NOT NULL")
def g1(t: Tables) -> DataFrame:
    return graph.event_signals(t.attacks)


@query("g4_same_campaign_edges", _WEIGHED + "SELECT DISTINCT a.source_ip AS src, b.source_ip AS dst, 'same_campaign' AS edge_type, 1.0::DOUBLE AS weight FROM weighed a JOIN weighed b ON a.username = b.username AND a.password = b.password AND a.source_ip <> b.source_ip WHERE a.ips <= 100 UNION ALL SELECT source_ip, concat_ws(':', 'cred', username, password), 'uses_credential', 1.0::DOUBLE FROM weighed WHERE ips > 100")
def g4(t: Tables) -> DataFrame:
    return graph.graph_edges(t.attacks, hubs=False, most=100).filter("edge_type IN ('same_campaign', 'uses_credential')")


@query("x12_stable_ids", "SELECT username, password, substring(sha256(string_agg(source_ip, ',' ORDER BY source_ip)), 1, 16) AS stable_id FROM (SELECT *, row_number() OVER (PARTITION BY username, password ORDER BY source_ip) AS rn FROM (SELECT DISTINCT username, password, source_ip FROM attacks WHERE username <> '' AND password <> '')) WHERE rn <= 20 GROUP BY ALL")
def x12(t: Tables) -> DataFrame:
    """An id of the first 20 addresses of each credential, sorted and joined: for short lists; graph.campaigns has ids of sets of any size."""
    used = t.attacks.filter(has_value("username") & has_value("password")).select("username", "password", "source_ip").distinct()
    place = F.row_number().over(Window.partitionBy("username", "password").orderBy("source_ip"))
    first = used.withColumn("place", place).filter("place <= 20").groupBy("username", "password").agg(F.array_sort(F.collect_list("source_ip")).alias("ips"))
    return first.select("username", "password", stable_id(F.col("ips")).alias("stable_id"))


@query("g6_indicator_nodes", _IOCS + "SELECT node_type, count(*) AS n FROM (SELECT DISTINCT source_ip AS v, 'ip' AS node_type FROM attacks WHERE username <> '' AND password <> '' UNION SELECT concat_ws(':', 'cred', username, password), 'credential' FROM attacks WHERE username <> '' AND password <> '' UNION SELECT ioc_value, ioc_type FROM merged WHERE ioc_type IN ('ip', 'domain')) GROUP BY node_type")
def g6(t: Tables) -> DataFrame:
    edges = linkage.credential_hubs(t.attacks).select("src", "dst", F.lit("uses_credential").alias("edge_type"))
    extra = merged_iocs(extract_iocs(t.attacks)).filter(F.col("ioc_type").isin("ip", "domain")).select(F.col("ioc_value").alias("node_value"), F.col("ioc_type").alias("node_type"))
    return counted(graph.graph_nodes(edges, extra), "node_type")


@query("g11_campaign_lifetimes", _MEMBERS.rstrip(", ") + " SELECT date_diff('day', min(day), max(day)) AS lifetime_days, count(DISTINCT source_ip) AS source_ip_count, count(*) AS event_count FROM e GROUP BY cluster")
def g11(t: Tables) -> DataFrame:
    c = graph.campaigns(_members(t), t.attacks)
    return c.select(F.datediff("last_seen", "first_seen").cast("long").alias("lifetime_days"), "source_ip_count", "event_count")


@query("g12_stability", "WITH a AS (SELECT DISTINCT source_ip AS node, hassh AS c FROM attacks WHERE hassh IS NOT NULL AND day < DATE '2024-01-02'), b AS (SELECT DISTINCT source_ip AS node, hassh AS c FROM attacks WHERE hassh IS NOT NULL AND day >= DATE '2024-01-29') SELECT a.c AS old, b.c AS new, count(*) / ((SELECT count(*) FROM a x WHERE x.c = a.c) + (SELECT count(*) FROM b x WHERE x.c = b.c) - count(*))::DOUBLE AS jaccard FROM a JOIN b ON a.node = b.node GROUP BY a.c, b.c")
def g12(t: Tables) -> DataFrame:
    rows = t.attacks.filter("hassh IS NOT NULL").select(F.col("source_ip").alias("node"), F.col("hassh").alias("cluster"), "day").distinct()
    of = lambda c: rows.filter(c).select("node", "cluster").distinct()
    return graph.stability(of("day < DATE '2024-01-02'"), of("day >= DATE '2024-01-29'"))


@query("g15_dangling_edges", "SELECT count(*) AS n FROM (SELECT DISTINCT source_ip, download_url FROM attacks WHERE download_url IS NOT NULL AND source_ip NOT IN (SELECT ip FROM feeds WHERE ip IS NOT NULL))")
def g15(t: Tables) -> DataFrame:
    edges = t.attacks.filter("download_url IS NOT NULL").select(F.col("source_ip").alias("src"), F.col("download_url").alias("dst")).distinct()
    nodes = t.feeds.filter("ip IS NOT NULL").select(F.col("ip").alias("node_value")).unionByName(edges.select(F.col("dst").alias("node_value"))).distinct()
    return graph.dangling(edges, nodes).agg(F.count("*").alias("n"))


@query("g12_label_propagation")
def g12b(t: Tables) -> DataFrame:
    return graph.label_propagation(graph.graph_edges(t.attacks)).groupBy("label").agg(F.count("*").alias("nodes"))


@query("l7_lifetime_histogram", "SELECT CAST(least(floor(lifetime_days / 1.0) + 1, 31) AS BIGINT) AS bin, count(*) AS ips FROM (SELECT source_ip, date_diff('day', min(day), max(day)) AS lifetime_days FROM attacks GROUP BY 1) WHERE lifetime_days >= 2 GROUP BY 1")
def l7(t: Tables) -> DataFrame:
    rows = activity.lifetimes(t.attacks).filter("lifetime_days >= 2")
    return rows.groupBy(F.width_bucket("lifetime_days", F.lit(0.0), F.lit(30.0), F.lit(30)).alias("bin")).agg(F.count("*").alias("ips"))


@query("a5_top_credentials", _MEMBERS + "c AS (SELECT cluster, concat_ws(':', username, password) AS cred, count(*) AS n FROM e WHERE username <> '' AND password <> '' GROUP BY 1, 2) SELECT cluster, cred, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, cred) AS rank FROM c) WHERE rank <= 3")
def a5(t: Tables) -> DataFrame:
    e = t.attacks.filter(has_value("username") & has_value("password")).join(_members(t), "source_ip")
    return top_per_group(counted(e.withColumn("cred", F.concat_ws(":", "username", "password")), "cluster", "cred"), ["cluster"], "n", ["cred"], 3)


@query("x4_scan_types", "SELECT port, CASE WHEN regexp_matches(b, 'busybox') THEN 'iot_embedded' WHEN regexp_matches(b, 'socks5') THEN 'proxy' WHEN regexp_matches(b, 'rtsp') THEN 'camera' WHEN port IN (1080, 3128, 8888) THEN 'proxy' WHEN port = 554 THEN 'camera' WHEN port IN (7547, 2323) THEN 'router' WHEN port = 1883 THEN 'iot_mqtt' ELSE 'unknown' END AS kind, count(*) AS n FROM (SELECT *, lower(coalesce(raw_banner, '')) AS b FROM devices) GROUP BY 1, 2")
def x4(t: Tables) -> DataFrame:
    return counted(t.devices.withColumn("kind", scan_type(F.lower(F.coalesce("raw_banner", F.lit(""))), F.col("port"))), "port", "kind")


@query("x22_service_labels", "SELECT CASE WHEN port IN (1080, 3128, 8080, 8888) THEN 'proxy' ELSE 'other' END AS service, count(*) AS n FROM devices GROUP BY 1")
def x22(t: Tables) -> DataFrame:
    return counted(t.devices.withColumn("service", service_label("port")), "service")


@query("s18_daily_partitions", "SELECT day, source_ip, honeypot, count(*) AS event_count FROM attacks WHERE day IN (DATE '2024-01-03', DATE '2024-01-04', DATE '2024-01-05') GROUP BY ALL")
def s18(t: Tables) -> DataFrame:
    path, rows = scratch_path(t.spark, "activity"), activity.daily_activity(t.attacks).select("day", "source_ip", "honeypot", "event_count")
    logs.write_days(rows.filter("day IN (DATE '2024-01-03', DATE '2024-01-04')"), path)
    logs.write_days(rows.filter("day IN (DATE '2024-01-04', DATE '2024-01-05')"), path)  # a late rerun of one day
    return t.spark.read.parquet(path).withColumn("day", F.col("day").cast("date"))


@query("s21_text_round_trip", "SELECT source, ioc_type, ioc_value, malware_family, confidence FROM feeds")
def s21(t: Tables) -> DataFrame:
    path, rows = scratch_path(t.spark, "export"), t.feeds.select("source", "ioc_type", "ioc_value", F.nullif("malware_family", F.lit("")).alias("malware_family"), "confidence")
    logs.export_text(rows, path)
    return logs.import_text(t.spark, path, rows.schema).withColumn("malware_family", F.coalesce("malware_family", F.lit("")))


@query("s22_changed_since", "SELECT source, count(*) AS n FROM feeds WHERE snapshot_date > DATE '2024-01-10' GROUP BY source")
def s22(t: Tables) -> DataFrame:
    import datetime

    return counted(logs.changed_since(t.feeds, "snapshot_date", datetime.date(2024, 1, 10)), "source")
