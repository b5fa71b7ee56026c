"""Queries that take raw lines, hosts, feeds and streams, all derived from the given tables, through parsers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill import schemas
from telemill.operators import graph, normalize
from telemill.plans.adapters import Tables
from telemill.plans.analyses import _EDGES
from telemill.plans.registry import query
from telemill.plans.reports import _IOCS
from telemill.plans.storage import scratch_path
from telemill.plans.streams import attack_stream
from telemill.sources import logs
from telemill.streaming import jobs


def _lines(rows: DataFrame, *fields) -> DataFrame:
    return rows.select(F.lit("derived").alias("file_path"), F.col("record_id").cast("int").alias("line_number"), F.col("event_time").alias("collected_at"), F.to_json(F.struct(*fields)).alias("value"))


@query("n2_ssh_parser", "SELECT event_type, CASE WHEN dest_port = 23 THEN 'telnet' ELSE 'ssh' END AS protocol, count(*) AS n, count(username) AS users, count(password) AS passwords, count(command_str) AS commands, count(file_hash) AS hashes, min(event_time) AS first_seen FROM attacks GROUP BY ALL")
def n2(t: Tables) -> DataFrame:
    c = F.col
    lines = _lines(
        t.attacks, F.concat(F.lit("cowrie."), "event_type").alias("eventid"), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), c("source_ip").alias("src_ip"), c("dest_port").alias("dst_port"),
        c("session_id").alias("session"), "username", "password", c("command_str").alias("input"), c("download_url").alias("url"), c("file_hash").alias("shasum"), "hassh",
    )
    good, _ = logs.parse_json_lines(lines, schemas.SSH_LINE)
    events = normalize.ssh_events(good)
    return events.groupBy("event_type", "protocol").agg(F.count("*").alias("n"), F.count("username").alias("users"), F.count("password").alias("passwords"), F.count("command_str").alias("commands"), F.count("file_hash").alias("hashes"), F.min("event_time").alias("first_seen"))


@query("n3_canary_parser", "SELECT CASE record_id % 4 WHEN 0 THEN 'ftp' WHEN 1 THEN 'http' WHEN 2 THEN 'portscan' ELSE 'unknown_77' END AS protocol, CASE record_id % 4 WHEN 0 THEN 'login.attempt' WHEN 1 THEN 'http.request' WHEN 2 THEN 'port_scan' ELSE 'connection' END AS event_type, count(*) AS n, count(CASE WHEN record_id % 4 = 0 THEN nullif(username, '') END) AS users, min(event_time) AS first_seen FROM attacks WHERE record_id % 5 <> 0 GROUP BY ALL")
def n3(t: Tables) -> DataFrame:
    kind = F.when(F.col("record_id") % 5 == 0, 1001).otherwise(F.element_at(F.array(*[F.lit(x) for x in (2000, 3000, 17000, 77)]), (F.col("record_id") % 4 + 1).cast("int")))
    lines = _lines(t.attacks, kind.alias("logtype"), F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("local_time"), F.col("source_ip").alias("src_host"), F.col("dest_port").alias("dst_port"), F.struct(F.nullif("username", F.lit("")).alias("USERNAME"), F.col("password").alias("PASSWORD")).alias("logdata"))
    good, _ = logs.parse_json_lines(lines, schemas.CANARY_LINE)
    return normalize.canary_events(good).groupBy("protocol", "event_type").agg(F.count("*").alias("n"), F.count("username").alias("users"), F.min("event_time").alias("first_seen"))


@query("n4_tcp_parser", "SELECT CASE WHEN dest_port IN (5555) THEN 'adb' WHEN dest_port IN (2323, 23) THEN 'telnet' WHEN dest_port = 22 THEN 'ssh' WHEN dest_port IN (80, 8080) THEN 'http' WHEN dest_port = 7547 THEN 'tr069' ELSE 'mqtt' END AS protocol, dest_port, count(*) AS n, count(file_hash) AS hashes FROM attacks WHERE record_id % 3 <> 0 GROUP BY ALL")
def n4(t: Tables) -> DataFrame:
    msg = F.when(F.col("record_id") % 3 == 0, "startup").otherwise("Packet got handled by tcp")
    lines = _lines(t.attacks, F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'123Z'").alias("time"), msg.alias("msg"), F.col("dest_port").cast("string").alias("dest_port"), F.col("source_ip").alias("src_ip"), F.coalesce("file_hash", F.lit("short")).alias("payload_hash"))
    good, _ = logs.parse_json_lines(lines, schemas.TCP_LINE)
    return normalize.tcp_events(good).groupBy("protocol", "dest_port").agg(F.count("*").alias("n"), F.count("file_hash").alias("hashes"))


@query("n5_connection_events", "SELECT CASE record_id % 3 WHEN 0 THEN 'smb' WHEN 1 THEN 'mysql' ELSE 'tcp' END AS protocol, count(*) AS n, count(download_url) AS downloads, min(event_time) AS first_seen FROM attacks WHERE record_id > 100 GROUP BY ALL")
def n5(t: Tables) -> DataFrame:
    service = F.when(F.col("record_id") % 3 == 0, "smbd").when(F.col("record_id") % 3 == 1, "mysqld").otherwise("oddd")
    c = t.attacks.select(F.col("record_id").alias("connection"), service.alias("connection_type"), F.lit("tcp").alias("connection_transport"), (F.unix_micros("event_time") / 1e6).alias("connection_timestamp"), F.lit("10.0.0.1").alias("local_host"), F.col("dest_port").alias("local_port"), F.col("source_ip").alias("remote_host"), F.lit(4444).alias("remote_port"))
    d = t.attacks.filter("download_url IS NOT NULL").select(F.col("record_id").alias("connection"), "download_url", F.substring("file_hash", 1, 32).alias("download_md5_hash"))
    new, _ = logs.connections_since(c, 100)
    return normalize.connection_events(new, d).groupBy("protocol").agg(F.count("*").alias("n"), F.count("download_url").alias("downloads"), F.min("event_time").alias("first_seen"))


@query("n6_host_devices", "SELECT port, count(*) AS n, count(DISTINCT asn) AS asns, max(len(coalesce(raw_banner, ''))) AS banner FROM (SELECT DISTINCT ON (ip, port) ip, port, asn, raw_banner FROM devices ORDER BY ip, port, seq) GROUP BY port")
def n6(t: Tables) -> DataFrame:
    w = normalize.first_of(t.devices, ["ip", "port"], "seq")
    service = F.struct("port", F.col("raw_banner").alias("data"), F.struct(F.col("http_server").alias("server")).alias("http"))
    docs = w.groupBy("ip", "asn", "org").agg(F.collect_list(service).alias("data"))
    doc = F.to_json(F.struct(F.col("ip").alias("ip_str"), F.concat(F.lit("AS"), F.col("asn").cast("string")).alias("asn"), "org", "data"))
    found = normalize.host_devices(docs.select(F.try_parse_json(doc).alias("doc")), "2024-01-01", "2024-01-03", "q1", "iot")
    return found.groupBy("port").agg(F.count("*").alias("n"), F.countDistinct("asn").alias("asns"), F.max(F.length(F.coalesce("raw_banner", F.lit("")))).alias("banner"))


@query("n8_feed_records", """
SELECT source, ioc_type, count(*) AS n, count(ip) AS ips, count(port) AS ports, sum(confidence) AS confidence, count(DISTINCT malware_family) AS families FROM (
    SELECT source, ioc_type, ip, port, CASE source WHEN 'threatfox' THEN confidence WHEN 'urlhaus' THEN CASE WHEN seq % 3 = 0 THEN 100 ELSE 80 END WHEN 'malwarebazaar' THEN 90 ELSE 75 END AS confidence, CASE WHEN source = 'threatfox' THEN malware_family WHEN source = 'otx' THEN 'unknown' WHEN malware_family = '' THEN 'unknown' ELSE malware_family END AS malware_family FROM feeds) GROUP BY ALL""")
def n8(t: Tables) -> DataFrame:
    def docs(source: str, *fields) -> DataFrame:
        return t.feeds.filter(F.col("source") == source).select(F.try_parse_json(F.to_json(F.struct(*fields))).alias("doc"))

    c, tags = F.col, F.when(F.col("malware_family") != "", F.array(F.upper("malware_family"))).otherwise(F.array().cast("array<string>"))
    c2 = normalize.c2_feed(docs("threatfox", c("ioc_type"), c("ioc_value").alias("ioc"), F.upper("malware_family").alias("malware"), c("confidence").alias("confidence_level")), "2024-01-02")
    urls = docs("urlhaus", c("ioc_value").alias("url"), F.lit("host.example").alias("host"), F.when(c("seq") % 3 == 0, "online").otherwise("offline").alias("url_status"), tags.alias("tags"))
    samples = normalize.sample_feed(docs("malwarebazaar", c("ioc_value").alias("sha256_hash"), F.upper("malware_family").alias("signature")), "2024-01-02")
    pulses = docs("otx", F.lit("pulse").alias("name"), F.array(F.struct(F.lit("IPv4").alias("type"), c("ioc_value").alias("indicator")), F.struct(F.lit("CVE").alias("type"), F.lit("x").alias("indicator"))).alias("indicators"))
    every = c2.unionByName(normalize.url_feed(urls, urls.limit(0), "2024-01-02")).unionByName(samples).unionByName(normalize.pulse_feed(pulses, "2024-01-02"))
    return every.groupBy("source", "ioc_type").agg(F.count("*").alias("n"), F.count("ip").alias("ips"), F.count("port").alias("ports"), F.sum("confidence").alias("confidence"), F.countDistinct("malware_family").alias("families"))


@query("s7_filtered_scan", "SELECT port, count(*) AS n FROM devices WHERE port IN (2323, 7547, 1883, 554, 1080, 3128) OR (port = 23 AND regexp_matches(lower(raw_banner), 'busybox|arm')) OR (port = 8080 AND regexp_matches(lower(raw_banner), 'boa ')) OR (port = 8888 AND regexp_matches(lower(raw_banner), 'socks')) GROUP BY port")
def s7(t: Tables) -> DataFrame:
    scan = t.devices.select("ip", "port", F.base64(F.col("raw_banner").cast("binary")).alias("value"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("string").alias("banner"))
    return logs.filtered_scan(scan).groupBy("port").agg(F.count("*").alias("n"))


@query("s8_scan_budget", "SELECT port, count(*) AS n FROM (SELECT port, coalesce(sum(size) OVER (PARTITION BY port ORDER BY ip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT DISTINCT port, ip, len(ip) + 9 AS size FROM devices)) WHERE before < 5000 GROUP BY port")
def s8(t: Tables) -> DataFrame:
    rows = t.devices.select("ip", "port").distinct()
    return logs.within_budget(rows, 5000, size=F.length("ip") + 9).groupBy("port").agg(F.count("*").alias("n"))


@query("s11_insert_new", "SELECT count(*) AS n FROM (SELECT DISTINCT source_ip, dest_port FROM attacks WHERE day > DATE '2024-01-03' EXCEPT SELECT source_ip, dest_port FROM attacks WHERE day <= DATE '2024-01-03')")
def s11(t: Tables) -> DataFrame:
    old, new = t.attacks.filter("day <= DATE '2024-01-03'"), t.attacks.filter("day > DATE '2024-01-03'")
    return logs.insert_new(old, new, ["source_ip", "dest_port"]).agg(F.count("*").alias("n"))


@query("s25_freshness", "SELECT honeypot, max(event_time) AS last_event, count(*) FILTER (event_time > TIMESTAMP '2024-01-30 23:00:00') AS recent_events, CASE WHEN count(*) FILTER (event_time > TIMESTAMP '2024-01-30 23:00:00') > 0 THEN 'fresh' ELSE 'stale' END AS status FROM attacks GROUP BY honeypot")
def s25(t: Tables) -> DataFrame:
    return logs.freshness(t.attacks, "2024-01-31 00:00:00", 60)


@query("st8_ioc_stream", _IOCS + "SELECT ioc_type, ioc_value, occurrence_count FROM merged")
def st8(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "iocs")
    jobs.ioc_batches(attack_stream(t), path, f"{path}-state").awaitTermination()
    return jobs.merged_ioc_batches(t.spark, path).select("ioc_type", "ioc_value", "occurrence_count")


@query("st6_sessions", """
SELECT source_ip, count(*) AS sessions, max(n) AS longest FROM (
    SELECT source_ip, s, count(*) AS n FROM (SELECT source_ip, sum(CASE WHEN before IS NULL OR event_time - before >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY source_ip ORDER BY event_time, record_id) AS s
        FROM (SELECT *, lag(event_time) OVER (PARTITION BY source_ip ORDER BY event_time, record_id) AS before FROM attacks)) GROUP BY ALL) GROUP BY source_ip""")
def st6(t: Tables) -> DataFrame:
    return jobs.sessions(t.attacks, "6 hours").groupBy("source_ip").agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))


@query("st7_recent_windows", "SELECT honeypot, time_bucket(INTERVAL 5 MINUTES, event_time) - k * INTERVAL 5 MINUTES AS start, count(*) AS events FROM attacks, range(12) r(k) GROUP BY ALL")
def st7(t: Tables) -> DataFrame:
    return jobs.recent_activity(t.attacks).select("honeypot", "start", "events")


@query("st1_ingest_stream", "SELECT honeypot, count(*) AS n, min(event_time) AS first_event FROM attacks GROUP BY honeypot")
def st1(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "ingest")
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest(attack_stream(t), path, f"{path}-state", ["record_id"]).awaitTermination()
    return t.spark.read.parquet(path).groupBy("honeypot").agg(F.count("*").alias("n"), F.min("event_time").alias("first_event"))


@query("st7_recent_stream", "SELECT honeypot, time_bucket(INTERVAL 5 MINUTES, event_time) - k * INTERVAL 5 MINUTES AS start, count(*) AS events FROM attacks, range(12) r(k) GROUP BY ALL")
def st7_stream(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "recent")
    jobs.to_batches(jobs.recent_activity(attack_stream(t)), path, f"{path}-state", mode="update").awaitTermination()
    return jobs.latest(t.spark, path, ["start", "honeypot"]).select("honeypot", "start", "events")


@query("s23_landed_hosts", "SELECT port, count(*) AS n, count(DISTINCT ip) AS ips FROM devices GROUP BY port")
def s23(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "hosts")
    t.devices.select(F.to_json(F.struct("ip", "port")).alias("value")).unionByName(t.devices.limit(1).select(F.lit("{broken").alias("value"))).write.text(path)
    docs = logs.read_hosts(t.spark, path).select(F.try_variant_get("doc", "$.ip", "string").alias("ip"), F.try_variant_get("doc", "$.port", "int").alias("port"))
    return docs.groupBy("port").agg(F.count("*").alias("n"), F.count_distinct("ip").alias("ips"))


@query("n16_week_backfill", "SELECT CAST(date_trunc('week', snapshot_date) AS DATE) AS snapshot_week, count(*) AS n FROM devices GROUP BY 1")
def n16(t: Tables) -> DataFrame:
    odd = F.pmod(F.xxhash64("ip"), F.lit(2)) == 0  # those have lost their week
    rows = normalize.backfill_week(t.devices.withColumn("snapshot_week", F.when(~odd, F.to_date(F.date_trunc("week", "snapshot_date")))))
    return rows.groupBy("snapshot_week").agg(F.count("*").alias("n"))


@query("n14_clean_records", "SELECT source_ip, count(*) AS n, 'a' || source_ip || 'b' AS cleaned FROM attacks GROUP BY source_ip")
def n14(t: Tables) -> DataFrame:
    with_nul = t.attacks.select("source_ip", F.struct(F.concat(F.lit("a\0"), "source_ip", F.lit("\0b")).alias("x")).alias("record"))
    return with_nul.groupBy("source_ip", F.get_json_object(normalize.clean_record(F.col("record")), "$.x").alias("cleaned")).agg(F.count("*").alias("n"))


@query("s9_unprocessed", "SELECT count(DISTINCT day) AS n FROM attacks WHERE day > DATE '2024-01-03'")
def s9(t: Tables) -> DataFrame:
    files = t.attacks.select(F.format_string("log-%s.json", F.col("day").cast("string")).alias("path"), "day").distinct()
    return logs.unprocessed(files.select("path"), files.filter("day <= DATE '2024-01-03'").select("path")).agg(F.count("*").alias("n"))


@query("s26_graph_export", _EDGES + " SELECT edge_type, count(*) AS n, sum(weight) AS weight FROM edges GROUP BY edge_type")
def s26(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "graph")
    edges = graph.graph_edges(t.attacks)
    logs.write_graph(graph.graph_nodes(edges), edges, path)
    return t.spark.read.parquet(f"{path}/edges").groupBy("edge_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
