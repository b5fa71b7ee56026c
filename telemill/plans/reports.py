"""Report queries R1 to R32: counts, distributions and rankings over events, credentials, indicators, devices and feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions import rules
from telemill.operators.activity import daily_activity
from telemill.operators.classify import reclassification_report
from telemill.operators.iocs import credentials, extract_iocs, merged_iocs
from telemill.operators.reporting import PROXY_PORTS, counted, ranked, share_of
from telemill.plans.adapters import Tables
from telemill.plans.registry import query


@query("r1_row_counts", "SELECT 'attacks' AS name, count(*) AS n FROM attacks UNION ALL SELECT 'devices', count(*) FROM devices UNION ALL SELECT 'feeds', count(*) FROM feeds")
def r1(t: Tables) -> DataFrame:
    one = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("attacks", t.attacks), ("devices", t.devices), ("feeds", t.feeds))]
    return one[0].unionByName(one[1]).unionByName(one[2])


@query("r2_events_by_honeypot", "SELECT honeypot, count(*) AS n, count(DISTINCT source_ip) AS ips, min(day) AS first_day, max(day) AS last_day FROM attacks GROUP BY honeypot")
def r2(t: Tables) -> DataFrame:
    return t.attacks.groupBy("honeypot").agg(F.count("*").alias("n"), F.countDistinct("source_ip").alias("ips"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("r3_window_days", "SELECT date_diff('day', min(day), max(day)) AS days FROM attacks")
def r3(t: Tables) -> DataFrame:
    return t.attacks.agg(F.datediff(F.max("day"), F.min("day")).cast("long").alias("days"))


def _top(name: str, view: str, key: str, k: int, where: str = "TRUE") -> None:
    """A top-k report: the k most frequent values, ties by value."""

    @query(name, f"SELECT {key}, count(*) AS n FROM {view} WHERE {where} GROUP BY {key} ORDER BY n DESC, {key} LIMIT {k}")
    def top(t: Tables) -> DataFrame:
        return ranked(counted(getattr(t, view).filter(where), key), "n", key, k)


_top("r4_top_event_types", "attacks", "event_type", 15)
_top("r5_top_ports", "attacks", "dest_port", 20, "dest_port IS NOT NULL")
_top("r11_families_c2", "feeds", "malware_family", 20, "source = 'threatfox'")
_top("r11_families_url", "feeds", "malware_family", 20, "source = 'urlhaus'")
_top("r11_families_samples", "feeds", "malware_family", 20, "source = 'malwarebazaar'")
_top("r11_types_pulses", "feeds", "ioc_type", 20, "source = 'otx'")
_top("r13_device_types", "devices", "device_type", 50)
_top("r14_protocols", "devices", "protocol", 15)
_top("r14_ports", "devices", "port", 20)
_top("r14_countries", "devices", "country_code", 15)
_top("r14_orgs", "devices", "org", 15)
_top("r14_products", "devices", "product", 15)
_top("r15_proxy_ports", "devices", "port", 10, "port IN (1080, 3128, 8080, 8888)")
_top("r15_iot_ports", "devices", "port", 10, "port IN (23, 554, 1883, 2323, 7547)")
_top("r26_dionaea_protocols", "attacks", "protocol", 20, "honeypot = 'dionaea'")


@query("r6_top_attackers", "SELECT source_ip, count(*) AS hits, count(DISTINCT event_type) AS kinds, min(event_time) AS first_seen, max(event_time) AS last_seen FROM attacks GROUP BY source_ip ORDER BY hits DESC, source_ip LIMIT 20")
def r6(t: Tables) -> DataFrame:
    rows = t.attacks.groupBy("source_ip").agg(F.count("*").alias("hits"), F.countDistinct("event_type").alias("kinds"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    return ranked(rows, "hits", "source_ip", 20)


_CREDENTIALS = "SELECT coalesce(username, '') AS username, coalesce(password, '') AS password, count(*) AS attempt_count, count(*) FILTER (event_type = 'login.success') AS success_count, count(DISTINCT source_ip) AS source_ip_count FROM attacks WHERE event_type LIKE 'login.%' AND (username <> '' OR password <> '') GROUP BY ALL"


@query("r7_top_credentials", f"SELECT * FROM ({_CREDENTIALS}) ORDER BY attempt_count DESC, username, password LIMIT 20")
def r7(t: Tables) -> DataFrame:
    return credentials(t.attacks).select("username", "password", "attempt_count", "success_count", "source_ip_count").orderBy(F.desc("attempt_count"), "username", "password").limit(20)


_IOCS = r"""
WITH rules AS (
    SELECT record_id, event_time, honeypot, 'ip' AS ioc_type, source_ip AS ioc_value FROM attacks WHERE NOT regexp_matches(source_ip, '^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|0\.|::1)')
    UNION ALL SELECT record_id, event_time, honeypot, 'url', unnest(regexp_extract_all(command_str, 'https?://[^\s"''<>]+')) FROM attacks
    UNION ALL SELECT record_id, event_time, honeypot, 'ip', unnest(regexp_extract_all(command_str, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) FROM attacks
    UNION ALL SELECT record_id, event_time, honeypot, 'domain', lower(unnest(regexp_extract_all(command_str, '\b(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+(?:com|net|org|ru|cn|io|to|cc|tk|xyz|top|info|biz|pw|su)\b'))) FROM attacks
    UNION ALL SELECT record_id, event_time, honeypot, 'url', download_url FROM attacks WHERE event_type = 'session.file_download'
    UNION ALL SELECT record_id, event_time, honeypot, 'sha256', file_hash FROM attacks WHERE event_type = 'session.file_download'
), once AS (SELECT DISTINCT * FROM rules), merged AS (
    SELECT ioc_type, ioc_value, min(event_time) AS first_seen, max(event_time) AS last_seen, count(*) AS occurrence_count, string_agg(DISTINCT honeypot, ',' ORDER BY honeypot) AS honeypots FROM once GROUP BY ioc_type, ioc_value
)
"""


def _iocs(t: Tables) -> DataFrame:
    return merged_iocs(extract_iocs(t.attacks))


@query("u1_iocs", _IOCS + "SELECT * FROM merged")
def u1(t: Tables) -> DataFrame:
    return _iocs(t).withColumn("honeypots", F.array_join("source_honeypots", ",")).select("ioc_type", "ioc_value", "first_seen", "last_seen", "occurrence_count", "honeypots")


@query("r8_iocs_by_type", _IOCS + "SELECT ioc_type, count(*) AS n, count(DISTINCT ioc_value) AS distinct_values, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM merged GROUP BY ioc_type")
def r8(t: Tables) -> DataFrame:
    return _iocs(t).groupBy("ioc_type").agg(F.count("*").alias("n"), F.countDistinct("ioc_value").alias("distinct_values"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query("r9_top_urls_and_hashes", _IOCS + "SELECT ioc_type, ioc_value, occurrence_count FROM (SELECT *, row_number() OVER (PARTITION BY ioc_type ORDER BY occurrence_count DESC, ioc_value) AS rn FROM merged WHERE ioc_type IN ('url', 'sha256')) WHERE rn <= 15")
def r9(t: Tables) -> DataFrame:
    w = Window.partitionBy("ioc_type").orderBy(F.desc("occurrence_count"), "ioc_value")
    return _iocs(t).filter(F.col("ioc_type").isin("url", "sha256")).withColumn("rn", F.row_number().over(w)).filter("rn <= 15").select("ioc_type", "ioc_value", "occurrence_count")


@query("r10_feeds", "SELECT source, count(*) AS n, count(DISTINCT malware_family) AS families, min(snapshot_date) AS first_snapshot FROM feeds GROUP BY source")
def r10(t: Tables) -> DataFrame:
    return t.feeds.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("malware_family").alias("families"), F.min("snapshot_date").alias("first_snapshot"))


@query("r12_devices_by_week", "SELECT source, snapshot_week, count(*) AS n, count(DISTINCT ip) AS ips FROM devices GROUP BY source, snapshot_week")
def r12(t: Tables) -> DataFrame:
    return t.devices.groupBy("source", "snapshot_week").agg(F.count("*").alias("n"), F.countDistinct("ip").alias("ips"))


@query("r16_feed_matches", """
SELECT source, (SELECT count(DISTINCT a.source_ip) FROM attacks a JOIN feeds f ON f.ip = a.source_ip WHERE f.source = s.source) AS attackers, (SELECT count(DISTINCT d.ip) FROM devices d JOIN feeds f ON f.ip = d.ip WHERE f.source = s.source) AS devices
FROM (SELECT DISTINCT source FROM feeds) s""")
def r16(t: Tables) -> DataFrame:
    feed = t.feeds.filter("ip IS NOT NULL").select("source", "ip").distinct()
    count = lambda ips, name: feed.join(ips, "ip", "left_semi").groupBy("source").agg(F.count("*").alias(name))
    out = t.feeds.select("source").distinct().join(count(t.attacks.select(F.col("source_ip").alias("ip")), "attackers"), "source", "left").join(count(t.devices.select("ip"), "devices"), "source", "left")
    return out.na.fill(0)


@query("r17_families_by_pattern", "SELECT malware_family, count(*) AS n FROM feeds WHERE malware_family ILIKE '%machin%' OR malware_family ILIKE '%HOUSE%' GROUP BY malware_family")
def r17(t: Tables) -> DataFrame:
    return counted(t.feeds.filter("malware_family ILIKE ANY ('%machin%', '%HOUSE%')"), "malware_family")


@query("r18_daily_by_honeypot", "SELECT day, honeypot, sum(n) AS events, count(*) AS ips FROM (SELECT day, honeypot, source_ip, count(*) AS n FROM attacks GROUP BY ALL) GROUP BY day, honeypot")
def r18(t: Tables) -> DataFrame:
    return daily_activity(t.attacks).groupBy("day", "honeypot").agg(F.sum("event_count").alias("events"), F.count("*").alias("ips"))


@query("r18_multi_day_ips", "SELECT source_ip, count(DISTINCT day) AS days FROM attacks GROUP BY source_ip HAVING count(DISTINCT day) > 1")
def r18b(t: Tables) -> DataFrame:
    return t.attacks.groupBy("source_ip").agg(F.countDistinct("day").alias("days")).filter("days > 1")


@query("r19_runs_by_task", "SELECT concat('ingest_', honeypot) AS task_name, count(DISTINCT day) AS runs, max(event_time) AS last_run FROM attacks GROUP BY honeypot")
def r19(t: Tables) -> DataFrame:
    runs = t.attacks.groupBy(F.concat(F.lit("ingest_"), "honeypot").alias("task_name"), "day").agg(F.max("event_time").alias("completed_at"))
    return runs.groupBy("task_name").agg(F.count("*").alias("runs"), F.max("completed_at").alias("last_run"))


@query("r20_daily_volume", "SELECT day, count(*) AS n FROM attacks GROUP BY day")
def r20(t: Tables) -> DataFrame:
    return counted(t.attacks, "day")


def _unknown(name: str, key: str, sql: str | None = None, column: Callable[[], Column] | None = None) -> None:
    """Unknown devices by a column: rows and addresses."""

    @query(f"r21_unknown_by_{name}", sql or f"SELECT {key} AS value, count(*) AS n, count(DISTINCT ip) AS ips FROM devices WHERE device_type = 'unknown' GROUP BY {key}")
    def unknown(t: Tables) -> DataFrame:
        rows = t.devices_of("unknown")
        return rows.withColumn("value", F.col(key) if column is None else column()).groupBy("value").agg(F.count("*").alias("n"), F.countDistinct("ip").alias("ips"))


_unknown("port", "port")
_unknown("protocol", "protocol")
_unknown("server", "http_server")
_unknown("tag", "tag_list", "SELECT unnest(string_split(tag_list, ',')) AS value, count(*) AS n, count(DISTINCT ip) AS ips FROM devices WHERE device_type = 'unknown' GROUP BY 1", lambda: F.explode(F.split("tag_list", ",")))
_unknown("port_protocol", "port", "SELECT concat(CAST(port AS STRING), '/', protocol) AS value, count(*) AS n, count(DISTINCT ip) AS ips FROM devices WHERE device_type = 'unknown' GROUP BY 1", lambda: F.concat(F.col("port").cast("string"), F.lit("/"), "protocol"))


@query("r21_unknown_share", "SELECT source, count(*) FILTER (device_type = 'unknown') AS unknown, count(*) AS n, round(100.0 * count(*) FILTER (device_type = 'unknown') / count(*), 1) AS share FROM devices GROUP BY source")
def r21(t: Tables) -> DataFrame:
    rows = t.devices.groupBy("source").agg(F.count_if(F.col("device_type") == "unknown").alias("unknown"), F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.lit(100.0) * F.col("unknown") / F.col("n"), 1))


@query("r23_matches_by_type", _IOCS + """
SELECT 'ip' AS kind, count(DISTINCT m.ioc_value) AS n FROM merged m WHERE m.ioc_type = 'ip' AND m.ioc_value IN (SELECT ip FROM feeds) UNION ALL
SELECT 'url', count(DISTINCT m.ioc_value) FROM merged m WHERE m.ioc_type = 'url' AND m.ioc_value IN (SELECT ioc_value FROM feeds WHERE ioc_type = 'url') UNION ALL
SELECT 'sha256', count(DISTINCT m.ioc_value) FROM merged m WHERE m.ioc_type = 'sha256' AND m.ioc_value IN (SELECT ioc_value FROM feeds WHERE ioc_type = 'sha256')""")
def r23(t: Tables) -> DataFrame:
    kind = F.when(F.col("ip").isNotNull(), "ip").otherwise(F.col("ioc_type"))
    feed = t.feeds.select(kind.alias("kind"), F.coalesce("ip", "ioc_value").alias("ioc_value")).distinct()
    own = _iocs(t).filter(F.col("ioc_type").isin("ip", "url", "sha256")).select(F.col("ioc_type").alias("kind"), "ioc_value")
    found = own.join(feed, ["kind", "ioc_value"], "left_semi").groupBy("kind").agg(F.count("*").alias("n"))
    kinds = t.spark.createDataFrame([("ip",), ("url",), ("sha256",)], "kind string")
    return kinds.join(found, "kind", "left").na.fill(0)


@query("r24_shared_credentials", "SELECT username, password, count(DISTINCT source_ip) AS ips FROM attacks WHERE username <> '' AND password <> '' GROUP BY username, password HAVING count(DISTINCT source_ip) > 50 ORDER BY ips DESC, username, password LIMIT 20")
def r24(t: Tables) -> DataFrame:
    rows = t.attacks.filter("username <> '' AND password <> ''").groupBy("username", "password").agg(F.countDistinct("source_ip").alias("ips")).filter("ips > 50")
    return rows.orderBy(F.desc("ips"), "username", "password").limit(20)


@query("r25_hassh_clusters", "SELECT hassh, count(DISTINCT source_ip) AS ips FROM attacks WHERE hassh IS NOT NULL GROUP BY hassh ORDER BY ips DESC, hassh LIMIT 20")
def r25(t: Tables) -> DataFrame:
    return ranked(t.attacks.filter("hassh IS NOT NULL").groupBy("hassh").agg(F.countDistinct("source_ip").alias("ips")), "ips", "hassh", 20)


_PROXY = "port IN (1080, 3128, 8080, 8888)"


@query("r27_proxies_by_country", f"SELECT country_code, count(DISTINCT ip) AS ips, round(100.0 * count(DISTINCT ip) / sum(count(DISTINCT ip)) OVER (), 2) AS share FROM devices WHERE {_PROXY} GROUP BY country_code")
def r27(t: Tables) -> DataFrame:
    return share_of(t.devices.filter(F.col("port").isin(*PROXY_PORTS)).groupBy("country_code").agg(F.countDistinct("ip").alias("ips")), "ips")


@query("r27_proxies_by_asn", f"SELECT asn, count(DISTINCT ip) AS ips, string_agg(DISTINCT org, ',' ORDER BY org) AS orgs FROM devices WHERE {_PROXY} GROUP BY asn")
def r27b(t: Tables) -> DataFrame:
    return t.devices.filter(F.col("port").isin(*PROXY_PORTS)).groupBy("asn").agg(F.countDistinct("ip").alias("ips"), F.array_join(F.array_sort(F.collect_set("org")), ",").alias("orgs"))


@query("r28_exposure_baseline", "SELECT device_type, count(DISTINCT ip) AS ips, count(*) AS n, count(DISTINCT org) AS orgs FROM devices WHERE device_type IN ('camera', 'router', 'iot', 'proxy') GROUP BY device_type")
def r28(t: Tables) -> DataFrame:
    return t.devices_of("camera", "router", "iot", "proxy").groupBy("device_type").agg(F.countDistinct("ip").alias("ips"), F.count("*").alias("n"), F.countDistinct("org").alias("orgs"))


@query("r29_exposed_iot_proxies", "SELECT ip, port, org, snapshot_date FROM devices WHERE list_has_any(string_split(query_list, ','), ['q_iot']) AND list_contains(string_split(query_list, ','), 'q_proxy') AND port IN (1080, 3128, 8080, 8888) ORDER BY snapshot_date DESC, ip, port, org LIMIT 50")
def r29(t: Tables) -> DataFrame:
    ids = F.split("query_list", ",")
    rows = t.devices.filter(F.arrays_overlap(ids, F.array(F.lit("q_iot"))) & F.array_contains(ids, "q_proxy") & F.col("port").isin(*PROXY_PORTS))
    return rows.select("ip", "port", "org", "snapshot_date").orderBy(F.desc("snapshot_date"), "ip", "port", "org").limit(50)


@query("r30_mixed_asns", "SELECT asn, count(DISTINCT CASE WHEN query_category = 'iot' THEN ip END) AS iot_ips, count(DISTINCT CASE WHEN query_category = 'malware' THEN ip END) AS malware_ips FROM devices WHERE asn IN (SELECT asn FROM devices WHERE query_category = 'malware') GROUP BY asn HAVING count(DISTINCT CASE WHEN query_category = 'iot' THEN ip END) > 0")
def r30(t: Tables) -> DataFrame:
    of = lambda c: F.count_distinct(F.when(F.col("query_category") == c, F.col("ip")))
    bad = t.devices.filter("query_category = 'malware'").select("asn").distinct()
    return t.devices.join(bad, "asn", "left_semi").groupBy("asn").agg(of("iot").alias("iot_ips"), of("malware").alias("malware_ips")).filter("iot_ips > 0")


@query("r30_ports_of_compromised", "SELECT port, CASE WHEN port IN (1080, 3128, 8080, 8888) THEN 'proxy' ELSE 'other' END AS service, count(DISTINCT ip) AS ips FROM devices WHERE ip IN (SELECT ip FROM feeds) GROUP BY port")
def r30b(t: Tables) -> DataFrame:
    from telemill.functions.exprs import service_label

    bad = t.feeds.filter("ip IS NOT NULL").select("ip").distinct()
    return t.devices.join(bad, "ip", "left_semi").groupBy("port", service_label("port").alias("service")).agg(F.countDistinct("ip").alias("ips"))


@query("r31_type_by_snapshot", "SELECT device_type, count(*) FILTER (year(snapshot_date) = 1998) AS y1998, count(*) FILTER (year(snapshot_date) = 1999) AS y1999, count(*) FILTER (year(snapshot_date) = 2000) AS y2000 FROM devices GROUP BY device_type")
def r31(t: Tables) -> DataFrame:
    rows = t.devices.withColumn("y", F.concat(F.lit("y"), F.year("snapshot_date")))
    return rows.groupBy("device_type").pivot("y", ["y1998", "y1999", "y2000"]).agg(F.count(F.lit(1))).na.fill(0)


@query("r32_snapshot_totals", "SELECT snapshot_week, count(*) AS n, count(DISTINCT ip) AS ips, count(DISTINCT source) AS sources FROM devices GROUP BY snapshot_week")
def r32(t: Tables) -> DataFrame:
    return t.devices.groupBy("snapshot_week").agg(F.count("*").alias("n"), F.countDistinct("ip").alias("ips"), F.countDistinct("source").alias("sources"))


def _refill(words: tuple[str, ...]) -> str:
    return "|".join(rf"\b{w}\b" if w in rules.REFILL_WHOLE_WORDS else w for w in words)


@query("x3_reclassified", f"""
WITH again AS (
    SELECT device_type AS old_type, CASE WHEN device_type <> 'unknown' THEN device_type WHEN port = 554 OR regexp_matches(t, '{_refill(rules.REFILL_CAMERA_WORDS)}') THEN 'camera' WHEN port = 7547 OR regexp_matches(t, '{_refill(rules.REFILL_ROUTER_WORDS)}') THEN 'router'
        WHEN regexp_matches(s, '{_refill(rules.REFILL_PROXY_WORDS)}') OR protocol IN ('socks5-proxy', 'socks4-proxy', 'http-connect') OR (port IN (1080, 3128) AND (coalesce(raw_banner, '') <> '' OR coalesce(http_server, '') <> '')) THEN 'proxy'
        WHEN protocol IN ('mqtt', 'coap') OR regexp_matches(t, '{_refill(rules.REFILL_IOT_WORDS)}') THEN 'iot' WHEN regexp_matches(t, '{_refill(rules.REFILL_SERVER_WORDS)}') OR protocol IN ('smtp', 'imap', 'imap-ssl', 'smb', 'mssql', 'ssh', 'pop3') THEN 'server' ELSE 'unknown' END AS new_type
    FROM (SELECT *, lower(concat_ws(' ', protocol, http_server, raw_banner)) AS t, lower(concat_ws(' ', http_server, raw_banner)) AS s FROM devices)
)
SELECT device_type, sum(b) AS before, sum(a) AS after FROM (SELECT old_type AS device_type, 1 AS b, 0 AS a FROM again UNION ALL SELECT new_type, 0, 1 FROM again) GROUP BY device_type""")
def x3(t: Tables) -> DataFrame:
    return reclassification_report(t.devices.withColumn("http_title", F.lit(None).cast("string")))
