"""Queries for aggregates, joins, windows, set operations, linkage, longitudinal and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.exprs import asn_number, canonical_ip, is_private_ip, ip_to_long, monday, net24, pseudonymous_ip
from telemill.operators import activity, graph, linkage, scoring
from telemill.operators.iocs import document_iocs, extract_iocs, merged_iocs
from telemill.operators.merge import merge_as_aggregate, merge_rules
from telemill.operators.normalize import first_of
from telemill.operators.reporting import PROXY_PORTS, counted, share_of, top_per_group
from telemill.plans.adapters import Tables
from telemill.plans.registry import query
from telemill.plans.reports import _IOCS
from telemill.plans.storage import store

_PROXY = "port IN (1080, 3128, 8080, 8888)"

# --- text indicators -------------------------------------------------------------------------------------------------

_TEXT_IOCS = r"""
WITH found AS (
    SELECT {key} AS id, 'url' AS ioc_type, unnest(regexp_extract_all({text}, '(?i)https?://[^\s"''<>]+')) AS ioc_value FROM {table}
    UNION ALL SELECT * FROM (SELECT {key}, 'ip', unnest(regexp_extract_all({text}, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b')) AS v FROM {table}) x WHERE NOT regexp_matches(v, '^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|0\.|::1)')
    UNION ALL SELECT {key}, 'sha256', lower(unnest(regexp_extract_all({text}, '\b[0-9a-fA-F]{{64}}\b'))) FROM {table}
    UNION ALL SELECT {key}, 'md5', lower(unnest(regexp_extract_all({text}, '\b[0-9a-fA-F]{{32}}\b'))) FROM {table}
    UNION ALL SELECT {key}, 'domain', lower(unnest(regexp_extract_all({text}, '(?i)\b(?:[a-z0-9](?:[a-z0-9\-]{{0,61}}[a-z0-9])?\.)+(?:com|net|org|ru|cn|io|to|cc|tk|xyz|top|info|biz|pw|su)\b'))) FROM {table}
)
SELECT ioc_type, ioc_value, count(DISTINCT id) AS n FROM found GROUP BY ioc_type, ioc_value
"""


def _text_iocs(table: str, key: str, text: str) -> None:
    @query(f"x1_iocs_of_{table}_{text}", _TEXT_IOCS.format(table=table, key=key, text=text))
    def found(t: Tables) -> DataFrame:
        return document_iocs(t.table(table), key, text).groupBy("ioc_type", "ioc_value").agg(F.countDistinct(key).alias("n"))


_text_iocs("documents", "doc_id", "text")
_text_iocs("pages", "page_id", "url")
_text_iocs("pages", "page_id", "html")

# --- aggregates and merges -------------------------------------------------------------------------------------------

_DAILY = "SELECT day, source_ip, honeypot, count(*) AS event_count, count(*) FILTER (event_type LIKE 'login%') AS login_attempts, count(DISTINCT session_id) AS unique_sessions, min(event_time) AS first_event, max(event_time) AS last_event FROM attacks {where} GROUP BY ALL"


@query("a1_daily_activity", _DAILY.format(where=""))
def a1(t: Tables) -> DataFrame:
    return activity.daily_activity(t.attacks)


@query("a2_catch_up", _DAILY.format(where="WHERE day BETWEEN DATE '2024-01-11' AND DATE '2024-01-19'"))
def a2(t: Tables) -> DataFrame:
    done = activity.daily_activity(t.attacks.filter("day <= DATE '2024-01-10'"))
    return activity.catch_up(t.attacks, done, "2024-01-20")


@query("m1_ioc_merge_in_two_batches", _IOCS + "SELECT ioc_type, ioc_value, first_seen, last_seen, occurrence_count, honeypots FROM merged")
def m1(t: Tables) -> DataFrame:
    found = extract_iocs(t.attacks)
    old, new = (merged_iocs(found.filter(c)) for c in ("event_time < TIMESTAMP '2024-01-15'", "event_time >= TIMESTAMP '2024-01-15'"))
    return merge_as_aggregate(new, **merge_rules("iocs"), old=old).withColumn("honeypots", F.array_join("source_honeypots", ",")).drop("source_honeypots")


@query("m3_device_merge", """
SELECT source, ip, port, snapshot_week, max(snapshot_date) AS snapshot_date, coalesce(arg_max(device_type, seq) FILTER (device_type <> 'unknown'), 'unknown') AS device_type,
    arg_min(query_category, seq) AS query_category, arg_max(raw_banner, seq) FILTER (raw_banner IS NOT NULL) AS raw_banner FROM devices GROUP BY ALL""")
def m3(t: Tables) -> DataFrame:
    rows = t.devices.select("source", "ip", "port", "snapshot_week", "snapshot_date", "device_type", "query_category", "raw_banner", "seq")
    return merge_as_aggregate(rows, **merge_rules("devices", ["snapshot_date", "device_type", "query_category", "raw_banner"]), seq="seq")


@query("m4_feed_merge", "SELECT source, ioc_value, max(confidence) AS confidence, coalesce(arg_max(malware_family, seq) FILTER (malware_family <> ''), '') AS malware_family, arg_max(snapshot_date, seq) AS snapshot_date FROM feeds GROUP BY ALL")
def m4(t: Tables) -> DataFrame:
    return merge_as_aggregate(t.feeds, **merge_rules("feeds", ["confidence", "malware_family", "snapshot_date"]), seq="seq")


@query("a8_login_share", "SELECT honeypot, round(100.0 * count(*) FILTER (event_type = 'login.success') / nullif(count(*) FILTER (event_type LIKE 'login%'), 0), 1) AS success_pct FROM attacks GROUP BY honeypot")
def a8(t: Tables) -> DataFrame:
    from telemill.functions.exprs import safe_share

    return t.attacks.groupBy("honeypot").agg(safe_share(F.count_if(F.col("event_type") == "login.success"), F.count_if(F.col("event_type").startswith("login"))).alias("success_pct"))


@query("a10_two_level", "SELECT source_ip, avg(n) AS mean_events, max(n) AS most_events FROM (SELECT source_ip, day, count(*) AS n FROM attacks GROUP BY ALL) GROUP BY source_ip")
def a10(t: Tables) -> DataFrame:
    return t.attacks.groupBy("source_ip", "day").agg(F.count("*").alias("n")).groupBy("source_ip").agg(F.avg("n").alias("mean_events"), F.max("n").alias("most_events"))


@query("a11_distinct_tuples", "SELECT count(*) AS n FROM (SELECT DISTINCT username, password FROM attacks)")
def a11(t: Tables) -> DataFrame:
    return t.attacks.agg(F.count_distinct(F.struct("username", "password")).alias("n"))


@query("a14_priority_ips", """
SELECT ip, min(CASE query_category WHEN 'malware' THEN 0 WHEN 'proxy' THEN 1 WHEN 'iot' THEN 2 ELSE 3 END) AS category_rank, min(CASE WHEN device_type IN ('camera', 'router', 'iot') THEN 0 WHEN device_type = 'proxy' THEN 1 ELSE 2 END) AS type_rank,
    max(CAST(port IN (1080, 3128, 8080, 8888) AS INT)) AS has_proxy, count(*) AS n FROM devices GROUP BY ip ORDER BY category_rank, type_rank, has_proxy DESC, n DESC, ip LIMIT 100""")
def a14(t: Tables) -> DataFrame:
    return scoring.priority_ips(t.devices, ["malware", "proxy", "iot"], 100)


_LINKS = _IOCS.rstrip() + """, links AS (
    SELECT CASE WHEN f.source = 'otx' THEN 'pulse' ELSE 'c2' END AS kind, m.ioc_value, f.malware_family, f.confidence FROM merged m JOIN feeds f ON m.ioc_type = 'ip' AND f.ip = m.ioc_value
    UNION ALL SELECT CASE WHEN f.ioc_type = 'url' THEN 'url' ELSE 'hash' END, m.ioc_value, f.malware_family, f.confidence FROM merged m JOIN feeds f ON f.ip IS NULL AND f.ioc_type = m.ioc_type AND f.ioc_value = m.ioc_value
)
"""


@query("a15_cross_match", _LINKS + """
SELECT *, round(100.0 * ip_matches / greatest(ips, 1), 1) AS ip_matches_pct, round(100.0 * url_matches / greatest(urls, 1), 1) AS url_matches_pct, round(100.0 * hash_matches / greatest(hashes, 1), 1) AS hash_matches_pct FROM
(SELECT count(DISTINCT CASE WHEN kind IN ('c2', 'pulse') THEN ioc_value END) AS ip_matches, count(DISTINCT CASE WHEN kind = 'url' THEN ioc_value END) AS url_matches, count(DISTINCT CASE WHEN kind = 'hash' THEN ioc_value END) AS hash_matches, count(DISTINCT nullif(malware_family, '')) AS families FROM links),
(SELECT count(*) FILTER (ioc_type = 'ip') AS ips, count(*) FILTER (ioc_type = 'url') AS urls, count(*) FILTER (ioc_type = 'sha256') AS hashes FROM merged)""")
def a15(t: Tables) -> DataFrame:
    return linkage.cross_match(merged_iocs(extract_iocs(t.attacks)), t.feeds)


@query("r22_feed_linkage", _LINKS + "SELECT kind, count(DISTINCT ioc_value) AS matches, count(DISTINCT nullif(malware_family, '')) AS families, CASE WHEN kind = 'pulse' THEN NULL ELSE CAST(max(confidence) AS BIGINT) END AS max_confidence FROM links GROUP BY kind")
def r22(t: Tables) -> DataFrame:
    return linkage.feed_link_summary(linkage.feed_links(merged_iocs(extract_iocs(t.attacks)), t.feeds))


@query("j1_feed_links", _LINKS + "SELECT kind, ioc_value, malware_family, confidence FROM links")
def j1(t: Tables) -> DataFrame:
    return linkage.feed_links(merged_iocs(extract_iocs(t.attacks)), t.feeds)


@query("a16_credential_stats", "SELECT username, password, count(*) AS attempt_count, count(*) FILTER (event_type = 'login.success') AS success_count, count(DISTINCT source_ip) AS source_ip_count, min(event_time) AS first_seen, max(event_time) AS last_seen FROM attacks WHERE event_type IN ('login.attempt', 'login.success', 'login.failed') AND (username <> '' OR password <> '') GROUP BY username, password")
def a16(t: Tables) -> DataFrame:
    from telemill.operators.iocs import credentials

    return credentials(t.attacks)


@query("a17_source_profiles", """
SELECT e.ip, e.first_seen, e.last_seen, e.event_count, d.country_code, d.asn FROM (SELECT source_ip AS ip, min(event_time) AS first_seen, max(event_time) AS last_seen, count(*) AS event_count FROM attacks GROUP BY 1) e
LEFT JOIN (SELECT ip, arg_max(country_code, seq) AS country_code, arg_max(asn, seq) AS asn FROM devices GROUP BY ip) d ON d.ip = e.ip""")
def a17(t: Tables) -> DataFrame:
    e = t.attacks.groupBy(F.col("source_ip").alias("ip")).agg(F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.count("*").alias("event_count"))
    d = t.devices.groupBy("ip").agg(F.max_by("country_code", "seq").alias("country_code"), F.max_by("asn", "seq").alias("asn"))
    return e.join(d, "ip", "left")


# --- joins -----------------------------------------------------------------------------------------------------------


@query("j3_attacker_devices", "SELECT device_type, count(DISTINCT ip) AS attackers FROM devices WHERE ip IN (SELECT source_ip FROM attacks) GROUP BY device_type")
def j3(t: Tables) -> DataFrame:
    return linkage.attacker_devices(t.attacks, t.devices)


@query("j4_devices_by_family", "SELECT malware_family, count(DISTINCT d.ip) AS devices FROM devices d JOIN feeds f ON d.ip = f.ip GROUP BY malware_family")
def j4(t: Tables) -> DataFrame:
    return linkage.matched_by(t.devices, t.feeds, "malware_family", "devices")


@query("j5_hash_ignoring_case", "SELECT lower(a.file_hash) AS sha, count(*) AS n FROM attacks a JOIN (SELECT DISTINCT upper(ioc_value) AS h FROM feeds WHERE ioc_type = 'sha256') f ON lower(a.file_hash) = lower(f.h) GROUP BY 1")
def j5(t: Tables) -> DataFrame:
    feed = t.feeds.filter("ioc_type = 'sha256'").select(F.upper("ioc_value").alias("h")).distinct()
    return linkage.same_hash(t.attacks, feed, "file_hash", "h").groupBy(F.lower("file_hash").alias("sha")).agg(F.count("*").alias("n"))


_USED = "WITH used AS (SELECT DISTINCT source_ip, username, password FROM attacks WHERE username <> '' AND password <> '') "


_WEIGHED = _USED.rstrip() + ", size AS (SELECT username, password, count(*) AS ips FROM used GROUP BY ALL), weighed AS (SELECT u.*, ips FROM used u JOIN size s ON u.username = s.username AND u.password = s.password) "


@query("j6_shared_credential_pairs", _USED + "SELECT a.source_ip AS src, b.source_ip AS dst, count(*) AS n FROM used a JOIN used b ON a.username = b.username AND a.password = b.password AND a.source_ip <> b.source_ip GROUP BY ALL")
def j6(t: Tables) -> DataFrame:
    return linkage.shared_credential_pairs(t.attacks)


@query("j7_sharing_attackers", _USED + "SELECT DISTINCT source_ip FROM used a WHERE EXISTS (SELECT 1 FROM used b WHERE a.username = b.username AND a.password = b.password AND a.source_ip <> b.source_ip)")
def j7(t: Tables) -> DataFrame:
    return linkage.sharing_attackers(t.attacks)


@query("j8_arrivals", "WITH d AS (SELECT DISTINCT source_ip, day FROM attacks) SELECT source_ip, day FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.source_ip = a.source_ip AND b.day < a.day AND b.day >= a.day - 7)")
def j8(t: Tables) -> DataFrame:
    return activity.arrivals(t.attacks)


@query("j9_events_of_listed", "SELECT event_type, count(*) AS n FROM attacks WHERE source_ip IN (SELECT ip FROM feeds) GROUP BY event_type")
def j9(t: Tables) -> DataFrame:
    listed = t.feeds.filter("ip IS NOT NULL").select(F.col("ip").alias("source_ip"))
    return counted(t.attacks.join(listed, "source_ip", "left_semi"), "event_type")


@query("j11_address_or_organisation", "SELECT malware_family, count(DISTINCT d.ip) AS devices FROM feeds f JOIN (SELECT DISTINCT ip, org FROM devices) d ON f.ip = d.ip OR lower(f.ioc_value) = lower(d.org) GROUP BY malware_family HAVING count(DISTINCT d.ip) > 5")
def j11(t: Tables) -> DataFrame:
    return linkage.organisations_or_addresses(t.feeds, t.devices)


_LATER = "SELECT d.ip, a.first_attack, min(d.snapshot_date) AS exposed, date_diff('day', a.first_attack, min(d.snapshot_date)) AS lag_days FROM (SELECT source_ip AS ip, min(day) - 8766 AS first_attack FROM attacks GROUP BY 1) a JOIN devices d ON a.ip = d.ip AND d.snapshot_date > a.first_attack GROUP BY d.ip, a.first_attack"


@query("j12_first_exposure", _LATER)
def j12(t: Tables) -> DataFrame:
    early = t.attacks.withColumn("event_time", F.date_sub(F.to_date("event_time"), 8766))  # before the snapshots
    return linkage.first_exposure_after(early, t.devices).withColumn("lag_days", F.col("lag_days").cast("long"))


@query("j13_consecutive_weeks", "WITH s AS (SELECT DISTINCT ip, port, snapshot_week FROM devices) SELECT a.snapshot_week AS week, count(*) AS kept FROM s a JOIN s b ON a.ip = b.ip AND a.port = b.port AND b.snapshot_week = a.snapshot_week + 7 GROUP BY 1")
def j13(t: Tables) -> DataFrame:
    return linkage.consecutive_weeks(t.devices)


@query("j15_missing_nodes", "SELECT count(*) AS n FROM attacks a WHERE a.source_ip NOT IN (SELECT ip FROM devices)")
def j15(t: Tables) -> DataFrame:
    return t.attacks.join(t.devices.select(F.col("ip").alias("source_ip")), "source_ip", "left_anti").agg(F.count("*").alias("n"))


@query("j17_latest_device_type", "SELECT a.source_ip, d.device_type FROM (SELECT DISTINCT source_ip FROM attacks) a LEFT JOIN (SELECT ip, arg_max(device_type, seq) AS device_type FROM devices GROUP BY ip) d ON d.ip = a.source_ip")
def j17(t: Tables) -> DataFrame:
    d = t.devices.groupBy(F.col("ip").alias("source_ip")).agg(F.max_by("device_type", "seq").alias("device_type"))
    return t.attacks.select("source_ip").distinct().join(d, "source_ip", "left")


@query("j19_own_samples", "SELECT DISTINCT ioc_value AS sha256, malware_family FROM feeds WHERE ioc_type = 'sha256' AND ioc_value IN (SELECT file_hash FROM attacks WHERE event_time >= TIMESTAMP '2024-01-01 02:00:00') AND ioc_value NOT IN (SELECT file_hash FROM attacks WHERE event_time < TIMESTAMP '2024-01-01 02:00:00' AND file_hash IS NOT NULL)")
def j19(t: Tables) -> DataFrame:
    h = t.attacks.filter("file_hash IS NOT NULL").select(F.col("file_hash").alias("sha256"), "event_time")
    samples = t.feeds.filter("ioc_type = 'sha256'").select(F.col("ioc_value").alias("sha256"), "malware_family").distinct()
    return linkage.own_samples(h.filter("event_time >= TIMESTAMP '2024-01-01 02:00:00'"), h.filter("event_time < TIMESTAMP '2024-01-01 02:00:00'").select("sha256").distinct(), samples)


@query("j20_remaining_queries", "SELECT DISTINCT source, snapshot_week FROM devices WHERE source = 'shodan' AND country_code = 'NATION_3' AND snapshot_week NOT IN (SELECT snapshot_week FROM devices WHERE source = 'censys' AND country_code = 'NATION_3')")
def j20(t: Tables) -> DataFrame:
    runs = t.devices.filter("country_code = 'NATION_3'").select("source", "snapshot_week").distinct()
    return linkage.exclude_done(runs.filter("source = 'shodan'"), runs.filter("source = 'censys'"), ["snapshot_week"]).select("source", "snapshot_week")


@query("j21_shared_blocks", "SELECT concat(array_to_string(string_split(source_ip, '.')[1:3], '.'), '.0/24') AS net FROM attacks INTERSECT SELECT concat(array_to_string(string_split(ip, '.')[1:3], '.'), '.0/24') FROM devices")
def j21(t: Tables) -> DataFrame:
    return linkage.shared_blocks(t.attacks, t.devices)


@query("j22_service_matches", "SELECT ip, port, count(*) AS n FROM devices WHERE concat(ip, ':', CAST(port AS STRING)) IN (SELECT concat(ip, ':', CAST(port AS STRING)) FROM feeds WHERE port IS NOT NULL) GROUP BY ip, port")
def j22(t: Tables) -> DataFrame:
    return counted(linkage.service_matches(t.devices, t.feeds), "ip", "port")


@query("j23_url_hosts", "SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(download_url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM attacks WHERE download_url IS NOT NULL) WHERE host IN (SELECT lower(regexp_extract(ioc_value, '^[a-z]+://([^/:?#]+)', 1)) FROM feeds WHERE ioc_type = 'url') GROUP BY host")
def j23(t: Tables) -> DataFrame:
    own = t.attacks.filter("download_url IS NOT NULL").select(linkage.host_of("download_url").alias("host"))
    feed = t.feeds.filter("ioc_type = 'url'").select(linkage.host_of("ioc_value").alias("host")).distinct()
    return counted(own.join(feed, "host", "left_semi"), "host")


@query("j24_proxies_listed", f"SELECT count(DISTINCT ip) AS ips FROM devices WHERE {_PROXY} AND ip IN (SELECT ip FROM feeds)")
def j24(t: Tables) -> DataFrame:
    listed = t.feeds.filter("ip IS NOT NULL").select("ip")
    return t.devices.filter(F.col("port").isin(*PROXY_PORTS)).join(listed, "ip", "left_semi").agg(F.countDistinct("ip").alias("ips"))


# --- windows, ranking, set operations --------------------------------------------------------------------------------


@query("w1_share_within_type", "SELECT device_type, query_category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY device_type), 2) AS share FROM devices GROUP BY device_type, query_category")
def w1(t: Tables) -> DataFrame:
    return share_of(counted(t.devices, "device_type", "query_category"), "n", ["device_type"])


@query("w3_first_per_key", "SELECT source, ip, port, raw_banner FROM (SELECT *, row_number() OVER (PARTITION BY source, ip, port ORDER BY seq) AS rn FROM devices) WHERE rn = 1")
def w3(t: Tables) -> DataFrame:
    return first_of(t.devices, ["source", "ip", "port"], "seq").select("source", "ip", "port", "raw_banner")


@query("w4_last_per_key", "SELECT ip, port, raw_banner FROM (SELECT *, row_number() OVER (PARTITION BY ip, port ORDER BY seq DESC) AS rn FROM devices) WHERE rn = 1")
def w4(t: Tables) -> DataFrame:
    return first_of(t.devices, ["ip", "port"], "seq", last=True).select("ip", "port", "raw_banner")


@query("w5_ips_per_asn", "SELECT asn, ip, rn AS rank FROM (SELECT asn, ip, row_number() OVER (PARTITION BY asn ORDER BY n DESC, ip) AS rn FROM (SELECT asn, ip, count(*) AS n FROM devices GROUP BY asn, ip)) WHERE rn <= 5")
def w5(t: Tables) -> DataFrame:
    return top_per_group(counted(t.devices, "asn", "ip"), ["asn"], "n", ["ip"], 5).select("asn", "ip", "rank")


@query("w6_daily_growth", "SELECT honeypot, day, n, round(100.0 * (n - lag(n) OVER w) / nullif(lag(n) OVER w, 0), 1) AS growth_pct FROM (SELECT honeypot, day, count(*) AS n FROM attacks GROUP BY ALL) WINDOW w AS (PARTITION BY honeypot ORDER BY day)")
def w6(t: Tables) -> DataFrame:
    return activity.growth(counted(t.attacks, "honeypot", "day"), ["honeypot"], "day", "n")


@query("w7_concentration", "SELECT source_ip, n, row_number() OVER w AS rank, round(100.0 * sum(n) OVER (ORDER BY n DESC, source_ip ROWS UNBOUNDED PRECEDING) / total, 2) AS cumulative_pct FROM (SELECT *, sum(n) OVER () AS total FROM (SELECT source_ip, count(*) AS n FROM attacks GROUP BY 1)) WINDOW w AS (ORDER BY n DESC, source_ip) ORDER BY rank LIMIT 10")
def w7(t: Tables) -> DataFrame:
    return scoring.concentration(counted(t.attacks, "source_ip"), "n", "source_ip", 10)


@query("t5_capped_per_query", "SELECT query_category, ip, rn AS rank FROM (SELECT query_category, ip, row_number() OVER (PARTITION BY query_category ORDER BY n DESC, ip) AS rn FROM (SELECT query_category, ip, count(*) AS n FROM devices GROUP BY ALL)) WHERE rn <= 100")
def t5(t: Tables) -> DataFrame:
    return top_per_group(counted(t.devices, "query_category", "ip"), ["query_category"], "n", ["ip"], 100).select("query_category", "ip", "rank")


@query("o1_new_this_week", "SELECT source_ip FROM attacks WHERE dest_port = 23 AND day BETWEEN DATE '2024-01-20' AND DATE '2024-01-20' EXCEPT SELECT source_ip FROM attacks WHERE dest_port = 23 AND day BETWEEN DATE '2024-01-17' AND DATE '2024-01-19'")
def o1(t: Tables) -> DataFrame:
    on = lambda a, b: t.attacks.filter("dest_port = 23").filter(F.col("day").between(F.lit(a).cast("date"), F.lit(b).cast("date"))).select("source_ip")
    return on("2024-01-20", "2024-01-20").subtract(on("2024-01-17", "2024-01-19"))


@query("o2_both_protocols", "SELECT source_ip FROM attacks WHERE protocol = 'ssh' INTERSECT SELECT source_ip FROM attacks WHERE protocol = 'telnet'")
def o2(t: Tables) -> DataFrame:
    return t.attacks.filter("protocol = 'ssh'").select("source_ip").intersect(t.attacks.filter("protocol = 'telnet'").select("source_ip"))


@query("x13_networks", "SELECT concat(array_to_string(string_split(source_ip, '.')[1:3], '.'), '.0/24') AS net, count(DISTINCT source_ip) AS ips, min(CAST(string_split(source_ip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(source_ip, '.')[2] AS BIGINT) * 65536 + CAST(string_split(source_ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(source_ip, '.')[4] AS BIGINT)) AS low FROM attacks GROUP BY 1")
def x13(t: Tables) -> DataFrame:
    return t.attacks.withColumn("ip", canonical_ip(F.concat("source_ip", F.lit("/32")))).groupBy(net24("ip").alias("net")).agg(F.countDistinct("ip").alias("ips"), F.min(ip_to_long("ip")).alias("low"))


@query("x23_pseudonyms", "SELECT sha256(concat('salt', source_ip)) AS id, count(*) AS n FROM attacks GROUP BY 1")
def x23(t: Tables) -> DataFrame:
    return counted(t.attacks.withColumn("id", pseudonymous_ip("source_ip", "salt")), "id")


@query("f1_public_share", "SELECT count(*) FILTER (NOT starts_with(source_ip, '10.')) AS public, count(*) AS n FROM attacks")
def f1(t: Tables) -> DataFrame:
    return t.attacks.agg(F.count_if(~is_private_ip("source_ip")).alias("public"), F.count("*").alias("n"))


# --- scores and longitudinal -----------------------------------------------------------------------------------------


@query("l1_risk_scores", """
SELECT ip, score, CASE WHEN score > 0.60 THEN 'high' WHEN score >= 0.30 THEN 'medium' ELSE 'low' END AS tier FROM (
    SELECT ip, round((count(DISTINCT CASE WHEN port IN (1080, 3128, 8080, 8888) THEN port END) / 4.0::DOUBLE + CAST(bool_or(port IN (23, 2323, 7547)) AS INT)
        + max(CASE WHEN device_type IN ('camera', 'router', 'iot') THEN 1.0 WHEN device_type = 'proxy' THEN 0.8 WHEN device_type = 'server' THEN 0.3 ELSE 0.1 END)::DOUBLE + least(count(DISTINCT port) / 5.0::DOUBLE, 1.0) + 0.2::DOUBLE) / 5, 4) AS score FROM devices GROUP BY ip)""")
def l1(t: Tables) -> DataFrame:
    return scoring.risk_score(t.devices)


_S, _B, _W = "device_type = 'proxy' AND port IN (1080, 3128)", "device_type = 'proxy'", "port IN (1080, 3128, 8080, 8888)"
_A = f"({_B}) OR ({_W}) OR protocol IN ('socks5-proxy', 'socks4-proxy', 'http-connect')"


@query("l2_proxy_sensitivity", "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER ({c}) AS {k}, round(100.0 * count(*) FILTER ({c}) / count(*), 2) AS {k}_pct" for k, c in (("strict", _S), ("banner", _B), ("broad", _W), ("broadest", _A))) + " FROM devices")
def l2(t: Tables) -> DataFrame:
    return scoring.proxy_sensitivity(t.devices)


@query("l3_exposure_counts", "SELECT count(*) FILTER (port IN (1080, 3128, 8080, 8888)) AS proxy, count(*) FILTER (port IN (25, 465, 587)) AS smtp, count(*) FILTER (port IN (48101, 6667, 7547)) AS c2 FROM devices")
def l3(t: Tables) -> DataFrame:
    return scoring.exposure_counts(t.devices)


@query("l4_weekly_churn", """
WITH d AS (SELECT DISTINCT source_ip, day FROM attacks), n AS (SELECT * FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.source_ip = a.source_ip AND b.day < a.day AND b.day >= a.day - 7)),
act AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week_start, count(DISTINCT source_ip) AS active_ips FROM d GROUP BY 1), fresh AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week_start, count(DISTINCT source_ip) AS new_ips FROM n GROUP BY 1)
SELECT week_start, active_ips, new_ips, round(100.0 * new_ips / nullif(active_ips, 0), 1) AS churn_pct FROM act JOIN fresh USING (week_start)""")
def l4(t: Tables) -> DataFrame:
    return activity.weekly_churn(t.attacks)


@query("l5_weekly_volume", "SELECT CAST(date_trunc('week', day) AS DATE) AS week_start, count(*) AS events, count(DISTINCT source_ip) AS ips FROM attacks GROUP BY 1")
def l5(t: Tables) -> DataFrame:
    return t.attacks.groupBy(monday("day").alias("week_start")).agg(F.count("*").alias("events"), F.countDistinct("source_ip").alias("ips"))


@query("l6_persistence", "SELECT days, count(*) AS ips FROM (SELECT source_ip, count(DISTINCT day) AS days FROM attacks GROUP BY 1) GROUP BY days")
def l6(t: Tables) -> DataFrame:
    return activity.lifetimes(t.attacks).groupBy(F.col("active_days").alias("days")).agg(F.count("*").alias("ips"))


_LIVES = "SELECT source_ip, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS active_days, date_diff('day', min(day), max(day)) AS lifetime_days FROM attacks GROUP BY source_ip"


@query("l9_lifetime_classes", f"SELECT CASE WHEN lifetime_days > 14 THEN 'persistent' WHEN lifetime_days > 3 THEN 'intermittent' ELSE 'transient' END AS lifetime_class, count(*) AS ips, avg(active_days) AS mean_days FROM ({_LIVES}) GROUP BY 1")
def l9(t: Tables) -> DataFrame:
    return activity.lifetimes(t.attacks).groupBy("lifetime_class").agg(F.count("*").alias("ips"), F.avg("active_days").alias("mean_days"))


@query("l8_persistent_actors", f"SELECT source_ip, lifetime_days FROM ({_LIVES}) WHERE lifetime_days > 7")
def l8(t: Tables) -> DataFrame:
    return activity.lifetimes(t.attacks).filter("lifetime_days > 7").select("source_ip", F.col("lifetime_days").cast("long").alias("lifetime_days"))


@query("l10_survival", f"""
WITH lives AS ({_LIVES}), by_t AS (SELECT lifetime_days AS t, count(*) FILTER (last_day < (SELECT max(day) FROM attacks)) AS ended, count(*) AS n FROM lives GROUP BY 1),
risk AS (SELECT t, ended, sum(n) OVER (ORDER BY t DESC) AS at_risk FROM by_t), steps AS (SELECT * FROM risk WHERE ended > 0)
SELECT CAST(t AS INT) AS t, CAST(at_risk AS BIGINT) AS at_risk, ended, CASE WHEN max(CAST(ended >= at_risk AS INT)) OVER w = 1 THEN 0.0::DOUBLE ELSE exp(sum(CASE WHEN ended < at_risk THEN ln(1 - ended / at_risk::DOUBLE) END) OVER w) END AS survival FROM steps WINDOW w AS (ORDER BY t)""")
def l10(t: Tables) -> DataFrame:
    return activity.survival_curve(t.attacks)


@query("l10_return_gaps", "SELECT gap, count(*) AS n FROM (SELECT date_diff('day', lag(day) OVER (PARTITION BY source_ip ORDER BY day), day) AS gap FROM (SELECT DISTINCT source_ip, day FROM attacks)) WHERE gap IS NOT NULL GROUP BY gap")
def l10b(t: Tables) -> DataFrame:
    return activity.return_gaps(t.attacks).withColumn("gap", F.col("gap").cast("long"))


@query("l11_device_persistence", f"SELECT ip, count(DISTINCT snapshot_week) AS weeks, min(snapshot_week) AS first_week, max(snapshot_week) AS last_week, count(DISTINCT CASE WHEN {_PROXY} THEN snapshot_week END) AS proxy_weeks FROM devices GROUP BY ip")
def l11(t: Tables) -> DataFrame:
    proxy = F.when(F.col("port").isin(*PROXY_PORTS), F.col("snapshot_week"))
    return t.devices.groupBy("ip").agg(F.countDistinct("snapshot_week").alias("weeks"), F.min("snapshot_week").alias("first_week"), F.max("snapshot_week").alias("last_week"), F.count_distinct(proxy).alias("proxy_weeks"))


@query("l12_proxies_per_week", f"SELECT snapshot_week, count(DISTINCT ip) AS ips FROM devices WHERE {_PROXY} GROUP BY snapshot_week")
def l12(t: Tables) -> DataFrame:
    return t.devices.filter(F.col("port").isin(*PROXY_PORTS)).groupBy("snapshot_week").agg(F.countDistinct("ip").alias("ips"))


@query("l13_co_exposure", f"SELECT count(*) FILTER (infected) AS infected, count(*) FILTER (infected AND proxy) AS infected_proxies, count(*) FILTER (proxy AND NOT infected) AS other_proxies, count(*) AS ips FROM (SELECT ip, bool_or(query_category = 'malware') AS infected, bool_or({_PROXY}) AS proxy FROM devices GROUP BY ip)")
def l13(t: Tables) -> DataFrame:
    ip = t.devices.groupBy("ip").agg(F.bool_or(F.col("query_category") == "malware").alias("i"), F.bool_or(F.col("port").isin(*PROXY_PORTS)).alias("p"))
    return ip.agg(F.count_if("i").alias("infected"), F.count_if(F.col("i") & F.col("p")).alias("infected_proxies"), F.count_if(F.col("p") & ~F.col("i")).alias("other_proxies"), F.count("*").alias("ips"))


@query("l14_asn_reputation", f"SELECT asn, count(DISTINCT ip) AS ips, round(100.0 * count(DISTINCT CASE WHEN device_type = 'iot' THEN ip END) / count(DISTINCT ip), 1) AS iot_pct, round(100.0 * count(DISTINCT CASE WHEN {_PROXY} THEN ip END) / count(DISTINCT ip), 1) AS proxy_pct FROM devices GROUP BY asn")
def l14(t: Tables) -> DataFrame:
    from telemill.functions.exprs import safe_share

    of = lambda c: F.count_distinct(F.when(c, F.col("ip")))
    return t.devices.groupBy("asn").agg(F.countDistinct("ip").alias("ips"), safe_share(of(F.col("device_type") == "iot"), F.countDistinct("ip")).alias("iot_pct"), safe_share(of(F.col("port").isin(*PROXY_PORTS)), F.countDistinct("ip")).alias("proxy_pct"))


@query("l15_ip_features", """
SELECT d.*, coalesce(e.attacks, 0) AS attacks, coalesce(e.kinds, 0) AS kinds FROM (SELECT ip, count(DISTINCT port) AS ports, count(DISTINCT snapshot_week) AS weeks, max(CAST(port IN (1080, 3128, 8080, 8888) AS INT)) AS proxy, max(CAST(device_type = 'iot' AS INT)) AS iot FROM devices GROUP BY ip) d
LEFT JOIN (SELECT source_ip AS ip, count(*) AS attacks, count(DISTINCT event_type) AS kinds FROM attacks GROUP BY 1) e ON e.ip = d.ip""")
def l15(t: Tables) -> DataFrame:
    return scoring.ip_features(t.attacks, t.devices)


@query("l16_risk_model")
def l16(t: Tables) -> DataFrame:
    f = scoring.ip_features(t.attacks, t.devices).withColumn("attacker", (F.col("attacks") > 0).cast("int"))
    f = store(f, "features")  # scaling, fit and evaluation read them again and again
    columns = ["ports", "weeks", "proxy", "iot"]
    model, auc = scoring.risk_model(f, "attacker", columns)
    weights = model.stages[-1].coefficients.toArray().tolist()
    return t.spark.createDataFrame(list(zip([*columns, "auc"], [*weights, auc], strict=True)), "name string, value double")


@query("l17_linkage_bundle", _USED + f"""
, act AS (SELECT source_ip, min(event_time) AS a, max(event_time) AS b FROM attacks GROUP BY 1)
SELECT (SELECT count(DISTINCT source_ip) FROM attacks WHERE source_ip IN (SELECT ip FROM devices)) AS scanned_attackers, (SELECT count(DISTINCT source_ip) FROM attacks WHERE source_ip IN (SELECT ip FROM feeds)) AS listed_attackers,
    (SELECT count(DISTINCT a.source_ip) FROM used a WHERE EXISTS (SELECT 1 FROM used b WHERE a.username = b.username AND a.password = b.password AND a.source_ip <> b.source_ip)) AS sharing_attackers,
    (SELECT count(DISTINCT hassh) FROM attacks) AS fingerprints, (SELECT count(*) FROM act WHERE b - a > INTERVAL 7 DAYS) AS persistent, (SELECT count(DISTINCT ip) FROM devices WHERE {_PROXY} AND ip IN (SELECT source_ip FROM attacks)) AS proxy_attackers""")
def l17(t: Tables) -> DataFrame:
    ips, devices = t.attacks.select(F.col("source_ip").alias("ip")).distinct(), t.devices.select("ip", "port").distinct()
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        n(ips.join(devices, "ip", "left_semi"), "scanned_attackers"), n(ips.join(t.feeds, "ip", "left_semi"), "listed_attackers"), n(linkage.sharing_attackers(t.attacks), "sharing_attackers"),
        t.attacks.agg(F.countDistinct("hassh").alias("fingerprints")),
        n(t.attacks.groupBy("source_ip").agg((F.max("event_time") - F.min("event_time")).alias("span")).filter(F.col("span") > F.expr("INTERVAL 7 DAYS")), "persistent"),
        n(devices.filter(F.col("port").isin(*PROXY_PORTS)).select("ip").distinct().join(ips, "ip", "left_semi"), "proxy_attackers"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@query("l18_readiness", "SELECT 'events' AS metric, count(*) >= 1000 AS passed FROM attacks UNION ALL SELECT 'attackers', count(DISTINCT source_ip) >= 100 FROM attacks UNION ALL SELECT 'devices', count(*) >= 10000 FROM devices UNION ALL SELECT 'feeds', count(DISTINCT source) >= 3 FROM feeds UNION ALL SELECT 'weeks', count(DISTINCT snapshot_week) >= 4 FROM devices")
def l18(t: Tables) -> DataFrame:
    metrics = [("events", t.attacks.agg(F.count("*").alias("v")), 1000), ("attackers", t.attacks.agg(F.countDistinct("source_ip").alias("v")), 100), ("devices", t.devices.agg(F.count("*").alias("v")), 10000), ("feeds", t.feeds.agg(F.countDistinct("source").alias("v")), 3), ("weeks", t.devices.agg(F.countDistinct("snapshot_week").alias("v")), 4)]
    rows = [df.select(F.lit(name).alias("metric"), (F.col("v") >= least).alias("passed")) for name, df, least in metrics]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("l19_source_ablation", "SELECT count(DISTINCT CASE WHEN source = 'shodan' THEN ip END) AS first_only, count(DISTINCT ip) AS both_sources, (SELECT count(*) FROM (SELECT ip FROM devices UNION SELECT source_ip FROM attacks)) AS with_attacks FROM devices")
def l19(t: Tables) -> DataFrame:
    seen = t.devices.select("ip", F.when(F.col("source") == "shodan", 0).otherwise(1).alias("k")).unionByName(t.attacks.select(F.col("source_ip").alias("ip"), F.lit(2).alias("k")))
    ip = seen.groupBy("ip").agg(F.min("k").alias("k"))
    return ip.agg(F.count_if(F.col("k") == 0).alias("first_only"), F.count_if(F.col("k") < 2).alias("both_sources"), F.count("*").alias("with_attacks"))


@query("l20_compromise_lag", f"SELECT min(lag_days) AS least, max(lag_days) AS most, avg(lag_days) AS mean, count(*) AS ips FROM ({_LATER})")
def l20(t: Tables) -> DataFrame:
    early = t.attacks.withColumn("event_time", F.date_sub(F.to_date("event_time"), 8766))
    lag = linkage.first_exposure_after(early, t.devices).select(F.col("lag_days").cast("long").alias("d"))
    return lag.agg(F.min("d").alias("least"), F.max("d").alias("most"), F.avg("d").alias("mean"), F.count("*").alias("ips"))


@query("l21_snapshot_growth", "SELECT snapshot_week, n, ips, round(100.0 * (n - lag(n) OVER (ORDER BY snapshot_week)) / nullif(lag(n) OVER (ORDER BY snapshot_week), 0), 1) AS growth_pct FROM (SELECT snapshot_week, count(*) AS n, count(DISTINCT ip) AS ips FROM devices GROUP BY 1)")
def l21(t: Tables) -> DataFrame:
    return activity.growth(t.devices.groupBy("snapshot_week").agg(F.count("*").alias("n"), F.countDistinct("ip").alias("ips")), [], "snapshot_week", "n")


@query("l22_command_prevalence", "SELECT command_str, count(*) AS n, count(DISTINCT source_ip) AS ips FROM attacks WHERE command_str ILIKE '%wget%' OR command_str ILIKE '%busybox%' OR command_str ILIKE '%CHMOD%' GROUP BY command_str HAVING count(DISTINCT source_ip) > 10")
def l22(t: Tables) -> DataFrame:
    return t.attacks.filter("command_str ILIKE ANY ('%wget%', '%busybox%', '%CHMOD%')").groupBy("command_str").agg(F.count("*").alias("n"), F.countDistinct("source_ip").alias("ips")).filter("ips > 10")


_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(command_str, '{p}') THEN '{k}'" for k, p in scoring.COMMAND_FAMILIES.items()) + " ELSE 'other' END"


@query("l23_command_families", f"SELECT CAST(date_trunc('week', day) AS DATE) AS week_start, {_FAMILY} AS family, count(*) AS n FROM attacks WHERE command_str IS NOT NULL GROUP BY ALL")
def l23(t: Tables) -> DataFrame:
    rows = t.attacks.filter("command_str IS NOT NULL").withColumn("family", scoring.command_family(F.col("command_str")))
    return rows.groupBy(monday("day").alias("week_start"), "family").agg(F.count("*").alias("n"))


@query("l23_command_chains", f"""
WITH c AS (SELECT *, lag(event_time) OVER w AS before FROM attacks WHERE command_str IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY event_time, record_id)),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR event_time - before >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_time, record_id) AS run FROM c),
p AS (SELECT *, (row_number() OVER (PARTITION BY session_id, run ORDER BY event_time, record_id) - 1) // 1000 AS piece FROM r)
SELECT chain, count(*) AS sessions FROM (SELECT string_agg({_FAMILY}, '>' ORDER BY event_time, record_id) AS chain FROM p GROUP BY session_id, run, piece) GROUP BY chain""")
def l23b(t: Tables) -> DataFrame:
    return scoring.command_chains(t.attacks)


@query("l23_roles", f"SELECT role, count(*) AS ips FROM (SELECT source_ip, CASE WHEN count(*) FILTER (regexp_matches(command_str, '{scoring.COMMAND_FAMILIES['downloader']}') OR download_url IS NOT NULL) > 0 THEN 'loader' WHEN count(command_str) > 0 THEN 'intruder' WHEN count(*) FILTER (event_type LIKE 'login%') > 0 THEN 'guesser' ELSE 'scanner' END AS role FROM attacks GROUP BY 1) GROUP BY role")
def l23c(t: Tables) -> DataFrame:
    return scoring.role_labels(t.attacks).groupBy("role").agg(F.count("*").alias("ips"))


@query("l24_brute_force", "SELECT source_ip, count(*) AS attempts, count(DISTINCT dest_port) AS ports FROM attacks WHERE event_type LIKE 'login%' GROUP BY 1 HAVING count(*) > 20")
def l24(t: Tables) -> DataFrame:
    return scoring.brute_force(t.attacks, 20)


@query("l25_signal_seeds", "SELECT signal, count(DISTINCT ip) AS devices, count(DISTINCT org) AS orgs, count(DISTINCT asn) AS asns FROM (SELECT *, unnest(string_split(query_list, ',')) AS signal FROM devices) GROUP BY signal")
def l25(t: Tables) -> DataFrame:
    return t.devices.select("ip", "org", "asn", F.explode(F.split("query_list", ",")).alias("signal")).groupBy("signal").agg(F.countDistinct("ip").alias("devices"), F.countDistinct("org").alias("orgs"), F.countDistinct("asn").alias("asns"))


@query("l26_top_networks", "SELECT concat(array_to_string(string_split(source_ip, '.')[1:3], '.'), '.0/24') AS net, count(*) AS n, count(DISTINCT source_ip) AS ips FROM attacks GROUP BY 1 ORDER BY n DESC, net LIMIT 20")
def l26(t: Tables) -> DataFrame:
    return t.attacks.groupBy(net24("source_ip").alias("net")).agg(F.count("*").alias("n"), F.countDistinct("source_ip").alias("ips")).orderBy(F.desc("n"), "net").limit(20)


@query("l27_both_ports", "SELECT ip FROM devices GROUP BY ip HAVING bool_or(port = 23) AND bool_or(port = 7547)")
def l27(t: Tables) -> DataFrame:
    ports = t.devices.groupBy("ip").agg(F.collect_set("port").alias("p"))
    return ports.filter(F.array_contains("p", 23) & F.array_contains("p", 7547)).select("ip")


@query("l28_cloud_share", f"SELECT round(100.0 * count(DISTINCT CASE WHEN tag_list LIKE '%cloud%' THEN ip END) / count(DISTINCT ip), 1) AS cloud_pct FROM devices WHERE {_PROXY}")
def l28(t: Tables) -> DataFrame:
    from telemill.functions.exprs import safe_share

    cloud = F.when(F.array_contains(F.split("tag_list", ","), "cloud"), F.col("ip"))
    return t.devices.filter(F.col("port").isin(*PROXY_PORTS)).agg(safe_share(F.count_distinct(cloud), F.countDistinct("ip")).alias("cloud_pct"))


@query("l29_parity", "SELECT honeypot, count(*) AS raw, count(DISTINCT record_id) AS stored, count(*) - count(DISTINCT record_id) AS lost FROM attacks GROUP BY honeypot")
def l29(t: Tables) -> DataFrame:
    rows = t.attacks.groupBy("honeypot").agg(F.count("*").alias("raw"), F.countDistinct("record_id").alias("stored"))
    return rows.withColumn("lost", F.col("raw") - F.col("stored"))


# --- graph -----------------------------------------------------------------------------------------------------------

_SIGNALS = "WITH s AS (SELECT DISTINCT source_ip, download_url, file_hash, hassh FROM attacks WHERE coalesce(download_url, file_hash, hassh) IS NOT NULL), "
_EDGES = _SIGNALS + """edges AS (
    SELECT source_ip AS src, download_url AS dst, 'downloads_from' AS edge_type, CAST(count(*) AS DOUBLE) AS weight FROM s WHERE download_url IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT DISTINCT download_url, file_hash, 'hosts_malware', 1.0::DOUBLE FROM s WHERE download_url IS NOT NULL AND file_hash IS NOT NULL
    UNION ALL SELECT source_ip, hassh, 'uses_fingerprint', CAST(count(*) AS DOUBLE) FROM s WHERE hassh IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT DISTINCT source_ip, concat_ws(':', 'cred', username, password), 'uses_credential', 1.0::DOUBLE FROM attacks WHERE username <> '' AND password <> ''
)"""


@query("g2_edges", _EDGES + " SELECT * FROM edges")
def g2(t: Tables) -> DataFrame:
    return graph.graph_edges(t.attacks)


@query("g5_asn_edges", "SELECT a.ip AS src, b.ip AS dst, 'shares_asn' AS edge_type, 0.5::DOUBLE AS weight FROM (SELECT asn, ip, row_number() OVER (PARTITION BY asn ORDER BY ip) AS rn FROM (SELECT DISTINCT asn, ip FROM devices)) a JOIN (SELECT asn, ip, row_number() OVER (PARTITION BY asn ORDER BY ip) AS rn FROM (SELECT DISTINCT asn, ip FROM devices)) b ON a.asn = b.asn AND a.rn < b.rn WHERE b.rn <= 5 GROUP BY ALL")
def g5(t: Tables) -> DataFrame:
    return graph.asn_edges(t.devices)


@query("g7_nodes", _EDGES + " SELECT node_type, count(*) AS n FROM (SELECT DISTINCT src AS v, CASE edge_type WHEN 'hosts_malware' THEN 'url' ELSE 'ip' END AS node_type FROM edges UNION SELECT DISTINCT dst, CASE edge_type WHEN 'downloads_from' THEN 'url' WHEN 'hosts_malware' THEN 'hash' WHEN 'uses_fingerprint' THEN 'hassh' ELSE 'credential' END FROM edges) GROUP BY node_type")
def g7(t: Tables) -> DataFrame:
    return counted(graph.graph_nodes(graph.graph_edges(t.attacks)), "node_type")


@query("g9_degrees", _EDGES + " SELECT node, sum(o) AS degree_out, sum(i) AS degree_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node")
def g9(t: Tables) -> DataFrame:
    return graph.degrees(graph.graph_edges(t.attacks))


@query("g13_edge_types", _EDGES + " SELECT edge_type, count(*) AS n, sum(weight) AS weight FROM edges GROUP BY edge_type")
def g13(t: Tables) -> DataFrame:
    return graph.graph_edges(t.attacks).groupBy("edge_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("g12_component_sizes", """
WITH RECURSIVE e AS (SELECT DISTINCT asn, ip FROM devices WHERE ip IN (SELECT source_ip FROM attacks)), p AS (SELECT a.ip AS x, b.ip AS y FROM e a JOIN e b ON a.asn = b.asn), reach AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x)
SELECT size, count(*) AS n FROM (SELECT low, count(*) AS size FROM (SELECT x, min(y) AS low FROM reach GROUP BY x) GROUP BY low) GROUP BY size""")
def g12(t: Tables) -> DataFrame:
    e = t.devices.join(t.attacks.select(F.col("source_ip").alias("ip")).distinct(), "ip", "left_semi").select(F.col("ip").alias("src"), F.concat(F.lit("asn"), F.col("asn").cast("string")).alias("dst")).distinct()
    size = graph.components(e).filter(~F.col("node").startswith("asn")).groupBy("component").agg(F.count("*").alias("size"))
    return size.groupBy("size").agg(F.count("*").alias("n"))


def _members(t: Tables) -> DataFrame:
    """Clusters of attackers by the fingerprint they use most, as a stand-in with a SQL twin."""
    return t.attacks.filter("hassh IS NOT NULL").groupBy("source_ip").agg(F.mode("hassh", True).alias("cluster"))


_MEMBERS = "WITH m AS (SELECT source_ip, cluster FROM (SELECT source_ip, hassh AS cluster, row_number() OVER (PARTITION BY source_ip ORDER BY count(*) DESC, hassh) AS rn FROM attacks WHERE hassh IS NOT NULL GROUP BY 1, 2) WHERE rn = 1), e AS (SELECT a.*, m.cluster FROM attacks a JOIN m ON a.source_ip = m.source_ip), "


@query("g10_campaigns", _MEMBERS + """
leaf AS (SELECT cluster, substring(sha256(source_ip), 1, 4) AS place, sha256(string_agg(sha256(source_ip), '' ORDER BY sha256(source_ip))) AS digest, count(*) AS n FROM m GROUP BY 1, 2),
branch AS (SELECT cluster, substring(place, 1, 2) AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest, sum(n) AS n FROM leaf GROUP BY 1, 2),
ids AS (SELECT cluster, substring(sha256(string_agg(digest, '' ORDER BY place)), 1, 16) AS cluster_id, sum(n) AS source_ip_count FROM branch GROUP BY cluster),
c AS (SELECT cluster, concat_ws(':', username, password) AS cred, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, concat_ws(':', username, password) DESC) AS rn FROM e WHERE username <> '' AND password <> '' GROUP BY 1, 2),
p AS (SELECT cluster, protocol FROM (SELECT cluster, protocol, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, protocol) AS rn FROM e GROUP BY 1, 2) WHERE rn = 1)
SELECT ids.cluster_id, ids.source_ip_count, (SELECT count(*) FROM e WHERE e.cluster = ids.cluster) AS event_count, p.protocol AS primary_protocol, (SELECT string_agg(cred, ',' ORDER BY rn) FROM c WHERE rn <= 3 AND c.cluster = ids.cluster) AS creds FROM ids JOIN p ON p.cluster = ids.cluster""")
def g10(t: Tables) -> DataFrame:
    return graph.campaigns(_members(t), t.attacks).select("cluster_id", "source_ip_count", "event_count", "primary_protocol", F.array_join("primary_creds", ",").alias("creds"))


@query("g14_behaviour", _MEMBERS.rstrip(", ") + " SELECT cluster, count(DISTINCT dest_port) AS ports, count(DISTINCT (username, password)) FILTER (username IS NOT NULL) AS creds, count(*) FILTER (regexp_matches(command_str, 'wget|curl|tftp')) AS download_commands, count(*) FILTER (event_type LIKE 'login%') AS logins, CASE WHEN count(*) FILTER (regexp_matches(command_str, 'wget|curl|tftp')) > 0 THEN 'botnet_loader' WHEN count(*) FILTER (event_type LIKE 'login%') > 100 THEN 'brute_force' WHEN count(DISTINCT dest_port) > 5 THEN 'scanner' ELSE 'other' END AS behaviour FROM e GROUP BY cluster")
def g14(t: Tables) -> DataFrame:
    return graph.behaviour_profile(_members(t), t.attacks)


@query("g8_communities")
def g8(t: Tables) -> DataFrame:
    return graph.communities(graph.graph_edges(t.attacks)).groupBy("label").agg(F.count("*").alias("nodes"))


@query("a6_c2_lists", _IOCS + """
, best AS (SELECT * FROM merged WHERE ioc_type IN ('ip', 'domain') ORDER BY occurrence_count DESC, ioc_type, ioc_value LIMIT 20)
SELECT (SELECT string_agg(ioc_value, ',' ORDER BY occurrence_count DESC, ioc_value) FROM (SELECT * FROM best WHERE ioc_type = 'ip' ORDER BY occurrence_count DESC, ioc_value LIMIT 10)) AS c2_ips,
    (SELECT string_agg(ioc_value, ',' ORDER BY occurrence_count DESC, ioc_value) FROM (SELECT * FROM best WHERE ioc_type = 'domain' ORDER BY occurrence_count DESC, ioc_value LIMIT 10)) AS c2_domains""")
def a6(t: Tables) -> DataFrame:
    one = graph.c2_lists(merged_iocs(extract_iocs(t.attacks)))
    none = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return one.select(none("c2_ips").alias("c2_ips"), none("c2_domains").alias("c2_domains"))


@query("x11_asn_numbers", "SELECT asn, count(*) AS n FROM devices GROUP BY asn")
def x11(t: Tables) -> DataFrame:
    return counted(t.devices.withColumn("asn", asn_number(F.concat(F.lit("AS"), F.col("asn").cast("string")))), "asn")


@query("st2_burst_dedup", "SELECT source_ip, dest_port, count(*) AS kept FROM (SELECT source_ip, dest_port, event_time, lag(event_time) OVER (PARTITION BY source_ip, dest_port ORDER BY event_time, record_id) AS before FROM attacks) WHERE before IS NULL OR event_time - before > INTERVAL 6 HOURS GROUP BY ALL")
def st2(t: Tables) -> DataFrame:
    w = Window.partitionBy("source_ip", "dest_port").orderBy("event_time", "record_id")
    rows = t.attacks.withColumn("before", F.lag("event_time").over(w)).filter(F.col("before").isNull() | (F.col("event_time") - F.col("before") > F.expr("INTERVAL 6 HOURS")))
    return rows.groupBy("source_ip", "dest_port").agg(F.count("*").alias("kept"))
