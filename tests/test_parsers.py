"""Sensor lines, hosts and feed records, by case."""

import json

import pytest
from pyspark.sql import functions as F

from telemill import schemas
from telemill.operators import normalize
from telemill.sources import logs


def lines(spark, docs):
    rows = [("f", k + 1, d if isinstance(d, str) else json.dumps(d)) for k, d in enumerate(docs)]
    return spark.createDataFrame(rows, "file_path string, line_number int, value string").withColumn("collected_at", F.lit("2026-01-01").cast("timestamp"))


def parsed(spark, docs, schema, parser):
    good, bad = logs.parse_json_lines(lines(spark, docs), schema)
    return parser(good).orderBy("raw_line_number").collect(), bad.count()


def ssh(**x):
    return {"eventid": "cowrie.login.failed", "timestamp": "2026-04-23T20:16:52.506110Z", "src_ip": "203.0.113.9", "src_port": 4000, "session": "s1", "username": "root", "password": "x"} | x


def test_ssh_events(spark):
    docs = [ssh(), ssh(dst_port=23), ssh(eventid="other.login"), "{broken", ssh(eventid="cowrie.command.input", input="uname -a"), ssh(eventid="cowrie.session.file_download", url="http://a.example/x", shasum="a" * 64), ssh(eventid="cowrie.client.kex", hassh="", hasshAlgorithms="h2"), {"no": 1}]
    rows, bad = parsed(spark, docs, schemas.SSH_LINE, normalize.ssh_events)
    assert bad == 1 and [r.event_type for r in rows] == ["login.failed", "login.failed", "command.input", "session.file_download", "client.kex"]
    assert (rows[0].protocol, rows[0].dest_port, rows[0].username) == ("ssh", 22, "root") and rows[1].protocol == "telnet"
    assert rows[2].command_str == "uname -a" and rows[2].username is None and rows[3].file_hash == "a" * 64 and rows[4].hassh == "h2"
    assert rows[0].event_time.microsecond == 506110


def test_rerun_gives_the_same_ids(spark):
    again = [parsed(spark, [ssh(), ssh()], schemas.SSH_LINE, normalize.ssh_events)[0] for _ in range(2)]
    assert [r.record_id for r in again[0]] == [r.record_id for r in again[1]] and len({r.record_id for r in again[0]}) == 2


def canary(**x):
    return {"logtype": 2000, "local_time": "2026-04-23 20:16:52.506110", "src_host": "203.0.113.9", "src_port": 4000, "dst_port": 21, "logdata": {"USERNAME": "u", "PASSWORD": "p"}} | x


def test_canary_events(spark):
    docs = [canary(), canary(logtype=1001), canary(logtype=3000, logdata={"path": "/a", "HEADERS": {"User-Agent": "x/1"}}), canary(logtype=17000, src_host="", src_port=-1), canary(logtype=99, logdata={}), canary(logtype=4000, logdata={"USERNAME": "", "username": "low"})]
    rows, _ = parsed(spark, docs, schemas.CANARY_LINE, normalize.canary_events)
    assert [(r.protocol, r.event_type) for r in rows] == [("ftp", "login.attempt"), ("http", "http.request"), ("portscan", "port_scan"), ("unknown_99", "connection"), ("ssh", "login.attempt")]
    assert (rows[1].http_path, rows[1].user_agent) == ("/a", "x/1") and rows[2].source_ip is None and rows[2].source_port is None and rows[4].username == "low"


@pytest.mark.parametrize(("port", "protocol"), [("7547", "tr069"), ("5555", "adb"), ("9", "tcp")])
def test_tcp_events(spark, port, protocol):
    doc = {"time": "2026-04-23T20:16:52.506110092Z", "msg": "packet got handled", "dest_port": port, "src_port": "x", "src_ip": "203.0.113.9", "payload_hash": "b" * 64}
    rows, _ = parsed(spark, [doc, doc | {"msg": "Startup"}, doc | {"payload_hash": "b"}], schemas.TCP_LINE, normalize.tcp_events)
    assert len(rows) == 2 and rows[0].protocol == protocol and rows[0].dest_port == int(port) and rows[0].source_port is None
    assert rows[0].file_hash == "b" * 64 and rows[1].file_hash is None and rows[0].event_time.microsecond == 506110


def variants(spark, docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "v string").select(F.try_parse_json("v").alias("doc"))


def test_host_devices(spark):
    docs = [
        {"ip_str": "203.0.113.1", "asn": "AS64500", "org": "o", "data": [{"port": 80, "data": "x" * 5000, "http": {"server": "nginx"}}, {"port": 80}, {"port": 554}], "location": {"country_code": "NL"}},
        {"ip": "203.0.113.2", "port": 23, "data": "BusyBox", "vulns": ["CVE-1"], "cpe": "cpe:/a"}, {"org": "no address"}, {"ip_str": "203.0.113.3", "data": [{"port": 1, "vulns": {"CVE-2": {}}, "data": "alarm"}]},
    ]
    rows = {(r.ip, r.port): r for r in normalize.host_devices(variants(spark, docs), "2026-04-20", "2026-04-23", "q", "iot").collect()}
    assert set(rows) == {("203.0.113.1", 80), ("203.0.113.1", 554), ("203.0.113.2", 23), ("203.0.113.3", 1)}
    a = rows["203.0.113.1", 80]
    assert (a.device_type, a.asn, a.country_code, len(a.raw_banner)) == ("server", 64500, "NL", 4096) and rows["203.0.113.1", 554].device_type == "camera"
    assert rows["203.0.113.2", 23].cve_ids == ["CVE-1"] and rows["203.0.113.2", 23].cpe == ["cpe:/a"] and rows["203.0.113.2", 23].device_type == "iot"
    assert rows["203.0.113.3", 1].cve_ids == ["CVE-2"] and rows["203.0.113.3", 1].device_type == "iot"  # "arm" within "alarm"


def test_enriched_devices(spark):
    r = {"ip": "203.0.113.1", "autonomous_system": {"asn": 64500, "name": "o"}, "services": [{"port": 22, "protocol": "SSH", "software": [{"vendor": "v", "product": "p"}]}, {"port": 22, "protocol": "HTTP"}]}
    rows = normalize.enriched_devices(variants(spark, [{"result": {"resource": r}}, {"result": {"resource": {"ip": "203.0.113.2"}}}]), "2026-04-20", "2026-04-23").collect()
    assert {(x.ip, x.port, x.protocol) for x in rows} == {("203.0.113.1", 22, "http"), ("203.0.113.2", None, None)}


def test_feed_records(spark):
    c2 = normalize.c2_feed(variants(spark, [{"ioc": "[::1]:80", "ioc_type": "ip:port", "malware": "Mirai"}, {"ioc": "203.0.113.1:x", "ioc_type": "ip:port", "confidence_level": 90}, {"ioc": "a.example", "ioc_type": "domain"}]), "2026-04-23").collect()
    assert [(r.ip, r.port, r.malware_family, r.confidence) for r in c2] == [("::1", 80, "mirai", 0), ("203.0.113.1", None, "", 90), (None, None, "", 0)]
    urls = normalize.url_feed(variants(spark, [{"url": "http://203.0.113.1/a", "host": "203.0.113.1", "url_status": "online", "tags": ["Mozi"]}, {"url": "http://h/a", "host": "h"}, {"url": ""}]), variants(spark, [{"sha256_hash": "a" * 64, "file_type": "ELF"}, {"sha256_hash": "b" * 64, "file_type": "zip"}]), "2026-04-23").collect()
    assert [(r.ioc_type, r.ip, r.malware_family, r.confidence) for r in urls] == [("url", "203.0.113.1", "mozi", 100), ("url", None, "unknown", 80), ("sha256", None, "unknown", 85)]
    pulse = normalize.pulse_feed(variants(spark, [{"name": "A Mirai wave", "tags": ["x"], "indicators": [{"type": "IPv4", "indicator": " 203.0.113.1 "}, {"type": "CVE", "indicator": "c"}, {"type": "URL", "indicator": ""}]}]), "2026-04-23").collect()
    assert [(r.ioc_type, r.ioc_value, r.ip, r.malware_family, r.confidence) for r in pulse] == [("ip", "203.0.113.1", "203.0.113.1", "mirai", 75)]
    sample = normalize.sample_feed(variants(spark, [{"sha256_hash": "a" * 64, "first_seen": "2026-04-25 12:00:01 UTC"}]), "2026-04-23").first()
    assert sample.malware_family == "unknown" and sample.first_seen.hour == 12


def test_connection_events(spark):
    c = spark.createDataFrame([(1, "smbd", "tcp", 1.5, "l", 445, "203.0.113.1", 1), (2, "odd", "tcp", None, "l", 1, "203.0.113.1", 1)], "connection long, connection_type string, connection_transport string, connection_timestamp double, local_host string, local_port int, remote_host string, remote_port int")
    d = spark.createDataFrame([(1, "http://b", "m2"), (1, "http://a", "m1")], "connection long, download_url string, download_md5_hash string")
    new, mark = logs.connections_since(c, 0)
    rows = normalize.connection_events(new, d).orderBy("raw_line_number").collect()
    assert [(r.event_type, r.download_url) for r in rows] == [("smb.connection", "http://a"), ("tcp.connection", None)] and mark.first()[0] == 2
    assert rows[0].event_time.microsecond == 500000 and logs.connections_since(c, 2)[0].count() == 0
