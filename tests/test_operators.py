"""Indicators, merges, classifiers, graph and sources, by case and by property."""

import datetime
import gzip
import random

import pytest
from pyspark.sql import functions as F

from telemill.functions import exprs
from telemill.operators import classify, graph, linkage, normalize
from telemill.operators.components import connected_components
from telemill.operators.iocs import credentials, extract_iocs, merged_iocs
from telemill.operators.merge import merge_as_aggregate, merge_rules, unseen_batches
from telemill.sources import logs

EVENT = "record_id string, event_time timestamp, honeypot string, source_ip string, event_type string, username string, password string, command_str string, download_url string, file_hash string, http_path string, raw_data string"
AT = datetime.datetime(2026, 4, 23)


def event(k=0, **x):
    row = dict(record_id=str(k), event_time=AT + datetime.timedelta(seconds=k), honeypot="a", source_ip=None, event_type="x", username=None, password=None, command_str=None, download_url=None, file_hash=None, http_path=None, raw_data=None) | x
    return tuple(row.values())


@pytest.mark.parametrize(
    ("fields", "expected"),
    [
        ({"source_ip": "203.0.113.1"}, {("ip", "203.0.113.1")}), ({"source_ip": "192.168.0.1"}, set()), ({"source_ip": "172.32.0.1"}, {("ip", "172.32.0.1")}),
        ({"command_str": "wget http://e.example.com/x; wget http://e.example.com/x"}, {("url", "http://e.example.com/x;"), ("url", "http://e.example.com/x"), ("domain", "e.example.com")}),
        ({"command_str": "ping 10.0.0.1 203.0.113.7 999.1.1.1"}, {("ip", "203.0.113.7"), ("ip", "999.1.1.1")}), ({"command_str": "x " + "A" * 64}, {("sha256", "a" * 64)}), ({"command_str": "f" * 32}, {("md5", "f" * 32)}),
        ({"event_type": "session.file_download", "download_url": "http://u", "file_hash": "C" * 64}, {("url", "http://u"), ("sha256", "c" * 64)}), ({"download_url": "http://u"}, set()),
        ({"raw_data": '{"downloads": [{"url": "http://d", "md5": "' + "d" * 32 + '", "sha512": "short"}]}'}, {("url", "http://d"), ("md5", "d" * 32)}), ({"http_path": "/?u=http://p/x"}, {("url", "http://p/x")}),
    ],
)
def test_extract(spark, fields, expected):
    rows = extract_iocs(spark.createDataFrame([event(**fields)], EVENT)).collect()
    assert {(r.ioc_type, r.ioc_value) for r in rows} == expected and len(rows) == len(expected)


def test_strict_extraction(spark):
    rows = extract_iocs(spark.createDataFrame([event(command_str="wget http://e/x; 999.1.1.1")], EVENT), strict=True).collect()
    assert {(r.ioc_type, r.ioc_value) for r in rows} == {("url", "http://e/x")}


def test_credentials(spark):
    rows = credentials(spark.createDataFrame([event(0, event_type="login.failed", username="u", password=None), event(1, event_type="login.success", username="u", password=""), event(2, event_type="login.failed"), event(3, event_type="other", username="z")], EVENT)).collect()
    assert [(r.username, r.password, r.attempt_count, r.success_count) for r in rows] == [("u", "", 2, 1)]


def test_merges_do_not_depend_on_order(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), r.choice(["v1", "v2"]), r.choice(["", "m", "n"]), r.randint(0, 9), k) for k in range(40)]
    schema = "source string, ioc_value string, malware_family string, confidence int, seq long"
    rule = merge_rules("feeds", ["malware_family", "confidence"])
    merged = lambda x: sorted(map(tuple, merge_as_aggregate(spark.createDataFrame(x, schema), **rule, seq="seq").collect()))
    whole = merged(rows)
    r.shuffle(rows)
    assert merged(rows) == whole == merged(rows + rows)


def test_ioc_merge_of_parts_is_merge_of_all(spark):
    found = extract_iocs(spark.createDataFrame([event(k, source_ip=f"203.0.113.{k % 3}", honeypot="ab"[k % 2]) for k in range(12)], EVENT))
    a, b = (merged_iocs(found.filter(c)) for c in ("record_id < '5'", "record_id >= '5'"))
    plain = lambda df: sorted(map(str, df.select("ioc_value", "first_seen", "last_seen", "occurrence_count", "source_honeypots").collect()))
    assert plain(merge_as_aggregate(b, **merge_rules("iocs"), old=a)) == plain(merged_iocs(found))
    ledger = spark.createDataFrame([(1,)], "batch_id int")
    assert unseen_batches(spark.createDataFrame([(1,), (2,)], "batch_id int"), ledger).count() == 1


def test_null_keys_merge(spark):
    rows = spark.createDataFrame([("s", "1.1.1.1", None, datetime.date(2026, 4, 20), "unknown", 1), ("s", "1.1.1.1", None, datetime.date(2026, 4, 20), "iot", 2), ("s", "1.1.1.1", None, datetime.date(2026, 4, 20), "unknown", 3)], "source string, ip string, port int, snapshot_week date, device_type string, seq long")
    assert [r.device_type for r in merge_as_aggregate(rows, **merge_rules("devices", ["device_type"]), seq="seq").collect()] == ["iot"]


@pytest.mark.parametrize(("server", "banner", "port", "kind"), [(None, None, 554, "camera"), ("GoAhead", None, 80, "router"), (None, None, 1080, "unknown"), (None, "hello", 1080, "proxy"), ("BusyBox", None, 23, "iot"), ("nginx", None, 80, "server"), (None, "x", 1, "unknown"), (None, "alarm", 1, "iot")])
def test_device_type(spark, server, banner, port, kind):
    df = spark.createDataFrame([(server, banner, port)], "s string, b string, p int")
    none = F.lit(None).cast("string")
    got = df.select(classify.device_type(none, F.col("s"), none, F.col("b"), F.col("p")).alias("a"), classify.device_type(none, F.col("s"), none, F.col("b"), F.col("p"), word_boundary=True).alias("b")).first()
    assert got.a == kind and (banner != "alarm" or got.b == "unknown")


def test_expressions(spark):
    df = spark.createDataFrame([("203.0.113.9/32", "AS64500", "aGVsbG8gQm94")], "ip string, asn string, banner string")
    r = df.select(exprs.canonical_ip("ip").alias("ip"), exprs.net24(exprs.canonical_ip("ip")).alias("net"), exprs.ip_to_long(exprs.canonical_ip("ip")).alias("n"), exprs.asn_number("asn").alias("asn"), exprs.decoded_banner("banner").alias("b"), exprs.decoded_banner(F.lit("Plain text!")).alias("p"), exprs.clean_text(F.lit("a\0b")).alias("c"), exprs.monday(F.lit("2026-04-26").cast("date")).alias("m")).first()
    assert tuple(r) == ("203.0.113.9", "203.0.113.0/24", 3405803785, 64500, "hello box", "plain text!", "ab", datetime.date(2026, 4, 20))
    ips = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("1.2.3",), ("1.2.3.4.",)], "ip string")
    assert [x[0] for x in ips.select(exprs.is_strict_ipv4("ip")).collect()] == [True, False, False, False]


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_communities_find_planted_groups(spark):
    groups = [[f"{g}{k}" for k in range(6)] for g in "abc"]
    edges = [(x, y, "e", 1.0) for g in groups for x in g for y in g if x < y] + [("a0", "b0", "e", 0.1), ("b1", "c1", "e", 0.1)]
    label = {r.node: r.label for r in graph.communities(spark.createDataFrame(edges, "src string, dst string, edge_type string, weight double")).collect()}
    assert all(len({label[x] for x in g}) == 1 for g in groups) and len(set(label.values())) == 3


def test_line_numbers_and_new_lines(spark, tmp_path):
    f = tmp_path / "a.log"
    f.write_bytes(b"one\n\ntwo\nbad \xff byte\n")
    lines = logs.read_lines(spark, str(tmp_path))
    assert [(r.line_number, r.value) for r in lines.orderBy("line_number").collect()] == [(1, "one"), (3, "two"), (4, "bad � byte")]
    stored = spark.createDataFrame([tuple(r) for r in lines.select("file_id", "line_number").collect()], "file_id string, line_number int")
    f.write_bytes(b"one\n\ntwo\nbad \xff byte\nmore\n")
    assert [r.value for r in logs.new_lines(logs.read_lines(spark, str(tmp_path)), stored).collect()] == ["more"]
    f.write_bytes(b"fresh\n")  # rotated: another first line
    assert [r.value for r in logs.new_lines(logs.read_lines(spark, str(tmp_path)), stored).collect()] == ["fresh"]


def test_bulk_scan_formats(spark, tmp_path):
    from telemill.schemas import BULK_SCAN

    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"ip": "203.0.113.1", "port": 23, "value": "QnVzeUJveA=="}\n{"ip": "203.0.113.2", "port": 23, "value": "plain"}\n')
    (tmp_path / "b.csv").write_text("ip,port,proto,timestamp,asn,country_code,value,data,banner\n203.0.113.3,1080,tcp,,,,,x,\n")
    a = logs.filtered_scan(logs.read_bulk_scan(spark, str(tmp_path / "a.json.gz"), BULK_SCAN)).collect()
    b = logs.filtered_scan(logs.read_bulk_scan(spark, str(tmp_path / "b.csv"), BULK_SCAN)).collect()
    assert [(r.ip, r.device_type) for r in a] == [("203.0.113.1", "iot_embedded")] and [(r.ip, r.device_type) for r in b] == [("203.0.113.3", "proxy")]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb"), (2, None)], "n int, s string")
    logs.export_text(df, str(tmp_path / "x"))
    assert sorted(map(tuple, logs.import_text(spark, str(tmp_path / "x"), df.schema).collect())) == [(1, "a\tb"), (2, None)]
    files = spark.createDataFrame([("p",), ("q",)], "path string")
    assert [r.path for r in logs.unprocessed(files, files.filter("path = 'p'")).collect()] == ["q"] and logs.unprocessed(files, files, force=True).count() == 2


def test_pairs_of_a_credential_of_many_addresses(spark):
    from telemill.plans import catalog

    assert "ips <= 100" not in catalog.ORACLES["j6_shared_credential_pairs"]
    rows = [(f"ip{k}", f"u{c}", "p") for k in range(150) for c in range(3) if k % (c + 1) == 0] + [("x", "", "p"), (None, "u1", "p")]
    events = spark.createDataFrame(rows, "source_ip string, username string, password string")
    held = {f"ip{k}": {c for c in range(3) if k % (c + 1) == 0} for k in range(150)}
    for most in (0, 60, 100, 1000):
        found = linkage.shared_credential_pairs(events, most).collect()
        assert len(found) == 150 * 149
        assert {(r.src, r.dst): r.n for r in found} == {(a, b): len(held[a] & held[b]) for a in held for b in held if a != b}


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_pairs_of_several_words_and_of_other_credentials(spark, monkeypatch, broadcast):
    monkeypatch.setattr(linkage, "BROADCAST_ADDRESSES", broadcast)
    rows = [(f"ip{k}", f"u{c}", "p") for k in range(40) for c in range(200) if (k * 7 + c * 11) % 13 < 2 or c == k] + [("alone", "x", "p")]
    events = spark.createDataFrame(rows, "source_ip string, username string, password string")
    held = {f"ip{k}": {u for ip, u, _ in rows if ip == f"ip{k}"} for k in range(40)}
    expected = {(a, b): len(held[a] & held[b]) for a in held for b in held if a != b and held[a] & held[b]}
    for most, words in ((5, 16), (5, 1), (0, 2), (100, 16)):  # all in words, some, some, none
        found = linkage.shared_credential_pairs(events, most, words).collect()
        assert len(found) == len(expected) and {(r.src, r.dst): r.n for r in found} == expected


def test_pairs_are_not_summed(spark):
    events = spark.createDataFrame([(f"ip{k}", f"u{c}", "p") for k in range(30) for c in range(70)], "source_ip string, username string, password string")
    found = linkage.shared_credential_pairs(events, 10)
    plan = found._jdf.queryExecution().optimizedPlan()
    assert "Aggregate" not in [plan.apply(k).nodeName() for k in range(60) if plan.apply(k) is not None]  # before: every pair was shuffled and summed
    assert {r.n for r in found.collect()} == {70} and found.count() == 30 * 29


@pytest.mark.parametrize("kind", ["host", "enriched"])
def test_hosts_are_not_carried_whole_with_each_service(spark, kind):
    service = lambda port, server: f'{{"port": {port}, "http": {{"server": "{server}", "response": {{"headers": {{"Server": "{server}"}}}}}}}}'
    services = "[" + ", ".join(service(p, f"s{k}") for k, p in enumerate([80, 23, 80, 443, 23])) + "]"
    doc = {"host": f'{{"ip_str": "192.0.2.1", "asn": "AS7", "org": "o", "data": {services}}}', "enriched": f'{{"result": {{"resource": {{"ip": "192.0.2.1", "autonomous_system": {{"asn": 7, "name": "o"}}, "services": {services}}}}}}}'}[kind]
    hosts = spark.createDataFrame([(doc,), (doc,)], "t string").repartition(2).select(F.try_parse_json("t").alias("doc"))
    found = normalize.host_devices(hosts, "2024-01-01", "2024-01-03", "q", "iot") if kind == "host" else normalize.enriched_devices(hosts, "2024-01-01", "2024-01-03")
    last = {"host": {80: "s0", 23: "s1", 443: "s3"}, "enriched": {80: "s2", 23: "s4", 443: "s3"}}[kind]
    assert {r.port: (r.http_server, r.asn, r.org) for r in found.collect()} == {p: (s, 7, "o") for p, s in last.items()}
    assert found.count() == 3 and found.filter("raw_data LIKE '%192.0.2.1%'").count() == 3
    plan = found.select("ip", "port", "http_server")._jdf.queryExecution().optimizedPlan()
    columns = [str(plan.apply(k).output()) for k in range(60) if plan.apply(k) is not None]
    assert not any("raw_data" in c for c in columns)  # before: with each service, so a host of n services took n * n


@pytest.mark.parametrize("kind", ["host", "enriched"])
def test_hosts_are_parsed_once(spark, kind):
    texts = {"host": '{"ip_str": "192.0.2.%d", "port": 23}', "enriched": '{"result": {"resource": {"ip": "192.0.2.%d", "services": [{"port": 23}]}}}'}[kind]
    docs = [(texts % k,) for k in range(3)] + [(texts.replace("192.0.2.%d", ip),) for ip in ("", " ", "/24")] + [("{}",), ("not a text of JSON",), (None,)]
    hosts = spark.createDataFrame(docs, "t string").repartition(2).select(F.try_parse_json("t").alias("doc"))
    found = normalize.host_devices(hosts, "2024-01-01", "2024-01-03", "q", "iot") if kind == "host" else normalize.enriched_devices(hosts, "2024-01-01", "2024-01-03")
    assert sorted((r.ip, r.port) for r in found.collect()) == [(f"192.0.2.{k}", 23) for k in range(3)]
    assert str(found._jdf.queryExecution().optimizedPlan()).count("parseJson") == 1  # before: again for each mention of the host in the filter by address


def test_details_need_no_types_and_no_text_twice(spark):
    from conftest import SF
    from telemill.plans import catalog

    plan = str(catalog.QUERIES["x19_host_details"](spark, SF)._jdf.queryExecution().optimizedPlan())
    assert "hikvision" not in plan and plan.count("regexp_replace(regexp_replace(") == 1  # before: types of all devices for their ties, and documents in a filter


def test_type_is_worked_out_once_and_blocks_are_distinct(spark):
    from conftest import SF
    from telemill.plans import catalog

    plan = catalog.QUERIES["r28_exposure_baseline"](spark, SF)._jdf.queryExecution().optimizedPlan()
    nodes = [plan.apply(k) for k in range(60) if plan.apply(k) is not None]
    filters = [str(n.condition()) for n in nodes if n.nodeName() == "Filter"]
    assert not any("hikvision" in f for f in filters)  # before: all words were looked for in the filter, and again for the groups
    plan = catalog.QUERIES["j21_shared_blocks"](spark, SF)._jdf.queryExecution().optimizedPlan()
    names = [plan.apply(k).nodeName() for k in range(60) if plan.apply(k) is not None]
    assert names[0] == "Join" and names.count("Aggregate") == 2  # before: one, above a join of every row with every network's rows


def test_words_of_types_by_bytes(spark):
    from telemill.functions import rules

    words = [w for ws in (rules.CAMERA_WORDS, rules.ROUTER_WORDS, rules.PROXY_WORDS, rules.IOT_WORDS, rules.SERVER_WORDS) for w in ws]
    df = spark.createDataFrame([(f"x{w.upper()}y",) for w in words] + [("é",), (None,), ("",)], "banner string")
    none = F.lit(None).cast("string")
    kind = classify.device_type(none, none, none, F.col("banner"), F.lit(1))
    order = [("camera", rules.CAMERA_WORDS), ("router", rules.ROUTER_WORDS), ("proxy", rules.PROXY_WORDS), ("iot", rules.IOT_WORDS), ("server", rules.SERVER_WORDS)]
    expected = lambda t: next((k for k, ws in order if any(w in (t or "").lower() for w in ws)), "unknown")
    assert all(r.k == expected(r.banner) for r in df.select("banner", kind.alias("k")).collect())


def test_features_take_one_row_for_each_device(spark):
    from conftest import SF
    from telemill.plans import catalog

    plan = catalog.QUERIES["l15_ip_features"](spark, SF)._jdf.queryExecution().optimizedPlan()
    assert "Expand" not in [plan.apply(k).nodeName() for k in range(60) if plan.apply(k) is not None]
