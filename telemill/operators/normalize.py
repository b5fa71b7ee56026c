"""Sensor lines, scan hosts and feed records as rows of the common tables.

Parsers take the first of the pair that sources.logs.parse_json_lines gives: a struct ``e``, with value, file_path,
line_number and collected_at beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill import schemas
from telemill.functions import rules
from telemill.functions.classify_inputs import banner_of  # noqa: F401  (part of the interface)
from telemill.functions.exprs import asn_number, blank_to_null, canonical_ip, epoch_seconds, family_of, local_time, lookup, monday, positive_port, rfc3339, safe_int
from telemill.operators.classify import device_type


def as_events(rows: DataFrame, honeypot: str, run_id: str, at: Column, **content: Column) -> DataFrame:
    """Rows of the event table: provenance, the given columns, and nulls for the rest.

    record_id is a hash of file and line, so a rerun gives the same rows. event_time falls back to collected_at.
    """
    known = {
        "record_id": F.sha2(F.concat_ws(":", "file_path", "line_number").cast("binary"), 256),
        "event_time": F.coalesce(at, F.col("collected_at")),
        "ingested_at": F.current_timestamp(),
        "honeypot": F.lit(honeypot),
        "pipeline_run_id": F.lit(run_id),
        "raw_file_path": F.col("file_path"),
        "raw_line_number": F.col("line_number"),
        "raw_data": F.col("value"),
        **content,
    }
    return rows.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.EVENT])


def ssh_events(rows: DataFrame, run_id: str = "") -> DataFrame:
    """SSH and Telnet sensor: ids under ``cowrie.`` only, without that prefix."""
    e, kind = (lambda f: F.col(f"e.{f}")), F.col("e.eventid")
    rows = rows.filter(kind.startswith("cowrie."))
    login, download = kind.contains("login"), kind == "cowrie.session.file_download"
    return as_events(
        rows, "cowrie", run_id, rfc3339(e("timestamp")),
        source_ip=canonical_ip(e("src_ip")), source_port=e("src_port"), dest_port=F.coalesce(e("dst_port"), F.lit(22)), session_id=e("session"),
        event_type=F.regexp_replace(kind, r"^cowrie\.", ""), protocol=F.when(kind.contains("telnet") | (e("dst_port") == 23), "telnet").otherwise("ssh"),
        username=F.when(login, e("username")), password=F.when(login, e("password")), command_str=F.when(kind == "cowrie.command.input", e("input")),
        download_url=F.when(download, e("url")), file_hash=F.when(download, e("shasum")), hassh=F.coalesce(blank_to_null(e("hassh")), blank_to_null(e("hasshAlgorithms"))),
    )


def _either_case(value: str, field: str) -> Column:
    """A field of logdata, upper-case key first."""
    upper, lower = (F.get_json_object(value, f"$.logdata.{k}") for k in (field.upper(), field.lower()))
    return F.coalesce(blank_to_null(upper), lower)


def canary_events(rows: DataFrame, run_id: str = "") -> DataFrame:
    """Multi-protocol canary: internal messages are dropped; log types give protocol and event type."""
    kind = F.coalesce(F.col("e.logtype"), F.lit(0))
    rows = rows.filter(kind != rules.CANARY_INTERNAL)
    login, http = kind.isin(*rules.CANARY_LOGIN_TYPES), kind == 3000
    agent = F.coalesce(*[blank_to_null(F.get_json_object("value", f"$.logdata.{h}['{a}']")) for h in ("HEADERS", "headers") for a in ("User-Agent", "user-agent")])
    return as_events(
        rows, "opencanary", run_id, local_time("e.local_time"),
        source_ip=canonical_ip("e.src_host"), source_port=positive_port("e.src_port"), dest_port=positive_port("e.dst_port"),
        protocol=F.coalesce(lookup(kind, rules.CANARY_PROTOCOLS), F.concat(F.lit("unknown_"), kind.cast("string"))),
        event_type=F.when(login, "login.attempt").when(http, "http.request").when(kind == 17000, "port_scan").otherwise("connection"),
        username=F.when(login, _either_case("value", "username")), password=F.when(login, _either_case("value", "password")),
        http_path=F.when(http, _either_case("value", "path")), user_agent=F.when(http, agent),
    )


def tcp_events(rows: DataFrame, run_id: str = "") -> DataFrame:
    """Catch-all TCP sensor: handled packets only; a payload hash of 64 characters is a file hash."""
    e = lambda f: F.col(f"e.{f}")
    rows = rows.filter(F.lower(e("msg")).contains("packet got handled"))
    return as_events(
        rows, "glutton", run_id, rfc3339(e("time")),
        source_ip=canonical_ip(e("src_ip")), source_port=safe_int(e("src_port")), dest_port=safe_int(e("dest_port")), session_id=e("sensorID"),
        protocol=lookup(e("dest_port"), rules.PORT_PROTOCOLS, "tcp"), event_type=F.lit("connection"), file_hash=F.when(F.length(e("payload_hash")) == 64, e("payload_hash")),
    )


def connection_events(connections: DataFrame, downloads: DataFrame, run_id: str = "") -> DataFrame:
    """Connections with the list of their downloads; the first is also the event's url and hash."""
    held = downloads.groupBy("connection").agg(F.array_sort(F.collect_list(F.struct(F.col("download_url").alias("url"), F.col("download_md5_hash").alias("md5")))).alias("downloads"))
    rows = connections.join(held, "connection", "left").withColumn("proto", lookup(F.coalesce("connection_type", F.lit("")), rules.SERVICE_PROTOCOLS, "tcp"))
    rows = rows.withColumn("file_path", F.lit("connections")).withColumn("line_number", F.col("connection")).withColumn("collected_at", F.lit(None).cast("timestamp"))
    rows = rows.withColumn("value", F.to_json(F.struct("connection", "connection_type", "connection_transport", "downloads")))
    first = F.try_element_at("downloads", F.lit(1))
    return as_events(
        rows, "dionaea", run_id, epoch_seconds("connection_timestamp"),
        source_ip=canonical_ip("remote_host"), source_port=F.col("remote_port"), dest_port=F.col("local_port"), session_id=F.col("connection").cast("string"),
        protocol=F.col("proto"), event_type=F.concat("proto", F.lit(".connection")), download_url=first["url"], file_hash=first["md5"],
    )


def _get(path: str, kind: str = "string", of: str = "doc") -> Column:
    return F.try_variant_get(of, path, kind)


def _list_or_one(path: str, of: str = "s") -> Column:
    """An array of texts from a list or a single text."""
    return F.coalesce(_get(path, "array<string>", of), F.when(_get(path, "string", of).isNotNull(), F.array(_get(path, "string", of))), F.array().cast("array<string>"))


def host_devices(hosts: DataFrame, week, snapshot, query_id: str, category: str) -> DataFrame:
    """Scan hosts (VARIANT doc) as a row per (ip, port), the first of each.

    ``data`` is a list of services or a banner of the host itself, ``vulns`` a map or a list, ``cpe`` a list or a
    text. Banners are cut to 4096 characters; hosts without an address are dropped.
    """
    ip = F.coalesce(blank_to_null(_get("$.ip_str")), blank_to_null(_get("$.ip")))
    rows = _with_address(hosts, canonical_ip(ip))
    several = _get("$.data", "array<variant>")
    none = F.array().cast("array<string>")
    of_host = {
        "_port": _get("$.port"), "_transport": _get("$.transport"), "_protocol": _get("$._shodan.module"), "_product": _get("$.product"), "_version": _get("$.version"),
        "country_code": F.coalesce(_get("$.location.country_code"), _get("$.country_code")), "asn": asn_number(_get("$.asn")), "org": _get("$.org"), "isp": _get("$.isp"),
        "hostnames": F.coalesce(_get("$.hostnames", "array<string>"), none), "domains": F.coalesce(_get("$.domains", "array<string>"), none), "tags": F.coalesce(_get("$.tags", "array<string>"), none),
    }
    rows = rows.select("doc", "ip", _text_hash(), *[v.alias(k) for k, v in of_host.items()], several.alias("_several"))
    several = F.col("_several")
    rows = rows.select("doc", "ip", "_tie", *of_host, F.posexplode(F.when(F.size(several) > 0, several).otherwise(F.array("doc"))).alias("k", "s"))
    s = lambda path, kind="string": _get(path, kind, "s")
    vulns = F.coalesce(F.map_keys(s("$.vulns", "map<string,variant>")), s("$.vulns", "array<string>"), F.array().cast("array<string>"))
    title = F.coalesce(blank_to_null(s("$.http.title")), s("$.http.html_title"))
    banner = F.coalesce(s("$.data"), s("$.banner"))
    both = lambda path, of: F.coalesce(s(path), F.col(of))
    rows = rows.select(
        F.lit("shodan").alias("source"), F.lit(week).cast("date").alias("snapshot_week"), F.lit(snapshot).cast("date").alias("snapshot_date"), "ip",
        safe_int(both("$.port", "_port")).alias("port"), both("$.transport", "_transport").alias("transport"), both("$._shodan.module", "_protocol").alias("protocol"), both("$.product", "_product").alias("product"), both("$.version", "_version").alias("version"),
        F.when(F.size(_list_or_one("$.cpe23")) > 0, _list_or_one("$.cpe23")).otherwise(_list_or_one("$.cpe")).alias("cpe"), F.array_sort(vulns).alias("cve_ids"),
        "country_code", "asn", "org", "isp", "hostnames", "domains", "tags", title.alias("http_title"), s("$.http.server").alias("http_server"),
        F.coalesce(s("$.http.headers", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("http_headers"), s("$.ssl.cert").alias("ssl_cert"), s("$.vulns").alias("vulns"),
        F.array(F.lit(query_id)).alias("query_ids"), F.lit(category).alias("query_category"), F.substring(banner, 1, 4096).alias("raw_banner"), F.to_json("doc").alias("raw_data"), "k", "_tie",
    )
    rows = rows.withColumn("device_type", device_type(F.col("product"), F.col("http_server"), F.col("http_title"), F.col("raw_banner"), F.col("port"), F.col("tags")))
    return first_of(rows, ["ip", "port"], "k", tie="_tie").select(*schemas.DEVICE.names)


def enriched_devices(hosts: DataFrame, week, snapshot) -> DataFrame:
    """Enrichment hosts (VARIANT doc) as a row per service, the last of each port; one row without a port where there is none."""
    r = lambda path, kind="string": _get(f"$.result.resource{path}", kind)
    rows = _with_address(hosts, canonical_ip(r(".ip")))
    none = F.array().cast("array<string>")
    of_host = {
        "country_code": r(".location.country_code"), "asn": r(".autonomous_system.asn", "long"), "org": r(".autonomous_system.name"), "isp": r(".autonomous_system.description"),
        "tags": F.coalesce(r(".labels", "array<string>"), none),
    }
    rows = rows.select("doc", "ip", _text_hash(), *[v.alias(k) for k, v in of_host.items()], r(".services", "array<variant>").alias("services"))
    rows = rows.select("doc", "ip", "_tie", *of_host, F.posexplode_outer("services").alias("k", "s"))
    s = lambda path, kind="string": _get(path, kind, "s")
    software = F.transform(s("$.software", "array<struct<vendor:string,product:string,version:string>>"), lambda x: F.concat_ws(" ", x.vendor, x.product, x.version))
    rows = rows.select(
        F.lit("censys").alias("source"), F.lit(week).cast("date").alias("snapshot_week"), F.lit(snapshot).cast("date").alias("snapshot_date"), "ip",
        safe_int(s("$.port")).alias("port"), F.lower(s("$.transport_protocol")).alias("transport"),
        F.lower(F.coalesce(s("$.protocol"), s("$.extended_service_name"), s("$.service_name"))).alias("protocol"), F.array_join(software, ", ").alias("product"), F.lit(None).cast("string").alias("version"),
        none.alias("cpe"), none.alias("cve_ids"), "country_code", "asn", "org",
        "isp", none.alias("hostnames"), none.alias("domains"), "tags",
        s("$.http.response.html_title").alias("http_title"), F.coalesce(s("$.http.response.headers.Server"), s("$.http.response.headers.server")).alias("http_server"),
        F.coalesce(s("$.http.response.headers", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("http_headers"), s("$.tls.certificates[0]").alias("ssl_cert"), F.lit(None).cast("string").alias("vulns"),
        none.alias("query_ids"), F.lit("enrichment").alias("query_category"), F.substring(s("$.banner"), 1, 4096).alias("raw_banner"), F.to_json("doc").alias("raw_data"), "k", "_tie",
    )
    rows = rows.withColumn("device_type", device_type(F.col("product"), F.col("http_server"), F.col("http_title"), F.col("raw_banner"), F.col("port"), F.col("tags")))
    return first_of(rows, ["ip", "port"], "k", last=True, tie="_tie").select(*schemas.DEVICE.names)


def _with_address(hosts: DataFrame, ip: Column) -> DataFrame:
    """Hosts that have an address, and the address.

    It goes through an array, because a filter on it would be pushed below the parsing of ``doc``: each mention of doc in it would then parse the text again.
    """
    return hosts.select("*", F.explode(F.array(ip)).alias("ip")).filter("ip IS NOT NULL")


def _text_hash() -> Column:
    """Hash of a whole host, taken once for each, which tells rows of equal order apart without their texts."""
    return F.xxhash64(F.to_json("doc")).alias("_tie")


def first_of(rows: DataFrame, key: list[str], order: str, last: bool = False, tie: str | None = None) -> DataFrame:
    """The first (or last) row of each key by an order; ties by a column, or by the row's hash where none is given."""
    from pyspark.sql import Window

    by = F.col(order).desc() if last else F.col(order).asc()
    w = Window.partitionBy(*key).orderBy(by, F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith(("map", "variant"))]) if tie is None else F.col(tie))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", *([tie] if tie else []))


def _feed(rows: DataFrame, snapshot, **content: Column) -> DataFrame:
    known = {"snapshot_date": F.lit(snapshot), "raw_data": F.to_json("doc"), **content}
    return rows.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.FEED])


def c2_feed(rows: DataFrame, snapshot) -> DataFrame:
    """C2 indicators (VARIANT doc): ``ip:port`` is split at the last colon, without brackets; no confidence counts as 0."""
    kind, value = F.lower(F.coalesce(_get("$.ioc_type"), F.lit(""))), F.coalesce(_get("$.ioc"), F.lit(""))
    pair = (kind == "ip:port") & value.contains(":")
    return _feed(
        rows, snapshot, source=F.lit("threatfox"), ioc_type=kind, ioc_value=value, ip=F.when(pair, F.regexp_replace(F.regexp_extract(value, r"^(.*):([^:]*)$", 1), r"^[\[\]]+|[\[\]]+$", "")),
        port=F.when(pair, F.regexp_extract(value, r"^(.*):([^:]*)$", 2).try_cast("int")), malware_family=F.lower(F.coalesce(_get("$.malware"), F.lit(""))),
        confidence=F.coalesce(_get("$.confidence_level", "int"), F.lit(0)), tags=F.coalesce(_get("$.tags", "array<string>"), F.array().cast("array<string>")),
        first_seen=_get("$.first_seen").try_cast("timestamp"), last_seen=_get("$.last_seen").try_cast("timestamp"),
    )


def url_feed(urls: DataFrame, payloads: DataFrame, snapshot) -> DataFrame:
    """URL records and ELF payload records (VARIANT doc); a host is an address only if it is digits and dots."""
    tags = F.coalesce(_get("$.tags", "array<string>"), F.array().cast("array<string>"))
    host, url, sha = _get("$.host"), blank_to_null(_get("$.url")), blank_to_null(_get("$.sha256_hash"))
    u = _feed(
        urls.filter(url.isNotNull()), snapshot, source=F.lit("urlhaus"), ioc_type=F.lit("url"), ioc_value=url, ip=F.when(host.rlike(r"^[0-9.]+$"), host),
        malware_family=F.coalesce(F.lower(F.try_element_at(tags, F.lit(1))), F.lit("unknown")), confidence=F.when(_get("$.url_status") == "online", 100).otherwise(80), tags=tags,
        first_seen=F.coalesce(_get("$.date_added"), _get("$.dateadded")).try_cast("timestamp"),
    )
    seen = _get("$.firstseen").try_cast("timestamp")
    p = _feed(
        payloads.filter((F.lower(_get("$.file_type")) == "elf") & sha.isNotNull()), snapshot, source=F.lit("urlhaus"), ioc_type=F.lit("sha256"), ioc_value=sha,
        malware_family=F.coalesce(blank_to_null(F.lower(_get("$.signature"))), F.lit("unknown")), confidence=F.lit(85), tags=F.array(F.lit("elf")), first_seen=seen, last_seen=seen,
    )
    return u.unionByName(p)


def sample_feed(rows: DataFrame, snapshot) -> DataFrame:
    """Malware samples (VARIANT doc)."""
    at = lambda f: F.regexp_replace(_get(f"$.{f}"), " UTC$", "").try_cast("timestamp")
    return _feed(
        rows, snapshot, source=F.lit("malwarebazaar"), ioc_type=F.lit("sha256"), ioc_value=F.coalesce(_get("$.sha256_hash"), F.lit("")),
        malware_family=F.lower(F.coalesce(blank_to_null(_get("$.signature")), F.lit("unknown"))), confidence=F.lit(90), tags=F.coalesce(_get("$.tags", "array<string>"), F.array().cast("array<string>")),
        first_seen=at("first_seen"), last_seen=at("last_seen"),
    )


def pulse_feed(pulses: DataFrame, snapshot) -> DataFrame:
    """Indicators of pulses (VARIANT doc with name, tags and indicators); unknown types and empty values are dropped."""
    tags = F.coalesce(_get("$.tags", "array<string>"), F.array().cast("array<string>"))
    rows = pulses.select(tags.alias("tags"), _get("$.name").alias("name"), F.explode(_get("$.indicators", "array<variant>")).alias("doc"))
    kind, value = lookup(F.coalesce(_get("$.type"), F.lit("")), rules.PULSE_TYPES), blank_to_null(F.trim(_get("$.indicator")))
    rows = rows.withColumn("kind", kind).withColumn("value", value).filter("kind IS NOT NULL AND value IS NOT NULL")
    at = _get("$.created").try_cast("timestamp")
    return _feed(
        rows, snapshot, source=F.lit("otx"), ioc_type=F.col("kind"), ioc_value=F.col("value"), ip=F.when(F.col("kind") == "ip", F.col("value")), malware_family=family_of(F.col("tags"), F.col("name")),
        confidence=F.lit(75), tags=F.col("tags"), first_seen=at, last_seen=at,
    )


def backfill_week(devices: DataFrame) -> DataFrame:
    """snapshot_week set to the Monday of snapshot_date where it is null."""
    return devices.withColumn("snapshot_week", F.coalesce("snapshot_week", monday("snapshot_date")))


def clean_record(c: Column) -> Column:
    """A nested record as JSON without NUL characters."""
    return F.replace(F.to_json(c), F.lit("\\u0000"), F.lit(""))
