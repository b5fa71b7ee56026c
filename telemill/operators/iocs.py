"""Indicators and credentials of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import rules
from telemill.functions.exprs import has_value, is_private_ip, is_strict_ipv4
from telemill.operators.merge import merge_as_aggregate, merge_rules


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def _typed(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("ioc_type"), F.trim(v).alias("ioc_value")))


def _one(value: Column, kind: str | Column, when: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.array().cast("array<struct<ioc_type:string,ioc_value:string>>")
    return F.when(when, F.array(F.struct(kind.alias("ioc_type"), value.alias("ioc_value")))).otherwise(none)


def text_iocs(text: Column, strict: bool = False) -> Column:
    """Array of (ioc_type, ioc_value) in a text: URLs, public IPv4 addresses, SHA-256 and MD5 hashes, domains.

    With ``strict``, addresses need octets up to 255 and URLs lose closing signs at their end.
    """
    urls, ips = _all(text, rules.URL_PATTERN), F.filter(_all(text, rules.IPV4_PATTERN), lambda v: ~is_private_ip(v))
    if strict:
        urls = F.transform(urls, lambda v: F.regexp_replace(v, r"[;,)\]]+$", ""))
        ips = F.filter(ips, is_strict_ipv4)
    lower = lambda pattern: F.transform(_all(text, pattern), F.lower)
    return F.concat(_typed(urls, "url"), _typed(ips, "ip"), _typed(lower(rules.SHA256_PATTERN), "sha256"), _typed(lower(rules.MD5_PATTERN), "md5"), _typed(lower(rules.DOMAIN_PATTERN), "domain"))


def extract_iocs(events: DataFrame, strict: bool = False) -> DataFrame:
    """Indicators of events, each once per event: (record_id, event_time, honeypot, ioc_type, ioc_value).

    From the public source address, the command, the download (url and hash by its length), nested downloads in
    raw_data and URLs in the HTTP path. Columns that events lack count as null.
    """
    have = set(events.columns)
    c = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    none = F.array().cast("array<struct<ioc_type:string,ioc_value:string>>")
    raw = lambda path: F.get_json_object(c("raw_data"), path)
    download = (F.col("event_type") == "session.file_download") | raw("$.shasum").isNotNull()
    url = F.coalesce(F.nullif(raw("$.url"), F.lit("")), c("download_url"))
    digest = F.coalesce(F.nullif(raw("$.shasum"), F.lit("")), F.nullif(raw("$.sha256"), F.lit("")), c("file_hash"))
    kind = F.when(F.length(digest) == 64, "sha256").when(F.length(digest) == 32, "md5")
    nested = F.from_json(raw("$.downloads"), "array<struct<url:string,md5:string,sha512:string>>")
    of = lambda f, kind, n: _typed(F.transform(F.filter(nested, lambda d: (F.length(d[f]) == n) if n else has_value(d[f])), lambda d: F.lower(d[f]) if n else d[f]), kind)
    found = F.concat(
        _one(c("source_ip"), "ip", F.coalesce(has_value(c("source_ip")) & ~is_private_ip(c("source_ip")), F.lit(False))),
        text_iocs(c("command_str"), strict),
        _one(url, "url", F.coalesce(download & has_value(url), F.lit(False))),
        _one(F.lower(digest), kind, F.coalesce(download & kind.isNotNull(), F.lit(False))),
        *[F.coalesce(x, none) for x in (of("url", "url", 0), of("md5", "md5", 32), of("sha512", "sha512", 128))],
        _typed(_all(c("http_path"), rules.URL_PATTERN), "url"),
    )
    rows = events.select("record_id", "event_time", "honeypot", F.explode(F.array_distinct(found)).alias("x"))
    return rows.select("record_id", "event_time", "honeypot", "x.ioc_type", "x.ioc_value")


def document_iocs(docs: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """Indicators of texts, each once per text: (key, ioc_type, ioc_value)."""
    return docs.select(key, F.explode(F.array_distinct(text_iocs(F.col(text), strict))).alias("x")).select(key, "x.ioc_type", "x.ioc_value")


def merged_iocs(found: DataFrame) -> DataFrame:
    """The indicator table of extract_iocs(): one row for each (type, value), observations counted."""
    rows = found.select("ioc_type", "ioc_value", F.col("event_time").alias("first_seen"), F.col("event_time").alias("last_seen"), F.lit(1).cast("long").alias("occurrence_count"), F.array("honeypot").alias("source_honeypots"))
    return merge_as_aggregate(rows, **merge_rules("iocs"))


def credential_rows(events: DataFrame) -> DataFrame:
    """Credentials of login events; null user or password is an empty text, both empty is none."""
    rows = events.filter(F.col("event_type").isin(*rules.LOGIN_TYPES)).withColumn("username", F.coalesce("username", F.lit(""))).withColumn("password", F.coalesce("password", F.lit("")))
    return rows.filter("username <> '' OR password <> ''")


def credentials(events: DataFrame) -> DataFrame:
    """(username, password, first_seen, last_seen, attempt_count, success_count, source_ip_count)."""
    return credential_rows(events).groupBy("username", "password").agg(
        F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.count("*").alias("attempt_count"), F.count_if(F.col("event_type") == "login.success").alias("success_count"), F.countDistinct("source_ip").alias("source_ip_count")
    )
