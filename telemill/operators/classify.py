"""Device classifiers from rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import rules
from telemill.functions.exprs import alternation, joined_lower


def _has(text: Column, words: tuple[str, ...], borders: bool) -> Column:
    """Whether a text has any of the words: searches of bytes, several times faster than one pattern with as many branches."""
    if borders:
        return text.rlike(alternation(words, words))
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def device_text(product: Column | str, server: Column | str, title: Column | str, banner: Column | str, tags: Column | None = None) -> Column:
    """The lower-cased texts that words of device_type are looked for in."""
    return joined_lower(product, server, title, banner, *([] if tags is None else [F.array_join(tags, " ")]))


def device_type(product: Column, server: Column, title: Column, banner: Column, port: Column, tags: Column | None = None, word_boundary: bool = False) -> Column:
    """camera | router | proxy | iot | server | unknown, the first whose words or ports match.

    Words match anywhere in the lower-cased texts, or only between word borders with ``word_boundary``.
    """
    return type_of_text(device_text(product, server, title, banner, tags), product, port, word_boundary)


def type_of_text(text: Column, product: Column, port: Column, word_boundary: bool = False) -> Column:
    """device_type of device_text, which is best a column of its own: it is looked at many times."""
    protocol = F.lower(F.coalesce(product, F.lit("")))
    port = F.coalesce(port, F.lit(-1))
    has = lambda words: _has(text, words, word_boundary)
    return (
        F.when((port == 554) | has(rules.CAMERA_WORDS), "camera")
        .when((port == 7547) | has(rules.ROUTER_WORDS), "router")
        .when(has(rules.PROXY_WORDS) | protocol.isin(*rules.PROXY_PROTOCOLS) | (port.isin(*rules.PROXY_PORTS) & (text != "")), "proxy")
        .when(has(rules.IOT_WORDS) | protocol.isin(*rules.IOT_PROTOCOLS), "iot")
        .when(has(rules.SERVER_WORDS), "server")
        .otherwise("unknown")
    )


def refilled_type(current: Column, protocol: Column, server: Column, title: Column, banner: Column, port: Column) -> Column:
    """The type where it is known, else by the second ruleset (fewer words, more protocols, no product or tags)."""
    text = joined_lower(protocol, server, title, banner)
    kind = F.lower(F.coalesce(protocol, F.lit("")))
    port = F.coalesce(port, F.lit(-1))

    def has(words: tuple[str, ...], of: Column = text) -> Column:
        return of.rlike(alternation(words, rules.REFILL_WHOLE_WORDS))

    shown = joined_lower(server, title, banner)
    answers = F.coalesce(banner, F.lit("")) != ""
    serves = F.coalesce(server, F.lit("")) != ""
    found = (
        F.when((port == 554) | has(rules.REFILL_CAMERA_WORDS), "camera")
        .when((port == 7547) | has(rules.REFILL_ROUTER_WORDS), "router")
        .when(has(rules.REFILL_PROXY_WORDS, shown) | kind.isin(*rules.PROXY_PROTOCOLS) | (port.isin(*rules.PROXY_PORTS) & (answers | serves)), "proxy")
        .when(kind.isin(*rules.IOT_PROTOCOLS) | has(rules.REFILL_IOT_WORDS), "iot")
        .when(has(rules.REFILL_SERVER_WORDS) | kind.isin(*rules.REFILL_SERVER_PROTOCOLS), "server")
        .otherwise("unknown")
    )
    return F.when(current == "unknown", found).otherwise(current)


def scan_type(banner: Column, port: Column) -> Column:
    """Type of a bulk-scan record: by hints in the lower-cased banner, then by port."""
    out = F.coalesce(*[F.when(banner.rlike(alternation(words)), F.lit(kind)) for kind, words in rules.SCAN_HINTS])
    by_port = F.create_map(*[F.lit(x) for pair in rules.SCAN_PORT_TYPES.items() for x in pair])
    return F.coalesce(out, F.try_element_at(by_port, port), F.lit("unknown"))


def scan_filter(banner: Column, port: Column) -> Column:
    """Whether a bulk-scan record is kept: every record of some ports, records with a keyword of others."""
    every = [p for p, words in rules.SCAN_PORTS.items() if words is None]
    some = [(port == p) & banner.rlike(alternation(words)) for p, words in rules.SCAN_PORTS.items() if words is not None]
    keep = port.isin(*every)
    for s in some:
        keep = keep | s
    return F.coalesce(keep, F.lit(False))


def reclassified(devices: DataFrame) -> DataFrame:
    """devices with device_type filled in by the second ruleset and old_type as it was."""
    new = refilled_type(F.col("device_type"), F.col("protocol"), F.col("http_server"), F.col("http_title"), F.col("raw_banner"), F.col("port"))
    return devices.withColumn("old_type", F.col("device_type")).withColumn("device_type", new)


def reclassification_report(devices: DataFrame) -> DataFrame:
    """(device_type, before, after) of reclassified()."""
    both = reclassified(devices).select(F.explode(F.array(F.struct(F.col("old_type").alias("device_type"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct("device_type", F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("x"))
    return both.groupBy("x.device_type").agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))
