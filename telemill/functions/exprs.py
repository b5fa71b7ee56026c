"""Column builders: addresses, text rules, safe casts and time."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from telemill.functions import rules


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column | str, table: Mapping, default: Column | str | None = None) -> Column:
    """Value of a fixed map, or the default."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.try_element_at(F.create_map(*entries), _col(key))
    return found if default is None else F.coalesce(found, F.lit(default) if isinstance(default, str) else default)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def has_value(c: Column | str) -> Column:
    """Neither null nor empty."""
    return _col(c).isNotNull() & (_col(c) != "")


def alternation(words: Sequence[str], whole: Sequence[str] = ()) -> str:
    """Pattern that any of the words matches, those in ``whole`` only between word borders."""
    return "|".join(rf"\b{re.escape(w)}\b" if w in whole else re.escape(w) for w in words)


def joined_lower(*cs: Column | str) -> Column:
    """Lower-cased texts joined by spaces; nulls and empty texts are skipped."""
    return F.lower(F.concat_ws(" ", *[blank_to_null(c) for c in cs]))


def safe_int(c: Column | str) -> Column:
    return _col(c).try_cast("int")


def positive_port(c: Column | str) -> Column:
    """A port number above 0 or null."""
    p = safe_int(c)
    return F.when(p > 0, p)


def canonical_ip(c: Column | str) -> Column:
    """The address without a mask or spaces around it; empty texts are null."""
    return blank_to_null(F.trim(F.substring_index(_col(c), "/", 1)))


def is_private_ip(c: Column | str) -> Column:
    """Private or loopback by prefix."""
    return _col(c).rlike(rules.PRIVATE_PATTERN)


def is_strict_ipv4(c: Column | str) -> Column:
    return _col(c).rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$")


def ip_to_long(c: Column | str) -> Column:
    """IPv4 as a number; null for anything else."""
    part = [F.split_part(_col(c), F.lit("."), F.lit(k)).try_cast("long") for k in (1, 2, 3, 4)]
    return F.when(_col(c).rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3])


def net24(c: Column | str) -> Column:
    """The /24 network of an IPv4 address."""
    return F.when(_col(c).rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.concat(F.substring_index(_col(c), ".", 3), F.lit(".0/24")))


def asn_number(c: Column | str) -> Column:
    """12345 of AS12345."""
    return blank_to_null(F.regexp_extract(_col(c), r"(?i)^AS(\d+)$", 1)).try_cast("long")


def monday(c: Column | str) -> Column:
    return F.to_date(F.date_trunc("week", _col(c)))


def epoch_seconds(c: Column | str) -> Column:
    """Timestamp of seconds since 1970, to the microsecond."""
    return F.timestamp_micros(F.round(_col(c).cast("double") * 1e6).cast("long"))


def local_time(c: Column | str) -> Column:
    """Timestamp of ``yyyy-MM-dd HH:mm:ss.SSSSSS`` in the session's zone; null if it is none."""
    return F.try_to_timestamp(_col(c), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))


def rfc3339(c: Column | str) -> Column:
    """Timestamp of an RFC 3339 text with up to nanoseconds, cut to microseconds."""
    return _col(c).try_cast("timestamp")


def safe_share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage, null when the whole is 0."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)


def stable_id(values: Column) -> Column:
    """16 hex digits of SHA-256 over a sorted array joined by commas."""
    return F.substring(F.sha2(F.array_join(F.array_sort(values), ",").cast("binary"), 256), 1, 16)


def pseudonymous_ip(c: Column | str, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), _col(c)).cast("binary"), 256)


def clean_text(c: Column | str) -> Column:
    """Text without NUL characters."""
    return F.translate(_col(c), "\u0000", "")


def decoded_banner(c: Column | str) -> Column:
    """Lower-cased banner, from strict base64 if it is that, else as it is."""
    return F.lower(F.coalesce(F.try_validate_utf8(F.try_to_binary(_col(c), F.lit("base64")).cast("string")), _col(c)))


def family_of(tags: Column, name: Column | None = None) -> Column:
    """First known malware family that tags and name contain, else 'unknown'."""
    text = F.lower(F.concat_ws(" ", tags, *([] if name is None else [name])))
    return F.coalesce(*[F.when(text.contains(f), F.lit(f)) for f in rules.FAMILIES], F.lit("unknown"))


def lifetime_class(days: Column) -> Column:
    return F.when(days > 14, "persistent").when(days > 3, "intermittent").otherwise("transient")


def service_label(port: Column | str) -> Column:
    return F.when(_col(port).isin(1080, 3128, 8080, 8888), "proxy").otherwise("other")
