"""Links between events, devices, indicators and feeds."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.functions.exprs import blank_to_null, has_value, net24
from telemill.plans.storage import store


def feed_links(iocs: DataFrame, feeds: DataFrame) -> DataFrame:
    """Indicators that feeds know, by group: c2 (address), url, hash, pulse (address or domain).

    Addresses are joined in canonical form. (kind, ioc_value, malware_family, confidence), a row per indicator and feed row.
    """
    own = iocs.select("ioc_type", "ioc_value")
    by_ip = feeds.filter("ip IS NOT NULL").select(F.when(F.col("source") == "otx", "pulse").otherwise("c2").alias("kind"), F.col("ip").alias("ioc_value"), "malware_family", "confidence", F.lit("ip").alias("ioc_type"))
    by_value = feeds.filter("ip IS NULL").select(F.when(F.col("ioc_type") == "url", "url").when(F.col("ioc_type").isin("sha256", "md5", "sha1"), "hash").otherwise("pulse").alias("kind"), "ioc_value", "malware_family", "confidence", "ioc_type")
    known = by_ip.unionByName(by_value)
    return own.join(known, ["ioc_type", "ioc_value"]).select("kind", "ioc_value", "malware_family", "confidence")


def feed_link_summary(links: DataFrame) -> DataFrame:
    """(kind, matches, families, max_confidence); the pulse group has no confidence of its own."""
    return links.groupBy("kind").agg(F.countDistinct("ioc_value").alias("matches"), F.countDistinct(blank_to_null("malware_family")).alias("families"), F.when(F.first("kind") == "pulse", F.lit(None).cast("long")).otherwise(F.max("confidence").cast("long")).alias("max_confidence"))


def cross_match(iocs: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row: matched distinct addresses, urls and hashes, families, totals and percentages (0.0 without any)."""
    links = feed_links(iocs, feeds)
    of = lambda *kinds: F.count_distinct(F.when(F.col("kind").isin(*kinds), F.col("ioc_value")))
    found = links.agg(of("c2", "pulse").alias("ip_matches"), of("url").alias("url_matches"), of("hash").alias("hash_matches"), F.count_distinct(blank_to_null("malware_family")).alias("families"))
    total = lambda t: F.count_if(F.col("ioc_type") == t)
    totals = iocs.agg(total("ip").alias("ips"), total("url").alias("urls"), total("sha256").alias("hashes"))
    one = found.crossJoin(totals)  # one row each
    for m, n in (("ip_matches", "ips"), ("url_matches", "urls"), ("hash_matches", "hashes")):
        one = one.withColumn(f"{m}_pct", F.round(F.lit(100.0) * F.col(m) / F.greatest(F.col(n), F.lit(1)), 1))
    return one


def attacker_devices(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Attackers that scans know, by device type: (device_type, attackers)."""
    ips = events.select(F.col("source_ip").alias("ip")).distinct()
    return devices.select("ip", "device_type").distinct().join(ips, "ip", "left_semi").groupBy("device_type").agg(F.count("*").alias("attackers"))


def matched_by(rows: DataFrame, feeds: DataFrame, by: str, name: str) -> DataFrame:
    """Distinct addresses (ip) of rows that feeds list, by a column of the feeds."""
    known = feeds.filter("ip IS NOT NULL").select("ip", by).distinct()
    return known.join(rows.select("ip").distinct(), "ip", "left_semi").groupBy(by).agg(F.count("*").alias(name))


def same_hash(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Rows of both sides whose hashes are equal but for case."""
    return a.withColumn("_h", F.lower(left)).join(b.withColumn("_h", F.lower(right)), "_h").drop("_h")


def credentials_by_weight(events: DataFrame, most: int) -> DataFrame:
    """Distinct (source_ip, username, password) with ``ips``, the addresses of the credential, and ``heavy``: more than ``most`` of them."""
    used = events.filter(has_value("username") & has_value("password") & F.col("source_ip").isNotNull()).select("source_ip", "username", "password").distinct()
    size = used.groupBy("username", "password").agg(F.count("*").alias("ips"))
    return used.join(size, ["username", "password"]).withColumn("heavy", F.col("ips") > most)


def shared_credentials(events: DataFrame, most: int) -> DataFrame:
    """Addresses that used one credential: (kind, src, dst, n), linear in the input.

    A credential of at most ``most`` addresses gives ordered pairs of them (kind ``pair``; n is the number of such credentials
    that both used), so at most ``most`` rows for each of its addresses. A heavier one is a hub: a row from each address to the credential (kind ``hub``;
    n is the number of its addresses). Addresses are connected by these rows as they would be by all pairs.
    """
    used = credentials_by_weight(events, most)
    light = used.filter("NOT heavy").select("source_ip", "username", "password")
    pairs = light.join(light.withColumnRenamed("source_ip", "dst"), ["username", "password"]).filter(F.col("source_ip") != F.col("dst"))
    pairs = pairs.groupBy(F.col("source_ip").alias("src"), "dst").agg(F.count("*").alias("n"))
    hubs = used.filter("heavy AND ips > 1").select(F.col("source_ip").alias("src"), credential_name().alias("dst"), F.col("ips").alias("n"))
    return pairs.select(F.lit("pair").alias("kind"), "src", "dst", "n").unionByName(hubs.select(F.lit("hub").alias("kind"), "src", "dst", "n"))


def shared_credential_pairs(events: DataFrame, most: int = 100, words: int = 16) -> DataFrame:
    """Ordered pairs of addresses that used one credential: (src, dst, n), n credentials that both used.

    Quadratic in the addresses of a credential, as its result is, so no pair is shuffled or summed on its way. The credentials of most addresses, up to
    63 for each of ``words`` and more than ``most`` addresses each, are bits of an address; a pair meets in each word in which both have a bit, and comes out
    of the first with a bit in common, with the bits of all words. Other credentials give pairs that are summed; one of these takes the bits that both have
    as well, and the pair does not come out of a word.
    """
    used = store(credentials_by_weight(events, most).filter("ips > 1"), "used")
    names = ["username", "password"]
    top = used.filter("heavy").select(*names, "ips").distinct().orderBy(F.desc("ips"), *names).limit(63 * words).collect()
    found = F.broadcast(used.sparkSession.createDataFrame([(r["username"], r["password"], k // 63, 1 << k % 63) for k, r in enumerate(top)], "username string, password string, _word int, _bit long"))
    columns = [f"_w{k}" for k in range(max(1, -(-len(top) // 63)))]
    bits = [F.coalesce(F.bit_or(F.when(F.col("_word") == k, F.col("_bit"))), F.lit(0).cast("long")).alias(c) for k, c in enumerate(columns)]
    own = used.join(found, names).groupBy("source_ip").agg(*bits)
    rest = used.join(found, names, "left_anti").select("source_ip", *names)
    if rest.isEmpty():
        return _pairs_by_words(own, columns)
    others = rest.groupBy("source_ip").agg(F.collect_list(F.to_json(F.struct(*names))).alias("_rest"))  # exact, unlike a hash
    return _pairs_by_words(own.join(others, "source_ip", "left"), columns).unionByName(_pairs_of_rest(rest, own, columns))


#: Addresses, one for each word in which it has a bit, that are broadcast to their pairs (some 70 bytes each with one word).
BROADCAST_ADDRESSES = 1_000_000


def _common(columns: list[str]) -> list[F.Column]:
    return [F.col(c).bitwiseAND(F.col(f"{c}_")) for c in columns]


def _pairs_by_words(own: DataFrame, columns: list[str]) -> DataFrame:
    """(src, dst, n) of addresses with common bits, but for those with an element of ``_rest`` in common, each from one pair of rows."""
    word = F.explode(F.array_compact(F.array(*[F.when(F.col(c) != 0, F.lit(k)) for k, c in enumerate(columns)]))).alias("_word")
    rows = store(own.select(*own.columns, word), "words")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = rows.withColumnRenamed("source_ip", "src"), rows.select(F.col("source_ip").alias("dst"), "_word", *[F.col(c).alias(f"{c}_") for c in own.columns if c != "source_ip"])
    keys = ["_word"]
    if rows.count() <= BROADCAST_ADDRESSES:
        left, right = left.repartition(tasks), F.broadcast(right)
    else:  # each share of the addresses meets a copy of all, so no word is left to one task
        keys.append("_share")
        left = left.withColumn("_share", F.pmod(F.xxhash64("src"), F.lit(tasks))).repartition(tasks, *keys)
        right = right.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long")))).repartition(tasks, *keys)
    common = _common(columns)
    first = F.coalesce(*[F.when(c != 0, F.lit(k)) for k, c in enumerate(common)])
    both = left.join(right, keys).filter((first == F.col("_word")) & (F.col("src") != F.col("dst")))
    if "_rest" in own.columns:
        both = both.filter(~F.coalesce(F.arrays_overlap("_rest", "_rest_"), F.lit(False)))
    return both.select("src", "dst", _bits(common).alias("n"))


def _pairs_of_rest(rest: DataFrame, own: DataFrame, columns: list[str]) -> DataFrame:
    """(src, dst, n) of addresses that share one of the other credentials, n with the bits that both have."""
    names = ["username", "password"]
    pairs = rest.withColumnRenamed("source_ip", "src").join(rest.withColumnRenamed("source_ip", "dst"), names).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    bits = own.select("source_ip", *columns)
    both = pairs.join(bits.withColumnRenamed("source_ip", "src"), "src", "left").join(bits.select(F.col("source_ip").alias("dst"), *[F.col(c).alias(f"{c}_") for c in columns]), "dst", "left")
    return both.select("src", "dst", (F.col("n") + F.coalesce(_bits(_common(columns)), F.lit(0).cast("long"))).alias("n"))


def _bits(common: list[F.Column]) -> F.Column:
    return reduce(add, [F.bit_count(c).cast("long") for c in common])


def credential_name() -> F.Column:
    return F.concat_ws(":", F.lit("cred"), "username", "password")


def credential_hubs(events: DataFrame) -> DataFrame:
    """Edges from an address to each credential it used: linear in the events."""
    used = events.filter(has_value("username") & has_value("password"))
    return used.select(F.col("source_ip").alias("src"), credential_name().alias("dst")).distinct()


def sharing_attackers(events: DataFrame) -> DataFrame:
    """Addresses that share a credential with another: (source_ip)."""
    used = events.filter(has_value("username") & has_value("password"))
    shared = used.groupBy("username", "password").agg(F.countDistinct("source_ip").alias("n")).filter("n > 1")
    return used.join(shared, ["username", "password"], "left_semi").select("source_ip").distinct()


def organisations_or_addresses(feeds: DataFrame, devices: DataFrame, more_than: int = 5) -> DataFrame:
    """Families with more than a number of devices whose address or organisation a feed names.

    The disjunction is two equi joins whose union is made distinct.
    """
    f = feeds.select("malware_family", "ip", "ioc_value")
    d = devices.select("ip", "org").distinct()
    by_ip = f.filter("ip IS NOT NULL").join(d, "ip").select("malware_family", "ip")
    by_org = f.drop("ip").join(d, F.lower("ioc_value") == F.lower("org")).select("malware_family", "ip")
    return by_ip.unionByName(by_org).distinct().groupBy("malware_family").agg(F.count("*").alias("devices")).filter(F.col("devices") > more_than)


def first_exposure_after(events: DataFrame, devices: DataFrame) -> DataFrame:
    """First snapshot after an address's first attack and the days between: (ip, first_attack, exposed, lag_days)."""
    first = events.groupBy(F.col("source_ip").alias("ip")).agg(F.min(F.to_date("event_time")).alias("first_attack"))
    later = devices.select("ip", "snapshot_date").join(first, "ip").filter(F.col("snapshot_date") > F.col("first_attack"))
    return later.groupBy("ip", "first_attack").agg(F.min("snapshot_date").alias("exposed")).withColumn("lag_days", F.datediff("exposed", "first_attack"))


def consecutive_weeks(devices: DataFrame) -> DataFrame:
    """(week, kept): services (ip, port) of a week that the next week still has."""
    seen = devices.select("ip", "port", "snapshot_week").distinct()
    w = Window.partitionBy("ip", "port").orderBy("snapshot_week")
    both = seen.withColumn("next", F.lead("snapshot_week").over(w)).filter(F.datediff("next", "snapshot_week") == 7)
    return both.groupBy(F.col("snapshot_week").alias("week")).agg(F.count("*").alias("kept"))


def shared_blocks(events: DataFrame, devices: DataFrame) -> DataFrame:
    """/24 networks with attackers and scanned devices."""
    a = events.select(net24("source_ip").alias("net")).filter("net IS NOT NULL").distinct()
    b = devices.select(net24("ip").alias("net")).distinct()  # intersect alone joins with every row of a network
    return a.join(b, "net", "left_semi")


def service_matches(devices: DataFrame, feeds: DataFrame) -> DataFrame:
    """Devices whose address and port a feed names."""
    return devices.join(feeds.filter("ip IS NOT NULL AND port IS NOT NULL").select("ip", "port").distinct(), ["ip", "port"], "left_semi")


def host_of(url: str) -> F.Column:
    return F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))


def exclude_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is not done."""
    return work.join(done.select(*keys), keys, "left_anti")


def own_samples(hashes: DataFrame, seen: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples of our own hashes that have not been looked up before."""
    return exclude_done(hashes.select("sha256").distinct(), seen, ["sha256"]).join(samples, "sha256")
