"""Risk scores, exposure measures, behaviour and the logistic risk model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators.ranges import numbered_runs
from telemill.operators.reporting import PROXY_PORTS
from telemill.plans.storage import scratch_path

# Command families by pattern, in order of precedence.
COMMAND_FAMILIES = {
    "downloader": r"wget |curl |tftp |ftpget ",
    "execution": r"chmod \+?x|chmod 777|sh /tmp|\./",
    "persistence": r"crontab|rc\.local|systemctl|authorized_keys",
    "cleanup": r"rm -rf|rm -f|history -c|unset HISTFILE",
    "arch_targeting": r"mips|arm[567v]|x86|/proc/cpuinfo",
    "sandbox_probing": r"/proc/mounts|/proc/self|dmidecode|lspci",
    "stealth": r"nohup|/dev/null|disown",
    "recon": r"uname|whoami|\bid\b|ifconfig|ps |w\b",
}


def risk_score(devices: DataFrame, asn_class: DataFrame | None = None) -> DataFrame:
    """(ip, score, tier): the mean of five features of an address, each 0 to 1.

    Share of proxy ports open (of four), Telnet or TR-069 open, device type (camera, router, iot 1; proxy 0.8; server
    0.3; else 0.1), number of ports (of five), and the class of its ASN (asn, asn_risk; 0.2 where not given).
    """
    kind = F.when(F.col("device_type").isin("camera", "router", "iot"), 1.0).when(F.col("device_type") == "proxy", 0.8).when(F.col("device_type") == "server", 0.3).otherwise(0.1)
    rows = devices.withColumn("kind", kind)
    if asn_class is not None:
        rows = rows.join(asn_class, "asn", "left")
    asn = F.coalesce("asn_risk", F.lit(0.2)) if asn_class is not None else F.lit(0.2)
    ip = rows.groupBy("ip").agg(F.collect_set("port").alias("ports"), F.max("kind").alias("f3"), F.max(asn).alias("f5"))
    wanted = F.array(*[F.lit(p) for p in PROXY_PORTS])
    f1 = F.size(F.array_intersect("ports", wanted)) / F.lit(len(PROXY_PORTS))
    f2 = F.arrays_overlap("ports", F.array(F.lit(23), F.lit(2323), F.lit(7547))).cast("double")
    f4 = F.least(F.size("ports") / F.lit(5.0), F.lit(1.0))
    score = F.round((f1 + f2 + F.col("f3") + f4 + F.col("f5")) / 5, 4)
    return ip.select("ip", score.alias("score")).withColumn("tier", F.when(F.col("score") > 0.60, "high").when(F.col("score") >= 0.30, "medium").otherwise("low"))


def proxy_sensitivity(devices: DataFrame, broad: Sequence[int] = PROXY_PORTS) -> DataFrame:
    """One row: devices that count as proxies under four definitions, from strict to broadest, and their percentages."""
    strict = (F.col("device_type") == "proxy") & F.col("port").isin(1080, 3128)
    banner = F.col("device_type") == "proxy"
    wide = F.col("port").isin(*broad)
    rules = {"strict": strict, "banner": banner, "broad": wide, "broadest": banner | wide | F.col("protocol").isin("socks5-proxy", "socks4-proxy", "http-connect")}
    one = devices.agg(F.count("*").alias("n"), *[F.count_if(r).alias(k) for k, r in rules.items()])
    for k in rules:
        one = one.withColumn(f"{k}_pct", F.round(F.lit(100.0) * F.col(k) / F.nullif(F.col("n"), F.lit(0)), 2))
    return one


def exposure_counts(devices: DataFrame) -> DataFrame:
    """One row: devices with proxy, mail and command-and-control ports."""
    return devices.agg(F.count_if(F.col("port").isin(*PROXY_PORTS)).alias("proxy"), F.count_if(F.col("port").isin(25, 465, 587)).alias("smtp"), F.count_if(F.col("port").isin(48101, 6667, 7547)).alias("c2"))


def command_family(command: Column) -> Column:
    return F.coalesce(*[F.when(command.rlike(p), F.lit(k)) for k, p in COMMAND_FAMILIES.items()], F.lit("other"))


def command_chains(events: DataFrame, gap: str = "30 minutes", longest: int = 1000) -> DataFrame:
    """(chain, sessions): families of a session's commands in order of time, joined by '>'.

    A session is cut where no command came for ``gap`` and after every ``longest`` commands: some sensors write one
    session id for their whole life. Sessions are read in ordered ranges, so one of any length spans many tasks.
    """
    c = events.filter("command_str IS NOT NULL AND session_id IS NOT NULL").select("session_id", "event_time", "record_id", command_family(F.col("command_str")).alias("family"))
    quiet = F.col("event_time") - F.col("previous.event_time") >= F.expr(f"INTERVAL {gap}")
    c = numbered_runs(c, ["session_id"], ["event_time", "record_id"], ["event_time"], quiet, "_run", "_place")
    held = F.array_sort(F.collect_list(F.struct("event_time", "record_id", "family")))
    chain = F.array_join(F.transform(held, lambda x: x.family), ">")
    return c.groupBy("session_id", "_run", F.expr(f"_place DIV {longest}")).agg(chain.alias("chain")).groupBy("chain").agg(F.count("*").alias("sessions"))


def role_labels(events: DataFrame) -> DataFrame:
    """(source_ip, role): loader, intruder, guesser or scanner, by what an address did."""
    rows = events.groupBy("source_ip").agg(
        F.count_if(F.col("command_str").rlike(COMMAND_FAMILIES["downloader"]) | F.col("download_url").isNotNull()).alias("d"), F.count_if(F.col("command_str").isNotNull()).alias("c"), F.count_if(F.col("event_type").startswith("login")).alias("l")
    )
    return rows.select("source_ip", F.when(F.col("d") > 0, "loader").when(F.col("c") > 0, "intruder").when(F.col("l") > 0, "guesser").otherwise("scanner").alias("role"))


def ip_features(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Features of scanned addresses for the risk model: two aggregates, joined (a single join would multiply counts)."""
    # sets of an address hold ports and weeks, which are few; distinct counts would take three rows for each device
    different = lambda c: F.size(F.collect_set(c)).cast("long")
    d = devices.groupBy("ip").agg(different("port").alias("ports"), different("snapshot_week").alias("weeks"), F.max(F.col("port").isin(*PROXY_PORTS).cast("int")).alias("proxy"), F.max((F.col("device_type") == "iot").cast("int")).alias("iot"))
    e = events.groupBy(F.col("source_ip").alias("ip")).agg(F.count("*").alias("attacks"), F.countDistinct("event_type").alias("kinds"))
    return d.join(e, "ip", "left").na.fill(0, ["attacks", "kinds"])


def risk_model(features: DataFrame, label: str, columns: Sequence[str], seed: int = 7) -> tuple:
    """(fitted pipeline, AUC on held-out rows): standard scaling and logistic regression, fitted on the training rows only."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = features.withColumn("_fold", F.pmod(F.xxhash64("ip", F.lit(seed)), F.lit(10))).withColumn("_label", F.col(label).cast("double"))
    train, test = rows.filter("_fold < 7"), rows.filter("_fold >= 7")
    steps = [VectorAssembler(inputCols=list(columns), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), LogisticRegression(featuresCol="_scaled", labelCol="_label", regParam=0.01)]
    path = scratch_path(features.sparkSession, "model")
    Pipeline(stages=steps).fit(train).save(path)
    model = PipelineModel.load(path)  # without the training summary, which holds the session: tasks cannot be sent that once it has observed anything
    return model, BinaryClassificationEvaluator(labelCol="_label").evaluate(model.transform(test))


def brute_force(events: DataFrame, more_than: int = 100) -> DataFrame:
    """Addresses with more than a number of logins, and the ports they tried."""
    rows = events.filter(F.col("event_type").startswith("login")).groupBy("source_ip").agg(F.count("*").alias("attempts"), F.countDistinct("dest_port").alias("ports"))
    return rows.filter(F.col("attempts") > more_than)


def priority_ips(devices: DataFrame, categories: Sequence[str], limit: int) -> DataFrame:
    """Addresses to enrich first: by category, then device type, then breadth and recency."""
    rank = F.lit(len(categories))
    for k, c in reversed(list(enumerate(categories))):
        rank = F.when(F.col("query_category") == c, k).otherwise(rank)
    kind = F.when(F.col("device_type").isin("camera", "router", "iot"), 0).when(F.col("device_type") == "proxy", 1).otherwise(2)
    rows = devices.groupBy("ip").agg(F.min(rank).alias("category_rank"), F.min(kind).alias("type_rank"), F.max(F.col("port").isin(*PROXY_PORTS).cast("int")).alias("has_proxy"), F.count("*").alias("n"))
    return rows.orderBy("category_rank", "type_rank", F.desc("has_proxy"), F.desc("n"), "ip").limit(limit)


def concentration(counts: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k largest with rank and cumulative percentage of the whole."""
    top = counts.orderBy(F.desc(value), key).limit(k)
    total = counts.agg(F.sum(value).alias("_total"))
    w = Window.orderBy(F.desc(value), key)  # over k rows
    rows = top.crossJoin(F.broadcast(total)).withColumn("rank", F.row_number().over(w)).withColumn("cumulative", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("cumulative_pct", F.round(F.lit(100.0) * F.col("cumulative") / F.col("_total"), 2)).drop("_total", "cumulative")
