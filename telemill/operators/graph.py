"""Infrastructure graph: typed edges and nodes, components, communities and campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators.components import connected_components
from telemill.operators.linkage import credential_hubs, shared_credentials
from telemill.operators.ranges import set_digests
from telemill.plans.storage import store

SIGNALS = ("download_url", "file_hash", "hassh")


def event_signals(events: DataFrame) -> DataFrame:
    """Distinct (source_ip, download_url, file_hash, hassh) with any signal."""
    any_signal = F.coalesce(*SIGNALS).isNotNull()
    return events.filter(F.col("source_ip").isNotNull() & any_signal).select("source_ip", *SIGNALS).distinct()


def _signal_edges(signals: DataFrame) -> DataFrame:
    """Edges of distinct signals: the three kinds leave a row together, so events are read once for all of them."""
    kinds = (("source_ip", "download_url", "downloads_from"), ("download_url", "file_hash", "hosts_malware"), ("source_ip", "hassh", "uses_fingerprint"))
    each = F.explode(F.array(*[F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("edge_type")) for src, dst, kind in kinds]))
    pairs = signals.select(each.alias("e")).select("e.*").filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst", "edge_type").agg(F.count("*").alias("n"))
    return pairs.select("src", "dst", "edge_type", F.when(F.col("edge_type") == "hosts_malware", 1).otherwise(F.col("n")).cast("double").alias("weight"))


def asn_edges(members: DataFrame, known: DataFrame | None = None, first: int = 5) -> DataFrame:
    """Pairs among the first few addresses of each ASN with two or more, weight 0.5, unless the pair is known."""
    rows = members.select("asn", "ip").distinct()
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("asn").orderBy("ip"))).filter(F.col("rn") <= first)
    pairs = rows.alias("a").join(rows.alias("b"), F.expr("a.asn = b.asn AND a.rn < b.rn")).select(F.col("a.ip").alias("src"), F.col("b.ip").alias("dst")).distinct()
    if known is not None:
        pairs = pairs.join(known.select("src", "dst"), ["src", "dst"], "left_anti")
    return pairs.select("src", "dst", F.lit("shares_asn").alias("edge_type"), F.lit(0.5).alias("weight"))


def graph_edges(events: DataFrame, members: DataFrame | None = None, hubs: bool = True, most: int = 100) -> DataFrame:
    """All edges: downloads_from, hosts_malware, uses_fingerprint, credentials and shares_asn.

    Credentials are hubs (uses_credential); without ``hubs``, only those of more than ``most`` addresses are, and others give an edge same_campaign for each ordered pair.
    """
    out = _signal_edges(event_signals(events))
    if hubs:
        out = out.unionByName(credential_hubs(events).select("src", "dst", F.lit("uses_credential").alias("edge_type"), F.lit(1.0).alias("weight")))
    else:
        kind = F.when(F.col("kind") == "pair", "same_campaign").otherwise("uses_credential")
        out = out.unionByName(shared_credentials(events, most).select("src", "dst", kind.alias("edge_type"), F.lit(1.0).alias("weight")))
    return out if members is None else out.unionByName(asn_edges(members, out))


def node_id(c: str) -> F.Column:
    return F.xxhash64(c)


#: Type of the source and of the target of each kind of edge, by order of precedence.
ENDS = {"downloads_from": ("ip", "url"), "hosts_malware": ("url", "hash"), "uses_fingerprint": ("ip", "hassh"), "uses_credential": ("ip", "credential"), "same_campaign": ("ip", "ip"), "shares_asn": ("ip", "ip")}


def graph_nodes(edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(id, node_value, node_type): the type of the first kind of edge, by the order of ENDS, that names the value; extra has indicator nodes."""
    ends = F.create_map(*[x for k, (kind, (s, d)) in enumerate(ENDS.items()) for x in (F.lit(kind), F.struct(F.lit(k).alias("o"), F.lit(s).alias("s"), F.lit(d).alias("d")))])
    e = edges.withColumn("t", F.element_at(ends, F.col("edge_type")))
    both = e.select(F.col("src").alias("node_value"), F.col("t.o").alias("o"), F.col("t.s").alias("node_type")).unionByName(e.select(F.col("dst").alias("node_value"), F.col("t.o").alias("o"), F.col("t.d").alias("node_type")))
    if extra is not None:
        both = both.unionByName(extra.select("node_value", F.lit(len(ENDS)).alias("o"), "node_type"))
    return both.groupBy("node_value").agg(F.min_by("node_type", F.struct("o", "node_type")).alias("node_type")).select(node_id("node_value").alias("id"), "node_value", "node_type")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree_out, degree_in)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("degree_out"), F.sum("x.i").alias("degree_in"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is not a node."""
    have = nodes.select("node_value")
    return edges.join(have, F.col("src") == F.col("node_value"), "left_anti").union(edges.join(have, F.col("dst") == F.col("node_value"), "left_anti")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that edges connect, whatever their direction; the component is the smallest hashed id in it."""
    e = store(edges.select("src", "dst").distinct(), "pairs")
    ids = store(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("id", node_id("node")), "node-ids")
    groups = connected_components(e.select(node_id("src").alias("a"), node_id("dst").alias("b")))
    return ids.join(groups, "id").select("node", "component")


#: Labels of so many nodes are broadcast (three longs each); beyond that they are joined by a shuffle.
FEW_NODES = 1_000_000


def _if_few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= FEW_NODES else rows


def _moves(pairs: DataFrame, gamma: float, rounds: int) -> DataFrame:
    """(id, label) of an undirected graph (a, b, w) after rounds in which half of the nodes, by a hash of node and round, move to the best label near them.

    A label's score is the weight of a node's edges to it, less gamma times what random edges of the same degrees would
    have; ties go to the smallest label, and a node only moves for a higher score. A round reads the edges of the nodes
    that may move, and is written to the shared folder; it ends when two rounds in a row move nothing. Edges lie in
    order of their nodes, cut anywhere, so a task sums up most of a node's votes before they are shuffled.
    """
    one_way = pairs.filter("a <> b")
    both = one_way.select(F.col("a").alias("id"), "b", "w").unionByName(one_way.select(F.col("b").alias("id"), F.col("a").alias("b"), "w"))
    both = store(both.repartitionByRange("id", "b").sortWithinPartitions("id", "b"), "move-edges")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "w")  # a loop counts twice
    label = store(ends.groupBy("id").agg(F.sum("w").alias("k")).select("id", F.col("id").alias("label"), "k", F.lit(False).alias("moved")), "labels")
    total, nodes = label.agg(F.sum("k"), F.count("*")).first()
    total, still = total or 1.0, 0
    for n in range(rounds):
        turn = F.pmod(F.xxhash64("id", F.lit(n)), F.lit(2)) == 0
        movable, sums = label.filter(turn), label.groupBy("label").agg(F.sum("k").alias("sum"))
        votes = both.filter(turn).join(_if_few(label.select(F.col("id").alias("b"), "label"), nodes), "b").select("id", "label", "w")
        votes = votes.unionByName(movable.select("id", "label", F.lit(0.0).alias("w"))).groupBy("id", "label").agg(F.sum("w").alias("w"))
        votes = votes.join(_if_few(movable.select("id", F.col("label").alias("own"), "k"), nodes), "id").join(sums, "label")
        here = F.col("label") == F.col("own")
        score = F.round(F.col("w") - gamma * F.col("k") * (F.col("sum") - F.when(here, F.col("k")).otherwise(0.0)) / total, 9)
        best = votes.groupBy("id", "own", "k").agg(F.min_by("label", F.struct(-score, "label")).alias("best"), F.max(score).alias("high"), F.max(F.when(here, score)).alias("stay"))
        better = F.col("high") > F.col("stay")
        new = best.select("id", F.when(better, F.col("best")).otherwise(F.col("own")).alias("label"), "k", better.alias("moved"))
        label = store(new.unionByName(label.filter(~turn).withColumn("moved", F.lit(False))), "labels")
        still = 0 if label.filter("moved").limit(1).count() else still + 1
        if still == 2:
            break
    return label.select("id", "label")


def _pairs(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b, w) of node ids; loops are left out."""
    a, b = node_id("src"), node_id("dst")
    return store(edges.filter("src <> dst").groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum("weight").alias("w")), "pairs")


def _named(edges: DataFrame, label: DataFrame) -> DataFrame:
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("id", node_id("node"))
    return names.join(label, "id").select("node", "label")


def label_propagation(edges: DataFrame, rounds: int = 12) -> DataFrame:
    """(node, label): nodes take the label of largest total weight around them."""
    edges = store(edges.select("src", "dst", "weight"), "edges")
    return _named(edges, _moves(_pairs(edges), 0.0, rounds))


def _louvain(pairs: DataFrame, rounds: int, levels: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, label) by the Louvain method, and the graph of groups of the last level with its labels.

    Labels only move along edges, so nodes of one label are of one component, at each level.
    """
    label = _moves(pairs, 1.0, rounds)
    group = label
    for _ in range(levels - 1):
        nodes = group.count()
        of = [_if_few(group.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")), nodes) for c in "ab"]
        merged = pairs.join(of[0], "a").join(of[1], "b").groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.sum("w").alias("w"))
        pairs = store(merged, "pairs")
        group = _moves(pairs, 1.0, rounds)  # ids are the labels below
        if group.filter("id <> label").isEmpty():
            break
        label = store(label.join(group.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", F.col("up").alias("label")), "labels")
    return label, pairs, group


def modularity_moves(edges: DataFrame, rounds: int = 12, levels: int = 3) -> DataFrame:
    """(node, label) by the Louvain method: moves that gain modularity, then the same on the graph of the groups."""
    edges = store(edges.select("src", "dst", "weight"), "edges")
    return _named(edges, _louvain(_pairs(edges), rounds, levels)[0])


def _modularity(e: DataFrame) -> DataFrame:
    """One row with the weighted modularity of edges (ls, ld, weight) between labels."""
    inside = e.filter("ls = ld").groupBy(F.col("ls").alias("label")).agg(F.sum("weight").alias("inside"))
    ends = e.select(F.explode(F.array("ls", "ld")).alias("label"), "weight").groupBy("label").agg(F.sum("weight").alias("degree"))
    total = ends.agg(F.sum("degree").alias("m2"))
    rows = ends.join(inside, "label", "left").crossJoin(F.broadcast(total))  # total is one row
    return rows.agg(F.coalesce(F.sum(F.coalesce("inside", F.lit(0.0)) * 2 / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)), F.lit(0.0)).alias("modularity"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the weighted modularity of labels (node, label) over the undirected edges."""
    e = edges.filter("src <> dst").join(labels.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")
    return _modularity(e)


def communities(edges: DataFrame, rounds: int = 12, levels: int = 3) -> DataFrame:
    """(node, label): modularity moves, or connected components where their modularity is higher.

    Edges are worked out once. Components and both modularities come from the graph of groups: a group is of one
    component, and an edge within a group is a loop there, with its weight.
    """
    edges = store(edges.select("src", "dst", "weight"), "edges")
    label, top, group = _louvain(_pairs(edges), rounds, levels)
    whole = group.select("id").join(connected_components(top), "id", "left").select("id", F.coalesce("component", "id").alias("label"))

    def quality(of: DataFrame) -> float:
        la, lb = (of.select(F.col("id").alias(c), F.col("label").alias(name)) for c, name in (("a", "ls"), ("b", "ld")))
        return round(_modularity(top.join(la, "a").join(lb, "b").select("ls", "ld", F.col("w").alias("weight"))).first()[0], 12)

    if quality(group) < quality(whole):
        joined = label.join(whole.select(F.col("id").alias("label"), F.col("label").alias("component")), "label").select("id", "component")
        smallest = joined.groupBy("component").agg(F.min("id").alias("label"))
        label = joined.join(smallest, "component").select("id", "label")
    return _named(edges, label)


def _first_of(rows: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """(cluster, name): the n smallest values of each cluster in order, from distinct (cluster, value)."""
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(value))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).groupBy("cluster").agg(F.array_sort(F.collect_list(value)).alias(name))


def campaigns(members: DataFrame, events: DataFrame, top_creds: int = 3, most: int = 10, listed: int = 20) -> DataFrame:
    """One row per cluster of addresses (source_ip, cluster): id, events, addresses, protocol, top credentials, hashes and members.

    The id is a digest of all members, so it is the same whenever the members are; it comes from a tree of digests, and
    lists are cut to their length before the shuffle, so no task holds the members or hashes of a whole cluster.
    """
    members = members.select("source_ip", "cluster").distinct()
    clusters = set_digests(members, ["cluster"], "source_ip").select("cluster", F.substring("digest", 1, 16).alias("cluster_id"), F.col("members").alias("source_ip_count"))
    clusters = clusters.join(_first_of(members, "source_ip", listed, "members"), "cluster", "left")
    e = events.join(members, "source_ip")
    stats = e.groupBy("cluster").agg(
        F.count("*").alias("event_count"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.mode("protocol", True).alias("primary_protocol"),
    )
    hashes = _first_of(e.filter("file_hash IS NOT NULL").select("cluster", "file_hash").distinct(), "file_hash", most, "malware_hashes")
    stats = stats.join(hashes, "cluster", "left").withColumn("malware_hashes", F.coalesce("malware_hashes", F.array().cast("array<string>")))
    creds = e.filter("username <> '' AND password <> ''").groupBy("cluster", F.concat_ws(":", "username", "password").alias("cred")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), F.desc("cred")))
    creds = creds.withColumn("rank", rank).filter(F.col("rank") <= top_creds).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cred"))), lambda x: x.cred).alias("primary_creds"))
    return clusters.join(stats, "cluster").join(creds, "cluster", "left").withColumn("name", F.concat(F.lit("campaign-"), F.substring("cluster_id", 1, 8)))


def c2_lists(iocs: DataFrame, top: int = 20, each: int = 10) -> DataFrame:
    """One row: addresses and domains among the most frequent indicators of both types."""
    best = iocs.filter(F.col("ioc_type").isin("ip", "domain")).orderBy(F.desc("occurrence_count"), "ioc_type", "ioc_value").limit(top)
    of = lambda t: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("ioc_type") == t, F.struct((-F.col("occurrence_count")).alias("n"), "ioc_value")))), lambda x: x.ioc_value), 1, each)
    return best.agg(of("ip").alias("c2_ips"), of("domain").alias("c2_domains"))


def stability(old: DataFrame, new: DataFrame) -> DataFrame:
    """Jaccard similarity of the members of clusters (node, cluster) of two weeks, for clusters that share any."""
    a, b = old.select("node", F.col("cluster").alias("old")), new.select("node", F.col("cluster").alias("new"))
    both = a.join(b, "node").groupBy("old", "new").agg(F.count("*").alias("both"))
    rows = both.join(a.groupBy("old").agg(F.count("*").alias("na")), "old").join(b.groupBy("new").agg(F.count("*").alias("nb")), "new")
    return rows.select("old", "new", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def behaviour_profile(members: DataFrame, events: DataFrame) -> DataFrame:
    """Per cluster: ports, credentials, downloads and a label of what it does most."""
    e = events.join(members, "source_ip")
    rows = e.groupBy("cluster").agg(
        F.countDistinct("dest_port").alias("ports"), F.count_distinct(F.when(F.col("username").isNotNull(), F.struct("username", "password"))).alias("creds"),
        F.count_if(F.col("command_str").rlike("wget|curl|tftp")).alias("download_commands"), F.count_if(F.col("event_type").startswith("login")).alias("logins"),
    )
    return rows.withColumn("behaviour", F.when(F.col("download_commands") > 0, "botnet_loader").when(F.col("logins") > 100, "brute_force").when(F.col("ports") > 5, "scanner").otherwise("other"))
