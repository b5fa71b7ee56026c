"""Ordered ranges, digests of sets, heavy credentials and long sessions against plain Python."""

import datetime
import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from telemill.operators import classify, graph, linkage, scoring
from telemill.operators.components import connected_components
from telemill.operators.ranges import in_ranges, numbered_runs, running_sum, set_digests
from telemill.sources import logs


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(40), rng.randrange(1, 9)) for _ in range(n)]


def test_running_sum_of_a_group_in_many_ranges(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    assert in_ranges(df, ["g"], ["o"]).filter("g = 'a'").select("_range").distinct().count() > 1
    want = []
    for g in {r[0] for r in rows}:
        total = 0
        for _, o, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]):
            want.append((g, o, v, total))
            total += v
    got = running_sum(df, ["g"], ["o", "v"], F.col("v"), "before")
    assert got.columns == ["g", "o", "v", "before"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    some = running_sum(df, ["g"], ["o", "v"], F.col("v"), "before", below=60).collect()
    assert sorted(map(tuple, some), key=str) == sorted((w for w in want if w[3] < 60), key=str)
    assert running_sum(df.limit(0), ["g"], ["o"], F.col("v"), "before").count() == 0


def test_budget_of_a_port(spark):
    df = spark.createDataFrame([(f"203.0.113.{k}", 23, "x" * (k % 7)) for k in range(200)] * 2, "ip string, port int, banner string")
    kept = logs.within_budget(df, 3000, size=F.length("banner") + 10)
    total = 0
    for ip, banner in sorted((f"203.0.113.{k}", "x" * (k % 7)) for k in range(200) for _ in range(2)):
        if total >= 3000:
            break
        total += len(banner) + 10
    assert kept.agg(F.sum(F.length("banner") + 10)).first()[0] == total and kept.columns == df.columns


def test_runs_are_numbered_across_ranges(spark):
    rng = random.Random(2)
    rows = sorted({(rng.choice("aab"), rng.randrange(3000)) for _ in range(500)})
    want = []
    for g in "ab":
        run, place, before = -1, 0, None
        for t in (t for x, t in rows if x == g):
            if before is None or t - before >= 15:
                run, place = run + 1, -1
            place, before = place + 1, t
            want.append((g, t, run, place))
    df = spark.createDataFrame(rows, "g string, t int").repartition(5)
    got = numbered_runs(df, ["g"], ["t"], ["t"], F.col("t") - F.col("previous.t") >= 15, "run", "place")
    assert sorted((r.g, r.t, r.run, r.place) for r in got.collect()) == sorted(want)


def test_chains_are_cut_by_gaps_and_length(spark):
    start = datetime.datetime(2026, 4, 20)
    rows = [("sensor", k, start + datetime.timedelta(seconds=10 * k + (7200 if k >= 25 else 0)), ["uname", "wget x", "rm -rf /"][k % 3]) for k in range(60)] + [("s", 100, start, "uname"), ("s", 101, start, None), (None, 102, start, "uname")]
    df = spark.createDataFrame(rows, "session_id string, record_id long, event_time timestamp, command_str string")
    name = ["recon", "downloader", "cleanup"]
    want = defaultdict(int)
    for a, b in ((0, 20), (20, 25), (25, 45), (45, 60)):
        want[">".join(name[k % 3] for k in range(a, b))] += 1
    want["recon"] += 1
    assert {r.chain: r.sessions for r in scoring.command_chains(df, longest=20).collect()} == want


def test_digest_depends_on_the_set_alone(spark):
    def brute(members, levels=2):
        hashes = sorted(hashlib.sha256(m.encode()).hexdigest() for m in set(members))
        at = [(h[: 2 * levels], h) for h in hashes]
        for level in range(levels, -1, -1):
            groups = defaultdict(list)
            for place, digest in sorted(at):
                groups[place[: 2 * level]].append(digest)
            at = [(place, hashlib.sha256("".join(ds).encode()).hexdigest()) for place, ds in groups.items()]
        return at[0][1]

    sets = {"x": [f"203.0.113.{k}" for k in range(250)], "y": ["a"], "z": [f"203.0.113.{k}" for k in range(249)]}
    df = spark.createDataFrame([(c, m) for c, ms in sets.items() for m in ms * 2] + [("x", None)], "cluster string, m string")
    one, two = ({r.cluster: (r.digest, r.members) for r in set_digests(d, ["cluster"], "m").collect()} for d in (df, df.repartition(9).orderBy(F.desc("m"))))
    assert one == two == {c: (brute(ms), len(ms)) for c, ms in sets.items()}


def test_campaign_lists_are_the_smallest(spark):
    start = datetime.datetime(2026, 4, 20)
    rows = [(f"203.0.113.{k:03d}", start + datetime.timedelta(minutes=k), "ssh", "root", "pw", f"{k % 15:064d}" if k % 2 else None) for k in range(60)]
    events = spark.createDataFrame(rows, "source_ip string, event_time timestamp, protocol string, username string, password string, file_hash string")
    members = events.select("source_ip", F.lit("c").alias("cluster"))
    c = graph.campaigns(members.union(members), events).collect()[0]
    assert c.members == [f"203.0.113.{k:03d}" for k in range(20)] and c.source_ip_count == c.event_count == 60
    assert c.malware_hashes == [f"{k:064d}" for k in range(10)] and c.primary_creds == ["root:pw"]


def test_heavy_credentials_are_hubs_with_the_same_connectivity(spark):
    rng = random.Random(4)
    rows = [(f"ip{rng.randrange(60)}", f"u{c}", "p") for c in range(8) for _ in range(rng.choice([1, 2, 3, 30]))] + [("lone", "own", "p"), ("x", "", "p"), (None, "u1", "p")]
    events = spark.createDataFrame(rows, "source_ip string, username string, password string")
    used = defaultdict(set)
    for ip, u, p in rows:
        if ip and u:
            used[u, p].add(ip)

    def classes(edges):
        ids = {n: k for k, n in enumerate(sorted({x for e in edges for x in e}))}
        found = {r.id: r.component for r in connected_components(spark.createDataFrame([(ids[a], ids[b]) for a, b in edges], "a long, b long")).collect()}
        groups = defaultdict(set)
        for n, k in ids.items():
            groups[found[k]].add(n)
        return {frozenset(x for x in g if not x.startswith("cred:")) for g in groups.values()}

    every = [(a, b) for ips in used.values() for a in ips for b in ips if a != b]
    for most in (1, 5, 1000):
        got = linkage.shared_credentials(events, most).collect()
        assert classes([(r.src, r.dst) for r in got]) == classes(every)
        assert len(got) <= most * sum(map(len, used.values()))
        assert {(r.src, r.dst) for r in got if r.kind == "pair"} == {(a, b) for ips in used.values() if len(ips) <= most for a in ips for b in ips if a != b}
        assert all(r.n == len(used[tuple(r.dst.split(":")[1:])]) > most for r in got if r.kind == "hub")


def test_second_ruleset(spark):
    rows = [("unknown", None, None, "OpenWrt 22.03"), ("unknown", None, None, "boa/0.94"), ("unknown", "smtp", None, ""), ("unknown", None, "iis", None), ("unknown", None, "aiist", None), ("camera", None, "nginx", None), ("unknown", None, None, "lede"), ("unknown", None, None, "dlink camera")]
    df = spark.createDataFrame([(*r[:3], None, r[3], 1) for r in rows], "device_type string, protocol string, http_server string, http_title string, raw_banner string, port int")
    assert [r.device_type for r in classify.reclassified(df).collect()] == ["router", "unknown", "server", "server", "unknown", "camera", "iot", "camera"]
