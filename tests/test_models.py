"""Communities, label propagation and the risk model against plain Python, where SQL has no twin."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from telemill.operators import graph, scoring

EDGES = "src string, dst string, edge_type string, weight double"


def undirected(edges):
    """Weight of each pair of different ends."""
    w = defaultdict(float)
    for a, b, _, x in edges:
        if a != b:
            w[min(a, b), max(a, b)] += x
    return w


def modularity(w, label):
    total, inside, degree = sum(w.values()), defaultdict(float), defaultdict(float)
    for (a, b), x in w.items():
        degree[label[a]] += x
        degree[label[b]] += x
        if label[a] == label[b]:
            inside[label[a]] += x
    return sum(inside[c] / total - (degree[c] / (2 * total)) ** 2 for c in degree)


def partitions(nodes):
    """Every partition of a few nodes, as labels."""
    if not nodes:
        yield {}
        return
    for rest in partitions(nodes[1:]):
        for c in range(max(rest.values(), default=-1) + 2):
            yield {nodes[0]: c, **rest}


def random_edges(seed, n=7):
    rng = random.Random(seed)
    pairs = rng.sample(list(itertools.combinations("abcdefg"[:n], 2)), 10)
    return [(a, b, "e", float(rng.randrange(1, 4))) for a, b in pairs] + [("a", "a", "e", 5.0), (pairs[0][1], pairs[0][0], "e", 1.0)]


@pytest.mark.parametrize("seed", range(2))
def test_communities_come_near_the_best_partition(spark, seed):
    edges = random_edges(seed)
    df, w = spark.createDataFrame(edges, EDGES), undirected(edges)
    labels = graph.communities(df)
    label = {r.node: r.label for r in labels.collect()}
    assert set(label) == {x for pair in w for x in pair}
    got = modularity(w, label)
    assert abs(graph.modularity(df, labels).first().modularity - got) < 1e-9
    best = max(modularity(w, p) for p in partitions(sorted(label)))
    assert got >= best - 0.05 and got <= best + 1e-9


def test_label_propagation_is_the_rule_step_by_step(spark):
    """Half of the nodes, by a hash of node and round, take the label of largest weight around them (the smallest of equals)."""
    edges = random_edges(5)
    w, rounds = undirected(edges), 12
    nodes = sorted({x for pair in w for x in pair})
    rows = spark.createDataFrame([(n,) for n in nodes], "node string").select("node", graph.node_id("node").alias("id"), *[F.pmod(F.xxhash64(graph.node_id("node"), F.lit(k)), F.lit(2)).alias(f"t{k}") for k in range(rounds)]).collect()
    number, turn = {r.node: r.id for r in rows}, {r.id: [r[f"t{k}"] == 0 for k in range(rounds)] for r in rows}
    near = defaultdict(dict)
    for (a, b), x in w.items():
        near[number[a]][number[b]] = near[number[b]][number[a]] = x
    label, still = {i: i for i in near}, 0
    for k in range(rounds):
        new = dict(label)
        for i in near:
            votes = defaultdict(float, {label[i]: 0.0})
            for j, x in near[i].items():
                votes[label[j]] += x
            best = min(votes, key=lambda c: (-votes[c], c))
            if turn[i][k] and votes[best] > votes[label[i]]:
                new[i] = best
        still = 0 if new != label else still + 1
        label = new
        if still == 2:
            break
    assert {r.node: r.label for r in graph.label_propagation(spark.createDataFrame(edges, EDGES), rounds).collect()} == {n: label[i] for n, i in number.items()}


def test_risk_model_is_the_penalised_maximum_likelihood(spark):
    """Newton's method on scaled training rows, and the area under the curve by counting pairs of held-out rows."""
    from telemill.plans.adapters import Tables

    t, columns = Tables(spark, SF), ["ports", "weeks", "proxy", "iot"]
    f = scoring.ip_features(t.attacks, t.devices).withColumn("label", (F.pmod(F.xxhash64("ip"), F.lit(5)) + F.col("weeks") % 7 > 5).cast("int"))
    model, auc = scoring.risk_model(f, "label", columns)
    rows = f.select(*columns, "label", F.pmod(F.xxhash64("ip", F.lit(7)), F.lit(10)).alias("fold")).toPandas()
    x, y, train = rows[columns].to_numpy(float), rows["label"].to_numpy(float), (rows["fold"] < 7).to_numpy()
    assert 10 < y.sum() < len(y) - 10
    spread = x[train].std(0, ddof=1)
    z = np.divide(x - x[train].mean(0), spread, out=np.zeros_like(x), where=spread > 0)
    a, w = np.c_[z[train], np.ones(train.sum())], np.zeros(len(columns) + 1)
    penalty = np.array([0.01] * len(columns) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(a) + np.diag(penalty + 1e-12), a.T @ (p - y[train]) / len(a) + penalty * w)
        w -= step
    got = model.stages[-1]
    assert np.allclose(got.coefficients.toArray(), w[:-1], atol=2e-3) and abs(got.intercept - w[-1]) < 2e-3
    score, held = z[~train] @ w[:-1], y[~train]
    pairs = np.sign(score[held == 1][:, None] - score[held == 0][None]) / 2 + 0.5
    assert abs(auc - pairs.mean()) < 2e-3


def test_risk_model_after_an_observation(spark):
    """A session that has observed counts, as the run log does, can fit, evaluate and apply a model."""
    from pyspark.sql import Observation

    rows = spark.range(500).select(F.col("id").cast("string").alias("ip"), (F.col("id") % 7).alias("a"), (F.xxhash64("id") % 5 + F.col("id") % 7 > 4).cast("int").alias("y"))
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    model, auc = scoring.risk_model(rows, "y", ["a"])
    assert seen.get == {"n": 500} and 0.5 < auc <= 1 and model.transform(rows).filter("prediction IN (0, 1)").count() == 500


def plain_moves(w, turn, rounds=12):
    """Labels of the nodes of w, (a, b) to weight, moved as graph._moves says with gamma 1."""
    near, degree = defaultdict(dict), defaultdict(float)
    for (a, b), x in w.items():
        degree[a] += x
        degree[b] += x
        if a != b:
            near[a][b] = near[b][a] = x
    total, label, still = sum(degree.values()), {i: i for i in degree}, 0
    for n in range(rounds):
        sums, new = defaultdict(float), dict(label)
        for i, k in degree.items():
            sums[label[i]] += k
        for i, k in degree.items():
            votes = defaultdict(float, {label[i]: 0.0})
            for j, x in near[i].items():
                votes[label[j]] += x
            score = {c: round(v - k * (sums[c] - (k if c == label[i] else 0.0)) / total, 9) for c, v in votes.items()}
            best = min(score, key=lambda c: (-score[c], c))
            if turn[i][n] and score[best] > score[label[i]]:
                new[i] = best
        still, label = (0 if new != label else still + 1), new
        if still == 2:
            break
    return label


def plain_communities(w, turn):
    """The moves on three levels, or components if their modularity is higher."""
    label = plain_moves(w, turn)
    group, level = label, w
    for _ in range(2):
        merged = defaultdict(float)
        for (a, b), x in level.items():
            merged[min(group[a], group[b]), max(group[a], group[b])] += x
        level, group = merged, plain_moves(merged, turn)
        label = {i: group[c] for i, c in label.items()}
        if all(c == g for c, g in group.items()):
            break
    whole = {i: i for i in label}
    for _ in label:
        for a, b in w:
            whole[a] = whole[b] = min(whole[a], whole[b])
    return label if round(modularity(w, label), 12) >= round(modularity(w, whole), 12) else whole


def planted(seed, groups=3, size=9):
    """Groups of which some are connected to others by few edges, some by many, and a pair of nodes on their own."""
    rng, edges = random.Random(seed), [("x", "y", "e", 1.0), ("z", "z", "e", 2.0)]
    for g in range(groups):
        nodes = [f"{g}-{i}" for i in range(size)]
        edges += [(a, b, "e", float(rng.randrange(1, 4))) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.4]
    return edges + [(f"0-{rng.randrange(size)}", f"1-{rng.randrange(size)}", "e", 1.0) for _ in range(rng.choice((0, 3, 25)))]


@pytest.mark.parametrize(("few", "seed"), [(0, 1), (1_000_000, 2)])
def test_communities_are_the_rule_step_by_step(spark, monkeypatch, few, seed):
    """Labels that are joined by a shuffle or broadcast, groups that are moved or left as components."""
    monkeypatch.setattr(graph, "FEW_NODES", few)
    edges = planted(seed)
    w = undirected(edges)
    nodes = spark.createDataFrame([(n,) for n in sorted({x for pair in w for x in pair})], "node string").withColumn("id", graph.node_id("node"))
    rows = nodes.select("node", "id", *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 0).alias(f"t{k}") for k in range(12)]).collect()
    number, turn = {r.node: r.id for r in rows}, {r.id: [r[f"t{k}"] for k in range(12)] for r in rows}
    by_number = defaultdict(float)
    for (a, b), x in w.items():
        by_number[min(number[a], number[b]), max(number[a], number[b])] += x
    want = plain_communities(by_number, turn)
    assert {r.node: r.label for r in graph.communities(spark.createDataFrame(edges, EDGES)).collect()} == {n: want[i] for n, i in number.items()}


def test_components_are_the_communities_where_they_are_better(spark):
    """Without a round of moves each node is on its own, so the components win: each has the smallest id in it."""
    edges = planted(3)
    df = spark.createDataFrame(edges, EDGES)
    assert {(r.node, r.label) for r in graph.communities(df, rounds=0).collect()} == {(r.node, r.component) for r in graph.components(df).collect()}


@pytest.mark.parametrize("of", ["communities", "label_propagation"])
def test_edges_are_worked_out_once(spark, of):
    """They are counted as they pass."""
    passed = spark.sparkContext.accumulator(0)

    def seen(x):
        passed.add(1)
        return x

    edges = planted(2)
    df = spark.createDataFrame(edges, EDGES).withColumn("weight", F.udf(seen, "double")("weight")).withColumn("src", F.when(F.col("weight") > 0, F.col("src")))
    getattr(graph, of)(df).collect()
    assert passed.value == len(edges)


def test_events_are_read_once_for_all_signals(spark):
    """One scan for downloads, files and fingerprints, and one for credentials."""
    from telemill.plans.adapters import Tables

    plan = graph.graph_edges(Tables(spark, SF).attacks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
