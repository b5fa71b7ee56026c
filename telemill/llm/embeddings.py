"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

Vectors of one label are dealt to the shards of their OVERLAP nearest leaders (a bounded sample of which no two are
close). Where a label asks for more leaders than one task should hold, its shards are dealt again to leaders of their
own, so that leaders grow with the label; each vector stays with its nearest leaders of all. In a shard each vector gets a robust-pruned list of neighbours; lists of a vector from several shards are
united. From the medoid of a shard a greedy walk goes to each query, then expands through every vector within range,
and cosines are verified in double precision. A shard with more vectors than fit in a task is cut into blocks, and
each pair of blocks is searched by itself, so one dense group is spread over many tasks. A link is counted in the first
shard that its ends share; no pairs of vectors leave a task, only counts and the root of each local component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import ship, told_apart
from telemill.operators.components import connected_components
from telemill.plans.storage import store

#: Vectors for each leader, leaders that a label or shard is dealt to at once, vectors sampled for each leader.
PER_LEADER, LEADERS, SAMPLED = 400, 1024, 4
#: Shards that a vector goes to; audit() says what recall that gives.
OVERLAP = 3
#: Vectors that are dealt to leaders together.
PART = 4000
#: Vectors in a block; a task holds two blocks.
BLOCK = 1000
#: Neighbours of a vector, slack of the pruning rule, walk width.
DEGREE, SLACK, WIDTH = 16, 1.2, 8
#: Leaders are at most this alike, so that a dense group has one leader.
APART = 0.8


def valid_unit(v: np.ndarray | None) -> np.ndarray | None:
    """The vector over its norm in double precision; None where it is null, zero or not finite."""
    if v is None:
        return None
    v = np.array([np.nan if x is None else x for x in v], np.float64)
    norm = np.linalg.norm(v) if len(v) and np.isfinite(v).all() else 0.0
    if 0 < norm < np.inf:
        return v / norm
    big = np.abs(v).max() if len(v) and np.isfinite(v).all() else 0.0
    return None if not big else (v / big) / np.linalg.norm(v / big)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        unit = [valid_unit(v) for v in batch.column(1).to_pylist()]
        keep = [k for k, u in enumerate(unit) if u is not None]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([unit[k].tobytes() for k in keep], pa.binary()), batch.column(2).take(pa.array(keep, pa.int64()))], ["vec_id", "unit", "label"])


def matrix(column) -> np.ndarray:
    raw = list(column)
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def robust_prune(sims: np.ndarray) -> np.ndarray:
    """Neighbours (n, DEGREE), -1 where fewer: from the closest on, one that is SLACK times nearer to a chosen neighbour than to the vector is left out."""
    n = len(sims)
    sims = sims.copy()
    np.fill_diagonal(sims, -2)
    k = min(n - 1, 4 * DEGREE)
    out = np.full((n, DEGREE), -1, np.int32)
    if k <= 0:
        return out
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
    gap = 1 - np.take_along_axis(sims, near, 1)
    alive, degree = np.ones((n, k), bool), np.zeros(n, int)
    for c in range(k):
        rows = np.flatnonzero(alive[:, c] & (degree < DEGREE))
        if not len(rows):
            continue
        chosen = near[rows, c]
        out[rows, degree[rows]] = chosen
        degree[rows] += 1
        between = 1 - sims[chosen[:, None], near[rows]]
        between[near[rows] == chosen[:, None]] = 2
        alive[rows] &= (SLACK * between > gap[rows]) | (np.arange(k) <= c)
    return out


def _searched(adjacent: list[np.ndarray], units: np.ndarray, medoid: int, q: int, limit: float) -> np.ndarray:
    """Vectors within range of q: a greedy walk from the medoid, then expansion through what is in range."""
    seen = np.zeros(len(units), bool)
    seen[[medoid, q]] = True
    target = units[q]
    best = [(float(units[medoid] @ target), medoid)]
    open_, found = [medoid], []
    if best[0][0] >= limit and medoid != q:
        found.append(np.array([medoid]))
    frontier = adjacent[q]  # the query is a vertex too
    done: set[int] = set()
    while True:
        new = frontier[~seen[frontier]]
        if len(new):
            new = np.unique(new)
            seen[new] = True
            s = units[new] @ target
            close = new[s >= limit]
            if len(close):
                found.append(close)
            best = sorted(best + list(zip(s.tolist(), new.tolist(), strict=True)), reverse=True)[:WIDTH]
            if len(close):
                frontier = np.concatenate([adjacent[v] for v in close])
                done.update(close.tolist())
                continue
        step = next((v for _, v in best if v not in done), None)
        if step is None or (found and best[0][1] in done and best[0][0] >= limit):
            break
        done.add(step)
        frontier = adjacent[step]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _graph(rows: pd.DataFrame) -> pd.DataFrame:
    """Neighbour lists of the vectors of one task."""
    units, ids = matrix(rows["unit"]), rows["vec_id"].to_numpy()
    lists = robust_prune(units @ units.T)
    return pd.DataFrame({"vec_id": ids, "near": [ids[x[x >= 0]] for x in lists]})


def _links(limit: float):
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        """(vec_id, links counted here, smallest id of its component here)."""
        rows = rows.drop_duplicates("vec_id").reset_index(drop=True)
        units, ids, weight = matrix(rows["unit"]), rows["vec_id"].to_numpy(), rows["copies"].to_numpy()
        block, two = rows["block"].to_numpy(), rows["i"].iloc[0] != rows["j"].iloc[0]
        homes, here = [set(x) for x in rows["homes"]], rows["home"].iloc[0]
        number = {v: k for k, v in enumerate(ids.tolist())}
        adjacent = [np.array([number[v] for v in near if v in number], np.int64) for near in rows["near"]]
        back: list[list[int]] = [[] for _ in ids]
        for k, near in enumerate(adjacent):
            for v in near:
                back[v].append(k)
        adjacent = [np.unique(np.concatenate([a, np.array(b, np.int64)])) for a, b in zip(adjacent, back, strict=True)]
        medoid = int(np.argmax(units @ units.mean(0)))
        n, pairs = len(ids), []
        for q in range(n):
            near = _searched(adjacent, units, medoid, q, limit)
            near = near[units[near] @ units[q] >= limit]  # verified
            if two:
                near = near[block[near] != block[q]]  # others are counted where the block is alone
            # counted and joined in the first shard that both have
            near = np.array([v for v in near.tolist() if here == min(homes[v] & homes[q])], np.int64)
            pairs.append(np.minimum(near, q) * n + np.maximum(near, q))
        # a link counts for both ends, whichever walk has met it
        pairs = np.unique(np.concatenate(pairs))
        first, second = pairs // n, pairs % n
        count = np.zeros(n, np.int64)
        np.add.at(count, first, weight[second])
        np.add.at(count, second, weight[first])
        root = np.arange(n)
        for a, b in zip(first.tolist(), second.tolist(), strict=True):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            low, high = (a, b) if ids[a] < ids[b] else (b, a)
            root[high] = low
        for k in range(len(ids)):
            while root[root[k]] != root[k]:
                root[k] = root[root[k]]
        return pd.DataFrame({"vec_id": ids, "n": count, "root": ids[root]})

    return links


def _leaders(sample: pd.DataFrame) -> pd.DataFrame:
    """Leaders of one cell: of its sampled vectors in order, those not closer than APART to one before."""
    sample = sample.sort_values(["place", "vec_id"])
    units, most, chosen = matrix(sample["unit"]), int(sample["most"].iloc[0]), []
    for k in range(len(units)):
        if len(chosen) < most and (not chosen or (units[chosen] @ units[k]).max() < APART):
            chosen.append(k)
    return pd.DataFrame({"label": sample["label"].iloc[0], "cell": sample["cell"].iloc[0], "leaders": [[sample["unit"].iloc[k] for k in chosen]]})


_DEALT = "vec_id long, unit binary, label string, copies long, all long, capped boolean, homes array<struct<cosine: double, cell: string>>"


def _deal(overlap: int):
    def deal(rows: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        """rows with homes: their nearest leaders, named below their cell."""
        columns = ["vec_id", "unit", "label", "copies", "all", "capped", "homes"]
        if rows.empty:
            return pd.DataFrame({c: [] for c in columns})
        cosine, cell = matrix(rows["unit"]) @ matrix(leaders["leaders"].iloc[0]).T, rows["cell"].iloc[0]
        near = np.argsort(-cosine, axis=1, kind="stable")[:, :overlap]
        homes = [[{"cosine": c[k], "cell": f"{cell}/{k}"} for k in n] for c, n in zip(cosine, near.tolist(), strict=True)]
        return rows.assign(homes=homes)[columns]

    return deal


def _level(rows: DataFrame, sizes: DataFrame, level: int, overlap: int, leaders: int) -> DataFrame:
    """rows (vec_id, unit, label, copies, cell) dealt to leaders of their cell; sizes has (label, cell, all).

    capped: the cell asked for more leaders than it got.
    """
    # below the first level a vector is in ``overlap`` cells, of which it leaves all but ``overlap`` shards in the end
    want = F.ceil(F.col("all") / (PER_LEADER * (overlap if level else 1)))
    sizes = sizes.select("label", "cell", "all", F.least(want, F.lit(leaders)).cast("int").alias("most"), (want > leaders).alias("capped"), F.ceil(F.col("all") / PART).cast("int").alias("parts"))
    rows = rows.join(sizes, ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    # about SAMPLED vectors for each leader: a vector is in by its hash
    place = F.pmod(F.xxhash64("vec_id", F.lit(level + 1)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = rows.withColumn("place", place).filter(F.col("place") <= F.greatest(F.col("most") * SAMPLED, F.lit(64)) / F.col("all"))
    lead = sample.select("vec_id", "unit", "label", "cell", "most", "place").groupBy("label", "cell").applyInPandas(_leaders, "label string, cell string, leaders array<binary>")
    lead = lead.join(sizes.select("label", "cell", "parts"), ["label", "cell"]).select("label", "cell", "leaders", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = rows.select("vec_id", "unit", "label", "copies", "cell", "all", "capped", "part").groupBy("label", "cell", "part").cogroup(lead.groupBy("label", "cell", "part"))
    return own.applyInPandas(_deal(overlap), _DEALT)


def _dealt(reps: DataFrame, overlap: int, leaders: int) -> DataFrame:
    """reps (vec_id, unit, label, copies) with homes: names of the ``overlap`` shards of their nearest leaders.

    Cells that came from one with too few leaders, and are much smaller than it, are dealt again; a cell that leaders do
    not divide is left to the blocks.
    """
    rows, ready, level = reps.withColumn("cell", F.lit("")), [], 0
    sizes = store(rows.groupBy("label", "cell").agg(F.count("*").alias("all")), "cells")
    while True:
        dealt = store(_level(rows, sizes, level, overlap, leaders), "dealt")
        one = dealt.select("vec_id", "unit", "label", "copies", "all", "capped", F.explode("homes").alias("home")).select("*", "home.cosine", "home.cell").drop("home")
        size = one.filter("capped").groupBy("label", "cell").agg(F.count("*").alias("n"), F.first("all").alias("all"))
        sizes = store(size.filter((F.col("n") > PER_LEADER * overlap) & (F.col("n") * 4 <= F.col("all") * 3)).select("label", "cell", F.col("n").alias("all")), "cells")
        if sizes.isEmpty():
            break
        ready.append(one.join(sizes.select("label", "cell"), ["label", "cell"], "left_anti").select("vec_id", "cosine", "cell"))
        rows = store(one.drop("all", "capped", "cosine").join(sizes.select("label", "cell"), ["label", "cell"]), "cells")
        level += 1
    if not level:
        return dealt.select("vec_id", "unit", "label", "copies", F.col("homes.cell").alias("homes"))
    near = one.select("vec_id", "cosine", "cell")
    for more in ready:
        near = near.unionByName(more)
    # a vector has at most ``overlap`` homes a cell in each level
    best = F.slice(F.sort_array(F.collect_list(F.struct("cosine", "cell")), False), 1, overlap)
    return store(near.groupBy("vec_id").agg(best["cell"].alias("homes")).join(reps, "vec_id").select("vec_id", "unit", "label", "copies", "homes"), "dealt")


def _tasks(dealt: DataFrame) -> DataFrame:
    """Rows of (label, home, i, j): each shard, or each pair of its blocks."""
    one = dealt.select("*", F.explode("homes").alias("home"))
    size = one.groupBy("label", "home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("wide"))
    one = one.join(size, ["label", "home"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("wide")).cast("int"))
    # a pair of equal blocks is a block alone; with two blocks in all, the pair holds the shard
    other = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    return one.select("*", F.explode(other).alias("at")).select("*", "at.i", "at.j").drop("at", "wide")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, overlap: int = OVERLAP, leaders: int = LEADERS) -> DataFrame:
    """Links of vectors of equal label with cosine at least ``threshold``, in double precision.

    vectors has (vec_id, embedding array of floats, label). Vectors that are null, empty, zero or hold
    null or infinite components, and those with a null label, link with nothing; those of different lengths do not link.
    Returns one row per vector: vec_id,
    n_links (other vectors linked with it), component_id (smallest vec_id that links reach), kept (vec_id =
    component_id). Equal vectors of a label are one vertex of the graph with its number of copies; all of them link. Rows
    that repeat a vec_id, or have none, are told apart by numbers and compared like others, and of a
    class's rows with its smallest vec_id one is kept (of null ids only if it has no other; its component_id is null). An
    empty table gives an empty result. Leaders are fitted on about ``leaders`` * SAMPLED vectors of a label, or of
    each shard of a label that needs more leaders than that; every vector is indexed. Recall is that of the walk and of the shards: see audit().
    """
    spark = vectors.sparkSession
    ship(spark)
    every = told_apart(vectors, "vec_id", "embedding", _label())
    rows = every.withColumnRenamed("row", "vec_id").select("vec_id", "embedding", "label")
    units = store(rows.filter("label IS NOT NULL AND embedding IS NOT NULL").mapInArrow(_units, "vec_id long, unit binary, label string"), "units")
    classes = units.groupBy("label", F.sha2("unit", 256).alias("same")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = store(classes, "same")
    reps = units.withColumnRenamed("vec_id", "rep").join(classes.select("rep", "copies"), "rep").withColumnRenamed("rep", "vec_id")
    dealt = _dealt(reps, overlap, leaders)
    task = ["label", "home", "i", "j"]
    rows = _tasks(dealt)
    graph = rows.select(*task, "vec_id", "unit").groupBy(*task).applyInPandas(_graph, "vec_id long, near array<long>")
    graph = store(graph.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    found = rows.join(graph, "vec_id").groupBy(*task).applyInPandas(_links(threshold), "vec_id long, n long, root long")
    found = store(found, "found")
    groups = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    count = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    known = classes.join(count.withColumnRenamed("vec_id", "rep"), "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("label", "same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    own = units.select("vec_id", "label", F.sha2("unit", 256).alias("same")).join(known, ["label", "same"]).select(F.col("vec_id").alias("row"), "n", "c")
    out = store(every.select("row", "own_id").join(own, "row", "left").withColumn("c", F.coalesce("c", "row")), "found")
    head = F.min(F.struct(F.col("own_id").isNull().alias("none"), "own_id", "row")).alias("head")
    out = out.join(out.groupBy("c").agg(head), "c")
    return out.select(F.col("own_id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.col("head.own_id").alias("component_id"), (F.col("head.row") == F.col("row")).alias("kept"))


def _label() -> Column:
    """What vectors must have in common to be compared: label and length."""
    return F.concat(F.size("embedding").cast("string"), F.lit(":"), F.col("label").cast("string")).alias("label")


def audit(vectors: DataFrame, found: DataFrame, threshold: float = 0.93, every: int = 50) -> DataFrame:
    """Recall of ``found`` (from near_vectors) for the queries whose vec_id is divisible by ``every``: (queries, links, found, recall).

    Queries meet the vectors of their label in a join, cosines are taken in blocks of rows; nothing is collected.
    """
    ship(vectors.sparkSession)
    units = vectors.select(F.col("vec_id").cast("long"), "embedding", _label()).filter("label IS NOT NULL AND embedding IS NOT NULL").mapInArrow(_units, "vec_id long, unit binary, label string")
    queries = units.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), F.col("unit").alias("target"), "label")

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.einsum("ij,ij->i", matrix(batch.column(1).to_pylist()), matrix(batch.column(3).to_pylist())) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["vec_id"]).filter(pa.array(near))

    true = queries.join(units, "label").filter("q <> vec_id").select("q", "target", "vec_id", "unit").mapInArrow(cosines, "vec_id long")
    count = true.groupBy("vec_id").agg(F.count("*").alias("true"))
    both = queries.select(F.col("q").alias("vec_id")).join(count, "vec_id", "left").join(found.select("vec_id", "n_links"), "vec_id")
    return both.agg(F.count("*").alias("queries"), F.sum(F.coalesce("true", F.lit(0))).alias("links"), F.sum(F.least("n_links", F.coalesce("true", F.lit(0)))).alias("found")).withColumn("recall", F.when(F.col("links") > 0, F.col("found") / F.col("links")).otherwise(1.0))
