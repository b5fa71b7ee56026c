"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

Every distinct set of word shingles gets COORDINATES minwise tokens. A tree is a set of paths: at a node, a document
goes down by each coordinate that a hash of (path, coordinate) selects - 1/threshold of them on average - and its
child is named by the path, the coordinate and the document's minwise token there. Small nodes are compared
exhaustively, large ones with one of their documents, and branch again unless links have joined all their documents by
then, so a group of near copies costs about one comparison a document and not one a pair. From the second level on
nodes hold documents that are alike in several tokens; up to a size their full sets are compared exactly, larger ones
go on branching, and the last level compares what is left in blocks. A pair at the threshold shares one child on average
at the first level and FANOUT at every other (a Poisson number), so it survives to any depth with a probability that
survival() gives, and the number of independent trees is what RECALL asks for at the last level; a pair that is more
alike, or that others link, is missed less often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import BROADCAST_IDS, blocks, mix, only_ids, runs, ship, strings, told_apart, words
from telemill.operators.components import connected_components
from telemill.plans.storage import scope, store

SHINGLE = 5
COORDINATES = 64
#: Probability that a pair at the threshold, which no other document links, meets in some tree, whatever the depth.
RECALL = 0.999
#: Children that a pair at the threshold shares on average below the first level; above 1, so that survival has a bound.
FANOUT = 1.5
#: Documents of a node up to which all its pairs are compared.
SMALL = 16
#: Documents of a node up to which, from the second level on, full sets are compared, all with all.
MEDIUM = 4096
#: Levels of a tree; at the last one nodes of any size are compared, in blocks.
LEVELS = 6
#: Documents and shingles in a block; a task compares two blocks.
BLOCK = (1024, 500_000)
#: Share of minwise tokens that must agree before the full sets are compared, for a threshold of 0.75 and in proportion
#: for others. A pair at 0.75 has fewer with a probability of 2e-12 (binomial), below that of meeting 64-bit hashes.
ESTIMATE = 0.34

_ODD = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def survival(levels: int) -> float:
    """Probability that a pair at the threshold shares a node of one tree at that level (the first is 1)."""
    alive = 1.0
    for level in reversed(range(levels)):
        alive = 1 - math.exp(-(1.0 if level == 0 else FANOUT) * alive)
    return alive


def trees(recall: float, levels: int) -> int:
    """Trees that a pair at the threshold needs to be met with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each document the sorted distinct hashes of its SHINGLE-word shingles, ASCII lower-cased, and its number of words."""
    _, _, h, at = words(data, offsets, lower=True)
    g, out = runs(h, SHINGLE), []
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = b - a
        out.append(np.unique(g[a : b - SHINGLE + 1]) if n >= SHINGLE else runs(h[a:b], int(n)) if n else g[:0])
    return out, np.diff(at)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column(1))
        for i, j in blocks(offsets):
            sets, n_words = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            digest, signs = np.zeros((2, len(sets)), np.uint64), [b""] * len(sets)
            if len(full):
                every, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for k, salt in enumerate((0x51ED, 0xA7C3)):
                    digest[k, full] = np.add.reduceat(mix(every ^ np.uint64(salt)), bounds)
                low = np.stack([np.minimum.reduceat(every * m, bounds) for m in _ODD], 1) >> np.uint64(32)
                for row, k in zip(low.astype(np.uint32), full, strict=True):
                    signs[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(n_words, pa.int64()), pa.array(sizes), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array(signs, pa.binary())], ["row", "doc_id", "n_words", "n_shingles", "d1", "d2", "sign"])


def sketches(rows: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, n_shingles, d1, d2: a digest of the set, sign: its minwise tokens) of (row, doc_id, text)."""
    return rows.select("row", "text", F.col("doc_id").cast("long")).mapInArrow(_sketch, "row long, doc_id long, n_words long, n_shingles long, d1 long, d2 long, sign binary")


def _branch(share: float):
    limit = np.uint64(min(int(2.0**64 * share), (1 << 64) - 1))
    steps = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (rep, path, sign): a row for each child."""
        for batch in batches:
            path = batch.column(1).to_numpy().view(np.uint64)
            for a in range(0, len(path), 20_000):
                p = path[a : a + 20_000]
                sign = np.frombuffer(b"".join(batch.column(2)[a : a + len(p)].to_pylist()), np.uint32).reshape(len(p), COORDINATES)
                row, c = np.nonzero(mix(p[:, None] ^ steps[None, :]) < limit)
                child = mix(p[row] + steps[c] * np.uint64(3)) ^ mix(sign[row, c].astype(np.uint64) + steps[c])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + len(p)].take(pa.array(row)), pa.array(child.view(np.int64))], ["rep", "path"])

    return branch


def _children(rows: DataFrame, threshold: float, fanout: float) -> DataFrame:
    return rows.mapInArrow(_branch(fanout / (threshold * COORDINATES)), "rep long, path long")


def _first_children(reps: DataFrame, threshold: float, roots: list[int]) -> DataFrame:
    """What _children() gives at the first level, where every document is at every root, from each (rep, sign) once."""
    limit, steps = np.uint64(int(2.0**64 / (threshold * COORDINATES))), mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))
    chosen = [(p, c) for p in np.array(roots, np.int64).view(np.uint64) for c in np.flatnonzero(mix(p ^ steps) < limit)]

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sign = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, COORDINATES)
            for p, c in chosen:
                child = mix(p + steps[c : c + 1] * np.uint64(3)) ^ mix(sign[:, c].astype(np.uint64) + steps[c])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(child.view(np.int64))], ["rep", "path"])

    return reps.select("rep", "sign").mapInArrow(branch, "rep long, path long")


def _beside(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has at most BROADCAST_IDS rows; a larger one is for a shuffle join, which can split a hot key."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def _nodes(rows: DataFrame) -> DataFrame:
    """Documents of nodes that have company: (path, rep, n, pivot).

    Rows and nodes are tables, so the join is of two plain scans and a node with very many documents can be split.
    """
    rows = store(rows, "children")
    node = rows.groupBy("path").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep")).alias("pivot")).filter("n > 1")
    return rows.join(_beside(store(node, "nodes")), "path")


def _alike(least: float):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, COORDINATES) for k in (2, 3))
            keep = pa.array((x == y).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return alike


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column(1))
        for i, j in blocks(offsets):
            sets, _ = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())], ["row", "tokens"])


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    for k in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("rep").alias(k), F.col("sign").alias(f"sign_{k}"), F.col("n_shingles").alias(f"n_{k}")), k)
    pairs = pairs.filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "sign_a", "sign_b")
    with scope(docs.sparkSession) as keep:
        pairs = store(pairs.mapInArrow(_alike(ESTIMATE * percent / 75), "a long, b long"), "pairs")
        ids = store(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "ids")
        sets = only_ids(docs.select("row", "text"), "row", ids, ids.count()).mapInArrow(_sets, "row long, tokens binary")
        full = pairs
        for k in ("b", "a"):
            full = full.join(sets.select(F.col("row").alias(k), F.col("tokens").alias(f"set_{k}")), k)
        return keep(store(full.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"), "links"))


def _exhaust(percent: int):
    def exhaust(rows: pa.Table) -> pa.Table:
        """Links that join all documents of a node which are connected within it, from exact intersections of every pair."""
        ids, raw = rows.column("rep").to_numpy(), rows.column("tokens").to_pylist()
        component = rows.column("component").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        size = np.array([len(x) for x in sets])
        found: list[tuple[int, int]] = []
        if len(ids) > 1 and component.min() < component.max():
            _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(ids)), size)
            shared = np.flatnonzero(times[token] > 1)
            column = (np.cumsum(times > 1) - 1)[token[shared]]
            order = np.argsort(column, kind="stable")
            row, column = row[shared][order], column[order]
            both = np.zeros((len(ids), len(ids)), np.float32)
            for a in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
                lo, hi = np.searchsorted(column, [a, a + 2048])
                part = np.zeros((len(ids), 2048), np.float32)
                part[row[lo:hi], column[lo:hi] - a] = 1
                both += part @ part.T
            link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            reached = np.zeros(len(ids), bool)
            for k in range(len(ids)):
                edge = [] if reached[k] else [k]
                reached[k] = True
                while edge:
                    x = edge.pop()
                    new = np.flatnonzero(link[x] & ~reached)
                    reached[new] = True
                    found += [(int(ids[x]), int(ids[y])) for y in new]
                    edge += new.tolist()
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return exhaust


def _apart(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """members with the component that each document has so far."""
    if groups is None:
        return members.withColumn("component", F.col("rep"))
    return members.join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _all_pairs(groups: DataFrame, keys: list[str], pivots: bool = False) -> DataFrame:
    """Pairs of documents of different components within groups of bounded size, those with the pivot only if asked for."""
    held = groups.groupBy(*keys).agg(F.collect_list(F.struct("rep", "component", "pivot")).alias("held"), F.min("component").alias("low"), F.max("component").alias("high"))
    one = held.filter("low < high").select("held", F.explode("held").alias("x")).select("x", F.explode("held").alias("y"))
    one = one.filter("x.rep < y.rep AND x.component <> y.component")
    return (one if pivots else one.filter("x.rep <> x.pivot AND y.rep <> x.pivot")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _compared(large: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all connected documents of each node of large (path, rep, component, size), compared in blocks."""
    node = large.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("same"), F.sum("size").alias("sizes"))
    node = node.groupBy("n", "same", "sizes").agg(F.min("path").alias("path"))  # of nodes with the same documents one is enough
    wide = F.greatest(F.ceil(F.col("n") / BLOCK[0]), F.ceil(F.col("sizes") / BLOCK[1])).cast("int")
    node = node.select("path", wide.alias("wide"))
    ids = store(large.select(F.col("rep").alias("row")).distinct(), "ids")
    sets = only_ids(docs.select("row", "text"), "row", ids, ids.count()).mapInArrow(_sets, "row long, tokens binary").withColumnRenamed("row", "rep")
    rows = large.select("path", "rep", "component").join(_beside(store(node, "nodes")), "path").join(sets, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("wide")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    rows = rows.select("path", "rep", "component", "tokens", F.explode(pairs).alias("at")).select("path", "at.i", "at.j", "rep", "component", "tokens")
    return rows.groupBy("path", "i", "j").applyInArrow(_exhaust(percent), "a long, b long").distinct()


def _mixed(placed: DataFrame) -> DataFrame:
    """Documents of nodes that do not all belong to one component."""
    node = placed.groupBy("path").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("path")
    return placed.join(_beside(store(node, "mixed")), "path", "left_semi")


def _pivots(members: DataFrame) -> DataFrame:
    return members.filter("rep <> pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()


def similar_links(docs: DataFrame, reps: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Components (id, component) of the rows of docs (row, text) in reps (rep, n_shingles, sign), whose sets are distinct."""
    percent = round(100 * threshold)
    size = reps.select("rep", F.col("n_shingles").alias("size"))
    roots = mix(np.arange(1, trees(RECALL, LEVELS) + 1, dtype=np.uint64)).view(np.int64).tolist()
    spark = docs.sparkSession
    with scope(spark) as all_ends:
        # first level: every node's pivot, then what is left of small nodes
        with scope(spark) as stays:
            members = stays(store(_nodes(_first_children(reps, threshold, roots)), "nodes"))
        links = _verified(_pivots(members), reps, docs, percent)
        groups = connected_components(links)
        placed = _apart(members, groups)
        more = _verified(_all_pairs(placed.filter(F.col("n") <= SMALL), ["path"]).distinct(), reps, docs, percent)
        links = links.union(more)
        large = store(_mixed(placed.filter(F.col("n") > SMALL)), "large")
        if large.isEmpty():
            return all_ends(store(connected_components(links), "groups"))
        for level in range(1, LEVELS):
            if large.isEmpty():
                break
            with scope(spark) as stays:
                rows = large.select("rep", "path").join(reps, "rep").select("rep", "path", "sign")
                members = stays(store(_mixed(_apart(_nodes(_children(rows, threshold, FANOUT)), groups)).join(size, "rep"), "nodes"))
            most = MEDIUM if level + 1 < LEVELS else 1 << 62
            found = [_verified(_all_pairs(members.filter(F.col("n") <= SMALL), ["path"], pivots=True).distinct(), reps, docs, percent)]
            found.append(store(_compared(members.filter((F.col("n") > SMALL) & (F.col("n") <= most)), docs, percent), "links"))
            large = members.filter(F.col("n") > most)
            if not large.isEmpty():
                found.append(_verified(_pivots(large), reps, docs, percent))
            for f in found:
                links = links.union(f)
            groups = connected_components(links)
            large = store(_mixed(_apart(large.drop("component"), groups)), "large")
        return all_ends(store(groups, "groups"))


def row_classes(rows: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Classes of near-duplicate rows of (row, doc_id, text), of which only ``row`` (from numbered) must be there and unique.

    Returns row, doc_id, n_words, n_shingles, component (a row of the class, the same for all its rows), component_id (its smallest
    doc_id; null where it has none) and kept: whether the row stands for its class. That is the one of smallest doc_id,
    nulls last, and of rows that share it the one of smallest number; a row without shingles is a class by itself.
    """
    ship(rows.sparkSession)
    sketch = store(sketches(rows), "sketch")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = sketch.filter("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("row").alias("rep"), head.alias("head"))
    classes = store(classes, "classes")
    reps = sketch.select(F.col("row").alias("rep"), "n_shingles", "sign").join(classes.select("rep"), "rep", "left_semi")
    groups = similar_links(rows, store(reps, "reps"), threshold)
    classes = classes.join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = classes.groupBy("component").agg(F.min("head").alias("head"))
    classes = classes.drop("rep", "head").join(heads, "component")
    out = sketch.drop("sign").join(classes, ["d1", "d2", "n_shingles"], "left")
    alone = F.col("component").isNull()
    component_id = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id")
    return out.select("row", "doc_id", "n_words", "n_shingles", F.coalesce("component", "row").alias("component"), component_id, (alone | (F.col("head.row") == F.col("row"))).alias("kept"))


def near_duplicates(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Classes of near-duplicate documents.

    docs has (doc_id, text); other columns are ignored. Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased; a
    document's set holds its distinct 5-word shingles, or with fewer words its whole sequence. Documents link when the
    Jaccard similarity of their sets is at least ``threshold``. Returns one row per document: doc_id, n_shingles,
    component_id (smallest doc_id that links reach), kept (one row of each class: doc_id = component_id where ids are
    unique). Null or empty texts have no shingles and link with nothing; equal texts always link. Rows that repeat a
    doc_id, and rows whose doc_id is null, are told apart by numbers, compared like others and each
    get a row; of a class's rows with its smallest doc_id one is kept, and one of null doc_id if it has no other; a class
    of null ids only has a null component_id. An empty table gives an empty result.
    """
    rows = told_apart(docs, "doc_id", "text").withColumnRenamed("own_id", "doc_id")
    return row_classes(rows, threshold).select("doc_id", "n_shingles", "component_id", "kept")
