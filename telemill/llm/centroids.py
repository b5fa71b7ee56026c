"""K-means on integer vectors with a vantage-point tree over the centroids.

Each round the driver builds a tree over the k centroids and broadcasts it. A vector searches it best first: of the open
branches that with the smallest lower bound on the distance is next, and a branch is left out only if its bound is
above the best distance so far; an equal one is entered, as it may hold a smaller number. Distances at vantage points and in leaves are exact
integers; bounds are floating-point numbers made smaller by more than their rounding error. The searches of an Arrow batch
advance together, each along its own order of branches.

A task gives one row of exact sums for each cluster it met, so nothing grows with the vectors but the final table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import ship
from telemill.plans.storage import store

#: Centroids in a leaf at least (more where there are many); bounds of open branches in one search.
LEAF, BOUNDS = 4, 1 << 21
#: Bits of a digit of a sum.
DIGIT = 56
_SLACK = 2.0**-50
_LONG = (1 << 63) - 1


class Index:
    """Vantage-point tree over centroids (tuples of integers), which are numbered from 0."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        self.centroids = centroids
        #: Integers below this have squared distances in a long.
        self.small = math.isqrt((1 << 62) // max(len(centroids[0]), 1)) // 2 if centroids else 0
        #: vantage, ((child, least distance, largest distance), ...) or, for a leaf, its members.
        self.nodes: list[tuple] = []
        self.leaf = max(LEAF, math.isqrt(len(centroids)))
        self.fits = all(abs(x) < self.small for c in centroids for x in c)
        if self.fits and centroids:
            self.points = np.array(centroids, np.int64)
            self._grow(np.arange(len(centroids)))

    def _grow(self, members: np.ndarray) -> int:
        place = len(self.nodes)
        self.nodes.append((None, members))
        if len(members) > self.leaf:
            vantage, rest = members[0], members[1:]
            gap = np.sqrt(((self.points[rest] - self.points[vantage]) ** 2).sum(1).astype(np.float64))
            order, half = np.argsort(gap, kind="stable"), len(rest) // 2
            children = [(self._grow(np.sort(rest[part])), gap[part].min(), gap[part].max()) for part in (order[:half], order[half:])]
            self.nodes[place] = (vantage, children)
        return place

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of vectors of small integers; of equally near ones the smallest number."""
        number, distance = np.empty(len(vectors), np.int64), np.empty(len(vectors), np.int64)
        step = max(1, BOUNDS // len(self.nodes))
        for a in range(0, len(vectors), step):
            number[a : a + step], distance[a : a + step] = self._search(vectors[a : a + step])
        return number, distance

    def _search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(vectors)
        number, best = np.full(n, len(self.points)), np.full(n, _LONG)
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0
        live = np.arange(n)
        while True:
            at = bound[live].argmin(1)
            open_ = bound[live, at] <= np.sqrt(best[live].astype(np.float64)) * (1 + _SLACK)
            live, at = live[open_], at[open_]
            if not len(live):
                return number, best
            for place in np.unique(at).tolist():
                rows = live[at == place]
                vantage, rest = self.nodes[place]
                met = np.array([vantage]) if vantage is not None else rest
                far = ((vectors[rows][:, None] - self.points[met]) ** 2).sum(2)
                first = far.argmin(1)  # members ascend
                d, c = far[np.arange(len(rows)), first], met[first]
                better = (d < best[rows]) | ((d == best[rows]) & (c < number[rows]))
                best[rows[better]], number[rows[better]] = d[better], c[better]
                if vantage is not None:
                    root, own = np.sqrt(d.astype(np.float64)), bound[rows, place]
                    for child, least, most in rest:
                        bound[rows, child] = np.maximum(own, np.maximum(root - most, least - root) - (root + most) * _SLACK)
                bound[rows, place] = np.inf

    def nearest_of(self, vector: list[int]) -> tuple[int, int]:
        """The same for any integers, by way of all centroids."""
        return min((sum((a - b) ** 2 for a, b in zip(vector, c, strict=True)), k) for k, c in enumerate(self.centroids))[::-1]

    def assigned(self, column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, list | np.ndarray, np.ndarray]]:
        """(rows, clusters, distances, integer vectors) of vectors of floats; those with a large integer, if any, come apart, as Python integers."""
        exact = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        with np.errstate(over="ignore"):
            whole = np.floor(exact * scale)
        fits = self.fits & (np.abs(whole) < self.small).all(1)
        rows = np.flatnonzero(fits)
        if len(rows):
            vectors = whole[rows].astype(np.int64)
            yield rows, *self.nearest(vectors), vectors
        rows = np.flatnonzero(~fits)
        if len(rows):
            vectors = [[int(w) if np.isfinite(w) else int(x) * scale for w, x in zip(whole[k], exact[k], strict=True)] for k in rows]
            clusters, distances = zip(*map(self.nearest_of, vectors), strict=True)
            yield rows, np.array(clusters), list(distances), np.array(vectors, object)


def digits(values: list[int]) -> list[int]:
    """The numbers of base 2**DIGIT, all lowest digits first; the highest have a sign. Sums of digits are digits of sums."""
    out, half = [], 1 << (DIGIT - 1)
    while not all(-half <= v < half for v in values):
        out += [v & ((1 << DIGIT) - 1) for v in values]
        values = [v >> DIGIT for v in values]
    return out + values


def of_digits(found: list[int], n: int) -> list[int]:
    """The n numbers whose digits() these are."""
    return [sum(d << (DIGIT * k) for k, d in enumerate(found[j::n])) for j in range(n)]


def _sums(index, scale: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            if batch.num_rows:
                for _, clusters, _, vectors in index.value.assigned(batch.column(0), scale):
                    for c in np.unique(clusters).tolist():
                        own = vectors[clusters == c]
                        total[c] = [a + b for a, b in zip(total.get(c, [0] * (1 + own.shape[1])), [len(own), *own.sum(0).tolist()], strict=True)]
        rows = [(c, v[0], digits(v[1:])) for c, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["cluster", "n", "digits"])

    return sums


def _labels(index, scale: int):
    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for rows, clusters, distances, _ in index.value.assigned(batch.column(1), scale):
                    fit = [d if d <= _LONG else None for d in distances] if isinstance(distances, list) else distances
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(clusters, pa.int32()), pa.array(fit, pa.int64())], ["vec_id", "cluster", "distance"])

    return labels


def _moved(sums: DataFrame, centroids: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Centroids after a round; at most k rows for each digit come to the driver."""
    each = sums.select("cluster", F.posexplode(F.concat(F.array("n"), "digits")).alias("place", "x"))
    rows = each.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    found: dict[int, dict[int, int]] = {}
    for r in rows:
        found.setdefault(r["cluster"], {})[r["place"]] = int(r["x"])
    out = list(centroids)
    for c, x in found.items():
        values = of_digits([x[k] for k in range(1, len(x))], len(centroids[c]))
        out[c] = tuple(v // x[0] for v in values)
    return out


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int, components: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Assign every vector to one of k centroids after ``rounds`` of exact k-means.

    Vectors with exactly ``components`` components, none of them null, infinite or not a number, are kept, others have
    no row. A component x becomes floor(scale * x), x as a double. Centroids 0, 1, ... start as the kept vectors with the
    smallest hexadecimal SHA-256 of ``seed:key`` (a null key as no digits; of equal keys the smaller vector first); fewer
    vectors than k give fewer centroids. A round assigns each vector to the nearest centroid by squared Euclidean
    distance, the smaller number of equally near ones, and moves each centroid that has vectors to the floor of their
    mean, componentwise. Then vectors are assigned once more.

    Returns a row per kept row: vec_id, cluster, distance (squared), cluster_inertia, inertia (sums of distance over the
    cluster and over all), centroid_sha256 (hexadecimal SHA-256 of the centroid's components joined by commas). Rows that
    repeat an id count as often. Distances and sums beyond 2**63 - 1 are null; the clusters of such vectors are
    exact. Each round reads the vectors once; k centroids, their sums and the final figures of k clusters are all that
    the driver holds.
    """
    spark = vectors.sparkSession
    ship(spark)
    sound = (F.size(vector) == components) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(order.alias("order"), "embedding").orderBy("order", "embedding").limit(k).collect()
    centroids = [tuple(math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in r["embedding"]) for r in first]
    for _ in range(rounds):
        index = spark.sparkContext.broadcast(Index(centroids))
        centroids = _moved(kept.select("embedding").mapInArrow(_sums(index, scale), "cluster int, n long, digits array<long>"), centroids)
        index.destroy()
    index = spark.sparkContext.broadcast(Index(centroids))
    found = store(kept.mapInArrow(_labels(index, scale), "vec_id long, cluster int, distance long"), "clusters")
    index.destroy()
    sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("inertia")).collect()
    fit = lambda x: None if x is None or x > _LONG else int(x)
    total = fit(None if any(r["inertia"] is None for r in sums) else sum(r["inertia"] for r in sums))
    digest = {c: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for c, x in enumerate(centroids)}
    figures = spark.createDataFrame([(r["cluster"], fit(r["inertia"]), total, digest[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int, rounds: int, seed: int, components: int = 64, scale: int = 64) -> str:
    """The same in DuckDB, over embeddings: all distances of each round."""
    distance = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(e, c)])"
    ctes = [
        f"v AS (SELECT row_number() OVER () AS row, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings WHERE len(embedding) = {components} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {components})",
        f"c0 AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS k, e AS c FROM v) WHERE k < {k})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS (SELECT row, vec_id, e, k, d FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, k) AS rn FROM (SELECT row, vec_id, e, k, CAST({distance} AS BIGINT) AS d FROM v, c{r})) WHERE rn = 1)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT k, i, sum(e[i]) AS s, count(*) AS n FROM a{r}, range(1, {components + 1}) t(i) GROUP BY k, i)")
            ctes.append(f"c{r + 1} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY k UNION ALL SELECT k, c FROM c{r} WHERE k NOT IN (SELECT k FROM s{r}))")
    last = f"a{rounds}"
    return (
        f"WITH {', '.join(ctes)} SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} JOIN c{rounds} USING (k)"
    )
