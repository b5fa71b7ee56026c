"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of each n-gram (3 to 5 lower-cased characters, hashed to BUCKETS buckets) is counted over toxic and other
labelled texts. The ratio of its smoothed logarithmic frequencies scales the feature of each bucket, of either sign, and
a logistic regression is fitted on all scaled features; no bucket is left out. Smoothing adds PRIOR texts, divided
between the classes as the labelled ones are, so a rare n-gram has a ratio near 0. The regression takes STEPS steps of
L-BFGS, whose losses and gradients are summed over the labelled rows where these lie (pyspark.ml scales every feature by
its deviation first, which undoes the scaling by ratios for rare n-grams: 0.47 of the held-out toxic texts instead of
0.8). A quarter of the labelled rows is left out at first: they say where the score of THRESHOLD belongs. From there,
AGAIN steps over all labelled rows follow. The model has a fixed size and is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import ship
from telemill.plans.storage import scope, store

ORDERS = (3, 4, 5)
BUCKETS = 1 << 17
#: Labelled rows that the model is made from at most, the first ones by a hash of doc_id.
SAMPLE = 20_000
#: Texts that smoothing adds, weight of the squared norm in the regression.
PRIOR, REG = 150, 0.0003
#: Of so many labelled rows one is kept for placing the threshold.
FOLDS = 4
#: Steps of the regression and with all rows, earlier steps that each one looks back on, tasks that sum a gradient.
STEPS, AGAIN, MEMORY, TASKS = 25, 10, 10, 8
#: Score from which a text counts as toxic.
THRESHOLD = 0.7
_PIECE = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


@dataclass(frozen=True)
class ToxicityModel:
    """weights: of each bucket, ratio times coefficient."""

    weights: np.ndarray
    intercept: float


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text, with a space before and after it, in pieces of bounded size."""
    code = f" {text.lower()} "
    for a in range(0, len(code) - ORDERS[0] + 1, _PIECE):
        c = np.frombuffer(code[a : a + _PIECE + ORDERS[-1] - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in ORDERS:
            m = min(_PIECE, len(c) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n * 0x3C6EF372 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h += c[k : k + m] * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
            yield (h * np.uint32(0x2C1B3C6D)) >> np.uint32(33 - BUCKETS.bit_length())


_SEEN = np.zeros(BUCKETS, bool)


def _features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    for buckets in ngrams(text or ""):
        _SEEN[buckets] = True
    found = np.flatnonzero(_SEEN)
    _SEEN[found] = False
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic, other): texts of a task that have the bucket; bucket -1 counts all."""
    count = np.zeros((2, BUCKETS), np.int64)
    total = [0, 0]
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            count[toxic, _features(text.as_py())] += 1
            total[toxic] += 1
    found = np.flatnonzero(count.sum(0))
    for a in range(0, len(found), 100_000):
        f = found[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(count[1, f]), pa.array(count[0, f])], ["bucket", "toxic", "other"])
    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array(total[1:]), pa.array(total[:1])], ["bucket", "toxic", "other"])


def log_ratios(toxic: np.ndarray, other: np.ndarray, p: int, n: int) -> np.ndarray:
    """Log-count ratio of each bucket from its numbers of toxic and other texts, p and n in all."""
    a, b = PRIOR * p / (p + n), PRIOR * n / (p + n)
    return np.log((toxic + a) / (p + a)) - np.log((other + b) / (n + b))


def best_cut(z: np.ndarray, toxic: np.ndarray) -> float:
    """The cut for which ``z >= cut`` has the largest F1; between the values on both sides of it, the lowest of equals."""
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + hits[-1])
    f1[:-1][z[:-1] == z[1:]] = 0  # equal scores are on one side
    k = len(z) - 1 - int(np.argmax(f1[::-1]))
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features = pa.array([_features(t.as_py()).astype(np.int32).tobytes() for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), features], ["sign", "weight", "features"])


def _objective(train: DataFrame, ratios: np.ndarray) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Loss and gradient of the regression at coefficients and intercept, over rows (sign 1 or -1, weight, features)."""
    spark = train.sparkSession
    train, scale = train.coalesce(TASKS), spark.sparkContext.broadcast(ratios)

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        now = spark.sparkContext.broadcast(x)

        def slope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, loss, total = now.value[:-1] * scale.value, 0.0, np.zeros(BUCKETS + 1)
            for batch in batches:
                for sign, weight, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    f = np.frombuffer(raw.as_buffer(), np.int32)
                    margin = sign * (now.value[-1] + weights[f].sum())
                    loss += weight * np.logaddexp(0, -margin)
                    step = -sign * weight / (1 + np.exp(min(margin, 500)))
                    total[f] += step  # a row's features are distinct
                    total[-1] += step
            total[:-1] *= scale.value
            yield pa.RecordBatch.from_arrays([pa.array([float(loss)]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["loss", "slope"])

        parts = train.mapInArrow(slope, "loss double, slope binary").collect()  # TASKS rows of BUCKETS + 1 numbers, half a megabyte each
        now.destroy()
        inner = np.append(x[:-1], 0.0)
        return sum(r["loss"] for r in parts) + REG / 2 * float(inner @ inner), sum((np.frombuffer(r["slope"], np.float32) for r in parts), REG * inner)

    return value


def minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int) -> np.ndarray:
    """Where the convex f (value, gradient) is least, by steps of L-BFGS from x."""
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = slope.copy(), []
        for dx, dg in reversed(moves):
            shares.append(dx @ way / (dx @ dg))
            way -= shares[-1] * dg
        if moves:
            dx, dg = moves[-1]
            way *= dx @ dg / (dg @ dg)
        for (dx, dg), share in zip(moves, reversed(shares), strict=True):
            way += dx * (share - dg @ way / (dx @ dg))
        length, down = 1.0 if moves else 1 / max(np.abs(slope).sum(), 1e-12), slope @ way
        new, ahead = f(x - length * way)
        while new > value - 1e-4 * length * down and length > 1e-10:
            length /= 2
            new, ahead = f(x - length * way)
        if value - new <= 1e-6 * abs(value):
            break
        if way @ (slope - ahead) > 0:
            moves = [*moves, (-length * way, ahead - slope)][-MEMORY:]
        x, value, slope = x - length * way, new, ahead
    return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on texts of docs (doc_id, text) by labels (doc_id, toxic 0 or 1), at most ``sample`` labelled rows.

    Rows without text or label are left out, of repeated labels the largest holds. Where one class has no row, every
    score is the smoothed share of toxic rows. Lang, source and doc_id are not features. Counts of BUCKETS buckets and
    the scores of a FOLDS-th of the sample come to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` rows
    rows = docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("text").isNotNull()).join(marked, "doc_id")
    rows = store(rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)) == 0).alias("aside")), "labelled")
    model, x = _fitted(rows.filter("NOT aside"), np.zeros(BUCKETS + 1), STEPS)
    aside = score(rows.filter("aside").select(F.col("toxic").alias("doc_id"), "text"), model).toPandas()
    if not model.weights.any() or aside["doc_id"].nunique() < 2:
        return _fitted(rows, x, STEPS)[0]
    cut = best_cut(np.log(aside["score"] / (1 - aside["score"])).to_numpy(), aside["doc_id"].to_numpy())
    model, _ = _fitted(rows, x, AGAIN)
    return ToxicityModel(model.weights, model.intercept - cut + math.log(THRESHOLD / (1 - THRESHOLD)))


def _fitted(rows: DataFrame, x: np.ndarray, steps: int) -> tuple[ToxicityModel, np.ndarray]:
    """Model of rows (text, toxic) and its coefficients and intercept, after some steps from x."""
    counts = rows.select("text", "toxic").mapInArrow(_counts, "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toPandas()
    total = counts[counts["bucket"] == -1]
    p, n = int(total["toxic"].sum()), int(total["other"].sum())
    if not p or not n:
        return ToxicityModel(np.zeros(BUCKETS), math.log((p + 1) / (n + 1))), x
    count = np.zeros((2, BUCKETS), np.int64)
    counts = counts[counts["bucket"] >= 0]
    count[:, counts["bucket"]] = counts[["toxic", "other"]].to_numpy().T
    ratios = log_ratios(*count, p, n)
    weight = F.when(F.col("toxic") == 1, F.lit(0.5 / p)).otherwise(F.lit(0.5 / n))
    train = rows.select(F.when(F.col("toxic") == 1, 1).otherwise(-1).alias("sign"), weight.alias("weight"), "text").mapInArrow(_encoded, "sign int, weight double, features binary")
    with scope(rows.sparkSession):
        x = minimum(_objective(store(train, "train"), ratios), x, steps)
    return ToxicityModel(x[:-1] * ratios, float(x[-1])), x


def _logits(texts: pa.Array, weights: np.ndarray, intercept: float) -> np.ndarray:
    return np.array([intercept + float(weights[_features(t.as_py())].sum()) for t in texts], float)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every whole text of (doc_id, text); null and empty texts get the score of no features."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.intercept))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _logits(batch.column(1), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scores, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All columns of the rows of docs whose score is below THRESHOLD, in one pass."""
    spark = docs.sparkSession
    ship(spark)
    shared, at = spark.sparkContext.broadcast((model.weights, model.intercept)), docs.columns.index(text)
    limit = math.log(THRESHOLD / (1 - THRESHOLD))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_logits(batch.column(at), *shared.value) < limit))

    return docs.mapInArrow(clean, docs.schema)


def held_out() -> F.Column:
    """Whether a document's label is kept out of training: crc32 of its id as text leaves 1 when divided by 3."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document of (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= THRESHOLD).

    The model is fitted on the labelled rows that are not held out (see fit and held_out). Other columns are ignored,
    repeated rows get a row each, an empty table gives an empty result.
    """
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
