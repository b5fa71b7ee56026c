"""Helpers that the operators of this subpackage share: shipping code to workers and vectorised word scanning."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.plans.storage import store

#: Bytes of text that are scanned at once; arrays of 8 bytes a byte are made for so many.
BLOCK = 1 << 19
#: Bytes of an Arrow batch between the JVM and Python, where the session leaves Spark's 64 MB.
BATCH_BYTES = 4 << 20
#: Ids of documents that may be broadcast to filter a scan (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` would, once for each application; keep Arrow batches small."""
    if spark.conf.get(_BATCH, None) in (None, "67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    target = os.path.join(tempfile.mkdtemp(prefix="telemill-"), "telemill.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "telemill").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def only_ids(df: DataFrame, key: str, ids: DataFrame, n: int) -> DataFrame:
    """Rows of df whose key is in ids (one column, ``key``, n rows): a broadcast filter up to BROADCAST_IDS, else a shuffle."""
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, "left_semi")


def numbered(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Columns of df and ``row``, a number of each row that no other has, whatever its ids are; written, so that it stays."""
    return store(df.select(F.monotonically_increasing_id().alias("row"), *columns), "rows")


def told_apart(df: DataFrame, key: str, *columns: Column | str) -> DataFrame:
    """``row``, ``own_id`` (the key as a long) and columns of df. Where the key is never null nor repeated it is the row's number itself, else see numbered()."""
    own = F.col(key).cast("long")
    if df.groupBy(own.alias("own_id")).count().filter("count > 1 OR own_id IS NULL").isEmpty():
        return df.select(own.alias("row"), own.alias("own_id"), *columns)
    return numbered(df, own.alias("own_id"), *columns)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# --- words -----------------------------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if len(have) <= 4 * BLOCK:
            _POWERS[base] = have
    return have[:n]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about BLOCK bytes; a longer document is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of documents: first byte, byte after the last, 64-bit hash, and each document's first word (one more than documents)."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    out, a = [], 0
    while a < len(data):
        b = min(a + BLOCK, len(data))
        while b < len(data) and not (_SPACE[data[b]] or edge[b]):  # a word is never cut
            b += 1
        d = _LOWER[data[a:b]] if lower else data[a:b]
        solid, cut = ~_SPACE[d], edge[a : b + 1].copy()
        cut[[0, -1]] = True
        first = np.flatnonzero(solid & (cut[:-1] | ~np.concatenate([[False], solid[:-1]])))
        last = np.flatnonzero(solid & (cut[1:] | ~np.concatenate([solid[1:], [False]])))
        value = _BYTE[d] * powers(_BASE, len(d))
        total = np.cumsum(value, dtype=np.uint64)
        h = (total[last] - total[first] + value[first]) * powers(pow(_BASE, -1, 1 << 64), len(d))[first]
        out.append((first + a, last + a + 1, mix(h)))
        a = b
    first, end, h = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return first, end, h, np.searchsorted(first, offsets)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all sequences of k consecutive words (len(h) - k + 1 of them); runs over document ends are for the caller to drop."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = (_BASE * (2 * k + 1) * 4 + 5) % (1 << 64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for a in range(0, len(out), BLOCK):
        part = h[a : a + BLOCK + k - 1]
        n = min(BLOCK, len(out) - a)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers(base, len(part)), dtype=np.uint64)])
        out[a : a + n] = (total[k : k + n] - total[:n]) * powers(pow(base, -1, 1 << 64), n)
    return mix(out + np.uint64(k))
