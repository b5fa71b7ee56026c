"""Shared scratch storage: written tables that cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset in local mode (tests), a temporary one for this session."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_OPEN = threading.local()


def store(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back, so later steps never recompute it; see scope()."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    for paths in getattr(_OPEN, "scopes", [])[-1:]:
        paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are stored inside are deleted at the end, but for those given to the function that this yields.

    These belong to the scope around this one, if there is any. Nothing that outlives the scope may read others.
    """
    _OPEN.scopes = [*getattr(_OPEN, "scopes", []), []]
    kept = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.stored_at)
        return df

    try:
        yield keep
    finally:
        paths = _OPEN.scopes.pop()
        for paths_around in _OPEN.scopes[-1:]:
            paths_around.extend(p for p in paths if p in kept)
        for path in paths:
            if path not in kept:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
