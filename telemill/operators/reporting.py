"""Pieces of reports: counts, rankings and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROXY_PORTS = (1080, 3128, 8080, 8888)


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def ranked(rows: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """The k rows of largest ``by``, ties by key."""
    return rows.orderBy(F.desc(by), key).limit(k)


def top_per_group(rows: DataFrame, group: list[str], by: str, ties: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.desc(by), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def share_of(rows: DataFrame, value: str, group: list[str] | None = None, digits: int = 2) -> DataFrame:
    """rows with ``share``, the percentage of ``value`` in its group or in all rows; for grouped, small results."""
    return rows.withColumn("share", F.round(F.lit(100.0) * F.col(value) / F.sum(value).over(Window.partitionBy(*(group or []))), digits))
