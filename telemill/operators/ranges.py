"""Running sums, previous rows and digests over groups of any size: ordered ranges, each in its own task.

Rows are dealt in ranges of (group, order) and written once, so a range keeps its rows. What a range needs of those before it comes from
a table with one row for each range and group in it, which is small: there are at most as many as ranges and groups together.
No window ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.plans.storage import store

_OWN = ("_range", "_row", "_inner", "_outer")


def in_ranges(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with ``_range``, the number of a range of (group, order, row), and ``_row``, a number of its own; as many ranges as shuffle partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *group, *order, "_row")
    return store(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def _inside(group: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy("_range", *group).orderBy(*order, "_row")


def _joined(ranged: DataFrame, small: DataFrame, group: Sequence[str]) -> DataFrame:
    """ranged with the columns of small (one row for each range and group); null groups are equal."""
    same = F.col("a._range") == F.col("b._range")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return ranged.alias("a").join(small.alias("b"), same).select("a.*", *[F.col(f"b.{c}") for c in small.columns if c not in ("_range", *group)])


def sums_before(ranged: DataFrame, group: Sequence[str], value: Column) -> DataFrame:
    """(_range, group, _outer): the sum of value over the ranges of a group before this one."""
    total = ranged.groupBy("_range", *group).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    return total.select("_range", *group, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_outer"))


def running_sum(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str, below: int | None = None) -> DataFrame:
    """rows with ``name``: the sum of value over the rows of their group before them.

    Equal rows stand in any order. With ``below``, only rows with less than that before them, and ranges that begin
    beyond it are not looked into.
    """
    ranged = in_ranges(rows, group, order)
    outer = sums_before(ranged, group, value)
    if below is not None:
        outer = outer.filter(F.col("_outer") < below)
    inner = F.coalesce(F.sum(value).over(_inside(group, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = _joined(ranged, outer, group).withColumn(name, inner + F.col("_outer"))
    return (out if below is None else out.filter(F.col(name) < below)).drop(*_OWN)


def with_previous(rows: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """in_ranges(rows) with ``name``: a struct of columns of the row before in its group, null for the first.

    The first row of a range gets it from the last row of the group's range before.
    """
    ranged = in_ranges(rows, group, order)
    last = ranged.groupBy("_range", *group).agg(F.max_by(F.struct(*columns), F.struct(*order, "_row")).alias("_last"))
    outer = last.select("_range", *group, F.lag("_last").over(Window.partitionBy(*group).orderBy("_range")).alias("_outer"))
    inner = F.lag(F.struct(*columns)).over(_inside(group, order))
    return _joined(ranged, outer, group).withColumn(name, F.coalesce(inner, F.col("_outer"))).drop("_outer")


def numbered_runs(rows: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], starts: Column, number: str, place: str) -> DataFrame:
    """rows with ``number``, that of their run in the group (from 0), and ``place``, theirs in the run (from 0).

    A run starts with the group's first row and wherever ``starts`` holds, which may use ``previous``, a struct of
    columns of the row before.
    """
    marked = with_previous(rows, group, order, columns, "previous")
    marked = marked.withColumn("_start", F.when(F.col("previous").isNull() | F.coalesce(starts, F.lit(False)), 1).otherwise(0)).drop("previous")
    # runs and rows are counted alike: what came before, by ranges, and what is in the range
    upto = _inside(group, order).rowsBetween(Window.unboundedPreceding, 0)
    runs = sums_before(marked, group, F.col("_start")).withColumnRenamed("_outer", "_runs")
    marked = _joined(marked, runs, group).withColumn(number, F.sum("_start").over(upto) + F.col("_runs") - 1)
    each = [*group, number]
    counted = sums_before(marked, each, F.lit(1))
    inner = F.row_number().over(_inside(each, order)) - 1
    return _joined(marked, counted, each).withColumn(place, inner + F.col("_outer")).drop("_start", "_runs", *_OWN)


def set_digests(members: DataFrame, group: Sequence[str], member: str, levels: int = 2) -> DataFrame:
    """(group, digest, members): SHA-256 of each set of distinct strings, by a tree.

    Members are sorted by their own SHA-256 and cut where its first ``levels`` bytes change; a leaf's digest is that of
    its sorted hashes, and each level above digests the digests below in order, 256 at most. So no row holds more than
    256 digests or a 256**levels-th of the members, and the digest depends on nothing but the set. Null members are left out.
    """
    rows = members.filter(F.col(member).isNotNull()).select(*group, F.sha2(F.col(member).cast("binary"), 256).alias("digest")).distinct().withColumn("members", F.lit(1))
    for level in range(levels, -1, -1):
        place = F.substring("digest" if level == levels else "place", 1, 2 * level)
        held = F.array_sort(F.collect_list(F.struct(F.lit("").alias("place") if level == levels else F.col("place"), "digest")))
        joined = F.array_join(F.transform(held, lambda x: x.digest), "")
        rows = rows.withColumn("_at", place).groupBy(*group, "_at").agg(F.sha2(joined.cast("binary"), 256).alias("digest"), F.sum("members").alias("members")).withColumnRenamed("_at", "place")
    return rows.drop("place")
