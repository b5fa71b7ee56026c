"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.plans.storage import scope, store


PER_TASK = 200_000


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every endpoint of ``edges`` with the smallest id it can reach.

    Returns (id, component), one row per id that has an edge; self-loops, repeated and null edges are ignored, an
    empty edge table gives an empty result. Ids are longs. Each round is two joins of the edge table with one minimum
    per vertex (partial aggregation first, so a hub costs one row per task), and is written to the shared folder.
    """
    edge = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    # few edges need few tasks: about PER_TASK edges in each file that a round writes
    parts = max(8, -(-edges.count() // PER_TASK))

    spark = edges.sparkSession

    def keep(df: DataFrame) -> DataFrame:
        return store(df.coalesce(parts), "cc")

    edge = keep(edge.filter((F.col("u") != F.col("v")) & F.col("u").isNotNull() & F.col("v").isNotNull()).distinct())
    before = _checksum(edge)
    for _ in range(max_rounds):
        if not before[0]:
            break
        with scope(spark) as stays:
            # large-star: every larger neighbour of a vertex is hung on the smallest vertex near it
            both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = keep(large.filter("u != v").distinct())
            # small-star: a vertex and its smaller neighbours are hung on the smallest of them
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
            edge = stays(keep(moved.filter("u != v").distinct()))
        after = _checksum(edge)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = edge.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.union(edge.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
