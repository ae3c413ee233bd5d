"""Connected components of an edge table by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v): for each vertex u that is not the smallest of its component, the smallest vertex v.

    edges has long columns u and v, loops and repeats allowed. Each round is written to the shared folder; the number of
    rounds grows with the logarithm of the largest component. An empty table gives an empty table.
    """
    now = materialize(_small_star(edges), "cc")
    mark = None
    for _ in range(rounds):
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark or not row.n:
            return now
        mark = (row.n, row.h)
        after = materialize(_small_star(_large_star(now)), "cc")
        discard(now)
        now = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
