"""Connected components of an edge table, with no link or component on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node in ``a, b``, edges between longs.

    Alternates two steps until nothing changes: each node's larger neighbours, then its smaller ones, are hung to
    the smallest of its neighbourhood. Minima are aggregated before they are shuffled and come back by a join,
    whose hot keys Spark can split; so no neighbourhood is gathered. Each round is written to the shared folder.
    Edges with a null end and loops are left out; repeated edges count once.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("link")).where("link").select("a", "b").distinct(), "edges")
    state = mark(now)
    for _ in range(rounds):
        if not state[0]:
            break
        before, now = now, materialize(small_star(large_star(now)), "edges")
        discard(before)
        was, state = state, mark(now)
        if was == state:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return both.where("b > a").join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    hung = edges.join(least, "a")
    moved = hung.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
