"""Connected components by alternating large-star and small-star steps.

Each step is two aggregations and two equi-joins over the edge table, so a node with a
third of all edges is pre-aggregated before its shuffle and its join can be split. The
edge table is written to the shared folder between rounds, and that of the round before
removed; nothing is collected but two sums by which the end is recognised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.storage import materialize, release

MAX_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest of the node's neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    moved = edges.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge to another.

    ``edges`` has columns u and v of one ordered type; direction, repeats, self-loops and
    edges with a null end do not matter. ``component`` is the smallest node of the
    component. No edges give no rows.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = materialize(edges, "edges", compact=True), None
    for _ in range(MAX_ROUNDS):
        last, edges = edges, materialize(_small_star(_large_star(edges)), "edges", compact=True)
        release(last)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
