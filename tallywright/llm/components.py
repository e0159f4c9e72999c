"""Connected components of an edge table by alternating stars; every round works on a table as long as the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywright.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest node beside it (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least.select(F.col("a").alias("_a"), F.least("a", "m").alias("m")), F.col("a") == F.col("_a"))
    return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, move to the smallest of them. Edges point from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least.select(F.col("a").alias("_a"), "m"), F.col("a") == F.col("_a"))
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (a, b); the root is the component's smallest node.

    Loops and repeated edges don't matter; nodes are whole numbers; an edge with a null is left out.
    """
    turned = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(turned, "edges"), None
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
