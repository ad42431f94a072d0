"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edges (a, b) with the least node it is connected to.

    Each round attaches a node's larger (then smaller) neighbours to its least
    neighbour, which halves paths, so rounds grow with the logarithm of the
    diameter. No component is ever gathered in one task. Null ends are left out.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("x"), "m").filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        now = materialise(small.union(down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
