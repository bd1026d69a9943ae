"""Connected components over an edge table, by star contraction.

Each round links every node to the smallest node it knows (large star, then small star), so long
chains shrink by a factor a round. Rounds are written to the shared folder; only two numbers reach
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction; edges are (u, v) with u > v.

    The large star links every larger neighbour of a node to the smallest of its neighbourhood, the
    small star every smaller neighbour and the node itself.
    """
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    if large:
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the smallest node."""
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialize(now, "cc"), None
    while True:  # a round only ever moves links to smaller nodes, so they settle
        now, old = materialize(_star(_star(now, True), False), "cc"), now
        discard(old)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    named = materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
    discard(now)
    return named
