"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so a vertex with very many edges is never gathered in one place; a round's
edges are written to the shared folder, which cuts lineage. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.plans.scratch import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than u is linked to the least of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour not larger than u, and u, is linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (the least node of each component), for every node that has an edge to another. Nulls are left out."""
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    now = written(now, "edges")
    seen = None
    while True:
        # the same edges twice in a row: count and an order-free hash agree
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or mark[0] == 0:
            break
        seen = mark
        now = written(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component")).distinct()
