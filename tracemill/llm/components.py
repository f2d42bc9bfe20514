"""Union-find grouping that is distributed: alternating large and small stars.

Each round hangs every node under the least neighbour it has (large star, then
small star) until each group is a star around its least member.  A round is two
aggregations and two joins on the node; the rounds grow with the logarithm of
the longest path.  Each round's edges go to the shared checkpoint folder, so
the lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.cluster import settle


def _hang(edges: DataFrame) -> DataFrame:
    """edges (u, v) with the least of v and u per u."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _hang(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _hang(large)
    return small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge, with the least node of its group, which is not listed itself.

    `edges` has the columns u and v; order, repeats and loops don't matter.
    """
    now = settle(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        now = settle(_round(now))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
