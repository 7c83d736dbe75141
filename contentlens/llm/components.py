"""Connected components by alternating large-star and small-star steps, all in DataFrame operations.

Between rounds the edges are written to the shared folder, so lineage stays
short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import materialise


def _mark(edges: DataFrame) -> tuple:
    """What tells a set of edges: their number and two sums of 64-bit hashes."""
    sums = [F.sum(F.xxhash64(F.lit(k), "a", "b").cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    turned = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return turned.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge list (a, b) of any ordered type; root is the smallest node of its component."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(edges)
    for _ in range(max_rounds if seen[0] else 0):
        edges = materialise(_small(_large(edges)))
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select("root", "root").distinct())
