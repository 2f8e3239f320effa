"""Connected components of an edge table by alternating large and small stars (Kiveris et al. 2014), each a grouped minimum and a join.

Edges are cut from their lineage into the shared folder after every round. Rows stay proportional to the edges, and no node's
neighbours are ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node that has an edge; edges are longs a, b, and component is the smallest id reachable.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    now = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen, before = mark, now
        now = cut(_small_star(_large_star(now)), "edges")
        discard(spark, before.inputFiles()[0].rsplit("/", 1)[0]) if mark[0] else None
    raise RuntimeError(f"components did not settle in {rounds} rounds")
