"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import drop_stage, stage_at


def _stars(edges: DataFrame) -> DataFrame:
    """Every neighbour and the node itself under the node's smallest neighbour."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("least"))
    return edges.join(smallest.withColumn("least", F.least("a", "least")), "a")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _stars(both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger to the smaller node."""
    starred = _stars(edges)
    moved = starred.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(starred.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``links(a, b)``; the component is its smallest node.

    Each round hangs neighbours below ever smaller nodes, until every node of a component hangs
    below the smallest; the rounds grow with the logarithm of the longest chain. A node
    with many links is aggregated before it is joined. Every round is written and the one
    before it dropped, so no lineage grows and a lost executor costs one round at most.
    """
    spark = links.sparkSession
    edges, path = stage_at(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        turned, new = stage_at(_small(_large(edges)), "links")
        drop_stage(spark, path)
        edges, path = turned, new
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
