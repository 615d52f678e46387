"""Connected components by alternating large-star and small-star steps.

Every round is an aggregation and a join over the edges, written to the shared
folder. Nothing of the graph comes to the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored


def _with(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, least). The join is on a digest of the node, so both sides are shuffled for it alone.

    Adaptive execution then splits the rows of a node with very many neighbours, which
    it could not do in one stage with the aggregation.
    """
    digest = F.xxhash64("u").alias("digest")
    return edges.select("*", digest).join(least.select("*", digest), ["digest", "u"]).drop("digest")


def _least(edges: DataFrame) -> DataFrame:
    """(u, least): the smallest of each node and its neighbours; ``edges`` are (u, v)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with(both, _least(both)).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = _with(down, least).where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v): the smallest node it is linked to, itself included.

    Links may repeat, point either way and join a node to itself; nulls are not
    nodes. Nodes without a link to another one are left out.
    """
    edges = links.where("u <> v").select("u", "v")
    edges = stored(_small_star(_large_star(edges)), "star")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = now
        edges = stored(_small_star(_large_star(edges)), "star")
