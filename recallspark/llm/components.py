"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, scratch, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (larger ones, or smaller ones and itself) to the least of them."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).select("u", F.least("u", "least").alias("least"), "n")
    least = written(least, "least")
    moved = near.where("v > u") if large else near
    out = join_keyed(moved, least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    if large:  # no more rows than links; repeats go in the small star
        return out.where("u <> v")
    return out.union(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) for every node of links(a, b); self-links and repeats are fine.

    The links stay distributed throughout; each round is written to the shared folder. Rounds grow
    with the logarithm of the longest path. The rows of a node with very many links stay where they
    are (join_keyed).
    """
    with scratch(links.sparkSession):
        edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
        edges = written(edges, "links")
        before = None
        while True:
            edges = written(_star(written(_star(edges, True), "stars"), False), "stars")
            now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            if now == before:
                break
            before = now
        heads = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
        return written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads), "components", keep=True)
