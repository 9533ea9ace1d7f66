"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptlens.session import materialize

# Few edges are not written as many files.
EDGES_PER_FILE = 50_000


def _linked_to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _linked_to_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = _linked_to_least(down, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v")


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``v``: every node of an edge but the least of its component, and that least.

    Alternating stars: each round is a few shuffles of the edges, whose number
    shrinks to the number of nodes, and few rounds suffice. Rounds are written
    to the shared folder. Hot nodes are aggregated before the shuffle, and the
    joins are left to adaptive execution, which splits skewed keys.
    """
    edges = materialize(edges.select("u", "v").filter("u <> v").distinct(), "component-edges")
    files = edges.count() // EDGES_PER_FILE + 1
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)).distinct().coalesce(files), "component-edges")
        now = edges.agg(mark.alias("m")).first()["m"]
        if now == before:
            return edges
        before = now
