"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours with the smallest of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours with the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def star_components(links: DataFrame) -> DataFrame:
    """Rows (node, label): for each node of ``links`` (a, b) the smallest node that it reaches.

    Alternating star operations; each round is written to the shared folder, so
    the plan stays short and lost executors cost one round. The loop ends when a
    round leaves the number of links and two 64-bit sums over all of them (links
    are distinct, so exclusive or tells sets apart) as they were. Nodes without
    links have no row.
    """
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first()
        if now[0] == 0 or now == mark:
            break
        mark, before = now, edges
        edges = materialize(_small_star(_large_star(before)), "edges")
        discard(before)
    # At the end each node but the smallest of its component has one edge, to that one.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
