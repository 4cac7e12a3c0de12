"""Arrival times, paths and seed trees on the voxel graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut
from .search import borders, cells_of, times


def arrival(cost: DataFrame, seeds: DataFrame, volumes: DataFrame, backend: str = "mcp") -> DataFrame:
    """(sv_id, z, y, x, t_a, t_b): least travel cost from either side's seeds, null where there is no way.

    An edge of the 26-neighbourhood costs, for mcp, the mean cost of both ends
    times their physical distance; for dj3d the cost of the end reached times the
    mean voxel size. All fragments and both sides advance in one loop; rounds are
    as many as the blocks that the longest least path crosses.
    """
    cells = cells_of(cost, volumes)
    starts = seeds.select("sv_id", F.col("side").alias("search"), "z", "y", "x")
    return times(cells, borders(cells, starts, backend), backend)


def seed_graph(seeds: DataFrame, volumes: DataFrame) -> DataFrame:
    """Complete graph of each side's seeds: (sv_id, side, a, b, d2), a < b."""
    left = seeds.select("sv_id", "side", F.col("seed_idx").alias("a"), *(F.col(c).alias(f"{c}0") for c in "zyx"))
    right = seeds.select("sv_id", "side", F.col("seed_idx").alias("b"), "z", "y", "x")
    gap = [(F.col(a) - F.col(f"{a}0")) * F.col(f"s{a}") for a in "zyx"]
    return left.join(right, ["sv_id", "side"]).where("a < b").join(volumes.select("sv_id", "sz", "sy", "sx"), "sv_id").select("sv_id", "side", "a", "b", (gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]).alias("d2"))


def spanning_tree(seeds: DataFrame, volumes: DataFrame) -> DataFrame:
    """Least spanning tree of each side's seeds, grown from its first seed: (sv_id, side, step, a, b).

    One edge of every tree is added in each round; ties go to the smaller b, then a.
    """
    graph = seed_graph(seeds, volumes)
    both = cut(graph.unionByName(graph.select("sv_id", "side", F.col("b").alias("a"), F.col("a").alias("b"), "d2")))
    tree = cut(seeds.groupBy("sv_id", "side").agg(F.min("seed_idx").alias("b")).select("sv_id", "side", F.lit(0).alias("step"), F.lit(None).cast("int").alias("a"), "b"))
    step = 0
    while True:
        step += 1
        inside = tree.select("sv_id", "side", F.col("b").alias("node"))
        out = both.join(inside, (both.sv_id == inside.sv_id) & (both.side == inside.side) & (both.a == inside.node), "left_semi")
        out = out.join(inside.withColumnRenamed("node", "b"), ["sv_id", "side", "b"], "left_anti")
        new = out.groupBy("sv_id", "side").agg(F.min(F.struct("d2", "b", "a")).alias("s")).select("sv_id", "side", F.lit(step).alias("step"), F.col("s.a").alias("a"), F.col("s.b").alias("b"))
        new = cut(new)
        if new.isEmpty():
            return tree.where("step > 0")
        tree = tree.unionByName(new)
