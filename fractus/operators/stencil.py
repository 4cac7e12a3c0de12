"""The 26-neighbourhood as a join: neighbours, boundary, dilation, components."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axes import linear
from ..functions.fields import in_volume
from ..plans.fixpoint import kept, star_components
from .blocks import BLOCK, on_border, smallest_in_block, with_blocks
from .offsets import HALF, OFFSETS

KEY = ["sv_id", "z", "y", "x"]


def shifted(voxels: DataFrame, offsets: list[tuple[int, int, int]], *keep: str) -> DataFrame:
    """A row for each voxel and offset: the voxel as z0, y0, x0 and the place beside it as z, y, x."""
    table = F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(("dz", "dy", "dx"), o))) for o in offsets])
    out = voxels.withColumn("o", F.explode(table))
    return out.select("sv_id", *(F.col(a).alias(f"{a}0") for a in "zyx"), *((F.col(a) + F.col(f"o.d{a}")).cast("int").alias(a) for a in "zyx"), *keep)


def places_in_volume(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Distinct places (sv_id, z, y, x) beside voxels, those outside the volume left out."""
    size = ["nz", "ny", "nx"]
    near = shifted(voxels.join(volumes.select("sv_id", *size), "sv_id"), OFFSETS, *size)
    return near.where(in_volume()).select(*KEY).distinct()


def neighbours(voxels: DataFrame, others: DataFrame, *keep: str) -> DataFrame:
    """Each voxel (z0, y0, x0) beside each of ``others`` (z, y, x and its further columns)."""
    return shifted(voxels, OFFSETS, *keep).join(others, KEY)


def interior(voxels: DataFrame, iterations: int = 1) -> DataFrame:
    """Voxels that stay after erosion by the full cube; the volume's border counts as outside.

    The cube is the product of three segments, so one axis is eroded after another:
    of a voxel's neighbours only those on its line are looked at.
    """
    out = voxels.select(*KEY)
    for axis in "xyz":
        line = Window.partitionBy("sv_id", *(a for a in "zyx" if a != axis)).orderBy(axis)
        here = F.col(axis)
        for _ in range(iterations):
            beside = out.withColumns({"before": F.lag(axis).over(line), "behind": F.lead(axis).over(line)})
            out = beside.where((F.col("before") == here - 1) & (F.col("behind") == here + 1)).select(*KEY)
    return out


def boundary(voxels: DataFrame, iterations: int = 1) -> DataFrame:
    """Voxels that erosion removes; all of them for fewer than one round or where none would be left.

    A fragment with foreground always has a boundary when the border counts as
    outside, so the fallback to the whole fragment never drops one.
    """
    voxels = voxels.select(*KEY)
    return voxels if iterations < 1 else voxels.join(interior(voxels, iterations), KEY, "left_anti")


def dilate(voxels: DataFrame, radius: int, within: DataFrame, *keep: str) -> DataFrame:
    """Voxels within ``radius`` of one of ``voxels`` (a ball), clipped to ``within``; apart for each value of the columns ``keep``."""
    if radius < 1:
        return voxels.select(*KEY, *keep).join(within.select(*KEY), KEY, "left_semi")
    ball = [o for o in product(range(-radius, radius + 1), repeat=3) if sum(v * v for v in o) <= radius * radius]
    return shifted(voxels, ball, *keep).select(*KEY, *keep).distinct().join(within.select(*KEY), KEY, "left_semi")


def components(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """``voxels`` with comp: the smallest row-major number in the 26-connected component.

    Each block of a fragment is settled in one task; only parts that touch over
    the borders of blocks are joined, so the rounds follow the blocks that a
    component crosses and not its voxels.
    """
    shape = volumes.select("sv_id", "ny", "nx")
    numbered = voxels.select(*KEY).join(shape, "sv_id").withColumn("node", linear(F.col("z"), F.col("y"), F.col("x"), F.col("ny"), F.col("nx"))).drop("ny", "nx")
    parts = with_blocks(numbered).groupBy(*BLOCK).applyInPandas(smallest_in_block, "sv_id long, z int, y int, x int, node long, part long")
    parts = kept(parts)
    outer = parts.where(on_border())
    beside = outer.select(*KEY, F.col("part").alias("b"))
    pairs = shifted(outer, HALF, F.col("part").alias("a")).join(beside, KEY).where("a <> b")
    found = star_components(pairs.select("sv_id", "a", "b")).withColumnRenamed("node", "part")
    named = parts.join(found, ["sv_id", "part"], "left").select(*KEY, F.coalesce("comp", "part").alias("comp"))
    return named if set(voxels.columns) == set(KEY) else voxels.join(named, KEY)


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("sv_id", "comp").agg(F.count("*").alias("n"))


def largest_component(labelled: DataFrame) -> DataFrame:
    """The component of most voxels in each fragment; ties go to the smallest number."""
    best = component_sizes(labelled).groupBy("sv_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "comp")).alias("s"), F.count("*").alias("n_components"))
    return best.select("sv_id", F.col("s.comp").alias("comp"), (-F.col("s.m")).alias("n"), "n_components")
