"""Seeds of a side joined along the ridge of the distance: all trees and paths of all fragments at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import BACKGROUND
from ..plans.fixpoint import kept
from . import distance, graph, regions, search
from .snap import nearest
from .stencil import KEY, dilate

#: Searches of a side are numbered from the side times this.
SIDE = 1 << 32


def _numbered(edges: DataFrame) -> DataFrame:
    return edges.withColumn("search", F.col("side").cast("long") * SIDE + F.col("step"))


def ridge_paths(coarse: DataFrame, seeds: DataFrame, volumes: DataFrame, power: float = 2.0) -> DataFrame:
    """(sv_id, side, search, z, y, x): cells of the least ridge paths along each side's spanning tree.

    ``coarse``: foreground; ``seeds`` (sv_id, side, seed_idx, z, y, x): cells of
    it. Paths stay in the foreground where it joins both ends; else they may
    cross background at its cost. Volumes that a task can hold are searched whole;
    for the others a grid with background is built, of the fragments that need it alone.
    """
    cost = kept(distance.cost_fields(kept(distance.squared_distance(coarse, volumes)), power=power).select(*KEY, F.col("ridge").alias("cost")))
    edges = kept(_numbered(graph.spanning_tree(seeds, volumes)))
    ends = [kept(edges.join(seeds.select("sv_id", "side", F.col("seed_idx").alias(c), "z", "y", "x"), ["sv_id", "side", c]).select("sv_id", "search", "z", "y", "x")) for c in ("a", "b")]
    large = kept(volumes.where(~search.fits()))
    if large.isEmpty():
        found = search.paths_inside(cost, volumes, *ends, beyond=BACKGROUND)
    else:
        found = _in_blocks(cost.join(large, "sv_id", "left_semi"), large, *(e.join(large, "sv_id", "left_semi") for e in ends))
        found = found.unionByName(search.paths_inside(cost.join(large, "sv_id", "left_anti"), volumes.where(search.fits()), *(e.join(large, "sv_id", "left_anti") for e in ends), beyond=BACKGROUND))
    return found.select("sv_id", F.floor(F.col("search") / SIDE).cast("tinyint").alias("side"), "search", "z", "y", "x")


def _in_blocks(cost: DataFrame, volumes: DataFrame, *ends: DataFrame) -> DataFrame:
    """Least paths over the foreground, and over the whole volume for searches without a way there."""
    found = kept(search.least_paths(search.cells_of(cost, volumes), *ends))
    lost = kept(ends[0].join(found, ["sv_id", "search"], "left_anti").select("sv_id", "search"))
    if not lost.isEmpty():
        mine = volumes.join(lost, "sv_id", "left_semi")
        dense = search.cells_of(regions.with_background(cost.join(lost, "sv_id", "left_semi"), mine), mine)
        found = found.unionByName(search.least_paths(dense, *(e.join(lost, ["sv_id", "search"], "left_semi") for e in ends)))
    return found


def augmented_seeds(seeds: DataFrame, voxels: DataFrame, volumes: DataFrame, power: float = 2.0, pad: tuple[int, int, int] = (24, 48, 48), steps: tuple[int, int, int] = (2, 2, 1)) -> tuple[DataFrame, DataFrame]:
    """Seeds (sv_id, side, z, y, x) with the voxels of ridge paths between them, and status (sv_id, ok_source, ok_sink) of each fragment of ``volumes``.

    ``seeds`` (sv_id, side, seed_idx, z, y, x): voxels. Paths are sought on each
    ``steps``-th cell of the padded box around both sides' seeds, then widened to
    the cells they stand for and by one voxel. A fragment that lacks seeds of a side, or has no
    foreground on that grid, gets its seeds back as they are, with the sides that failed.
    """
    sides = seeds.groupBy("sv_id").agg(*(F.bool_or(F.col("side") == k).alias(n) for k, n in ((1, "has_source"), (2, "has_sink"))))
    plain = seeds.select("sv_id", F.col("side").cast("tinyint").alias("side"), *(F.col(a).cast("int").alias(a) for a in "zyx")).distinct()
    whole = kept(sides.where("has_source AND has_sink").select("sv_id"))
    shapes = volumes.join(whole, "sv_id", "left_semi")
    boxes = kept(regions.padded_box(seeds.join(whole, "sv_id", "left_semi"), shapes, pad))
    roi = kept(regions.crop(voxels.select(*KEY), boxes))
    coarse = kept(regions.stride(roi, steps))
    grounded = coarse.select("sv_id").distinct().withColumn("ground", F.lit(True))
    status = volumes.select("sv_id").join(sides, "sv_id", "left").join(grounded, "sv_id", "left")
    has = [F.coalesce(n, F.lit(False)) for n in ("has_source", "has_sink")]
    ok = [F.when(has[0] & has[1], F.coalesce("ground", F.lit(False))).otherwise(h) for h in has]
    status = status.select("sv_id", ok[0].alias("ok_source"), ok[1].alias("ok_sink"))
    # Fragments without a second seed of a side have no path to seek.
    several = kept(seeds.join(whole, "sv_id", "left_semi").groupBy("sv_id", "side").count().where("count > 1").select("sv_id").distinct())
    if several.isEmpty():
        return plain, status
    of = lambda df: df.join(several, "sv_id", "left_semi")
    mine, roi, coarse = of(seeds), of(roi), of(coarse)
    wide = kept(of(regions.box_volumes(boxes, shapes, steps)))
    low = [F.col(f"{a}0") for a in "zyx"]
    scaled = mine.join(boxes.select("sv_id", *(f"{a}0" for a in "zyx")), "sv_id").select("sv_id", "side", "seed_idx", *(((F.col(a) - o).cast("double") / k).alias(a) for a, o, k in zip("zyx", low, steps)))
    placed = kept(nearest(scaled, coarse, wide).select("sv_id", "side", "seed_idx", *(F.col(f"v{a}").alias(a) for a in "zyx")))
    paths = kept(ridge_paths(coarse, placed, wide, power).select(*KEY, "side").distinct())
    covered = dilate(regions.cells_under(paths, steps, roi), 1, roi, "side")
    back = covered.join(boxes, "sv_id").select("sv_id", "side", *((F.col(a) + o).cast("int").alias(a) for a, o in zip("zyx", low)))
    return plain.unionByName(back).distinct(), status
