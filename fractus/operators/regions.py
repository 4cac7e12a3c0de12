"""Boxes, windows, strided grids and their inverse, histograms."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import BACKGROUND, in_volume
from .stencil import KEY


def bounding_box(voxels: DataFrame) -> DataFrame:
    """Tight half-open box of each fragment; no row for an empty one."""
    return voxels.groupBy("sv_id").agg(*(f.alias(n) for a in "zyx" for f, n in ((F.min(a), f"{a}0"), (F.max(a) + 1, f"{a}1"))))


def padded_box(points: DataFrame, volumes: DataFrame, pad: tuple[int, int, int]) -> DataFrame:
    """Box of points, padded (z, y, x) and clamped to the volume; the whole volume where there are no points."""
    joined = volumes.select("sv_id", "nz", "ny", "nx").join(bounding_box(points), "sv_id", "left")
    sides = []
    for a, p in zip("zyx", pad):
        sides.append(F.greatest(F.lit(0), F.coalesce(F.col(f"{a}0") - p, F.lit(0))).cast("int").alias(f"{a}0"))
        sides.append(F.least(F.col(f"n{a}"), F.coalesce(F.col(f"{a}1") + p, F.col(f"n{a}"))).cast("int").alias(f"{a}1"))
    return joined.select("sv_id", *sides)


def crop(voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Voxels inside their fragment's box, in the box's coordinates."""
    edges = boxes.select("sv_id", *(F.col(f"{a}0").alias(f"low{a}") for a in "zyx"), *((F.col(f"{a}1") - F.col(f"{a}0")).alias(f"n{a}") for a in "zyx"))
    moved = voxels.join(edges, "sv_id").withColumns({a: (F.col(a) - F.col(f"low{a}")).cast("int") for a in "zyx"})
    return moved.where(in_volume()).select(*voxels.columns)


def box_volumes(boxes: DataFrame, volumes: DataFrame, steps: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Boxes as volumes of their own, with each ``steps``-th cell of them and voxels as many times the size."""
    joined = boxes.join(volumes.select("sv_id", "sz", "sy", "sx"), "sv_id")
    sizes = [F.ceil((F.col(f"{a}1") - F.col(f"{a}0")) / k).cast("int").alias(f"n{a}") for a, k in zip("zyx", steps)]
    return joined.select("sv_id", *sizes, *((F.col(f"s{a}") * float(k)).alias(f"s{a}") for a, k in zip("zyx", steps)))


def with_background(cost: DataFrame, volumes: DataFrame) -> DataFrame:
    """``cost`` (sv_id, z, y, x, cost) with all other cells of the volumes, at the cost of background."""
    planes = volumes.select("sv_id", "ny", "nx", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)).alias("z")).repartition("sv_id", "z")
    lines = planes.select("sv_id", "nx", "z", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("y"))
    every = lines.select("sv_id", "z", "y", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("x"))
    beyond = every.join(cost.select(*KEY), KEY, "left_anti").withColumn("cost", F.lit(BACKGROUND))
    return cost.select(*KEY, "cost").unionByName(beyond)


def crop_to_foreground(voxels: DataFrame, volumes: DataFrame, halo: int = 1) -> DataFrame:
    return crop(voxels, padded_box(voxels, volumes, (halo, halo, halo)))


def stride(voxels: DataFrame, steps: tuple[int, int, int]) -> DataFrame:
    """Every ``steps``-th cell of the grid, in the coarse grid's coordinates."""
    on = " AND ".join(f"{a} % {s} = 0" for a, s in zip("zyx", steps))
    return voxels.where(on).withColumns({a: F.floor(F.col(a) / s).cast("int") for a, s in zip("zyx", steps)})


def upsample(coarse: DataFrame, steps: tuple[int, int, int], fine: DataFrame) -> DataFrame:
    """Cells of ``fine`` with the further columns of the coarse cell that covers them, null if there is none."""
    anchors = fine.select(*KEY, *(F.floor(F.col(a) / s).cast("int").alias(f"{a}c") for a, s in zip("zyx", steps)))
    named = coarse.select("sv_id", *(F.col(a).alias(f"{a}c") for a in "zyx"), *(c for c in coarse.columns if c not in KEY))
    return anchors.join(named, ["sv_id", "zc", "yc", "xc"], "left").drop("zc", "yc", "xc")


def cells_under(coarse: DataFrame, steps: tuple[int, int, int], fine: DataFrame) -> DataFrame:
    """Cells of ``fine`` that coarse cells cover, with their further columns: as :func:`upsample`, but only what is covered is made and met."""
    table = F.array(*[F.struct(*(F.lit(v).alias(f"d{a}") for a, v in zip("zyx", o))) for o in product(*map(range, steps))])
    rest = [c for c in coarse.columns if c not in KEY]
    places = coarse.withColumn("o", F.explode(table)).select("sv_id", *((F.col(a) * s + F.col(f"o.d{a}")).cast("int").alias(a) for a, s in zip("zyx", steps)), *rest)
    return places.join(fine.select(*KEY), KEY, "left_semi")


def numbered(points: DataFrame, slab: Column, order: list[Column]) -> DataFrame:
    """``points`` with i, the place of each in its fragment from 0: by slab, then by ``order`` within it.

    What is before a slab is a sum over the fragment's slabs; only the points of a slab are sorted in one task.
    """
    cut_up = points.withColumn("slab", slab)
    counts = cut_up.groupBy("sv_id", "slab").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("sv_id").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("sv_id", "slab").orderBy(*order))
    return cut_up.withColumn("here", here).join(counts.select("sv_id", "slab", before.alias("before")), ["sv_id", "slab"]).withColumn("i", F.col("before") + F.col("here") - 1).drop("slab", "here", "before")


def every_nth(points: DataFrame, n: int) -> DataFrame:
    """Each n-th point of a fragment in row-major order."""
    return numbered(points, F.col("z"), [F.col("y"), F.col("x")]).where(F.col("i") % max(1, n) == 0).drop("i")


def sample(points: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """``target`` points of each fragment, those of the smallest digests of seed and place; all where there are no more."""
    digest = F.md5(F.concat_ws(",", F.lit(str(seed)), "sv_id", "z", "y", "x"))
    drawn = numbered(points.withColumn("digest", digest), F.substring("digest", 1, 3), [F.col("digest"), F.col("z"), F.col("y"), F.col("x")])
    return drawn.where(F.col("i") < max(1, target)).drop("i", "digest")


def histogram(labels: DataFrame) -> DataFrame:
    """Voxels of each label by fragment, zero-filled."""
    return labels.groupBy("sv_id").agg(*(F.count_if(F.col("label") == k).alias(n) for k, n in ((1, "n_source"), (2, "n_sink"), (3, "n_stray"))))


def with_defaults(voxels: DataFrame, sub_labels: DataFrame, default: int = 1) -> DataFrame:
    """All voxels with the labels of some of them, the rest with ``default``."""
    return voxels.select(*KEY).join(sub_labels.select(*KEY, "label"), KEY, "left").withColumn("label", F.coalesce("label", F.lit(default)).cast("tinyint"))


def force_seeds(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed voxels take their side; where both sides have one the sink does."""
    forced = seeds.groupBy(*KEY).agg(F.max("side").alias("side"))
    return labels.join(forced, KEY, "left").withColumn("label", F.coalesce("side", "label").cast("tinyint")).drop("side")


def seeds_on_grid(seeds: DataFrame, steps: tuple[int, int, int], coarse: DataFrame) -> DataFrame:
    """Seed voxels on a coarse grid: integer division by the steps; only those on its foreground stay."""
    placed = seeds.withColumns({a: F.floor(F.col(a) / s).cast("int") for a, s in zip("zyx", steps)})
    return placed.join(coarse.select(*KEY), KEY, "left_semi")


def seeds_near_grid(seeds: DataFrame, steps: tuple[int, int, int], coarse: DataFrame, volumes: DataFrame) -> DataFrame:
    """Seeds on the nearest foreground cell of a coarse grid whose cells are ``steps`` voxels wide."""
    from .snap import nearest

    scaled = seeds.withColumns({a: F.col(a).cast("double") / s for a, s in zip("zyx", steps)})
    wide = volumes.withColumns({f"s{a}": F.col(f"s{a}") * float(s) for a, s in zip("zyx", steps)})
    return nearest(scaled, coarse, wide).select("sv_id", "side", "seed_idx", *(F.col(f"v{a}").alias(a) for a in "zyx"))
