"""Seeds to their nearest voxels: an exact nearest-neighbour join within fragments.

Candidates and seeds meet by fragment and by blocks of candidates, so a large
fragment is spread over many tasks; each block yields one row for each seed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.axes import rounded
from ..plans.fixpoint import kept
from .regions import every_nth, sample
from .stencil import boundary

#: Edge of the blocks in which a fragment's candidates are searched.
BLOCK = 64


def nearest(seeds: DataFrame, candidates: DataFrame, volumes: DataFrame) -> DataFrame:
    """``seeds`` (sv_id, side, seed_idx, z, y, x) with the nearest candidate as vz, vy, vx and d2.

    Ties go to the smallest z, then y, then x. A seed in a fragment without
    candidates has no row.
    """
    sized = volumes.select("sv_id", "sz", "sy", "sx")
    points = candidates.select("sv_id", *(F.col(a).cast("int").alias(f"v{a}") for a in "zyx"), *(F.floor(F.col(a) / BLOCK).alias(f"b{a}") for a in "zyx"))
    blocks = points.select("sv_id", "bz", "by", "bx").distinct()
    # A block's distance bounds that of its points from below; only blocks that the nearest block's far corner reaches stay.
    low = [F.greatest(F.col(f"b{a}") * BLOCK - F.col(a), F.col(a) - (F.col(f"b{a}") + 1) * BLOCK, F.lit(0.0)) * F.col(f"s{a}") for a in "zyx"]
    high = [F.greatest(F.abs(F.col(f"b{a}") * BLOCK - F.col(a)), F.abs((F.col(f"b{a}") + 1) * BLOCK - F.col(a))) * F.col(f"s{a}") for a in "zyx"]
    square = lambda parts: sum((p * p for p in parts[1:]), parts[0] * parts[0])
    reach = seeds.join(sized, "sv_id").join(blocks, "sv_id").withColumns({"low": square(low), "high": square(high)})
    key = ["sv_id", "side", "seed_idx"]
    bound = reach.groupBy(*key).agg(F.min("high").alias("most"))
    wanted = reach.join(bound, key).where("low <= most").select(*key, "z", "y", "x", "sz", "sy", "sx", "bz", "by", "bx")
    gap = [(F.col(f"v{a}") - F.col(a)) * F.col(f"s{a}") for a in "zyx"]
    met = wanted.join(points, ["sv_id", "bz", "by", "bx"]).withColumn("d2", square(gap))
    best = met.groupBy(*key).agg(F.min(F.struct("d2", "vz", "vy", "vx")).alias("best"))
    return seeds.join(best, key).select(*key, "z", "y", "x", "best.vz", "best.vy", "best.vx", "best.d2")


def snap_seeds(seeds: DataFrame, voxels: DataFrame, volumes: DataFrame, use_boundary: bool = True, erosion_iters: int = 1, downsample: bool = True, downsample_mode: str = "stride", downsample_stride: int = 2, downsample_target: int | None = None, seed: int = 0, use_bbox: bool = False, bbox_pad_phys: float | None = None, rng: int | np.random.Generator | None = None, leafsize: int = 16) -> DataFrame:
    """:func:`nearest` among boundary or all voxels, thinned as asked, with moved (boolean).

    Raises ValueError if a fragment with seeds has no candidate. ``rng`` (a number
    or a numpy generator) gives the seed of a random sample in place of ``seed``.
    The search is exact whether or not a window around the seeds is asked for
    (``use_bbox``, ``bbox_pad_phys``), as :func:`nearest` opens only blocks near
    each seed; ``leafsize`` is accepted for completeness.
    """
    if rng is not None:
        seed = int(rng if isinstance(rng, int | np.integer) else rng.integers(1 << 31))
    if bbox_pad_phys is not None and bbox_pad_phys < 0:
        raise ValueError("bbox_pad_phys must not be negative")
    if downsample_mode not in ("stride", "random"):
        raise ValueError("downsample_mode must be 'stride' or 'random'")
    candidates = boundary(voxels, erosion_iters) if use_boundary else voxels.select("sv_id", "z", "y", "x")
    if downsample and downsample_mode == "stride":
        candidates = kept(every_nth(candidates, downsample_stride))
    elif downsample:
        candidates, target = kept(candidates), downsample_target or 50_000
        many = candidates.groupBy("sv_id").count().where(F.col("count") > target).select("sv_id")
        if not many.isEmpty():
            candidates = candidates.join(many, "sv_id", "left_anti").unionByName(sample(candidates.join(many, "sv_id", "left_semi"), target, seed))
    else:
        candidates = kept(candidates)
    lost = seeds.join(voxels, "sv_id", "left_anti").select("sv_id").limit(1).collect()
    if lost:
        raise ValueError(f"fragment {lost[0][0]} has seeds but no candidate voxel")
    out = nearest(seeds, candidates, volumes)
    moved = F.lit(False)
    for a in "zyx":
        moved = moved | (rounded(F.col(a)) != F.col(f"v{a}"))
    return out.withColumn("moved", moved)


def moved_count(snapped: DataFrame) -> DataFrame:
    return snapped.groupBy("sv_id", "side").agg(F.count_if("moved").alias("moved_count"))
