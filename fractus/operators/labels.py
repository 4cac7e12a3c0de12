"""Labels from arrival times: the narrow band, its floor, both resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import SINK, SOURCE, in_band, label_of
from . import regions
from .stencil import KEY, dilate

#: Voxels that a band has at least; a fragment with fewer is all band.
FLOOR = 64


def grid_labels(times: DataFrame, narrow_band_rel: float = 0.08, nb_dilate: int = 1, k_prox: float = 2.0, lambda_prox: float = 1.0) -> DataFrame:
    """(sv_id, z, y, x, label) from written ``times`` (sv_id, z, y, x, t_a, t_b; null where there is no way).

    The band are voxels that both sides reach at nearly the same time, dilated
    by a ball within the fragment. Each fragment decides by its own count if the
    band is too small to mean anything.
    """
    inf = F.lit(float("inf"))
    ta, tb = F.coalesce("t_a", inf), F.coalesce("t_b", inf)
    band = times.where(in_band(F.col("t_a"), F.col("t_b"), narrow_band_rel)).select(*KEY)
    if nb_dilate > 0:
        band = dilate(band, nb_dilate, times)
    marked = times.select(*KEY, ta.alias("ta"), tb.alias("tb")).join(band.withColumn("band", F.lit(True)), KEY, "left")
    wide = band.groupBy("sv_id").agg((F.count("*") >= FLOOR).alias("wide"))
    inside = F.when(F.coalesce("wide", F.lit(False)), F.coalesce("band", F.lit(False))).otherwise(True)
    return marked.join(wide, "sv_id", "left").select(*KEY, label_of(inside, F.col("ta"), F.col("tb"), k_prox, lambda_prox).alias("label"))


def coarse_or_fine(cost: DataFrame, seeds: DataFrame, volumes: DataFrame, steps: tuple[int, int, int]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cost, seeds and volumes of the grid that each fragment is searched on, and the fragments (sv_id) whose grid is coarse.

    A fragment takes the coarse grid unless all seeds of one side miss its foreground there.
    """
    coarse = regions.stride(cost, steps)
    placed = regions.seeds_on_grid(seeds, steps, coarse)
    ids = placed.groupBy("sv_id").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("sv_id")
    wide = volumes.select("sv_id", *(F.ceil(F.col(f"n{a}") / k).cast("int").alias(f"n{a}") for a, k in zip("zyx", steps)), *((F.col(f"s{a}") * float(k)).alias(f"s{a}") for a, k in zip("zyx", steps)))

    def chosen(small: DataFrame, full: DataFrame) -> DataFrame:
        return small.join(ids, "sv_id", "left_semi").unionByName(full.join(ids, "sv_id", "left_anti").select(*small.columns))

    return chosen(coarse, cost), chosen(placed, seeds), chosen(wide, volumes), ids


def written_back(grid: DataFrame, voxels: DataFrame, seeds: DataFrame, coarse: DataFrame | None = None, steps: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Labels of all ``voxels``: those of the ``grid``, upsampled for the fragments of ``coarse``, seeds forced, the rest to the source."""
    if coarse is None:
        full = voxels.select(*KEY).join(grid.select(*KEY, "label"), KEY, "left")
    else:
        up = regions.upsample(grid.join(coarse, "sv_id", "left_semi"), steps, voxels.join(coarse, "sv_id", "left_semi"))
        full = up.unionByName(voxels.select(*KEY).join(coarse, "sv_id", "left_anti").join(grid.select(*KEY, "label"), KEY, "left"))
    return regions.force_seeds(full, seeds).withColumn("label", F.when(F.col("label") == SINK, SINK).otherwise(SOURCE).cast("tinyint"))
