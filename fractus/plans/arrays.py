"""One volume in memory in, one result out: the array interface over the table splitters."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.axes import checked, sampling_zyx
from ..sources.chunks import array_chunks, from_chunks
from ..sources.volumes import SEED, volume
from .profiling import NullProfiler, Profiler
from .splitters import SINK, SOURCE, RidgeConnectPrep, SeedPrep, Splitter
from .state import SplitResult


def seeds_zyx(points: np.ndarray, order: str = "xyz") -> np.ndarray:
    """(N, 3) coordinates rounded half to even, in z, y, x."""
    out = np.asarray(points, float)
    if out.size % 3 or (out.ndim > 1 and out.shape[-1] != 3):
        raise ValueError("seeds have three coordinates each")
    out = out.reshape(-1, 3)
    return np.rint(out if checked(order, "seed_order") == "zyx" else out[:, ::-1]).astype(int)


def seeds_from_zyx(points: np.ndarray, order: str = "xyz") -> np.ndarray:
    points = np.asarray(points, int).reshape(-1, 3)
    return points if checked(order, "seed_order") == "zyx" else points[:, ::-1]


def _tables(spark: SparkSession, mask: np.ndarray, sources, sinks, voxel_size, vol_order, vox_order, seed_order) -> tuple[DataFrame, DataFrame, DataFrame, tuple]:
    mask = np.asarray(mask)
    if mask.ndim != 3:
        raise ValueError("a mask has three dimensions")
    grid = mask.astype(bool) if checked(vol_order, "vol_order") == "zyx" else mask.astype(bool).transpose(2, 1, 0)
    size = sampling_zyx(voxel_size, vox_order)
    rows = [(0, side, i, *map(float, p)) for side, pts in ((SOURCE, sources), (SINK, sinks)) for i, p in enumerate(seeds_zyx(pts, seed_order))]
    return from_chunks(array_chunks(spark, 0, grid)), spark.createDataFrame(rows, SEED), volume(spark, [(0, *grid.shape, *size)]), grid.shape


def _points(df: DataFrame | None, side: int, order: str) -> np.ndarray:
    if df is None:
        return np.zeros((0, 3), int)
    rows = df.where(f"side = {side}").select("z", "y", "x").collect()
    return seeds_from_zyx(np.array([tuple(r) for r in rows], int), order)


def split_array(spark: SparkSession, splitter: Splitter, mask: np.ndarray, sources: np.ndarray, sinks: np.ndarray, *, voxel_size=(1.0, 1.0, 1.0), vol_order: str = "xyz", vox_order: str = "xyz", seed_order: str = "xyz", profiler: Profiler | None = None) -> SplitResult:
    """Split one volume that the caller holds; as much comes back to the driver as the caller gave."""
    profiler = profiler or NullProfiler()
    began = time.perf_counter()
    voxels, seeds, shape, grid = _tables(spark, mask, sources, sinks, voxel_size, vol_order, vox_order, seed_order)
    with profiler.profile("split"):
        out = splitter.split(voxels, seeds, shape)
        found = out.labels.select("z", "y", "x", "label").toArrow()
        labels = np.zeros(grid, np.uint8)
        labels[tuple(found.column(a).to_numpy() for a in "zyx")] = found.column("label").to_numpy()
    facts = out.diagnostics.first()
    augmented = [None, None] if out.augmented is None or out.augmented.isEmpty() else [_points(out.augmented, k, seed_order) for k in (SOURCE, SINK)]
    notes = {k: v for k, v in facts.asDict().items() if k not in ("sv_id", "facts")} if facts else {}
    notes["total_elapsed_s"] = time.perf_counter() - began
    return SplitResult(labels if checked(vol_order) == "zyx" else labels.transpose(2, 1, 0), out.side_of_label, _points(out.snapped, SOURCE, seed_order), _points(out.snapped, SINK, seed_order), *augmented, notes)


def prepare_array(spark: SparkSession, prep: SeedPrep | None, mask: np.ndarray, sources: np.ndarray, sinks: np.ndarray, *, voxel_size=(1.0, 1.0, 1.0), vol_order: str = "xyz", vox_order: str = "xyz", seed_order: str = "xyz") -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Prepared seeds of both sides of one volume, and whether each side could be prepared."""
    voxels, seeds, shape, _ = _tables(spark, mask, sources, sinks, voxel_size, vol_order, vox_order, seed_order)
    out = (prep or RidgeConnectPrep()).prepare(voxels, seeds, shape)
    ok = out.status.first()
    return _points(out.seeds, SOURCE, seed_order), _points(out.seeds, SINK, seed_order), bool(ok and ok.ok_source), bool(ok and ok.ok_sink)
