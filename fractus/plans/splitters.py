"""Splitters over tables of fragments: all fragments of a table at once.

The geodesic split and its preparation are plans over the operators: shuffles by
line, voxel and block, and loops that advance all fragments together, so a
fragment may be larger than a task. The watershed alone still takes a fragment
whole (:func:`_by_fragment`).
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axes import rounded
from ..functions.fields import SINK, SOURCE, STRAY
from ..operators import distance, graph, labels, regions, resolve, ridge, snap
from . import kernel
from .fixpoint import cut, keeping, kept, measured_joins
from .profiling import NullProfiler, Profiler

__all__ = ["SOURCE", "SINK", "STRAY", "Splitter", "SeedPrep", "SplitFrames", "SeedFrames", "GeodesicSplitter", "RidgeConnectPrep", "WatershedSplitter", "NoopSplitter"]

#: Default options of the snap of seeds.
SNAP = {"use_boundary": True, "erosion_iters": 1, "downsample": True, "downsample_mode": "random", "downsample_target": 50_000}


@dataclass(frozen=True)
class SplitFrames:
    """labels (sv_id, z, y, x, label) of all foreground voxels that got one; snapped and augmented seeds (sv_id, side, z, y, x); diagnostics, a row for each fragment; reports of the repair by name."""

    labels: DataFrame
    snapped: DataFrame
    augmented: DataFrame | None
    diagnostics: DataFrame
    side_of_label: dict[int, int]
    reports: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class SeedFrames:
    """seeds (sv_id, side, z, y, x) and status (sv_id, ok_source, ok_sink)."""

    seeds: DataFrame
    status: DataFrame


@runtime_checkable
class Splitter(Protocol):
    """Gives each foreground voxel of each fragment a side."""

    def split(self, voxels: DataFrame, seeds: DataFrame, volumes: DataFrame) -> SplitFrames: ...


@runtime_checkable
class SeedPrep(Protocol):
    """Prepares seeds before a split."""

    def prepare(self, voxels: DataFrame, seeds: DataFrame, volumes: DataFrame) -> SeedFrames: ...


ROWS = "sv_id long, kind string, side tinyint, z int, y int, x int, label tinyint, facts map<string,string>"


def _by_fragment(voxels: DataFrame, seeds: DataFrame, volumes: DataFrame, work) -> DataFrame:
    """Run ``work(mask, sources, sinks, sampling)`` for each fragment; its rows by :data:`ROWS`.

    ``work`` gets the dense mask of the fragment's whole volume (one byte a
    cell), on whose border the distance depends.
    """
    v = voxels.select("sv_id", F.lit(0).cast("tinyint").alias("side"), F.lit(0).alias("seed_idx"), *(F.col(a).cast("double").alias(a) for a in "zyx"))
    s = seeds.select("sv_id", F.col("side").cast("tinyint").alias("side"), F.col("seed_idx").cast("int").alias("seed_idx"), *(F.col(a).cast("double").alias(a) for a in "zyx"))
    shape = volumes.select("sv_id", *(F.col(f"n{a}").cast("int").alias(f"n{a}") for a in "zyx"), *(F.col(f"s{a}").cast("double").alias(f"s{a}") for a in "zyx"))
    # Three tables cogrouped two by two: the volume's row rides on the seeds, and stands alone without any.
    with_shape = shape.join(s, "sv_id", "left")

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: [] for c in ("sv_id", "kind", "side", "z", "y", "x", "label", "facts")})
        if not len(right):
            return empty
        first = right.iloc[0]
        sv, full = int(first.sv_id), tuple(int(first[f"n{a}"]) for a in "zyx")
        sampling = tuple(float(first[f"s{a}"]) for a in "zyx")
        mask = np.zeros(full, bool)
        at = left[["z", "y", "x"]].to_numpy(int)
        mask[tuple(at.T)] = True
        ordered = right.dropna(subset=["side"]).sort_values("seed_idx", kind="stable")
        sides = [np.rint(ordered.loc[ordered.side == k, ["z", "y", "x"]].to_numpy(float)).astype(int) for k in (SOURCE, SINK)]
        labels, snapped, augmented, facts = work(mask, sides[0], sides[1], sampling)
        parts = []
        if labels is not None:
            p = np.argwhere(labels)
            parts.append(pd.DataFrame({"kind": "label", "side": 0, "z": p[:, 0], "y": p[:, 1], "x": p[:, 2], "label": labels[tuple(p.T)]}))
        for kind, pair in (("snapped", snapped), ("augmented", augmented)):
            for side, pts in zip((SOURCE, SINK), pair or ()):
                pts = np.asarray(pts, int).reshape(-1, 3)
                parts.append(pd.DataFrame({"kind": kind, "side": side, "z": pts[:, 0], "y": pts[:, 1], "x": pts[:, 2], "label": 0}))
        out = pd.concat(parts) if parts else empty.drop(columns=["sv_id", "facts"])
        out["facts"] = None
        note = {"full_shape_zyx": str(full)} | {k: str(v) for k, v in facts.items()}
        out = pd.concat([out, pd.DataFrame([{"kind": "facts", "side": 0, "z": 0, "y": 0, "x": 0, "label": 0, "facts": note}])])
        out.insert(0, "sv_id", sv)
        return out.astype({"side": "int8", "z": "int32", "y": "int32", "x": "int32", "label": "int8"})

    return v.groupBy("sv_id").cogroup(with_shape.groupBy("sv_id")).applyInPandas(one, ROWS)


def _frames(rows: DataFrame, sides: dict[int, int]) -> SplitFrames:
    rows = cut(rows)  # several tables are taken from one run
    seeds = lambda kind: rows.where(F.col("kind") == kind).select("sv_id", "side", "z", "y", "x")
    return SplitFrames(rows.where("kind = 'label'").select("sv_id", "z", "y", "x", "label"), seeds("snapped"), seeds("augmented"), rows.where("kind = 'facts'").select("sv_id", "facts"), sides)


class Stages:
    """Passes names of stages on to a profiler and keeps their seconds."""

    def __init__(self, profiler: Profiler):
        self.profiler, self.began, self.seconds = profiler, time.perf_counter(), {}

    @contextmanager
    def profile(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        with self.profiler.profile(name):
            yield
        self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began


def _shapes(volumes: DataFrame) -> DataFrame:
    return volumes.select(F.col("sv_id").cast("long").alias("sv_id"), *(F.col(f"n{a}").cast("int").alias(f"n{a}") for a in "zyx"), *(F.col(f"s{a}").cast("double").alias(f"s{a}") for a in "zyx"))


def _snapped(seeds: DataFrame, voxels: DataFrame, volumes: DataFrame, options: dict[str, Any]) -> DataFrame:
    """Rounded seeds on their nearest candidates: (sv_id, side, seed_idx, z, y, x)."""
    whole = seeds.select("sv_id", F.col("side").cast("tinyint").alias("side"), F.col("seed_idx").cast("int").alias("seed_idx"), *(rounded(F.col(a)).cast("double").alias(a) for a in "zyx"))
    found = snap.snap_seeds(whole, voxels, volumes, **(SNAP | options))
    return kept(found.select("sv_id", "side", "seed_idx", *(F.col(f"v{a}").cast("int").alias(a) for a in "zyx")))


@dataclass(frozen=True)
class RidgeConnectPrep:
    """Bridges seeds of one side along the ridge of the distance: spanning tree, least paths, dilation.

    ``refine_fullres_when_fail`` is accepted for completeness: background can be
    crossed at its cost, so a path never fails on the coarse grid.
    """

    ridge_power: float = 2.0
    roi_pad_zyx: tuple[int, int, int] = (24, 48, 48)
    downsample: tuple[int, int, int] = (2, 2, 1)
    refine_fullres_when_fail: bool = True
    snap: dict[str, Any] = field(default_factory=lambda: dict(SNAP))
    profiler: Profiler = field(default_factory=NullProfiler, compare=False)

    def prepare(self, voxels: DataFrame, seeds: DataFrame, volumes: DataFrame) -> SeedFrames:
        measured_joins(voxels.sparkSession)
        shapes = _shapes(volumes)
        with keeping():
            with self.profiler.profile("ridge:snap"):
                points = _snapped(seeds, voxels, shapes, self.snap)
            with self.profiler.profile("ridge:augment"):
                out, status = ridge.augmented_seeds(points, voxels, shapes, self.ridge_power, self.roi_pad_zyx, self.downsample)
                return SeedFrames(cut(out), cut(status))


@dataclass(frozen=True)
class GeodesicSplitter:
    """Splits by travel time from both sides' seeds, slowed in narrow necks; then repairs components.

    ``seed_prep``: "ridge" (the default preparation), "none", or a SeedPrep.
    ``snap`` holds for both; what it leaves out has the defaults. ``parallel`` is
    accepted for completeness: both sides are always searched together.
    Raises RuntimeError if the preparation fails for a fragment, ValueError if one with
    seeds has no voxel, or if a side ends in several components and ``raise_if_multi_cc`` is set.

    Paths stay in the foreground, as crossing background costs more than any way
    within (up to half a million voxels at the highest cost). Where a component
    has no seed, so that background must be crossed to reach it, the fragment's
    box is searched with its background; no other fragment is.
    """

    halo: int = 1
    gamma_neck: float = 1.6
    k_prox: float = 2.0
    lambda_prox: float = 1.0
    narrow_band_rel: float = 0.08
    nb_dilate: int = 1
    downsample_geodesic: tuple[int, int, int] | None = None
    seed_prep_downsample: tuple[int, int, int] | None = None
    allow_third_label: bool = True
    enforce_single_cc: bool = True
    backend: str = "dj3d"
    parallel: bool = True
    snap: dict[str, Any] = field(default_factory=lambda: dict(SNAP))
    seed_prep: Any = "ridge"
    raise_if_multi_cc: bool = False
    profiler: Profiler = field(default_factory=NullProfiler, compare=False)

    def __post_init__(self) -> None:
        if self.backend not in ("dj3d", "mcp"):
            raise ValueError(f"unknown backend {self.backend!r}")

    def split(self, voxels: DataFrame, seeds: DataFrame, volumes: DataFrame) -> SplitFrames:
        measured_joins(voxels.sparkSession)
        with keeping():
            return self._split(voxels, seeds, volumes, Stages(self.profiler))

    def _split(self, voxels: DataFrame, seeds: DataFrame, volumes: DataFrame, stages: Stages) -> SplitFrames:
        voxels = voxels.select("sv_id", *(F.col(a).cast("int").alias(a) for a in "zyx"))
        shapes = kept(_shapes(volumes))
        augmented = None
        with stages.profile("seed_prep"):
            prep = self._preparation()
            if prep is not None:
                made = prep.prepare(voxels, seeds, shapes)
                failed = made.status.where("NOT (ok_source AND ok_sink)").limit(1).collect()
                if failed:
                    raise RuntimeError(f"seed preparation failed for fragment {failed[0].sv_id}: source {failed[0].ok_source}, sink {failed[0].ok_sink}")
                augmented = made.seeds
                order = F.row_number().over(Window.partitionBy("sv_id", "side").orderBy("z", "y", "x"))
                seeds = augmented.withColumn("seed_idx", order.cast("int"))
        with stages.profile("snap"):
            points = _snapped(seeds, voxels, shapes, self.snap)
        # Fragments that lack seeds of a side go to the source whole.
        ids = kept(points.groupBy("sv_id").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("sv_id"))
        mine = lambda df: df.join(ids, "sv_id", "left_semi")
        with stages.profile("cost"):
            boxes = kept(regions.padded_box(mine(voxels), mine(shapes), (self.halo,) * 3))
            crop, inner = kept(regions.crop(mine(voxels), boxes)), kept(regions.box_volumes(boxes, shapes))
            placed = kept(regions.crop(mine(points), boxes))
            cost = kept(distance.cost_fields(kept(distance.squared_distance(crop, inner)), self.gamma_neck).select("sv_id", "z", "y", "x", "cost"))
        with stages.profile("arrival"):
            coarse, grid = None, (cost, placed, inner)
            if self.downsample_geodesic is not None:
                *grid, coarse = map(kept, labels.coarse_or_fine(cost, placed, inner, self.downsample_geodesic))
            times = self._times(*grid)
        with stages.profile("writeback"):
            found = labels.grid_labels(times, self.narrow_band_rel, self.nb_dilate, self.k_prox, self.lambda_prox)
            found = regions.force_seeds(found, grid[1])
            first = kept(labels.written_back(found, crop, placed, coarse, self.downsample_geodesic or (1, 1, 1)))
        done = resolve.repair(first, placed, inner, self.enforce_single_cc, self.allow_third_label, stages)
        if self.raise_if_multi_cc:
            parts = resolve.side_components(done.labels, inner).groupBy("sv_id", "label").agg(F.count_distinct("comp").alias("n"))
            several = parts.where("n > 1").limit(1).collect()
            if several:
                raise ValueError(f"fragment {several[0].sv_id}: label {several[0].label} has {several[0].n} connected components")
        low = boxes.select("sv_id", *(F.col(f"{a}0").alias(f"low{a}") for a in "zyx"))
        back = done.labels.join(low, "sv_id").select("sv_id", *((F.col(a) + F.col(f"low{a}")).cast("int").alias(a) for a in "zyx"), "label")
        rest = voxels.join(ids, "sv_id", "left_anti").withColumn("label", F.lit(SOURCE).cast("tinyint"))
        whole = cut(back.unionByName(rest))
        facts = cut(self._diagnostics(whole, done.before, shapes, inner, coarse, stages))
        reports = {"resolve_stray": cut(done.resolved)} | ({} if done.enforced is None else {"enforce_cc": cut(done.enforced)})
        return SplitFrames(whole, cut(points.select("sv_id", "side", "z", "y", "x")), augmented, facts, {SOURCE: SOURCE, SINK: SINK}, reports)

    def _preparation(self) -> SeedPrep | None:
        if isinstance(self.seed_prep, SeedPrep):
            return self.seed_prep
        steps = self.seed_prep_downsample or self.downsample_geodesic or (2, 2, 1)
        return RidgeConnectPrep(downsample=steps, snap=self.snap) if self.seed_prep in (None, "ridge") else None

    def _times(self, cost: DataFrame, seeds: DataFrame, volumes: DataFrame) -> DataFrame:
        """Arrivals at all foreground cells, through background in fragments where neither side reaches a cell without."""
        found = kept(graph.arrival(cost, seeds, volumes, self.backend))
        lost = kept(found.where("t_a IS NULL AND t_b IS NULL").select("sv_id").distinct())
        if lost.isEmpty():
            return found
        mine = lambda df: df.join(lost, "sv_id", "left_semi")
        dense = graph.arrival(regions.with_background(mine(cost), mine(volumes)), mine(seeds), mine(volumes), self.backend)
        inside = dense.join(cost.select("sv_id", "z", "y", "x"), ["sv_id", "z", "y", "x"], "left_semi")
        return kept(found.join(lost, "sv_id", "left_anti").unionByName(inside))

    def _diagnostics(self, done: DataFrame, before: DataFrame, shapes: DataFrame, inner: DataFrame, coarse: DataFrame | None, stages: Stages) -> DataFrame:
        """A row for each fragment: sv_id, backend, full_shape_zyx, fg_bbox_shape_zyx, downsample_zyx, label_counts, pre_resolve_label_counts, total_elapsed_s, stage_elapsed_s (seconds of all fragments together)."""
        sizes = F.array("nz", "ny", "nx")
        out = shapes.select("sv_id", sizes.alias("full_shape_zyx")).join(inner.select("sv_id", sizes.alias("fg_bbox_shape_zyx")), "sv_id", "left")
        for frame, name in ((done, "label_counts"), (before, "pre_resolve_label_counts")):
            out = out.join(regions.histogram(frame).select("sv_id", _counts().alias(name)), "sv_id", "left")
        steps = F.array(*map(F.lit, self.downsample_geodesic)) if coarse is not None else F.lit(None)
        out = out.join(coarse.withColumn("is_coarse", F.lit(True)), "sv_id", "left") if coarse is not None else out.withColumn("is_coarse", F.lit(False))
        seconds = F.create_map(*(F.lit(v) for pair in stages.seconds.items() for v in pair))
        return out.select("sv_id", F.lit(self.backend).alias("backend"), "full_shape_zyx", F.coalesce("fg_bbox_shape_zyx", F.array(*[F.lit(0)] * 3)).alias("fg_bbox_shape_zyx"), F.when(F.col("is_coarse"), steps).cast("array<int>").alias("downsample_zyx"), "label_counts", "pre_resolve_label_counts", F.lit(time.perf_counter() - stages.began).alias("total_elapsed_s"), seconds.alias("stage_elapsed_s"))


def _counts() -> Column:
    return F.create_map(F.lit(SOURCE), F.col("n_source"), F.lit(SINK), F.col("n_sink"), F.lit(STRAY), F.col("n_stray"))


@dataclass(frozen=True)
class WatershedSplitter:
    """Seeded watershed of the negative distance."""

    compactness: float = 1e-3
    watershed_line: bool = False
    profiler: Profiler = field(default_factory=NullProfiler, compare=False)

    def split(self, voxels: DataFrame, seeds: DataFrame, volumes: DataFrame) -> SplitFrames:
        compactness, line = self.compactness, self.watershed_line

        def work(mask, sources, sinks, sampling):
            labels, a, b = kernel.watershed(mask, sources, sinks, sampling, compactness, line)
            return labels, (a, b), None, {}

        with self.profiler.profile("watershed"):
            return _frames(_by_fragment(voxels, seeds, volumes, work), {SOURCE: SOURCE, SINK: SINK})


@dataclass(frozen=True)
class NoopSplitter:
    """All foreground to the source; seeds are rounded, not moved. No shuffle."""

    model_path: str | None = None

    def split(self, voxels: DataFrame, seeds: DataFrame, volumes: DataFrame) -> SplitFrames:
        labels = voxels.select("sv_id", "z", "y", "x", F.lit(SOURCE).cast("tinyint").alias("label"))
        placed = seeds.select("sv_id", "side", *(rounded(F.col(a)).cast("int").alias(a) for a in "zyx"))
        return SplitFrames(labels, placed, None, volumes.select("sv_id", F.create_map().cast("map<string,string>").alias("facts")), {SOURCE: SOURCE})
