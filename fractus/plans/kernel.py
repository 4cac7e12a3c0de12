"""The watershed of one fragment on a dense (z, y, x) grid."""

from __future__ import annotations

import heapq
from itertools import product

import numpy as np

from ..functions.fields import SINK, SOURCE
from ..operators.offsets import OFFSETS

INF = np.inf


def edt(mask: np.ndarray, sampling: tuple[float, float, float]) -> np.ndarray:
    """Distance to the nearest background cell; infinite inside if there is none. The border isn't background."""
    d2 = np.where(mask, INF, 0.0)
    for axis, step in enumerate(sampling):
        best, n = d2.copy(), mask.shape[axis]
        for k in range(1, n):
            if (step * k) ** 2 >= best[mask].max(initial=0.0):
                break
            lo = [slice(None)] * 3
            hi = [slice(None)] * 3
            lo[axis], hi[axis] = slice(0, n - k), slice(k, n)
            lo, hi = tuple(lo), tuple(hi)
            best[lo] = np.minimum(best[lo], d2[hi] + (step * k) ** 2)
            best[hi] = np.minimum(best[hi], d2[lo] + (step * k) ** 2)
        d2 = best
    return np.sqrt(d2)


def erode(mask: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        padded = np.pad(mask, 1)
        mask = np.logical_and.reduce([padded[tuple(slice(1 + d, 1 + d + n) for d, n in zip(o, mask.shape))] for o in product((-1, 0, 1), repeat=3)])
    return mask


def snap(seeds: np.ndarray, mask: np.ndarray, sampling, use_boundary=True, erosion_iters=1, downsample=True, downsample_mode="random", downsample_stride=2, downsample_target=50_000, seed=0) -> np.ndarray:
    """Nearest candidate of each seed; ties to the smallest z, y, x."""
    if not len(seeds):
        return np.zeros((0, 3), int)
    from_mask = mask & ~erode(mask, erosion_iters) if use_boundary and erosion_iters >= 1 else mask
    found = np.argwhere(from_mask if from_mask.any() else mask)
    if downsample and downsample_mode == "stride":
        found = found[:: max(1, downsample_stride)]
    elif downsample and downsample_mode == "random" and len(found) > downsample_target:
        found = found[np.sort(np.random.default_rng(seed).choice(len(found), downsample_target, replace=False))]
    elif downsample and downsample_mode not in ("stride", "random"):
        raise ValueError("downsample_mode must be 'stride' or 'random'")
    if not len(found):
        raise ValueError("no candidate voxel")
    out = [found[int((((found - p) * np.array(sampling)) ** 2).sum(1).argmin())] for p in np.asarray(seeds, float)]
    return np.array(out, int)


def watershed(mask: np.ndarray, sources: np.ndarray, sinks: np.ndarray, sampling, compactness: float, line: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flooding of the negative distance from both sides' seeds over face neighbours.

    With ``compactness`` or a ``line`` a voxel gets its side when it leaves the
    queue, as a later entry may be cheaper; else when it enters.
    """
    kind = {"use_boundary": False, "downsample": False}
    a, b = (snap(s, mask, sampling, **kind) for s in (sources, sinks))
    height = -edt(mask, sampling)
    height[np.isinf(height)] = 0.0
    labels = np.zeros(mask.shape, np.uint8)
    for pts, side in ((a, SOURCE), (b, SINK)):
        for p in pts:
            labels[tuple(p)] = side
    queue = [(height[p], age, p, p) for age, p in enumerate(map(tuple, np.argwhere(labels).tolist()))]
    age = len(queue)
    heapq.heapify(queue)
    faces = [o for o in OFFSETS if sum(map(abs, o)) == 1]
    late = compactness > 0 or line
    while queue:
        _, _, p, origin = heapq.heappop(queue)
        beside = [q for q in (tuple(v + d for v, d in zip(p, o)) for o in faces) if all(0 <= v < n for v, n in zip(q, mask.shape)) and mask[q]]
        if late and p != origin:
            if labels[p] or (line and len({int(labels[q]) for q in beside} - {0}) > 1):
                continue
            labels[p] = labels[origin]
        for q in beside:
            if not labels[q]:
                far = float(np.sqrt(sum((v - w) ** 2 for v, w in zip(q, origin))))
                heapq.heappush(queue, (height[q] + compactness * far, age, q, origin))
                age += 1
                if not late:
                    labels[q] = labels[p]
    return labels, a, b
