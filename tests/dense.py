"""The split of one fragment on a dense grid, step by step: what the plans over tables are held against.

Grids are (z, y, x) arrays of one fragment, background included.
"""

from __future__ import annotations

from itertools import product

import numpy as np

from fractus.functions.fields import BACKGROUND, SINK, SOURCE, STRAY
from fractus.operators.offsets import OFFSETS

INF = np.inf


def views(shape: tuple[int, int, int], o: tuple[int, int, int]) -> tuple[tuple, tuple]:
    """Slices of the cells that have a neighbour at ``o``, and of these neighbours."""
    here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, shape))
    there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, shape))
    return here, there


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


def normal(dist: np.ndarray) -> np.ndarray:
    most = dist.max(initial=0.0)
    if np.isinf(most):
        return np.where(np.isinf(dist), 1.0, 0.0)
    return dist / most if most > 0 else dist


def erode(mask: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        padded = np.pad(mask, 1)
        mask = np.logical_and.reduce([padded[tuple(slice(1 + d, 1 + d + n) for d, n in zip(o, mask.shape))] for o in product((-1, 0, 1), repeat=3)])
    return mask


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    out = mask.copy()
    for o in product(range(-radius, radius + 1), repeat=3):
        if 0 < sum(v * v for v in o) <= radius * radius and all(abs(d) < n for d, n in zip(o, mask.shape)):
            here, there = views(mask.shape, o)
            out[here] |= mask[there]
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Smallest row-major number in each 26-connected component, -1 outside."""
    none = mask.size
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), none)
    while True:
        least = label.copy()
        for o in OFFSETS:
            if all(abs(d) < n for d, n in zip(o, mask.shape)):
                here, there = views(mask.shape, o)
                np.minimum(least[here], label[there], out=least[here])
        least[~mask] = none
        jump = np.append(least.ravel(), none)  # a label is a cell; follow its own label
        for _ in range(4):
            jump[:-1] = jump[jump[:-1]]
        least = jump[:-1].reshape(mask.shape)
        if (least == label).all():
            return np.where(mask, label, -1)
        label = least


def arrival(cost: np.ndarray, starts: list[tuple], sampling: tuple[float, float, float], backend: str) -> np.ndarray:
    """Least travel cost of every cell from the starts, by rounds of relaxation until nothing changes."""
    t = np.full(cost.shape, INF)
    for p in starts:
        t[tuple(p)] = 0.0
    mean = sum(sampling) / 3.0
    steps = []
    for o in OFFSETS:
        if all(abs(d) < n for d, n in zip(o, cost.shape)):
            here, there = views(cost.shape, o)
            if backend == "mcp":
                w = 0.5 * (cost[here] + cost[there]) * float(np.sqrt(sum((d * s) ** 2 for d, s in zip(o, sampling))))
            else:
                w = cost[here] * mean
            steps.append((here, there, w))
    while True:
        before = t.copy()
        for here, there, w in steps:
            np.minimum(t[here], t[there] + w, out=t[here])
        if (t == before).all():
            return t


def path(cost: np.ndarray, start: tuple, end: tuple, sampling: tuple[float, float, float]) -> list[tuple] | None:
    """Cells of a least path; among equal ways back the neighbour of the smallest number."""
    t = arrival(cost, [start], sampling, "mcp")
    if not np.isfinite(t[end]):
        return None
    out = [end]
    while out[-1] != start:
        at, best = out[-1], None
        for o in OFFSETS:
            p = tuple(a + d for a, d in zip(at, o))
            if all(0 <= v < n for v, n in zip(p, cost.shape)) and t[p] < t[at]:
                reach = t[p] + 0.5 * (cost[p] + cost[at]) * float(np.sqrt(sum((d * s) ** 2 for d, s in zip(o, sampling))))
                if best is None or (reach, p) < best:
                    best = (reach, p)
        out.append(best[1])
    return out


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


# --- repair -------------------------------------------------------------------


def enforce(labels: np.ndarray, side: int, seeds: np.ndarray, allow_stray: bool) -> int:
    """Demote components of ``side`` without its seeds (all but the largest if none has one); returns how many voxels."""
    mask = labels == side
    comp = components(mask)
    ids, counts = np.unique(comp[mask], return_counts=True)
    if len(ids) <= 1:
        return 0
    keep = {int(comp[tuple(p)]) for p in seeds if labels[tuple(p)] == side} or {int(ids[counts.argmax()])}
    bad = mask & ~np.isin(comp, list(keep))
    if allow_stray:
        labels[bad] = STRAY
    return int(bad.sum())


def resolve(labels: np.ndarray, sources: np.ndarray, sinks: np.ndarray, sampling) -> int:
    """Give stray components to a side by border vote, else by the nearer seeds; returns how many voxels moved."""
    mask = labels == STRAY
    comp = components(mask)
    touch = {side: dilate_full(labels == side) & mask for side in (SOURCE, SINK)}
    moved = 0
    before = labels.copy()
    for c in np.unique(comp[mask]).tolist():
        cells = comp == c
        a, b = int(touch[SOURCE][cells].sum()), int(touch[SINK][cells].sum())
        side = SOURCE if a > b else SINK if b > a else 0
        if not side and len(sources) and len(sinks):
            at = np.argwhere(cells) * np.array(sampling)
            d = [((at[:, None] - np.asarray(s) * np.array(sampling)) ** 2).sum(2).min(1) for s in (sources, sinks)]
            side = SINK if 2 * int((d[1] < d[0]).sum()) > len(at) else SOURCE
        if side:
            before[cells] = side
            moved += int(cells.sum())
    labels[:] = before
    return moved


def dilate_full(mask: np.ndarray) -> np.ndarray:
    padded = np.pad(mask, 1)
    return np.logical_or.reduce([padded[tuple(slice(1 + d, 1 + d + n) for d, n in zip(o, mask.shape))] for o in OFFSETS])


# --- the geodesic split ---------------------------------------------------------


def geodesic(mask: np.ndarray, sources: np.ndarray, sinks: np.ndarray, sampling, cfg) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Labels, snapped seeds of both sides, diagnostics."""
    a, b = (snap(s, mask, sampling, **cfg.snap) for s in (sources, sinks))
    labels = np.zeros(mask.shape, np.uint8)
    facts: dict = {"backend": None, "downsample_zyx": None, "fg_bbox_shape_zyx": (0, 0, 0), "pre_resolve": None}
    if not len(a) or not len(b) or not mask.any():
        labels[mask] = SOURCE
        return labels, a, b, facts
    at = np.argwhere(mask)
    low = np.maximum(at.min(0) - cfg.halo, 0)
    high = np.minimum(at.max(0) + 1 + cfg.halo, mask.shape)
    box = tuple(slice(int(p), int(q)) for p, q in zip(low, high))
    crop, out = mask[box], labels[box]
    ac, bc = a - low, b - low
    speed = np.clip(normal(edt(crop, sampling)) ** max(cfg.gamma_neck, 0.0), 1e-6, 1.0)
    cost = np.where(crop, 1.0 / speed, BACKGROUND)
    steps = cfg.downsample_geodesic
    grid, inside, size = cost, crop, tuple(sampling)
    sa, sb = [tuple(p) for p in ac], [tuple(p) for p in bc]
    if steps is not None:
        every = tuple(slice(None, None, int(s)) for s in steps)
        da, db = ([tuple(q) for q in np.asarray(pts) // np.array(steps) if crop[every][tuple(q)]] for pts in (ac, bc))
        if da and db:
            grid, inside, sa, sb = cost[every], crop[every], da, db
            size = tuple(s * k for s, k in zip(sampling, steps))
        else:
            steps = None
    ta, tb = (np.where(inside, arrival(grid, s, size, cfg.backend), INF) for s in (sa, sb))
    sub = label_grid(ta, tb, inside, cfg)
    for pts, side in ((sa, SOURCE), (sb, SINK)):
        for p in pts:
            sub[p] = side
    if steps is not None:
        for axis, k in enumerate(steps):
            sub = np.repeat(sub, k, axis)
        sub = np.where(crop, sub[tuple(slice(0, n) for n in crop.shape)], 0)
        for pts, side in ((ac, SOURCE), (bc, SINK)):
            for p in pts:
                sub[tuple(p)] = side
    out[crop] = SOURCE
    out[sub == SINK] = SINK
    repair(out, ac, bc, sampling, cfg, facts)
    facts |= {"backend": cfg.backend, "downsample_zyx": steps, "fg_bbox_shape_zyx": crop.shape}
    return labels, a, b, facts


def label_grid(ta: np.ndarray, tb: np.ndarray, inside: np.ndarray, cfg) -> np.ndarray:
    both = np.isfinite(ta) & np.isfinite(tb) & inside
    with np.errstate(invalid="ignore"):
        near = np.abs(ta - tb) / (ta + tb + 1e-12) <= cfg.narrow_band_rel
    band = both & near
    if cfg.nb_dilate > 0:
        band = dilate(band, cfg.nb_dilate) & inside
    if band.sum() < 64:
        band = inside
    with np.errstate(invalid="ignore", over="ignore"):
        ca = ta / (1.0 + cfg.k_prox * np.exp(-cfg.lambda_prox * np.maximum(tb, 0)))
        cb = tb / (1.0 + cfg.k_prox * np.exp(-cfg.lambda_prox * np.maximum(ta, 0)))
    first = np.where(band, ca <= cb, ta <= tb)
    return np.where(inside, np.where(first, SOURCE, SINK), 0).astype(np.uint8)


def repair(out: np.ndarray, sources: np.ndarray, sinks: np.ndarray, sampling, cfg, facts: dict) -> None:
    def once() -> None:
        for side, seeds in ((SOURCE, sources), (SINK, sinks)):
            enforce(out, side, seeds, cfg.allow_third_label)

    if cfg.enforce_single_cc:
        once()
    facts["pre_resolve"] = tuple(int((out == k).sum()) for k in (SOURCE, SINK, STRAY))
    if (out == STRAY).any() and resolve(out, sources, sinks, sampling) and cfg.enforce_single_cc:
        once()
    if cfg.raise_if_multi_cc:
        for side in (SOURCE, SINK):
            n = len(np.unique(components(out == side)[out == side]))
            if n > 1:
                raise ValueError(f"label {side} has {n} connected components")


# --- bridging seeds -----------------------------------------------------------------


def spanning_tree(points: np.ndarray, sampling) -> list[tuple[int, int]]:
    """Edges (in tree, new) in the order in which the tree grows from the first point; ties to the lowest index."""
    phys = np.asarray(points, float) * np.array(sampling)
    reach = {j: (float(((phys[j] - phys[0]) ** 2).sum()), j, 0) for j in range(1, len(phys))}
    edges = []
    while reach:
        _, j, i = min(reach.values())
        edges.append((i, j))
        del reach[j]
        for k, old in reach.items():
            d = float(((phys[k] - phys[j]) ** 2).sum())
            if d < old[0]:
                reach[k] = (d, k, j)
    return edges


def ridge(mask: np.ndarray, sources: np.ndarray, sinks: np.ndarray, sampling, cfg) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Seeds of both sides with the voxels of ridge paths between them, and whether each side could be joined."""
    a, b = (snap(s, mask, sampling, **cfg.snap) for s in (sources, sinks))
    if not len(a) or not len(b):
        return a, b, len(a) > 0, len(b) > 0
    both = np.vstack([a, b])
    low = np.maximum(both.min(0) - cfg.roi_pad_zyx, 0)
    high = np.minimum(both.max(0) + 1 + cfg.roi_pad_zyx, mask.shape)
    roi = mask[tuple(slice(int(p), int(q)) for p, q in zip(low, high))]
    steps = np.array(cfg.downsample)
    coarse = roi[tuple(slice(None, None, int(s)) for s in steps)]
    size = tuple(float(s * k) for s, k in zip(sampling, steps))
    if not coarse.any():
        return a, b, False, False
    placed = [snap((pts - low) / steps, coarse, size, use_boundary=False, downsample=False) for pts in (a, b)]

    def field(grid: np.ndarray, scale) -> np.ndarray:
        return np.where(grid, 1.0 / (1e-6 + np.clip(normal(edt(grid, scale)), 0, 1) ** max(0.0, cfg.ridge_power)), BACKGROUND)

    cost, fine = field(coarse, size), None
    out, fine_ok = [], []
    for pts, seeds in zip(placed, (a, b)):
        way, ok = np.zeros(coarse.shape, bool), True
        for i, j in spanning_tree(pts, size):
            cells = path(cost, tuple(int(v) for v in pts[i]), tuple(int(v) for v in pts[j]), size)
            if cells is None and cfg.refine_fullres_when_fail:
                fine = field(roi, sampling) if fine is None else fine
                full = path(fine, tuple(int(v) for v in pts[i] * steps), tuple(int(v) for v in pts[j] * steps), sampling)
                cells = None if full is None else [tuple(int(v // k) for v, k in zip(p, steps)) for p in full if all(v % k == 0 for v, k in zip(p, steps))]
            if cells is None:
                ok = False
            else:
                for p in cells:
                    way[p] = True
        wide = way
        for axis, k in enumerate(steps):
            wide = np.repeat(wide, int(k), axis)
        wide = wide[tuple(slice(0, n) for n in roi.shape)] & roi
        wide = dilate(wide, 1) & roi
        out.append(np.unique(np.vstack([seeds, np.argwhere(wide) + low]), axis=0) if wide.any() else np.unique(seeds, axis=0))
        fine_ok.append(ok)
    if not all(fine_ok):
        return a, b, fine_ok[0], fine_ok[1]
    return out[0], out[1], True, True
