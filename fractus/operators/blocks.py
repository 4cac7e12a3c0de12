"""Voxels by blocks of their volume: what is settled within a block needs no join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .offsets import OFFSETS

#: Edge of a block; a task holds one block with a border of one voxel.
EDGE = 64
BLOCK = ["sv_id", "bz", "by", "bx"]


def with_blocks(voxels: DataFrame) -> DataFrame:
    return voxels.withColumns({f"b{a}": F.floor(F.col(a) / EDGE).cast("int") for a in "zyx"})


def on_border() -> Column:
    """Voxels that may have neighbours in another block."""
    out = F.lit(False)
    for a in "zyx":
        out = out | (F.col(a) % EDGE == 0) | (F.col(a) % EDGE == EDGE - 1)
    return out


def blocks_beside() -> Column:
    """Array of the blocks (z, y, x) other than its own in which a voxel has neighbouring places."""
    places = F.array(*[F.struct(*(F.floor((F.col(a) + d) / EDGE).cast("int").alias(a) for a, d in zip("zyx", o))) for o in OFFSETS])
    return F.filter(F.array_distinct(places), lambda p: (p["z"] != F.col("bz")) | (p["y"] != F.col("by")) | (p["x"] != F.col("bx")))


class Box:
    """The smallest box around some rows' places, with a margin of one cell, as flat numbers in row-major order."""

    def __init__(self, rows: pd.DataFrame):
        at = rows[["z", "y", "x"]].to_numpy(np.int64)
        self.low = at.min(0) - 1
        self.shape = at.max(0) - self.low + 2
        self.size = int(self.shape.prod())
        self.by = np.array([self.shape[1] * self.shape[2], self.shape[2], 1])
        self.at = (at - self.low) @ self.by
        self.steps = [int(np.dot(o, self.by)) for o in OFFSETS]

    def places(self, flat: np.ndarray) -> np.ndarray:
        return np.stack(np.unravel_index(flat, self.shape), 1) + self.low


def smallest_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (sv_id, z, y, x, node, part): the smallest node that a voxel reaches within its block."""
    box = Box(rows)
    none = box.size
    label = np.full(box.size + 1, none)
    label[box.at] = box.at
    cells = np.sort(box.at)
    while True:
        least = label[cells]
        for step in box.steps:
            np.minimum(least, label[cells + step], out=least)
        for _ in range(4):  # a label is a cell: follow its own
            least = np.minimum(least, label[least])
        if (least == label[cells]).all():
            break
        label[cells] = least
    node = np.zeros(box.size, np.int64)
    node[box.at] = rows["node"]
    return rows.assign(part=node[label[box.at]])[["sv_id", "z", "y", "x", "node", "part"]]


class Costs:
    """Edges of the 26-neighbourhood over the cells of a box: for mcp the mean cost of both ends times their distance, for dj3d the cost of the end reached times the mean voxel size."""

    def __init__(self, rows: pd.DataFrame, backend: str):
        self.box, self.mcp = Box(rows), backend == "mcp"
        size = [float(rows[f"s{a}"].iloc[0]) for a in "zyx"]
        self.cost = np.full(self.box.size, np.inf)
        self.cost[self.box.at] = rows["cost"]
        self.lengths = [float(np.sqrt(sum((d * s) * (d * s) for d, s in zip(o, size)))) for o in OFFSETS]
        self.mean = (size[0] + size[1] + size[2]) / 3.0

    def weight(self, here: np.ndarray, there: np.ndarray, k: int) -> np.ndarray:
        """Of the step from cells ``here`` to those beside them, ``there``, along the k-th offset."""
        return 0.5 * (self.cost[here] + self.cost[there]) * self.lengths[k] if self.mcp else self.cost[there] * self.mean

    def settle(self, t: np.ndarray) -> np.ndarray:
        """Least times of all cells, given those of some; only what changed is looked at again."""
        changed = np.zeros(len(t), bool)
        active = np.flatnonzero(np.isfinite(t))
        while len(active):
            for k, step in enumerate(self.box.steps):
                there = active + step
                new = t[active] + self.weight(active, there, k)
                better = new < t[there]
                if better.any():
                    there = there[better]
                    t[there] = new[better]
                    changed[there] = True
            active = np.flatnonzero(changed)
            changed[active] = False
        return t

    def before(self, t: np.ndarray) -> np.ndarray:
        """For each cell of the rows the cell from which its time comes, by number, the first of equals; -1 without any."""
        cells = self.box.at
        best, out = np.full(len(cells), np.inf), np.full(len(cells), -1)
        for k, step in enumerate(self.box.steps):  # offsets ascend, so the first of equals is the smallest place
            there = cells + step
            reach = np.where(t[there] < t[cells], t[there] + self.weight(there, cells, k), np.inf)
            better = reach < best
            best[better], out[better] = reach[better], there[better]
        return out


class Boxes:
    """Searches in volumes of their own, side by side in flat arrays: each in a box with a margin of one cell.

    ``searches``: a row for each, with the shape (nz, ny, nx), the voxel's size (sz,
    sy, sx) and the places of start (z0, y0, x0) and end (z1, y1, x1); ``cells``
    (sv_id, z, y, x, cost). Steps cost what they do in :class:`Costs`.
    """

    def __init__(self, searches: pd.DataFrame, cells: pd.DataFrame, backend: str):
        self.mcp = backend == "mcp"
        shape = searches[["nz", "ny", "nx"]].to_numpy(np.int64) + 2
        size = searches[["sz", "sy", "sx"]].to_numpy(float)
        sizes = shape.prod(1)
        self.first = np.cumsum(sizes) - sizes
        self.by = np.stack([shape[:, 1] * shape[:, 2], shape[:, 2], np.ones(len(shape), np.int64)], 1)
        self.of = np.repeat(np.arange(len(shape), dtype=np.int32), sizes)
        # A step's way in the flat array and its length, for each offset by search; plain numbers where all are the same.
        step = [self.by @ np.array(o) for o in OFFSETS]
        length = [np.sqrt(sum((d * s) * (d * s) for d, s in zip(o, size.T))) for o in OFFSETS]
        same = len(searches) and (shape == shape[0]).all() and (size == size[0]).all()
        self.steps = [(int(s[0]), float(n[0])) for s, n in zip(step, length)] if same else list(zip(step, length))
        self.same, self.least = same, np.min(length, axis=0)
        self.mean = (size[:, 0] + size[:, 1] + size[:, 2]) / 3.0
        self.start, self.end = (self.first + ((searches[[f"z{k}", f"y{k}", f"x{k}"]].to_numpy(np.int64) + 1) * self.by).sum(1) for k in (0, 1))
        self.shape = shape
        self.cost = np.full(int(sizes.sum()), np.inf)
        sv = searches["sv_id"].to_numpy()
        cells = cells.sort_values("sv_id", kind="stable")
        at, value, owner = cells[["z", "y", "x"]].to_numpy(np.int64) + 1, cells["cost"].to_numpy(float), cells["sv_id"].to_numpy()
        low, high = np.searchsorted(owner, sv, "left"), np.searchsorted(owner, sv, "right")
        for k, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
            self.cost[self.first[k] + at[a:b] @ self.by[k]] = value[a:b]
        self.t = np.full(len(self.cost), np.inf)

    def _step(self, k: int, searches: np.ndarray) -> tuple:
        step, length = self.steps[k]
        return (step, length) if self.same else (step[searches], length[searches])

    def _weight(self, here: np.ndarray, there: np.ndarray, length, searches: np.ndarray) -> np.ndarray:
        return 0.5 * (self.cost[here] + self.cost[there]) * length if self.mcp else self.cost[there] * self.mean[searches]

    def lost(self) -> np.ndarray:
        """Searches that haven't found their end."""
        return ~np.isfinite(self.t[self.end])

    def fill(self, which: np.ndarray, cost: float) -> None:
        """Give all cells of some searches' volumes that had no cost this one, and forget their times."""
        for k in np.flatnonzero(which).tolist():
            here = slice(self.first[k], self.first[k] + self.shape[k].prod())
            inner = self.cost[here].reshape(self.shape[k])[1:-1, 1:-1, 1:-1]
            inner[np.isinf(inner)] = cost
            self.t[here] = np.inf

    def settle(self, which: np.ndarray, narrow: float = np.inf) -> None:
        """Least times on all ways from these searches' starts to their ends.

        Of the cells that wait only those are looked at whose time is within ``narrow``
        times the shortest step of the least that waits in the same search: this
        spares cells that still become less. What isn't nearer than the end is left out.
        """
        t = self.t
        waiting = np.zeros(len(t), bool)
        begin = self.start[which]
        begin = begin[np.isfinite(self.cost[begin])]
        t[begin], waiting[begin] = 0.0, True
        while True:
            cells = np.flatnonzero(waiting)
            if not len(cells):
                return
            searches, time = self.of[cells], t[cells]
            new = np.flatnonzero(np.diff(searches, prepend=-1))  # cells ascend, and so do their searches
            limit = np.minimum.reduceat(time, new) + narrow * self.least[searches[new]]
            late = time >= t[self.end][searches]
            now = ~late & (time <= np.repeat(limit, np.diff(new, append=len(cells))))
            waiting[cells[late | now]] = False
            cells, searches, time = cells[now], searches[now], time[now]
            for k in range(len(OFFSETS)):
                step, length = self._step(k, searches)
                there = cells + step
                reach = time + self._weight(cells, there, length, searches)
                better = reach < t[there]
                if better.any():
                    there = there[better]
                    t[there] = reach[better]
                    waiting[there] = True

    def traced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Search (by number), place and time of the cells on each way back from a found end; among equal ways the cell before is the smallest by z, y, x."""
        searches = np.flatnonzero(~self.lost())
        cells = self.end[searches]
        out = [(searches, cells)]
        while len(cells):
            best, before = np.full(len(cells), np.inf), np.full(len(cells), -1)
            for k in range(len(OFFSETS)):  # offsets ascend, so the first of equals is the smallest place
                step, length = self._step(k, searches)
                there = cells + step
                reach = np.where(self.t[there] < self.t[cells], self.t[there] + self._weight(there, cells, length, searches), np.inf)
                better = reach < best
                best[better], before[better] = reach[better], there[better]
            on = before >= 0
            searches, cells = searches[on], before[on]
            out.append((searches, cells))
        searches, cells = (np.concatenate(c) for c in zip(*out))
        left, place = cells - self.first[searches], []
        for axis in range(3):
            place.append(left // self.by[searches, axis] - 1)
            left = left % self.by[searches, axis]
        return searches, np.stack(place, 1), self.t[cells]
