"""Least-cost searches on the voxel graph: any number at once, block by block.

A search meets only the blocks that it reaches. Between rounds nothing is kept but
the times at the borders of blocks; a block is settled anew from all that its
borders were told, and tells the blocks beside it what became less. Times and ways
are written once, when no border changes any more. Volumes of no more cells than a
block are searched whole, many in one task, and nothing but paths leaves it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut, drop, kept
from . import blocks as by_block
from .blocks import BLOCK, Boxes, Costs, blocks_beside, with_blocks

BACKENDS = ("dj3d", "mcp")
PLACE = ["z", "y", "x"]
OPEN = ["sv_id", "search", *BLOCK[1:]]
#: What a border was told: its cost and time; ``wanted`` marks the end of a search.
GIVEN = [*OPEN, *PLACE, "cost", "sz", "sy", "sx", "t", "given", "wanted"]
GIVEN_TYPE = "sv_id long, search long, bz int, by int, bx int, z int, y int, x int, cost double, sz double, sy double, sx double, t double, given boolean, wanted boolean"
#: Parts of what borders were told that are read side by side; then they are merged.
PARTS = 6
#: Cells of all boxes that a task searches at once, unless a single box has more.
AT_ONCE = 1 << 21


def cells_of(cost: DataFrame, volumes: DataFrame) -> DataFrame:
    """``cost`` (sv_id, z, y, x, cost) by blocks, with the voxel's size, for several uses."""
    sized = volumes.select("sv_id", *(F.col(f"s{a}").cast("double").alias(f"s{a}") for a in "zyx"))
    placed = cost.select("sv_id", *(F.col(a).cast("int").alias(a) for a in "zyx"), F.col("cost").cast("double").alias("cost"))
    return kept(with_blocks(placed).join(sized, "sv_id"))


def _at_cells(cells: DataFrame, points: DataFrame, t: float, wanted: bool) -> DataFrame:
    """Points (sv_id, search, z, y, x) that are cells, as rows GIVEN."""
    placed = points.select("sv_id", F.col("search").cast("long").alias("search"), *(F.col(a).cast("int").alias(a) for a in "zyx")).distinct()
    return cells.join(placed, ["sv_id", *PLACE]).withColumns({"t": F.lit(t), "given": F.lit(True), "wanted": F.lit(wanted)}).select(*GIVEN)


def _settled_borders(backend: str):
    edge = by_block.EDGE

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        costs = Costs(rows, backend)
        t = np.full(costs.box.size, np.inf)
        np.minimum.at(t, costs.box.at, rows["t"].to_numpy())
        rows = rows.assign(t=costs.settle(t)[costs.box.at])
        ends = np.zeros(len(rows), bool)
        for a in PLACE:
            ends |= rows[a].to_numpy() % edge % (edge - 1) == 0
        told = np.isfinite(rows["t"].to_numpy()) & (rows["wanted"] | (~rows["given"] & ends)).to_numpy()
        return rows[told]

    return work


def borders(cells: DataFrame, starts: DataFrame, backend: str, ends: DataFrame | None = None) -> DataFrame:
    """Rows GIVEN of everything that blocks must be told to settle each search from ``starts`` (sv_id, search, z, y, x).

    With ``ends`` (the same columns, one for each search) what isn't nearer than
    the end found so far is told to nobody.
    """
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}")
    inf = float("inf")
    parts = [cut(_at_cells(cells, starts, 0.0, False))]
    targets = kept(_at_cells(cells, ends, inf, True)) if ends is not None else None
    blocks = kept(cells.select(*BLOCK).distinct())
    several = blocks.groupBy("sv_id").count().where("count > 1").select("sv_id")  # a fragment of one block tells nobody
    todo = parts[0].select(*OPEN).distinct().join(several, "sv_id", "left_semi")
    bounds = None
    spare = parts[0].where(F.lit(False))
    while not todo.isEmpty():
        told = parts[0]
        for part in parts[1:]:
            told = told.unionByName(part)
        if targets is not None:
            told = told.unionByName(targets)
        inside = todo.join(cells, BLOCK).withColumns({"t": F.lit(inf), "given": F.lit(False), "wanted": F.lit(False)}).select(*GIVEN)
        opened = inside.unionByName(told.join(todo, OPEN, "left_semi"))
        settled = cut(opened.groupBy(*OPEN).applyInPandas(_settled_borders(backend), GIVEN_TYPE))
        news = settled.where("NOT wanted").withColumn("to", F.explode(blocks_beside())).withColumns({f"b{a}": F.col(f"to.{a}") for a in "zyx"} | {"given": F.lit(True)}).select(*GIVEN)
        news = news.join(blocks, BLOCK, "left_semi")
        known = told.where("NOT wanted").groupBy(*OPEN, *PLACE).agg(F.min("t").alias("t_known"))
        news = news.join(known, [*OPEN, *PLACE], "left").where("t_known IS NULL OR t < t_known")
        if targets is not None:
            found = settled.where("wanted").select("sv_id", "search", "t")
            bounds = cut((found if bounds is None else found.unionByName(bounds)).groupBy("sv_id", "search").agg(F.min("t").alias("t")))
            news = news.join(bounds.withColumnRenamed("t", "t_end"), ["sv_id", "search"], "left").where("t_end IS NULL OR t < t_end")
        new = cut(news.select(*GIVEN))
        drop(settled)
        parts.append(new)
        todo = new.select(*OPEN).distinct()
        if len(parts) > PARTS:
            merged = parts[0]
            for part in parts[1:]:
                merged = merged.unionByName(part)
            rest = [F.first(c).alias(c) for c in GIVEN if c not in {*OPEN, *PLACE, "t"}]
            whole = cut(merged.groupBy(*OPEN, *PLACE).agg(F.min("t").alias("t"), *rest).select(*GIVEN))
            drop(*parts[:-1])  # the last is read in the next round
            parts = [whole]
    out = spare
    for part in parts:
        out = out.unionByName(part)
    return out


def times(cells: DataFrame, told: DataFrame, backend: str, searches: tuple[int, int] = (1, 2)) -> DataFrame:
    """(sv_id, z, y, x, t_a, t_b): least times of two searches at all cells, null where there is no way."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        costs = Costs(rows, backend)
        out = rows[["sv_id", *PLACE]].copy()
        for name, search in zip(("t_a", "t_b"), searches):
            t = np.full(costs.box.size, np.inf)
            mine = (rows["search"] == search).to_numpy()
            np.minimum.at(t, costs.box.at[mine], rows["t"].to_numpy()[mine])
            value = costs.settle(t)[costs.box.at]
            out[name] = np.where(np.isfinite(value), value, np.nan)
        return out[~rows["given"].to_numpy()]

    inside = cells.withColumns({"search": F.lit(0).cast("long"), "t": F.lit(float("inf")), "given": F.lit(False)})
    kept = [c for c in GIVEN if c != "wanted"]
    rows = inside.select(*kept).unionByName(told.where("NOT wanted").select(*kept))
    out = rows.groupBy(*BLOCK).applyInPandas(work, "sv_id long, z int, y int, x int, t_a double, t_b double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("t_a", "t_b")})


WAY = "sv_id long, search long, bz int, by int, bx int, z int, y int, x int, t double, pz int, py int, px int, ez int, ey int, ex int"


def ways(cells: DataFrame, told: DataFrame, backend: str) -> DataFrame:
    """Rows WAY of all cells of the blocks that a search reached: the time, the cell before (p) on a least way, and the first cell on the way back that is outside the block (e), null where the search starts within.

    Among equal ways the cell before is the smallest by z, y, x.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        costs = Costs(rows, backend)
        box = costs.box
        t = np.full(box.size, np.inf)
        np.minimum.at(t, box.at, rows["t"].to_numpy())
        t = costs.settle(t)
        own = ~rows["given"].to_numpy()
        before = np.full(box.size + 1, -1)
        before[box.at] = costs.before(t)
        inside = np.zeros(box.size + 1, bool)
        inside[box.at[own]] = True
        # Follow the cells before: from inside on, until one lies outside or there is none (-1, the last entry).
        out = before.copy()
        while True:
            on = (out >= 0) & inside[out]
            if not on.any():
                break
            out[on] = out[out[on]]
        kept = np.flatnonzero(own & np.isfinite(t[box.at]))
        made = rows.iloc[kept][["sv_id", "search", *BLOCK[1:], *PLACE]].copy()
        made["t"] = t[box.at[kept]]
        for letter, cell in (("p", before), ("e", out)):
            flat = cell[box.at[kept]]
            there = box.places(np.maximum(flat, 0))
            for axis, a in enumerate("zyx"):
                made[letter + a] = pd.array(np.where(flat >= 0, there[:, axis], 0), "Int32")
                made.loc[flat < 0, letter + a] = pd.NA
        return made

    told = told.where("NOT wanted")
    todo = told.select(*OPEN).distinct()
    inside = todo.join(cells, BLOCK).withColumns({"t": F.lit(float("inf")), "given": F.lit(False), "wanted": F.lit(False)}).select(*GIVEN)
    return inside.unionByName(told).groupBy(*OPEN).applyInPandas(work, WAY)


def traced(found: DataFrame, ends: DataFrame) -> DataFrame:
    """(sv_id, search, z, y, x, t) of the cells on each search's way back from its end; none where the end wasn't reached.

    ``found``: :func:`ways`, for several uses. The places where a way enters a
    block are found by pointer doubling over such places alone, so a way through
    n blocks takes log2(n) joins; each block then gives its stretches.
    """
    key = ["sv_id", "search"]
    at = F.struct(*PLACE)
    last = ends.select("sv_id", F.col("search").cast("long").alias("search"), F.struct(*(F.col(a).cast("int").alias(a) for a in "zyx")).alias("cell")).distinct()
    entered = found.where("ez IS NOT NULL").select(*key, F.struct(*(F.col(f"e{a}").alias(a) for a in "zyx")).alias("cell")).unionByName(last).distinct()
    of_cell = found.select(*key, at.alias("cell"), F.when(F.col("ez").isNotNull(), F.struct(*(F.col(f"e{a}").alias(a) for a in "zyx"))).alias("next"))
    jump = cut(entered.join(of_cell, [*key, "cell"]))
    reached = cut(last.join(jump.select(*key, "cell"), [*key, "cell"], "left_semi"))
    while True:
        step = cut(reached.join(jump, [*key, "cell"]).where("next IS NOT NULL").select(*key, F.col("next").alias("cell")))
        if step.isEmpty():
            break
        reached = cut(reached.unionByName(step))
        far = jump.select(*key, F.col("cell").alias("next"), F.col("next").alias("far"))
        jump = cut(jump.join(far, [*key, "next"], "left").select(*key, "cell", F.col("far").alias("next")))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        number = {p: k for k, p in enumerate(zip(rows["z"], rows["y"], rows["x"]))}
        before = [number.get(p, -1) for p in zip(rows["pz"].fillna(-1), rows["py"].fillna(-1), rows["px"].fillna(-1))]
        on = np.zeros(len(rows), bool)
        for k in np.flatnonzero(rows["entered"].to_numpy()).tolist():
            while k >= 0 and not on[k]:
                on[k] = True
                k = before[k]
        return rows[on][["sv_id", "search", *PLACE, "t"]]

    marked = with_blocks(reached.select(*key, *(F.col(f"cell.{a}").alias(a) for a in "zyx"))).withColumn("entered", F.lit(True))
    crossed = found.join(marked.select(*OPEN).distinct(), OPEN, "left_semi").join(marked.select(*key, *PLACE, "entered"), [*key, *PLACE], "left")
    return crossed.withColumn("entered", F.coalesce("entered", F.lit(False))).groupBy(*OPEN).applyInPandas(walk, "sv_id long, search long, z int, y int, x int, t double")


def least_paths(cells: DataFrame, starts: DataFrame, ends: DataFrame, backend: str = "mcp") -> DataFrame:
    """(sv_id, search, z, y, x, t): cells of a least path from each search's start to its end and the time there.

    ``cells``: :func:`cells_of`. Searches without a way have no rows.
    """
    told = borders(cells, starts, backend, ends)
    return traced(kept(ways(cells, told, backend)), ends)


def fits() -> Column:
    """Volumes (nz, ny, nx) of no more cells than a block, for :func:`paths_inside`."""
    return F.col("nz").cast("long") * F.col("ny") * F.col("nx") <= by_block.EDGE**3


PATH = "sv_id long, search long, z int, y int, x int, t double"
#: What a row of :func:`paths_inside` tells: a volume's shape and voxel size, a cell's cost, where a search starts or ends.
SHAPE, CELL, START, END = range(4)


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows sorted by sv_id in portions that hold all rows of their fragments."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        sv = batch.column("sv_id").to_numpy()
        first = int(np.searchsorted(sv, sv[-1]))  # of the fragment that may go on
        if held and (first or held[-1].column("sv_id")[0].as_py() != sv[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, first)]).to_pandas()
            held = []
        elif first:
            yield batch.slice(0, first).to_pandas()
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held).to_pandas()


def _portions(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Searches (sv_id, search, nz, ny, nx, sz, sy, sx and both ends' places) of whole fragments, as many as a task holds at once, and the cells of their fragments."""
    of = lambda kind, names: rows.loc[rows["kind"] == kind, ["sv_id", *names]].rename(columns=names)
    shapes = of(SHAPE, {"z": "nz", "y": "ny", "x": "nx", "cost": "sz", "sy": "sy", "sx": "sx"})
    ends = [of(kind, {"search": "search"} | {a: f"{a}{k}" for a in PLACE}).drop_duplicates() for k, kind in ((0, START), (1, END))]
    searches = ends[0].merge(ends[1], on=["sv_id", "search"]).merge(shapes, on="sv_id").sort_values(["sv_id", "search"], ignore_index=True)
    for k in (0, 1):
        for a in PLACE:
            searches = searches[(searches[f"{a}{k}"] >= 0) & (searches[f"{a}{k}"] < searches[f"n{a}"])]
    size = ((searches["nz"] + 2) * (searches["ny"] + 2) * (searches["nx"] + 2)).to_numpy(np.int64)
    cells = rows[rows["kind"] == CELL]
    low = 0
    while low < len(searches):
        high = low + max(1, int(np.searchsorted(np.cumsum(size[low:]), AT_ONCE, "right")))
        part = searches.iloc[low:high].reset_index(drop=True)
        yield part, cells[cells["sv_id"].isin(part["sv_id"].unique())]
        low = high


def paths_inside(cost: DataFrame, volumes: DataFrame, starts: DataFrame, ends: DataFrame, backend: str = "mcp", beyond: float | None = None) -> DataFrame:
    """What :func:`least_paths` gives over ``cost`` (sv_id, z, y, x, cost) in ``volumes`` that a task can hold (:func:`fits`), all searches of a fragment in one task.

    Cells, starts and ends lie in their volume. With ``beyond`` a search without
    a way over the cells is done again with all other cells of the volume at that cost.
    """
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches):
            for searches, cells in _portions(rows):
                boxes = Boxes(searches, cells, backend)
                boxes.settle(np.arange(len(searches)))
                if beyond is not None and boxes.lost().any():
                    boxes.fill(boxes.lost(), beyond)
                    boxes.settle(np.flatnonzero(boxes.lost()), 0.5 * beyond)
                k, place, t = boxes.traced()
                made = {"sv_id": searches["sv_id"].to_numpy(np.int64)[k], "search": searches["search"].to_numpy(np.int64)[k]}
                made |= {a: place[:, axis].astype(np.int32) for axis, a in enumerate(PLACE)} | {"t": t}
                yield pa.RecordBatch.from_pydict(made)

    none = F.lit(None)
    place = [F.col(a).cast("int").alias(a) for a in PLACE]

    def told(df: DataFrame, kind: int, search: Column, at: list[Column], *values: Column) -> DataFrame:
        return df.select("sv_id", F.lit(kind).cast("tinyint").alias("kind"), search.cast("long").alias("search"), *at, *(v.cast("double").alias(n) for v, n in zip((*values, none, none, none), ("cost", "sy", "sx"))))

    rows = told(volumes, SHAPE, F.lit(0), [F.col(f"n{a}").cast("int").alias(a) for a in PLACE], *(F.col(f"s{a}") for a in PLACE))
    rows = rows.unionByName(told(cost, CELL, F.lit(0), place, F.col("cost")))
    for kind, points in ((START, starts), (END, ends)):
        rows = rows.unionByName(told(points, kind, F.col("search"), place))
    return rows.repartition("sv_id").sortWithinPartitions("sv_id").mapInArrow(work, PATH)
