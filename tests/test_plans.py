"""Searches, paths, ridges, labels and repair as plans over tables, against one dense grid at a time."""

import dense
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fractus.operators import blocks, labels, regions, resolve, ridge, search, snap
from fractus.plans.profiling import JobProfiler
from fractus.plans.splitters import GeodesicSplitter, RidgeConnectPrep, SeedFrames
from fractus.sources import volumes

SIZE = (3.0, 2.0, 1.0)


def tables(spark, masks, seeds):
    """Voxels, seeds and volumes of masks by fragment; seeds: {fragment: (sources, sinks)}."""
    points = [(sv, *map(int, p)) for sv, m in masks.items() for p in np.argwhere(m)]
    rows = [(sv, side, i, *map(float, p)) for sv, pair in seeds.items() for side, some in zip((1, 2), pair) for i, p in enumerate(some)]
    return spark.createDataFrame(points, volumes.VOXEL), spark.createDataFrame(rows, volumes.SEED), volumes.volume(spark, [(sv, *m.shape, *SIZE) for sv, m in masks.items()])


def balls(rng, shape=(9, 14, 18), n=4, specks=0):
    """Balls, some of which touch, and single voxels apart from them."""
    mask, grid = np.zeros(shape, bool), np.stack(np.indices(shape), -1)
    for _ in range(n):
        centre = rng.integers(1, np.array(shape) - 1)
        mask |= ((grid - centre) ** 2).sum(-1) <= rng.integers(4, 17)
    for p in rng.integers(0, np.array(shape), (specks, 3)):
        mask[tuple(p)] = True
    return mask


def some_seeds(rng, mask, n):
    at = rng.permutation(np.argwhere(mask))
    return at[:n], at[n : 2 * n]


def dense_of(df, shape, value, default=0):
    out = np.full(shape, default)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[value]
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "EDGE", 6)


def test_least_paths_over_blocks(spark, small_blocks):
    """Many searches in several fragments: cells and times as found on dense grids, ties included."""
    rng = np.random.default_rng(5)
    masks = {7: rng.random((6, 9, 13)) < 0.5, 8: np.ones((5, 6, 17), bool), 9: np.eye(9, dtype=bool)[None, ::8]}
    costs = {sv: np.where(m, rng.choice([1.0, 1.0, 2.5, 30.0], m.shape), np.inf) for sv, m in masks.items()}
    rows = [(sv, *map(int, p), float(costs[sv][tuple(p)])) for sv, m in masks.items() for p in np.argwhere(m)]
    cost = spark.createDataFrame(rows, "sv_id long, z int, y int, x int, cost double")
    shapes = volumes.volume(spark, [(sv, *m.shape, *SIZE) for sv, m in masks.items()])
    pairs = [(sv, k, *rng.permutation(np.argwhere(m))[:2].tolist()) for sv, m in masks.items() for k in range(4)]
    pairs += [(8, 9, [0, 0, 0], [0, 0, 0]), (8, 10, [0, 0, 0], [4, 5, 16])]
    table = lambda which: spark.createDataFrame([(sv, k, *pair[which]) for sv, k, *pair in pairs], "sv_id long, search long, z int, y int, x int")
    got = {}
    for r in search.least_paths(search.cells_of(cost, shapes), table(0), table(1)).collect():
        got.setdefault((r.sv_id, r.search), []).append((r.t, (r.z, r.y, r.x)))
    lengths = []
    for sv, k, start, end in pairs:
        want = dense.path(costs[sv], tuple(start), tuple(end), SIZE)
        found = [p for _, p in sorted(got.get((sv, k), []), reverse=True)]
        assert found == (want or [])
        lengths.append(len(found))
    assert max(lengths) > 10 and 0 in lengths


def test_parts_of_what_borders_were_told_are_merged(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(search, "PARTS", 2)
    line = spark.range(40).selectExpr("0L AS sv_id", "0 AS z", "0 AS y", "CAST(id AS int) AS x", "1.0D AS cost")
    cells = search.cells_of(line, volumes.volume(spark, [(0, 1, 1, 40, *SIZE)]))
    at = lambda x: spark.createDataFrame([(0, 1, 0, 0, x)], "sv_id long, search long, z int, y int, x int")
    assert sorted(r.t for r in search.least_paths(cells, at(1), at(38)).collect()) == [float(k) for k in range(38)]
    with pytest.raises(ValueError):
        search.borders(cells, at(1), "other")


def test_paths_inside_volumes(spark):
    """Whole volumes of several shapes in one task: the same cells as on dense grids, over the cells or else over background."""
    rng = np.random.default_rng(11)
    masks = {7: rng.random((6, 9, 13)) < 0.3, 8: np.ones((5, 6, 17), bool), 9: np.eye(9, dtype=bool)[None, ::8], 2**40: rng.random((6, 9, 13)) < 0.5}
    costs = {sv: np.where(m, rng.choice([1.0, 1.0, 2.5, 30.0], m.shape), np.inf) for sv, m in masks.items()}
    cost = spark.createDataFrame([(sv, *map(int, p), float(costs[sv][tuple(p)])) for sv, m in masks.items() for p in np.argwhere(m)], "sv_id long, z int, y int, x int, cost double")
    shapes = volumes.volume(spark, [(sv, *m.shape, *SIZE) for sv, m in masks.items()])
    pairs = [(sv, (1 << 32) + k, *rng.permutation(np.argwhere(m))[:2].tolist()) for sv, m in masks.items() for k in range(4)]
    pairs += [(8, 9, [0, 0, 0], [0, 0, 0]), (8, 10, [0, 0, 0], [4, 5, 16])]
    table = lambda which: spark.createDataFrame([(sv, k, *pair[which]) for sv, k, *pair in pairs], "sv_id long, search long, z int, y int, x int")
    lost = 0
    for beyond in (None, 1e12):
        got = {}
        for r in search.paths_inside(cost, shapes, table(0), table(1), beyond=beyond).collect():
            got.setdefault((r.sv_id, r.search), []).append((r.t, (r.z, r.y, r.x)))
        for sv, k, start, end in pairs:
            want = dense.path(costs[sv], tuple(start), tuple(end), SIZE)
            if want is None and beyond is not None:
                want, lost = dense.path(np.where(masks[sv], costs[sv], beyond), tuple(start), tuple(end), SIZE), lost + 1
            assert [p for _, p in sorted(got.get((sv, k), []), reverse=True)] == (want or [])
    assert lost > 2
    times = lambda df: {(r.sv_id, r.search, r.z, r.y, r.x): r.t for r in df.collect()}
    assert times(search.paths_inside(cost, shapes, table(0), table(1), "dj3d")) == times(search.least_paths(search.cells_of(cost, shapes), table(0), table(1), "dj3d"))
    with pytest.raises(ValueError):
        search.paths_inside(cost, shapes, table(0), table(1), "other")


def test_portions_hold_whole_fragments(monkeypatch):
    """Fragments that cross batches are put together; searches are dealt by the cells of their boxes."""
    rows = pd.DataFrame({"sv_id": np.repeat([1, 2, 5, 6], [1, 7, 2, 4])})
    for n in (1, 2, 3, 4, 14):
        batches = pa.Table.from_pandas(rows).to_batches(n)
        parts = list(search._whole(batches))
        assert pd.concat(parts).sv_id.tolist() == rows.sv_id.tolist()
        assert sum(part.sv_id.nunique() for part in parts) == 4
    monkeypatch.setattr(search, "AT_ONCE", 100)
    told = [(sv, kind, k, 0, 0, 0, 1.0, 1.0, 1.0) for sv in (1, 2) for kind in (search.START, search.END) for k in range(3)]
    told += [(sv, kind, 0, n, n, n, 1.0, 1.0, 1.0) for sv, n in ((1, 1), (2, 9)) for kind in (search.SHAPE, search.CELL)]
    parts = list(search._portions(pd.DataFrame(told, columns=["sv_id", "kind", "search", *"zyx", "cost", "sy", "sx"])))
    assert [(p.sv_id.tolist(), p.search.tolist(), c.sv_id.tolist()) for p, c in parts] == [([1, 1, 1], [0, 1, 2], [1]), ([2], [0], [2]), ([2], [1], [2]), ([2], [2], [2])]


def test_ridge_paths_of_small_volumes_build_no_grid(spark, monkeypatch):
    """Background is laid out within the tasks where a volume fits one, and paths are those found by blocks."""
    rng = np.random.default_rng(12)
    apart = np.zeros((4, 7, 11), bool)
    apart[1:3, 1:6, :3] = apart[1:3, 1:6, 7:] = True
    masks = {0: balls(rng, (5, 6, 7), n=1, specks=2), 1: apart}
    v, s, shapes = tables(spark, masks, {0: some_seeds(rng, masks[0], 3), 1: ([(1, 1, 0), (2, 5, 9)], [(1, 2, 1), (1, 3, 8), (2, 2, 10)])})
    s = s.withColumns({a: F.col(a).cast("int") for a in "zyx"})
    grid = regions.with_background
    monkeypatch.setattr(regions, "with_background", lambda *_: pytest.fail("a grid with background was built"))
    inside = sorted(ridge.ridge_paths(v, s, shapes).collect())
    built = []
    monkeypatch.setattr(regions, "with_background", lambda *given: built.append(1) or grid(*given))
    monkeypatch.setattr(blocks, "EDGE", 6)  # 5 by 6 by 7 cells are no more than a block's, 4 by 7 by 11 are more
    assert inside == sorted(ridge.ridge_paths(v, s, shapes).collect())
    assert built and {r.sv_id for r in inside} == set(masks)


def test_ridge(spark, small_blocks):
    """Seeds joined within fragments, over background, and left as they are where a side has none."""
    rng = np.random.default_rng(6)
    masks = {sv: balls(rng, n=3 + sv % 3, specks=sv % 2) for sv in range(4)}
    pairs = {sv: some_seeds(rng, m, 3) for sv, m in masks.items()}
    pairs[3] = (pairs[3][0], pairs[3][1][:0])
    cfg = RidgeConnectPrep(snap={"downsample": False}, roi_pad_zyx=(2, 4, 4))
    v, s, shapes = tables(spark, masks, pairs)
    out = cfg.prepare(v, s, shapes)
    got, status = {}, {r.sv_id: (r.ok_source, r.ok_sink) for r in out.status.collect()}
    for r in out.seeds.collect():
        got.setdefault((r.sv_id, r.side), set()).add((r.z, r.y, r.x))
    grown = 0
    for sv, m in masks.items():
        a, b, ok_a, ok_b = dense.ridge(m, *pairs[sv], SIZE, cfg)
        assert status[sv] == (ok_a, ok_b)
        for side, want in ((1, a), (2, b)):
            assert got.get((sv, side), set()) == set(map(tuple, want.tolist()))
        grown += len(a)
    assert grown > 30


CONFIGS = [
    {"backend": "mcp", "lambda_prox": 0.05, "downsample_geodesic": (1, 2, 2), "nb_dilate": 2},
    {"backend": "dj3d", "allow_third_label": False, "halo": 0, "narrow_band_rel": 0.3, "gamma_neck": 1.0, "nb_dilate": 0, "enforce_single_cc": False},
]


@pytest.mark.parametrize("options", CONFIGS)
def test_geodesic(spark, small_blocks, options):
    """Labels, snapped seeds and counts of several fragments, with and without components that no seed reaches."""
    rng = np.random.default_rng(len(options) + 7)
    masks = {sv: balls(rng, n=2 + sv, specks=2 * (sv % 2)) for sv in range(1, 6)}
    pairs = {sv: some_seeds(rng, m, 2) for sv, m in masks.items()}
    pairs[5] = (pairs[5][0], pairs[5][1][:0])
    cfg = GeodesicSplitter(seed_prep="none", snap={"downsample": False}, **options)
    out = cfg.split(*tables(spark, masks, pairs))
    facts = {r.sv_id: r for r in out.diagnostics.collect()}
    strays = 0
    for sv, m in masks.items():
        want, a, b, said = dense.geodesic(m, *pairs[sv], SIZE, cfg)
        got = dense_of(out.labels.where(F.col("sv_id") == sv), m.shape, "label")
        assert (got == want).all(), (sv, np.argwhere(got != want)[:5])
        snapped = {(r.side, r.z, r.y, r.x) for r in out.snapped.where(F.col("sv_id") == sv).collect()}
        assert snapped == {(side, *p) for side, some in ((1, a), (2, b)) for p in some.tolist()}
        assert facts[sv].label_counts == {k: int((want == k).sum()) for k in (1, 2, 3)}
        if said["pre_resolve"]:
            assert tuple(facts[sv].pre_resolve_label_counts[k] for k in (1, 2, 3)) == said["pre_resolve"]
            assert tuple(facts[sv].fg_bbox_shape_zyx) == said["fg_bbox_shape_zyx"] and facts[sv].downsample_zyx == (None if said["downsample_zyx"] is None else list(said["downsample_zyx"]))
        strays += int((want == 3).sum())
    assert strays > 0 or not (cfg.enforce_single_cc and cfg.allow_third_label)


def test_exceptions_reach_the_caller(spark):
    mask = np.zeros((3, 3, 40), bool)
    mask[:, :, 0:15] = mask[:, :, 16:30] = mask[:, :, 32:36] = True
    v, s, shapes = tables(spark, {0: mask}, {0: ([(1, 1, 2)], [(1, 1, 27)])})
    with pytest.raises(RuntimeError, match="seed preparation failed"):
        GeodesicSplitter().split(v, s.where("side = 1"), shapes)
    with pytest.raises(ValueError, match="connected components"):
        GeodesicSplitter(seed_prep="none", allow_third_label=False, raise_if_multi_cc=True).split(v, s, shapes)
    with pytest.raises(ValueError, match="no candidate"):
        GeodesicSplitter(seed_prep="none").split(v.where("false"), s, shapes)

    class Failing:
        def prepare(self, voxels, seeds, volumes):
            return SeedFrames(seeds, volumes.selectExpr("sv_id", "true AS ok_source", "false AS ok_sink"))

    with pytest.raises(RuntimeError, match="sink False"):
        GeodesicSplitter(seed_prep=Failing()).split(v, s, shapes)


def test_spans_and_reports(spark):
    """A fragment in three parts: the part without a seed stays stray under the defaults."""
    mask = np.zeros((3, 3, 40), bool)
    mask[:, :, 0:15] = mask[:, :, 16:30] = mask[:, :, 32:36] = True
    v, s, shapes = tables(spark, {4: mask}, {4: ([(1, 1, 2)], [(1, 1, 27)])})
    timed = JobProfiler(spark)
    out = GeodesicSplitter(seed_prep=RidgeConnectPrep(profiler=timed), profiler=timed).split(v, s, shapes)
    assert {(r.label, r["count"]) for r in out.labels.groupBy("label").count().collect()} == {(1, 135), (2, 126), (3, 36)}
    facts = out.diagnostics.first()
    spans = {"seed_prep", "snap", "cost", "arrival", "writeback", "enforce_cc:1st", "resolve_stray", "enforce_cc:2nd"}
    assert set(facts.stage_elapsed_s) == spans and set(timed.seconds) == spans | {"ridge:snap", "ridge:augment"}
    assert facts.label_counts[1] == 135 and facts.total_elapsed_s >= facts.stage_elapsed_s["arrival"] > 0
    assert {tuple(r) for r in out.reports["enforce_cc"].select("label", "kept_components").collect()} == {(1, 1), (2, 1)}
    resolved = out.reports["resolve_stray"].first()
    assert resolved.n_components == 1 and resolved.tie_break_count == 1 and resolved.moved_to_source + resolved.moved_to_sink == 36


def test_band_floor_is_each_fragments_own(spark):
    """63 voxels in the band are too few and count as none; 64 are enough."""
    rows = [(sv, 0, 0, x, 1.0, 1.01) for sv, n in ((1, 63), (2, 64)) for x in range(n)] + [(sv, 0, 0, 200 + x, 1.0, 2.0) for sv in (1, 2) for x in range(9)]
    times = spark.createDataFrame(rows, "sv_id long, z int, y int, x int, t_a double, t_b double")
    swapped = times.withColumns({"t_a": F.col("t_b"), "t_b": F.col("t_a")})
    out = labels.grid_labels(swapped, nb_dilate=0, k_prox=50.0, lambda_prox=0.01)
    far = {(r.sv_id, r.label) for r in out.where("x >= 200").collect()}
    inner = lambda ta, tb: 1 if ta / (1 + 50 * np.exp(-0.01 * tb)) <= tb / (1 + 50 * np.exp(-0.01 * ta)) else 2
    assert far == {(1, inner(2.0, 1.0)), (2, 2)}


def test_nearest_sides_by_blocks(spark):
    rng = np.random.default_rng(9)
    points, comps = np.unique(rng.integers(0, 60, (500, 3)), axis=0), None
    comps = points[:, 2] // 7
    strays = spark.createDataFrame([(1, int(c), *map(int, p)) for c, p in zip(comps, points)], "sv_id long, comp long, z int, y int, x int")
    sides = [rng.integers(0, 60, (90, 3)) for _ in range(2)]
    seeds = spark.createDataFrame([(1, k, i, *map(float, p)) for k, some in zip((1, 2), sides) for i, p in enumerate(some)], volumes.SEED)
    got = {r.comp: r.side for r in resolve.nearest_side(strays, seeds, volumes.volume(spark, [(1, 60, 60, 60, *SIZE)])).collect()}
    d = [(((points[:, None] - some) * np.array(SIZE)) ** 2).sum(2).min(1) for some in sides]
    assert got == {int(c): 2 if 2 * (d[1] < d[0])[comps == c].sum() > (comps == c).sum() else 1 for c in np.unique(comps)}
    assert resolve.nearest_side(strays, seeds.where("side = 1"), volumes.volume(spark, [(1, 60, 60, 60, *SIZE)])).count() == 0


def test_windows_and_generators_of_the_snap(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((20, 20, 20)) < 0.3
    v, s, shapes = tables(spark, {0: mask}, {0: (rng.integers(0, 20, (5, 3)), rng.integers(0, 20, (5, 3)))})
    plain = snap.snap_seeds(s, v, shapes, use_boundary=False, downsample=False).collect()
    for window in ({"use_bbox": True}, {"use_bbox": True, "bbox_pad_phys": 2.0}):
        assert sorted(snap.snap_seeds(s, v, shapes, use_boundary=False, downsample=False, **window).collect()) == sorted(plain)
    drawn = {"use_boundary": False, "downsample_mode": "random", "downsample_target": 40}
    one, two = (sorted(snap.snap_seeds(s, v, shapes, rng=g, **drawn).collect()) for g in (11, np.random.default_rng(2)))
    assert one == sorted(snap.snap_seeds(s, v, shapes, seed=11, **drawn).collect()) and one != two
    with pytest.raises(ValueError):
        snap.snap_seeds(s, v, shapes, bbox_pad_phys=-1.0)


def test_places_in_order(spark):
    rng = np.random.default_rng(2)
    v, _, _ = tables(spark, {0: rng.random((9, 9, 9)) < 0.4, 1: np.ones((1, 1, 5), bool)}, {})
    ordered = sorted(tuple(r) for r in v.collect())
    for sv in (0, 1):
        mine = [r for r in ordered if r[0] == sv]
        assert sorted(tuple(r) for r in regions.every_nth(v, 4).where(F.col("sv_id") == sv).collect()) == mine[::4]
    assert {r["count"] for r in regions.sample(v, 50).groupBy("sv_id").count().collect()} == {50, 5}


def test_background_cells(spark):
    v, _, shapes = tables(spark, {0: np.ones((1, 2, 2), bool), 1: np.eye(3, dtype=bool)[None]}, {})
    out = regions.with_background(v.withColumn("cost", F.lit(2.0)), shapes).collect()
    assert len(out) == 4 + 9 and {(r.sv_id, r.y == r.x, r.cost) for r in out if r.sv_id} == {(1, True, 2.0), (1, False, 1e12)}
    assert ridge.SIDE > 1 << 31


def test_snapped_seeds_are_written_once(spark):
    """What searches use many times is read from a file, not computed from the table again for each use."""
    from fractus import split_queries

    v, _, seeds = split_queries._snapped(*split_queries._fragments(spark, "/root/testdata/sf0.001"))
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() and "Generate" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (v, seeds))
