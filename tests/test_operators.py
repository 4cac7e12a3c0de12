"""Operators on voxel tables: hand-made cases and brute force."""

import heapq
import itertools
import random
from itertools import product

import numpy as np
import pytest

from fractus.operators import blocks, distance, graph, regions, resolve, snap, stencil
from fractus.sources import chunks, volumes


def table(spark, points, sv=0):
    return spark.createDataFrame([(sv, *map(int, p)) for p in points], volumes.VOXEL)


def shape(spark, size, sampling=(1.0, 1.0, 1.0), sv=0):
    return volumes.volume(spark, [(sv, *size, *sampling)])


def cells(df):
    return {(r.z, r.y, r.x) for r in df.select("z", "y", "x").collect()}


@pytest.fixture(scope="module")
def blob():
    rng = np.random.default_rng(4)
    return rng.random((7, 8, 9)) < 0.6


def test_sources(spark, blob, tmp_path):
    v = volumes.from_array(spark, 3, blob)
    assert cells(v) == set(map(tuple, np.argwhere(blob).tolist()))
    flat = spark.createDataFrame([(3, 7, 8, 9, blob.ravel().tolist())], "sv_id long, nz int, ny int, nx int, cells array<boolean>")
    assert cells(volumes.from_array_column(flat)) == cells(v)
    volumes.write_labels(v, str(tmp_path / "v"))
    assert cells(volumes.read_voxels(spark, str(tmp_path / "v"))) == cells(v)
    with pytest.raises(ValueError):
        volumes.from_array(spark, 0, blob[0])
    assert volumes.box(spark, 2, 3, 4).distinct().count() == 24


def test_chunks(spark, blob, tmp_path):
    """Round trips of stored chunks in both orders, of chunks of an array, and of a pruned read."""
    v = volumes.from_array(spark, 3, blob).unionByName(table(spark, [(40, 0, 7)], sv=4))
    for order in ("zyx", "XYZ"):
        path = str(tmp_path / order)
        chunks.write_chunks(v.unionByName(v.limit(5)), path, 4, order)
        assert sorted(map(tuple, chunks.read_chunks(spark, path).collect())) == sorted(map(tuple, v.collect()))
        assert cells(chunks.read_chunks(spark, path, [4])) == {(40, 0, 7)}
        turned = blob if order == "zyx" else blob.transpose(2, 1, 0)
        assert cells(chunks.from_chunks(chunks.array_chunks(spark, 3, turned, 4, order))) == set(map(tuple, np.argwhere(blob).tolist()))
    assert chunks.to_chunks(v, 4).count() <= 2 * 2 * 3 + 1 and chunks.from_chunks(chunks.array_chunks(spark, 0, np.zeros((2, 2, 2), bool))).count() == 0
    for change in ({"order": "yxz"}, {"mask": blob[0]}):
        with pytest.raises(ValueError):
            chunks.array_chunks(spark, **({"sv_id": 0, "mask": blob} | change))


def test_distance_against_brute_force(spark, blob):
    for sampling in ((1.0, 1.0, 1.0), (3.0, 2.0, 1.0)):
        got = {(r.z, r.y, r.x): r.d2 for r in distance.squared_distance(volumes.from_array(spark, 0, blob), shape(spark, blob.shape, sampling)).collect()}
        outside = np.argwhere(~blob) * np.array(sampling)
        want = {tuple(p): float(((outside - p * np.array(sampling)) ** 2).sum(1).min()) for p in np.argwhere(blob)}
        assert got == want


def test_distance_edges(spark):
    strip = table(spark, [(0, 0, x) for x in range(4)])
    for scale in (1.0, 10.0):
        got = {r.x: r.d2**0.5 for r in distance.squared_distance(strip, shape(spark, (1, 1, 5), (1.0, 1.0, scale))).collect()}
        assert got == {x: (4 - x) * scale for x in range(4)}
    full = distance.squared_distance(table(spark, [(0, 0, 0), (0, 0, 1)]), shape(spark, (1, 1, 2)))
    assert {r.d2 for r in full.collect()} == {float("inf")}
    assert {r.cost for r in distance.cost_fields(full).collect()} == {1.0}
    assert distance.squared_distance(table(spark, []), shape(spark, (1, 1, 2))).count() == 0


def test_boxes(spark):
    v = table(spark, [(3, 4, 5)])
    vol = shape(spark, (10, 10, 10))
    assert tuple(regions.bounding_box(v).first())[1:] == (3, 4, 4, 5, 5, 6)
    assert regions.bounding_box(table(spark, [])).count() == 0
    assert tuple(regions.padded_box(v, vol, (5, 1, 1)).first())[1:] == (0, 9, 3, 6, 4, 7)
    assert tuple(regions.padded_box(table(spark, []), vol, (5, 1, 1)).first())[1:] == (0, 10, 0, 10, 0, 10)
    assert cells(regions.crop_to_foreground(v, vol)) == {(1, 1, 1)}


def test_grids(spark):
    coarse = table(spark, [(0, 0, 0)])
    fine = volumes.box(spark, 2, 3, 8).selectExpr("0L AS sv_id", "z", "y", "x")
    up = regions.upsample(coarse.selectExpr("*", "7 AS mark"), (2, 3, 4), fine).collect()
    assert {r.x for r in up if r.mark == 7} == {0, 1, 2, 3} and {r.x for r in up if r.mark is None} == {4, 5, 6, 7}
    assert cells(regions.stride(fine, (2, 2, 4))) == {(0, y, x) for y in (0, 1) for x in (0, 1)}
    assert [r.x for r in regions.every_nth(table(spark, [(0, 0, x) for x in range(7)]), 3).orderBy("x").collect()] == [0, 3, 6]
    assert regions.sample(fine, 5).count() == 5 and regions.sample(fine, 500).count() == 48 and cells(regions.sample(fine, 5)) == cells(regions.sample(fine, 5))


def test_morphology(spark, blob):
    v = volumes.from_array(spark, 0, blob)
    padded = np.pad(blob, 1)
    inner = np.logical_and.reduce([padded[1 + a : 8 + a, 1 + b : 9 + b, 1 + c : 10 + c] for a, b, c in product((-1, 0, 1), repeat=3)])
    assert cells(stencil.boundary(v)) == set(map(tuple, np.argwhere(blob & ~inner).tolist()))
    assert cells(stencil.boundary(v, 0)) == cells(v)
    assert cells(stencil.dilate(table(spark, [(3, 3, 3)]), 1, volumes.box(spark, 7, 7, 7).selectExpr("0L AS sv_id", "z", "y", "x"))) == {(3, 3, 3), (2, 3, 3), (4, 3, 3), (3, 2, 3), (3, 4, 3), (3, 3, 2), (3, 3, 4)}


def test_components(spark):
    vol = shape(spark, (5, 5, 5))
    corner = stencil.components(table(spark, [(0, 0, 0), (1, 1, 1)]), vol)
    assert {r.comp for r in corner.collect()} == {0}
    apart = stencil.components(table(spark, [(0, 0, 0), (4, 4, 4), (4, 4, 3)]), vol)
    assert stencil.component_sizes(apart).count() == 2
    assert tuple(stencil.largest_component(apart).first())[1:] == (4 * 25 + 4 * 5 + 3, 2, 2)
    snake = [(0, y, x) for y in range(5) for x in range(5) if y % 2 == 0 or x == (4 if y % 4 == 1 else 0)]
    assert {r.comp for r in stencil.components(table(spark, snake), vol).collect()} == {0}


def seeds(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], volumes.SEED)


def test_snap(spark):
    vol = shape(spark, (20, 20, 20))
    cube = table(spark, list(product(range(10, 15), repeat=3)))
    far = snap.snap_seeds(seeds(spark, [(1, 0, 0.0, 0.0, 0.0)]), cube, vol, use_boundary=False, downsample=False).first()
    assert (far.vz, far.vy, far.vx) == (10, 10, 10) and far.moved
    on = snap.snap_seeds(seeds(spark, [(1, 0, 12.0, 12.0, 12.0)]), cube, vol, use_boundary=False, downsample=False)
    assert not on.first().moved and snap.moved_count(on).first().moved_count == 0
    tie = snap.nearest(seeds(spark, [(1, 0, 12.0, 12.0, 12.0)]), stencil.boundary(cube), vol).first()
    assert (tie.vz, tie.vy, tie.vx, tie.d2) == (10, 12, 12, 4.0)
    pair = table(spark, [(0, 0, 1), (0, 1, 0)])
    for size, want in (((1.0, 10.0, 1.0), 1), ((1.0, 1.0, 10.0), 0)):
        got = snap.nearest(seeds(spark, [(1, 0, 0.0, 0.0, 0.0)]), pair, shape(spark, (1, 2, 2), size)).first()
        assert got.vx == want
    out = snap.nearest(seeds(spark, [(1, 0, 100.0, 100.0, 100.0)]), table(spark, [(3, 3, 3)]), shape(spark, (4, 4, 4))).first()
    assert (out.vz, out.vy, out.vx) == (3, 3, 3)
    with pytest.raises(ValueError):
        snap.snap_seeds(seeds(spark, [(1, 0, 0.0, 0.0, 0.0)]), table(spark, []), vol)
    with pytest.raises(ValueError):
        snap.snap_seeds(seeds(spark, []), cube, vol, downsample_mode="none")


def test_nearest_across_blocks(spark):
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 300, (400, 3)), axis=0)
    places = rng.uniform(-50, 350, (40, 3))
    got = snap.nearest(seeds(spark, [(1, i, *map(float, p)) for i, p in enumerate(places)]), table(spark, points), shape(spark, (300, 300, 300), (3.0, 2.0, 1.0))).collect()
    scale = np.array((3.0, 2.0, 1.0))
    for r in got:
        d = (((points - places[r.seed_idx]) * scale) ** 2).sum(1)
        assert tuple(points[d.argmin()]) == (r.vz, r.vy, r.vx)
    assert len(got) == 40


def test_graph(spark):
    line = table(spark, [(0, 0, x) for x in range(6)]).selectExpr("*", "double(1) AS cost")
    vol = shape(spark, (1, 1, 6), (1.0, 1.0, 2.0))
    ends = seeds(spark, [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 5.0)])
    got = {r.x: (r.t_a, r.t_b) for r in graph.arrival(line, ends, vol, "mcp").collect()}
    assert got == {x: (2.0 * x, 2.0 * (5 - x)) for x in range(6)}
    got = {r.x: r.t_a for r in graph.arrival(line, ends, vol, "dj3d").collect()}
    assert got[3] == pytest.approx(3 * 4 / 3)
    cut = graph.arrival(line.where("x <> 3"), ends, vol, "mcp").orderBy("x").collect()
    assert cut[-1].t_a is None and cut[0].t_b is None
    with pytest.raises(ValueError):
        graph.arrival(line, ends, vol, "other")
    tree = graph.spanning_tree(seeds(spark, [(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.0, 0.0, 9.0), (1, 2, 0.0, 0.0, 4.0), (2, 5, 0.0, 0.0, 0.0)]), shape(spark, (1, 1, 10))).orderBy("step").collect()
    assert [(r.a, r.b) for r in tree] == [(0, 2), (2, 1)]


def labelled(spark, rows):
    return spark.createDataFrame([(0, 0, 0, x, label) for x, label in rows], "sv_id long, z int, y int, x int, label tinyint")


def test_repair(spark):
    vol = shape(spark, (1, 1, 12))
    places = seeds(spark, [(1, 0, 0.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 11.0)])
    labels = labelled(spark, [(0, 1), (1, 1), (3, 1), (4, 1), (5, 1), (8, 2), (9, 2), (11, 2)])
    out = {r.x: r.label for r in resolve.enforce_components(labels, places, vol, 1).collect()}
    assert out[0] == 1 and out[3] == out[4] == out[5] == 3
    out = {r.x: r.label for r in resolve.enforce_components(labels, places.where("side = 2"), vol, 1).collect()}
    assert out[0] == 3 and out[3] == 1  # the largest stays where none has a seed
    assert resolve.enforce_components(labels, places, vol, 1, allow_stray=False).where("label = 3").count() == 0
    strays = labelled(spark, [(0, 1), (1, 3), (2, 3), (3, 3), (4, 2), (6, 3), (8, 3), (9, 2)])
    votes = {r.comp: (r.n_source, r.n_sink, r.side) for r in resolve.border_vote(strays, vol).collect()}
    assert votes == {1: (1, 1, 0), 6: (0, 0, 0), 8: (0, 1, 2)}
    out = {r.x: r.label for r in resolve.resolve_strays(strays, places, vol).collect()}
    assert (out[1], out[6], out[8]) == (1, 2, 2)
    assert regions.histogram(strays).first().n_stray == 5


def test_seeds_on_coarse_grids(spark):
    coarse = table(spark, [(1, 1, 3), (0, 0, 0)])
    places = seeds(spark, [(1, 0, 2.0, 3.0, 3.0), (1, 1, 3.0, 3.0, 9.0), (2, 0, 0.0, 1.0, 0.0)])
    assert cells(regions.seeds_on_grid(places, (2, 2, 1), coarse)) == {(1, 1, 3), (0, 0, 0)}
    near = {(r.side, r.seed_idx): (r.z, r.y, r.x) for r in regions.seeds_near_grid(places, (2, 2, 1), coarse, shape(spark, (4, 4, 10))).collect()}
    assert near == {(1, 0): (1, 1, 3), (1, 1): (1, 1, 3), (2, 0): (0, 0, 0)}


def brute_arrival(cost, starts, size, backend):
    """Dijkstra over the neighbours of a dictionary of costs."""
    best, queue = {}, [(0.0, p) for p in starts if p in cost]
    heapq.heapify(queue)
    while queue:
        t, p = heapq.heappop(queue)
        if p in best:
            continue
        best[p] = t
        for o in stencil.OFFSETS:
            q = tuple(a + d for a, d in zip(p, o))
            if q in cost and q not in best:
                length = sum((d * s) ** 2 for d, s in zip(o, size)) ** 0.5
                heapq.heappush(queue, (t + (0.5 * (cost[p] + cost[q]) * length if backend == "mcp" else cost[q] * sum(size) / 3), q))
    return best


def test_blocks_against_brute_force(spark, monkeypatch):
    """Components and arrivals over many small blocks."""
    monkeypatch.setattr(blocks, "EDGE", 6)
    rng = random.Random(3)
    places = [p for p in itertools.product(range(6), range(9), range(11)) if rng.random() < 0.2]
    cost = {p: rng.choice((0.5, 1.0, 3.25, 40.0)) for p in places}
    vol = shape(spark, (6, 9, 11), (3.0, 2.0, 1.0))
    got = {(r.z, r.y, r.x): r.comp for r in stencil.components(table(spark, places), vol).collect()}
    for p in places:
        mine = brute_arrival(cost, [p], (1, 1, 1), "mcp")
        assert got[p] == min((z * 9 + y) * 11 + x for z, y, x in mine)
    frame = spark.createDataFrame([(0, *p, c) for p, c in cost.items()], "sv_id long, z int, y int, x int, cost double")
    ends = seeds(spark, [(1, 0, *map(float, places[0])), (1, 1, *map(float, places[3])), (2, 0, *map(float, places[-1])), (2, 1, 0.0, 0.0, 99.0)])
    for backend in ("mcp", "dj3d"):
        a, b = (brute_arrival(cost, s, (3.0, 2.0, 1.0), backend) for s in ([places[0], places[3]], [places[-1]]))
        rows = graph.arrival(frame, ends, vol, backend).collect()
        assert len(rows) == len(places)
        for r in rows:
            p = (r.z, r.y, r.x)
            assert (r.t_a, r.t_b) == (pytest.approx(a[p]) if p in a else None, pytest.approx(b[p]) if p in b else None)


def test_voxels_are_never_broadcast_by_estimate(spark, tmp_path):
    """A table of small balls looks small to the planner; the places around them aren't."""
    from fractus import registry, split_queries  # noqa: F401

    spark.range(1000).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("places_beside", "boundary_two_deep", "drawn_voxels", "snapped_to_every_third"):
        planned = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
        assert "Join" in planned and "BroadcastHashJoin" not in planned


def test_cells_under_coarse_ones_are_made_and_widened_by_side(spark):
    """As upsample gives them, without a look at all fine cells for each side; dilated, the sides stay apart."""
    steps, rng = (2, 3, 1), random.Random(8)
    fine = table(spark, [p for p in itertools.product(range(5), range(7), range(6)) if rng.random() < 0.7])
    on = [(0, z, y, x, side) for z, y, x in itertools.product(range(3), range(3), range(6)) for side in (1, 2) if rng.random() < 0.2]
    coarse = spark.createDataFrame(on, "sv_id long, z int, y int, x int, side int")
    under = regions.cells_under(coarse, steps, fine)
    want = [(side, p) for side in (1, 2) for p in cells(regions.upsample(coarse.where(volumes.F.col("side") == side), steps, fine).where("side IS NOT NULL"))]
    assert sorted((r.side, (r.z, r.y, r.x)) for r in under.collect()) == sorted(want)
    wide = [(side, p) for side in (1, 2) for p in cells(stencil.dilate(under.where(volumes.F.col("side") == side), 1, fine))]
    assert sorted((r.side, (r.z, r.y, r.x)) for r in stencil.dilate(under, 1, fine, "side").collect()) == sorted(wide)


@pytest.mark.parametrize("name", ["grid_labels", "augmented_seeds"])
def test_searches_plan_no_broadcasts_by_estimate(spark, tmp_path, name):
    """No step of arrivals and labels or of ridges is planned with a broadcast: what is small is known only once it is measured."""
    from fractus import registry, split_queries  # noqa: F401

    spark.range(10).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsCount()
    registry.QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList(done, store.executionsCount() - done)
    said = [runs.apply(k).physicalPlanDescription() for k in range(runs.size())]
    planned = [text.split("== Initial Plan ==")[-1].split("\n\n")[0] for text in said]
    assert any("Join" in text for text in planned)
    assert not any("BroadcastHashJoin" in text for text in planned)


def test_a_cell_of_the_distance_looks_up_its_reach_once(spark):
    """An expression inside a lambda is computed each time it is named: the root that says how far to look stands once in each pass after the first."""
    voxels, shape, _ = volumes.dumbbell(spark)
    plan = distance.squared_distance(voxels, shape)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") == 2


def test_balls_are_spread_over_tasks(spark):
    """The voxels of a growing table are made by a growing number of tasks."""
    named = spark.range(0, 4000, 1, 1).select(volumes.F.col("id").alias("n_nationkey"), volumes.F.floor(volumes.F.col("id") / 5).alias("n_regionkey"))
    made = [n for n in volumes.nation_blobs(named).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(made) >= 4 and max(made) < sum(made) / 2


def test_erosion_joins_no_neighbours(spark, blob):
    """Erosion by the cube, once to three times, without a row for each neighbour."""
    solid = blob | (np.indices(blob.shape).sum(0) % 7 > 0)
    left = {tuple(map(int, p)) for p in np.argwhere(solid)}
    frame = table(spark, left)
    for rounds in (1, 2, 3):
        left = {p for p in left if all(tuple(a + d for a, d in zip(p, o)) in left for o in stencil.OFFSETS)}
        eroded = stencil.interior(frame, rounds)
        assert cells(eroded) == left
        assert "Generate" not in eroded._jdf.queryExecution().optimizedPlan().toString()
