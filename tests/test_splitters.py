"""Splitters end to end, on the dumbbell and on small fragments."""

from dataclasses import replace

import dense
import numpy as np
import pytest

import fractus
from fractus.operators import stencil
from fractus.plans import kernel
from fractus.plans.splitters import GeodesicSplitter, NoopSplitter, RidgeConnectPrep, SeedPrep, Splitter, WatershedSplitter
from fractus.sources import volumes
from fractus.streaming.splits import split_stream, voxel_stream


@pytest.fixture(scope="module")
def dumbbell(spark):
    v, shape, seeds = volumes.dumbbell(spark)
    return v.cache(), shape, seeds


@pytest.fixture(scope="module")
def both(dumbbell):
    """The dumbbell under two ids, split at once."""
    v, shape, seeds = dumbbell
    again = [df.unionByName(df.withColumn("sv_id", df.sv_id + 7)) for df in (v, seeds, shape)]
    return GeodesicSplitter(backend="mcp").split(*again)


@pytest.fixture(scope="module")
def split(both):
    one = lambda df: df.where("sv_id = 0")
    return replace(both, labels=one(both.labels), snapped=one(both.snapped), diagnostics=one(both.diagnostics))


def test_fixture(dumbbell):
    v, shape, _ = dumbbell
    assert v.count() == 2080 and stencil.boundary(v).count() == 1056


def test_geodesic(dumbbell, split):
    v, shape, _ = dumbbell
    labels = {(r.z, r.y, r.x): r.label for r in split.labels.collect()}
    assert len(labels) == 2080 and set(labels.values()) == {1, 2}
    assert labels[10, 15, 10] == 1 and labels[10, 15, 40] == 2
    assert min(sum(x == k for x in labels.values()) for k in (1, 2)) > 100
    for k in (1, 2):
        assert stencil.component_sizes(stencil.components(split.labels.where(f"label = {k}").drop("label"), shape)).count() == 1
    facts = split.diagnostics.first()
    assert facts.full_shape_zyx == [20, 30, 50] and facts.fg_bbox_shape_zyx == [12, 12, 42] and facts.backend == "mcp" and facts.downsample_zyx is None
    assert facts.label_counts == {k: sum(x == k for x in labels.values()) for k in (1, 2, 3)} and sum(facts.pre_resolve_label_counts.values()) == 2080
    snapped = {(r.side, r.z, r.y, r.x) for r in split.snapped.collect()}
    assert snapped == {(1, 10, 15, 14), (2, 10, 15, 44)} or len(snapped) == 2


def test_geodesic_options(dumbbell):
    v, shape, seeds = dumbbell
    for options in ({"seed_prep": RidgeConnectPrep(), "halo": 0, "downsample_geodesic": (2, 2, 2), "nb_dilate": 0},):
        out = GeodesicSplitter(**options).split(v, seeds, shape).labels
        counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
        assert sum(counts.values()) == 2080 and min(counts[1], counts[2]) > 100
    with pytest.raises(ValueError):
        GeodesicSplitter(backend="x")


def test_many_fragments_at_once(both):
    one, other = ({(r.z, r.y, r.x, r.label) for r in both.labels.where(f"sv_id = {sv}").collect()} for sv in (0, 7))
    assert one == other and len(one) == 2080


def test_ridge(spark, dumbbell):
    v, shape, seeds = dumbbell
    alone = RidgeConnectPrep().prepare(v, seeds, shape)
    assert alone.seeds.groupBy("side").count().where("count = 1").count() == 2
    assert tuple(alone.status.first())[1:] == (True, True)
    more = seeds.unionByName(spark.createDataFrame([(0, 1, 1, 10.0, 17.0, 12.0)], volumes.SEED))
    joined = {r.side: r["count"] for r in RidgeConnectPrep().prepare(v, more, shape).seeds.groupBy("side").count().collect()}
    assert joined[1] > 2 and joined[2] == 1


def test_watershed_and_noop(dumbbell):
    v, shape, seeds = dumbbell
    out = {(r.z, r.y, r.x): r.label for r in WatershedSplitter().split(v, seeds, shape).labels.collect()}
    assert out[10, 15, 10] == 1 and out[10, 15, 40] == 2
    line = WatershedSplitter(watershed_line=True).split(v, seeds, shape).labels.count()
    assert 2000 < line <= 2080
    nothing = NoopSplitter("unused").split(v, seeds, shape)
    assert nothing.labels.where("label <> 1").count() == 0 and nothing.labels.count() == 2080 and nothing.side_of_label == {1: 1}


def test_profiler(spark, dumbbell):
    from fractus.plans.profiling import JobProfiler

    v, shape, seeds = dumbbell
    timed = JobProfiler(spark)
    WatershedSplitter(profiler=timed).split(v, seeds, shape)
    assert set(timed.seconds) == {"watershed"}


def test_protocols():
    assert all(isinstance(x, Splitter) for x in (GeodesicSplitter(), WatershedSplitter(), NoopSplitter()))
    assert isinstance(RidgeConnectPrep(), SeedPrep) and not isinstance(NoopSplitter(), SeedPrep) and not isinstance(object(), Splitter)
    assert (fractus.SOURCE, fractus.SINK, fractus.STRAY) == (1, 2, 3)


def test_kernels_against_tables(spark):
    """The dense kernels and the table operators agree."""
    from fractus.operators import distance, graph

    rng = np.random.default_rng(8)
    mask = rng.random((6, 7, 8)) < 0.5
    v, shape = volumes.from_array(spark, 0, mask), volumes.volume(spark, [(0, 6, 7, 8, 3.0, 2.0, 1.0)])
    far = kernel.edt(mask, (3.0, 2.0, 1.0)) ** 2
    for r in distance.squared_distance(v, shape).collect():
        assert far[r.z, r.y, r.x] == pytest.approx(r.d2)
    comp = dense.components(mask)
    assert all(comp[r.z, r.y, r.x] == r.comp for r in stencil.components(v, shape).collect())
    start = tuple(map(int, np.argwhere(mask)[0]))
    cost = np.where(mask, 1.0, np.inf)
    for backend in ("mcp", "dj3d"):
        t = dense.arrival(cost, [start], (3.0, 2.0, 1.0), backend)
        seeds = spark.createDataFrame([(0, 1, 0, *map(float, start))], volumes.SEED)
        for r in graph.arrival(v.selectExpr("*", "double(1) AS cost"), seeds, shape, backend).collect():
            assert (r.t_a is None and np.isinf(t[r.z, r.y, r.x])) or r.t_a == pytest.approx(t[r.z, r.y, r.x])


def test_stream(spark, dumbbell, tmp_path):
    v, shape, seeds = dumbbell
    v.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = split_stream(voxel_stream(spark, str(tmp_path / "in")), lambda: seeds, lambda: shape, NoopSplitter(), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2080


def brute_flooding(mask, sources, sinks, compactness, line):
    """Compact flooding with a plain list as its queue: the cheapest entry, then the oldest, is taken next."""
    height = -kernel.edt(mask, (1.0, 1.0, 1.0))
    labels = {}
    for side, pts in ((1, sources), (2, sinks)):
        labels.update({tuple(map(int, p)): side for p in pts})
    queue = [(height[p], k, p, p) for k, p in enumerate(sorted(labels))]
    age = len(queue)
    while queue:
        at = min(range(len(queue)), key=lambda i: queue[i][:2])
        _, _, p, origin = queue.pop(at)
        beside = [tuple(p[k] + (d if k == axis else 0) for k in range(3)) for axis in range(3) for d in (-1, 1)]
        beside = [q for q in sorted(beside) if all(0 <= v < n for v, n in zip(q, mask.shape)) and mask[q]]
        if p != origin:
            if p in labels or (line and len({labels[q] for q in beside if q in labels}) > 1):
                continue
            labels[p] = labels[origin]
        for q in beside:
            if q not in labels:
                queue.append((height[q] + compactness * sum((v - w) ** 2 for v, w in zip(q, origin)) ** 0.5, age, q, origin))
                age += 1
    return labels


def test_watershed_against_brute_force():
    rng = np.random.default_rng(11)
    for trial in range(8):
        mask = rng.random((5, 9, 10)) < 0.75
        at = rng.permutation(np.argwhere(mask))
        for compactness, line in ((1e-3, False), (0.5, False), (1e-3, True)):
            got, a, b = kernel.watershed(mask, at[:2], at[2:4], (1.0, 1.0, 1.0), compactness, line)
            want = brute_flooding(mask, at[:2], at[2:4], compactness, line)
            assert (a == at[:2]).all() and (b == at[2:4]).all()
            assert {tuple(map(int, p)): int(got[tuple(p)]) for p in np.argwhere(got)} == want
