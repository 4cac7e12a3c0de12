"""The array interface: orders, results, errors."""

import numpy as np
import pytest

from fractus.plans.arrays import prepare_array, seeds_from_zyx, seeds_zyx, split_array
from fractus.plans.profiling import JobProfiler, NullProfiler, Profiler
from fractus.plans.splitters import NoopSplitter, RidgeConnectPrep, WatershedSplitter


def dumbbell():
    mask = np.zeros((50, 30, 20), bool)
    mask[5:15, 10:20, 5:15] = mask[35:45, 10:20, 5:15] = mask[15:35, 14:16, 9:11] = True
    return mask, np.array([[10, 15, 10]]), np.array([[40, 15, 10]])


def test_split_in_both_orders(spark):
    mask, a, b = dumbbell()
    timed = JobProfiler(spark)
    one = split_array(spark, WatershedSplitter(), mask, a, b, profiler=timed)
    two = split_array(spark, WatershedSplitter(), mask.transpose(2, 1, 0), a[:, ::-1], b[:, ::-1], vol_order="zyx", vox_order="ZYX", seed_order="zyx")
    assert (one.labels == two.labels.transpose(2, 1, 0)).all() and one.labels.shape == mask.shape
    assert ((one.labels > 0) == mask).all() and one.labels[10, 15, 10] == 1 and one.labels[40, 15, 10] == 2
    assert one.snapped_sources.shape == (1, 3) and (one.snapped_sources == two.snapped_sources[:, ::-1]).all()
    assert one.side_of_label == {1: 1, 2: 2} and one.diagnostics["total_elapsed_s"] > 0
    assert timed.seconds["split"] > 0 and isinstance(NullProfiler(), Profiler) and isinstance(timed, Profiler)


def test_noop_and_prepare(spark):
    mask, a, b = dumbbell()
    out = split_array(spark, NoopSplitter(), mask, a + 0.5, b)
    assert (out.labels == mask).all() and out.snapped_sources.tolist() == [[10, 16, 10]] and out.aug_sinks is None
    pa, pb, ok_a, ok_b = prepare_array(spark, RidgeConnectPrep(), mask, a, b)
    assert ok_a and ok_b and len(pa) == len(pb) == 1


def test_errors(spark):
    mask, a, b = dumbbell()
    for change in ({"mask": mask[0]}, {"sources": np.zeros((2, 2))}, {"vol_order": "yxz"}, {"seed_order": "x"}, {"vox_order": "x"}):
        with pytest.raises(ValueError):
            split_array(spark, NoopSplitter(), **({"mask": mask, "sources": a, "sinks": b} | change))


def test_seed_orders():
    points = np.array([[1, 2, 3], [10, 20, 30]])
    assert seeds_zyx(points).tolist() == [[3, 2, 1], [30, 20, 10]]
    assert (seeds_from_zyx(seeds_zyx(points)) == points).all()
    assert seeds_zyx(np.zeros((0, 3))).shape == (0, 3)
