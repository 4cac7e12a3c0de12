"""Fragments that arrive in parts, over several micro-batches and a restart."""

import numpy as np
from pyspark.sql import functions as F

from fractus.plans.splitters import NoopSplitter, WatershedSplitter
from fractus.sources import volumes
from fractus.streaming.parts import PART, part_stream, split_parts


def write(spark, folder, rows):
    spark.createDataFrame(rows, PART).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp, splitter, seeds, shape):
    query = split_parts(part_stream(spark, f"{tmp}/in", 1), lambda: seeds, lambda: shape, splitter, f"{tmp}/out", f"{tmp}/check")
    assert query.awaitTermination(300)


def labels(spark, tmp):
    return sorted(map(tuple, spark.read.schema(volumes.VOXEL + ", label tinyint").parquet(f"{tmp}/out/batch=*").select("sv_id", "z", "y", "x", "label").collect()))


def test_parts_over_restarts(spark, tmp_path):
    tmp, rng = str(tmp_path), np.random.default_rng(2)
    cells = {sv: np.argwhere(rng.random((4, 5, 6)) < 0.6).tolist() for sv in (1, 2, 3)}
    part = lambda sv, k, n: [(sv, k, n, *p) for p in cells[sv][k::n]]
    shape, seeds = volumes.volume(spark, [(sv, 4, 5, 6, 1.0, 1.0, 1.0) for sv in cells]), spark.createDataFrame([], volumes.SEED)
    write(spark, f"{tmp}/in", part(1, 0, 3) + part(2, 0, 1))
    write(spark, f"{tmp}/in", part(1, 0, 3))  # a part again
    write(spark, f"{tmp}/in", part(1, 2, 3) + part(3, 1, 2))
    run(spark, tmp, NoopSplitter(), seeds, shape)
    want = lambda *ids: sorted((sv, *p, 1) for sv in ids for p in cells[sv])
    assert labels(spark, tmp) == want(2)
    write(spark, f"{tmp}/in", part(1, 1, 3))
    run(spark, tmp, NoopSplitter(), seeds, shape)
    assert labels(spark, tmp) == want(1, 2)
    write(spark, f"{tmp}/in", part(1, 1, 3) + part(2, 0, 1))  # after they were given out
    run(spark, tmp, NoopSplitter(), seeds, shape)
    assert labels(spark, tmp) == want(1, 2)


def test_parts_give_the_labels_of_the_whole(spark, tmp_path):
    v, shape, seeds = volumes.dumbbell(spark)
    for k in range(3):
        own = v.where(F.col("x") % 3 == k).select("sv_id", F.lit(k).alias("part"), F.lit(3).alias("n_parts"), "z", "y", "x")
        own.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(spark, tmp_path, WatershedSplitter(), seeds, shape)
    want = WatershedSplitter().split(v, seeds, shape).labels
    assert labels(spark, tmp_path) == sorted(map(tuple, want.select("sv_id", "z", "y", "x", "label").collect()))
