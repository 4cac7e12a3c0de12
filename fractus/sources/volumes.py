"""Voxel tables: foreground voxels, volumes and seeds, from Parquet tables, arrays and formulas.

``voxel`` (sv_id, z, y, x) has the foreground only; ``volume`` (sv_id, nz, ny,
nx, sz, sy, sx) one row for each fragment; ``seed`` (sv_id, side, seed_idx, z,
y, x).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXEL = "sv_id long, z int, y int, x int"
VOLUME = "sv_id long, nz int, ny int, nx int, sz double, sy double, sx double"
SEED = "sv_id long, side tinyint, seed_idx int, z double, y double, x double"


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOXEL).parquet(path)


def write_labels(labels: DataFrame, path: str, fragments_in_a_file: str = "sv_id") -> None:
    """Labels as Parquet, clustered by fragment so that reading one prunes row groups."""
    labels.repartition(fragments_in_a_file).sortWithinPartitions(fragments_in_a_file, "z", "y", "x").write.parquet(path)


def box(spark: SparkSession, nz: int, ny: int, nx: int) -> DataFrame:
    """All cells (z, y, x) of a box."""
    cell = F.col("id")
    return spark.range(nz * ny * nx).select(F.floor(cell / (ny * nx)).cast("int").alias("z"), (F.floor(cell / nx) % ny).cast("int").alias("y"), (cell % nx).cast("int").alias("x"))


def from_array(spark: SparkSession, sv_id: int, mask: np.ndarray) -> DataFrame:
    """Foreground voxels of a dense (z, y, x) mask held by the caller."""
    if mask.ndim != 3:
        raise ValueError("a mask has three dimensions")
    at = np.argwhere(mask)
    return spark.createDataFrame([(sv_id, *map(int, p)) for p in at], VOXEL)


def from_array_column(volumes: DataFrame, column: str = "cells") -> DataFrame:
    """Foreground voxels of flat row-major boolean arrays (sv_id, nz, ny, nx, cells)."""
    flat = volumes.select("sv_id", "ny", "nx", F.posexplode(column).alias("i", "set")).where("set")
    plane = F.col("ny") * F.col("nx")
    return flat.select("sv_id", F.floor(F.col("i") / plane).cast("int").alias("z"), (F.floor(F.col("i") / F.col("nx")) % F.col("ny")).cast("int").alias("y"), (F.col("i") % F.col("nx")).cast("int").alias("x"))


def volume(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, VOLUME)


def dumbbells(ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dumbbell once for each id (sv_id): voxel, volume and seed tables."""
    one = dumbbell(ids.sparkSession)
    return tuple(ids.join(F.broadcast(df.drop("sv_id"))).select(*df.columns) for df in one)  # of fixed size  # type: ignore[return-value]


def dumbbell(spark: SparkSession, sv_id: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two cubes and a thin neck: voxel, volume and seed tables."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    cube = lambda lo, hi: (x >= lo) & (x < hi) & (y >= 10) & (y < 20) & (z >= 5) & (z < 15)
    neck = (x >= 15) & (x < 35) & (y >= 14) & (y < 16) & (z >= 9) & (z < 11)
    voxels = box(spark, 20, 30, 50).where(cube(5, 15) | cube(35, 45) | neck).select(F.lit(sv_id).cast("long").alias("sv_id"), "z", "y", "x")
    shape = volume(spark, [(sv_id, 20, 30, 50, 1.0, 1.0, 1.0)])
    seeds = spark.createDataFrame([(sv_id, 1, 0, 10.0, 15.0, 10.0), (sv_id, 2, 0, 10.0, 15.0, 40.0)], SEED)
    return voxels, shape, seeds


#: Balls whose voxels a task makes.
BALLS = 500
#: Shape (z, y, x) and voxel size of the volumes that the nation table gives.
BLOBS, BLOB_SIZE = (16, 24, 40), (3.0, 2.0, 1.0)


def nation_blobs(nation: DataFrame) -> DataFrame:
    """Balls around a place for each nation, a fragment for each region.

    The table is counted and spread first: small as it is, one task would read it and make all voxels.
    """
    k = F.col("n_nationkey")
    centre = nation.select(F.col("n_regionkey").cast("long").alias("sv_id"), (4 + k * 11 % 32).alias("cx"), (4 + k * 7 % 16).alias("cy"), (4 + k * 5 % 8).alias("cz"), (3 + k % 3).alias("r"))
    centre = centre.repartition(-(-max(1, nation.count()) // BALLS), "sv_id")
    reach = F.sequence(-F.col("r"), F.col("r"))
    cells = centre.withColumn("dz", F.explode(reach)).withColumn("dy", F.explode(reach)).withColumn("dx", F.explode(reach))
    cells = cells.where("dz * dz + dy * dy + dx * dx <= r * r").select("sv_id", (F.col("cz") + F.col("dz")).cast("int").alias("z"), (F.col("cy") + F.col("dy")).cast("int").alias("y"), (F.col("cx") + F.col("dx")).cast("int").alias("x"))
    nz, ny, nx = BLOBS
    return cells.where(f"z BETWEEN 0 AND {nz - 1} AND y BETWEEN 0 AND {ny - 1} AND x BETWEEN 0 AND {nx - 1}").distinct()


def blob_volumes(nation: DataFrame) -> DataFrame:
    nz, ny, nx = BLOBS
    sz, sy, sx = BLOB_SIZE
    ids = nation.select(F.col("n_regionkey").cast("long").alias("sv_id")).distinct()
    return ids.select("sv_id", *(F.lit(v).cast("int").alias(n) for n, v in (("nz", nz), ("ny", ny), ("nx", nx))), *(F.lit(v).alias(n) for n, v in (("sz", sz), ("sy", sy), ("sx", sx))))


def blob_seeds(nation: DataFrame) -> DataFrame:
    """A seed for each nation near its place: even keys are sources, odd ones sinks."""
    k = F.col("n_nationkey")
    side = F.when(k % 2 == 0, 1).otherwise(2).cast("tinyint")
    return nation.select(F.col("n_regionkey").cast("long").alias("sv_id"), side.alias("side"), k.cast("int").alias("seed_idx"), (4.5 + k * 5 % 8).cast("double").alias("z"), (4.25 + k * 7 % 16).cast("double").alias("y"), (3.5 + k * 11 % 32).cast("double").alias("x"))


def lineitem_voxels(lineitem: DataFrame, least: int) -> DataFrame:
    """Cells of a small grid, a fragment for each return flag, that hold at least ``least`` items."""
    cells = lineitem.select(F.ascii("l_returnflag").cast("long").alias("sv_id"), (F.col("l_quantity").cast("int") % 8).alias("z"), (F.col("l_suppkey") % 10).cast("int").alias("y"), (F.col("l_partkey") % 16).cast("int").alias("x"))
    return cells.groupBy("sv_id", "z", "y", "x").count().where(F.col("count") >= least).drop("count")
