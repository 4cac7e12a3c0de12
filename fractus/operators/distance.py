"""Exact anisotropic Euclidean distance to the background, one axis after another.

Along each line the foreground falls into runs. A voxel's nearest background lies
in its own run's ends or is reached through a voxel of the same run, so each pass
is one shuffle by line and works within runs. Only voxels nearer than the distance
known so far (along the axes before, or to the run's ends) are looked at, so a
pass takes as many steps as a distance is long and not as a run is. The volume's border isn't
background; without any background distances are infinite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import normalised, ridge_cost, travel_cost


def _numbered(df: DataFrame, axis: str) -> DataFrame:
    """``df`` with the run of each cell along ``axis``: consecutive cells share it."""
    line = Window.partitionBy("sv_id", *(a for a in "zyx" if a != axis)).orderBy(axis)
    return df.withColumn("run", F.col(axis) - F.row_number().over(line))


def _square(axis: str, d: Column) -> Column:
    return (F.col(f"s{axis}") * d) * (F.col(f"s{axis}") * d)


def _to_ends(axis: str, here: Column) -> Column:
    """Squared distance along ``axis`` to the background behind the nearer end of the run; the volume's border has none."""
    inf = F.lit(float("inf"))
    before = F.when(F.col("lo") > 0, _square(axis, here - F.col("lo") + 1)).otherwise(inf)
    return F.least(before, F.when(F.col("hi") < F.col(f"n{axis}") - 1, _square(axis, F.col("hi") + 1 - here)).otherwise(inf))


def _first(df: DataFrame, axis: str) -> DataFrame:
    """Distances along the first axis, where nothing but the ends of runs is known."""
    run = Window.partitionBy("sv_id", *(a for a in "zyx" if a != axis), "run")
    ended = _numbered(df, axis).withColumns({"lo": F.min(axis).over(run), "hi": F.max(axis).over(run)})
    return ended.withColumn("d2", _to_ends(axis, F.col(axis))).drop("run", "lo", "hi")


def _along(df: DataFrame, axis: str) -> DataFrame:
    line = ["sv_id", *(a for a in "zyx" if a != axis)]
    keep = [f"n{axis}", f"s{axis}", *(f"{p}{a}" for a in "zyx" if a != axis for p in "ns")]
    runs = _numbered(df, axis).groupBy(*line, "run").agg(F.sort_array(F.collect_list(F.struct(F.col(axis).alias("p"), F.col("d2").alias("d")))).alias("cells"), F.min(axis).alias("lo"), F.max(axis).alias("hi"), *(F.first(c).alias(c) for c in keep))
    # A lambda's parts are computed as often as they are named: what is known and how far to look are made fields first.
    known = F.transform("cells", lambda c: F.struct(c["p"].alias("p"), F.least(c["d"], _to_ends(axis, c["p"])).alias("known")))
    steps = lambda c: F.floor(F.least(F.sqrt(c["known"]) / F.col(f"s{axis}"), F.size("cells"))).cast("int") + 1
    reach = F.transform(known, lambda c: F.struct(c["p"].alias("p"), c["known"].alias("known"), steps(c).alias("reach")))

    def nearest(cell):
        here = cell["p"]
        near = F.slice("cells", F.greatest(F.lit(1), here - F.col("lo") + 1 - cell["reach"]), 2 * cell["reach"] + 1)  # cells are consecutive; the first stands at lo
        through = F.array_min(F.transform(near, lambda o: o["d"] + _square(axis, here - o["p"])))
        return F.struct(here.alias(axis), F.least(cell["known"], through).alias("d2"))

    return runs.select(*line, *keep, F.explode(F.transform(reach, nearest)).alias("c")).select(*line, *keep, F.col(f"c.{axis}").alias(axis), F.col("c.d2").alias("d2"))


def squared_distance(voxels: DataFrame, volumes: DataFrame) -> DataFrame:
    """``voxels`` (sv_id, z, y, x) with d2 (double), the squared distance to the nearest background."""
    out = voxels.select("sv_id", "z", "y", "x").join(volumes, "sv_id")
    out = _first(out, "x")
    for axis in ("y", "z"):
        out = _along(out, axis)
    return out.select("sv_id", "z", "y", "x", "d2")


def cost_fields(distances: DataFrame, gamma: float = 1.6, power: float = 2.0) -> DataFrame:
    """Rows with cost and ridge from d2, a written table: the maximum is one aggregated row for each fragment, joined back."""
    most = distances.groupBy("sv_id").agg(F.sqrt(F.max("d2")).alias("most"))
    dn = normalised(F.sqrt("d2"), F.col("most"))
    return distances.join(most, "sv_id").select("sv_id", "z", "y", "x", travel_cost(dn, gamma).alias("cost"), ridge_cost(dn, power).alias("ridge"))
