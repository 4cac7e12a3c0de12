"""Repair of labels: one component for each side, strays by border vote and nearest seed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import SINK, SOURCE, STRAY
from ..plans.fixpoint import kept
from ..plans.profiling import NullProfiler, Profiler
from .stencil import KEY, components, neighbours

#: Edge of the blocks of stray voxels that meet seeds together.
NEAR = 16


def enforce_components(labels: DataFrame, seeds: DataFrame, volumes: DataFrame, side: int, allow_stray: bool = True) -> DataFrame:
    """Keep the components of ``side`` that hold one of its seeds, else the largest; others become stray.

    ``labels``: (sv_id, z, y, x, label); ``seeds``: voxels (sv_id, side, z, y, x).
    """
    if not allow_stray:
        return labels
    mine = components(labels.where(F.col("label") == side).select(*KEY), volumes)
    seeded = seeds.where(F.col("side") == side).select(*KEY).distinct()
    marks = mine.join(seeded.withColumn("seed", F.lit(1)), KEY, "left").groupBy("sv_id", "comp").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    best = marks.groupBy("sv_id").agg(F.max("seed").alias("any"), F.min(F.struct((-F.col("n")).alias("m"), "comp")).alias("s"))
    kept = marks.join(best, "sv_id").where("(any = 1 AND seed = 1) OR (any IS NULL AND comp = s.comp)").select("sv_id", "comp")
    bad = mine.join(kept, ["sv_id", "comp"], "left_anti").select(*KEY, F.lit(True).alias("bad"))
    return labels.join(bad, KEY, "left").withColumn("label", F.when(F.col("bad"), STRAY).otherwise(F.col("label")).cast("tinyint")).drop("bad")


def stray_components(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """Stray voxels (sv_id, z, y, x, comp), written for those that read them more than once."""
    return kept(components(labels.where(F.col("label") == STRAY).select(*KEY), volumes))


def border_vote(labels: DataFrame, volumes: DataFrame, strays: DataFrame | None = None) -> DataFrame:
    """Stray components (sv_id, comp, n, n_source, n_sink, side): voxels touching each side; side 0 where even."""
    strays = stray_components(labels, volumes) if strays is None else strays
    sides = labels.where(F.col("label") != STRAY)
    touch = neighbours(strays, sides, "comp").groupBy("sv_id", "comp", "z0", "y0", "x0").agg(F.bool_or(F.col("label") == SOURCE).alias("a"), F.bool_or(F.col("label") == SINK).alias("b"))
    votes = touch.groupBy("sv_id", "comp").agg(F.count_if("a").alias("n_source"), F.count_if("b").alias("n_sink"))
    all_of = strays.groupBy("sv_id", "comp").agg(F.count("*").alias("n"))
    out = all_of.join(votes, ["sv_id", "comp"], "left").fillna(0, ["n_source", "n_sink"])
    side = F.when(F.col("n_source") > F.col("n_sink"), SOURCE).when(F.col("n_sink") > F.col("n_source"), SINK).otherwise(0)
    return out.withColumn("side", side.cast("int"))


def nearest_side(strays: DataFrame, seeds: DataFrame, volumes: DataFrame) -> DataFrame:
    """Components (sv_id, comp, side): sink iff strictly more of their voxels are nearer a sink seed.

    ``strays``: (sv_id, comp, z, y, x). Fragments lacking seeds of a side have no
    row. Voxels and seeds meet by blocks of voxels: a block's box bounds the
    distance of its voxels to each seed from both sides, and only seeds that can
    be the nearest of some voxel in it stay.
    """
    key = ["sv_id", "bz", "by", "bx"]
    sized = volumes.select("sv_id", "sz", "sy", "sx")
    points = strays.select("sv_id", "comp", "z", "y", "x", *(F.floor(F.col(a) / NEAR).cast("int").alias(f"b{a}") for a in "zyx")).join(sized, "sv_id")
    places = seeds.select("sv_id", F.col("side").cast("int").alias("side"), *(F.col(a).cast("double").alias(f"s_{a}") for a in "zyx")).distinct()
    lows, highs = [F.min(a).alias(f"{a}l") for a in "zyx"], [F.max(a).alias(f"{a}h") for a in "zyx"]
    boxes = points.groupBy(*key).agg(*lows, *highs, *(F.first(f"s{a}").alias(f"s{a}") for a in "zyx"))
    near = [F.greatest(F.col(f"{a}l") - F.col(f"s_{a}"), F.col(f"s_{a}") - F.col(f"{a}h"), F.lit(0.0)) * F.col(f"s{a}") for a in "zyx"]
    far = [F.greatest(F.abs(F.col(f"{a}l") - F.col(f"s_{a}")), F.abs(F.col(f"{a}h") - F.col(f"s_{a}"))) * F.col(f"s{a}") for a in "zyx"]
    square = lambda p: p[0] * p[0] + p[1] * p[1] + p[2] * p[2]
    reach = boxes.join(places, "sv_id").withColumns({"near": square(near), "far": square(far)})
    most = reach.groupBy(*key, "side").agg(F.min("far").alias("most"))
    wanted = reach.join(most, [*key, "side"]).where("near <= most").select(*key, "side", *(f"s_{a}" for a in "zyx"))
    gap = [(F.col(a) - F.col(f"s_{a}")) * F.col(f"s{a}") for a in "zyx"]
    met = points.join(wanted, key).withColumn("d2", square(gap))
    best = met.groupBy("sv_id", "comp", "z", "y", "x").agg(F.min(F.when(F.col("side") == SOURCE, F.col("d2"))).alias("a"), F.min(F.when(F.col("side") == SINK, F.col("d2"))).alias("b"))
    votes = best.where("a IS NOT NULL AND b IS NOT NULL").groupBy("sv_id", "comp").agg(F.count_if(F.col("b") < F.col("a")).alias("k"), F.count("*").alias("n"))
    return votes.select("sv_id", "comp", F.when(2 * F.col("k") > F.col("n"), SINK).otherwise(SOURCE).alias("side"))


def resolve_strays(labels: DataFrame, seeds: DataFrame, volumes: DataFrame) -> DataFrame:
    """Labels with stray components given to a side by border vote, else by nearest seeds."""
    strays = stray_components(labels, volumes)
    return _moved(labels, chosen_sides(labels, strays, seeds, volumes), strays)


def chosen_sides(labels: DataFrame, strays: DataFrame, seeds: DataFrame, volumes: DataFrame) -> DataFrame:
    """(sv_id, comp, n, side, tie): the side of each stray component, null if the fragment lacks seeds; tie where the vote was even."""
    votes = kept(border_vote(labels, volumes, strays))
    even = votes.where("side = 0").select("sv_id", "comp")
    nearer = nearest_side(strays.join(even, ["sv_id", "comp"], "left_semi"), seeds, volumes).withColumnRenamed("side", "near")
    return votes.join(nearer, ["sv_id", "comp"], "left").select("sv_id", "comp", "n", F.when(F.col("side") != 0, F.col("side")).otherwise(F.col("near")).alias("side"), (F.col("side") == 0).alias("tie"))


def _moved(labels: DataFrame, chosen: DataFrame, strays: DataFrame) -> DataFrame:
    moved = strays.join(chosen.where("side IS NOT NULL"), ["sv_id", "comp"]).select(*KEY, "side")
    return labels.join(moved, KEY, "left").withColumn("label", F.coalesce("side", "label").cast("tinyint")).drop("side")


def side_components(labels: DataFrame, volumes: DataFrame) -> DataFrame:
    """(sv_id, z, y, x, label, comp) of both sides' voxels, found in one loop: the sink's are set apart along z."""
    apart = (F.col("label") - 1) * (F.col("nz") + 2)
    both = labels.where(F.col("label").isin(SOURCE, SINK)).join(volumes.select("sv_id", "nz"), "sv_id")
    found = components(both.select("sv_id", (F.col("z") + apart).cast("int").alias("z"), "y", "x"), volumes)
    back = found.join(volumes.select("sv_id", "nz"), "sv_id").withColumn("label", F.when(F.col("z") >= F.col("nz") + 2, SINK).otherwise(SOURCE))
    return back.select("sv_id", (F.col("z") - apart).cast("int").alias("z"), "y", "x", F.col("label").cast("tinyint").alias("label"), "comp")


def enforce_both(labels: DataFrame, seeds: DataFrame, volumes: DataFrame, allow_stray: bool = True) -> tuple[DataFrame, DataFrame]:
    """:func:`enforce_components` of either side, and the report (sv_id, label, kept_components, moved_to_stray).

    Neither side's components hang on the other's, so one loop finds both. With
    ``allow_stray`` false the labels stay and the report says what would move.
    """
    mine = kept(side_components(labels, volumes))
    seeded = seeds.select(*KEY, F.col("side").cast("tinyint").alias("label")).distinct().withColumn("seed", F.lit(1))
    marks = kept(mine.join(seeded, [*KEY, "label"], "left").groupBy("sv_id", "label", "comp").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    best = marks.groupBy("sv_id", "label").agg(F.max("seed").alias("any"), F.min(F.struct((-F.col("n")).alias("m"), "comp")).alias("s"))
    judged = marks.join(best, ["sv_id", "label"]).withColumn("kept", F.expr("(any = 1 AND seed <=> 1) OR (any IS NULL AND comp = s.comp)"))
    report = judged.groupBy("sv_id", "label").agg(F.count_if("kept").alias("kept_components"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("n"))), F.lit(0)).alias("moved_to_stray"))
    if not allow_stray:
        return labels, report
    bad = mine.join(judged.where("NOT kept").select("sv_id", "label", "comp"), ["sv_id", "label", "comp"], "left_semi").select(*KEY, F.lit(True).alias("bad"))
    return labels.join(bad, KEY, "left").withColumn("label", F.when(F.col("bad"), STRAY).otherwise(F.col("label")).cast("tinyint")).drop("bad"), report


@dataclass(frozen=True)
class Repaired:
    """Labels after repair and before strays were resolved; reports of the first enforcement (sv_id, label, kept_components, moved_to_stray) and of the resolver (sv_id, n_components, moved_to_source, moved_to_sink, tie_break_count)."""

    labels: DataFrame
    before: DataFrame
    enforced: DataFrame | None
    resolved: DataFrame


def repair(labels: DataFrame, seeds: DataFrame, volumes: DataFrame, enforce: bool = True, allow_stray: bool = True, profiler: Profiler | None = None) -> Repaired:
    """Enforce components, resolve strays, and enforce again in the fragments where the resolver moved anything; nothing resolves after that."""
    profiler = profiler or NullProfiler()
    report = None
    with profiler.profile("enforce_cc:1st"):
        if enforce:
            labels, report = enforce_both(labels, seeds, volumes, allow_stray)
            report = kept(report)
        before = labels = kept(labels)
    with profiler.profile("resolve_stray"):
        strays = stray_components(labels, volumes)
        chosen = kept(chosen_sides(labels, strays, seeds, volumes))
        moved = F.coalesce(F.sum(F.when(F.col("side") == SOURCE, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("side") == SINK, F.col("n"))), F.lit(0))
        resolved = kept(chosen.groupBy("sv_id").agg(F.count("*").alias("n_components"), moved[0].alias("moved_to_source"), moved[1].alias("moved_to_sink"), F.count_if("tie").alias("tie_break_count")))
        if not strays.isEmpty():
            labels = kept(_moved(labels, chosen, strays))
    with profiler.profile("enforce_cc:2nd"):
        again = resolved.where("moved_to_source + moved_to_sink > 0").select("sv_id")
        if enforce and allow_stray and not again.isEmpty():
            redone, _ = enforce_both(labels.join(again, "sv_id", "left_semi"), seeds, volumes, allow_stray)
            labels = kept(labels.join(again, "sv_id", "left_anti").unionByName(redone.select(*labels.columns)))
    return Repaired(labels, before, report, resolved)
