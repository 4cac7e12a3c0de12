"""Orders, roundings and scalar fields."""

import math

import pytest
from pyspark.sql import functions as F

from fractus.functions import axes, fields


def test_orders(spark):
    df = spark.createDataFrame([(1, 2, 3, "k")], "a int, b int, c int, k string")
    zyx = axes.to_zyx(df, ("a", "b", "c"), "XYZ").first()
    assert (zyx.z, zyx.y, zyx.x, zyx.k) == (3, 2, 1, "k")
    back = axes.from_zyx(axes.to_zyx(df, ("a", "b", "c"), "xyz"), ("a", "b", "c"), "xyz").select("a", "b", "c").first()
    assert tuple(back) == (1, 2, 3)
    assert tuple(axes.to_zyx(df, ("a", "b", "c"), "zyx").select("z", "y", "x").first()) == (1, 2, 3)
    assert axes.sampling_zyx((1, 2, 3)) == (3, 2, 1) and axes.sampling_zyx((1, 2, 3), "zyx") == (1, 2, 3)
    for call in (lambda: axes.checked("yxz"), lambda: axes.sampling_zyx((1, 2, 3), "x"), lambda: axes.to_zyx(df, ("a", "b", "c"), "no")):
        with pytest.raises(ValueError):
            call()


def test_rounding(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (2.4,)], "v double").select(axes.rounded(F.col("v")), axes.half_up(F.col("v"))).collect()
    assert [r[0] for r in rows] == [0, 2, 2, 0, 2] and [r[1] for r in rows] == [1, 2, 3, 0, 2]


def test_fields(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, 1.0), (10.0, 10.5), (5.0, 1.0), (inf, 2.0), (2.0, inf), (inf, inf)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    out = df.select(fields.relative_difference(a, b).alias("rd"), fields.in_band(a, b).alias("band"), fields.label_of(fields.in_band(a, b), a, b).alias("label"), fields.discounted(a, b).alias("d")).collect()
    assert [r.label for r in out] == [1, 1, 2, 2, 1, 1]
    assert [r.band for r in out] == [True, True, False, False, False, False]
    assert out[2].rd == pytest.approx(4 / 6) and out[0].d == pytest.approx(1 / (1 + 2 * math.exp(-1)))
    dn = spark.createDataFrame([(0.0, 2.0), (1.0, 2.0), (2.0, 2.0), (inf, inf), (0.0, 0.0)], "d double, m double").select(fields.normalised(F.col("d"), F.col("m")).alias("n")).collect()
    assert [r.n for r in dn] == [0.0, 0.5, 1.0, 1.0, 0.0]
    cost = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "n double").select(fields.travel_cost(F.col("n")).alias("c"), fields.ridge_cost(F.col("n")).alias("r")).collect()
    assert cost[0].c == pytest.approx(1e6) and cost[1].c == pytest.approx(0.5**-1.6) and cost[2].c == 1.0
    assert cost[0].r == pytest.approx(1e6) and cost[1].r == pytest.approx(1 / (1e-6 + 0.25))
