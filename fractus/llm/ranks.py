"""Places of rows within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Bits of the row number that monotonically_increasing_id keeps for the row within its partition.
LOW = 33


def in_order(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` written in the order of ``by`` (nulls first) over range partitions, with seq (partition and row within it).

    Equal rows are told apart by where they were read, so that a large group of
    them is spread over partitions too; which of them comes first has no effect
    on what is computed from their columns. ``rows`` should be a written table,
    as the ranges are sampled from it first.
    """
    order = [F.col(c).asc_nulls_first() for c in by] + [F.col("tie")]
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    return materialize(spread.sortWithinPartitions(*order).drop("tie").withColumn("seq", F.monotonically_increasing_id()), name)


def runs(ordered: DataFrame, group: list[str]) -> DataFrame:
    """A row for each partition and group of :func:`in_order`: first (its least seq), before (rows of the group in earlier partitions) and total (rows of the group).

    There are as many rows as groups and partitions together.
    """
    pieces = ordered.groupBy(F.shiftright("seq", LOW).alias("part"), *group).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy(*group)
    earlier = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("part", *group, "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(of_group).alias("total"))


def placed(ordered: DataFrame, of_runs: DataFrame, group: list[str], place: str = "place") -> DataFrame:
    """``ordered`` with the place of each row in its group, from 0, and the further columns of ``of_runs``."""
    named = of_runs.select("part", *(F.col(c).alias(f"{c}_run") for c in group), "first", "before", *(c for c in of_runs.columns if c not in {"part", "first", "before", *group}))
    same = F.shiftright("seq", LOW) == named["part"]
    for c in group:
        same = same & ordered[c].eqNullSafe(named[f"{c}_run"])
    met = ordered.join(named, same)
    return met.withColumn(place, F.col("seq") - F.col("first") + F.col("before")).drop("part", "first", "before", "seq", *(f"{c}_run" for c in group))
