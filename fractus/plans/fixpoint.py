"""Loops over tables: written rounds that keep plans short and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; only under a local master one is chosen where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fractus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/fractus/table-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read from there: computed once, and pruned by later reads."""
    path = _shared(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def measured_joins(spark: SparkSession) -> None:
    """From now on this session's joins broadcast a side only by its measured size, under adaptive execution, or where a hint says so.

    The planner's estimate counts neither the rows that an explode adds nor what a
    packed file unpacks to, and adaptive execution keeps a broadcast that was planned
    by it: voxels of a small table went whole through the driver.
    """
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, spark.conf.get(static))
    spark.conf.set(static, "-1")


_local = threading.local()


@contextmanager
def keeping() -> Iterator[None]:
    """At its end the tables that were :func:`kept` within it are deleted; what is returned from it must be cut."""
    outer = getattr(_local, "kept", None)
    _local.kept = []
    try:
        yield
    finally:
        done, _local.kept = _local.kept, outer
        drop(*done)


def kept(df: DataFrame) -> DataFrame:
    """:func:`cut` for the steps of something larger."""
    out = cut(df)
    if getattr(_local, "kept", None) is not None:
        _local.kept.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete cut tables that only tables written by now were made of."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def star_components(edges: DataFrame, keys: tuple[str, ...] = ("sv_id",)) -> DataFrame:
    """Rows (*keys, node, comp): smallest node reached, for all nodes of ``edges`` (*keys, a, b).

    Alternating large and small stars; nodes without an edge have no row.
    """
    k = list(keys)
    edges = cut(edges.where("a <> b").select(*k, "a", "b").distinct())
    mark = None
    while True:
        # Edges are distinct: two exclusive ors of 64-bit hashes and the count tell sets of them apart.
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64(*k, "a", "b")), F.bit_xor(F.xxhash64("b", *k, F.lit(1), "a"))).first()
        if now[0] == 0 or now == mark:
            break
        mark, before = now, edges
        both = edges.unionByName(edges.select(*k, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*k, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, [*k, "a"]).select(*k, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(*k, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy(*k, "a").agg(F.min("b").alias("m"))
        moved = down.join(least, [*k, "a"]).where("b <> m").select(*k, F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.unionByName(least.select(*k, "a", F.col("m").alias("b"))).distinct())
        drop(before)
    tips = edges.select(*k, F.col("a").alias("node"), F.col("b").alias("comp"))
    return tips.unionByName(edges.select(*k, F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
