"""Places that the driver and all executors share, and tables that cut lineage there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    On a cluster the setting names a store that every executor sees. Only where
    it is unset (tests in one JVM) a local folder is chosen and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fractus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/fractus/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table survives lost executors and, unlike a cached RDD, later
    reads prune its columns.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that only tables written by now were made of."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows and bytes (as JSON, which is longer than Spark's rows are) of a table that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def fits(df: DataFrame) -> bool:
    """If a table may be broadcast: its rows and bytes, counted now, are within the limits."""
    some = df.limit(BROADCAST_ROWS + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("bytes"))
    rows, size = some.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if it :func:`fits`; otherwise a shuffle joins it."""
    return F.broadcast(df) if fits(df) else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for work columns that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
        taken.add(name)
    return out


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
