"""Structured Streaming: fragments are split as their rows arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.splitters import Splitter
from ..sources.volumes import VOXEL


def split_stream(arrivals: DataFrame, seeds: Callable[[], DataFrame], volumes: Callable[[], DataFrame], splitter: Splitter, path: str, checkpoint: str) -> StreamingQuery:
    """Split each micro-batch of whole fragments (rows of voxels) and write labels below ``path``.

    Each batch writes a folder of its own, overwritten if the batch is run
    again, so a restart neither loses nor doubles labels. Seeds and volumes are
    read anew for every batch.
    """

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        ids = batch.select("sv_id").distinct()
        mine = lambda df: df.join(ids, "sv_id", "left_semi")
        splitter.split(batch, mine(seeds()), mine(volumes())).labels.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def voxel_stream(spark, path: str) -> DataFrame:
    """Voxels from files that arrive in a folder."""
    return spark.readStream.schema(VOXEL).parquet(path)
