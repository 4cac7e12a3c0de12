"""Structured Streaming: fragments that arrive in parts are held until the last one is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans.splitters import Splitter
from ..sources.volumes import VOXEL
from .splits import split_stream

#: Voxels (z, y, x) of one of ``n_parts`` parts of a fragment, numbered from 0.
PART = "sv_id long, part int, n_parts int, z int, y int, x int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gathering(StatefulProcessor):
    """Keeps the parts of a fragment as packed coordinates, one entry each, and gives them out when all have come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getListState("cells", "cells binary")
        self.seen = handle.getMapState("seen", "part int", "here boolean")
        self.given = handle.getValueState("given", "whole boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.given.exists():  # a part that came again
            return
        fresh, n_parts = set(), 0
        for some in rows:
            n_parts = int(some["n_parts"].iloc[0])
            for part, own in some.groupby("part"):
                if part in fresh or not self.seen.containsKey((int(part),)):
                    fresh.add(part)
                    self.cells.appendValue((own[["z", "y", "x"]].to_numpy(np.int32).tobytes(),))
        for part in fresh:
            self.seen.updateValue((int(part),), (True,))
        if sum(1 for _ in self.seen.keys()) < n_parts:
            return
        for (packed,) in self.cells.get():
            at = np.frombuffer(packed, np.int32).reshape(-1, 3)
            yield pd.DataFrame({"sv_id": key[0], "z": at[:, 0], "y": at[:, 1], "x": at[:, 2]})
        self.cells.clear()
        self.seen.clear()
        self.given.update((True,))

    def close(self) -> None:
        pass


def whole_fragments(parts: DataFrame) -> DataFrame:
    """Voxels (sv_id, z, y, x) of each fragment of a stream of ``parts`` (rows PART), in the micro-batch of its last part.

    A part must come within one micro-batch: write each to a file, which a file
    source never splits. A part that comes again later is passed over, also when
    its fragment was given out. Open parts lie in the state store (RocksDB), so
    they survive restarts and lost executors, and a task holds one part at a time;
    of a fragment given out a single flag stays. ``n_parts`` must be the same in
    all rows of a fragment.
    """
    parts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    known = parts.where("sv_id IS NOT NULL AND part IS NOT NULL").select(*(c.split()[0] for c in PART.split(", ")))
    return known.groupBy("sv_id").transformWithStateInPandas(Gathering(), VOXEL, "append", "none")


def split_parts(parts: DataFrame, seeds: Callable[[], DataFrame], volumes: Callable[[], DataFrame], splitter: Splitter, path: str, checkpoint: str) -> StreamingQuery:
    """:func:`split_stream` of fragments that arrive in parts: each is split once, when it is whole."""
    return split_stream(whole_fragments(parts), seeds, volumes, splitter, path, checkpoint)


def part_stream(spark, path: str, files_at_once: int | None = None) -> DataFrame:
    """Parts from files that arrive in a folder."""
    reader = spark.readStream.schema(PART)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)
