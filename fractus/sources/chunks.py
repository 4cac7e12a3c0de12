"""Dense volumes stored in chunks: packed bits of small boxes, a row for each chunk that has foreground.

Chunks are rows of a Parquet table, so Spark plans the scan, prunes by fragment
and by chunk, and retries a lost task on its own; a task unpacks one chunk after
another and streams the voxels on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.axes import checked
from .volumes import VOXEL

#: Edge of a chunk in cells.
EDGE = 64
CHUNK = "sv_id long, cz int, cy int, cx int, edge int, layout string, cells binary"


def to_chunks(voxels: DataFrame, edge: int = EDGE, order: str = "zyx") -> DataFrame:
    """Rows CHUNK of foreground ``voxels``; within a chunk the bits are row-major in ``order``.

    A chunk's cells beyond the volume are background. Repeated voxels count once.
    """
    layout = checked(order)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        box = np.zeros((edge, edge, edge), bool)
        box[tuple(rows[a].to_numpy() % edge for a in layout)] = True
        first = rows.iloc[0]
        return pd.DataFrame([(first.sv_id, first.cz, first.cy, first.cx, edge, layout, np.packbits(box).tobytes())], columns=[f.split()[0] for f in CHUNK.split(", ")])

    placed = voxels.select("sv_id", *(F.col(a).cast("int").alias(a) for a in "zyx")).withColumns({f"c{a}": F.floor(F.col(a) / edge).cast("int") for a in "zyx"})
    return placed.groupBy("sv_id", "cz", "cy", "cx").applyInPandas(pack, CHUNK)


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Foreground voxels (sv_id, z, y, x) of rows CHUNK, one chunk in memory at a time."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["edge"]
                at = np.nonzero(np.unpackbits(np.frombuffer(row["cells"], np.uint8), count=n**3).reshape(n, n, n))
                place = {a: (v + row[f"c{a}"] * n).astype(np.int32) for a, v in zip(row["layout"], at)}
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at[0]), row["sv_id"], np.int64)), *(pa.array(place[a]) for a in "zyx")], ["sv_id", "z", "y", "x"])

    return chunks.select("sv_id", "cz", "cy", "cx", "edge", "layout", "cells").mapInArrow(unpack, VOXEL)


def write_chunks(voxels: DataFrame, path: str, edge: int = EDGE, order: str = "zyx") -> None:
    """Chunks as Parquet below ``path``, ordered by fragment and chunk within its files."""
    to_chunks(voxels, edge, order).sortWithinPartitions("sv_id", "cz", "cy", "cx").write.parquet(path)


def read_chunks(spark: SparkSession, path: str, fragments: list[int] | None = None) -> DataFrame:
    """Voxels of the chunks below ``path``; of some fragments alone, whose row groups are all that is read then."""
    chunks = spark.read.schema(CHUNK).parquet(path)
    return from_chunks(chunks if fragments is None else chunks.where(F.col("sv_id").isin(fragments)))


def array_chunks(spark: SparkSession, sv_id: int, mask: np.ndarray, edge: int = EDGE, order: str = "zyx") -> DataFrame:
    """Chunks of one dense mask in memory, its axes in ``order``; packed, an eighth of the mask's bytes leaves the caller."""
    if mask.ndim != 3:
        raise ValueError("a mask has three dimensions")
    layout = checked(order)
    rows = []
    for low in np.ndindex(*(-(-n // edge) for n in mask.shape)):
        box = mask[tuple(slice(k * edge, (k + 1) * edge) for k in low)].astype(bool)
        if box.any():
            full = np.zeros((edge, edge, edge), bool)
            full[tuple(slice(0, n) for n in box.shape)] = box
            at = dict(zip(layout, low))
            rows.append((sv_id, at["z"], at["y"], at["x"], edge, layout, np.packbits(full).tobytes()))
    return spark.createDataFrame(rows, CHUNK)
