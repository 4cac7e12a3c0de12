"""Arrow batches bounded by bytes, so that a run of long texts doesn't fill a task."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of the batches that Spark sends to Python and takes from it; a longer row is sent alone.
SENT = 4 << 20
#: Bytes of text that a task takes at once; a longer text is taken alone.
BYTES = 2 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose setting for the bytes of an Arrow batch is at most ``SENT``."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    said = re.fullmatch(r"(-?\d+)([kmgt]?)b?", conf.get(name).lower())
    now = int(said[1]) << 10 * " kmgt".index(said[2] or " ") if said else -1
    if not 0 < now <= SENT:
        conf.set(name, str(SENT))
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str | int, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of at most ``most`` bytes of one string or binary column, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(ends):
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(low, high - low)
            low = high
    pa.default_memory_pool().release_unused()  # the worker stays for other tasks
