"""Packing documents into fixed windows (operator 4): non-negative least squares over length combinations.

Whole windows of a document fill sequences of their own. The histogram of what
remains (at most 1023 lengths, whatever the corpus) goes to the driver. There
shallow combinations of two or three lengths that fill a window exactly are
enumerated, repeat counts are solved by non-negative least squares, rounded down
and clipped to the histogram. Remainders that the combinations leave over are
packed greedily, longest first, each window being filled before the next opens:
a remainder that crosses the end of a window is cut there. The last, partial
window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import bounded, slices
from .storage import materialize
from .tokens import END_ID, default_vocabulary, encoder


def combinations(histogram: np.ndarray, window: int, per_length: int = 24) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that add up to ``window``.

    All pairs are taken; of the triples, for each longest length the
    ``per_length`` whose scarcest member is most frequent (a bound on columns,
    not on documents).
    """
    have = np.flatnonzero(histogram[:window])
    have = have[have > 0]
    present = np.zeros(window + 1, bool)
    present[have] = True
    out: list[tuple[int, ...]] = [(int(a), int(window - a)) for a in have[have >= (window + 1) // 2] if present[window - a]]
    for a in have[have >= window // 3]:
        rest = window - int(a)
        b = have[(have <= a) & (have >= (rest + 1) // 2) & (have < rest)]
        b = b[present[rest - b]] if len(b) else b
        if len(b):
            scarce = np.minimum(histogram[b], histogram[rest - b])
            for x in b[np.argsort(-scarce, kind="stable")[:per_length]]:
                out.append((int(a), int(x), int(rest - x)))
    return out


def nnls(columns: list[tuple[int, ...]], histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Minimise ||Ax - h|| over x >= 0, A having a column of multiplicities for each combination.

    Accelerated projected gradient with restarts; A is kept as index lists.
    """
    if not columns:
        return np.zeros(0)
    size = len(histogram)
    col = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    row = np.array([r for c in columns for r in c])
    h = histogram.astype(float)
    # The largest eigenvalue is at most the largest row sum of A times that of its transpose.
    step = 1.0 / (3 * max(1, np.bincount(row, minlength=size).max()))
    x = y = np.zeros(len(columns))
    t, last = 1.0, np.inf
    for _ in range(steps):
        left = np.bincount(row, weights=y[col], minlength=size) - h
        grad = np.bincount(col, weights=left[row], minlength=len(columns))
        new = np.maximum(0, y - step * grad)
        value = float(left @ left)
        if value > last:
            t, y = 1.0, x
            last = np.inf
            continue
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t, last = new + (t - 1) / t2 * (new - x), new, t2, value
    return x


@dataclass
class Plan:
    """Where the k-th remainder of each length goes; its size depends on the window alone."""

    window: int
    #: By length: ascending first ranks of slots, and for each slot its first sequence and its offset there.
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: By length: the first rank that is packed greedily, and its place in the greedy stream.
    greedy: dict[int, tuple[int, int]]
    first_greedy: int
    stream: int
    n_sequences: int

    def greedy_pieces(self, at: int, length: int) -> list[tuple[int, int, int, int]]:
        """(offset in the remainder, length, sequence, offset there) of a remainder at a place of the stream."""
        out, done = [], 0
        whole = self.stream // self.window
        while done < length:
            seq, offset = divmod(at + done, self.window)
            size = self.window
            if seq == whole:  # the partial window, as powers of two from the largest
                rest, seq_at, offset_at = self.stream - whole * self.window, seq, offset
                while True:
                    size = 1 << (rest.bit_length() - 1)
                    if offset_at < size:
                        break
                    offset_at, rest, seq_at = offset_at - size, rest - size, seq_at + 1
                seq, offset = seq_at, offset_at
            n = min(length - done, size - offset)
            out.append((done, n, self.first_greedy + seq, offset))
            done += n
        return out


def plan(histogram: np.ndarray, window: int) -> Plan:
    columns = combinations(histogram, window)
    repeats = np.floor(nnls(columns, histogram) + 1e-6).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    seq = 0
    # Solved combinations first; a second pass takes what else fits exactly.
    for want in (repeats, None):
        for c, combo in enumerate(columns):
            lengths, times = np.unique(combo, return_counts=True)
            most = int((left[lengths] // times).min())
            n = min(most, int(want[c])) if want is not None else most
            if n <= 0:
                continue
            offset = 0
            for length in combo:
                slots.setdefault(length, []).append((int(used[length]), seq, offset))
                used[length] += n
                left[length] -= n
                offset += length
            seq += n
    greedy, at = {}, 0
    for length in np.flatnonzero(left)[::-1].tolist():
        if length:
            greedy[length] = (int(used[length]), at)
            at += length * int(left[length])
    tail = at % window
    arrays = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in slots.items()}
    return Plan(window, arrays, greedy, seq, at, seq + at // window + tail.bit_count())  # type: ignore[arg-type]


def pack(docs: DataFrame, window: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone; rows that repeat an
    id and rows without one are documents of their own (without an id, doc_id is
    null). Other columns are ignored; an empty table gives no piece.
    ``window`` is a power of two.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    vocabulary = vocabulary or default_vocabulary()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens once: checksums of whole windows, and the remainder's ids, which may be cut later."""
        coder, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        windows = 0
        for some in slices(batches, "text"):
            ids, ends = coder.encode(some.column(1).to_pylist())
            raw = np.insert(ids, ends, END_ID).tobytes()  # the end id behind each document
            ends = ends + np.arange(1, len(ends) + 1)
            counts = np.diff(np.r_[0, ends])
            cols: dict[str, list] = {k: [] for k in ("crcs", "rank", "windows", "tail")}
            for start, stop, n in zip((ends - counts).tolist(), ends.tolist(), counts.tolist()):
                whole, r = divmod(n, window)
                wide = np.frombuffer(raw, "<u2", whole * window, 2 * start).astype("<u4").tobytes() if whole else b""
                rank = seen.get(r, 0)
                seen[r] = rank + 1
                cols["crcs"].append([zlib.crc32(wide[4 * window * i : 4 * window * (i + 1)]) for i in range(whole)])
                cols["rank"].append(rank)
                cols["windows"].append(windows)
                cols["tail"].append(raw[2 * (start + whole * window) : 2 * stop])
                windows += whole
            kinds = (pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(v, t) for v, t in zip(cols.values(), kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(counts), pa.int32()), some.column(0), pa.array(counts), arrays[0], pa.array(counts % window, pa.int32()), *arrays[1:]], ["part", "doc_id", "n", "crcs", "r", "rank", "windows", "tail"])

    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kept = materialize(bounded(source).mapInArrow(measured, "part int, doc_id long, n long, crcs array<long>, r int, rank long, windows long, tail binary"), "pack")
    by_part = kept.groupBy("part", "r").agg(F.count("*").alias("docs"), F.sum(F.size("crcs")).alias("whole"))
    by_part = materialize(by_part, "pack-counts")
    histogram = np.zeros(window + 1, np.int64)
    for r, n in by_part.groupBy("r").agg(F.sum("docs")).collect():  # at most ``window`` rows
        histogram[r] = n
    histogram[0] = 0
    chosen = plan(histogram, window)
    # Ranks and whole windows before each task's rows: one row for each task and length.
    ranks = by_part.select("part", "r", (F.sum("docs").over(Window.partitionBy("r").orderBy("part")) - F.col("docs")).alias("rank_base"))
    totals = by_part.groupBy("part").agg(F.sum("whole").alias("whole"))
    totals = totals.select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("window_base"))
    placed = kept.join(ranks, ["part", "r"]).join(F.broadcast(totals), "part")  # totals: a row for each task
    placed = placed.select("doc_id", "n", "crcs", "r", (F.col("rank") + F.col("rank_base")).alias("rank"), (F.col("windows") + F.col("window_base")).alias("windows"), "tail")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                doc, n, r, rank = row["doc_id"], row["n"], row["r"], row["rank"]
                first = chosen.n_sequences + row["windows"]
                out += [(doc, i * window, window, crc, n, first + i, 0) for i, crc in enumerate(row["crcs"])]
                if not r:
                    continue
                start, tail = n - r, np.frombuffer(row["tail"], "<u2").astype("<u4").tobytes()
                greedy = chosen.greedy.get(r)
                if greedy and rank >= greedy[0]:
                    for at, length, seq, offset in chosen.greedy_pieces(greedy[1] + (rank - greedy[0]) * r, r):
                        out.append((doc, start + at, length, zlib.crc32(tail[4 * at : 4 * (at + length)]), n, seq, offset))
                else:
                    ranks_at, seqs, offsets = chosen.slots[r]
                    k = int(np.searchsorted(ranks_at, rank, "right")) - 1
                    out.append((doc, start, r, zlib.crc32(tail), n, int(seqs[k] + rank - ranks_at[k]), int(offsets[k])))
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return placed.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
