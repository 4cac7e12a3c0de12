"""Token-id files with Re-Pair grammar compression (operator 2).

Documents are sorted by id over the whole table and their ids cut into shards of
whole documents. Each shard is one self-contained block: rounds of Re-Pair
replace the most frequent adjacent pairs by nonterminals until none is frequent;
rules, the expansion length of every nonterminal and a sampled table of expansion
offsets are stored, so that any token range is decoded without the rest of the
shard. Blocks are
rows of Parquet files in a folder that the caller names; a manifest beside them
has the number of tokens before each partition.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import bounded, slices
from .storage import partitions, shared_dir
from .tokens import END_ID, default_vocabulary, encoder

MAGIC = b"RPG2"
#: Ids from here up are nonterminals.
TERMINALS = 50_257
#: Symbols between two entries of the table of expansion offsets.
SAMPLE = 1024
#: The count that the first rounds ask of a pair.
FREQUENT = 64


# --- the grammar of one shard -------------------------------------------------


def _adjacent(seq: np.ndarray) -> np.ndarray:
    """Each symbol and the next as one number, of twice the symbols' width."""
    half = 8 * seq.itemsize
    keys = seq[:-1].astype(np.uint32 if half == 16 else np.uint64)
    keys <<= keys.dtype.type(half)
    keys |= seq[1:]
    return keys


def _slots(keys: np.ndarray) -> np.ndarray:
    if keys.dtype == np.uint64:
        keys = (keys ^ (keys >> np.uint64(29))).astype(np.uint32)
    return (keys * np.uint32(2654435761)) >> np.uint32(16)


def _replace(seq: np.ndarray, keys: np.ndarray, pairs: np.ndarray, first: int) -> np.ndarray:
    """Replace occurrences of the pairs (of which no two share a slot), leftmost first, by ids from ``first`` up."""
    table = np.zeros(1 << 16, np.uint16)
    table[_slots(pairs)] = np.arange(1, len(pairs) + 1)
    at = np.flatnonzero(np.take(table, _slots(keys)))
    found = keys[at]
    code = table[_slots(found)]
    same = pairs[code.astype(np.int64) - 1] == found
    at, code = at[same], code[same]
    if not len(at):
        return seq
    head = np.r_[True, np.diff(at) != 1]
    every = (at - at[head][np.cumsum(head) - 1]) % 2 == 0  # of overlapping occurrences every other one
    at, code = at[every], code[every]
    out = seq.copy()
    out[at] = code.astype(seq.dtype) + seq.dtype.type(first - 1)
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return out[keep]


def compress(ids: np.ndarray, rounds: int | None, min_count: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Symbols, rules (pairs of symbols) and the number of rules of each round.

    Rounds go on until no pair occurs ``min_count`` times, unless ``rounds``
    limits them. The count asked of pairs falls from ``FREQUENT`` by quarters
    whenever no pair has it, so that frequent ones get their ids first. Symbols
    take 16 bits until their ids run out, and 32 from then on.
    """
    seq, rules, sizes, at, asked = ids.astype(np.uint16), [], [], TERMINALS, max(min_count, FREQUENT)
    while (rounds is None or len(sizes) < rounds) and len(seq) > 1:
        beside = _adjacent(seq)
        keys = np.sort(beside)
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[new, len(keys)])
        most = int(counts.max())
        if most < min_count:
            break
        while most < asked:
            asked = max(min_count, asked // 4)
        often = counts >= asked
        pairs, counts = keys[new][often], counts[often]
        pairs = pairs[np.argsort(-counts, kind="stable")]
        # One pair for each slot of the lookup table: the most frequent one; the others' turn comes next.
        pairs = pairs[np.sort(np.unique(_slots(pairs), return_index=True)[1])]
        half = 8 * seq.itemsize
        rules.append(np.stack([pairs >> pairs.dtype.type(half), pairs & pairs.dtype.type((1 << half) - 1)], 1).astype(np.uint32))
        if at + len(pairs) > 1 << 16 and half == 16:
            seq, beside = seq.astype(np.uint32), _wide(beside)
            pairs = _wide(pairs)
            pairs = pairs[np.sort(np.unique(_slots(pairs), return_index=True)[1])]
            rules[-1] = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        seq = _replace(seq, beside, pairs, at)
        sizes.append(len(pairs))
        at += len(pairs)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), sizes


def _wide(keys: np.ndarray) -> np.ndarray:
    """Pairs of 16-bit symbols as pairs of 32-bit ones."""
    return (keys.astype(np.uint64) >> np.uint64(16) << np.uint64(32)) | (keys & np.uint32(0xFFFF))


def planes(symbols: np.ndarray, extra: int) -> bytes:
    """Symbols as their low 16 bits, and ``extra`` planes of one bit each for what is above."""
    wide = symbols.astype(np.uint32)
    return b"".join([(wide & 0xFFFF).astype("<u2").tobytes(), *(np.packbits((wide >> (16 + b)) & 1 > 0).tobytes() for b in range(extra))])


def expansion_lengths(rules: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Terminals below each nonterminal; a rule only refers to rules of earlier rounds."""
    lengths, low = np.ones(len(rules), np.uint32), 0
    for size in sizes:
        of = rules[low : low + size].astype(np.int64) - TERMINALS
        lengths[low : low + size] = np.where(of >= 0, lengths[np.maximum(of, 0)], 1).sum(1)
        low += size
    return lengths


def expand(seq: np.ndarray, rules: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Terminals of a run of symbols, undoing the rounds from the last to the first."""
    high = TERMINALS + len(rules)
    for size in reversed(sizes):
        low = high - size
        at = np.flatnonzero(seq >= low)  # later rounds are undone already
        if len(at):
            pairs = rules[seq[at].astype(np.int64) - TERMINALS]
            right = at + np.arange(1, len(at) + 1)
            out = np.empty(len(seq) + len(at), seq.dtype)
            single = np.ones(len(out), bool)
            single[right] = False
            out[single] = seq
            out[right - 1], out[right] = pairs[:, 0], pairs[:, 1]
            seq = out
        high = low
    return seq


def pack_shard(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, rounds: int | None, min_count: int) -> bytes:
    """Header, documents, rules, expansion lengths, sampled offsets, symbols."""
    seq, rules, sizes = compress(ids, rounds, min_count)
    lengths = expansion_lengths(rules, sizes)
    each = np.ones(len(seq), np.int64)
    deep = seq >= TERMINALS
    each[deep] = lengths[seq[deep].astype(np.int64) - TERMINALS]
    offsets = np.r_[0, np.cumsum(each)][:-1][::SAMPLE].astype(np.uint32)
    extra = max(0, (TERMINALS + len(rules) - 1).bit_length() - 16)
    head = struct.pack("<4sIIIIII", MAGIC, len(doc_ids), len(ids), len(seq), len(sizes), len(offsets), extra)
    parts = [np.array(sizes, "<u4"), doc_ids.astype("<i8"), counts.astype("<u4"), lengths.astype("<u4"), offsets.astype("<u4")]
    body = head + b"".join(p.tobytes() for p in parts) + planes(rules.reshape(-1), extra) + planes(seq, extra)
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A block read back: documents and random access to token ranges."""

    def __init__(self, block: bytes):
        magic, docs, tokens, symbols, rounds, samples, extra = struct.unpack_from("<4sIIIIII", block)
        if magic != MAGIC or zlib.crc32(memoryview(block)[:-4]) != struct.unpack_from("<I", block, len(block) - 4)[0]:
            raise ValueError("not a token shard, or damaged")
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(block, kind, n, at)
            at += out.nbytes
            return out

        def take_planes(n: int) -> np.ndarray:
            out = take("<u2", n)
            if extra:
                out = out.astype(np.uint32)
                for b in range(extra):
                    out |= np.unpackbits(take("u1", -(-n // 8)), count=n).astype(np.uint32) << np.uint32(16 + b)
            return out

        self.tokens, self.sizes = tokens, take("<u4", rounds).tolist()
        n = sum(self.sizes)
        self.doc_ids, self.counts = take("<i8", docs), take("<u4", docs)
        self.lengths, self.offsets = take("<u4", n), take("<u4", samples)
        self.rules = take_planes(2 * n).reshape(-1, 2)
        self.symbols = take_planes(symbols)

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.sizes)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop), decoding only the symbols between the sampled offsets around them."""
        if stop <= start:
            return np.zeros(0, np.uint16)
        low = max(0, int(np.searchsorted(self.offsets, start, "right")) - 1)
        high = int(np.searchsorted(self.offsets, stop, "left"))
        part = expand(self.symbols[low * SAMPLE : high * SAMPLE], self.rules, self.sizes)
        base = int(self.offsets[low])
        return part[start - base : stop - base]


# --- tables -------------------------------------------------------------------


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, shard_tokens: int = 1 << 19, rounds: int | None = None, min_count: int = 5) -> None:
    """Encode ``docs`` (doc_id, text) and write shards in ascending order of doc_id below ``path``.

    Null and empty texts are documents of the end id alone; rows that repeat an
    id are documents of their own, in order of their text; rows without an id
    come first. Other columns are ignored. An empty table gives no shard.
    A task holds one shard's ids (2 bytes each) and one batch of texts. A rule
    takes 8 bytes and saves 2 with every replacement, so that pairs are frequent
    from ``min_count`` = 5 on.
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(vocabulary), TaskContext.get().partitionId()
        ids: list[int | None] = []
        sizes: list[int] = []
        coded: list[np.ndarray] = []
        held = shard = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, shard, before
            flat = np.concatenate(coded)
            given = np.array([x is not None for x in ids], np.uint8)
            block = pack_shard(np.array([x or 0 for x in ids], np.int64), np.array(sizes, np.int64), flat, rounds, min_count)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int64()), "before": pa.array([before], pa.int64()), "n_tokens": pa.array([len(flat)], pa.int64()), "given": pa.array([None if given.all() else given.tobytes()], pa.binary()), "block": pa.array([block], pa.binary())})
            before, shard, held = before + len(flat), shard + 1, 0
            for x in (ids, sizes, coded):
                x.clear()
            return row

        for some in slices(batches, "text"):
            flat, ends = coder.encode(some.column(1).to_pylist())
            flat = np.insert(flat, ends, END_ID)  # the end id behind each document
            ends = ends + np.arange(1, len(ends) + 1)
            docs, counts, first = some.column(0).to_pylist(), np.diff(np.r_[0, ends]), 0
            while first < len(docs):
                # Whole documents until the shard is full; at least one.
                begin = int(ends[first - 1]) if first else 0
                last = min(len(docs), int(np.searchsorted(ends, begin + shard_tokens - held, "left")) + 1)
                ids += docs[first:last]
                sizes += counts[first:last].tolist()
                coded.append(flat[begin : ends[last - 1]])
                held += int(ends[last - 1]) - begin
                first = last
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    out = bounded(ordered).mapInArrow(shards, "part int, shard long, before long, n_tokens long, given binary, block binary")
    out.write.parquet(f"{path}/shards")
    # One row for each partition: a running total over at most as many rows as there are tasks.
    totals = spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    base = totals.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("base"))
    base.coalesce(1).write.parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) decoded from the files: ``start`` counts the ids of all documents before."""
    shards = spark.read.parquet(f"{path}/shards")
    # The manifest has one row for each writing task, so it is small whatever the corpus.
    joined = shards.join(F.broadcast(spark.read.parquet(f"{path}/manifest")), "part").select((F.col("base") + F.col("before")).alias("start"), "given", "block")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["block"])
                counts = shard.counts.astype(np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(shard.all().astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                absent = None if row["given"] is None else np.frombuffer(row["given"], np.uint8) == 0
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64(), mask=absent), pa.array(row["start"] + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return joined.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, **options: object) -> DataFrame:
    """Write the files (below the shared folder unless ``path`` is given) and return what they hold."""
    path = path or shared_dir(docs.sparkSession, "tokens")
    write_token_files(docs, path, **options)  # type: ignore[arg-type]
    return read_token_files(docs.sparkSession, path)
