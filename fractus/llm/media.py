"""Media columns in archives (operator 6): a data source that plans byte ranges and reads members by offset.

An archive is a file of members one after another, then a directory (one fixed
record for each member) and a footer that says where the directory starts.
Writers roll archives at a size, so a directory is small; a manifest lists the
archives that a job committed. The reader plans one partition for each range of
bytes of an archive from the manifest alone; a partition reads the directory of
its archive and the members that start in its range, each checked against its
checksum and fetched again on its own, by offset, if the check fails.

Payloads here are texts as 8-bit samples in greyscale PNG images 64 wide.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .batches import bounded, slices
from .storage import shared_dir

MAGIC = b"MARC0001"
RECORD = np.dtype([("given", "u1"), ("doc_id", "<i8"), ("n_bytes", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("crc", "<u4")])
FOOTER = struct.Struct("<QQI8s")
WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, media binary"


# --- the image format ---------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of the image's width."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def decode_png(image: bytes) -> np.ndarray:
    """Samples of an image that :func:`encode_png` made, line by line."""
    if image[:8] != PNG:
        raise ValueError("not a PNG image")
    at, data, shape = 8, [], (0, 0)
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale without interlacing")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("only lines without a filter")
    return np.ascontiguousarray(lines[:, 1:]).reshape(-1)


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy of the samples and mean step between neighbours."""
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float((counts * values).sum()) / len(samples)
    spread = float((counts * (values - mean) ** 2).sum() / len(samples)) ** 0.5
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    return f"mean={mean:.4f};sd={spread:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};step={step:.4f}"


# --- archives -----------------------------------------------------------------


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return pafs.FileSystem.from_uri(path if urlparse(path).scheme else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


class ArchiveWriter(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own; only committed ones enter the manifest."""

    def __init__(self, path: str, roll_bytes: int):
        self.path, self.roll = path, roll_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _store(self.path)
        fs.create_dir(base, recursive=True)
        done: list[tuple[str, int]] = []
        out, name, at, records = None, "", 0, []

        def close() -> None:
            nonlocal out, at
            table = np.array(records, RECORD).tobytes()
            out.write(table + FOOTER.pack(at, len(records), zlib.crc32(table), MAGIC))
            out.close()
            done.append((name, at + len(table) + FOOTER.size))
            records.clear()
            out, at = None, 0

        for batch in iterator:
            ids, sizes, media = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "n_bytes", "media"))
            for doc, n, member in zip(ids.to_pylist(), sizes.to_pylist(), media):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.marc"
                    out = fs.open_output_stream(f"{base}/{name}")
                body = member.as_buffer()
                out.write(body)
                records.append((doc is not None, doc or 0, n, at, body.size, zlib.crc32(body)))
                at += body.size
                if at >= self.roll:
                    close()
        if out is not None:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _store(self.path)
        fs.create_dir(base, recursive=True)
        names = [a for m in messages if m for a in m.archives]
        with fs.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _store(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                fs.delete_file(f"{base}/{name}")


@dataclass
class ByteRange(InputPartition):
    archive: str
    size: int
    low: int
    high: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, batch_bytes: int):
        self.path, self.range, self.batch = path, range_bytes, batch_bytes

    def partitions(self) -> list[ByteRange]:
        fs, base = _store(self.path)
        listed = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        out = []
        for info in listed:
            if info.base_name.startswith("manifest-"):
                with fs.open_input_stream(info.path) as f:
                    for name, size in json.loads(f.readall()):
                        out += [ByteRange(name, size, low, min(low + self.range, size)) for low in range(0, size, self.range)]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, base = _store(self.path)
        file = f"{base}/{partition.archive}"

        def fetch(offset: int, size: int) -> bytes:
            with fs.open_input_file(file) as f:
                return f.read_at(size, offset)

        start, count, crc, magic = FOOTER.unpack(fetch(partition.size - FOOTER.size, FOOTER.size))
        table = fetch(start, count * RECORD.itemsize)
        if magic != MAGIC or zlib.crc32(table) != crc:
            raise ValueError(f"{partition.archive}: damaged directory")
        records = np.frombuffer(table, RECORD)
        records = records[(records["offset"] >= partition.low) & (records["offset"] < partition.high)]
        at = 0
        while at < len(records):
            # As many members as fit a batch, in one read; at least one.
            ends = records["offset"][at:] + records["size"][at:]
            n = max(1, int(np.searchsorted(ends, records["offset"][at] + self.batch, "right")))
            some = records[at : at + n]
            low = int(some["offset"][0])
            block = fetch(low, int(ends[n - 1]) - low)
            members = []
            for r in some:
                begin = int(r["offset"]) - low
                member = block[begin : begin + int(r["size"])]
                members.append(member if zlib.crc32(member) == r["crc"] else self._again(fetch, r, partition.archive))
            yield pa.RecordBatch.from_arrays([pa.array(some["doc_id"], pa.int64(), mask=some["given"] == 0), pa.array(some["n_bytes"], pa.int64()), pa.array(members, pa.binary())], ["doc_id", "n_bytes", "media"])
            at += n

    @staticmethod
    def _again(fetch, record: np.void, archive: str, attempts: int = 3) -> bytes:
        """One member on its own, by offset."""
        for k in range(attempts):
            member = fetch(int(record["offset"]), int(record["size"]))
            if zlib.crc32(member) == record["crc"]:
                return member
            time.sleep(0.1 * 2**k)
        raise OSError(f"{archive}: member at {record['offset']} is damaged")


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(path)`` and ``df.write.format("media_archive").save(path)``.

    Options: ``roll_bytes`` (size at which a writer begins a new archive),
    ``range_bytes`` (bytes of a read partition), ``batch_bytes`` (of an Arrow
    batch; one larger member is a batch of its own).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", 8 << 20)), int(self.options.get("batch_bytes", 4 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("roll_bytes", 64 << 20)))


# --- the operator -------------------------------------------------------------


def media_of(docs: DataFrame) -> DataFrame:
    """Texts as images: doc_id, n_bytes (of UTF-8, before padding), media."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1):
            raw = [b"" if not t.is_valid else t.as_buffer().to_pybytes() for t in some.column(1)]
            images = [encode_png(pad(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """Decode each image and describe its samples."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [part.split()[0] for part in schema.split(", ")]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(2):
                image = cell.as_buffer().to_pybytes()
                samples = decode_png(image)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return media.mapInArrow(describe, schema)


def media_columns(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store the texts of ``docs`` (doc_id, text) as media below ``path`` (default: the shared folder), read them back and describe them.

    Null and empty texts are one line of zeros. Rows that repeat an id are
    members of their own; a null id stays null; other columns are ignored; an
    empty table gives no member.
    """
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchive)
    path = path or shared_dir(spark, "media")
    media_of(docs).write.format("media_archive").mode("append").save(path)
    return media_features(spark.read.format("media_archive").load(path))
