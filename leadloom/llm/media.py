"""Media columns: payloads in archives, read back by a Spark data source.

Writing: each task appends members to archives of bounded size in one directory and
reports them; the commit writes a manifest that names finished archives only, so a lost
or repeated task leaves nothing that is read.  An archive is a run of members followed
by an index of (offset, length) pairs and the index's place.  A member is a header
(magic, key, payload length, checksum) and the stored form.

Reading: the planner cuts each archive of the manifest into byte ranges; a partition
owns the members that begin inside its range, and yields them as Arrow batches.  A
member that fails to read or verify is tried again on its own, at its own offset.

The stored form is a grey 8-bit PNG image, SAMPLES_PER_ROW wide: one byte, one sample.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .store import new_path

SAMPLES_PER_ROW = 576
PAD = 255
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 256 << 20, 16 << 20, 4 << 20
RETRIES = 4
MANIFEST = "manifest.json"
SCHEMA = "key long, payload_bytes long, media binary"

_HEAD = struct.Struct("<4sqBqqI")  # magic, key, key is null, payload length, media length, checksum
_PLACE = struct.Struct("<qq")
_PNG = b"\x89PNG\r\n\x1a\n"


def to_payload(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length, and its bytes padded to a positive multiple of the row."""
    data = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(data) // SAMPLES_PER_ROW))
    return len(data), data.ljust(rows * SAMPLES_PER_ROW, bytes([PAD]))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    rows = len(payload) // SAMPLES_PER_ROW
    lines = np.zeros((rows, SAMPLES_PER_ROW + 1), dtype=np.uint8)  # the first byte of a line: no filter
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, SAMPLES_PER_ROW)
    head = struct.pack(">IIBBBBB", SAMPLES_PER_ROW, rows, 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that :func:`to_png` has written; damage raises ValueError."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, data, size = 8, b"", None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(size[1], size[0] + 1)
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean and deviation of the samples, and a difference hash of 8 x 8 cell means."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    cells = np.array([part.mean() if len(part) else 0.0 for part in np.array_split(samples, 72)]).reshape(8, 9)
    bits = (cells[:, 1:] > cells[:, :-1]).ravel()
    return f"{samples.mean():.4f}/{samples.std():.4f}/{int(''.join('01'[int(b)] for b in bits), 2):016x}"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


@dataclass
class _Written(WriterCommitMessage):
    archives: list[tuple[str, int, int]]  # name, bytes of members, members


class _ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = _filesystem(self.path)
        system.create_dir(folder, recursive=True)
        done: list[tuple[str, int, int]] = []
        name, stream, places, at = "", None, [], 0

        def close() -> None:
            stream.write(b"".join(_PLACE.pack(*p) for p in places) + _PLACE.pack(at, len(places)))
            stream.close()
            done.append((name, at, len(places)))

        for batch in iterator:
            for key, size, media in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    name, places, at = f"part-{uuid.uuid4().hex}.arc", [], 0
                    stream = system.open_output_stream(f"{folder}/{name}")
                data = _HEAD.pack(b"MEM1", key or 0, key is None, size or 0, len(media), zlib.crc32(media)) + media
                stream.write(data)
                places.append((at, len(data)))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    close()
                    stream = None
        if stream is not None:
            close()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = _filesystem(self.path)
        system.create_dir(folder, recursive=True)
        archives = sorted(a for m in messages if m for a in m.archives)
        with system.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"archives": archives}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = _filesystem(self.path)
        for m in messages:
            for name, _, _ in m.archives if m else ():
                system.delete_file(f"{folder}/{name}")


class Range(InputPartition):
    """The members that begin at bytes [start, end) of an archive."""

    def __init__(self, path: str, size: int, count: int, start: int, end: int):
        self.path, self.size, self.count, self.start, self.end = path, size, count, start, end


def read_member(system: pafs.FileSystem, path: str, offset: int, length: int, retries: int = RETRIES, wait: float = 0.2) -> tuple[int | None, int, bytes]:
    """One member by its offset; each try opens the archive anew."""
    for attempt in range(retries):
        try:
            with system.open_input_file(path) as file:
                return _parse(file.read_at(length, offset))
        except (OSError, ValueError, struct.error):
            if attempt + 1 == retries:
                raise
            time.sleep(wait * 2**attempt)
    raise ValueError("retries must be positive")


def _parse(data: bytes) -> tuple[int | None, int, bytes]:
    magic, key, null, size, length, checksum = _HEAD.unpack_from(data)
    media = bytes(data[_HEAD.size : _HEAD.size + length])
    if magic != b"MEM1" or len(media) != length or zlib.crc32(media) != checksum:
        raise ValueError("damaged member")
    return (None if null else key), size, media


class _ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        system, folder = _filesystem(self.path)
        with system.open_input_file(f"{folder}/{MANIFEST}") as file:
            archives = json.loads(file.read())["archives"]
        return [
            Range(f"{folder}/{name}", size, count, start, min(size, start + self.range_bytes))
            for name, size, count in archives
            for start in range(0, size, self.range_bytes)
        ] or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = _filesystem(self.path)
        with system.open_input_file(partition.path) as file:
            index = np.frombuffer(file.read_at(_PLACE.size * partition.count, partition.size), dtype="<i8").reshape(-1, 2)
        own = index[(index[:, 0] >= partition.start) & (index[:, 0] < partition.end)]
        members: list[tuple[int | None, int, bytes]] = []
        size = 0
        for at in range(0, len(own), 256):
            part = own[at : at + 256].tolist()
            try:
                with system.open_input_file(partition.path) as file:
                    first = part[0][0]
                    block = file.read_at(part[-1][0] + part[-1][1] - first, first)
            except OSError:
                block = b""
            for offset, length in part:
                try:
                    member = _parse(block[offset - first : offset - first + length]) if block else read_member(system, partition.path, offset, length)
                except (ValueError, struct.error):
                    member = read_member(system, partition.path, offset, length)
                members.append(member)
                size += length
                if size >= BATCH_BYTES:
                    yield _batch(members)
                    members, size = [], 0
        if members:
            yield _batch(members)


def _batch(members: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([m[0] for m in members], pa.int64()), pa.array([m[1] for m in members], pa.int64()), pa.array([m[2] for m in members], pa.binary())],
        names=["key", "payload_bytes", "media"],
    )


class MediaArchive(DataSource):
    """``format("media_archive")``: key, payload_bytes, media; option range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MediaArchive)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            payloads = [to_payload(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([n for n, _ in payloads], pa.int64()), pa.array([to_png(p) for _, p in payloads], pa.binary())],
                names=["key", "payload_bytes", "media"],
            )


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for key, size, media in zip(*(c.to_pylist() for c in batch.columns)):
            payload = from_png(media)
            row = (key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload))
            for column, value in zip(columns, row):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def store_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each text as a media member under its id into the archives of ``path``."""
    register(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_stored, SCHEMA)
    rows.write.format("media_archive").mode("append").save(path)


def read_media(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("media_archive").option("range_bytes", range_bytes).load(path)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts, read them back, and describe payload and stored form.

    n_bytes is the unpadded length; digests are of what was read.  A null text is an
    empty one (one row of padding); null ids and repeated rows are members of their own.
    Other columns are not read.
    """
    spark = docs.sparkSession
    path = new_path(spark, "media")
    store_texts(docs, path, id_col, text_col)
    return read_media(spark, path).mapInArrow(
        _described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
