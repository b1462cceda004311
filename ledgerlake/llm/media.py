"""Operator 6: media columns in archives, read through a custom Spark data source.

A payload is stored losslessly as the samples of an 8-bit grayscale PNG of WIDTH columns. Images are the members of archive
files: members one after another, then a directory with offset, length, checksum and identity of each, then a fixed
trailer. The writer makes one archive or more in each task; only archives that the job's commit lists are seen.

The reader plans byte ranges over the archives. A task reads the directory of its archive, takes the members that
begin in its range, and streams their payloads in Arrow batches of bounded size. A member that cannot be read, or does not
match its checksum, is tried again by itself, from its offset in a newly opened file; after ATTEMPTS tries the row
gets an error in place of a payload and the others go on.

A payload is padded with bytes 32 up to a positive multiple of WIDTH, so a null or empty one is a row of blanks; its true
length is in the directory. Null ids stay null; repeated rows are members of their own with equal values. Columns besides
the id and the payload are not stored. An empty table makes no archives.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ledgerlake.llm.common import documents, open_store, read_manifest, shared_dir, write_manifest

WIDTH = 192
ARCHIVE_BYTES = 128 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
LEVEL = 1
_PNG = b"\x89PNG\r\n\x1a\n"
_MAGIC = b"MEDIADIR"
_TAIL = struct.Struct("<QQI8s")
#: id, whether there is one, offset, length, unpadded length, checksum
_ENTRY = np.dtype([("id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("length", "<u8"), ("n_bytes", "<u8"), ("crc", "<u4")])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(payload: bytes) -> bytes:
    return payload + b" " * (-len(payload) % WIDTH if payload else WIDTH)


def to_png(samples: bytes) -> bytes:
    """A grayscale image of WIDTH columns; each row is stored as it is (filter 0)."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, LEVEL)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png() made; ValueError where it is damaged or of another kind."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, width, height, data = 8, 0, 0, []
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, color, *_, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, color, interlaced) != (8, 0, 0):
                raise ValueError("not 8-bit grayscale")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Sixteen-bin histogram shares, mean and deviation, and the mean step between neighbours, as 20 hex bytes."""
    values = np.frombuffer(samples, np.uint8)
    shares = np.bincount(values >> 4, minlength=16) * 255 // len(values)
    steps = np.abs(np.diff(values.astype(np.int16))) if len(values) > 1 else np.zeros(1)
    rest = [int(values.mean()), int(values.std()), min(255, int(steps.mean())), int((steps == 0).mean() * 255)]
    return bytes([*shares.tolist(), *rest]).hex()


@dataclass
class _Written(WriterCommitMessage):
    entries: list


class _Archive:
    def __init__(self, folder: str):
        self.name, self.at, self.entries = f"{uuid.uuid4().hex}.media", 0, []
        store, path = open_store(f"{folder}/{self.name}")
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)

    def add(self, key: int | None, image: bytes, n_bytes: int) -> None:
        self.out.write(image)
        self.entries.append((key or 0, key is not None, self.at, len(image), n_bytes, zlib.crc32(image)))
        self.at += len(image)

    def close(self) -> dict:
        directory = np.array(self.entries, _ENTRY).tobytes()
        self.out.write(directory)
        self.out.write(_TAIL.pack(self.at, len(self.entries), zlib.crc32(directory), _MAGIC))
        self.out.close()
        return {"file": self.name, "bytes": self.at}


class _MediaWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        archive, done = None, []
        for batch in iterator:
            for key, payload in zip(batch.column("id").to_pylist(), batch.column("payload"), strict=True):
                archive = archive or _Archive(self.path)
                raw = payload.as_py() or b""
                archive.add(key, to_png(padded(raw)), len(raw))
                if archive.at >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        return _Written(done)

    def commit(self, messages: list) -> None:
        write_manifest(self.path, [e for m in messages if m is not None for e in m.entries])

    def abort(self, messages: list) -> None:
        """Nothing to undo: readers see the archives of a manifest only."""


@dataclass
class _Range(InputPartition):
    uri: str
    start: int
    end: int


def directory(uri: str) -> np.ndarray:
    """The directory of an archive, by offset."""
    store, path = open_store(uri)
    with store.open_input_file(path) as src:
        size = src.size()
        src.seek(size - _TAIL.size)
        at, _, crc, magic = _TAIL.unpack(src.read(_TAIL.size))
        src.seek(at)
        data = src.read(size - _TAIL.size - at)
    if magic != _MAGIC or zlib.crc32(data) != crc:
        raise OSError(f"not a whole archive: {uri}")
    return np.frombuffer(data, _ENTRY)


def _at(uri: str, offset: int, length: int) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as src:
        src.seek(offset)
        return src.read(length)


def member(uri: str, entry: np.void, first: bytes | None, fetch: Callable[[str, int, int], bytes] = _at, wait: float = 0.1) -> tuple[bytes | None, bytes | None, str | None]:
    """(image, samples, error) of one member. first: its bytes as already read; each further try reads it alone."""
    error = None
    for attempt in range(ATTEMPTS):
        try:
            image = first if attempt == 0 and first is not None else fetch(uri, int(entry["offset"]), int(entry["length"]))
            if len(image) != entry["length"] or zlib.crc32(image) != entry["crc"]:
                raise ValueError("checksum differs")
            return image, from_png(image), None
        except (OSError, ValueError, zlib.error) as e:
            error = f"{type(e).__name__}: {e}"
            if attempt + 1 < ATTEMPTS:
                time.sleep(wait * 2**attempt)
    return None, None, error


class _MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        return [
            _Range(f"{self.path}/{e['file']}", at, min(at + self.range, e["bytes"]))
            for e in read_manifest(self.path)
            for at in range(0, e["bytes"], self.range)
        ] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator:
        import pyarrow as pa

        if not partition.uri:
            return
        entries = directory(partition.uri)
        mine = entries[(entries["offset"] >= partition.start) & (entries["offset"] < partition.end)]
        names, types = zip(("id", pa.int64()), ("n_bytes", pa.int64()), ("image", pa.binary()), ("payload", pa.binary()), ("error", pa.string()), strict=True)
        at = 0
        while at < len(mine):
            # one read for the members of a batch, which lie side by side
            last = max(at + 1, int(np.searchsorted(mine["offset"] + mine["length"], int(mine["offset"][at]) + BATCH_BYTES, "right")))
            start = int(mine["offset"][at])
            end = int(mine["offset"][last - 1] + mine["length"][last - 1])
            try:
                data = _at(partition.uri, start, end - start)
            except OSError:
                data = None
            rows = []
            for e in mine[at:last]:
                own = None if data is None else data[int(e["offset"]) - start : int(e["offset"] + e["length"]) - start]
                image, samples, error = member(partition.uri, e, own)
                rows.append((int(e["id"]) if e["known"] else None, int(e["n_bytes"]), image, samples, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            at = last


class MediaArchives(DataSource):
    """spark.read / df.write .format("media_archives"); the writer takes id and payload."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "id long, n_bytes long, image binary, payload binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _MediaReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _MediaWriter(self.options)


def write_media(rows: DataFrame, path: str) -> None:
    """Writes rows(id long, payload binary) as archives below path, one task's rows in its own archives."""
    rows.sparkSession.dataSource.register(MediaArchives)
    rows.select("id", "payload").write.format("media_archives").mode("append").save(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """id, n_bytes, the stored image, its samples as payload, and an error where a member could not be read."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(path)


def with_feature(media: DataFrame) -> DataFrame:
    """media(id, n_bytes, image, payload, error) with digests and features in place of the bytes."""

    def digest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made = []
            for image, payload in zip(batch.column("image"), batch.column("payload"), strict=True):
                i, p = image.as_py(), payload.as_py()
                if p is None:
                    made.append((None,) * 6)
                else:
                    made.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(i), hashlib.sha256(i).hexdigest(), feature(p)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)] if made else [pa.array([], t) for t in kinds]
            names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *columns, batch.column("error")], names=names)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return media.mapInArrow(digest, schema)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "media")
    docs = documents(spark, sf_dir, "doc_id", "text")
    write_media(docs.select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload")), path)
    return with_feature(read_media(spark, path)).withColumnRenamed("id", "doc_id")


QUERIES = {"op6_media": op6_media}
ORACLES: dict[str, str] = {}
