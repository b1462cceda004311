"""Operator 1: token-id files of patched frame-of-reference blocks.

A file holds the ids of a run of documents in ascending doc_id order, cut into blocks of 1,024 ids. A block
subtracts its minimum and packs the rest at a width taken from the percentiles of its values, whichever of
them gives the shortest block; values that do not fit keep their low bits in the packed part and put their
high bits and positions into the block's exception list. The footer has the start of every block and of every
document, so any document can be read without unpacking the file before it.

Layout, all little-endian::

    "PFOR0001"
    block*   : minimum u32, width u8, exceptions u16, packed words (width x 32) u32,
               positions (exceptions) u16, high bits (exceptions) u32
    footer   : block starts u64, doc_ids i64, doc starts u64, doc lengths u32
    trailer  : blocks u64, documents u64, ids u64, footer start u64, footer crc32 u32, "PFOR0001"

A task writes its documents into files of at most about FILE_IDS ids, and the manifest names, every RANGE_IDS ids, a document at which
reading may begin; so files stay small and a reader's tasks are even, however many tasks wrote.

Null and empty texts have the end id only. Documents with a null doc_id come first. Documents that share a doc_id
follow one another in the order of their texts. An empty table gives no files and no rows. Other columns are
not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ledgerlake.llm.common import documents, open_store, read_manifest, shared_dir, write_manifest
from ledgerlake.llm.encoding import encoder, vocabulary

MAGIC = b"PFOR0001"
BLOCK = 1024
LANES = 32
PERCENTILES = (75.0, 90.0, 95.0, 99.0, 100.0)
_HEAD = struct.Struct("<IBH")
_TAIL = struct.Struct("<QQQQI8s")
#: Blocks that are packed or unpacked together.
GROUP = 256
NO_ID = -(1 << 63)
FILE_IDS = 128 << 20
RANGE_IDS = 8 << 20


def _bit_length(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width to rows of width x LANES words."""
    rows = values.reshape(len(values), BLOCK // LANES, LANES)
    out = np.zeros((len(values), width, LANES), "<u4")
    for j in range(BLOCK // LANES):
        word, shift = divmod(j * width, 32)
        out[:, word] |= rows[:, j] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= rows[:, j] >> np.uint32(32 - shift)
    return out.reshape(len(values), width * LANES)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack()."""
    rows = words.reshape(len(words), width, LANES)
    out = np.zeros((len(words), BLOCK // LANES, LANES), "<u4")
    if width:
        mask = np.uint32((1 << width) - 1)
        for j in range(BLOCK // LANES):
            word, shift = divmod(j * width, 32)
            value = rows[:, word] >> np.uint32(shift)
            if shift + width > 32:
                value = value | (rows[:, word + 1] << np.uint32(32 - shift))
            out[:, j] = value & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids; the last is filled up with its own minimum."""
    blocks = []
    for at in range(0, len(ids), BLOCK * GROUP):
        part = ids[at : at + BLOCK * GROUP]
        if short := -len(part) % BLOCK:
            part = np.concatenate([part, np.full(short, part[len(part) // BLOCK * BLOCK :].min(), "<u4")])
        part = part.reshape(-1, BLOCK)
        low = part.min(axis=1)
        rest = part - low[:, None]
        places = [min(BLOCK - 1, int(p / 100 * (BLOCK - 1) + 0.5)) for p in PERCENTILES]
        widths = _bit_length(np.partition(rest, places, axis=1)[:, places])
        over = np.stack([(rest >> np.minimum(w, 31).astype("<u4")[:, None] > 0).sum(axis=1) * (w < 32) for w in widths.T], axis=1)
        best = (widths * (LANES * 4) + over * 6).argmin(axis=1)
        width = widths[np.arange(len(best)), best]
        made: list[bytes] = [b""] * len(part)
        for w in np.unique(width):
            where = np.flatnonzero(width == w)
            own = rest[where]
            high = own >> np.uint32(w) if w < 32 else np.zeros_like(own)
            words = pack(own & np.uint32((1 << int(w)) - 1), int(w)) if w else np.zeros((len(where), 0), "<u4")
            row, position = np.nonzero(high)
            ends = np.searchsorted(row, np.arange(len(where) + 1))
            for k, b in enumerate(where):
                spot = position[ends[k] : ends[k + 1]]
                made[b] = b"".join((_HEAD.pack(int(low[b]), int(w), len(spot)), words[k].tobytes(), spot.astype("<u2").tobytes(), high[k, spot].astype("<u4").tobytes()))
        blocks += made
    return blocks


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The values of the blocks at these starts, whole."""
    out = np.empty((len(starts), BLOCK), "<u4")
    heads = [_HEAD.unpack_from(data, int(s)) for s in starts]
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width):
        where = np.flatnonzero(width == w)
        words = np.stack([np.frombuffer(data, "<u4", int(w) * LANES, int(starts[b]) + _HEAD.size) for b in where]) if w else np.zeros((len(where), 0), "<u4")
        out[where] = unpack(words, int(w))
    for b, (low, w, n) in enumerate(heads):
        if n:
            at = int(starts[b]) + _HEAD.size + w * LANES * 4
            spot = np.frombuffer(data, "<u2", n, at)
            out[b, spot] |= np.frombuffer(data, "<u4", n, at + 2 * n) << np.uint32(w)
        out[b] += np.uint32(low)
    return out.reshape(-1)


@dataclass
class _Written(WriterCommitMessage):
    entries: list[dict]


class _FileBuilder:
    """Writes one file as documents arrive; holds a group of blocks and the document index."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.buffer: list[bytes] = []
        self.held = 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        #: (document, ids before it) at which reading may begin.
        self.cuts: list[tuple[int, int]] = [(0, 0)]
        self.ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.ids - self.cuts[-1][1] >= RANGE_IDS:
            self.cuts.append((len(self.docs), self.ids))
        self.docs.append((NO_ID if doc_id is None else doc_id, self.ids, n))
        self.ids += n
        self.buffer.append(ids)
        self.held += n
        if self.held >= BLOCK * GROUP:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        values = np.frombuffer(b"".join(self.buffer), "<u4")
        cut = len(values) if all_of_it else len(values) // BLOCK * BLOCK
        for block in encode_blocks(values[:cut]):
            self.starts.append(self.at)
            self._put(block)
        self.buffer, self.held = [values[cut:].tobytes()], len(values) - cut

    def close(self) -> dict:
        if self.held:
            self._flush(True)
        docs = np.array(self.docs, np.int64).reshape(-1, 3)
        footer = b"".join((np.array(self.starts, "<u8").tobytes(), docs[:, 0].astype("<i8").tobytes(), docs[:, 1].astype("<u8").tobytes(), docs[:, 2].astype("<u4").tobytes()))
        at = self.at
        self._put(footer)
        self._put(_TAIL.pack(len(self.starts), len(docs), self.ids, at, zlib.crc32(footer), MAGIC))
        return {"documents": len(docs), "ids": self.ids, "bytes": self.at, "cuts": self.cuts}


class _TokenWriter(DataSourceArrowWriter):
    """Each task encodes its documents in order and writes files of its own names; commit lists the files."""

    def __init__(self, options: dict):
        self.path, self.tokenizer, self.end_id = options["path"], options["tokenizer"], int(options["end_id"])

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, end, run = TaskContext.get().partitionId(), np.array([self.end_id], "<u4").tobytes(), encoder(self.tokenizer)
        entries, builder, out, name = [], None, None, ""
        for batch in iterator:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if builder is None:
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.pfor"
                    store, path = open_store(f"{self.path}/{name}")
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path)
                    builder = _FileBuilder(out)
                builder.add(doc_id, run.ids(text.as_py()) + end)
                if builder.ids >= FILE_IDS:
                    entries.append(builder.close() | {"file": name, "place": [part, len(entries)]})
                    out.close()
                    builder = None
        if builder is not None:
            entries.append(builder.close() | {"file": name, "place": [part, len(entries)]})
            out.close()
        return _Written(entries)

    def commit(self, messages: list) -> None:
        write_manifest(self.path, sorted((e for m in messages if m is not None for e in m.entries), key=lambda e: e["place"]))

    def abort(self, messages: list) -> None:
        """Nothing to undo: readers see the files of a manifest only."""


@dataclass
class _Range(InputPartition):
    """Documents [begin, end) of a file; first is the number of ids in all files before it."""

    uri: str
    first: int
    begin: int
    end: int


class _TokenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        found, first = [], 0
        for e in read_manifest(self.path):
            begins = [d for d, _ in e["cuts"]]
            found += [_Range(f"{self.path}/{e['file']}", first, b, c) for b, c in zip(begins, [*begins[1:], e["documents"]], strict=True)]
            first += e["ids"]
        return found or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator:
        if not partition.uri:
            return
        import pyarrow as pa

        for docs, starts, lengths, values in read_file(partition.uri, partition.begin, partition.end):
            ends = np.cumsum(lengths)
            raw = values.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if d == NO_ID else int(d) for d in docs], pa.int64()),
                    pa.array(starts + partition.first, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([raw[4 * int(e - n) : 4 * int(e)] for e, n in zip(ends, lengths, strict=True)], pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_le32"],
            )


def read_file(uri: str, begin: int = 0, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, starts in the file, lengths and ids of successive runs of whole documents [begin, end) of about GROUP blocks."""
    store, path = open_store(uri)
    with store.open_input_file(path) as src:
        size = src.size()
        src.seek(size - _TAIL.size)
        blocks, n_docs, _, at, crc, magic = _TAIL.unpack(src.read(_TAIL.size))
        src.seek(at)
        footer = src.read(size - _TAIL.size - at)
        if magic != MAGIC or zlib.crc32(footer) != crc:
            raise OSError(f"not a whole token file: {uri}")
        block_at = np.append(np.frombuffer(footer, "<u8", blocks).astype(np.int64), at)
        docs = np.frombuffer(footer, "<i8", n_docs, 8 * blocks)
        starts = np.frombuffer(footer, "<u8", n_docs, 8 * (blocks + n_docs)).astype(np.int64)
        lengths = np.frombuffer(footer, "<u4", n_docs, 8 * (blocks + 2 * n_docs)).astype(np.int64)
        ends, d, stop = starts + lengths, begin, n_docs if end is None else end
        while d < stop:
            e = min(stop, max(d + 1, int(np.searchsorted(ends, starts[d] + BLOCK * GROUP, "right"))))
            b, c = starts[d] // BLOCK, -(-ends[e - 1] // BLOCK)
            src.seek(int(block_at[b]))
            values = decode_blocks(src.read(int(block_at[c] - block_at[b])), block_at[b:c] - block_at[b])
            yield docs[d:e], starts[d:e], lengths[d:e], values[starts[d] - b * BLOCK : ends[e - 1] - b * BLOCK]
            d = e


class TokenFiles(DataSource):
    """spark.read / df.write .format("token_files"); the writer takes doc_id and text."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_le32 binary"

    def reader(self, schema) -> DataSourceReader:
        return _TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _TokenWriter(self.options)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encodes docs(doc_id, text) and writes them below path in ascending doc_id order.

    The texts are dealt by ranges of doc_id, as many as spark.sql.shuffle.partitions says; each range is a file.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.write.format("token_files").option("tokenizer", tokenizer).option("end_id", end_id).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids as little-endian 32-bit bytes."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(path)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    write_tokens(documents(spark, sf_dir, "doc_id", "text"), path, vocabulary("byte_bpe_50k.json"), 2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le32").alias("ids_crc32"))


QUERIES = {"op1_token_files": op1_token_files}
ORACLES: dict[str, str] = {}
