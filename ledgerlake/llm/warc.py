"""Operator 4: WARC archives with segmented records, and their reassembly.

The writer makes one record for each row: an HTTP response head and the payload in chunked transfer framing. A block
longer than segment_bytes is cut: the first part is the record itself with WARC-Segment-Number 1, the others are
continuation records that name it in WARC-Segment-Origin-ID, the last one also with WARC-Segment-Total-Length. Every
record is a gzip member of its own, as usual for .warc.gz files. Of rows with equal payloads of at least
min_revisit bytes the largest id is a response; the others are revisits without a payload.

The reader plans byte ranges of the archives. A record belongs to the range in which its gzip member begins. Records of
one segment are decoded where they are read; continuations are grouped by origin, ordered by segment number, held
against the total length and the row of numbers, and then decoded. Segments of a record may lie in any archive.
A record that misses a segment, has a wrong length or breaks its framing gets an error and no payload. A gzip member that is damaged or
cut short, and a record whose head is broken, become a row with an error alone, and reading goes on at the next member that holds
a record.

Null payloads are empty ones. Null urls are written as "about:blank". Ids are written as they are; rows with a null id
get none, and equal payloads without any id are all responses. Rows that repeat the largest id of equal payloads are
all responses. An empty table makes no archives.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ledgerlake.llm.common import open_store, read_manifest, shared_dir, small_enough, write_manifest, written

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
MIN_REVISIT = 1000
RANGE_BYTES = 16 << 20
BROADCAST_ROWS = 50_000
#: Compressed bytes handed to zlib at once.
STEP = 32 << 10
#: Bytes after which an archive is closed and the next begun.
ARCHIVE_BYTES = 256 << 20
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].partition(b";")[0], 16)
        at = end + 2
        if size == 0:
            if body[at : at + 2] != b"\r\n" and b"\r\n\r\n" not in body[at:]:  # a blank line, or trailers and a blank line
                raise ValueError("cut after the last chunk")
            return b"".join(parts)
        if size < 0:
            raise ValueError("broken chunk")
        part = body[at : at + size]
        if len(part) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        parts.append(part)
        at += size + 2


def record(fields: dict[str, str | int | None], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    return (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class _Written(WriterCommitMessage):
    entries: list


class _WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.segment = options["path"], int(options.get("segment_bytes", SEGMENT_BYTES))

    def records(self, row: dict) -> Iterator[bytes]:
        key = "" if row["id"] is None else str(row["id"])
        own = f"<urn:uuid:{uuid.uuid4()}>"  # rows may repeat an id, records may not; a task's attempt that is not committed is not read
        fields = {"WARC-Record-ID": own, "WARC-Date": _DATE, "WARC-Target-URI": _uri(row["url"]), "WARC-Payload-Digest": f"sha1:{row['digest']}", "Content-Type": "application/http;msgtype=response", "X-Archive-Key": key or None}
        payload = row["payload"] or b""
        if row["refers_to"] is not None:
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["n_bytes"]
            yield record({"WARC-Type": "revisit"} | fields | {"WARC-Profile": _PROFILE, "WARC-Refers-To-Target-URI": _uri(row["refers_to_url"]), "WARC-Refers-To-Date": _DATE, "X-Archive-Refers-To-Key": row["refers_to"]}, head)
            return
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
        if len(block) <= self.segment:
            yield record({"WARC-Type": "response"} | fields, block)
            return
        for n, at in enumerate(range(0, len(block), self.segment), 1):
            part, last = block[at : at + self.segment], at + self.segment >= len(block)
            numbered = {"WARC-Segment-Number": n, "WARC-Segment-Total-Length": len(block) if last else None}
            if n == 1:
                yield record({"WARC-Type": "response"} | fields | numbered, part)
            else:
                yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": _DATE, "WARC-Segment-Origin-ID": own} | numbered, part)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        entries, out, size, name = [], None, 0, ""
        for batch in iterator:
            for row in batch.to_pylist():
                for data in self.records(row):
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        store, path = open_store(f"{self.path}/{name}")
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    data = _gzip(data)
                    out.write(data)
                    size += len(data)
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                        entries.append({"file": name, "bytes": size})
        if out is not None:
            out.close()
            entries.append({"file": name, "bytes": size})
        return _Written(entries)

    def commit(self, messages: list) -> None:
        write_manifest(self.path, [e for m in messages if m is not None for e in m.entries])

    def abort(self, messages: list) -> None:
        """Nothing to undo: readers see the archives of a manifest only."""


@dataclass
class _Range(InputPartition):
    uri: str
    start: int
    end: int


_MAGIC = b"\x1f\x8b\x08"


def members(uri: str, start: int, end: int) -> Iterator[tuple[bytes, str | None]]:
    """(content, error) of the gzip members that begin in [start, end). A range that begins inside a member, and one that goes on
    after a damaged member, skips to the next that holds a WARC record; the bytes of the magic number may also occur inside a member."""
    store, path = open_store(uri)
    with store.open_input_file(path) as src:
        size = src.size()
        src.seek(start)
        data, at, base = src.read(min(RANGE_BYTES, size - start)), 0, start

        def more() -> bool:
            nonlocal data, at, base
            base, data, at = base + at, data[at:], 0
            src.seek(base + len(data))
            read = src.read(RANGE_BYTES)
            data += read
            return bool(read)

        def begins() -> bool:
            while len(data) - at < 4096 and more():
                pass
            try:
                return zlib.decompressobj(31).decompress(data[at : at + 4096], 9) == b"WARC/1.1\r"
            except zlib.error:
                return False

        def skip() -> bool:
            """Moves on to the next member that holds a record; False where none begins in the range."""
            nonlocal at
            while not begins():
                found = data.find(_MAGIC, at + 1)
                if found < 0:
                    at = max(at, len(data) - len(_MAGIC) + 1)
                    if not more():
                        return False
                else:
                    at = found
                if base + at >= end:
                    return False
            return True

        if start and not skip():
            return
        while base + at < end:
            first = base + at
            z, parts, error = zlib.decompressobj(31), [], None
            while not z.eof and error is None:
                if at >= len(data) and not more():
                    if first == base + at:
                        return
                    error = "the member is cut short"
                    break
                piece = data[at : at + STEP]
                try:
                    parts.append(z.decompress(piece))
                    at += len(piece) - len(z.unused_data)
                except zlib.error as e:
                    error = str(e)
            if error is None:
                yield b"".join(parts), None
                continue
            yield b"", f"{uri} at {first}: {error}"
            # look again from right behind the member's first byte; what was read past may hold the next one
            src.seek(first + 1)
            base, at = first + 1, 0
            data = src.read(RANGE_BYTES)
            if not data or base >= end or not skip():
                return


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields by lower-case name and the block; ValueError where the head is broken or the block is not whole."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"WARC/"):
        raise ValueError("no head of a record")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    for name, least, bits in (("content-length", 0, 63), ("warc-segment-number", 1, 31), ("warc-segment-total-length", 0, 63), ("x-archive-key", -(1 << 63), 63), ("x-archive-refers-to-key", -(1 << 63), 63)):
        if name in fields and not fields[name].removeprefix("-").isdecimal():
            raise ValueError(f"{name} is no number")
        if name in fields and not (len(fields[name]) <= 20 and least <= int(fields[name]) < 1 << bits):
            raise ValueError(f"{name} is out of range")
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("the block is cut short")
    return fields, rest[:n]


class _WarcReader(DataSourceReader):
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
        names = ["record_type", "record_id", "key", "origin_id", "segment", "total_length", "digest", "refers_to", "block", "error"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        rows, held = [], 0
        number = lambda v: None if v is None else int(v)
        for data, error in members(partition.uri, partition.start, partition.end):
            try:
                if error is not None:
                    raise ValueError(error)
                f, block = parse_record(data)
            except ValueError as e:
                rows.append((*[None] * 9, str(e)))
                continue
            rows.append((f["warc-type"], f["warc-record-id"], number(f.get("x-archive-key")), f.get("warc-segment-origin-id"), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, number(f.get("x-archive-refers-to-key")), block, None))
            held += len(block)
            if held >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class WarcArchives(DataSource):
    """spark.read / df.write .format("warc_archives"); the writer takes id, url, payload, digest, n_bytes, refers_to, refers_to_url."""

    @classmethod
    def name(cls) -> str:
        return "warc_archives"

    def schema(self) -> str:
        return "record_type string, record_id string, key long, origin_id string, segment int, total_length long, digest string, refers_to long, block binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _WarcWriter(self.options)


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_revisit: int = MIN_REVISIT) -> None:
    """Writes pages(id long, url string, payload binary) as archives below path.

    Copies are found from digests and ids alone; the payloads are not shuffled while the copied digests are at most
    BROADCAST_ROWS.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcArchives)
    full = pages.select("id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    full = full.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    large = full.filter(F.col("n_bytes") >= min_revisit).select("digest", "id", "url")
    copied = written(large.groupBy("digest").agg(F.max("id").alias("first"), F.max_by("url", "id").alias("refers_to_url"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n"), "warc-copies")
    side = F.broadcast(copied) if small_enough(copied, BROADCAST_ROWS) else copied
    marked = full.join(side, "digest", "left")
    refers = F.when((F.col("n_bytes") >= min_revisit) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    marked = marked.withColumn("refers_to", refers)
    payload = F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload")
    marked.select("id", "url", payload, "digest", "n_bytes", "refers_to", "refers_to_url").write.format("warc_archives").option("segment_bytes", segment_bytes).mode("append").save(path)


def _assembled(cut: DataFrame) -> DataFrame:
    """cut(..., parts array<binary>, error) with the parts joined to a block, none where there is an error."""

    def join(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            blocks = [None if e is not None else b"".join(p.as_py()) for p, e in zip(batch.column("parts"), batch.column("error").to_pylist(), strict=True)]
            kept = [batch.column(c) for c in ("key", "record_type", "digest", "refers_to")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(blocks, pa.binary()), batch.column("error")], names=["key", "record_type", "digest", "refers_to", "block", "error"])

    return cut.mapInArrow(join, "key long, record_type string, digest string, refers_to long, block binary, error string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(key, record_type, digest, refers_to, block, error): whole records, continuations put together."""
    spark.dataSource.register(WarcArchives)
    parts = spark.read.format("warc_archives").load(path)
    whole = parts.filter("segment IS NULL").select("key", "record_type", "digest", "refers_to", "block", "error")
    cut = parts.filter("segment IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))
    piece = F.struct("segment", "block", "total_length", "key", "record_type", "digest", "refers_to")
    grouped = cut.groupBy("origin").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    numbers = F.transform("pieces", lambda p: p["segment"])
    total = F.col("pieces")[F.size("pieces") - 1]["total_length"]
    length = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    error = (
        F.when(~numbers.eqNullSafe(F.sequence(F.lit(1), F.size("pieces"))), "a segment is missing or repeated")
        .when(total.isNull(), "the last segment is missing")
        .when(total != length, "the total length is wrong")
    )
    head = F.col("pieces")[0]
    found = grouped.select(
        head["key"].alias("key"), head["record_type"].alias("record_type"), head["digest"].alias("digest"), head["refers_to"].alias("refers_to"),
        F.transform("pieces", lambda p: p["block"]).alias("parts"), error.alias("error"),
    )
    return whole.unionByName(_assembled(found))


def payloads(records: DataFrame) -> DataFrame:
    """records with payload (binary) and n_bytes decoded from their HTTP message; a revisit has n_bytes from its head.

    Only responses and revisits hold such a message; the block of any other record is its payload as it is.
    """

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            bodies, lengths, errors = [], [], []
            for block, kind, error in zip(batch.column("block"), batch.column("record_type").to_pylist(), batch.column("error").to_pylist(), strict=True):
                body = length = None
                if (raw := block.as_py()) is not None and kind not in ("response", "revisit"):
                    body, length = raw, len(raw)
                elif raw is not None:
                    head, _, rest = raw.partition(b"\r\n\r\n")
                    try:
                        if b"transfer-encoding: chunked" in head.lower():
                            body = dechunked(rest)
                            length = len(body)
                        else:
                            told = next((line for line in head.lower().split(b"\r\n") if line.startswith(b"content-length:")), None)
                            if told is None or not told[15:].strip().isdigit() or len(told) > 40 or int(told[15:]) >= 1 << 63:
                                raise ValueError("no length of the content")
                            length = int(told[15:])
                            if kind == "response":
                                if len(rest) != length:
                                    raise ValueError("the content has another length")
                                body = rest
                    except ValueError as e:
                        error, body, length = f"broken message: {e}", None, None
                bodies.append(body)
                lengths.append(length)
                errors.append(error)
            columns = [batch.column(c) for c in ("key", "record_type", "digest", "refers_to")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bodies, pa.binary()), pa.array(lengths, pa.int64()), pa.array(errors, pa.string())], names=["key", "record_type", "digest", "refers_to", "payload", "n_bytes", "error"])

    return records.mapInArrow(decode, "key long, record_type string, digest string, refers_to long, payload binary, n_bytes long, error string")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_dir(spark, "warc")
    write_warc(pages.select(F.col("page_id").alias("id"), "url", F.encode("html", "UTF-8").alias("payload")), path)
    read = payloads(read_warc(spark, path))
    digest = F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("digest"))
    return read.select(
        F.col("key").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "error"
    )


_ORACLE = """
WITH full_pages AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
sized AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM full_pages),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to,
       CAST(NULL AS VARCHAR) AS error
FROM ranked
"""

QUERIES = {"op4_warc": op4_warc}
ORACLES = {"op4_warc": _ORACLE}
