"""Helpers that several training-data operators share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, or the given columns of it."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


#: Temporary folders of local sessions without a checkpoint folder, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder, as a URI, below the one in spark.checkpoint.dir.

    Where that setting is missing, the folder set by setCheckpointDir() is used, and on a local master (tests, a laptop) a temporary
    one. On a cluster without either this is a ValueError: executors on other hosts could not see a local folder.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _LOCAL.get(context.applicationId)
    if not root:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if root.startswith("/"):
        root = f"file://{root}"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs a reread."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() would also fold other alphabets."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df holds at most so many rows; reads no further than one row beyond."""
    return df.limit(rows + 1).count() <= rows


# Files that tasks read and write themselves go through Arrow's filesystems, so a URI of any store works.


def open_store(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    store, path = open_store(uri)
    with store.open_output_stream(path) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_stream(path) as src:
        return src.read()


def make_dir(uri: str) -> None:
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)


MANIFEST = "manifest.json"


def write_manifest(uri: str, files: list[dict]) -> None:
    """The list of committed files. Files that it does not name are leftovers of failed attempts."""
    make_dir(uri)
    write_bytes(f"{uri}/{MANIFEST}", json.dumps(files).encode())


def read_manifest(uri: str) -> list[dict]:
    return json.loads(read_bytes(f"{uri}/{MANIFEST}"))


#: For counterparts in DuckDB, which has no crc32: its 256 steps as a list, and the fold of a text's bytes, given in hex, over it.
CRC32_STEPS_SQL = """SELECT list(c ORDER BY i) AS step FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))"""


def crc32_sql(h: str) -> str:
    """The unsigned crc32 of the bytes in column h, beside a row of CRC32_STEPS_SQL."""
    octets = f"list_transform(range(0, len({h}), 2), lambda i: ('0x' || {h}[i + 1:i + 2])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295)"
