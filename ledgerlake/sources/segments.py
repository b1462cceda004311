"""A ledger of segments: records are appended under the head that the writer saw, and the first of two writers wins."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.operators.ledger import leaf, merkle_root


class HeadMoved(Exception):
    """Another writer has appended since the head was read."""


class Ledger:
    """Segments of records in a folder, each committed by one small file that names its parent.

    Commits are numbered, and one is made by creating the file of the next number, which fails where it exists: of two writers with the same head one
    gets in, the other reads the new head and tries again. A segment's records are written before that, in a folder of their own, so a
    writer that dies leaves files that no commit names. Nothing is ever changed or deleted.

    A segment has a root over its records, and a commit's hash is over its parent's hash and that root, so a changed record, segment or order
    shows. Roots are taken in two steps: over the records of each part, then over the parts, so no task holds more than a part.
    """

    PART = 4096

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/") if "://" in uri else f"file://{uri.rstrip('/')}"
        self.store, self.path = fs.FileSystem.from_uri(self.uri)
        self.store.create_dir(f"{self.path}/commits", recursive=True)

    def _commit_path(self, number: int) -> str:
        return f"{self.path}/commits/{number:012d}.json"

    def commits(self) -> list[dict]:
        """All commits in order: number, parent, root, hash, segment, records."""
        names = sorted(i.path for i in self.store.get_file_info(fs.FileSelector(f"{self.path}/commits")) if i.path.endswith(".json"))
        found = []
        for name in names:
            with self.store.open_input_stream(name) as f:
                found.append(json.loads(f.read()))
        return found

    def head(self) -> tuple[int, str]:
        """(number, hash) of the last commit; (0, "") of an empty ledger."""
        last = self.commits()[-1:]
        return (last[0]["number"], last[0]["hash"]) if last else (0, "")

    def _numbered(self, records: DataFrame, order: list[str]) -> DataFrame:
        """records with seq, 0.. in the given order: places inside ranges, then the ranges' sums before them."""
        ranged = records.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
        ranged = self.spark.read.parquet(self._written(ranged))
        sizes = sorted(ranged.groupBy("__range").count().collect())  # a number for each range
        starts, before = [], 0
        for r, n in sizes:
            starts.append((r, before))
            before += n
        place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
        ahead = F.broadcast(self.spark.createDataFrame(starts, "__range int, __before long"))
        return ranged.withColumn("__place", place).join(ahead, "__range").withColumn("seq", F.col("__before") + F.col("__place")).drop("__range", "__place", "__before")

    def _written(self, df: DataFrame) -> str:
        path = f"{self.uri}/segments/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    @classmethod
    def root(cls, segment: DataFrame) -> str:
        """The root of a segment's records, in the order of seq."""
        columns = sorted(c for c in segment.columns if c != "seq")
        text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        parts = segment.select(F.floor(F.col("seq") / cls.PART).alias("part"), F.struct("seq", leaf(text).alias("h")).alias("x"))
        roots = parts.groupBy("part").agg(merkle_root(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"])).alias("h"))
        # a number for each part of PART records; levels above are parts of parts
        level = roots
        while level.count() > cls.PART:
            up = level.select(F.floor(F.col("part") / cls.PART).alias("part"), F.struct("part", "h").alias("x"))
            level = up.groupBy("part").agg(merkle_root(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"])).alias("h"))
        top = level.agg(merkle_root(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])).alias("h")).first()
        return top["h"] or ""

    def append(self, records: DataFrame, order: list[str], expected: str, segment: str | None = None) -> str:
        """Appends the records in the given order if the head still is the expected one, and returns the new head; else HeadMoved.

        segment is one that an earlier try wrote, to spare writing it again.
        """
        number, hash_ = self.head()
        if hash_ != expected:
            raise HeadMoved(hash_)
        segment = segment or self._written(self._numbered(records, order))
        rows = self.spark.read.parquet(segment)
        root = self.root(rows)
        own = self._hash(expected, root)
        commit = {"number": number + 1, "parent": expected, "root": root, "hash": own, "segment": segment.rpartition("/")[2], "records": rows.count()}
        if not self._create(self._commit_path(number + 1), json.dumps(commit).encode()):
            raise HeadMoved(segment)
        return own

    def append_retrying(self, records: DataFrame, order: list[str], tries: int = 10) -> str:
        """Appends under whatever head there is; a writer that loses reads the head again."""
        segment = self._written(self._numbered(records, order))
        for _ in range(tries):
            try:
                return self.append(records, order, self.head()[1], segment)
            except HeadMoved:
                continue
        raise HeadMoved(f"{tries} tries")

    def _hash(self, parent: str, root: str) -> str:
        return hashlib.sha256(f"{parent}\n{root}".encode()).hexdigest()

    def _create(self, path: str, data: bytes) -> bool:
        """Creates a file that must not exist, as Hadoop's file systems do it for any store; False where it does."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.uri}/commits/{path.rpartition('/')[2]}")
        store = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = store.create(target, False)
        except Exception as e:  # noqa: BLE001  the class of the JVM's exception tells which
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(data)
        out.close()
        return True

    def read(self) -> DataFrame:
        """All records with commit and seq, those of committed segments only."""
        parts = [self.spark.read.parquet(f"{self.uri}/segments/{c['segment']}").withColumn("commit", F.lit(c["number"])) for c in self.commits()]
        if not parts:
            raise ValueError("the ledger is empty")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def broken(self) -> list[int]:
        """The commits whose root, link, hash or number does not hold."""
        found, parent = [], ""
        for place, c in enumerate(self.commits(), 1):
            root = self.root(self.spark.read.parquet(f"{self.uri}/segments/{c['segment']}"))
            if (c["number"], c["parent"], c["root"], c["hash"]) != (place, parent, root, self._hash(parent, root)):
                found.append(c["number"])
            parent = c["hash"]
        return found
