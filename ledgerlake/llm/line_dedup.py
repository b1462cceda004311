"""Operator 9: line deduplication over levelled sorted runs of line hashes.

Documents are taken in batches of descending doc_id, each of about BATCH_DOCS rows and never fewer than BATCHES of them. A batch's line keys are counted, merge-anti-joined with
the runs that earlier batches left, and written as a run of their own: keys that no run has carry the largest doc_id
holding them, keys met before add their count only. A run is bucketed and sorted by hash, so joins against it need
no new shuffle of the run. When a level has FANOUT runs they are compacted into one run of the next level, and
at the end all levels into one, from which the repeated keys are read.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least MIN_CHARS code
points found in at least MIN_DOCS documents lose all their lines except in the largest doc_id holding them. Keys are
compared by 128 bits of hash. Null and empty texts have one empty line. Rows with a null doc_id are one document
below all others; rows that share a doc_id are one document. Lines go back to their rows by doc_id and text, so the rows of
a frequent or null id spread. An empty table gives no rows.

Runs are bucketed tables, which only the session's catalog can hold: they are made in the current database and dropped at the
end, also after a failure. Their files lie in the shared folder.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import ascii_lower, documents, shared_dir, written

MIN_CHARS = 40
MIN_DOCS = 5
#: Least number of batches, and the rows of a batch beyond which there are more.
BATCHES = 4
BATCH_DOCS = 50_000_000
FANOUT = 2
SPACE = " \t\n\x0b\f\r"
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key; the second is seeded by a constant in front."""
    return F.xxhash64(key), F.xxhash64(F.lit("line"), key)


class LineRuns:
    """Levelled runs of (h1, h2, last_doc, n_docs); last_doc is null in a row that only adds to a count."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.levels: dict[int, list[str]] = {}
        self.names: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        by = rows.repartition(self.buckets, "h1")
        by.write.bucketBy(self.buckets, "h1").sortBy("h1", "h2").option("path", shared_dir(self.spark, "line-run")).saveAsTable(name)
        self.names.append(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        runs = self.spark.table(names[0])
        for name in names[1:]:
            runs = runs.union(self.spark.table(name))
        return runs.groupBy("h1", "h2").agg(F.max("last_doc").alias("last_doc"), F.sum("n_docs").alias("n_docs"))

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys(h1, h2, ...) that no run holds: one merge-anti-join for each run."""
        for names in self.levels.values():
            for name in names:
                keys = keys.join(self.spark.table(name).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of (h1, h2, last_doc, n_docs) whose doc_ids lie below those of all batches before it."""
        if self.levels:
            new = self.unseen(batch).select("h1", "h2", F.lit(True).alias("new"))
            batch = batch.join(new, ["h1", "h2"], "left").select("h1", "h2", F.when(F.col("new"), F.col("last_doc")).alias("last_doc"), "n_docs")
        self.levels.setdefault(0, []).append(self._write(batch))
        level = 0
        while len(self.levels.get(level, [])) >= FANOUT:
            self.levels.setdefault(level + 1, []).append(self._write(self._merged(self.levels.pop(level))))
            level += 1

    def compacted(self) -> DataFrame:
        return self._merged([name for names in self.levels.values() for name in names])

    def close(self) -> None:
        """Forgets the table names; the files stay in the shared folder until its owner clears it."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(_NO_ID))


@contextmanager
def _line_runs(spark: SparkSession):
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        yield runs
    finally:
        runs.close()


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, h1, h2) of the lines that go; null ids are the least long."""
    spark = docs.sparkSession
    lines = docs.select(_id().alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    long_enough = lines.select("doc_id", "text_hash", F.btrim("line", F.lit(SPACE)).alias("line")).filter(F.char_length("line") >= min_chars)
    h1, h2 = _hashes(ascii_lower(F.col("line")))
    batches = max(BATCHES, -(-docs.count() // BATCH_DOCS))
    cuts = docs.select(F.percentile_approx(_id(), [i / batches for i in range(1, batches)], max(10_000, 10 * batches))).first()[0] or []
    # the largest ids have batch 0: as many cuts lie below an id as batches come after its own
    after = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda cut: F.col("doc_id") <= cut)) if cuts else F.lit(0)
    path = shared_dir(spark, "line-keys")
    long_enough.select("doc_id", "text_hash", h1.alias("h1"), h2.alias("h2")).distinct().withColumn("batch", after).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema("doc_id long, text_hash long, h1 long, h2 long, batch int").parquet(path)
    with _line_runs(spark) as runs:
        for b in range(len(set(cuts)) + 1):
            own = keys.filter(F.col("batch") == b).select("doc_id", "h1", "h2").distinct()
            runs.add(own.groupBy("h1", "h2").agg(F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs")))
        known = written(runs.compacted().filter(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc"), "line-repeats")
    return keys.join(known, ["h1", "h2"]).filter(F.col("doc_id") < F.col("last_doc")).select("doc_id", "text_hash", "h1", "h2")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with __lines (array) and __kept (array), the lines before and after."""
    gone = repeated_lines(docs, min_chars, min_docs).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("h1", "h2")).alias("__gone"))
    gone = gone.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    both = docs.withColumns({"__id": _id(), "__hash": F.xxhash64("text")}).join(gone, ["__id", "__hash"], "left").drop("__id", "__hash")
    split = both.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))

    def stays(line: Column) -> Column:
        h1, h2 = _hashes(line_key(line))
        return ~F.array_contains(F.col("__gone"), F.struct(h1.alias("h1"), h2.alias("h2")))

    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.filter("__lines", stays))
    return split.withColumn("__kept", kept).drop("__gone")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated lines removed; n_chars, where docs have it, counts the text that stays. Null texts stay null."""
    found = deduplicated(docs)
    text = F.when(F.col("text").isNotNull(), F.array_join("__kept", "\n"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = F.size("__kept") < F.size("__lines")
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(documents(spark, sf_dir, "doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("__kept", "\n"), 256).alias("kept_sha256"),
    )


_ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed
  WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, (r.key IS NOT NULL AND k.doc_id < r.last_doc) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": _ORACLE}
