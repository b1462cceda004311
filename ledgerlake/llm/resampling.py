"""Operator 12: importance resampling towards a target distribution, by array-scored weights and a bisected cutoff.

Features are all runs of 1 to `longest` consecutive words, hashed into buckets. One pass over the texts writes each document as
(bucket, count) entries to the shared folder. The buckets' counts over all documents and over the target's texts give one array of gains, a
document's weight is the sum of its entries' gains, looked up in that array for a whole Arrow batch at once, and Gumbel noise drawn from its
doc_id turns the highest scores into a sample without replacement.

The scores are written once. The cutoff is found by bisecting the numbers between the least and the highest score with exact count jobs over
that table, and then the doc_ids of the rows tied at that score in the same way. Only rows above the cutoff are put in order, by ranges, for
their ranks. So nothing is sorted as a whole, and the driver holds counts and the array of gains, whose size is a parameter.

A-Z are lower-cased; a word is a run of a-z, 0-9 and characters beyond ASCII. A null text has no words. A null doc_id draws noise as
an empty one does and comes after all others in ties. Rows that share a doc_id are documents of their own, those with fewer features first in ties;
rows that agree in that as well have equal results but for their ranks. Empty tables give no rows, an empty target gives gains all the same. Extra
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.common import CRC32_STEPS_SQL, crc32_sql, documents, written

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Cuts that one count job tries at once.
CUTS = 15

#: Bytes of words as they are, A-Z lower-cased, all others blanks.
_WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def features(text: bytes, longest: int = LONGEST) -> tuple[int, Counter]:
    """(words, counts of the features) of a text."""
    words = text.translate(_WORDS).split()
    found = Counter(words)
    for n in range(2, longest + 1):
        found.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return len(words), found


def vectors(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """docs with n_words, n_features and entries of (bucket, count) in place of text; a bucket may come more than once."""
    kept = [c for c in docs.columns if c != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, total, bucket, n, ends = [], [], [], [], [0]
            for text in batch.column("__text").to_pylist():
                number, found = features(text, longest)
                words.append(number)
                total.append(found.total())
                bucket += [crc32(f) % buckets for f in found]
                n += found.values()
                ends.append(len(n))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (bucket, n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(words, pa.int64()), pa.array(total, pa.int64()), *lists], [*kept, "n_words", "n_features", "bucket", "n"])

    types = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    text = F.coalesce("text", F.lit("")).cast("binary").alias("__text")
    return docs.select(*kept, text).mapInArrow(count, f"{types}n_words long, n_features long, bucket array<int>, n array<int>")


def bucket_counts(entries: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features of all rows by bucket. Each task adds its own up, so the shuffle moves a row for each bucket and task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("bucket", "n"))
            found += np.bincount(bucket, n, buckets).astype(np.int64)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(found[held])], ["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    for bucket, n in entries.select("bucket", "n").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of a bucket's smoothed shares in the target and in the source."""
    whole_s, whole_t, b = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (whole_s + b) / ((s + 1) * (whole_t + b)))) for s, t in zip(source.astype(float), target.astype(float), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(entries: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of vectors()."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column("bucket"), batch.column("doc_id")
            ends = lists.offsets.to_numpy()
            bucket, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("bucket", "n"))
            sums = np.append(0, np.cumsum(gain[bucket] * n))
            weight = np.diff(sums[ends - ends[0]])
            drawn = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, batch.column("n_words"), batch.column("n_features"), pa.array(weight), pa.array(drawn)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return entries.select("doc_id", "n_words", "n_features", "bucket", "n").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def least(rows: DataFrame, number: Column, enough: int) -> int:
    """The least whole number that at least `enough` rows do not exceed; rows hold that many."""
    low, high = rows.agg(F.min(number), F.max(number)).first()
    while low < high:
        cuts = sorted({low + (high - low) * (i + 1) // (CUTS + 1) for i in range(CUTS)} - {high})
        counts = rows.agg(*[F.count_if(number <= F.lit(c)) for c in cuts]).first()
        reach = [c for c, n in zip(cuts, counts, strict=True) if n >= enough]
        short = [c for c, n in zip(cuts, counts, strict=True) if n < enough]
        low, high = (max(short) + 1 if short else low), (min(reach) if reach else high)
    return low


def cutoff(rows: DataFrame, draws: int) -> Column:
    """Whether a row of rows(doc_id, score) is among the first `draws` by score and doc_id, or ties with the last of them in both."""
    worst = -least(rows, -F.col("score"), draws)
    tied = rows.filter(F.col("score") == worst)
    above, ties, named = rows.agg(F.count_if(F.col("score") > worst), F.count_if(F.col("score") == worst), F.count_if((F.col("score") == worst) & F.col("doc_id").isNotNull())).first()
    first = F.col("score") > worst
    if above + ties == draws or draws - above > named:
        return first | (F.col("score") == worst)
    last = least(tied.filter("doc_id IS NOT NULL"), F.col("doc_id"), draws - above)
    return first | ((F.col("score") == worst) & F.coalesce(F.col("doc_id") <= last, F.lit(False)))


def ranks(rows: DataFrame) -> DataFrame:
    """rows with rank, 1.. by falling score; each range of scores is put in order by itself."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "resampling-ranges")
    sizes = dict(ranged.groupBy("part").count().collect())  # a number for each partition
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    inside = ranged.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    ahead = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    return inside.join(ahead, "part").withColumn("rank", F.col("before") + F.col("place"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all docs(doc_id, text); rank is null where a document is not drawn.

    Of the documents with least_words words or more, percent in a hundred are drawn towards the texts of target(text).
    """
    entries = written(vectors(docs.select(F.col("doc_id").cast("long"), "text"), buckets, longest), "resampling-vectors")
    gain = gains(bucket_counts(entries, buckets), bucket_counts(vectors(target.select("text"), buckets, longest), buckets))
    scores = written(weighed(entries, gain, seed).withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    eligible = scores.filter(F.col("n_words") >= least_words)
    draws = percent * eligible.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if draws == 0:
        return scores.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & cutoff(eligible, draws)
    first = ranks(scores.filter(drawn)).select(*out, F.when(F.col("rank") <= draws, F.col("rank")).alias("rank"))
    return scores.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(first)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


QUERIES = {"op12_resampling": op12_resampling}

_FEATURES = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word"

ORACLES = {
    "op12_resampling": f"""
WITH steps AS ({CRC32_STEPS_SQL}),
d AS (SELECT doc_id, row_number() OVER () AS r, text FROM documents),
dw AS (SELECT r, {_FEATURES} FROM d), bw AS (SELECT {_FEATURES} FROM benchmark),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
hashed AS (SELECT word, {crc32_sql('h')} % {BUCKETS} AS bucket FROM vocabulary, steps),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY 1),
totals AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS big_s, (SELECT count(*) FROM bw)::DOUBLE AS big_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (big_s + {BUCKETS}) / ((coalesce(s, 0) + 1) * (big_t + {BUCKETS}))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), totals),
weights AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY 1),
scores AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT *, n_features >= {LEAST_WORDS} AS fit, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id, n_features) AS place FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT {PERCENT} * count(*) // 100 FROM ranked WHERE fit) THEN place END AS rank FROM ranked"""
}
