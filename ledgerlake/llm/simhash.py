"""Operator 7: SimHash near-duplicates by multi-index hashing.

A text becomes a 64-bit fingerprint: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of
the text's word shingles. The fingerprint is cut into two 32-bit segments. Two fingerprints that differ in d bits
or fewer differ in d // 2 bits or fewer in one of the segments, so each fingerprint looks up every value of
the Hamming ball of that radius around each of its segments in the table of segment values, and keeps matches
whose complete distance is d or less.

Only distinct fingerprints are looked up, so a group of exact copies counts once. A segment value that very many
distinct fingerprints share is not matched row by row: those fingerprints, and all that look the value up, go by
the points of the full 64-bit space instead. Fingerprints within two bits share a point at distance one or
less from both, and no point has more than 65 fingerprints around it, so that path is exact and linear.

Words are runs without ASCII white space, A-Z lower-cased. Texts with fewer words than a shingle hash whole;
null, empty and blank texts have fingerprint zero and link like any other. Repeated doc_ids are separate
documents with one identity; a null doc_id gets a class but never names one unless the whole class has null ids.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import near_copies
from ledgerlake.llm.common import documents, written
from ledgerlake.llm.components import components

SEGMENTS = 2
SEGMENT_BITS = 64 // SEGMENTS
#: Distinct fingerprints of a segment value beyond which they are linked through points of the full space.
HOT = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit value of a text's fingerprint."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests, n = xxhash.xxh64_digest(joined, 42), 1
    else:
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(length)
        n = len(words) - shingle + 1
        starts, ends = (end - length)[:n].tolist(), (end[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, 8), axis=1)
    over = bits.sum(axis=0, dtype=np.uint32) * 2 > n
    return int(np.packbits(over).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select("doc_id", of("text").alias("fp"))


def _ball(radius: int) -> list[int]:
    """All changes of up to radius bits of a segment, none first."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(SEGMENT_BITS), r)]


def _key(segment: int, change: Column) -> Column:
    value = F.shiftrightunsigned("fp", segment * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    return value.bitwiseXOR(change) + F.lit(segment << SEGMENT_BITS)


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(u, v) between distinct fingerprints of prints(fp), such that all within distance are connected."""
    if not 0 <= distance <= 2:
        raise ValueError("the path for frequent segment values holds up to two bits")
    table = prints.select("fp", F.explode(F.array(*[_key(s, F.lit(0)) for s in range(SEGMENTS)])).alias("key"))
    changes = F.array(*[F.lit(c).cast("long") for c in _ball(distance // SEGMENTS)])
    probes = prints.select("fp", F.explode(changes).alias("change")).select(
        "fp", F.explode(F.array(*[_key(s, F.col("change")) for s in range(SEGMENTS)])).alias("key")
    )
    sizes = written(table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "hot-segments")
    if sizes.isEmpty():
        cold, dense = table, None
    else:
        cold = table.join(sizes, "key", "left_anti")
        dense = probes.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "key", "left_semi").select("fp").distinct()
    met = probes.withColumnRenamed("fp", "u").join(cold.withColumnRenamed("fp", "v"), "key").filter(F.col("v") < F.col("u"))
    near = met.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")
    if dense is None:
        return near.distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)])
    points = dense.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    around = points.groupBy("point").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    shared = around.select("v", F.explode("fps").alias("u")).filter("u <> v")
    verified = shared.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")
    if distance < 2:  # points then join fingerprints two bits apart as well: compare all of the 65
        pairs = around.select(F.explode("fps").alias("u"), "fps").select("u", F.explode("fps").alias("v"))
        verified = pairs.filter(F.col("v") < F.col("u")).filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
    return near.union(verified).distinct()


def classes(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text)."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(links(distinct.select("fp"), distance))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each group of near copies: five-word shingles, similarity 0.8 or more.

    Texts are compared by their sets of shingles (near_copies.py); rows with equal sets are one node. Fingerprints of the
    sets that lie within two bits are found by links(); a node whose set is verified to be similar to that of its group's least node
    leaves at once. Fingerprints of similar sets may differ in up to 11 bits, beyond what small Hamming balls reach, so
    the remaining nodes meet by the prefixes of their sets, which finds every pair. No two of the kept rows are near copies, and every
    row that goes is a near copy of one that is kept.

    A row is kept for its own text: rows that share a doc_id, or have none, are separate. Of rows with equal sets that of least doc_id
    stays, null last, then by a hash of the row. Null, empty and blank texts are equal. An empty table gives no rows.
    """
    nodes = near_copies.nodes(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    distinct = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    roots = components(links(distinct.select("fp"), 2))
    grouped = nodes.select("node", "fp").join(roots, nodes.fp == roots.node, "left").select(nodes.node, F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("node").alias("u"), F.count("*").alias("n")).filter("n > 1")
    asked = grouped.join(least.drop("n"), "root").filter("node > u").select("u", F.col("node").alias("v"))
    return near_copies.kept(docs, nodes, asked)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
