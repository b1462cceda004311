"""Near copies by an exact join of shingle sets: the verification and completion of operator 7's near_dedup().

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is SIMILARITY or more. Fingerprints
of such texts differ in up to 11 of 64 bits, too many for multi-index hashing alone, so further candidates come from prefixes: if all
sets are sorted by one order, two sets that are similar enough share an element among the first n - ceil(0.8 n) + 1 of each.
Any order finds all pairs. The one used puts shingles that are frequent in a part of the documents last, which only saves work.
Candidates whose parities differ too much are dropped, which leaves few that are not near copies; the complete sets of those are
compared.

Equal sets are one node from the start. Nodes have an order, that of their hashes, and a node stays if and only if no smaller node that
stays is a near copy of it. So no two of the kept texts are near copies, and every text that goes is a near copy of one that
stays, whatever the sizes of groups: with A like B, B like C and A unlike C, in this order, B goes and C stays.

A prefix element that more than HOT nodes share is first compared with its least
node alone: nodes that are near copies of it leave the search, round by round, so a large group of near copies takes one comparison for each
of its nodes. What is left meets pair by pair. A node that has left for one that does not stay itself, and for no other, may stay
after all: such nodes come back and meet those that are left, until no link is found any more.

Words are those of operator 7. Texts of five words or fewer are one shingle; null, empty and blank texts are equal. A row is
kept for its text: rows that share a doc_id, or have none, are separate. Of rows with equal sets the one of least doc_id stays.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ledgerlake.llm.common import small_enough, written

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
SIMILARITY = (4, 5)
#: Nodes of a prefix element beyond which they are compared with its least node first.
HOT = 4
#: One of so many documents is counted to find frequent shingles, which occur FREQUENT times or more in that part.
PART, FREQUENT, MAX_FREQUENT = 8, 8, 500_000
#: Rounds end when fewer than this share of the nodes in hot elements leave.
LEAST_GAIN = 0.05
#: Columns of a set's parity folded to 256 parts.
SKETCH = ("s0", "s1", "s2", "s3")


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64).view(np.int64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length)
    n = len(words) - SHINGLE + 1
    starts, ends = (end - length)[:n].tolist(), (end[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    return np.unique(hashes.view(np.int64))


@F.pandas_udf(LongType())
def _node(texts: pd.Series) -> pd.Series:
    return pd.Series([_name(shingle_set(t)) for t in texts], dtype="uint64").astype("int64")


@F.pandas_udf(ArrayType(LongType()))
def _set(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t) for t in texts], dtype="object")


def _fingerprint(hashes: np.ndarray) -> np.int64:
    """The 64-bit fingerprint of a set of hashes: a bit is 1 if it is set in over half of them."""
    bits = np.unpackbits(hashes.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.uint32) * 2 > len(hashes)).view(">i8")[0]


def _parity(hashes: np.ndarray) -> np.ndarray:
    """A bit for each part of the hashes, by their low bits: whether the set has an odd number there. Four parts for each element at least."""
    parts = max(256, 1 << (4 * len(hashes) - 1).bit_length())
    return np.packbits((np.bincount(hashes & (parts - 1), minlength=parts) & 1).astype(np.uint8)).view(np.int64)


def _name(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), 7)


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a part of the documents, sorted, and how often they occur there."""
    part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0).select(F.explode(_set("text")).alias("key"))
    counted = part.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).toPandas().sort_values("key")
    return rows["key"].to_numpy("int64"), rows["n"].to_numpy("int64")


def nodes(docs: DataFrame) -> DataFrame:
    """(node, hash, n, fp, first, keys, parity, s0 to s3) of each distinct set of docs(text); fp is its fingerprint.

    hash is that of a text with the set. A set need be met by a longer one in its first keys alone. Sets differ in as many elements at
    least as their parities, and as those folded to 256 parts in s0 to s3.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs))
    a, b = SIMILARITY

    @F.pandas_udf("struct<node: long, n: int, fp: long, first: int, keys: array<long>, parity: array<long>, " + ", ".join(f"{c}: long" for c in SKETCH) + ">")
    def prefix(texts: pd.Series) -> pd.DataFrame:
        known, times = shared.value
        out = []
        for t in texts:
            s = shingle_set(t)
            n, node = len(s), np.uint64(_name(s)).astype(np.int64)
            fp = _fingerprint(s)
            parity = _parity(s)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                s = s[np.argsort(np.where(known[at] == s, times[at], 0), kind="stable")]
            out.append((node, n, fp, n - -(-2 * a * n // (a + b)) + 1, s[: n - -(-a * n // b) + 1], parity, *np.bitwise_xor.reduce(parity.reshape(-1, len(SKETCH)))))
        return pd.DataFrame(out, columns=["node", "n", "fp", "first", "keys", "parity", *SKETCH])

    found = docs.select(F.xxhash64("text").alias("hash"), prefix("text").alias("p"))
    return written(found.groupBy("p.node").agg(F.min("hash").alias("hash"), F.first("p").alias("p")).select("hash", "p.*"), "near-nodes")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) that are near copies."""
    a, b = SIMILARITY
    # sizes first: they are narrow and part most pairs before parities move
    sizes, seen = nodes.select("node", "n"), nodes.select("node", "hash", "parity")
    pairs = pairs.distinct().join(sizes.toDF("u", "u_n"), "u").join(sizes.toDF("v", "v_n"), "v")
    pairs = pairs.filter(F.least("u_n", "v_n") * b >= F.greatest("u_n", "v_n") * a)
    pairs = pairs.join(seen.toDF("u", "u_hash", "u_parity"), "u").join(seen.toDF("v", "v_hash", "v_parity"), "v")
    # sets whose sizes are that close have as many parts or one of them twice as many, whose halves are then folded
    parts = F.least(F.size("u_parity"), F.size("v_parity"))
    halves = lambda c: F.zip_with(F.slice(c, F.lit(1), parts), F.slice(c, parts + 1, parts), lambda x, y: x.bitwiseXOR(y))
    folded = [F.when(F.size(c) > parts, halves(c)).otherwise(F.col(c)) for c in ("u_parity", "v_parity")]
    apart = F.aggregate(F.zip_with(*folded, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    pairs = written(pairs.filter(apart * (a + b) <= (F.col("u_n") + F.col("v_n")) * (b - a)).select("u", "v", "u_hash", "v_hash"), "near-pairs")
    asked = written(pairs.select(F.explode(F.array("u_hash", "v_hash")).alias("hash")).distinct(), "near-asked")
    asked = F.broadcast(asked) if small_enough(asked, 1_000_000) else asked
    texts = docs.select("text", F.xxhash64("text").alias("hash")).join(asked, "hash", "left_semi")
    one = texts.groupBy("hash", F.octet_length("text").alias("size")).agg(F.min("text").alias("text"))
    sets = written(one.select(_node("text").alias("node"), _set("text").alias("s")), "near-sets")
    both = pairs.select("u", "v").join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    common = F.size(F.array_intersect("a", "b"))
    whole = F.size("a") + F.size("b") - common
    return written(both.filter(common * b >= whole * a).select("u", "v"), "near-edges")


def losers(edges: DataFrame) -> DataFrame:
    """(node) of edges(u, v), u < v, whose smaller neighbours include one that is not among them itself.

    Rounds grow with the logarithm of the nodes if their order is a random one; each is written to the shared folder.
    """
    left, gone = written(edges.select("u", "v").distinct(), "near-links"), []
    while not left.isEmpty():
        stay = left.select("u").distinct().join(left.select(F.col("v").alias("u")), "u", "left_anti")
        gone.append(written(left.join(stay, "u").select(F.col("v").alias("node")).distinct(), "near-gone"))
        left = written(_without(_without(left, gone[-1], "u"), gone[-1], "v"), "near-links")
    return reduce(DataFrame.union, gone) if gone else edges.select(F.col("v").alias("node"))


def _without(rows: DataFrame, gone: DataFrame, column: str = "node") -> DataFrame:
    gone = gone.withColumnRenamed("node", column)
    return rows.join(F.broadcast(gone) if small_enough(gone, 500_000) else gone, column, "left_anti")


def _prefixes(open_: DataFrame) -> DataFrame:
    """(key, node, first, new) of the prefix elements that several nodes of open_(node, first, keys, new) share, one of them new."""
    each = open_.select("node", "first", "new", F.posexplode("keys").alias("at", "key"))
    by_key = each.select("key", "node", (F.col("at") < F.col("first")).alias("first"), "new").repartition("key")
    several = by_key.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("new").alias("some")).filter("n > 1 AND some").select("key")
    return written(by_key.join(several, "key", "left_semi"), "near-prefixes")


def _search(rows: DataFrame, nodes: DataFrame, docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of near copies (u, v) among the nodes of rows, and tables of the nodes that left before they had met all others."""
    edges, early = [], []
    while True:
        hot = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("new", "node").alias("u_new"), F.min("node").alias("u")).filter(F.col("n") > HOT).drop("n"), "near-hot")
        if hot.isEmpty():
            break
        few = F.broadcast(hot) if small_enough(hot, 500_000) else hot
        met = rows.join(few, "key").filter("node > u AND (new OR u_new)").select("u", F.col("node").alias("v"))
        edges.append(_verified(met, nodes, docs))
        early.append(written(edges[-1].select(F.col("v").alias("node")).distinct(), "near-gone"))
        n_hot, n_gone = met.select("v").distinct().count(), early[-1].count()
        # the least node has met all others of its element, so it need not stay there
        told = rows.join(few.select("key", F.col("u").alias("node")), ["key", "node"], "left_anti")
        rows = written(_without(told, early[-1]), "near-prefixes")
        if n_gone <= LEAST_GAIN * n_hot:
            break
    # sizes and folded parities part most pairs in the join itself, before they are rows
    facts = nodes.select("node", "n", *SKETCH)
    rows = rows.join(F.broadcast(facts) if small_enough(facts, 500_000) else facts, "node")
    one, other = rows.filter("first"), rows.select("key", *[F.col(c).alias(f"b_{c}") for c in rows.columns if c != "key"])
    a, b = SIMILARITY
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH), F.lit(0))
    close = (F.least("n", "b_n") * b >= F.greatest("n", "b_n") * a) & (apart * (a + b) <= (F.col("n") + F.col("b_n")) * (b - a))
    met = one.join(other, "key").filter(F.expr("node <> b_node AND (new OR b_new)") & close).select(F.col("node").alias("a"), F.col("b_node").alias("b"))
    edges.append(_verified(met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")), nodes, docs))
    return edges, early


def gone(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node) of the nodes of docs(text) that go: those with a smaller near copy that stays.

    asked are pairs (u, v), u < v, to verify first.
    """
    edges = [_verified(asked, nodes, docs)]
    early = [written(edges[0].select(F.col("v").alias("node")).distinct(), "near-gone")]
    rows, first = _prefixes(_without(nodes, early[0]).withColumn("new", F.lit(True))), True
    while True:
        found, left = _search(rows, nodes, docs)
        if not first and all(e.isEmpty() for e in found):
            return lost
        edges, early, first = edges + found, early + left, False
        lost = written(losers(reduce(DataFrame.union, edges)), "near-lost")
        back = written(_without(reduce(DataFrame.union, early).distinct(), lost), "near-back")
        if back.isEmpty():
            return lost
        stay = _without(nodes, lost).join(back.withColumn("back", F.lit(True)), "node", "left")
        rows = _prefixes(stay.withColumn("new", F.coalesce("back", F.lit(False))))


def kept(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with one row of each group of near copies; nodes are those of docs, asked as for links()."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    lost = gone(docs.select(F.coalesce("text", F.lit("")).alias("text")), nodes, asked)
    row = docs.select(_node("text").alias("node"), F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*columns)).alias("place"), F.struct(*columns).alias("row"))
    stays = _without(row, lost)
    return stays.groupBy("node").agg(F.min_by("row", "place").alias("row")).select("row.*")
