"""Hash-chained ledgers: record hashes, Merkle roots, links and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def record_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as one JSON object, names in order, so no two records share a form; a null field makes the hash null, an error row."""
    whole = F.lit(True)
    for f in fields.values():
        whole = whole & f.isNotNull()
    return F.when(whole, F.sha2(F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)])), 256))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(text, "UTF-8")), 256)


def merkle_root(leaves: Column) -> Column:
    """The root of an array of leaf hashes in order: pairs hash to nodes, an odd node goes up as it is.

    One expression for each array: the levels are an aggregate over a range of the logarithm of its size, so a group's
    leaves are gathered once and nothing is shuffled between levels.
    """

    def level(nodes: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.greatest(F.floor((F.size(nodes) - 1) / 2), F.lit(0)).cast("int"))
        node = lambda i: F.when(
            2 * i + 1 < F.size(nodes),
            F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(F.get(nodes, 2 * i)), F.unhex(F.get(nodes, 2 * i + 1))), 256),
        ).otherwise(F.get(nodes, 2 * i))
        return F.transform(pairs, node)

    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(leaves).cast("double"))).cast("int")))
    return F.get(F.aggregate(levels, leaves, level), F.lit(0))


def chained(rows: DataFrame, ledger: str, seq: str, hash_: str) -> DataFrame:
    """rows with prev_hash, "" for the first; ledgers are independent and run in parallel."""
    return rows.withColumn("prev_hash", F.lag(hash_, 1, "").over(Window.partitionBy(ledger).orderBy(seq)))


def verified(rows: DataFrame, ledger: str, seq: str, recomputed: Column, root: Column | None = None, actors: DataFrame | None = None) -> DataFrame:
    """rows(record_hash, prev_hash) with hash_ok, link_ok, merkle_ok, actor_ok, all_valid and detail; a null says that it was not checked.

    root is the recomputed Merkle root, held against rows' merkle_root; null where there is none. actors(actor) are those who may write,
    held against rows' actor; no actor is checked where that list is empty.
    """
    by = Window.partitionBy(ledger).orderBy(seq)
    unchecked = F.lit(None).cast("boolean")
    out = rows.withColumn("hash_ok", F.col("record_hash") == recomputed)
    out = out.withColumn("link_ok", F.col("prev_hash") == F.lag("record_hash", 1, "").over(by))
    out = out.withColumn("merkle_ok", unchecked if root is None else F.col("merkle_root") == root)
    if actors is None:
        out = out.withColumn("actor_ok", unchecked)
    else:
        known = actors.filter("actor IS NOT NULL").select("actor").distinct().withColumn("__known", F.lit(True))
        listed = F.broadcast(known.agg((F.count("*") > 0).alias("__listed")))
        out = out.join(known, "actor", "left").crossJoin(listed)
        out = out.withColumn("actor_ok", F.when(F.col("__listed"), F.coalesce("__known", F.lit(False)))).drop("__known", "__listed")
    flags = ("hash_ok", "link_ok", "merkle_ok", "actor_ok")
    out = out.withColumn("all_valid", F.coalesce("hash_ok", F.lit(True)) & F.coalesce("link_ok", F.lit(True)) & F.coalesce("merkle_ok", F.lit(True)) & F.coalesce("actor_ok", F.lit(True)))
    said = ("record hash differs", "link is broken", "Merkle root differs", "actor is unknown")
    wrong = F.array_compact(F.array(*[F.when(~F.col(f), F.lit(t)) for f, t in zip(flags, said, strict=True)]))
    return out.withColumn("detail", F.when(F.col("all_valid"), "valid").otherwise(F.array_join(wrong, "; ")))
