"""Operator 10: benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. Each fixed mask
hashes only the words at its ones, so a replaced word at a zero leaves the hash alone. The hashes
of all benchmark positions are joined with those of all document positions. A hit puts the benchmark item and the
document side by side at one offset; the words of the whole item are then compared with the document's at that
offset, and the overlap counts if some WINDOW of the item (all of it, if shorter) agrees in at least SHARE of its words.
Items of fewer than EXACT words count only word for word.

The masks lose nothing: whichever words a window of 10 to 20 words may have replaced at SHARE, one of the two masks still fits
between them (the tests enumerate all patterns), and four equal words in a row have a hit. Items of one to three words are hashed whole.

Only narrow rows meet in the join: a hit is a document's text hash, an item and an offset. The words of the documents that
have hits are fetched once afterwards. The benchmark's hashes are broadcast while they are at most BROADCAST_ROWS rows of
three numbers, otherwise both sides are shuffled by hash; both plans give the same hits.

Documents are rows: of rows that share a doc_id each text is compared for itself, and a row is removed for its own text.
Null and empty texts have no words. Repeated rows give the same findings once. Items with equal texts are found one by
one, and items that share an item_id under that id. A document with a null doc_id is found under a null id. Empty tables give
no findings. Extra columns pass through decontaminated() untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import ascii_lower, documents, small_enough, written

#: Ones take part in the hash.
MASKS = ("1111", "11011")
#: Items below four words have no room for a mask; these hash such an item as a whole.
WHOLE = {1: "1", 2: "11", 3: "111"}
#: From so many words on an item may have replaced words.
EXACT = 10
WINDOW = 20
SHARE = 0.8
BROADCAST_ROWS = 500_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _seeds(rows: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """rows(words, ...) with pos and seed for each mask at each position that it fits."""
    n = F.size("words")
    shortest = min(map(len, masks))
    placed = rows.withColumn("pos", F.explode(F.when(n >= shortest, F.sequence(F.lit(0), n - shortest))))
    seeds = []
    for mask in masks:
        seed = F.xxhash64(F.lit(mask), *[F.get("words", F.col("pos") + i) for i, one in enumerate(mask) if one == "1"])
        seeds.append(seed if len(mask) == shortest else F.when(F.col("pos") + len(mask) <= n, seed))
    return placed.withColumn("seed", F.explode(F.array(*seeds)))


def _agreement(item: str, text: str, at: str) -> Column:
    """1 or 0 for each word of the item: the text's word beside it is the same. at: the item's word 0 in the text."""
    first = F.greatest(F.lit(0), F.col(at))
    skipped = first - F.col(at)
    beside = F.concat(F.array_repeat(F.lit(""), skipped), F.slice(F.col(text), first + 1, F.greatest(F.size(item) - skipped, F.lit(0))))
    return F.zip_with(F.col(item), beside, lambda a, b: F.when(a == b, 1).otherwise(0))


def _sum(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda x, y: x + y)


def _enough(flags: str, share: float) -> Column:
    """Whether a window of the item agrees enough."""
    width = F.least(F.size(flags), F.lit(WINDOW))
    windows = F.transform(F.sequence(F.lit(1), F.size(flags) - width + 1), lambda s: _sum(F.slice(F.col(flags), s, width)))
    return F.array_max(windows) >= F.when(F.size(flags) < EXACT, width).otherwise(F.ceil(width * share))


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, hash, item, at): the offsets at which a text and an item share a seed, each once."""
    short = [r[0] for r in items.select(F.size("words")).filter(F.size("words").between(1, 3)).distinct().collect()]
    parts = [(MASKS, items.filter(F.size("words") > 3))] + [((WHOLE[n],), items.filter(F.size("words") == n)) for n in sorted(short)]
    tokens, found = docs.select("doc_id", F.xxhash64("text").alias("hash"), words(F.col("text")).alias("words")), None
    for masks, own in parts:
        seeds = written(_seeds(own, masks).select("seed", "item", F.col("pos").alias("item_pos")).distinct(), "benchmark-seeds")
        table = F.broadcast(seeds) if small_enough(seeds, BROADCAST_ROWS) else seeds
        placed = _seeds(tokens, masks).select("doc_id", "hash", "pos", "seed")
        met = placed.join(table, "seed").select("doc_id", "hash", "item", (F.col("pos") - F.col("item_pos")).alias("at"))
        found = met if found is None else found.unionByName(met)
    return written(found.distinct(), "benchmark-hits")


def row_overlaps(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, hash, item_id, n_words, n_same, first_word) of every verified offset of a text, named by its hash, and an item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).distinct()
    items = written(items.select("item_id", "words", F.xxhash64("item_id", "words").alias("item")), "benchmark-items")
    hits = _hits(docs, items)
    asked = hits.select(F.col("hash").alias("__hash")).distinct()
    asked = F.broadcast(asked) if small_enough(asked, BROADCAST_ROWS) else asked
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(asked, F.col("hash") == F.col("__hash"), "left_semi")
    texts = named.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), words(F.col("text")).alias("words"))
    few = F.broadcast(hits) if small_enough(hits, BROADCAST_ROWS) else hits
    both = texts.join(few, (F.col("hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    beside = both.join(items.withColumnRenamed("words", "__item"), "item").select("doc_id", "hash", "item_id", "at", _agreement("__item", "words", "at").alias("same"))
    return beside.filter(_enough("same", share)).select(
        "doc_id", "hash", "item_id", F.size("same").cast("long").alias("n_words"), _sum(F.col("same")).cast("long").alias("n_same"),
        F.greatest(F.col("at"), F.lit(0)).cast("long").alias("first_word"),
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_words, n_same, first_word) of the best verified overlap of each document and item."""
    best = F.max(F.struct("n_same", (-F.col("first_word")).alias("back"), "n_words"))
    grouped = row_overlaps(docs, benchmark, share).groupBy("doc_id", "item_id").agg(best.alias("best"))
    return grouped.select("doc_id", "item_id", "best.n_words", "best.n_same", (-F.col("best.back")).alias("first_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text overlaps an item."""
    bad = row_overlaps(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__bad")).distinct()
    return docs.join(bad, (F.xxhash64("text") == F.col("__bad")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    """The same in SQL: the words at a mask's ones joined by a blank stand for their hash."""
    split = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

    def seeds(key: str, table: str, whole: str) -> str:
        kinds = [(m, "true") for m in MASKS] + [(m, whole.format(n=n)) for n, m in WHOLE.items()]
        return " UNION ALL ".join(
            f"SELECT {key}, words, pos, concat_ws(' ', '{m}', {', '.join(f'words[pos + {i + 1}]' for i, one in enumerate(m) if one == '1')}) AS seed "
            f"FROM (SELECT {key}, words, unnest(range(len(words) - {len(m) - 1})) AS pos FROM {table} WHERE len(words) >= {len(m)} AND {when})"
            for m, when in kinds
        )

    return f"""
WITH items AS (SELECT DISTINCT item_id, {split} AS words FROM benchmark),
docs AS (SELECT doc_id, {split} AS words FROM documents),
item_seeds AS ({seeds("item_id", "items", "len(words) = {n}")}),
doc_seeds AS ({seeds("doc_id", "docs", "EXISTS (SELECT 1 FROM items i WHERE len(i.words) = {n})")}),
hits AS (
  SELECT DISTINCT d.doc_id, i.item_id, i.words AS item, d.words AS words, d.pos - i.pos AS off
  FROM doc_seeds d JOIN item_seeds i ON d.seed = i.seed
), compared AS (
  SELECT doc_id, item_id, off, len(item) AS n, least(len(item), {WINDOW}) AS w,
         list_transform(range(len(item)), lambda j: CASE WHEN off + j >= 0 AND words[off + j + 1] = item[j + 1] THEN 1 ELSE 0 END) AS same
  FROM hits
), judged AS (
  SELECT doc_id, item_id, n, greatest(off, 0) AS first_word, list_sum(same) AS n_same,
         list_max(list_transform(range(n - w + 1), lambda s: list_sum(same[s + 1 : s + w]))) >= CASE WHEN n < {EXACT} THEN w ELSE ceil(w * {SHARE}) END AS enough
  FROM compared
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_same DESC, first_word) AS r FROM judged WHERE enough
)
SELECT doc_id, item_id, n::BIGINT AS n_words, n_same::BIGINT AS n_same, first_word::BIGINT AS first_word FROM ranked WHERE r = 1
"""


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES = {"op10_decontaminate": _sql()}
