"""Operator 13: scores of an interpolated modified Kneser-Ney n-gram model counted in Spark and kept as sorted hash arrays.

Words and n-grams are 64-bit hashes, computed for a whole Arrow batch at once from the bytes of its texts. Counting goes down from the highest order. Each
task counts its own n-grams and sends them by hash to shards; a shard adds up what it gets, writes its n-grams as a sorted array of hashes
with their counts, and sends on what the next step needs: for the contexts their total and how many followers they have once,
twice and more often, and for the n-grams one shorter a one for each distinct n-gram that ends in them, which is their count there. Each step spreads by hash, so a
frequent word or context lands in one shard only as one row from each shard of the step before. Rows travel as blobs of columns.

Scoring reads each text once. Workers map the arrays into memory, look a chunk's hashes up in order, and interpolate

    p(w | c) = (max(n(cw) - D, 0) + (D1 N1 + D2 N2 + D3 N3) p(w | shorter c)) / n(c)

from the uniform distribution over the known tokens and one unknown upwards. D1, D2 and D3 of each order come from how many n-grams it has once, twice, three and four
times; an order that has too few for that takes FALLBACK. A text is preceded by marks that are never predicted and followed by an end that is.
The model's folder lies in the shared folder. Where that is a file system, only the pages in use take memory; arrays of other stores
are read one shard at a time.

A-Z are lower-cased; words are runs without ASCII white space. Null and empty texts are the end alone. A null doc_id counts as an empty one, so
it trains. Rows that share a doc_id are texts of their own. Without any training text every token has the odds of the one unknown. An empty table gives no
rows. Extra columns are not read. A task holds 8 bytes for each token of its longest text and order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import CRC32_STEPS_SQL, crc32_sql, documents, make_dir, open_store, read_bytes, shared_dir, write_bytes

ORDER = 2
FOLDS, HELD_OUT = 7, 2
#: Bytes of text for each shard of the counts; there are a power of two of them.
SHARD_BYTES = 8 << 20
#: Bytes of text that are worked on at once, and n-grams that a task gathers before it counts them.
CHUNK = 4 << 20
GATHER = 3_000_000
#: Discounts of n-grams with count 1, 2, and 3 or more.
FALLBACK = (0.5, 1.0, 1.5)

_U = np.uint64
_TIMES, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64 over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


START, END = (int(x) for x in mix(np.array([1, 2], np.uint64)))
_IS_WORD = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
#: What a byte adds to its word's hash; white space nothing.
_BYTE = np.where(_IS_WORD, mix((_LOWER + _U(3)) * _TIMES), _U(0))


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(_U(1), np.full(n - 1, _STEP)))


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from those of its context and its last word."""
    return mix(context * _TIMES + word)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the words of texts in data, text i from offsets[i] to offsets[i + 1]; data begins with text 0."""
    inside = _IS_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    found = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK // 4)))
        a, b = starts[at], ends[to - 1]
        first = starts[at:to] - a
        reach = np.diff(np.append(first, b - a))
        place = np.arange(b - a) - np.repeat(first, reach)
        powers = _powers(1 << max(16, int(reach.max() - 1).bit_length()))
        sums = np.add.reduceat(_BYTE[data[a:b]] * powers[place], first)
        found[at:to] = mix(sums + (ends[at:to] - starts[at:to]).astype(np.uint64) * _TIMES)
        at = to
    return found, np.searchsorted(offsets, starts, "right") - 1


@dataclass
class Tokens:
    """Texts as hashes one after another: order - 1 starts, words, end. at: the places of words and ends; ends: how many of them up to each text's end."""

    sequence: np.ndarray
    at: np.ndarray
    ends: np.ndarray

    def grams(self, order: int) -> list[np.ndarray]:
        """Hashes of the n-grams that end at each place, for n from 1 on; of use where n - 1 places of the same text come before."""
        found = [self.sequence]
        for _ in range(order - 1):
            found.append(longer(np.append(_U(0), found[-1][:-1]), self.sequence))
        return found


def tokens(data: np.ndarray, offsets: np.ndarray, order: int) -> Tokens:
    words, text = word_hashes(data, offsets)
    texts, pad = len(offsets) - 1, order - 1
    ends = np.cumsum(np.bincount(text, minlength=texts)) + np.arange(1, texts + 1)
    sequence = np.full(len(words) + texts * (1 + pad), START, np.uint64)
    sequence[np.arange(len(words)) + text * (1 + pad) + pad] = words
    sequence[ends - 1 + np.arange(1, texts + 1) * pad] = END
    of = np.repeat(np.arange(texts), np.diff(np.append(0, ends)))
    return Tokens(sequence, np.arange(len(of)) + (of + 1) * pad, ends)


def chunks(texts: pa.Array, order: int) -> Iterator[tuple[int, int, Tokens]]:
    """(first, end, tokens) of runs of texts, a column of binary, of about CHUNK bytes."""
    wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, to, tokens(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], order)
        at = to


# Rows travel as (kind, shard, blob); a blob is a number of rows and columns of 8 bytes, compressed.

_ROW = "kind string, shard int, blob binary, stats array<long>"
_CODEC = "zstd"


def pack(columns: list[np.ndarray]) -> bytes:
    raw = b"".join(c.tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, _CODEC, asbytes=True)


def unpack(blobs: list[bytes], columns: int) -> list[np.ndarray]:
    parts = []
    for b in blobs:
        size = int.from_bytes(b[:8], "little")
        raw = pa.decompress(b[8:], size, _CODEC, asbytes=True) if size else b""
        parts.append(np.frombuffer(raw, np.uint64).reshape(columns, -1))
    return list(np.concatenate(parts, axis=1))


def shard_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> _U(63 - bits) >> _U(1)).astype(np.int64)


def added(key: np.ndarray, columns: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rows of the same key as one: keys in order, columns of any of its rows, sums added up."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if not len(first):
        return key, columns, sums
    return key[first], [c[order[first]] for c in columns], [np.add.reduceat(s[order], first) for s in sums]


def dealt(kind: str, key: np.ndarray, columns: list[np.ndarray], bits: int) -> Iterator[dict]:
    """The rows, sorted by key, as blobs for their shards."""
    cuts = np.searchsorted(shard_of(key, bits), np.arange((1 << bits) + 1))
    for shard in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[shard], cuts[shard + 1])
        like = np.argsort(columns[0][s])  # equal words side by side take next to no space
        yield {"kind": kind, "shard": int(shard), "blob": pack([c[s][like] for c in columns]), "stats": None}


def whole_key(words: list[np.ndarray]) -> np.ndarray:
    key = words[0]
    for w in words[1:]:
        key = longer(key, w)
    return key


def publish(uri: str, key: np.ndarray, columns: list[np.ndarray]) -> None:
    """Writes a shard's arrays: rows and the width of each column, then the columns, each from a multiple of 8 bytes on.

    The file appears under its name when it is whole. A second attempt writes the same bytes, so either may stay.
    """
    narrow = [c.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(c) or c.max() <= np.iinfo(t).max)) for c in columns]
    arrays = [key, *narrow]
    head = np.array([len(key), *[a.itemsize for a in arrays], *[0] * (7 - len(arrays))], np.uint64)
    own = f"{uri}.{uuid.uuid4().hex}"
    write_bytes(own, b"".join([head.tobytes(), *[a.tobytes() + bytes(-a.nbytes % 8) for a in arrays]]))
    store, path = open_store(uri)
    try:
        store.move(open_store(own)[1], path)
    except OSError:  # some stores don't move onto a file
        if not store.get_file_info(path).is_file:
            raise
        store.delete_file(open_store(own)[1])


def _columns(raw: np.ndarray) -> list[np.ndarray]:
    head = raw[:64].view(np.uint64)
    n, at, found = int(head[0]), 64, []
    for width in head[1:]:
        if width:
            found.append(raw[at : at + n * int(width)].view(f"u{int(width)}"))
            at += -(-n * int(width) // 8) * 8
    return found


@lru_cache(4096)
def _mapped(path: str) -> list[np.ndarray]:
    return _columns(np.asarray(np.memmap(path, np.uint8, "r")))


def opened(uri: str) -> list[np.ndarray]:
    """The arrays of a shard, mapped into memory where the store is a file system."""
    store, path = open_store(uri)
    return _mapped(path) if store.type_name == "local" else _columns(np.frombuffer(read_bytes(uri), np.uint8))


def find(table: str, bits: int, key: np.ndarray, columns: int) -> list[np.ndarray]:
    """The columns of a table at each key; 0 where it hasn't the key."""
    order = np.argsort(key)
    asked = key[order]
    first = np.append(True, asked[1:] != asked[:-1])[: len(asked)]
    once = asked[first]
    got = [np.zeros(len(once), np.int64) for _ in range(columns)]
    shards = shard_of(once, bits)
    cuts = np.append(np.flatnonzero(np.append(True, shards[1:] != shards[:-1])[: len(shards)]), len(shards))
    for a, b in zip(cuts, cuts[1:], strict=False):
        held, *values = opened(f"{table}/{shards[a]}")
        at = np.searchsorted(held, once[a:b])
        at[at == len(held)] = 0
        hit = np.flatnonzero(held[at] == once[a:b]) if len(held) else np.zeros(0, np.int64)
        for g, v in zip(got, values, strict=True):
            g[a + hit] = v[at[hit]]
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(first) - 1
    return [g[back] for g in got]


def counted(texts: DataFrame, order: int, bits: int) -> DataFrame:
    """The n-grams of texts(text), a binary column, counted by task: rows for step()."""
    kind = f"grams{order}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def blobs() -> pa.RecordBatch:
            words = [np.concatenate(c) for c in zip(*held, strict=True)]
            key, words, (n,) = added(whole_key(words), words, [np.ones(len(words[0]), np.uint64)])
            return pa.RecordBatch.from_pylist(list(dealt(kind, key, [*words, n, n], bits)), _SCHEMA)

        for batch in batches:
            for _, _, t in chunks(batch.column("text"), order):
                held.append([t.sequence[t.at - k] for k in range(order - 1, -1, -1)])
                n += len(t.at)
                if n >= GATHER:
                    yield blobs()
                    held, n = [], 0
        if n:
            yield blobs()

    empty = texts.sparkSession.range(1 << bits).select(F.lit(kind).alias("kind"), F.col("id").cast("int").alias("shard"), F.lit(pack([])).alias("blob"), F.lit(None).cast("array<long>").alias("stats"))
    return texts.select("text").mapInArrow(count, _ROW).unionAll(empty)


_SCHEMA = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])


def shard_grams(folder: str, level: int, shard: int, blobs: list[bytes], bits: int) -> Iterator[dict]:
    """Adds up and writes a shard of the n-grams of a level; gives rows for contexts and the level below, and the level's counts.

    Those are: n-grams, the sum of their counts, how many have count 1, 2, 3, 4, how many 3 or more, and occurrences in the texts.
    """
    *words, n, raw = unpack(blobs, level + 2)
    key, words, (n, raw) = added(whole_key(words), words, [n, raw])
    publish(f"{folder}/grams{level}/{shard}", key, [n, raw] if level == 1 else [n])
    has = [n == c for c in (1, 2, 3, 4)] + [n >= 3]
    yield {"kind": f"stats{level}", "shard": shard, "blob": None, "stats": [len(n), int(n.sum()), *[int(h.sum()) for h in has], int(raw.sum())]}
    if level > 1:
        context, _, sums = added(whole_key(words[:-1]), [], [n, *[has[i].astype(np.uint64) for i in (0, 1, 4)]])
        yield {"kind": f"context{level}", "shard": shard, "blob": pack([]), "stats": None}
        yield from dealt(f"context{level}", context, [context, *sums], bits)
        below, shorter, sums = added(whole_key(words[1:]), words[1:], [np.ones(len(n), np.uint64), raw])
        yield {"kind": f"grams{level - 1}", "shard": shard, "blob": pack([]), "stats": None}
        yield from dealt(f"grams{level - 1}", below, [*shorter, *sums], bits)


def step(rows: DataFrame, folder: str, bits: int) -> DataFrame:
    """One step down: shards of what has arrived are written, and their rows for the next step come out; counts pass through."""

    def reduce(group: pa.Table) -> pa.Table:
        kind, shard = group.column("kind")[0].as_py(), group.column("shard")[0].as_py()
        blobs, found = group.column("blob").to_pylist(), []
        if kind.startswith("grams"):
            found = list(shard_grams(folder, int(kind[5:]), shard, blobs, bits))
        elif kind.startswith("context"):
            key, *sums = unpack(blobs, 5)
            key, _, sums = added(key, [], sums)
            publish(f"{folder}/{kind}/{shard}", key, sums)
        else:
            return group
        return pa.Table.from_pylist(found, _SCHEMA)

    return rows.groupBy("kind", "shard").applyInArrow(reduce, _ROW)


@dataclass(frozen=True)
class Model:
    """Where the arrays of a model are, and its counts by level from 1 on, as in shard_grams()."""

    folder: str
    order: int
    bits: int
    stats: tuple[tuple[int, ...], ...]

    def discounts(self, level: int) -> tuple[float, float, float]:
        _, _, n1, n2, n3, n4, *_ = self.stats[level - 1]
        if min(n1, n2, n3, n4) == 0:
            return FALLBACK
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        return found if all(0 < d <= i + 1 for i, d in enumerate(found)) else FALLBACK

    def odds(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(probability, occurrences of the token itself in training) at each place of t.at."""
        types, total, n1, n2, _, _, n3, _ = self.stats[0]
        grams = t.grams(self.order)
        n, raw = find(f"{self.folder}/grams1", self.bits, grams[0][t.at], 2)
        p = np.full(len(n), 1 / (types + 1))
        for level in range(1, self.order + 1):
            d1, d2, d3 = self.discounts(level)
            if level > 1:
                (n,) = find(f"{self.folder}/grams{level}", self.bits, grams[level - 1][t.at], 1)
                total, n1, n2, n3 = find(f"{self.folder}/context{level}", self.bits, grams[level - 2][t.at - 1], 4)
            less = n - np.array([0, d1, d2, d3])[np.minimum(n, 3)]
            with np.errstate(invalid="ignore", divide="ignore"):
                p = np.where(np.greater(total, 0), (less + (d1 * n1 + d2 * n2 + d3 * n3) * p) / total, p)
        return p, raw


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """The model of texts(text)."""
    if order < 2:
        raise ValueError("the counts below the highest order need an order of two or more")
    spark = texts.sparkSession
    folder = shared_dir(spark, "language-model")
    texts = texts.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (max(1, size) - 1) // SHARD_BYTES).bit_length()
    for level in range(1, order + 1):
        make_dir(f"{folder}/grams{level}")
        make_dir(f"{folder}/context{level}")
    rows = counted(texts, order, bits)
    for _ in range(order):
        rows = step(rows, folder, bits)
    stats = rows.filter("stats IS NOT NULL").select("kind", F.posexplode("stats").alias("i", "n")).groupBy("kind", "i").agg(F.sum("n")).collect()
    of = {(kind, i): n for kind, i, n in stats}  # eight counts for each level
    return Model(folder, order, bits, tuple(tuple(of[f"stats{level}", i] for i in range(8)) for level in range(1, order + 1)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs, without text, and with n_tokens, n_known, train_tokens, base_score and score."""
    kept = [c for c in docs.columns if c != "text"]
    types, *_, occurrences = model.stats[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in chunks(batch.column("__text"), model.order):
                p, raw = model.odds(t)
                first = np.append(0, t.ends[:-1])
                base = np.log10((raw + 1) / (occurrences + types + 1))
                sums = [np.add.reduceat(x, first) for x in (raw > 0, base, np.log10(p))] if b > a else []
                own = [batch.column(c).slice(a, b - a) for c in kept]
                numbers = [pa.array(np.diff(np.append(0, t.ends))), pa.array(sums[0].astype(np.int64)), pa.array(np.full(b - a, occurrences, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
                yield pa.RecordBatch.from_arrays([*own, *numbers], [*kept, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    types_of = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    text = F.coalesce("text", F.lit("")).cast("binary").alias("__text")
    return docs.select(*kept, text).mapInArrow(score, f"{types_of}n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def language_model_scores(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, fold: int = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text); the model learns from those not held out."""
    docs = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text")
    return scored(docs, train(docs.filter("NOT held_out"), order))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {"op13_language_model": op13_language_model}
#: The same for order two; a text's end is the word ' ', its start the word of two blanks.
ORACLES = {
    "op13_language_model": f"""WITH steps AS ({CRC32_STEPS_SQL}),
named AS (SELECT row_number() OVER () AS r, doc_id, text, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS h FROM documents),
d AS MATERIALIZED (SELECT r, doc_id, {crc32_sql('h')} % {FOLDS} = {HELD_OUT} AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') AS words FROM named, steps),
tokens AS MATERIALIZED (SELECT r, held_out, unnest(words) AS w, unnest(list_prepend('  ', words[:-2])) AS c FROM d),
pairs AS MATERIALIZED (SELECT c, w, count(*) AS n FROM tokens WHERE NOT held_out GROUP BY 1, 2),
singles AS MATERIALIZED (SELECT w, count(*) AS n, sum(n) AS raw FROM pairs GROUP BY 1),
totals AS MATERIALIZED (SELECT count(*) AS types, coalesce(sum(n), 0)::DOUBLE AS total, coalesce(sum(raw), 0)::BIGINT AS occurrences FROM singles),
counts AS (SELECT 2 AS level, n FROM pairs UNION ALL SELECT 1, n FROM singles),
once AS (SELECT level, count(*) FILTER (WHERE n = 1)::DOUBLE AS a, count(*) FILTER (WHERE n = 2)::DOUBLE AS b, count(*) FILTER (WHERE n = 3)::DOUBLE AS e, count(*) FILTER (WHERE n = 4)::DOUBLE AS f FROM counts GROUP BY 1),
tried AS (SELECT level, 1 - 2 * a / (a + 2 * b) * b / a AS d1, 2 - 3 * a / (a + 2 * b) * e / b AS d2, 3 - 4 * a / (a + 2 * b) * f / e AS d3, a * b * e * f > 0 AS enough FROM once),
discounts AS MATERIALIZED (SELECT level, CASE WHEN fit THEN [0, d1, d2, d3] ELSE [0, 0.5, 1, 1.5]::DOUBLE[] END AS d FROM
  (SELECT *, enough AND d1 > 0 AND d1 <= 1 AND d2 > 0 AND d2 <= 2 AND d3 > 0 AND d3 <= 3 AS fit FROM tried)),
left1 AS (SELECT sum(d[least(n, 3) + 1]) AS mass FROM singles, discounts WHERE level = 1),
left2 AS MATERIALIZED (SELECT c, sum(n)::DOUBLE AS total, sum(d[least(n, 3) + 1]) AS mass FROM pairs, discounts WHERE level = 2 GROUP BY 1),
low AS MATERIALIZED (SELECT w, raw, (n - d[least(n, 3) + 1] + mass / (types + 1)) / total AS p FROM singles, discounts, left1, totals WHERE level = 1),
high AS MATERIALIZED (SELECT c, w, n - d[least(n, 3) + 1] AS less FROM pairs, discounts WHERE level = 2),
scored AS (SELECT r, raw, coalesce(low.p, coalesce(left1.mass / totals.total, 1) / (types + 1)) AS p1, coalesce(less, 0) AS less, left2.mass AS mass, left2.total AS total
  FROM tokens t CROSS JOIN totals CROSS JOIN left1 LEFT JOIN low USING (w) LEFT JOIN high ON high.c = t.c AND high.w = t.w LEFT JOIN left2 ON left2.c = t.c),
sums AS (SELECT r, count(*) AS n_tokens, count(raw) AS n_known, occurrences AS train_tokens, sum(log10((coalesce(raw, 0) + 1) / (occurrences + types + 1))) AS base_score,
  sum(log10(CASE WHEN scored.total > 0 THEN (less + mass * p1) / scored.total ELSE p1 END)) AS score FROM scored, totals GROUP BY 1, 4)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM d JOIN sums USING (r)"""
}
