"""Operator 5: lexical retrieval packing with a sharded BM25 inverted index.

Terms are token ids. Texts are encoded once and their ids written to the shared folder; document frequencies, the number of
documents and their mean length are then counted over all of them, so every shard weighs its terms alike. Documents are dealt into shards
by content: a document's place is a row of three terms, each drawn from the terms of its last window by a weighted min-hash, so two
documents share a place the more likely the more idf weight their terms have in common, and copies always do. (Windows before
the last one of a long document hold nothing else, so it is the last one that needs neighbours.) Documents are put in
order of their places and cut into shards of at most SHARD_DOCS documents and about SHARD_IDS ids. A frequent place, such as
that of many copies, is spread over shards by a hash of the document.

A shard's task keeps an inverted index of its documents. A window's seed is the first unused document of the shard, the index returns
the unused neighbours of the seed by falling BM25 score, and they fill the window one after another. A document that does not
fit whole is cut at the window's end and its rest begins the next window, whose neighbours are those of that document. So all
windows of a shard but the last are full, and the last is cut into sequences whose lengths are powers of two, which need no padding.

A term that stands in half of all documents or more has idf zero, as usual for BM25, and a term of one document of the
shard cannot score for another, so neither has postings. Documents without a common term follow by their order in the shard.

Null and empty texts are the end id alone. Rows that share a doc_id are packed one by one; a null doc_id is packed like any
other. An empty table gives no pieces. sequence_id is unique in the table: the number of the task times 2**32, plus the place in
its shards. Which documents meet in a shard depends on the ranges that Spark draws, so sequences may differ where the input is
partitioned in another way. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import documents, written
from ledgerlake.llm.encoding import encoder, vocabulary

WINDOW = 2048
SHARD_DOCS = 512
SHARD_IDS = 4 << 20
#: Terms of a document's place.
PLACES = 3
K1, B = 1.2, 0.75


def idf(df: np.ndarray, n: int) -> np.ndarray:
    """BM25's inverse document frequency; 0 for a term of half of the n documents or more."""
    return np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))


def distinct(docs: list[np.ndarray], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, count) of the distinct ids of each document, in that order; all ids are below terms."""
    sizes = [len(d) for d in docs]
    wide = np.uint32 if len(docs) * terms < 1 << 32 else np.uint64
    key = np.repeat(np.arange(len(docs), dtype=wide) * wide(terms), sizes) + (np.concatenate(docs).astype(wide) if docs else np.zeros(0, wide))
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    count = np.diff(np.append(first, len(key)))
    doc, ids = np.divmod(key[first], wide(terms))
    return doc.astype(np.int32), ids.astype(np.int64), count


class Index:
    """BM25 postings of a shard: for each term the documents that hold it and what each adds for one query occurrence."""

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray, mean: float):
        """weight is the idf of each id, mean the mean length, both over all documents of all shards."""
        self.n = len(docs)
        doc, ids, count = distinct(docs, len(weight))
        df = np.bincount(ids, minlength=len(weight))
        keep = ((df > 1) & (weight > 0))[ids]
        ids, doc, count = ids[keep], doc[keep], count[keep]
        held = np.flatnonzero(np.bincount(ids, minlength=len(weight)))
        number = np.zeros(len(weight), np.uint32)
        number[held] = np.arange(len(held))
        term = number[ids]
        length = np.array([len(d) for d in docs], np.float64)
        norm = K1 * (1 - B + B * length / max(1.0, mean))
        # numbers of 16 bits are sorted in linear time
        order = np.argsort(term.astype(np.uint16) if len(held) <= 1 << 16 else term, kind="stable")
        self.post_doc = doc[order]
        tf = count[order]
        self.post_weight = (weight[ids[order]] * tf * (K1 + 1) / (tf + norm[self.post_doc])).astype(np.float32)
        self.start = np.append(0, np.cumsum(df[held]))
        #: The terms of each document that have postings.
        self.query_start = np.searchsorted(doc, np.arange(self.n + 1))
        self.query_term = term

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents by falling score for the seed's terms, ties by place; those without a common term last."""
        terms = self.query_term[self.query_start[seed] : self.query_start[seed + 1]]
        first, last = self.start[terms], self.start[terms + 1]
        size = last - first
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
        score = np.bincount(self.post_doc[at], self.post_weight[at], self.n)
        return np.argsort(-score, kind="stable")


def order(index: Index, lengths: list[int], window: int) -> Iterator[int]:
    """The documents in the order in which they fill windows one after another."""
    free = np.ones(index.n, bool)
    room, ranked, at, first = 0, None, 0, 0
    for _ in range(index.n):
        if seeds := room == 0:
            while not free[first]:
                first += 1
            pick, room = first, window
        else:
            while not free[ranked[at]]:
                at += 1
            pick = int(ranked[at])
        free[pick] = False
        yield pick
        over = lengths[pick] - room
        room = -over if over <= 0 else -over % window
        if room and (seeds or over > 0):  # the document that begins the window now open is its seed
            ranked, at = index.neighbours(pick), 0


def sequences(total: int, window: int) -> list[int]:
    """Lengths of the sequences of a shard: full windows, then powers of two."""
    rest = total % window
    return [window] * (total // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(ids: list[np.ndarray], weight: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, start, length, crc32, sequence, offset) of each piece of a shard's documents; the last id of each is its end id."""
    lengths = [len(d) for d in ids]
    sizes, seq, offset = sequences(sum(lengths), window), 0, 0
    for d in order(Index([i[:-1] for i in ids], weight, mean), lengths, window):
        raw, start = ids[d].astype("<u4").tobytes(), 0
        while start < lengths[d]:
            n = min(lengths[d] - start, sizes[seq] - offset)
            yield d, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), seq, offset
            start, offset = start + n, offset + n
            if offset == sizes[seq]:
                seq, offset = seq + 1, 0


def _encoded(docs: DataFrame, tokenizer: str, kind: str) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text), without end ids, as a table in the shared folder."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(tokenizer)
        for batch in batches:
            ids = [np.frombuffer(encode.ids(t.as_py()), "<u4").astype(kind).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary"), "packing-ids")


def _statistics(encoded: DataFrame, kind: str, terms: int) -> tuple[np.ndarray, int, float]:
    """(document frequency of each id, documents, mean length): a row of the vocabulary for each task, then their sums."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        df, n, total = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            own = [np.frombuffer(ids.as_py(), kind) for ids in batch.column(0)]
            df += np.bincount(distinct(own, terms)[1], minlength=terms)
            n, total = n + len(own), total + sum(map(len, own))
        at = np.append(np.flatnonzero(df), [-1, -2])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.append(df[at[:-2]], [n, total]), pa.int64())], names=["term", "n"])

    # a row for each id of the vocabulary at most, and two more
    rows = encoded.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(rows["term"].tolist(), rows["n"].tolist(), strict=True))
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(terms, np.int64)
    df[list(found)] = list(found.values())
    return df, n, total / max(1, n)


def _race(weight: np.ndarray) -> np.ndarray:
    """For each place a number for each id: an id of greater weight has the least number of a document more often."""
    draws = np.random.default_rng(11).exponential(size=(PLACES, len(weight)))
    with np.errstate(divide="ignore"):
        return np.where(weight > 0, draws / weight, np.inf)


def places(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, race: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The terms that documents values[start:end] draw, a row each; -1 for one without any term that has weight."""
    spans = np.stack([np.maximum(starts, ends - window), ends], axis=1).ravel()
    found = np.full((len(starts), len(race)), -1, np.int64)
    for p, numbers in enumerate(race):
        least = np.minimum.reduceat(np.append(numbers[values], np.inf), spans)[::2] if len(starts) else np.zeros(0)
        by = np.argsort(numbers)
        drawn = by[np.minimum(np.searchsorted(numbers, least, sorter=by), len(by) - 1)]
        found[:, p] = np.where((least < np.inf) & (ends > starts), drawn, -1)
    return found


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The pieces of docs(doc_id, text), packed into sequences of at most window ids."""
    terms = max(end_id + 1, encoder(tokenizer).size)
    kind = "<u2" if terms <= 1 << 16 else "<u4"
    encoded = _encoded(docs, tokenizer, kind)
    df, n, mean = _statistics(encoded, kind, terms)
    weight = docs.sparkSession.sparkContext.broadcast(idf(df, n))

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        race = _race(weight.value)
        for batch in batches:
            texts = [i.as_py() for i in batch.column(1)]
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64) // np.dtype(kind).itemsize
            found = places(np.frombuffer(b"".join(texts), kind), np.append(0, ends)[:-1][: len(texts)], ends, race, window)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in found.T)], names=["doc_id", "ids", "p0", "p1", "p2"])

    rows = encoded.mapInArrow(placed, "doc_id long, ids binary, p0 long, p1 long, p2 long")
    by = ["p0", "p1", "p2", "salt"]
    rows = rows.withColumn("salt", F.xxhash64("doc_id", "ids"))
    dealt = rows.repartitionByRange(_tasks(docs.sparkSession), *by).sortWithinPartitions(*by, "doc_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, end, own = TaskContext.get().partitionId() << 32, np.array([end_id], kind), weight.value
        names, first = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], 0
        keys: list[int | None] = []
        texts: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            found = np.array(list(pieces(texts, own, mean, window)), np.int64).reshape(-1, 6)
            at = found[:, 0]
            columns = [pa.array([keys[d] for d in at.tolist()], pa.int64()), *(pa.array(found[:, c], pa.int64()) for c in (1, 2, 3))]
            columns += [pa.array(np.array([len(t) for t in texts], np.int64)[at]), pa.array(found[:, 4] + (task + first)), pa.array(found[:, 5])]
            first += int(found[-1, 4]) + 1
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(key)
                texts.append(np.append(np.frombuffer(ids.as_py(), kind), end))
                held += len(texts[-1])
                if len(keys) >= shard_docs or held >= SHARD_IDS:
                    yield packed()
                    keys, texts, held = [], [], 0
        if keys:
            yield packed()

    return dealt.select("doc_id", "ids").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text"), vocabulary("word_bpe_49k.json"), 1)


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
