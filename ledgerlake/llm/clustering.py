"""Operator 11: centroid clustering over subvector dictionaries, in whole numbers.

A vector's components become integers. Each task deals its vectors into groups of GROUP and writes a group in dictionary-encoded form: the
dimensions are cut into blocks, the distinct subvectors of a block are listed once, and a vector is a code for each block. That loses nothing, and
each group takes the block width that leaves the least work: single dimensions where vectors hardly repeat, up to whole vectors where
they are copies. The encoded groups are a table in the shared folder, so the vectors are read once.

A round goes over that table. For each group the squared distances of its distinct subvectors to the centroids' blocks are computed
once, and a vector's distance is the sum of what its codes point at: whole numbers, so exact in any order. Sums for the new centroids come from counts by
code and cluster. A task returns one sum for each cluster and dimension, so what is shuffled depends on neither the vectors nor their
repetition, nothing but the centroids is sent out, and no dictionary of all the data is ever held in one place. A lost executor costs its groups of the round.

Kept are vectors of the right length whose components are all finite and below 2**17 in absolute value; beyond that, squared distances need not fit a long. Others
have no row. A null vec_id is hashed as an empty one; vectors that share a vec_id are vectors of their own, in the order of their components where
the hash ties. With fewer vectors than clusters each of them starts one. Sums over a cluster that fit no long are null. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import written

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Components from here on are not kept.
LARGEST = 2.0**17
#: Vectors of an encoded group.
GROUP = 16_384

_ENCODED = "ids array<long>, width int, starts binary, subvectors binary, codes binary"


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v): the vectors of vectors(vec_id, embedding) that count, as whole numbers."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LARGEST, F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return vectors.filter((F.size("embedding") == dimensions) & finite).select(F.col("vec_id").cast("long"), whole.alias("v"))


def encode(values: np.ndarray) -> tuple[int, np.ndarray, list[np.ndarray], np.ndarray]:
    """(width, starts, subvectors, codes) of the rows of values.

    subvectors has all blocks' distinct ones, those of block b from starts[b] on; codes has a row for each block and counts from starts[b].
    Pairs of neighbouring blocks are put together for as long as that leaves less to do.
    """
    n, width = values.shape[0], 1
    columns = [np.unique(c, return_index=True, return_inverse=True)[1:] for c in values.T]
    best = None
    while True:
        work = sum(len(first) for first, _ in columns) * width + n * len(columns)
        if best is None or work < best[0]:
            best = work, width, columns
        if len(columns) % 2:
            break
        pairs = zip(columns[::2], columns[1::2], strict=True)
        columns = [np.unique(a[1].astype(np.int64) * len(b[0]) + b[1], return_index=True, return_inverse=True)[1:] for a, b in pairs]
        width *= 2
    _, width, columns = best
    starts = np.cumsum([0, *[len(first) for first, _ in columns]]).astype(np.int32)
    subvectors = np.concatenate([values[first, b * width : (b + 1) * width] for b, (first, _) in enumerate(columns)])
    codes = np.stack([code.astype(np.int32) + s for (_, code), s in zip(columns, starts, strict=False)])
    return width, starts, subvectors, codes


class Group:
    """An encoded group, and what a round needs of it."""

    def __init__(self, width: int, starts: bytes, subvectors: bytes, codes: bytes):
        self.starts = np.frombuffer(starts, np.int32)
        self.subvectors = np.frombuffer(subvectors, np.int32).reshape(-1, width).astype(np.int64)
        self.codes = np.frombuffer(codes, np.int32).reshape(len(self.starts) - 1, -1)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, distance) of each vector."""
        width, k = self.subvectors.shape[1], len(centroids)
        parts = np.empty((len(self.subvectors), k), np.int64)
        for b, (s, e) in enumerate(zip(self.starts, self.starts[1:], strict=False)):
            for c in range(k):
                apart = self.subvectors[s:e] - centroids[c, b * width : (b + 1) * width]
                parts[s:e, c] = np.einsum("ij,ij->i", apart, apart)
        whole = sum(parts[code] for code in self.codes)
        cluster = whole.argmin(axis=1)
        return cluster, whole[np.arange(len(cluster)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """The sum of each cluster's vectors, from the counts of codes in it."""
        found = []
        for code, s, e in zip(self.codes, self.starts, self.starts[1:], strict=False):
            counts = np.bincount((code - s) * np.int64(k) + cluster, minlength=(e - s) * k).reshape(-1, k)
            found.append(counts.T @ self.subvectors[s:e])
        return np.concatenate(found, axis=1)


def encoded(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """The groups of kept() vectors, one row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, held = [], [], 0

        def group() -> pa.RecordBatch:
            width, starts, subvectors, codes = encode(np.concatenate(values))
            row = [pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([width], pa.int32())]
            return pa.RecordBatch.from_arrays([*row, *[pa.array([np.ascontiguousarray(x, np.int32).tobytes()]) for x in (starts, subvectors, codes)]], ["ids", "width", "starts", "subvectors", "codes"])

        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                if held + part.num_rows > GROUP:
                    yield group()
                    ids, values, held = [], [], 0
                ids.append(np.array(part.column("vec_id").to_pylist(), object))
                values.append(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
                held += part.num_rows
        if held:
            yield group()

    return vectors.mapInArrow(pack, _ENCODED)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, Group]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("ids")[i], Group(*[batch.column(c)[i].as_py() for c in ("width", "starts", "subvectors", "codes")])


def moved(groups: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: every non-empty one at the floor of its vectors' mean."""
    k, dimensions = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for _, group in _groups(batches):
            cluster, _ = group.nearest(centroids)
            n += np.bincount(cluster, minlength=k)
            total += group.sums(cluster, k)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    rows = groups.mapInArrow(add, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("d", "x"))
    new = [list(c) for c in centroids]
    for cluster, d, n, x in rows.groupBy("cluster", "d").agg(F.sum("n"), F.sum(F.col("x").cast("decimal(20,0)"))).collect():  # a row for each cluster and dimension
        new[cluster][d] = int(x) // n
    return np.array(new, np.int64)


def assigned(groups: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, group in _groups(batches):
            cluster, distance = group.nearest(centroids)
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return groups.mapInArrow(assign, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The kept() vectors with the least hashes of their ids."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in vectors.select("v", by.alias("h")).orderBy("h", "v").limit(clusters).collect()], np.int64)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept rows of vectors(vec_id, embedding)."""
    spark, whole = vectors.sparkSession, kept(vectors, dimensions)
    centroids = first_centroids(whole, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    groups = written(encoded(whole, dimensions), "clustering-groups")
    for _ in range(rounds):
        centroids = moved(groups, centroids)
    rows = written(assigned(groups, centroids), "clustering-assigned")
    sums = {c: int(d) for c, d in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    fitting = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    digests = [F.lit(sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()]
    return rows.select(
        "vec_id", "cluster", "distance", of([fitting(sums.get(c, 0)) for c in range(len(centroids))]).alias("cluster_inertia"),
        fitting(sum(sums.values())).alias("inertia"), of(digests).alias("centroid_sha256"),
    )


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op11_clustering": op11_clustering}


def _sql() -> str:
    parts = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS k, v AS c FROM v QUALIFY k < {CLUSTERS})"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min(ROW(d, k)) AS best FROM (SELECT r, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}) GROUP BY 1)""")
        if i < ROUNDS:
            parts.append(f"""n{i} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT best[2] AS k, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m
  FROM v JOIN a{i} USING (r), range(1, {DIMENSIONS} + 1) g(i) GROUP BY 1, 2) GROUP BY 1),
c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c)::BIGINT[] AS c FROM c{i} o LEFT JOIN n{i} n ON o.k = n.k)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM v JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} ON k = best[2]"""


ORACLES = {"op11_clustering": _sql()}
