import math
from hashlib import sha256

import numpy as np
import pytest

from ledgerlake.llm import clustering as c

SCHEMA = "vec_id long, embedding array<double>, label string, cluster string"


def plain(rows, clusters, rounds, dimensions):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v)]
    key = lambda r: (sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), k) for k, x in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, at) in zip(kept, to, strict=True) if at == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    to = assign()
    inertia = [sum(d for d, at in to if at == k) for k in range(len(centroids))]
    sha = [sha256(",".join(map(str, x)).encode()).hexdigest() for x in centroids]
    return sorted([(i, k, d, inertia[k], sum(inertia), sha[k]) for (i, _), (d, k) in zip(kept, to, strict=True)], key=repr)


def run(spark, rows, clusters=3, rounds=4, dimensions=4):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    got = c.clustered(df, clusters, rounds, dimensions=dimensions)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(x) for x in got.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    made = [(i, (rng.normal(size=4) * 0.1 + rng.integers(-1, 2)).tolist()) for i in range(120)]
    made += [(1000 + i, [0.25, -0.25, 0.5, 0.0]) for i in range(80)]  # copies
    made += [(7, [1.0, 2.0, 3.0, 4.0]), (7, [4.0, 3.0, 2.0, 1.0]), (None, [0.1, 0.1, 0.1, 0.1]), (None, [9e4, -1.3e5, 0.0, 1.0])]
    return made + [(2000, None), (2001, []), (2002, [1.0]), (2003, [0.0, None, 0.0, 0.0]), (2004, [float("nan"), 0.0, 0.0, 0.0]), (2005, [0.0, float("-inf"), 0.0, 0.0]), (2006, [2.0**17, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("group", [7, 16_384])
def test_rows_equal_a_plain_version(spark, rows, monkeypatch, group):
    monkeypatch.setattr(c, "GROUP", group)
    assert run(spark, rows) == plain(rows, 3, 4, 4)


def test_few_and_no_vectors(spark):
    few = [(1, [0.0, 0.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.0, 0.0])]
    assert run(spark, few, clusters=5) == plain(few, 5, 4, 4)
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []


@pytest.mark.parametrize(("distinct", "copies", "span", "best"), [(40, 50, 2**27, 8), (2000, 1, 2, 4), (2000, 1, 100, 1)])
def test_encoding_loses_nothing_and_takes_the_width_with_the_least_work(distinct, copies, span, best):
    rng = np.random.default_rng(1)
    values = np.repeat(rng.integers(-span, span, (distinct, 8)), copies, axis=0)
    rng.shuffle(values)
    width, starts, subvectors, codes = c.encode(values)
    assert np.array_equal(np.concatenate([subvectors[x] for x in codes], axis=1), values)
    assert width == best and len(starts) == 8 // width + 1
    centroids = rng.integers(-(2**27), 2**27, (5, 8))
    group = c.Group(width, *[np.ascontiguousarray(x, np.int32).tobytes() for x in (starts, subvectors, codes)])
    cluster, distance = group.nearest(centroids)
    whole = ((values[:, None, :] - centroids) ** 2).sum(axis=2)
    assert np.array_equal(cluster, whole.argmin(axis=1)) and np.array_equal(distance, whole.min(axis=1))
    assert np.array_equal(group.sums(cluster, 5), np.stack([values[cluster == k].sum(axis=0) for k in range(5)]))
