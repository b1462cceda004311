import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from ledgerlake.llm import resampling as r

SCHEMA = "doc_id long, text string, source string, score string, n_words string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, percent, least_words, buckets, longest):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], target))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        h = int(sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(of(f)) for f in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    fit = sorted((x for x in rows if x[5] >= least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for i, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in rows), key=repr)


def run(spark, docs, target, percent=30, least_words=3, buckets=50, longest=1):
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], SCHEMA).repartition(3)
    got = r.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, least_words, buckets, longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(x) for x in got.collect()), key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma", "día", "x9", "İstanbul", "naïve", "Ünit", "42", "the"]
    made = [(int(i), " ".join(rng.choice(words, rng.integers(0, 30))) + rng.choice(["", ".", "--", "\n"])) for i in range(200)]
    made += [(None, "alpha beta gamma"), (None, "alpha beta gamma"), (None, None), (500, None), (501, ""), (502, "  ,;"), (7, "alpha alpha alpha alpha"), (503, "the " * 20_000)]
    return made + [(600, "alpha beta x9")] * 40  # ties in score and doc_id


@pytest.mark.parametrize(("percent", "longest"), [(0, 1), (10, 1), (77, 1), (30, 2)])
def test_rows_equal_a_plain_version(spark, docs, percent, longest):
    target = ["alpha beta día", None, "x9 x9 42", ""]
    assert run(spark, docs, target, percent, longest=longest) == plain(docs, target, percent, 3, 50, longest)


def test_cutoff_inside_rows_that_share_score_and_id(spark):
    docs = [(1, "a b c")] * 50 + [(None, "a b c")] * 50 + [(2, "a b d")]
    for percent in (40, 60):
        assert run(spark, docs, ["a"], percent) == plain(docs, ["a"], percent, 3, 50, 1)


def test_empty_tables(spark):
    assert run(spark, [], ["a"]) == []
    assert run(spark, [(1, "a b c d")], [], 100) == plain([(1, "a b c d")], [], 100, 3, 50, 1)


def test_least_number_that_enough_rows_do_not_exceed(spark):
    values = [-7, -7, 0, 3, 3, 3, 10**12]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r.least(rows, rows.v, n) for n in range(1, 8)] == sorted(values)
