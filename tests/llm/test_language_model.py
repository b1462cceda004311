import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerlake.llm import language_model as lm

SCHEMA = "doc_id long, text string, score string, held_out string, n_tokens int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))


def discounts(counts):
    n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
    if 0 in (n1, n2, n3, n4):
        return lm.FALLBACK
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 < x <= i + 1 for i, x in enumerate(d)) else lm.FALLBACK


def plain(docs, order):
    """The definition, by dictionaries of tuples."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    sequence = lambda t: ["<s>"] * (order - 1) + split(t) + ["</s>"]
    training = [sequence(t) for i, t in docs if not held(i)]
    raw = Counter(w for s in training for w in s[order - 1 :])
    N, V = raw.total(), len(raw)
    counts = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s in training for i in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: discounts(counts[k].values()) for k in counts}
    followers = {k: defaultdict(list) for k in counts}
    for k in counts:
        for g, c in counts[k].items():
            followers[k][g[:-1]].append(c)

    def p(gram):
        if not gram:
            return 1 / (V + 1)
        k, lower = len(gram), p(gram[1:])
        all_ = followers[k].get(gram[:-1])
        if not all_:
            return lower
        c = counts[k][gram]
        left = sum(d[k][min(x, 3) - 1] for x in all_)
        return ((c - d[k][min(c, 3) - 1] if c else 0) + left * lower) / sum(all_)

    rows = []
    for i, t in docs:
        s = sequence(t)
        at = range(order - 1, len(s))
        rows.append((
            i, held(i), len(at), sum(raw[s[j]] > 0 for j in at), N, sum(math.log10((raw[s[j]] + 1) / (N + V + 1)) for j in at),
            sum(math.log10(p(tuple(s[j - order + 1 : j + 1]))) for j in at),
        ))
    return sorted(rows, key=lambda r: (repr(r[:5]), r[6]))


def run(spark, docs, order):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], SCHEMA).repartition(3)
    got = lm.language_model_scores(df, order)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (repr(r[:5]), r[6]))


def same(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=0)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(3)
    words = np.array(["the", "The", "of", "naïve", "Ünit", "x,y", "dog.", "cat", "日本", "a", "b", "c", "runs", "und", "42", "İ"])
    odds = 1 / np.arange(1, len(words) + 1)
    made = [(i, " ".join(rng.choice(words, rng.integers(0, 25), p=odds / odds.sum()))) for i in range(150)]
    made += [(None, "the of the"), (None, None), (200, None), (201, ""), (202, " \t\n"), (203, "unseen words only"), (204, "\x0bthe\x0cdog.\r\nruns\x00 x"), (7, "the of"), (7, "the of")]
    made += [(300 + i, "one common line of text") for i in range(60)] + [(400, "the of " * 30_000), (401, "w" * 100_000), (402, "the" + " " * 50_000 + "of")]
    return made


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_the_definition(spark, docs, monkeypatch, order):
    monkeypatch.setattr(lm, "SHARD_BYTES", 60_000)
    monkeypatch.setattr(lm, "GATHER", 5_000)
    same(run(spark, docs, order), plain(docs, order))


def test_one_shard_nothing_to_learn_from_and_no_rows(spark):
    few = [(i, "a b a c") for i in range(20)]
    same(run(spark, few, 2), plain(few, 2))
    out = [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    same(run(spark, out, 2), plain(out, 2))
    assert run(spark, [], 2) == []


def test_odds_of_all_tokens_add_up_to_one(spark, docs):
    model = lm.train(spark.createDataFrame([(t,) for _, t in docs], "text string"), 3)
    vocabulary = sorted({w for _, t in docs for w in split(t)})
    for before in ("the of", "", "unseen the", "cat unseen"):
        texts = [f"{before} {w}".encode() for w in [*vocabulary, "never-seen"]] + [before.encode()]
        ((_, _, t),) = lm.chunks(pa.array(texts, pa.binary()), 3)
        p, _ = model.odds(t)
        last = p[t.ends[:-1] - 2].sum() + p[t.ends[-1] - 1]  # the word after `before`, and the end in its place
        assert abs(last - 1) < 1e-9


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_words_of_texts_have_equal_hashes_wherever_they_are(monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    texts = ["", "Alpha beta\tALPHA", "beta", "  ", "alphabeta alpha", "γάμμα Γάμμα", "beta" * 500 + " beta"]
    found, names = [], {}
    for a, b, t in lm.chunks(pa.array([x.encode() for x in texts], pa.binary()).slice(1), 2):
        words = [[*split(x), None] for x in texts[1:][a:b]]
        assert list(t.ends) == list(np.cumsum([len(w) for w in words]))
        for w, h in zip([w for ws in words for w in ws], t.sequence[t.at].tolist(), strict=True):
            assert names.setdefault(w, h) == h
            found.append(w)
    assert len(set(names.values())) == len(names) and len(found) == sum(len(split(x)) + 1 for x in texts[1:])


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    sf = "/root/testdata/sf0.01"
    rows = lm.op13_language_model(spark, sf).filter("held_out AND n_tokens > 50").collect()
    assert rows and sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)
