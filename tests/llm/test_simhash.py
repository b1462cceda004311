import random
import re

import numpy as np
import xxhash

from ledgerlake.llm import simhash


def plain_fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows, distance=2):
    """component of every row by comparing all pairs of fingerprints."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) for i in range(len(rows))]


TEXTS = [None, "", " \t\n", "one", "One", "one two", "a b c", "A  B\nC", "É é Ñ", "é é ñ", "x y z w", "word " * 9000, "ünï côde " * 50]


def test_fingerprint_equals_the_plain_one():
    for text in TEXTS:
        assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def check_links(spark, prints, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    df = spark.createDataFrame([(signed(p),) for p in sorted(prints)], "fp long")
    found = simhash.components(simhash.links(df)).collect()
    roots = {r.node % 2**64: r.root for r in found}
    prints = sorted(prints)
    plain = plain_classes([(i, p) for i, p in enumerate(prints)])
    ours = [roots.get(p, signed(p)) for p in prints]
    assert len(set(zip(plain, ours, strict=True))) == len(set(plain)) == len(set(ours))


def test_links_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])))
            prints.add(centre)
    check_links(spark, prints, monkeypatch, 64)
    check_links(spark, prints, monkeypatch, 1)  # every shared segment value goes by points


def test_classes_with_odd_rows(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (None, "only here " * 3), (3, "one")]
    for i in range(20):
        words = list(base)
        words[i * 7] = "changed"
        rows.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, fp string").repartition(3)
    got = sorted(((r.doc_id is not None, r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.classes(docs.select("doc_id", "text")).collect()), key=str)
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    want = sorted(((d is not None, d, p, c) for (d, p), c in zip(prints, plain_classes(prints), strict=True)), key=str)
    assert got == want


def test_near_dedup_judges_rows_not_ids(spark):
    a, c = "one two three four five six seven eight nine ten", "an unlike text that stands only once in this little table"
    rows = [(1, a), (5, a), (5, c), (None, a), (None, None), (2, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(3)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, a), (2, ""), (5, c)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(docs).count() == 0
    assert simhash.near_dedup(docs).count() == 0
    assert np.uint64(0) == simhash.fingerprint(None)
