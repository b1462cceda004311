import random

import corpus_pipeline
from ledgerlake.llm import near_copies, simhash


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def changed(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return " ".join(words)


def test_no_near_copy_stays_and_nothing_else_goes(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    common = " ".join(rng.choices(vocabulary, k=30))
    bases = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 200))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(bases)]
    for base in bases[:20]:  # one changed word spoils five shingles
        rows += [(len(rows) + j, changed(rng, base, j)) for j in range(5)]
    rows += [(1000 + j, changed(rng, bases[0], 1)) for j in range(60)]
    rows += [(2000 + j, common + " " + " ".join(rng.choices(vocabulary, k=40))) for j in range(30)]
    rows += [(None, None), (3000, ""), (3001, " "), (7, "another text of the same id"), (3002, "One two"), (3003, "one  two"), (3004, "one two three")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, node string").repartition(3)
    for hot in (64, 2):
        monkeypatch.setattr(near_copies, "HOT", hot)
        monkeypatch.setattr(near_copies, "PART", 1)
        kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
        assert kept.columns == docs.columns
        kept = [(r.doc_id, r.text) for r in kept.collect()]
        assert set(kept) <= set(rows) and len(kept) == len(set(kept))
        assert not any(similar(a[1], b[1]) for i, a in enumerate(kept) for b in kept[:i])
        alone = [r for i, r in enumerate(rows) if not any(similar(r[1], o[1]) for j, o in enumerate(rows) if j != i)]
        assert set(alone) <= set(kept) and (7, "another text of the same id") in kept
        assert 30 + 30 <= len(kept) < len(rows) - 60


def test_near_copies_of_an_empty_table(spark):
    assert simhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_meaning_in_chains_whatever_the_sizes_of_groups(spark, monkeypatch):
    rng = random.Random(9)
    texts = []
    for _ in range(6):  # A like B, B like C, C like D; A not like C
        text = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))
        for _ in range(4):
            texts.append(text)
            text = changed(rng, text, 5)
    passage = " ".join(f"p{i}" for i in range(200))
    texts += [changed(rng, passage, n) for n in range(1, 7) for _ in range(6)]
    name = lambda t: int.from_bytes(near_copies._name(near_copies.shingle_set(t)).to_bytes(8, "big"), "big", signed=True)
    stay = []
    for text in sorted(texts, key=name):
        if not any(similar(text, other) for other in stay):
            stay.append(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for hot in (1, 4, 10**9):
        monkeypatch.setattr(near_copies, "HOT", hot)
        monkeypatch.setattr(near_copies, "PART", 1)
        assert sorted(r.text for r in simhash.near_dedup(docs).collect()) == sorted(stay)
    assert 6 < len(stay) < len(texts)
