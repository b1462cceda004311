import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from ledgerlake.llm import packing
from ledgerlake.llm.encoding import vocabulary


def plain_scores(docs, seed):
    """BM25 of every document for a seed's distinct terms."""
    n, mean = len(docs), max(1.0, np.mean([len(d) for d in docs]))
    out = np.zeros(n)
    for term in set(docs[seed].tolist()):
        df = sum(term in d for d in docs)
        idf = max(0.0, np.log((n - df + 0.5) / (df + 0.5)))
        for i, d in enumerate(docs):
            tf = int((d == term).sum())
            if tf:
                out[i] += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
    return out


def statistics(docs, terms=100):
    df = np.array([sum(t in d for d in docs) for t in range(terms)])
    return packing.idf(df, len(docs)), float(np.mean([len(d) for d in docs]))


def test_neighbours_are_those_of_plain_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60, rng.integers(0, 40)).astype("<u2") for _ in range(40)]
    docs[7] = docs[3].copy()
    index = packing.Index(docs, *statistics(docs))
    for seed in (0, 3, 7, 21):
        scores = plain_scores(docs, seed)
        ranked = index.neighbours(seed)
        # other documents with a positive score come by falling score; a seed's unique terms count for itself alone
        others = [d for d in ranked if d != seed]
        values = [scores[d] for d in others]
        assert all(a >= b - 1e-4 for a, b in zip(values, values[1:], strict=False))
    assert packing.Index([], np.zeros(5), 1.0).n == 0
    assert packing.Index([np.zeros(0, "<u2")] * 2, np.zeros(5), 0.0).neighbours(0).tolist() == [0, 1]


def test_windows_are_filled_with_the_best_unused_neighbours():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 60, rng.integers(5, 40)).astype("<u2") for _ in range(30)]
    weight, mean = statistics(docs)
    lengths, window = [len(d) for d in docs], 64
    got = list(packing.order(packing.Index(docs, weight, mean), lengths, window))
    free, want, room, seed = set(range(30)), [], 0, None
    while free:  # the same by plain scores
        if room == 0:
            pick = seed = min(free)
            room = window
        else:
            scores = plain_scores(docs, seed)
            pick = min(free, key=lambda d: (-round(scores[d], 4), d))
        free.discard(pick)
        want.append(pick)
        if lengths[pick] > room:
            seed, room = pick, -(lengths[pick] - room) % window
        else:
            room -= lengths[pick]
    assert got == want


def test_copies_and_near_copies_share_a_place():
    rng = np.random.default_rng(3)
    weight = rng.random(2000) * 8
    weight[:100] = 0
    race = packing._race(weight)
    docs = []
    for _ in range(200):
        ids = rng.integers(0, 2000, 200)
        near = ids.copy()
        near[:10] = rng.integers(0, 2000, 10)
        docs += [ids, ids[::-1].copy(), near]
    docs += [np.zeros(0, int), np.array([5, 6]), np.append(rng.integers(0, 2000, 900), docs[0])]
    ends = np.cumsum([len(d) for d in docs])
    found = packing.places(np.concatenate(docs), np.append(0, ends)[:-1], ends, race, 200)
    for d, got in zip(docs, found.tolist(), strict=True):
        own = race[:, d[-200:]]
        assert got == [int(d[-200:][j]) if own[p, j] < np.inf else -1 for p, j in enumerate(own.argmin(axis=1))] if len(d) else [-1] * 3
    assert (found[:600:3] == found[1:600:3]).all() and found[-1].tolist() == found[0].tolist()
    assert (found[:600:3, 0] == found[2:600:3, 0]).mean() > 0.75
    assert packing.places(np.zeros(0, "<u2"), np.zeros(0, int), np.zeros(0, int), race).shape == (0, 3)


def test_statistics_are_of_all_documents(spark):
    rows = [(i, "alpha beta" if i % 3 else "gamma") for i in range(50)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    encoded = packing._encoded(docs, vocabulary("word_bpe_49k.json"), "<u2")
    df, n, mean = packing._statistics(encoded, "<u2", 49_408)
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = [set(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert n == 51 and df.sum() == sum(map(len, ids)) and all(df[t] == sum(t in i for i in ids) for t in set.union(*ids))
    assert mean == sum(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows) / 51


def test_sequences_need_no_padding():
    for total in (0, 1, 2047, 2048, 2049, 5000, 12345):
        sizes = packing.sequences(total, 2048)
        assert sum(sizes) == total
        assert all(s == 2048 or s & (s - 1) == 0 for s in sizes)


def test_pieces_hold_each_id_once_and_follow_the_index(spark):
    rng = random.Random(1)
    texts = [None, "", "a", " ", "long " * 20_000, "end<|endoftext|>of"] + [" ".join(rng.choices(["alpha", "Beta", "gamma", "délta", "x1", "!!"], k=rng.randint(1, 900))) for _ in range(60)]
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts)] + [(8, texts[8], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(4)
    got = packing.pack(docs, vocabulary("word_bpe_49k.json"), 1, 256, 20).collect()
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {}
    for doc_id, text, _ in rows:
        ids[doc_id] = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) // 4
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
    assert set(by_doc) == set(ids)
    for doc_id, parts in by_doc.items():
        starts = sorted((p.start, p.length) for p in parts)
        copies = 2 if doc_id == 8 else 1
        assert sum(n for _, n in starts) == copies * len(ids[doc_id]) // 4
        if copies == 1:
            assert [s for s, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1].tolist()]
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1].tolist()]
        total = sum(p.length for p in parts)
        assert total == 256 or total & (total - 1) == 0
    assert packing.pack(docs.limit(0), vocabulary("word_bpe_49k.json"), 1).count() == 0
