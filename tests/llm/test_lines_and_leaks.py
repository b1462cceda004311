import itertools
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate, licenses, line_dedup

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


# line deduplication


def plain_lines(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if len(key) >= min_chars:
                holders[key].add(-(1 << 63) if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        own = -(1 << 63) if doc_id is None else doc_id
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders[k := lower(x.strip(SPACE))]) >= min_docs and own < max(holders[k]))]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_equals_the_plain_version(spark):
    rng = random.Random(1)
    common = ["Shared line number %d that is long enough to count for something" % i for i in range(6)] + ["ÄÖÜ É line with letters beyond ascii, long enough to count", "short"]
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, common[0]), (3, common[0]), (None, common[0] + "\n" + common[1])]
    for i in range(10, 60):
        lines = [rng.choice([x, x.upper() if x.isascii() else x, f"  {x}\t", x.replace("É", "é")]) for x in rng.sample(common, rng.randint(0, 6))]
        lines += [lines[0]] * rng.randint(0, 2) if lines else []
        lines.insert(rng.randint(0, len(lines)), f"own line of document {i}, which is long enough as well, but is not shared")
        rows.append((i, "\n".join(lines)))
    rows.append((90, "x" * 60_000 + "\n" + common[2]))
    docs = spark.createDataFrame([(a, b, "e", len(b or "")) for a, b in rows], "doc_id long, text string, h1 string, n_chars long").repartition(3)
    got = line_dedup.deduplicated(docs)
    got = [(r.doc_id, len(r["__lines"]), len(r["__lines"]) - len(r["__kept"]), "\n".join(r["__kept"])) for r in got.collect()]
    assert sorted(got, key=str) == sorted(plain_lines(rows), key=str)
    out = line_dedup.without_repeats(docs)
    assert out.columns == ["doc_id", "text", "h1", "n_chars"]
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None and r.doc_id != 3}
    assert texts == {d: t for d, _, _, t in plain_lines(rows) if d is not None and d != 3}


def test_line_dedup_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.deduplicated(docs).count() == 0


def test_runs_are_compacted_by_level(spark):
    runs = line_dedup.LineRuns(spark, 2)
    for last in (40, 30, 20, 10):
        rows = [(1, 1, last, 2)] + [(last, 0, last, 1)]
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, last_doc long, n_docs long"))
    assert list({k: len(v) for k, v in runs.levels.items() if v}.items()) == [(2, 1)]
    merged = {r.h1: (r.last_doc, r.n_docs) for r in runs.compacted().collect()}
    assert merged == {1: (40, 8), 40: (40, 1), 30: (30, 1), 20: (20, 1), 10: (10, 1)}
    assert runs.unseen(spark.createDataFrame([(1, 1), (5, 5)], "h1 long, h2 long")).collect()[0].h1 == 5
    runs.close()


# decontamination


def plain_overlaps(rows, bench):
    """Every offset of every item, without seeds: those must lose nothing."""
    found = {}
    for item_id, item in bench:
        if not (a := words(item)):
            continue
        for doc_id, text in rows:
            b = words(text)
            for at in range(-len(a) + 1, len(b)):
                same = [int(0 <= at + j < len(b) and b[at + j] == a[j]) for j in range(len(a))]
                width = min(len(a), 20)
                if max(sum(same[s : s + width]) for s in range(len(a) - width + 1)) >= (width if width < 10 else -(-width * 8 // 10)):
                    best = (sum(same), -max(at, 0), len(a))
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), best), best)
    return {(d, i, w, n, -f) for (d, i), (n, f, w) in found.items()}


def test_masks_fit_between_all_replaced_words():
    for length in range(10, 21):
        spots = [{at + i for i, c in enumerate(m) if c == "1"} for m in decontaminate.MASKS for at in range(length - len(m) + 1)]
        for replaced in itertools.combinations(range(length), length - -(-length * 8 // 10)):
            assert any(not spot & set(replaced) for spot in spots)


def test_overlaps_equal_the_plain_version(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(60)] + ["the", "of", "é"]
    bench = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate((40, 30, 22, 15, 12, 10, 9, 5, 0))]
    bench += [(20, None), (21, "one two three"), (22, "pair wise"), (23, "single"), (0, "another text of an item id " * 3), (24, bench[2][1])]
    rows = [(None, None), (1, ""), (2, "few words"), (3, "a one two three b"), (4, "pair, wise!"), (5, "a single word"), (6, "two three one"), (6, bench[0][1]), (6, "x " + bench[1][1])]
    for d in range(10, 50):
        item = (bench[d % 8][1] or "").split()
        changed = [w if rng.random() > 0.08 * (d % 4) else "new" for w in item][: rng.choice([len(item), 25])]
        own = rng.choices(vocabulary, k=30)
        rows.append((d, " ".join(own[:15] + changed + own[15:]).upper() if d % 3 else " ".join(changed)))
    rows += [rows[5], (None, bench[3][1]), (None, "clean text without an id")]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, item_id string").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = plain_overlaps(rows, bench)
    assert len(want) > 20
    for limit, order in ((500_000, F.col("doc_id")), (0, F.desc("text"))):  # with and without broadcasts, in other orders
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
        got = [tuple(r) for r in decontaminate.overlaps(docs.select("doc_id", "text").orderBy(order), items).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    left = decontaminate.decontaminated(docs, items)
    assert left.columns == docs.columns
    clean = [(d, t) for d, t in rows if not plain_overlaps([(d, t)], bench)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(clean, key=str)
    assert (6, "two three one") in clean
    assert decontaminate.overlaps(docs.select("doc_id", "text").limit(0), items).count() == 0
    assert decontaminate.overlaps(docs.select("doc_id", "text"), items.limit(0)).count() == 0


# licenses


def plain_base(text):
    w = words(text)
    at = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
    starts = [p for p, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit"][1]
    broken = mit.split()
    broken[7:8] = ["very", "new"]
    texts = [
        None, "", "cc", "cc by", "CC-BY cc by. General Public License; all rights reserved", "general public general public license", "cc cc by by",
        "É licence: Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", f"words before {mit} and after", " ".join(broken), "all rights " * 3000 + "reserved",
        "permission is hereby granted and nothing else", "released under the same terms",
        # every trigram of the template, each beside a filler word
        " filler ".join(" ".join(mit.split()[i : i + 3]) for i in range(len(mit.split()) - 2)),
    ]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "cc by", "x"), (3, "cc by", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(3)
    got = licenses.scan(docs.select("doc_id", "text")).collect()
    base = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)
    assert base == sorted(((d, *plain_base(t)) for d, t, _ in rows), key=str)
    by = {r.doc_id: r for r in got}
    assert by[4].labels == "cc-by,gpl,reserved" and by[4].score == 1
    assert by[7].labels == "mit" and by[8].labels == "apache-2.0" and by[9].labels == "mit" and by[10].labels == "mit"
    assert by[12].labels == "" and 0 < by[12].score < 0.7
    assert by[14].labels == "" and 0 < by[14].score < 0.7
    assert all(0 <= r.score <= 1 for r in got)
    assert licenses.scan(docs.select("doc_id", "text").limit(0)).count() == 0


def plain_labels(text, templates):
    """Labels and score by votes kept in plain lists; base phrases count where they stand."""
    w, labels, best = words(text), set(), 0.0
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        if any(w[i : i + len(p)] == p for i in range(len(w))):
            labels.add(label)
            best = 1.0
    for label, template in templates:
        t = words(template)
        grams = max(1, len(t) - 2)
        votes = sorted((pos - at, pos, at) for pos in range(len(w) - 2) for at in range(len(t) - 2) if w[pos : pos + 3] == t[at : at + 3])
        spans, last = [], None
        for diagonal, _, at in votes:
            if last is None or diagonal - last > licenses.DRIFT:
                spans.append([])
            spans[-1].append((diagonal, at))
            last = diagonal
        most = licenses.DRIFT * max(1, int((1 - licenses.COVERAGE) * grams) // 2)
        bands = {}
        for i, span in enumerate(spans):
            for diagonal, at in span:
                for shift in (0, most):
                    bands.setdefault((i, shift, (diagonal + shift) // (2 * most)), set()).add(at)
        for span in bands.values():
            best = max(best, len(span) / grams)
            if len(span) / grams >= licenses.COVERAGE:
                labels.add(label)
    return ",".join(sorted(labels)), round(best, 4)


def test_votes_and_merged_diagonals_equal_plain_lists(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(25)] + ["cc", "by", "é"]
    whole = " ".join(rng.choices(vocabulary, k=400))
    templates = [("long-1.0", whole), ("short", " ".join(rng.choices(vocabulary, k=9))), ("short", "two words"), ("echo", "w1 w2 " * 6), ("empty", None)]
    rows = []
    for i in range(40):
        part = whole.split() if i % 2 else templates[1 + i % 4 // 3][1].split()
        kept = [x for x in part if rng.random() > 0.02 * (i % 6)]
        for _ in range(i % 4):
            kept.insert(rng.randrange(len(kept) + 1), "inserted")
        rows.append((i, " ".join(rng.choices(vocabulary, k=20) + kept + rng.choices(vocabulary, k=20) + (["w1", "w2"] * (i % 5)))))
    rows += [(90, None), (91, ""), (None, whole)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(templates + [templates[0]], "label string, text string")
    want = sorted(((d, *plain_labels(t, templates)) for d, t in rows), key=str)
    assert {"long-1.0", "short", "echo"} <= {x for _, labels, _ in want for x in labels.split(",")}
    for limit in (500_000, 0):
        monkeypatch.setattr(licenses, "BROADCAST_ROWS", limit)
        got = sorted(((r.doc_id, r.labels, r.score) for r in licenses.scan(docs, table).collect()), key=str)
        assert got == want
    assert all(r.labels == "" for r in licenses.scan(docs.filter("doc_id = 90"), table.limit(0)).collect())
