import random

from pyspark.sql import functions as F

from ledgerlake.operators.metrics import by_fold, folds
from ledgerlake.plans import joins, mining


def test_scores_of_folds(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.choice("abc"), rng.choice("abcd")) for _ in range(300)]
    got = {r.fold: r for r in by_fold(spark.createDataFrame(rows, "fold int, y string, g string"), "fold", "y", "g").collect()}
    want = []
    for k in range(3):
        part = [(y, g) for f, y, g in rows if f == k]
        f1, support = {}, {}
        for c in {x for p in part for x in p}:
            tp, either = sum(p == (c, c) for p in part), sum(c == y for y, _ in part) + sum(c == g for _, g in part)
            f1[c], support[c] = 2 * tp / either, sum(c == y for y, _ in part)
        want.append((sum(y == g for y, g in part) / len(part), sum(f1.values()) / len(f1), sum(f1[c] * support[c] for c in f1) / len(part)))
        assert all(abs(a - b) < 1e-9 for a, b in zip(want[k], (got[k].accuracy, got[k].macro_f1, got[k].weighted_f1), strict=True))
    assert abs(got[None].macro_f1 - sum(w[1] for w in want) / 3) < 1e-9 and got[None].n == 300


def test_groups_stay_whole_in_folds(spark):
    rows = spark.createDataFrame([(g,) for g in range(40) for _ in range(g % 7 + 1)], "g int")
    dealt = folds(rows, "g").collect()
    assert len(dealt) == 40 and {r.fold for r in dealt} == set(range(5))
    sizes = [sum(r.n for r in dealt if r.fold == k) for k in range(5)]
    assert max(sizes) - min(sizes) <= 7


def test_terms_are_sparse_and_embeddings_keep_angles(spark):
    rng = random.Random(5)
    words = ["interface", "address", "router", "logging", "server", "password", "enable", "banner", "access", "list"]
    texts = [" ".join(rng.choices(words, k=6)) for _ in range(60)] + [""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    assert mining.term_counts(rows.filter("id = 0"), F.col("text"), 8192).first().tf.toArray().size == 8192
    assert type(mining.term_counts(rows.filter("id = 0"), F.col("text"), 8192).first().tf).__name__ == "SparseVector"
    terms = {r.id: r.vector.toArray() for r in mining.tfidf(rows, F.col("text"), 256).collect()}
    made = {r.id: r.vector for r in mining.embedded(rows, "text", 256, 64).collect()}
    assert len(made) == 61 and all(len(v) == 64 for v in made.values())
    for v in made.values():
        assert abs(sum(x * x for x in v) - 1) < 1e-6 or not any(v)
    for a in range(0, 60, 7):
        for b in range(60):
            assert abs(sum(x * y for x, y in zip(made[a], made[b], strict=True)) - float(terms[a] @ terms[b])) < 0.1


def test_held_out_rows_are_told_apart(spark):
    rows = mining.tfidf_line_classifier(spark, "/root/testdata/sf0.001").filter("held_out").collect()
    share = sum(r.label == r.prediction for r in rows) / len(rows)
    usual = max(sum(r.label == k for r in rows) for k in (0.0, 1.0)) / len(rows)
    assert share >= usual - 0.05


def test_pairs_of_a_network_leave_their_join_without_a_shuffle(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(60), rng.choice([1, 1, 1, rng.randrange(12), None])) for _ in range(200)] + [(None, 1)]
    found = joins.adjacent_pairs(spark.createDataFrame(rows, "device long, network long").repartition(3))
    of = {}
    for d, n in rows:
        if d is not None and n is not None:
            of.setdefault(d, set()).add(n)
    want = sorted((a, b, min(of[a] & of[b])) for a in of for b in of if a < b and of[a] & of[b])
    assert sorted(map(tuple, found.collect())) == want
    top = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top and "Window" not in top


def test_nearest_equals_all_pairs_and_joins_nothing(spark):
    rng = random.Random(13)
    rows = [(i, i % 3, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(160)]
    rows += [(200, 1, None), (250, 1, [1.0, 2.0]), (300, 0, [1.0, None, 0.0, 1.0]), (350, 9, [1.0, 0.0, 0.0, 0.0]), (50, 2, [0.5] * 4), (7, 2, [0.25] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, v array<double>").repartition(5)

    def similarity(a, b):
        whole = a is not None and b is not None and len(a) == len(b) and None not in a + b
        return round(sum(x * y for x, y in zip(a, b, strict=True)), 6) if whole else None

    for by_label, k in ((False, 5), (True, 2)):
        found = mining.nearest(vectors, k, by_label, 6)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        best = {}
        for r in found.collect():
            best.setdefault(r["query"], []).append((r.s is None, -(r.s or 0), r.neighbour))
        want = {}
        for q, label, v in rows:
            if q % 50 == 0:
                met = [similarity(v, w) for _, _, w in rows]
                want.setdefault(q, []).extend((s is None, -(s or 0), n) for (n, other, _), s in zip(rows, met, strict=True) if n != q and (not by_label or other == label))
        assert {q: sorted(x)[:k] for q, x in best.items()} == {q: sorted(x)[:k] for q, x in want.items() if x}


def test_shares_of_term_counts_do_not_grow_with_the_rows(spark):
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        texts = spark.range(0, 20_000, 1, 16).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
        counted = mining.term_counts(texts, F.lit("ab"), 16).select(F.spark_partition_id().alias("p"), "id", "text")
        shares = [r.n for r in counted.groupBy("p").agg(F.count("*").alias("n"), F.max("text")).collect()]
        assert sum(shares) == 20_000 and max(shares) < 20_000 / 2 / spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_terms_are_those_of_hashing_tf(spark):
    from pyspark.ml.feature import HashingTF

    texts = ["", "a", "  x\ty ", "Grüße aus 東京 😀😀", "interface Ethernet0/0/1 up " * 40]

    def grams(text):
        words = [f" {w} " for w in __import__("re").split(r"[ \t]+", text.lower())]
        return [w[i : i + n] for w in words for n in range(3, 7) for i in range(max(1, len(w) - n + 1))]

    rows = spark.createDataFrame([(i, t, grams(t)) for i, t in enumerate(texts)], "id int, text string, grams array<string>")
    for features in (64, 1000):
        want = {r.id: r.h.toArray() for r in HashingTF(inputCol="grams", outputCol="h", numFeatures=features).transform(rows).collect()}
        counted = mining.term_counts(rows.drop("grams"), F.col("text"), features)
        assert "Generate" not in (plan := counted._jdf.queryExecution().optimizedPlan().toString()) and "transform(" not in plan
        for r in counted.collect():
            assert max(abs(x - (1 + __import__("math").log(n) if n else 0)) for x, n in zip(r.tf.toArray(), want[r.id], strict=True)) < 1e-9


def test_terms_for_fits_are_held_on_disk(spark):
    held = mining.held_terms(spark.createDataFrame([(1, "a b")], "id int, text string"), 64)
    assert held.storageLevel.useDisk and not held.storageLevel.useMemory
    held.unpersist()


def test_templates_are_mined_once(spark):
    plan = mining.template_embedding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "split(" not in plan


def test_embeddings_come_from_stored_counts_and_equal_mllib(spark):
    import numpy as np
    from pyspark.ml.feature import PCA, Normalizer

    rng = random.Random(17)
    texts = ["", None, "grüße " * 9, "ab " * 300, "a\tb  c"] + [" ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    made = mining.embedded(rows, "text", 64, 16)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan and "Window" not in plan
    got = {r.id: r.vector for r in made.collect()}
    terms = mining.tfidf(rows, F.col("text"), 64)
    reduced = PCA(k=16, inputCol="vector", outputCol="reduced").fit(terms).transform(terms)
    want = {r.id: r.unit.toArray() for r in Normalizer(inputCol="reduced", outputCol="unit").transform(reduced).collect()}
    assert set(got) == set(want)
    a, b = (np.array([m[i] for i in sorted(want)]) for m in (got, want))
    assert np.abs(a @ a.T - b @ b.T).max() < 1e-8  # axes may point either way
    assert sorted(mining.embedded(rows.filter("id < 0"), "text", 64, 16).collect()) == []


def test_masks_run_only_where_they_can_match(spark):
    from ledgerlake.operators import lines

    rng = random.Random(19)
    parts = ['"', "'", "$1$ab", "abcdefABCDEFabcd", "deadbeefdeadbee", "1.2.3.4/24", "::", "a:b:c", "Gi0/1", "x-7", " ", "  ", "\t", "<*>", "<", "é", "word", "7", "٣"]
    rows = spark.createDataFrame([("".join(rng.choices(parts, k=rng.randrange(8))),) for _ in range(3000)] + [(None,)], "l string")
    plain = F.trim(F.regexp_replace("l", r"[ \t\r\n\x0b\x0c]+", " "))
    for mask in lines.MASKS:
        plain = F.regexp_replace(plain, mask, "<*>")
    every = F.regexp_replace(plain, r"(?:<\*>){2,}", "<*>")
    assert rows.filter(~lines.template(F.col("l")).eqNullSafe(every)).count() == 0
    assert 0 < rows.filter(~F.col("l").rlike(lines.MASKABLE)).count() < 3000


def test_folds_are_fitted_together_and_guess_as_mllib(spark):
    import pytest

    from ledgerlake.operators import fits

    rng = random.Random(23)
    word = lambda y: "".join(rng.choices("abcdefgh" if y else "efghijkl", k=rng.randrange(2, 7)))
    rows = [(i, i % 2, float(y := rng.random() < 0.6), " ".join(word(y) for _ in range(rng.randrange(1, 12)))) for i in range(160)] + [(160, 0, 1.0, ""), (161, 1, 0.0, "a " * 300)]
    texts = spark.createDataFrame(rows, "id long, fold long, label double, text string").repartition(3)

    def guesses(some):
        return fits.fold_guesses(mining.counted(some.select("fold", "label", "text"), F.col("text"), 128).drop("text"), 128, 3)

    held = mining.held_terms(texts, 128)
    want = []
    for k in range(2):
        told = mining.classifier().fit(held.filter(F.col("fold") != k)).transform(held.filter(F.col("fold") == k))
        want += [(r.fold, r.label, r.prediction) for r in told.collect()]
    held.unpersist()
    assert sorted(map(tuple, guesses(texts).collect())) == sorted(want)
    # a fold whose model saw one class guesses it, a table without rows has no guesses, and a fold alone or another label is an error
    same = guesses(texts.withColumn("label", F.when(F.col("fold") == 1, 0.0).otherwise(F.col("label"))))
    assert {r.prediction for r in same.filter("fold = 0").collect()} == {0.0}
    assert guesses(texts.filter("id < 0")).collect() == []
    for wrong in (texts.filter("fold = 0"), texts.withColumn("label", F.lit(2.0))):
        with pytest.raises(ValueError):
            guesses(wrong)


def test_scores_of_folds_take_the_passes_of_one_fit(spark):
    context = spark.sparkContext
    context.setJobGroup("fits of folds", "")
    try:
        scores = mining.grouped_kfold_scores(spark, "/root/testdata/sf0.001")
        assert len(context.statusTracker().getJobIdsForGroup("fits of folds")) < 150
        assert {r.fold for r in scores.collect()} == {None, 0, 1, 2, 3, 4}
    finally:
        context._jsc.clearJobGroup()


def test_every_row_asks_for_its_neighbours(spark):
    rng = random.Random(29)
    rows = [(rng.randrange(900), [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)] if i % 3 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(700)]
    odd = [(-3, None), (-4, None), (1001, [1.0, 2.0]), (1002, [1.0, None, 0.0]), (None, [1.0, 0.0, 0.0])]

    def similarity(a, b):
        whole = a is not None and b is not None and len(a) == len(b) and None not in a + b
        return round(sum(x * y for x, y in zip(a, b, strict=True)), 6) if whole else None

    before = mining.GROUP
    for some in (rows, rows[:300] + odd, rows[:4]):
        vectors = spark.createDataFrame([(i, 0, v) for i, v in some], "vec_id long, label int, v array<double>").repartition(5)
        try:
            mining.GROUP = 64
            found = mining.nearest(vectors, 4, False, 6, every=True).collect()
        finally:
            mining.GROUP = before
        best, want = {}, {}
        for r in found:
            best.setdefault(r["query"], []).append((r.s is None, -(r.s or 0), r.neighbour))
        for q, v in some:
            for n, w in some:
                if q is not None and n is not None and q != n:
                    s = similarity(v, w)
                    want.setdefault(q, []).append((s is None, -(s or 0), n))
        assert {q: sorted(x)[:4] for q, x in best.items()} == {q: sorted(x)[:4] for q, x in want.items()}


def test_pairs_in_hand_are_bettered_chunk_by_chunk(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(31)
    vectors = [[rng.choice([-1.0, 0.0, 0.5, 1.0]) if i % 2 else rng.gauss(0, 1) for _ in range(4)] for i in range(400)]
    batch = lambda at, asks: pa.RecordBatch.from_arrays([pa.array([asks] * len(at)), pa.array(at), pa.array([vectors[i] for i in at])], ["asks", "vec_id", "v"])
    monkeypatch.setattr(mining, "MET", 16)
    monkeypatch.setattr(mining, "ASKED", 32)
    for digits in (6, None):
        best = mining._Best(3, digits)
        best.take(batch(list(range(100)), True))
        for at in range(0, 400, 90):
            best.take(batch(list(range(at, min(at + 90, 400))), False))
        got = {}
        for r in (r for b in best.rows() for r in b.to_pylist()):
            got.setdefault(r["query"], []).append((r["neighbour"], r["s"]))
        s = np.array(vectors) @ np.array(vectors).T
        for q in range(100):
            value = lambda n: round(float(s[q, n]), 6) if digits else round(float(s[q, n]), 12)  # noqa: E731, B023
            order = sorted((n for n in range(400) if n != q), key=lambda n: (-value(n), n))[:3]  # noqa: B023
            assert [round(v, 6) for _, v in got[q]] == [round(float(s[q, n]), 6) for n in order]
            assert not digits or [n for n, _ in got[q]] == order
