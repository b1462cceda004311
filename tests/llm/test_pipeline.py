import random

import corpus_pipeline
from ledgerlake.llm import line_dedup, simhash


def corpus(folder, spark):
    """Clean, junk and toxic documents, exact copies, a shared line and a benchmark passage."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 8))) for _ in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    shared = "this line of more than forty characters stands in many documents"
    rows = []
    for i in range(200):
        lines = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(3)]
        if i % 10 == 0:
            lines = [x.replace(" ", "*** ") for x in lines]
        elif i % 10 == 1:
            lines = [x.replace(" ", " slur1 ", 2) for x in lines]
        elif i % 10 == 2:
            lines.insert(1, shared)
        elif i % 10 == 3:
            lines[1] = passage
        elif i % 10 == 4:
            lines = rows[-1][1].split("\n") if i == 4 else rows[5][1].split("\n") if i > 14 else lines
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
    rows = [(a, b, c, d, len(b)) for a, b, c, d, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 10 != 0), int(i % 10 == 1)) for i in range(200) if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return shared, passage


def test_stages_take_effect(spark, tmp_path):
    shared, passage = corpus(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    kept = ids["quality_classifier"]
    assert len([i for i in kept if i % 10 > 1]) >= 155 and len([i for i in kept if i % 10 < 2]) <= 4
    assert ids["line_dedup"] == kept
    assert sum(shared in r.text for r in seen["line_dedup"]) == 1
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    near = {r.doc_id for r in seen["simhash_near_dedup"]}
    prints = {}
    for r in seen["line_dedup"]:
        prints.setdefault(simhash.fingerprint(r.text), []).append(r.doc_id)
    assert all(len(near & set(group)) == 1 for group in prints.values())
    assert all(passage not in r.text for r in seen["decontaminate"])
    assert {i for i in near if i % 10 != 3} <= ids["decontaminate"] | {4}
    assert ids["packing"] == ids["decontaminate"]
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, seen["packing"]))
    assert line_dedup.MIN_DOCS == 5


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
