import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import blocks as b


def plain_tightest(points, blocks):
    out = {}
    for i, (g, at) in enumerate(points):
        around = [(e - s, s, n) for bg, n, s, e in blocks if bg == g and g is not None and at is not None and s <= at <= e]
        if around:
            out[i] = min(around)[2]
    return out


@pytest.mark.parametrize(("width", "far"), [(4, 300), (64, 300), (16_384, 40), (8, 10**6)])
def test_tightest_equals_all_pairs(spark, width, far):
    rng = random.Random(width)
    points = [(rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([rng.randrange(-far, far), rng.randrange(0, 30)])) for _ in range(600)] + [("a", None)]
    blocks = []
    for n in range(300):
        s = rng.randrange(-far, far) if n % 2 else rng.randrange(0, 30)
        blocks.append((rng.choice(["a", "hot", "hot", "c", None]), n, s, s + rng.choice([-1, 0, 3, 17, far // 4, 2 * far])))
    blocks += [("hot", 1000 + i, 5, 9) for i in range(20)]  # equal extents
    p = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(points)], "i int, g string, at long").repartition(3)
    d = spark.createDataFrame(blocks, "g string, block int, start int, end int").repartition(3)
    got = {r.i: r.block for r in b.tightest(p, d, "g", "at", ["i"], width).collect()}
    assert got == plain_tightest(points, blocks)


def test_tightest_spreads_a_hot_group_and_makes_no_pairs(spark):
    n = 20_000
    points = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("at"))
    blocks = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("block"), F.lit(0).alias("start"), (F.lit(2 * n) - F.col("id")).alias("end"))  # all hold all points
    rows = b.tightest(points, blocks, "g", "at", ["at"], 256).collect()
    assert len(rows) == n and {r.block for r in rows} == {n - 1}
    assert b.tightest(points.limit(0), blocks, "g", "at", ["at"]).count() == 0 == b.tightest(points, blocks.limit(0), "g", "at", ["at"]).count()


def plain_spans(net, anchors):
    """Extents as the depth-counting loop over lines gives them."""
    out = []
    for i, x in enumerate(net):
        if not anchors[i]:
            continue
        depth, end = x, i
        if x > 0:
            end = len(net) - 1
            for j in range(i + 1, len(net)):
                depth += net[j]
                if depth <= 0:
                    end = j
                    break
        out.append((i + 1, end + 1))
    return sorted(out)


def test_spans_equal_the_counting_loop(spark):
    rng = random.Random(1)
    files = {f: [rng.choice([0, 0, 1, 1, 2, 3, -1, -1, -2, -4]) for _ in range(rng.randrange(0, 60))] for f in range(25)}
    anchors = {f: [x > 0 and rng.random() < 0.8 or rng.random() < 0.1 for x in net] for f, net in files.items()}
    rows = spark.createDataFrame([(f, i + 1, x, anchors[f][i], len(net)) for f, net in files.items() for i, x in enumerate(net)], "f int, no int, net int, anchor boolean, n int").repartition(4)
    got = b.spans(rows, ["f"], "no", F.col("net"), F.col("anchor"), F.col("n"))
    found = {f: [] for f in files}
    for r in got.collect():
        found[r.f].append((r.start, r.end))
    assert {f: sorted(x) for f, x in found.items()} == {f: plain_spans(net, anchors[f]) for f, net in files.items()}


def test_lines_are_matched_by_their_blocks_then_the_pack_then_what_was_taught(spark):
    text = """interface one
 ip address 1
 description x
 unit 0
  ip address 2
  mtu 9
 after
global a
ip address 3
strange""".split("\n")
    lines = spark.createDataFrame([("f", i + 1, t.strip()) for i, t in enumerate(text)], "file string, line_no int, stripped string")
    blocks = spark.createDataFrame([("f", 1, 1, 7, "interface"), ("f", 4, 4, 6, "unit")], "file string, block int, start int, end int, kind string")
    children = {"interface": [("if.desc", "description"), ("if.ip", "ip address"), ("if.mtu", "mtu")], "unit": [("unit.ip", "ip address")]}
    matched, residue = b.extract(lines, blocks, "file", 3, children, [("ip", "ip "), ("global", "global")], [("odd", "strange|ip")])
    assert {(r.line_no, r.scope, r.pattern) for r in matched.collect()} == {
        (2, "interface", "if.ip"), (3, "interface", "if.desc"), (5, "unit", "unit.ip"), (6, "interface", "if.mtu"), (8, "pack", "global"), (9, "pack", "ip"), (10, "taught", "odd"),
    }
    assert [(r.line_no, r.block, r.block_path, r.block_line) for r in residue.collect()] == [(7, 1, "interface", "interface one")]
    none = b.extract(lines, blocks.limit(0), "file", 3, children, [("ip", "ip ")], [])
    assert none[0].count() == 3 and {r.block_path for r in none[1].collect()} == {None}


def test_tightest_broadcasts_nothing(spark):
    # a few rows whose blocks cover many bins: by its estimate the planner would send the lookups of all bins through the driver
    points = spark.range(64).select((F.col("id") % 2).alias("g"), (F.col("id") * 1000).alias("at"))
    blocks = spark.range(8).select((F.col("id") % 2).alias("g"), F.col("id").alias("block"), (F.col("id") * 100).alias("start"), F.lit(60_000).alias("end"))
    found = b.tightest(points, blocks, "g", "at", ["at"], 16)
    assert {r.at: r.block for r in found.collect()} == {0: 0, **{1000 * k: 6 + k % 2 for k in range(1, 61)}}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_spans_read_their_rows_once(spark):
    rows = spark.createDataFrame([(1, 1, 1, True, 3), (1, 2, 0, True, 3), (1, 3, -1, False, 3)], "f int, no int, net int, anchor boolean, n int")
    found = b.spans(rows, ["f"], "no", F.col("net"), F.col("anchor"), F.col("n"))
    assert sorted((r.start, r.end, r.depth) for r in found.collect()) == [(1, 3, 1), (2, 2, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_chains_take_few_joins(spark):
    own = [("f", i, i, 100 - i, f"k{i}") for i in range(1, 12)] + [("g", 5, 5, 9, "x"), ("g", 20, 20, 30, "y")]
    blocks = spark.createDataFrame(own, "file string, block int, start int, end int, kind string")
    for depth in (1, 2, 5, 8):
        found = b.around(blocks, "file", depth)
        assert {(r.file, r.block): r.chain for r in found.collect()} == {(f, n): [k for g, m, *_, k in reversed(own) if g == f and (f == "f" and m <= n or m == n)][:depth] for f, n, *_ in own}
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1


def test_indentation_is_scanned_across_batches(spark):
    rng = random.Random(4)
    rows = [(f, n, rng.choice(["", "a x", "b y", "c"]), rng.randrange(4)) for f in [*range(12), None] for n in range(1, rng.randrange(2, 25))]
    lines = spark.createDataFrame(rows, "file int, line_no int, stripped string, indent int").repartition(3)
    want = []
    for f in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == f and r[2]]
        for i, (_, n, text, indent) in enumerate(own):
            if text[0] in "ab":
                stop = next((j for j in range(i + 1, len(own)) if own[j][3] <= indent), len(own))
                want.append((f, n, own[stop - 1][1]))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = b.indent_blocks(lines, "file", "[ab] ")
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
        assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_page_is_cut_once_and_not_for_each_piece(spark):
    from ledgerlake.plans.blocks import block_spans_brace, pieces

    for found in (pieces(spark, "/root/testdata/sf0.001"), block_spans_brace(spark, "/root/testdata/sf0.001")):
        above = found._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        assert "split(" not in above
