import itertools

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import scalars
from ledgerlake.operators import conditions as c

RESULTS = ("pass", "fail", "error", "unknown", "notapplicable")


def plain_fold(kind, results):
    if "error" in results:
        return "error"
    if kind == "all":
        return "fail" if "fail" in results else "unknown" if "unknown" in results else "notapplicable" if "notapplicable" in results and "pass" not in results else "pass"
    if kind == "any":
        return "pass" if "pass" in results else "unknown" if "unknown" in results else "fail" if "fail" in results else "notapplicable"
    return "fail" if "pass" in results else "unknown" if "unknown" in results else "pass"


def test_folds_over_every_pair(spark):
    pairs = list(itertools.product(RESULTS, RESULTS))
    df = spark.createDataFrame(pairs, "a string, b string")
    cols = [F.col("a"), F.col("b")]
    for r in df.select("a", "b", c.fold_all(cols).alias("all"), c.fold_any(cols).alias("any"), c.fold_none(cols).alias("none")).collect():
        for kind in ("all", "any", "none"):
            assert r[kind] == plain_fold(kind, (r.a, r.b)), (kind, r)


CASES = [
    ("eq", dict(n=2.0), 2, True), ("eq", dict(s="2"), 2, False), ("eq", dict(b=True), 1, True), ("eq", dict(b=True), True, True), ("eq", dict(n=1.0), True, True), ("ne", dict(s="a"), "b", True),
    ("gt", dict(s=" 5 "), 4, True), ("lte", dict(n=4.0), 4, True), ("gt", dict(s="x"), 4, None), ("lt", dict(b=True), 4, None),
    ("in", dict(s="a"), "a, b", True), ("not_in", dict(s="c"), ["a", "b"], True), ("in", dict(l=["a"]), "a", None),
    ("contains", dict(s="abc"), "b", True), ("contains", dict(l=["x", "y"]), "y", True), ("contains", dict(n=3.0), "3", True),
    ("regex_match", dict(s="version 12"), r"\d+", True), ("regex_not_match", dict(s="abc"), r"\d", True),
    ("subset_of", dict(s="a, b"), "a b c", True), ("superset_of", dict(l=["a", "b"]), ["a"], True), ("disjoint_from", dict(l=["a"]), ["b"], True), ("subset_of", dict(l=["z"]), ["a"], False),
]


@pytest.mark.parametrize("case", CASES, ids=lambda x: f"{x[0]}-{x[1]}-{x[2]}")
def test_operators(spark, case):
    op, given, expected, want = case
    kind, raw = next(iter(given.items()))
    col = F.array(*[F.lit(x) for x in raw]) if kind == "l" else F.lit(raw)
    assert spark.range(1).select(c.compare(op, c.value(**{kind: col}), expected).alias("x")).first().x is want


def test_missing_facts_errors_and_quantifiers(spark):
    rows = [(1, "p", "5"), (1, "p", "7"), (2, "p", "9"), (3, "p", "x"), (3, "p", "1"), (4, "q", "1")]
    facts = spark.createDataFrame(rows, "device long, path string, s string").select("device", "path", c.value(s=F.col("s")).alias("value"), (F.col("device") != 2).alias("present"))
    scope = spark.createDataFrame([(i,) for i in range(1, 6)], "device long")

    def run(tree):
        return {r.device: r.outcome for r in c.evaluate(scope, facts, tree, ["device"]).collect()}

    assert run(c.FactCheck("p", "lte", 6)) == {1: "fail", 2: "fail", 3: "error", 4: "unknown", 5: "unknown"}
    assert run(c.FactCheck("p", "lte", 6, quantifier="any", on_missing="fail")) == {1: "pass", 2: "fail", 3: "error", 4: "fail", 5: "fail"}
    assert run(c.Presence("p")) == {1: "pass", 2: "pass", 3: "pass", 4: "fail", 5: "fail"}
    assert run(c.Presence("p", False))[5] == "pass"
    assert run(c.Count("p", "gte", 2)) == {1: "pass", 2: "fail", 3: "pass", 4: "fail", 5: "fail"}
    assert run(c.NoneOf((c.Presence("p"), c.Presence("q")))) == {1: "fail", 2: "fail", 3: "fail", 4: "fail", 5: "pass"}
    got = {r.device: r.applicable for r in c.required(scope, facts, ["p"], ["device"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_for_each_counts_blocks(spark):
    rows = [(1, 10, "a", "5"), (1, 11, "b", "50"), (2, 20, "a", "5"), (3, 30, "skip", "50"), (4, 40, "a", "x")]
    facts = spark.createDataFrame(rows, "device long, block long, label string, s string").select("device", "block", "label", F.lit("p").alias("path"), c.value(s=F.col("s")).alias("value"))
    scope = spark.createDataFrame([(i,) for i in range(1, 6)], "device long")
    tree = c.ForEach(c.FactCheck("p", "lt", 10), skip="^skip$")
    got = {r.device: r.outcome for r in c.evaluate(scope, facts, tree, ["device"], "block", "label").collect()}
    assert got == {1: "fail", 2: "pass", 3: "notapplicable", 4: "unknown", 5: "notapplicable"}


def test_control_and_projection_ranks_differ(spark):
    df = spark.createDataFrame([(1, "pass"), (1, "error"), (2, "pass"), (2, "unknown"), (3, "notapplicable"), (3, "pass"), (4, "fail"), (4, "error")], "k long, outcome string")
    fold = lambda ranks: {r.k: r.outcome for r in c.fold(df, ["k"], ranks).collect()}
    assert fold(c.CONTROL_RANK) == {1: "error", 2: "unknown", 3: "pass", 4: "fail"}
    assert fold(c.PROJECTION_RANK) == {1: "pass", 2: "pass", 3: "pass", 4: "fail"}


def test_score_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 15), (0, 0), (3, 1)], "p long, f long")
    assert [r.s for r in df.select(c.score(F.col("p"), F.col("f")).alias("s")).collect()] == [6.2, 0.0, 75.0]


def test_membership_keeps_kinds_apart(spark):
    def of(op, v, expected):
        return spark.range(1).select(c.compare(op, v, expected).alias("x")).first().x

    text, number, flag = c.value(s=F.lit("2")), c.value(n=F.lit(2)), c.value(b=F.lit(True))
    assert of("in", text, ["2"]) and of("in", text, "2,3") and of("in", number, [2, 5]) and of("in", flag, [True])
    assert not of("in", text, [2]) and not of("in", number, "2,3") and not of("in", number, ["2"])
    assert of("not_in", text, [2]) and of("not_contains", c.value(s=F.lit("abc")), "x") and not of("not_contains", c.value(s=F.lit("abc")), "b")


def test_ids_severities_and_keys(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).first().x
    assert [one(scalars.control_id(F.lit(t))) for t in ("ac-117", "AC-007 (012)", "ac-2.3", "x")] == ["AC-117", "AC-07(12)", "AC-02(03)", None]
    assert one(scalars.normalise_severity(F.lit("Important"))) == "medium"
    keys = [one(scalars.natural_key(F.lit(t))) for t in ("v-2", "V-10", "v-" + "9" * 30, "v-1" + "0" * 30)]
    assert keys == sorted(keys)


def test_nested_for_each_and_broken_rules(spark):
    schema = f"device int, block int, label string, path string, value {c.VALUE}, line_no int"
    number = lambda n: ("number", None, float(n), None, None)
    text = lambda s: ("text", None, None, s, None)
    rows = [
        (1, 1, "a", "x", number(1), 1), (1, 2, "b", "x", number(9), 2), (1, None, None, "y", text("on"), 3),
        (2, 1, "a", "x", number(1), 1), (2, 2, "skip", "x", number(9), 2), (2, None, None, "y", text("off"), 3),
        (3, None, None, "y", text("on"), 1), (4, 1, "a", "z", text("q"), 1),
    ]
    facts = spark.createDataFrame(rows, schema)
    scope = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "device int")
    small = c.FactCheck("x", "lte", 5)
    rules = {
        "both": c.AllOf((c.ForEach(small, skip="^skip"), c.FactCheck("y", "eq", "on"))),
        "each": c.ForEach(small, skip="^skip"),
        "pattern": c.FactCheck("y", "regex_match", "("),
        "half": c.AnyOf((c.FactCheck("y", "no_such", 1), c.Presence("y"))),
        "text": c.FactCheck("x", "gt", "many"),
    }
    got = {(r.device, r.rule_id): r.outcome for r in c.audit(scope, facts, rules, ["device"], "block", "label").collect()}
    assert [got[d, "each"] for d in (1, 2, 3, 4, 5)] == ["fail", "pass", "notapplicable", "unknown", "notapplicable"]
    assert [got[d, "both"] for d in (1, 2, 3, 4, 5)] == ["fail", "fail", "pass", "unknown", "unknown"]
    assert {got[d, r] for d in (1, 2, 3, 4, 5) for r in ("pattern", "half", "text")} == {"error"}
    told = c.evidence(facts, {"small": small, "on": c.FactCheck("y", "eq", "on", quantifier="any")}, ["device"]).collect()
    assert sorted((r.device, r.rule_id, r.path, r.line_no) for r in told) == [(1, "on", "y", 3), (1, "small", "x", 2), (2, "small", "x", 2), (3, "on", "y", 1)]


def test_rule_tables(spark):
    rows = [("a", '{"type": "count", "path": "x", "op": "gte", "threshold": 2}'), ("b", "{"), ("c", '{"type": "count", "path": "x"}'), ("d", None)]
    rules = c.rules_of(spark.createDataFrame(rows, "rule_id string, condition string"))
    assert rules["a"] == c.Count("x", "gte", 2)
    assert all(isinstance(rules[k], c.Malformed) for k in "bcd")


def test_audited_facts_are_not_sorted(spark):
    from ledgerlake.plans import conditions as queries

    plan = queries.audit_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in [line for line in plan.splitlines() if "Aggregate(" in line][-1]
