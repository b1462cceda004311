import random

import pytest

from ledgerlake.operators import conditions as c
from ledgerlake.operators import rulebook as rb

SCHEMA = f"device int, block int, label string, path string, value {c.VALUE}, line_no int, present boolean"


def typed(x):
    if isinstance(x, bool):
        return ("boolean", x, None, None, None)
    if isinstance(x, int | float):
        return ("number", None, float(x), None, None)
    return ("list", None, None, None, x) if isinstance(x, list) else ("text", None, None, x, None)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    values = [1, 2, 5, "2", "on", "Off", "a, b", True, False, ["a", "b"], ["B"], "version 12", 2.5]
    out = []
    for device in range(30):
        for line in range(rng.randint(0, 14)):
            block = rng.choice([None, 1, 2, 3])
            label = None if block is None else ("Loopback0" if block == 3 else f"port{block}")
            out.append((device, block, label, rng.choice("pqrs"), rng.choice(values), line))
    return out


def checks(rng):
    ops = ["eq", "ne", "gt", "lte", "in", "not_in", "contains", "not_contains", "regex_match", "regex_not_match", "subset_of", "superset_of", "disjoint_from"]
    expected = [2, "2", " 2 ", "on", "a b", ["a", "b"], ["A"], [2, "on"], True, None, "(", "\\d", 2.5]
    kind = rng.randrange(6)
    if kind == 0:
        return c.Presence(rng.choice("pqrst"), rng.random() < 0.5)
    if kind == 1:
        return c.Count(rng.choice("pqrst"), rng.choice(["gte", "eq", "lt", "ne"]), rng.randrange(4))
    return c.FactCheck(rng.choice("pqrst"), rng.choice(ops), rng.choice(expected), rng.choice(["all", "any"]), rng.choice(["unknown", "fail", "pass", "notapplicable"]), rng.random() < 0.3)


def trees(rng, depth=0, block=False):
    kind = rng.randrange(7)
    if depth == 3 or kind < 3:
        return checks(rng)
    if kind == 3 and not block:
        return c.ForEach(trees(rng, depth + 1, True), rng.choice([None, "^loop", "port1"]), rng.choice(["notapplicable", "fail"]))
    return rng.choice([c.AllOf, c.AnyOf, c.NoneOf])(tuple(trees(rng, depth + 1, block) for _ in range(rng.randint(1, 3))))


def compared(op, v, e, fold):
    """The operators on plain values; None is an error."""
    low = lambda x: x.lower() if fold and isinstance(x, str) else [low(i) for i in x] if isinstance(x, list) else x
    as_set = lambda x: set(x) if isinstance(x, list) else set(x.replace(",", " ").split()) if isinstance(x, str) else {x}
    a, b = low(v), low(e)
    if op in ("eq", "ne"):
        return (a == b) == (op == "eq")
    if op in ("gt", "lte"):
        if isinstance(a, bool | list):
            return None
        try:
            return float(a) > float(b) if op == "gt" else float(a) <= float(b)
        except ValueError:
            return None
    if op in ("in", "not_in"):
        return None if isinstance(a, list) else (a in as_set(b)) == (op == "in")
    if op in ("contains", "not_contains"):
        shown = lambda x: str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
        held = str(b) in a if isinstance(a, str) else isinstance(b, str) and b in a if isinstance(a, list) else low(shown(a)) == low(str(e))
        return held == (op == "contains")
    if op in ("regex_match", "regex_not_match"):
        import re

        text = ",".join(v) if isinstance(v, list) else str(v)
        return bool(re.search(e, text, re.I if fold else 0)) == (op == "regex_match")
    mine, want = as_set(a), as_set(b)
    return {"subset_of": mine <= want, "superset_of": mine >= want, "disjoint_from": not mine & want}[op]


def plain(tree, facts, in_block=False):
    """(outcome, evidence as (path, line)) of a tree over facts (block, label, path, value, line)."""
    if c.problem(tree):
        return "error", []
    if isinstance(tree, c.Presence | c.Count | c.FactCheck):
        own = sorted((f for f in facts if f[2] == tree.path), key=lambda f: f[4])
        places = [(f[2], f[4]) for f in own]
    if isinstance(tree, c.Presence):
        return ("pass" if own else "fail", places[:1]) if tree.must_be_present else ("fail" if own else "pass", places)
    if isinstance(tree, c.Count):
        n, t = len(own), tree.threshold
        return ("pass" if {"gte": n >= t, "eq": n == t, "lt": n < t, "ne": n != t}[tree.op] else "fail"), places
    if isinstance(tree, c.FactCheck):
        if not own:
            return tree.on_missing, []
        said = [compared(tree.op, f[3], tree.expected, tree.fold_case) for f in own]
        if None in said:
            return "error", []
        good, bad = [[p for p, s in zip(places, said, strict=True) if s is x] for x in (True, False)]
        if tree.quantifier == "any":
            return ("pass", good[:1]) if good else ("fail", bad)
        return ("fail", bad) if bad else ("pass", good)
    if isinstance(tree, c.ForEach):
        if in_block:
            return "error", []
        import re

        blocks = {b: [f for f in facts if f[0] == b] for b in {f[0] for f in facts} - {None}}
        blocks = {b: fs for b, fs in blocks.items() if not (tree.skip and re.search(tree.skip, fs[0][1], re.I))}
        if not blocks:
            return tree.on_no_blocks, []
        anchor = lambda fs: [(f[2], f[4]) for f in sorted(fs, key=lambda f: (f[4], f[2]))][:1]
        got = {b: plain(tree.sub, fs, True) for b, fs in blocks.items()}
        if any(o == "fail" for o, _ in got.values()):
            return "fail", [x for b, (o, ev) in got.items() if o == "fail" for x in (ev or anchor(blocks[b]))]
        if any(o in ("unknown", "error") for o, _ in got.values()):
            return "unknown", []
        return "pass", [x for fs in blocks.values() for x in anchor(fs)]
    got = [plain(x, facts, in_block) for x in tree.children]
    has = {o for o, _ in got}
    of = lambda r: [x for o, ev in got if o == r for x in ev]
    if "error" in has:
        return "error", []
    if isinstance(tree, c.AllOf):
        return ("fail", of("fail")) if "fail" in has else ("unknown", []) if "unknown" in has else ("notapplicable", []) if "notapplicable" in has and "pass" not in has else ("pass", of("pass"))
    if isinstance(tree, c.AnyOf):
        return ("pass", next(ev for o, ev in got if o == "pass")) if "pass" in has else ("unknown", []) if "unknown" in has else ("fail", of("fail")) if "fail" in has else ("notapplicable", [])
    return ("fail", of("pass")) if "pass" in has else ("unknown", []) if "unknown" in has else ("pass", [])


def test_many_rules_equal_the_definition_with_their_evidence(spark, rows):
    rng = random.Random(11)
    rules = {f"r{i}": trees(rng) for i in range(150)}
    facts = spark.createDataFrame([(d, b, lab, p, typed(v), n, True) for d, b, lab, p, v, n in rows], SCHEMA)
    scope = spark.createDataFrame([(d,) for d in range(32)], "device int")
    want = {(d, r): plain(t, [x[1:] for x in rows if x[0] == d]) for d in range(32) for r, t in rules.items()}
    assert len({o for o, _ in want.values()}) == 5
    got = {(r.device, r.rule_id): r.outcome for r in rb.decide(scope, facts, rules, ["device"], "block", "label").collect()}
    assert got == {k: o for k, (o, _) in want.items()}
    told = rb.evidence(scope, facts, rules, ["device"], block="block", label="label").collect()
    assert sorted(map(tuple, told)) == sorted({(d, r, o, p, n) for (d, r), (o, ev) in want.items() for p, n in ev})


def test_same_as_the_rules_compiled_into_the_plan(spark, rows):
    rng = random.Random(3)
    rules = {f"r{i}": trees(rng) for i in range(12)}
    facts = spark.createDataFrame([(d, b, lab, p, typed(v), n, True) for d, b, lab, p, v, n in rows], SCHEMA)
    scope = spark.createDataFrame([(d,) for d in range(32)], "device int")
    a, b = (f(scope, facts, rules, ["device"], "block", "label") for f in (c.audit, rb.decide))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_without_blocks_facts_rules_or_devices(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    scope = spark.createDataFrame([(1,), (2,)], "device int")
    rules = {"a": c.Count("p", "lte", 0), "b": c.ForEach(c.Presence("p")), "c": c.FactCheck("p", "eq", 1), "d": c.AllOf(())}
    want = {"a": "pass", "b": "notapplicable", "c": "unknown", "d": "error"}
    assert {(r.device, r.rule_id): r.outcome for r in rb.decide(scope, empty, rules, ["device"], "block", "label").collect()} == {(d, k): v for d in (1, 2) for k, v in want.items()}
    assert rb.decide(scope, empty, {}, ["device"]).count() == 0 and rb.decide(scope.limit(0), empty, rules, ["device"]).count() == 0
    facts = spark.createDataFrame([(d, b, lab, p, typed(v), n, True) for d, b, lab, p, v, n in rows], SCHEMA)
    assert rb.decide(scope, facts, {"a": c.Presence("p")}, ["device"]).count() == 2


def test_shuffles_do_not_grow_with_the_rules(spark, rows):
    facts = spark.createDataFrame([(d, b, lab, p, typed(v), n, True) for d, b, lab, p, v, n in rows], SCHEMA)
    scope = spark.createDataFrame([(d,) for d in range(3)], "device int")

    def exchanges(n):
        rng = random.Random(5)
        df = rb.decide(scope, facts, {f"r{i}": trees(rng) for i in range(n)}, ["device"], "block", "label")
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(20) == exchanges(400) <= 8


def test_controls_fold_outcomes_and_their_evidence(spark):
    outcomes = spark.createDataFrame([(1, "a", "fail"), (1, "b", "pass"), (2, "a", "pass"), (2, "b", "notapplicable"), (2, "c", "error"), (3, "a", "notapplicable"), (3, "b", "pass")], "device int, rule_id string, outcome string")
    shown = spark.createDataFrame([(1, "a", "fail", "p", 3), (1, "a", "fail", "p", 3), (1, "b", "pass", "q", 4), (2, "a", "pass", "p", 1), (3, "b", "pass", "q", 9)], "device int, rule_id string, outcome string, path string, line_no int")
    controls = spark.createDataFrame([("a", "K1"), ("b", "K1"), ("c", "K2"), ("b", "K2")], "rule_id string, control string")
    folded, told = rb.control_fold(outcomes, shown, controls, ["device"])
    assert sorted(map(tuple, folded.collect())) == [(1, "K1", "fail"), (1, "K2", "pass"), (2, "K1", "pass"), (2, "K2", "error"), (3, "K1", "pass"), (3, "K2", "pass")]
    assert sorted(map(tuple, told.collect())) == [(1, "K1", "p", 3), (1, "K2", "q", 4), (2, "K1", "p", 1), (3, "K1", "q", 9), (3, "K2", "q", 9)]


def test_ordered_checks_in_batches_equal_expressions_and_counts_equal_rows(spark, rows, monkeypatch):
    rng = random.Random(3)
    thresholds = [0, 1, 2, "2", 2.5, 5, -1, float("nan"), "inf", 1e300]
    rules = {f"o{i}": c.FactCheck(rng.choice("pqrs"), rng.choice(["gt", "gte", "lt", "lte"]), rng.choice(thresholds), rng.choice(["all", "any"])) for i in range(60)}
    rules |= {f"x{i}": trees(rng) for i in range(20)}
    facts = spark.createDataFrame([(d, b, la, p, typed(v), n, True) for d, b, la, p, v, n in [*rows, (1, None, None, "p", float("nan"), 99), (2, 1, "port1", "q", "NaN", 98)]], SCHEMA).repartition(3)
    scope = spark.range(31).selectExpr("int(id) AS device")
    told = []
    for many in (1, 10**9):
        monkeypatch.setattr(rb, "MANY", many)
        told.append(sorted(map(tuple, rb.decide(scope, facts, rules, ["device"], "block", "label").collect())))
    assert told[0] == told[1]
    counts = {}
    for _, rule, outcome in told[0]:
        counts[rule, outcome] = counts.get((rule, outcome), 0) + 1
    monkeypatch.setattr(rb, "MANY", 1)
    assert {(r.rule_id, r.outcome): r.devices for r in rb.outcome_counts(scope, facts, rules, ["device"], "block", "label").collect()} == counts
    # the many checks of a path are no part of the rows that meet its facts
    book = rb.Rulebook.of(rules)
    assert all(not any(x.form == "FactCheck" and x.op in c.ORDERED for x in r.checks) for r in book.table(spark).collect())


def test_lines_meet_their_orders_before_they_become_facts(spark):
    from ledgerlake.plans.conditions import customer_facts

    plan = customer_facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Generate") < plan.find("Join")


def test_the_first_fact_of_a_check_is_found_without_sorting(spark, rows):
    facts = spark.createDataFrame([(d, b, l, p, typed(v), n, True) for d, b, l, p, v, n in rows], SCHEMA)
    shown = rb.evidence(facts.select("device").distinct(), facts, {"a": c.FactCheck("p", "eq", 2, "any")}, ["device"])
    assert "SortAggregate" not in shown._jdf.queryExecution().executedPlan().toString()
    want = {}
    for d, _, _, p, v, n in rows:
        if p == "p" and not isinstance(v, bool) and v == 2:
            want[d] = min(n, want.get(d, n))
    assert {(r.device, r.path, r.line_no) for r in shown.collect() if r.outcome == "pass"} == {(d, "p", n) for d, n in want.items()}
