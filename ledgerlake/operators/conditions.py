"""Tri-state condition algebra over facts.

A fact is a row (device keys, path, value, present, line_no, label); value is a tagged struct, since one path may hold text in one
file and a number in another. A condition tree compiles to aggregates over the facts of a device (or of a block
inside it) and one outcome column, so a whole rule set costs one shuffle by device, whatever the number of leaves.

Outcomes: pass, fail, error, unknown, notapplicable. An error on any fact makes its leaf an error. A defaulted fact
(present = false) counts like an observed one, except for requires_paths. A rule that cannot be evaluated (unknown type or
operator, a broken pattern, a threshold that is no number) is an error and the audit of the others goes on.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cache, reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = ("pass", "fail", "error", "unknown", "notapplicable", "notchecked", "notselected", "informational", "fixed")
VALUE = "struct<kind:string,b:boolean,n:double,s:string,l:array<string>>"


def value(n=None, s=None, b=None, l=None) -> Column:  # noqa: E741
    """A tagged value from the one given column."""
    kind = "number" if n is not None else "text" if s is not None else "boolean" if b is not None else "list"
    null = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"),
        (null if b is None else b).cast("boolean").alias("b"),
        (null if n is None else n).cast("double").alias("n"),
        (null if s is None else s).cast("string").alias("s"),
        (null if l is None else l).cast("array<string>").alias("l"),
    )


def as_text(v: Column) -> Column:
    whole = F.when(v["n"] == F.floor(v["n"]), F.floor(v["n"]).cast("string")).otherwise(v["n"].cast("string"))
    return F.when(v["kind"] == "text", v["s"]).when(v["kind"] == "number", whole).when(v["kind"] == "boolean", F.initcap(v["b"].cast("string"))).otherwise(F.array_join(v["l"], ","))


def as_number(v: Column) -> Column:
    """Numbers and numeric text; booleans, lists and other text are null, which callers report as an error."""
    return F.when(v["kind"] == "number", v["n"]).when(v["kind"] == "text", F.trim(v["s"]).try_cast("double"))


def tokens(text: Column) -> Column:
    """The distinct words of a text, cut at commas and blanks."""
    return F.array_distinct(F.array_remove(F.split(text, r"[,\s]+"), ""))


#: An expected value in the forms that the operators need, as a struct of columns; expected_of() gives its fields.
EXPECTED = "struct<kind:string,n:double,s:string,l:array<string>,number:double,texts:array<string>,numbers:array<double>,text:string,pattern:string,fold:boolean>"
ORDERED = ("gt", "gte", "lt", "lte")


def _is_number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def expected_of(op: str, expected, fold_case: bool = False) -> dict:
    """The fields of EXPECTED; ValueError where the operator cannot use the value."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    low = (lambda x: x.lower() if fold_case and isinstance(x, str) else x)
    many = list(expected) if isinstance(expected, list | tuple | set | frozenset) else None
    if many is not None and not all(isinstance(x, str | bool | int | float) for x in many):
        raise ValueError(f"not a list of plain values: {expected}")
    items = many if many is not None else expected.replace(",", " ").split() if isinstance(expected, str) else [expected]
    number = None
    if op in ORDERED:
        if not _is_number(expected) and not isinstance(expected, str):
            raise ValueError(f"not a number: {expected}")
        number = float(expected)
    if op in ("regex_match", "regex_not_match") and not isinstance(expected, str):
        raise ValueError(f"not a pattern: {expected}")
    return {
        "kind": "none" if expected is None else "list" if many is not None else "text" if isinstance(expected, str) else "number",
        "n": float(expected) if isinstance(expected, bool | int | float) else None,
        "s": low(expected) if isinstance(expected, str) else None,
        "l": [low(x) for x in many] if many is not None and all(isinstance(x, str) for x in many) else None,
        "number": number,
        "texts": sorted({low(x) for x in items if isinstance(x, str)}),
        "numbers": sorted({float(x) for x in items if isinstance(x, bool | int | float)}),
        "text": low(str(expected)),
        "pattern": ("(?iu)" if fold_case else "") + expected if isinstance(expected, str) else None,
        "fold": fold_case,
    }


def _literal(fields: dict) -> dict[str, Column]:
    """The fields as constants."""
    kinds = dict(f.split(":") for f in EXPECTED[len("struct<") : -1].split(","))
    return {k: (F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)).cast(kinds[k]) for k, v in fields.items()}


# Each operator takes a value v and the fields e of an expected one, which may be constants or columns of a table of checks.
# Text, numbers and lists stay apart: text is not in a list of numbers, nor a number in one of texts. Booleans count as 0 and 1.


def _folded(text: Column, e) -> Column:
    return F.when(e["fold"], F.lower(text)).otherwise(text)


def _as_n(v: Column) -> Column:
    return F.when(v["kind"] == "number", v["n"]).when(v["kind"] == "boolean", v["b"].cast("double"))


def _list(v: Column, e) -> Column:
    return F.when(e["fold"], F.transform(v["l"], F.lower)).otherwise(v["l"])


def _eq(v: Column, e) -> Column:
    number = F.coalesce(_as_n(v) == e["n"], F.lit(False))
    text = (v["kind"] == "text") & (_folded(v["s"], e) == e["s"])
    same_list = (v["kind"] == "list") & F.coalesce(_list(v, e) == e["l"], F.lit(False))
    return F.when(e["kind"] == "number", number).when(e["kind"] == "text", text).when(e["kind"] == "list", same_list).otherwise(F.lit(False))


def _in(v: Column, e) -> Column:
    return F.when(v["kind"] == "text", F.array_contains(e["texts"], _folded(v["s"], e))).when(v["kind"] != "list", F.array_contains(e["numbers"], _as_n(v)))


def _contains(v: Column, e) -> Column:
    listed = (e["kind"] == "text") & F.coalesce(F.array_contains(_list(v, e), e["s"]), F.lit(False))
    return F.when(v["kind"] == "text", F.contains(_folded(v["s"], e), e["text"])).when(v["kind"] == "list", listed).otherwise(_folded(as_text(v), e) == e["text"])


def _regex(v: Column, e) -> Column:
    return F.rlike(as_text(v), e["pattern"])


def _by_kind(v: Column, e, texts, number: Column) -> Column:
    """A set operator over a list or the words of a text, and over the one number that another value is."""
    held = F.when(v["kind"] == "list", F.array_distinct(_list(v, e))).otherwise(tokens(_folded(v["s"], e)))
    return F.when(v["kind"].isin("list", "text"), texts(held)).otherwise(number)


def _subset(v: Column, e) -> Column:
    return _by_kind(v, e, lambda mine: F.size(F.array_except(mine, e["texts"])) == 0, F.array_contains(e["numbers"], _as_n(v)))


def _superset(v: Column, e) -> Column:
    alone = (F.size(e["texts"]) == 0) & (F.size(F.array_except(e["numbers"], F.array(_as_n(v)))) == 0)
    return _by_kind(v, e, lambda mine: (F.size(e["numbers"]) == 0) & (F.size(F.array_except(e["texts"], mine)) == 0), alone)


def _disjoint(v: Column, e) -> Column:
    return _by_kind(v, e, lambda mine: ~F.arrays_overlap(mine, e["texts"]), ~F.array_contains(e["numbers"], _as_n(v)))


OPERATORS = {
    "eq": _eq,
    "ne": lambda v, e: ~_eq(v, e),
    "gt": lambda v, e: as_number(v) > e["number"],
    "gte": lambda v, e: as_number(v) >= e["number"],
    "lt": lambda v, e: as_number(v) < e["number"],
    "lte": lambda v, e: as_number(v) <= e["number"],
    "in": _in,
    "not_in": lambda v, e: ~_in(v, e),
    "contains": _contains,
    "not_contains": lambda v, e: ~_contains(v, e),
    "regex_match": _regex,
    "regex_not_match": lambda v, e: ~_regex(v, e),
    "subset_of": _subset,
    "superset_of": _superset,
    "disjoint_from": _disjoint,
}


def compare(op: str, v: Column, expected, fold_case: bool = False) -> Column:
    """Whether v satisfies op; null stands for an error."""
    return OPERATORS[op](v, _literal(expected_of(op, expected, fold_case)))


@dataclass(frozen=True)
class FactCheck:
    path: str
    op: str
    expected: object
    quantifier: str = "all"
    on_missing: str = "unknown"
    fold_case: bool = False


@dataclass(frozen=True)
class Presence:
    path: str
    must_be_present: bool = True


@dataclass(frozen=True)
class Count:
    path: str
    op: str
    threshold: float


@dataclass(frozen=True)
class AllOf:
    children: tuple


@dataclass(frozen=True)
class AnyOf:
    children: tuple


@dataclass(frozen=True)
class NoneOf:
    children: tuple


@dataclass(frozen=True)
class ForEach:
    """A condition for every block of a device."""

    sub: object
    skip: str | None = None
    on_no_blocks: str = "notapplicable"


@dataclass(frozen=True)
class Malformed:
    """A condition that cannot be evaluated; its outcome is an error."""

    reason: str


NODES = {"fact_check": FactCheck, "presence": Presence, "count": Count, "all_of": AllOf, "any_of": AnyOf, "none_of": NoneOf, "for_each": ForEach}


def tree_of(node) -> object:
    """The tree of a parsed rule: a mapping with a type from NODES and the fields of that node."""
    try:
        kind, given = NODES[node["type"]], {k: v for k, v in node.items() if k != "type"}
        if "children" in given:
            given["children"] = tuple(tree_of(c) for c in given["children"])
        if "sub" in given:
            given["sub"] = tree_of(given["sub"])
        return kind(**given)
    except (KeyError, TypeError, AttributeError) as e:
        return Malformed(repr(e))


def rules_of(table: DataFrame) -> dict[str, object]:
    """The trees of a rule table (rule_id, condition), the condition as JSON. A rule set is part of the plan, so the driver reads it."""
    found = {}
    for r in table.select("rule_id", "condition").collect():
        try:
            found[r["rule_id"]] = tree_of(json.loads(r["condition"]))
        except (ValueError, TypeError) as e:
            found[r["rule_id"]] = Malformed(repr(e))
    return found


@cache
def _is_pattern(pattern: str) -> bool:
    """Whether Java takes the pattern, as Spark will."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except (Py4JError, PySparkException):
        return False


def problem(tree) -> str | None:
    """Why a node by itself cannot be evaluated; None: it can."""
    if isinstance(tree, Malformed):
        return tree.reason
    if isinstance(tree, ForEach):
        return None if tree.skip is None or _is_pattern(tree.skip) else f"not a pattern: {tree.skip}"
    if not isinstance(tree, FactCheck | Count):
        return None
    wanted = tree.expected if isinstance(tree, FactCheck) else tree.threshold
    if isinstance(tree, Count) and not _is_number(wanted):
        return f"not a number: {wanted}"
    if isinstance(tree, FactCheck) and (tree.quantifier not in ("all", "any") or tree.on_missing not in RESULTS):
        return "unknown quantifier or result"
    try:
        fields = expected_of(tree.op, wanted, isinstance(tree, FactCheck) and tree.fold_case)
    except (ValueError, TypeError) as e:
        return repr(e)
    if tree.op in ("regex_match", "regex_not_match") and not _is_pattern(fields["pattern"]):
        return f"not a pattern: {wanted}"
    return None


@dataclass
class Compiled:
    """Aggregates over the facts of a group, and the outcome from them.

    A tree with ForEach takes two levels: aggregates and inner ones over each block, then counts summed over blocks and folds over the
    blocks' outcomes. names are those of aggregates, inner_names those of inner.
    """

    aggregates: list[Column] = field(default_factory=list)
    outcome: Column | None = None
    names: list[str] = field(default_factory=list)
    inner: list[Column] = field(default_factory=list)
    inner_names: list[str] = field(default_factory=list)
    per_block: list[Column] = field(default_factory=list)
    folds: list[Column] = field(default_factory=list)


def fold_all(outcomes: list[Column]) -> Column:
    has = lambda r: reduce(lambda a, b: a | b, [o == r for o in outcomes])
    return F.when(has("error"), "error").when(has("fail"), "fail").when(has("unknown"), "unknown").when(has("notapplicable") & ~has("pass"), "notapplicable").otherwise("pass")


def fold_any(outcomes: list[Column]) -> Column:
    has = lambda r: reduce(lambda a, b: a | b, [o == r for o in outcomes])
    return F.when(has("error"), "error").when(has("pass"), "pass").when(has("unknown"), "unknown").when(has("fail"), "fail").otherwise("notapplicable")


def fold_none(outcomes: list[Column]) -> Column:
    has = lambda r: reduce(lambda a, b: a | b, [o == r for o in outcomes])
    return F.when(has("error"), "error").when(has("pass"), "fail").when(has("unknown"), "unknown").otherwise("pass")


def compile_tree(tree, name: str = "n", block: str | None = None) -> Compiled:
    """Aggregates and outcome of a tree; block names the column of a block inside the device, which ForEach needs."""
    if problem(tree):
        return Compiled(outcome=F.lit("error"))
    if isinstance(tree, AllOf | AnyOf | NoneOf):
        parts = [compile_tree(c, f"{name}_{i}", block) for i, c in enumerate(tree.children)]
        fold = {AllOf: fold_all, AnyOf: fold_any, NoneOf: fold_none}[type(tree)]
        joined = {f: [x for p in parts for x in getattr(p, f)] for f in ("aggregates", "names", "inner", "inner_names", "per_block", "folds")}
        return Compiled(outcome=fold([p.outcome for p in parts]) if parts else F.lit("error"), **joined)
    if isinstance(tree, ForEach):
        sub = compile_tree(tree.sub, f"{name}_s")
        if block is None:
            return Compiled(outcome=F.lit("error"))
        skipped = F.coalesce(F.col("__label").rlike(tree.skip), F.lit(False)) if tree.skip else F.lit(False)
        seen = F.when(F.col(block).isNotNull() & ~skipped, sub.outcome).alias(f"{name}_o")
        has = lambda *r: F.bool_or(F.col(f"{name}_o").isin(*r))
        folded = F.when(has("fail"), "fail").when(has("unknown", "error"), "unknown").when(F.count(f"{name}_o") > 0, "pass").alias(f"{name}_f")
        return Compiled(outcome=F.coalesce(F.col(f"{name}_f"), F.lit(tree.on_no_blocks)), inner=sub.aggregates, inner_names=sub.names, per_block=[seen], folds=[folded])
    here = F.col("path") == tree.path
    total = F.count_if(here).alias(f"{name}_n")
    n = F.coalesce(F.col(f"{name}_n"), F.lit(0))
    if isinstance(tree, Presence):
        return Compiled([total], F.when((n > 0) == F.lit(tree.must_be_present), "pass").otherwise("fail"), [f"{name}_n"])
    if isinstance(tree, Count):
        return Compiled([total], F.when(compare(tree.op, value(n=n), tree.threshold), "pass").otherwise("fail"), [f"{name}_n"])
    ok = compare(tree.op, F.col("value"), tree.expected, tree.fold_case)
    aggregates = [total, F.count_if(here & ok).alias(f"{name}_ok"), F.count_if(here & ok.isNull()).alias(f"{name}_err")]
    good = F.col(f"{name}_ok") == n if tree.quantifier == "all" else F.col(f"{name}_ok") > 0
    outcome = F.when(n == 0, tree.on_missing).when(F.col(f"{name}_err") > 0, "error").when(good, "pass").otherwise("fail")
    return Compiled(aggregates, outcome, [f"{name}_n", f"{name}_ok", f"{name}_err"])


def audit(scope: DataFrame, facts: DataFrame, rules: dict[str, object], keys: list[str], block: str | None = None, label: str | None = None) -> DataFrame:
    """(keys, rule_id, outcome) for every row of scope and every rule; devices without facts get what a tree says of missing ones.

    block and label name the columns of a block inside the device and of its label, for ForEach anywhere in a tree. All rules share one
    shuffle of the facts by device; with blocks, their counts are a second, smaller one.
    """
    made = [(r, compile_tree(t, f"r{i}", block)) for i, (r, t) in enumerate(rules.items())]
    every = lambda f: [x for _, m in made for x in getattr(m, f)]
    counts = [*every("aggregates"), F.count("*").alias("__facts")]
    if every("per_block"):
        # numbers are counted by label first: the largest text of a group is found by sorting, which the facts themselves are spared
        inner = [n for _, m in made for n in m.inner_names]
        sums = [F.sum(n).alias(n) for n in [*every("names"), "__facts", *inner]]
        called = F.col(label) if label else F.lit(None).cast("string")
        parts = facts.groupBy(*keys, block, called.alias("__label")).agg(*counts, *every("inner"))
        parts = parts.groupBy(*keys, block).agg(*sums, F.max("__label").alias("__label"))
        parts = parts.select(*keys, *every("names"), "__facts", *every("per_block"))
        counted = parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in [*every("names"), "__facts"]], *every("folds"))
    else:
        counted = facts.groupBy(*keys).agg(*counts)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule_id"), m.outcome.alias("outcome")) for r, m in made]))
    return scope.select(*keys).join(counted, keys, "left").select(*keys, each.alias("r")).select(*keys, "r.*")


def evaluate(scope: DataFrame, facts: DataFrame, tree, keys: list[str], block: str | None = None, label: str | None = None) -> DataFrame:
    """(keys, outcome) of one tree for every row of scope, as in audit()."""
    return audit(scope, facts, {"": tree}, keys, block, label).drop("rule_id")


def leaves(tree) -> list[FactCheck]:
    """The fact checks of a tree that can be evaluated."""
    inside = [*getattr(tree, "children", ()), *([tree.sub] if isinstance(tree, ForEach) else [])]
    return [tree] if isinstance(tree, FactCheck) and not problem(tree) else [x for c in inside for x in leaves(c)]


def evidence(facts: DataFrame, rules: dict[str, object], keys: list[str], place: str = "line_no") -> DataFrame:
    """(keys, rule_id, path, place) of the facts that speak for a rule's outcome, one row each.

    Of a check of all facts these are its violations and errors, of a check of any the first fact in the order of place that satisfies it.
    The violations need no shuffle, and no group is gathered.
    """
    checks = [(r, x) for r, t in rules.items() for x in leaves(t)]

    def told(quantifier: str, shows) -> DataFrame:
        hits = [F.when((F.col("path") == x.path) & shows(compare(x.op, F.col("value"), x.expected, x.fold_case)), F.lit(r)) for r, x in checks if x.quantifier == quantifier]
        found = F.explode(F.array_distinct(F.array_compact(F.array(*hits)))) if hits else F.explode(F.array().cast("array<string>"))
        return facts.select(*keys, found.alias("rule_id"), "path", place)

    violations = told("all", lambda ok: ~F.coalesce(ok, F.lit(False)))
    first = told("any", lambda ok: F.coalesce(ok, F.lit(False))).groupBy(*keys, "rule_id", "path").agg(F.min(place).alias(place))
    return violations.unionByName(first)


def required(scope: DataFrame, facts: DataFrame, paths: list[str], keys: list[str]) -> DataFrame:
    """(keys, applicable): every path has an observed fact; defaults do not satisfy."""
    seen = [F.count_if((F.col("path") == p) & F.col("present")).alias(f"p{i}") for i, p in enumerate(paths)]
    counted = facts.groupBy(*keys).agg(*seen)
    all_seen = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"p{i}"), F.lit(0)) > 0 for i in range(len(paths))])
    return scope.select(*keys).join(counted, keys, "left").select(*keys, all_seen.alias("applicable"))


CONTROL_RANK = {"fail": 4, "error": 3, "unknown": 2, "pass": 1, "notapplicable": 0}
PROJECTION_RANK = {"fail": 4, "pass": 3, "error": 2, "unknown": 1, "notapplicable": 0}


def ranked(outcome: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(outcome == k, F.lit(v)) for k, v in ranks.items()])


def unranked(rank: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(rank == v, F.lit(k)) for k, v in ranks.items()])


def fold(outcomes: DataFrame, keys: list[str], ranks: dict[str, int]) -> DataFrame:
    """(keys, outcome): the outcome of highest rank in each group; one shuffle with map-side combine."""
    top = outcomes.groupBy(*keys).agg(F.max(ranked(F.col("outcome"), ranks)).alias("rank"))
    return top.select(*keys, unranked(F.col("rank"), ranks).alias("outcome"))


def score(passed: Column, failed: Column) -> Column:
    """100 * pass / (pass + fail) to one digit, half to even; 0 where nothing was decided."""
    return F.coalesce(F.bround(100 * passed / F.nullif(passed + failed, F.lit(0)), 1), F.lit(0.0))
