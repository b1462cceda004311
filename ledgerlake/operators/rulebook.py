"""Rule sets as data: any number of rules over any number of devices in a plan that does not grow with the rules.

A rule set becomes a table of its distinct checks, a row for each path, joined to the facts by path; what a check expects is a column
there, not part of the plan. A fact gets a code for each check of its path, and facts of a device (and of a block, where a for_each asks) with
equal codes are counted together before they move. Devices then have one row, in which the counts give the outcomes of all checks; checks without facts
have an outcome that the rule set alone gives. Trees are folded from the leaves up for a whole Arrow batch of devices at a time, a node being one array
operation over its children, and from the root down again for the evidence. So neither rows nor shuffles grow with the rules.

Outcomes are those of operators.conditions.audit. The evidence of an outcome follows its tree: a failed all_of shows what failed in it, a passed one
all that passed; any_of the first alternative that passed or all that failed; a failed none_of what was satisfied; a failed for_each the failing
blocks' evidence, or a block's anchor (its first fact) where that is empty, a passed one the anchors of all its blocks. Skipped blocks give none. A
check shows the facts that violate it, or those that satisfy it when it passed (the first, if one is enough); presence the first fact or all
forbidden ones; a count all facts. Outcomes other than pass and fail have no evidence.

Rules that cannot be evaluated are errors, the others go on. The driver holds the rule set and nothing of the facts; its table of checks is sent
to all executors where it is small, and else joined by path. A device without facts gets what the rules say of missing ones; no rules give no
rows. Repeated facts count as often as they are there and are one row of evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import conditions as c
from ledgerlake.session import kept

#: Rows of the table of checks up to which it is sent to all executors.
SMALL = 50_000
#: Ordered checks of one path from which on their codes are made in Arrow batches, not by an expression for each.
MANY = 4
CODE = {r: i for i, r in enumerate(c.RESULTS)}
PASS, FAIL, ERROR, UNKNOWN, INAPPLICABLE = (CODE[r] for r in ("pass", "fail", "error", "unknown", "notapplicable"))
_CHECK = f"struct<form:string,op:string,e:{c.EXPECTED}>"
_FORMS = ("FactCheck", "Presence", "Count")
#: How an operator over whole numbers acts: as one of these; others as eq.
_NUMERIC = {"gt": np.greater, "gte": np.greater_equal, "lt": np.less, "lte": np.less_equal, **dict.fromkeys(("ne", "not_in", "not_contains", "disjoint_from"), np.not_equal)}


@dataclass
class Rulebook:
    """A rule set with its distinct checks numbered; a tree refers to them by number.

    A leaf belongs to the device (each is -1) or to a for_each. Behind the device's leaves come the outcomes of the for_eachs, as leaves of
    their own. trees are nested tuples: ("leaf", n), ("error",), or a fold and its children.
    """

    names: list[str] = field(default_factory=list)
    trees: list[tuple] = field(default_factory=list)
    checks: dict[tuple, int] = field(default_factory=dict)
    missing: dict[int, list[int]] = field(default_factory=lambda: {-1: []})
    eaches: list[tuple[tuple, str | None, int]] = field(default_factory=list)
    #: By path, in the order of their first check: the checks of devices and those of blocks, each with its leaf.
    paths: dict[str, tuple[list, list]] = field(default_factory=dict)

    @classmethod
    def of(cls, rules: dict[str, object]) -> Rulebook:
        book = cls()
        for name, tree in rules.items():
            book.names.append(name)
            book.trees.append(book._flat(tree, -1))
        return book

    def _flat(self, tree, each: int) -> tuple:
        if c.problem(tree):
            return ("error",)
        if isinstance(tree, c.AllOf | c.AnyOf | c.NoneOf):
            return (type(tree).__name__, *[self._flat(x, each) for x in tree.children]) if tree.children else ("error",)
        if isinstance(tree, c.ForEach):
            if each >= 0:  # blocks hold no blocks
                return ("error",)
            number = len(self.eaches)
            self.eaches.append((("error",), tree.skip, CODE[tree.on_no_blocks]))
            self.missing[number] = []
            self.eaches[number] = (self._flat(tree.sub, number), *self.eaches[number][1:])
            return ("each", number)
        key = (each, tree if not isinstance(tree, c.FactCheck) else repr(tree))
        if key not in self.checks:
            self.checks[key] = len(self.missing[each])
            self.missing[each].append(_without_facts(tree))
            self.paths.setdefault(tree.path, ([], []))[each >= 0].append((tree, each, self.checks[key]))
        return ("leaf", self.checks[key])

    def table(self, spark: SparkSession) -> DataFrame:
        """(path, path_id, on_device, checks): a path's checks but those in batched(), the first on_device of all are devices'; sent to all executors where the checks are few."""
        apart = self.batched()
        rows = [(p, i, len(sides[0]), [_fields(x) for x in _of_path(sides) if i not in apart or not _is_ordered(x)]) for i, (p, sides) in enumerate(self.paths.items())]
        table = spark.createDataFrame(rows, f"path string, path_id int, on_device int, checks array<{_CHECK}>")
        return F.broadcast(table) if len(self.checks) <= SMALL else table

    def batched(self) -> dict[int, Ordered]:
        """The ordered checks of the paths that have MANY of them, by path_id."""
        found = {i: Ordered.of(_of_path(sides)) for i, sides in enumerate(self.paths.values())}
        return {i: x for i, x in found.items() if len(x.at) >= MANY}

    def positions(self, spark: SparkSession) -> DataFrame:
        """(each, leaf, path, at, form, every) of every check; at is its place among those of its path, devices' and blocks' apart."""
        rows = [(each, leaf, p, at, type(x).__name__, getattr(x, "quantifier", "all") == "all") for p, sides in self.paths.items() for side in sides for at, (x, each, leaf) in enumerate(side)]
        table = spark.createDataFrame(rows, "each int, leaf int, path string, at int, form string, every boolean")
        return F.broadcast(table) if len(rows) <= SMALL else table

    def tallies(self, blocks: bool) -> list[Tally]:
        """For each path what turns counts into outcomes."""
        return [Tally.of(sides[blocks]) for sides in self.paths.values()]


def _of_path(sides: tuple[list, list]) -> list:
    return [x for side in sides for x, _, _ in side]


def _is_ordered(check) -> bool:
    return isinstance(check, c.FactCheck) and check.op in c.ORDERED


def _without_facts(check) -> int:
    if isinstance(check, c.FactCheck):
        return CODE[check.on_missing]
    if isinstance(check, c.Presence):
        return FAIL if check.must_be_present else PASS
    return PASS if _NUMERIC.get(check.op, np.equal)(0, float(check.threshold)) else FAIL


def _fields(check) -> tuple:
    form = type(check).__name__
    e = c.expected_of(check.op, check.expected, check.fold_case) if form == "FactCheck" else None
    return form, getattr(check, "op", None), e and tuple(e[f.split(":")[0]] for f in c.EXPECTED[len("struct<") : -1].split(","))


@dataclass(frozen=True)
class Tally:
    """The checks of a path as arrays: whose they are, and what they make of how many facts there are, satisfy them, and cannot be compared."""

    each: np.ndarray
    leaf: np.ndarray
    form: np.ndarray
    every: np.ndarray
    counts: list[tuple[int, object, float]]

    @classmethod
    def of(cls, side: list[tuple]) -> Tally:
        of = lambda f, kind: np.array([f(x) for x in side], kind)
        counts = [(i, _NUMERIC.get(x.op, np.equal), float(x.threshold)) for i, (x, _, _) in enumerate(side) if isinstance(x, c.Count)]
        every = of(lambda x: x[0].must_be_present if isinstance(x[0], c.Presence) else getattr(x[0], "quantifier", "all") == "all", bool)
        return cls(of(lambda x: x[1], np.int32), of(lambda x: x[2], np.int32), of(lambda x: _FORMS.index(type(x[0]).__name__), np.int8), every, counts)

    def outcomes(self, n: np.ndarray, ok: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """A row for each group of facts, a column for each check; n has a number for each row, ok and bad for each check as well."""
        good = np.where(self.every, ok == n[:, None], ok > 0)
        found = np.where(bad > 0, ERROR, np.where(good, PASS, FAIL))
        found = np.where(self.form == 1, np.where(self.every, PASS, FAIL), found)
        for i, met, threshold in self.counts:
            found[:, i] = np.where(met(n, threshold), PASS, FAIL)
        return found.astype(np.int8)


@dataclass(frozen=True)
class Ordered:
    """The ordered checks of a path: their places among its checks, operators and thresholds; rest are the places of its other checks."""

    at: np.ndarray
    op: np.ndarray
    threshold: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, checks: list) -> Ordered:
        own = [(i, x.op, c.expected_of(x.op, x.expected)["number"]) for i, x in enumerate(checks) if _is_ordered(x)]
        of = lambda k, kind: np.array([x[k] for x in own], kind)
        return cls(of(0, np.int64), of(1, object), of(2, np.float64), np.array([i for i, x in enumerate(checks) if not _is_ordered(x)], np.int64))

    def codes(self, n: np.ndarray, known: np.ndarray, others: np.ndarray) -> np.ndarray:
        """A row for each number, a column for each check of the path; NaN is above all numbers, as in Spark."""
        found = np.empty((len(n), len(self.at) + len(self.rest)), np.int8)
        found[:, self.rest] = others
        for op in set(self.op):
            own = self.op == op
            x, t = n[:, None], self.threshold[own][None, :]
            if op in ("gt", "lte"):
                held = ((x > t) | (np.isnan(x) & ~np.isnan(t))) == (op == "gt")
            else:
                held = ((x < t) | (np.isnan(t) & ~np.isnan(x))) == (op == "lt")
            found[:, self.at[own]] = np.where(known[:, None], held, 2)
        return found


def tallied(lists: pa.Array, tallies: list[Tally]) -> Iterator[tuple[np.ndarray, Tally, np.ndarray]]:
    """(rows, tally, outcomes) for each path that occurs in lists of (path_id, codes, n)."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    if not len(flat):
        return
    row, path, n = np.repeat(np.arange(len(lists)), sizes), flat.field("path_id").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
    codes = flat.field("codes")
    start, values = codes.offsets.to_numpy()[:-1], codes.values.to_numpy(zero_copy_only=False)
    for p in np.unique(path):
        tally, at = tallies[p], np.flatnonzero(path == p)
        own = values[start[at][:, None] + np.arange(len(tally.leaf))]
        first = np.flatnonzero(np.append(True, row[at][1:] != row[at][:-1]))
        many = n[at][:, None]
        total, ok, bad = (np.add.reduceat(x, first) for x in (n[at], (own == 1) * many, (own == 2) * many))
        yield row[at][first], tally, tally.outcomes(total, ok, bad)


_NEGATED = ("ne", "not_in", "not_contains", "regex_not_match")


def _decided(op: Column, v: Column, e: Column) -> Column:
    """The operator that a column names. An operator and its negation share one expression, so that plans stay small."""
    pairs = (("eq", "ne"), ("in", "not_in"), ("contains", "not_contains"), ("regex_match", "regex_not_match"), *[(x,) for x in ("gt", "gte", "lt", "lte", "subset_of", "superset_of", "disjoint_from")])
    found = F.when(op.isin(*pairs[0]), c.OPERATORS[pairs[0][0]](v, e))
    for names in pairs[1:]:
        found = found.when(op.isin(*names), c.OPERATORS[names[0]](v, e))
    return found != op.isin(*_NEGATED)


def _codes() -> Column:
    """For each check of a path whether the value satisfies it: 0, 1, or 2 where it cannot be compared."""
    one = lambda x: F.when(x["form"] != "FactCheck", F.lit(1)).otherwise(F.coalesce(_decided(x["op"], F.col("value"), x["e"]).cast("int"), F.lit(2))).cast("tinyint")
    return F.transform("checks", one)


def checked(facts: DataFrame, book: Rulebook, keys: list[str], block: str | None, label: str | None, place: str) -> DataFrame:
    """(keys, path, path_id, place, blk, label, device_codes, block_codes) of the facts at the rules' paths; with for_eachs, of all facts in blocks as well."""
    named = block is not None and bool(book.eaches)
    blk = F.col(block).cast("string") if named else F.lit(None).cast("string")
    text = F.col(label).cast("string") if label and named else F.lit(None).cast("string")
    met = facts.select(*keys, "path", "value", F.col(place).alias("place"), blk.alias("blk"), text.alias("label"))
    rows = met.join(book.table(facts.sparkSession), "path", "left" if named else "inner")
    rows = rows.filter(F.col("path_id").isNotNull() | F.col("blk").isNotNull()) if named else rows
    columns = [*keys, "path", "path_id", "place", "blk", "label", "on_device"]
    if apart := book.batched():
        numbered = rows.select(*columns, c.as_number(F.col("value")).alias("number"), _codes().alias("codes"))
        coded = numbered.mapInArrow(lambda batches: (_filled(x, apart) for x in batches), ", ".join([*[f"`{k}` {numbered.schema[k].dataType.simpleString()}" for k in columns], "codes array<tinyint>"]))
    else:
        coded = rows.select(*columns, _codes().alias("codes"))
    device = F.slice("codes", F.lit(1), F.col("on_device"))
    block = F.slice("codes", F.col("on_device") + 1, F.size("codes") - F.col("on_device"))
    return coded.select(*keys, "path", "path_id", "place", "blk", "label", device.alias("device_codes"), block.alias("block_codes"))


def _filled(batch: pa.RecordBatch, apart: dict[int, Ordered]) -> pa.RecordBatch:
    """The batch with the codes of ordered checks among the other ones."""
    path = batch.column("path_id").fill_null(-1).to_numpy(zero_copy_only=False)
    codes, number = batch.column("codes"), batch.column("number")
    known, n = ~number.is_null().to_numpy(zero_copy_only=False), number.fill_null(0.0).to_numpy(zero_copy_only=False)
    starts, sizes, values = codes.offsets.to_numpy()[:-1], codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), codes.values.to_numpy(zero_copy_only=False)
    wide = sizes.copy()
    for p, own in apart.items():
        wide[path == p] = len(own.at) + len(own.rest)
    ends = np.append(0, np.cumsum(wide))
    flat = np.empty(ends[-1], np.int8)
    for p in np.unique(path):
        rows = np.flatnonzero(path == p)
        others = values[starts[rows][:, None] + np.arange(sizes[rows[0]])]
        flat[ends[rows][:, None] + np.arange(wide[rows[0]])] = apart[p].codes(n[rows], known[rows], others) if p in apart else others
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=codes.is_null() if codes.null_count else None)
    kept_columns = [x for x in batch.schema.names if x not in ("codes", "number")]
    return pa.RecordBatch.from_arrays([*[batch.column(x) for x in kept_columns], lists], [*kept_columns, "codes"])


def _counted(rows: DataFrame, book: Rulebook, keys: list[str]) -> DataFrame:
    """(keys, blk, path_id, device_codes, block_codes, n): facts with equal codes together; with blocks also whether they are in one, and its label."""
    # by label, too: the largest text of a group would be found by sorting all facts
    by = [*keys, "blk", "label", "path_id", "device_codes", "block_codes"] if book.eaches else [*keys, "path_id", "device_codes"]
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.withColumn("inside", F.col("blk").isNotNull()) if book.eaches else counts


# Folds over arrays: a row for each device or block of a batch, codes of outcomes.


def outcome_of(node: tuple, leaves: np.ndarray, memo: dict[int, np.ndarray]) -> np.ndarray:
    """The outcome of a node in every row; leaves has a column for each leaf, those of for_eachs last."""
    if id(node) in memo:
        return memo[id(node)]
    kind = node[0]
    if kind == "error":
        found = np.full(len(leaves), ERROR, np.int8)
    elif kind == "leaf":
        found = leaves[:, node[1]]
    elif kind == "each":
        found = leaves[:, leaves.shape[1] - 1 - node[1]]
    else:
        parts = [outcome_of(x, leaves, memo) for x in node[1:]]
        has = lambda code: np.logical_or.reduce([p == code for p in parts])
        if kind == "AllOf":
            order = [(has(ERROR), ERROR), (has(FAIL), FAIL), (has(UNKNOWN), UNKNOWN), (has(INAPPLICABLE) & ~has(PASS), INAPPLICABLE)]
            rest = PASS
        elif kind == "AnyOf":
            order, rest = [(has(x), x) for x in (ERROR, PASS, UNKNOWN, FAIL)], INAPPLICABLE
        else:
            order, rest = [(has(ERROR), ERROR), (has(PASS), FAIL), (has(UNKNOWN), UNKNOWN)], PASS
        found = np.select([x for x, _ in order], [np.int8(r) for _, r in order], np.int8(rest))
    memo[id(node)] = found
    return found


def shown_by(node: tuple, rows: np.ndarray, memo: dict[int, np.ndarray]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The leaves (and for_eachs) that speak for a node's outcome, and in which of the given rows."""
    out = memo[id(node)]
    rows = rows & ((out == PASS) | (out == FAIL))
    if node[0] in ("leaf", "each"):
        yield node, rows
        return
    for x in node[1:] if node[0] != "error" else ():
        own = memo[id(x)]
        if node[0] == "AllOf":
            yield from shown_by(x, rows & (own == out), memo)
        elif node[0] == "NoneOf":
            yield from shown_by(x, rows & (out == FAIL) & (own == PASS), memo)
        else:
            chosen = rows & (own == out)
            yield from shown_by(x, chosen, memo)
            rows = rows & ~(chosen & (out == PASS))  # the first that passes is enough


def _pairs(parts: list[tuple[int, int, int, np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """Lists of (rule, each, leaf, outcome), for n rows, from (rule, each, leaf, rows, outcomes)."""
    rows = np.concatenate([np.flatnonzero(r) for *_, r, _ in parts]) if parts else np.zeros(0, np.int64)
    columns = [np.repeat([p[i] for p in parts], [int(p[3].sum()) for p in parts]).astype(np.int32) for i in range(3)] if parts else [rows.astype(np.int32)] * 3
    outcome = np.concatenate([o[r] for *_, r, o in parts]) if parts else rows.astype(np.int8)
    by = np.argsort(rows, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(rows, minlength=n)))
    items = pa.StructArray.from_arrays([*[pa.array(x[by]) for x in columns], pa.array(outcome[by])], ["rule", "each", "leaf", "outcome"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


_PAIRS = "array<struct<rule:int,each:int,leaf:int,outcome:tinyint>>"


def _blocks(counts: DataFrame, book: Rulebook, keys: list[str]) -> DataFrame:
    """(keys, blk, each, outcome, shown): each block's outcome under each for_each that does not skip it.

    shown are the checks that speak for a failing block, an empty list where none has facts.
    """
    item = F.struct("path_id", F.col("block_codes").alias("codes"), "n")
    label = F.coalesce("label", F.lit(""))
    skip = F.array(*[label.rlike(f"(?iu){s}") if s else F.lit(False) for _, s, _ in book.eaches])
    rows = counts.filter("inside").groupBy(*keys, "blk").agg(F.collect_list(F.when(F.size("block_codes") > 0, item)).alias("found"), F.max("label").alias("label")).select(*keys, "blk", "found", skip.alias("skip"))
    trees, missing, tallies = [t for t, *_ in book.eaches], [book.missing[i] for i in range(len(book.eaches))], book.tallies(True)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            leaves = [np.tile(np.array(none, np.int8), (n, 1)) for none in missing]
            for row, tally, found in tallied(batch.column("found"), tallies):
                for at, (each, leaf) in enumerate(zip(tally.each, tally.leaf, strict=True)):
                    leaves[each][row, leaf] = found[:, at]
            outcomes, parts = [], []
            for i, tree in enumerate(trees):
                memo: dict[int, np.ndarray] = {}
                outcomes.append(outcome_of(tree, leaves[i], memo))
                parts += [(-1, i, node[1], rows, memo[id(node)]) for node, rows in shown_by(tree, outcomes[-1] == FAIL, memo)]
            codes = np.stack(outcomes, axis=1)
            skipped = batch.column("skip").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            codes = np.where(skipped, -1, codes).astype(np.int8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in [*keys, "blk"]], lists, _pairs(parts, n)], [*keys, "blk", "codes", "shown"])

    types = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in [*keys, "blk"])
    folded = rows.mapInArrow(fold, f"{types}codes array<tinyint>, shown {_PAIRS}")
    by_each = folded.select(*keys, "blk", "shown", F.posexplode("codes").alias("each", "outcome")).filter("outcome >= 0")
    return by_each.withColumn("shown", F.when(F.col("outcome") == FAIL, F.filter("shown", lambda s: s["each"] == F.col("each"))))


def _device_leaves(counts: DataFrame, blocks: DataFrame | None, book: Rulebook, keys: list[str]) -> DataFrame:
    """(keys, found, eaches): a device's counts by path and codes, and the outcomes of its for_eachs."""
    item = F.struct("path_id", F.col("device_codes").alias("codes"), "n")
    if blocks is None:
        return counts.groupBy(*keys).agg(F.collect_list(item).alias("found"), F.array().cast("array<struct<each:int,outcome:tinyint>>").alias("eaches"))
    # blocks of a device are added up before its counts are gathered
    whole = counts.filter(F.size("device_codes") > 0).groupBy(*keys, "path_id", "device_codes").agg(F.sum("n").alias("n")).select(*keys, item.alias("item"))
    has = lambda *codes: F.bool_or(F.col("outcome").isin(*codes))
    code = F.when(has(FAIL), F.lit(FAIL)).when(has(UNKNOWN, ERROR), F.lit(UNKNOWN)).otherwise(F.lit(PASS))
    each = blocks.groupBy(*keys, "each").agg(code.cast("tinyint").alias("outcome")).select(*keys, F.struct("each", "outcome").alias("of"))
    both = whole.unionByName(each, allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.collect_list("item").alias("found"), F.collect_list("of").alias("eaches"))


def _folded(scope: DataFrame, leaves: DataFrame, book: Rulebook, keys: list[str], evidence: bool) -> DataFrame:
    """(keys, codes, shown) of every row of scope: the outcomes of all rules, and with evidence the leaves behind them."""
    rows = scope.select(*keys).join(leaves, keys, "left")
    missing = book.missing[-1] + [none for _, _, none in reversed(book.eaches)]
    trees, tallies = book.trees, book.tallies(False)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, eaches = (batch.column(x).fill_null([]) for x in ("found", "eaches"))
            leaves, memo = np.tile(np.array(missing, np.int8), (batch.num_rows, 1)), {}
            for row, tally, outcomes in tallied(found, tallies):
                leaves[row[:, None], tally.leaf] = outcomes
            if len(flat := eaches.flatten()):
                row = np.repeat(np.arange(len(eaches)), np.diff(eaches.offsets.to_numpy()))
                leaves[row, leaves.shape[1] - 1 - flat.field("each").to_numpy(zero_copy_only=False)] = flat.field("outcome").to_numpy(zero_copy_only=False)
            codes = np.stack([outcome_of(t, leaves, memo) for t in trees], axis=1)
            n, parts = batch.num_rows, []
            if evidence:
                for r, tree in enumerate(trees):
                    for node, where in shown_by(tree, np.ones(n, bool), memo):
                        each = node[1] if node[0] == "each" else -1
                        parts.append((r, each, -1 if each >= 0 else node[1], where, memo[id(node)]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], lists, _pairs(parts, n)], [*keys, "codes", "shown"])

    types = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(fold, f"{types}codes array<tinyint>, shown {_PAIRS}")


def _stages(scope: DataFrame, facts: DataFrame, book: Rulebook, keys: list[str], block: str | None, label: str | None, place: str, evidence: bool):
    met = checked(facts, book, keys, block, label, place)
    counts = _counted(met, book, keys)
    blocks = _blocks(counts, book, keys) if block is not None and book.eaches else None
    if evidence and blocks is not None:  # evidence asks for the outcomes of blocks and devices more than once
        blocks = kept(blocks, "blocks")
    folded = _folded(scope, _device_leaves(counts, blocks, book, keys), book, keys, evidence)
    return met, blocks, kept(folded, "devices") if evidence else folded


def _named(rows: DataFrame, book: Rulebook, keys: list[str]) -> DataFrame:
    names, results = F.lit(book.names), F.lit(list(c.RESULTS))
    each = rows.select(*keys, F.posexplode("codes").alias("r", "code"))
    return each.select(*keys, F.get(names, F.col("r")).alias("rule_id"), F.get(results, F.col("code").cast("int")).alias("outcome"))


def decide(scope: DataFrame, facts: DataFrame, rules: dict[str, object], keys: list[str], block: str | None = None, label: str | None = None) -> DataFrame:
    """(keys, rule_id, outcome) for every row of scope and every rule, as conditions.audit() gives them."""
    book = Rulebook.of(rules)
    if not rules:
        return scope.select(*keys, F.lit("").alias("rule_id"), F.lit("").alias("outcome")).limit(0)
    _, _, folded = _stages(scope, facts.withColumn("__place", F.lit(0)), book, keys, block, label, "__place", False)
    return _named(folded, book, keys)


def outcome_counts(scope: DataFrame, facts: DataFrame, rules: dict[str, object], keys: list[str], block: str | None = None, label: str | None = None) -> DataFrame:
    """(rule_id, outcome, devices): how many rows of scope have each outcome of decide(), added up in every batch before rows are made."""
    if not rules:
        return decide(scope, facts, rules, keys, block, label).groupBy("rule_id", "outcome").agg(F.count("*").alias("devices"))
    book = Rulebook.of(rules)
    _, _, folded = _stages(scope, facts.withColumn("__place", F.lit(0)), book, keys, block, label, "__place", False)
    many = len(book.trees)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(CODE), many), np.int64)
        for batch in batches:
            codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(-1, many)
            total += np.stack([(codes == x).sum(0) for x in range(len(CODE))])
        code, rule = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(rule.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(total[code, rule])], ["r", "code", "n"])

    counts = folded.select("codes").mapInArrow(add_up, "r int, code int, n long").groupBy("r", "code").agg(F.sum("n").alias("devices"))
    return counts.select(F.get(F.lit(book.names), F.col("r")).alias("rule_id"), F.get(F.lit(list(c.RESULTS)), F.col("code")).alias("outcome"), "devices")


def evidence(scope: DataFrame, facts: DataFrame, rules: dict[str, object], keys: list[str], place: str = "line_no", block: str | None = None, label: str | None = None) -> DataFrame:
    """(keys, rule_id, outcome, path, place): the distinct facts that speak for the outcome of each rule that passes or fails."""
    book = Rulebook.of(rules)
    met, blocks, folded = _stages(scope, facts, book, keys, block, label, place, True)
    shown = folded.select(*keys, "codes", F.explode("shown").alias("s")).select(*keys, "s.rule", "s.each", "s.leaf", F.col("s.outcome").alias("says"), F.get("codes", F.col("s.rule")).alias("out"))
    own = shown.filter("each < 0").select(*keys, "rule", "each", F.lit(None).cast("string").alias("blk"), "leaf", "says", "out")
    anchors = None
    if blocks is not None:
        held = shown.filter("each >= 0").select(*keys, "rule", "each", "says", "out").join(blocks, [*keys, "each"])
        failing = held.filter((F.col("says") == FAIL) & (F.col("outcome") == FAIL))
        deep = failing.select(*keys, "rule", "each", "blk", "out", F.explode("shown").alias("s")).select(*keys, "rule", "each", "blk", F.col("s.leaf").alias("leaf"), F.col("s.outcome").alias("says"), "out")
        own = own.unionByName(deep)
        anchors = held.filter((F.col("says") == PASS) | (F.col("outcome") == FAIL)).select(*keys, "rule", "blk", "each", "out")
    # facts meet what is shown by their path (and block), and each then looks up its own code
    wanted = own.join(book.positions(facts.sparkSession), ["each", "leaf"]).withColumn("blk", F.coalesce("blk", F.lit("")))
    on_device = met.filter(F.size("device_codes") > 0).select(*keys, F.lit("").alias("blk"), "path", "place", F.col("device_codes").alias("codes"))
    joined = wanted.filter("each < 0").join(on_device, [*keys, "blk", "path"])
    if blocks is not None:
        in_block = met.filter(F.col("blk").isNotNull() & (F.size("block_codes") > 0)).select(*keys, "blk", "path", "place", F.col("block_codes").alias("codes"))
        joined = joined.unionByName(wanted.filter("each >= 0").join(in_block, [*keys, "blk", "path"]))
    joined = joined.withColumn("ok", F.get("codes", F.col("at")) == 1)
    passed = F.col("says") == PASS
    speaks = F.when(F.col("form") == "FactCheck", F.col("ok") == passed).otherwise(F.lit(True))
    alone = passed & (F.col("form").isin("Presence") | ((F.col("form") == "FactCheck") & ~F.col("every")))
    rows = joined.filter(speaks).select(*keys, "rule", "out", "each", "blk", "leaf", "path", "place", alone.alias("alone"))
    many = rows.filter("NOT alone").select(*keys, "rule", "out", "path", "place", "each", "blk")
    # a leaf has one path
    first = rows.filter("alone").groupBy(*keys, "rule", "out", "each", "blk", "leaf", "path").agg(F.min("place").alias("place"))
    found = many.unionByName(first.select(*keys, "rule", "out", "path", "place", "each", "blk"))
    if anchors is not None:
        starts = met.filter("blk IS NOT NULL").groupBy(*keys, "blk").agg(F.min(F.struct(F.col("place").isNull(), "place", "path")).alias("m"))
        # a failing block without evidence of its own shows its anchor
        bare = anchors.join(found.filter("each >= 0").select(*keys, "rule", "blk", "each").distinct(), [*keys, "rule", "blk", "each"], "left_anti")
        found = found.unionByName(bare.join(starts, [*keys, "blk"]).select(*keys, "rule", "out", "m.path", "m.place", "each", "blk"))
    names, results = F.lit(book.names), F.lit(list(c.RESULTS))
    told = found.select(*keys, "rule", "out", "path", "place").distinct()
    return told.select(*keys, F.get(names, F.col("rule")).alias("rule_id"), F.get(results, F.col("out").cast("int")).alias("outcome"), "path", F.col("place").alias(place))


def control_fold(outcomes: DataFrame, shown: DataFrame, controls: DataFrame, keys: list[str], place: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(keys, control, outcome) and (keys, control, path, place) of controls(rule_id, control).

    A control has the gravest outcome of its rules, and the distinct evidence of the rules that have it; a passing control that of all its rules.
    """
    mapped = F.broadcast(controls) if controls.limit(SMALL + 1).count() <= SMALL else controls
    by_rule = outcomes.join(mapped, "rule_id")
    whole = c.fold(by_rule.select(*keys, "control", "outcome"), [*keys, "control"], c.CONTROL_RANK)
    chosen = shown.join(mapped, "rule_id").withColumnRenamed("outcome", "own").join(whole, [*keys, "control"])
    # rules that pass do not speak for a control that fails, nor failing ones for any other
    same = (F.col("outcome").isin("pass", "notapplicable") & (F.col("own") == "pass")) | (F.col("own") == F.col("outcome"))
    return whole, chosen.filter(same).select(*keys, "control", "path", place).distinct()
