"""Blocks of lines: runs, depth, brackets, indentation, the tightest block around a line, and extraction by the blocks around it."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.operators.lines import first_match
from ledgerlake.session import kept


def runs(rows: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """rows with run, counted from 1: rows of a group with the same key one after another."""
    by = Window.partitionBy(*group).orderBy(*order)
    changed = F.when(F.col(key).eqNullSafe(F.lag(key).over(by)) & (F.row_number().over(by) > 1), 0).otherwise(1)
    return rows.withColumn("__new", changed).withColumn("run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def running_depth(rows: DataFrame, group: list[str], order: list[str], opens: Column, closes: Column) -> DataFrame:
    """rows with depth: opens minus closes up to and with each row of its group."""
    by = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("depth", F.sum(opens - closes).over(by))


def occurrences(text: Column, part: str) -> Column:
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())).cast("int")


def spans(rows: DataFrame, group: list[str], pos: str, net: Column, anchor: Column, last: Column) -> DataFrame:
    """(group, start, end, depth) of the blocks that anchors open: from the anchor to the first later row that returns to the depth before it.

    net is how many brackets a row opens more than it closes; rows of net 0 that are no anchors may be left out beforehand. A row of several
    brackets counts by its net alone. An anchor that opens nothing is a block of its own, one that is never closed ends at last, the last
    row of its group. An opening and the row that closes it are neighbours among the rows that pass its depth, so nothing is joined.
    """
    rows = rows.select(*group, F.col(pos).alias("at"), net.cast("int").alias("net"), anchor.alias("anchor"), last.alias("last"))
    deep = rows.withColumn("after", F.sum("net").over(Window.partitionBy(*group).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("after") - F.col("net")
    mark = lambda level, alone: F.struct(level.alias("level"), F.lit(alone).alias("alone"))
    closes = F.when(F.col("net") < 0, F.transform(F.sequence(F.col("after") + 1, before), lambda x: mark(x, False)))
    own = F.when(F.col("anchor"), F.when(F.col("net") > 0, F.array(mark(before + 1, False))).otherwise(F.array(mark(before + 1, True))))
    none = F.array().cast("array<struct<level:bigint,alone:boolean>>")
    marks = deep.select(*group, "at", "last", (F.col("net") > 0).alias("opens"), F.inline(F.concat(F.coalesce(closes, none), F.coalesce(own, none))))
    # anchors that open nothing stand apart, so all come from one pass
    level = Window.partitionBy(*group, "alone", "level").orderBy("at")
    found = marks.withColumn("next", F.lead(F.struct("at", "opens")).over(level)).filter("opens OR alone")
    end = F.when(F.col("alone"), F.col("at")).when(~F.col("next.opens"), F.col("next.at")).otherwise(F.col("last"))
    return found.select(*group, F.col("at").alias("start"), end.alias("end"), F.col("level").alias("depth"))


#: Positions of a bin of tightest().
BIN = 16_384
#: Bins are covered by runs of 2**level bins that begin at a multiple of their length; levels are fewer than this.
_LEVELS = 48


def _covered(first: Column, end: Column) -> Column:
    """The runs (level, run) of bins that make up the bins from first up to and without end."""

    def at(k: Column) -> Column:
        low, high = -F.call_function("shiftright", -first, k), F.call_function("shiftright", end, k)
        run = lambda i, there: F.when((low < high) & there, F.struct(k.alias("level"), i.alias("run")))
        return F.array(run(low, F.pmod(low, F.lit(2)) == 1), run(high - 1, F.pmod(high, F.lit(2)) == 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), at)))


def tightest(points: DataFrame, blocks: DataFrame, group: str, point: str, key: list[str], width: int = BIN) -> DataFrame:
    """Each point with the block (block, start, end) around it of least span, then least start, then least block; none: left out.

    Positions are whole numbers, cut into bins of width. Points go to their bin, a block to the bins in which it begins and ends. Of all
    blocks that cover a bin whole only the tightest can matter there; each is put down at the few runs of bins that make up what it covers, and
    a bin looks up the runs it lies in. So rows grow with neither the overlap of blocks nor their length, and a group with many rows is dealt by its
    bins. In a bin, blocks are painted over its points from the widest to the tightest, in one pass over sorted rows. Blocks that end before they start
    hold nothing, and rows without a group or position neither hold nor lie in one.
    """
    kind = {f.name: f.dataType.simpleString() for f in [*points.schema, *blocks.schema]}
    bin_of = lambda c: F.floor(F.col(c) / width).cast("long")
    b = blocks.select(F.col(group).alias("g"), F.col("start").cast("long"), F.col("end").cast("long"), "block").filter("g IS NOT NULL AND end >= start")
    rank = F.struct((F.col("end") - F.col("start")).alias("span"), F.col("start").alias("start"), F.col("block").alias("block"))
    b = b.select("g", "start", "end", rank.alias("rank"), bin_of("start").alias("b1"), bin_of("end").alias("b2"))
    p = points.filter(F.col(group).isNotNull() & F.col(point).isNotNull()).select(F.col(group).alias("g"), bin_of(point).alias("bin"), F.col(point).cast("long").alias("lo"), F.struct(*key).alias("key"))

    ends = b.select("g", "start", "end", "rank", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("bin"))
    parts = ends.select("g", "bin", F.greatest("start", F.col("bin") * width).alias("lo"), F.least("end", F.col("bin") * width + width - 1).alias("hi"), "rank")
    runs_of = b.filter(F.col("b2") - F.col("b1") > 1).select("g", "rank", F.explode(_covered(F.col("b1") + 1, F.col("b2"))).alias("c")).groupBy("g", "c.level", "c.run").agg(F.min("rank").alias("rank"))
    # a bin asks at the levels that its group's blocks reach; n bins are made up of runs of no more levels than n has binary digits
    top = b.filter(F.col("b2") - F.col("b1") > 1).groupBy("g").agg(F.max(F.char_length(F.bin(F.col("b2") - F.col("b1") - 1))).alias("top"))
    # both joins are merged: rows made by explode look far smaller to the planner than they are, and the driver would hold what it sends out
    levels = p.select("g", "bin").distinct().join(top.hint("merge"), "g").select("g", "bin", F.explode(F.sequence(F.lit(0), F.col("top") - 1)).alias("level"))
    lies_in = levels.withColumn("run", F.call_function("shiftright", F.col("bin"), F.col("level")))
    whole = lies_in.join(runs_of.hint("merge"), ["g", "level", "run"]).groupBy("g", "bin").agg(F.min("rank").alias("rank"))
    parts = parts.unionByName(whole.select("g", "bin", (F.col("bin") * width).alias("lo"), (F.col("bin") * width + width - 1).alias("hi"), "rank"))
    # of blocks with the same extent in a bin one is enough
    parts = parts.groupBy("g", "bin", "lo", "hi").agg(F.min("rank").alias("rank"))
    rows = parts.unionByName(p, allowMissingColumns=True)
    rows = rows.select("g", "bin", "lo", "hi", "key", "rank.span", "rank.start", F.col("rank.block").alias("block"))
    return _painted(rows.repartition("g", "bin").sortWithinPartitions("g", "bin", "lo"), group, key, kind)


def _painted(rows: DataFrame, group: str, key: list[str], kind: dict[str, str]) -> DataFrame:
    """(group, key, block) of the points of rows(g, bin, lo, hi, key, span, start, block), in which those of a bin stand together; blocks have no key."""

    def paint(held: pa.Table) -> pa.RecordBatch:
        names = held.column("g").combine_chunks().dictionary_encode().indices.to_numpy()
        bins, lo = held.column("bin").to_numpy(), held.column("lo").to_numpy()
        changes = np.append(True, (names[1:] != names[:-1]) | (bins[1:] != bins[:-1]))
        number = np.cumsum(changes) - 1
        is_block = ~held.column("hi").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        at, of = np.flatnonzero(~is_block), np.flatnonzero(is_block)
        # places of all bins one after another, so that one search serves all of them
        base = np.minimum.reduceat(lo, np.flatnonzero(changes))[number]
        hi = held.column("hi").take(pa.array(of)).to_numpy().astype(np.int64)
        far = int(max((lo - base).max(initial=0), (hi - base[of]).max(initial=0))) + 1
        place = number * far + (lo - base)
        first, end = np.searchsorted(place[at], place[of]), np.searchsorted(place[at], number[of] * far + (hi - base[of]), "right")
        span, start = (held.column(c).take(pa.array(of)).to_numpy().astype(np.int64) for c in ("span", "start"))
        block = held.column("block").take(pa.array(of)).combine_chunks()
        rank = np.argsort(pc.array_sort_indices(block).to_numpy()) if len(of) else np.zeros(0, np.int64)
        chosen = np.full(len(at), -1, np.int64)
        for i in np.lexsort((rank, start, span))[::-1]:
            chosen[first[i] : end[i]] = i
        inside = np.flatnonzero(chosen >= 0)
        taken = held.take(pa.array(at[inside]))
        keys = taken.column("key").combine_chunks()
        return pa.RecordBatch.from_arrays([taken.column("g").combine_chunks(), *[keys.field(k) for k in key], block.take(pa.array(chosen[inside]))], [group, *key, "block"])

    def pass_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            same = lambda a, i, x, j: a.column("g")[i] == x.column("g")[j] and a.column("bin")[i] == x.column("bin")[j]
            cut = batch.num_rows
            while cut and same(batch, cut - 1, batch, batch.num_rows - 1):
                cut -= 1
            if cut or (held and not same(held[-1], held[-1].num_rows - 1, batch, 0)):
                yield paint(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield paint(pa.Table.from_batches(held))

    types = ", ".join(f"`{c}` {kind[c]}" for c in [group, *key, "block"])
    return rows.mapInArrow(pass_over, types)


def around(blocks: DataFrame, group: str, depth: int, width: int = BIN) -> DataFrame:
    """(group, block, chain): each block of blocks(group, block, start, end, kind) with the kinds of the blocks around it, its own first.

    Blocks nest; depth is how many of them do at most. Blocks further out are left out of the chain.
    """
    own = blocks.select(group, "block", "start", "end", "kind")
    # twice as many positions, so that the place just before a block's start is inside what is around it and nothing else
    wide = own.select(group, "block", (F.col("start") * 2).alias("start"), (F.col("end") * 2).alias("end"))
    outer = tightest(own.select(group, F.col("block").alias("inner"), (F.col("start") * 2 - 1).alias("before")), wide, group, "before", ["inner"], width)
    parent = outer.select(group, F.col("inner").alias("block"), F.col("block").alias("parent"))
    chain = kept(own.join(parent, [group, "block"], "left").select(group, "block", F.array("kind").alias("chain"), "parent"), "chains")
    # each step doubles the chains: a block's own, then that of the block where it ends
    for step in range(max(depth - 1, 0).bit_length()):
        up = chain.select(F.col(group).alias("g"), F.col("block").alias("up"), F.col("chain").alias("up_chain"), F.col("parent").alias("up_parent"))
        joined = chain.join(up, (F.col(group) == F.col("g")) & (F.col("parent") == F.col("up")), "left")
        longer = F.slice(F.concat("chain", F.coalesce("up_chain", F.array().cast(chain.schema["chain"].dataType))), 1, depth)
        chain = joined.select(group, "block", longer.alias("chain"), F.col("up_parent").alias("parent"))
        chain = kept(chain, "chains") if 2 << step < depth else chain
    return chain.select(group, "block", "chain")


def scoped_match(line: Column, chain: Column, depth: int, children: dict[str, list[tuple[str, str]]], pack: list[tuple[str, str]], taught: list[tuple[str, str]]) -> Column:
    """(scope, pattern) of the first pattern that matches the line: those of the blocks in chain, innermost first, then the pack's, then taught ones.

    Null if none does. scope is the kind of the block, pack or taught. A taught pattern never takes a line from a vetted one.
    """
    hit = lambda scope, pattern: F.when(pattern.isNotNull(), F.struct(scope.alias("scope"), pattern.alias("pattern")))
    own = {kind: first_match(line, patterns) for kind, patterns in children.items() if patterns}
    tried = []
    for i in range(depth):
        kind = F.get(chain, F.lit(i))
        if own:
            by_kind = reduce(lambda a, x: a.when(kind == x[0], x[1]), list(own.items())[1:], F.when(kind == next(iter(own)), own[next(iter(own))]))
            tried.append(hit(kind, by_kind))
    for scope, patterns in (("pack", pack), ("taught", taught)):
        if patterns:
            tried.append(hit(F.lit(scope), first_match(line, patterns)))
    return F.coalesce(*tried)


def extract(lines: DataFrame, blocks: DataFrame, group: str, depth: int, children: dict, pack: list, taught: list, width: int = BIN) -> tuple[DataFrame, DataFrame]:
    """The matched lines and the residue of lines(group, line_no, stripped, ...).

    Matched lines have scope and pattern; those of the residue have the line number (block), kind (block_path) and text (block_line) of
    the innermost block's anchor, null outside all blocks. Anchors of blocks(group, block, start, end, kind) are in neither.
    """
    # blocks are asked for in several places, and found once
    blocks = kept(blocks.select(group, "block", "start", "end", "kind"), "blocks")
    rest = lines.join(blocks.select(group, F.col("start").alias("line_no")).distinct(), [group, "line_no"], "left_anti")
    inside = tightest(lines.select(group, "line_no"), blocks, group, "line_no", ["line_no"], width).distinct()
    # chains find their lines' numbers first, so that texts move once
    placed = rest.join(inside.join(around(blocks, group, depth, width), [group, "block"], "left"), [group, "line_no"], "left")
    decided = placed.withColumn("m", scoped_match(F.col("stripped"), F.col("chain"), depth, children, pack, taught))
    matched = decided.filter("m IS NOT NULL").select(*lines.columns, "m.scope", "m.pattern")
    anchors = blocks.select(group, "block", F.col("start").alias("line_no")).join(lines.select(group, "line_no", F.col("stripped").alias("block_line")), [group, "line_no"]).select(group, "block", "block_line")
    left = decided.filter("m IS NULL").select(*lines.columns, "block", F.get("chain", F.lit(0)).alias("block_path"))
    return matched, left.join(anchors, [group, "block"], "left").select(*lines.columns, "block", "block_path", "block_line")


def indent_blocks(lines: DataFrame, key: str, anchor: str) -> DataFrame:
    """(key, start, end) of the blocks that anchor lines open in lines(key, line_no, stripped, indent).

    A block ends before the first later line that is not blank and indented no deeper. What is an anchor is told before lines move, so that their
    texts do not; files then stand one after another in Arrow batches, scanned with a stack of the open blocks. A file may go on in the next batch.
    """

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_anchor = re.compile(anchor).match
        for batch in batches:
            opens = pa.array([is_anchor(t) is not None for t in batch.column("stripped").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("line_no"), batch.column("indent"), opens], [key, "line_no", "indent", "opens"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, open_, last = None, [], 0
        told = lambda names, found: pa.RecordBatch.from_arrays([names, *[pa.array([x[i] for x in found], pa.int32()) for i in (1, 2)]], [key, "start", "end"])
        for batch in batches:
            if not batch.num_rows:
                continue
            names, found = batch.column(key), []
            code = names.dictionary_encode("encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1), len(code)]
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("line_no", "indent", "opens")], strict=True))
            for a, b in itertools.pairwise(cuts):
                if a > 0:
                    found += [(a - 1, start, last) for start, _ in open_]
                elif name is not None and name[0] != names[0] and open_:
                    yield told(name.take(pa.array([0] * len(open_))), [(0, start, last) for start, _ in open_])
                if a > 0 or name is None or name[0] != names[0]:
                    open_, last = [], 0
                for i, (no, indent, opens) in enumerate(rows[a:b], a):
                    while open_ and indent <= open_[-1][1]:
                        found.append((i, open_.pop()[0], last))
                    last = no
                    if opens:
                        open_.append((no, indent))
            name = names.slice(len(code) - 1, 1)
            yield told(names.take(pa.array([i for i, _, _ in found], pa.int64())), found)
        if open_:
            yield told(name.take(pa.array([0] * len(open_))), [(0, start, last) for start, _ in open_])

    own = lines.filter("stripped <> ''").select(key, "line_no", "stripped", "indent")
    kind = {c: own.schema[c].dataType.simpleString() for c in (key, "line_no", "indent")}
    flagged = own.mapInArrow(flag, ", ".join([*[f"`{c}` {k}" for c, k in kind.items()], "opens boolean"]))
    return flagged.repartition(key).sortWithinPartitions(key, "line_no").mapInArrow(scan, f"`{key}` {kind[key]}, start int, end int")
