"""Catalogs of controls as trees of any depth, in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.scalars import control_id


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _named(v: Column, name: str) -> Column:
    """The value of the first prop of that name, null without one."""
    props = F.transform(_list(v, "$.props"), lambda p: F.struct(F.try_variant_get(p, "$.name", "string").alias("name"), F.try_variant_get(p, "$.value", "string").alias("value")))
    return F.get(F.filter(props, lambda p: p["name"] == name), F.lit(0))["value"]


def with_parameters(prose: Column) -> Column:
    """Insertions of parameters as readable assignments."""
    return F.regexp_replace(prose, r"\{\{\s*insert:\s*param,\s*([^}]+?)\s*\}\}", "[assignment: $1]")


def canonical_id(raw: Column) -> Column:
    """The canonical form of a control's id; the part after its last dot is an enhancement. Ids of no known form are upper-cased."""
    return F.coalesce(control_id(raw), F.upper(raw))


def _levels(rows: DataFrame, column: str, path: str, keys: list[str], most: int) -> list[DataFrame]:
    """The nodes of trees level by level, each with the places of its ancestors and itself. Ends at the first level without nodes."""
    found = []
    level = rows
    while len(found) < most and not level.isEmpty():
        found.append(level)
        below = F.posexplode(_list(F.col(column), path)).alias("__i", "__node")
        level = level.select(*keys, F.col("place").alias("__up"), below).select(*keys, F.concat("__up", F.array(F.col("__i"))).alias("place"), F.col("__node").alias(column))
    return found


def _union(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def controls(documents: DataFrame, key: str, text: str, deepest: int = 32) -> DataFrame:
    """(key, oscal_id, control_id, title, statement, place) of all controls in the trees of documents(key, text).

    text is a JSON object with controls, which may hold controls in turn. Withdrawn controls are left out, those below them are not, and nodes without
    an id hide what is below them. statement is the prose of the part of that name, one line for each part below it, indented by depth, behind its
    label. place is the path of positions from the root. Text that is no JSON has no controls. Trees are read level by level, so a tree's
    depth costs jobs and its size does not.
    """
    parsed = documents.select(key, F.try_parse_json(text).alias("node")).filter("node IS NOT NULL")
    roots = parsed.select(key, F.posexplode(_list(F.col("node"), "$.controls")).alias("i", "node")).select(key, F.array("i").alias("place"), "node")
    named = lambda rows: rows.filter(_text(F.col("node"), "$.id") != "")
    levels, level = [], named(roots)
    while len(levels) < deepest and not level.isEmpty():
        levels.append(level)
        below = level.select(key, F.col("place").alias("up"), F.posexplode(_list(F.col("node"), "$.controls")).alias("i", "node"))
        level = named(below.select(key, F.concat("up", F.array("i")).alias("place"), "node"))
    if not levels:
        return documents.select(key, *[F.lit("").alias(c) for c in ("oscal_id", "control_id", "title", "statement")], F.array(F.lit(0)).alias("place")).limit(0)
    nodes = _union(levels).filter(~(F.coalesce(_named(F.col("node"), "status"), F.lit("")) == "withdrawn"))
    raw = _text(F.col("node"), "$.id")
    own = nodes.select(key, F.col("place").alias("control"), raw.alias("oscal_id"), canonical_id(raw).alias("control_id"), _text(F.col("node"), "$.title").alias("title"), "node")

    first = F.get(F.filter(_list(F.col("node"), "$.parts"), lambda p: F.try_variant_get(p, "$.name", "string") == "statement"), F.lit(0))
    parts = own.select(key, "control", F.array(F.lit(0)).alias("place"), first.alias("node")).filter("node IS NOT NULL")
    lines = _levels(parts, "node", "$.parts", [key, "control"], deepest)
    out = own.select(key, "oscal_id", "control_id", "title", "control")
    if not lines:
        return out.select(key, "oscal_id", "control_id", "title", F.lit("").alias("statement"), F.col("control").alias("place"))
    label, prose = F.trim(F.coalesce(_named(F.col("node"), "label"), F.lit(""))), with_parameters(_text(F.col("node"), "$.prose"))
    line = F.concat(F.repeat(F.lit("  "), F.size("place") - 1), F.when(label != "", F.concat(label, F.lit(" "))).otherwise(""), prose)
    told = _union(lines).filter(prose != "").select(key, "control", "place", line.alias("line"))
    whole = told.groupBy(key, "control").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    text_of = F.trim(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    joined = out.join(whole, [key, "control"], "left")
    return joined.select(key, "oscal_id", "control_id", "title", F.coalesce(text_of, F.lit("")).alias("statement"), F.col("control").alias("place"))
