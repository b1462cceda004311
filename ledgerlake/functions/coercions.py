"""Values of facts from matches of patterns with named groups: twelve coercions as column expressions.

A value is a struct (state, value): state is "value", "skip" where the coercion's group took no part in the match, or "error"
where the captured text does not fit; value is JSON text, null but for the first state. A line that does not match, or a null
line, gives null. A group that matched an empty text counts as one that took no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.scalars import inferred

COERCIONS = ("true", "false", "const", "line", "negated_bool", "minutes_seconds", "group_present", "str", "lower", "int", "word_list", "auto")
_WHOLE = r"^[+-]?[0-9]{1,38}$"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s]+|[\s]+$", "")


def json_text(c: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def _number(c: Column) -> Column:
    """The number as JSON text, without a plus sign or zeros in front; null where there is none of up to 38 digits."""
    return F.when(c.rlike(_WHOLE), c.try_cast("decimal(38,0)").cast("string"))


def coerced(kind: str, line: Column, pattern: str, group: str = "value", literal: Column | None = None) -> Column:
    """The value of one emission for a line; kind is one of COERCIONS, literal the JSON text of a const.

    An unknown kind, or a group that the pattern does not name where the kind needs it, is a ValueError when the plan is made.
    """
    if kind not in COERCIONS:
        raise ValueError(f"{kind!r} is none of {', '.join(COERCIONS)}")
    at = re.compile(pattern).groupindex
    if kind in ("str", "lower", "int", "word_list", "auto", "group_present") and group not in at:
        raise ValueError(f"{pattern!r} has no group {group!r}")
    java = pattern.replace("(?P<", "(?<")

    def captured(name: str) -> Column:
        return F.nullif(F.regexp_extract(line, java, at[name]), F.lit("")) if name in at else F.lit(None).cast("string")

    def state(name: str, value: Column | None = None) -> Column:
        return F.struct(F.lit(name).alias("state"), (F.lit(None) if value is None else value).cast("string").alias("value"))

    def whole(text: Column) -> Column:
        number = _number(_trimmed(text))
        return F.when(text.isNull(), state("skip")).when(number.isNull(), state("error")).otherwise(state("value", number))

    raw = captured(group)
    text = _trimmed(raw)
    given = lambda value: F.when(raw.isNull(), state("skip")).otherwise(state("value", value))
    if kind in ("true", "false"):
        out = state("value", F.lit(kind))
    elif kind == "const":
        out = state("value", F.lit("null") if literal is None else literal)
    elif kind == "line":
        out = state("value", json_text(_trimmed(line)))
    elif kind == "negated_bool":
        out = state("value", captured("neg").isNull().cast("string"))
    elif kind == "minutes_seconds":
        parts = [captured("minutes"), captured("seconds")]
        minutes, seconds = (_number(_trimmed(F.coalesce(p, F.lit("0")))).try_cast("long") for p in parts)
        total = F.try_add(F.try_multiply(minutes, F.lit(60)), seconds)
        none = parts[0].isNull() & parts[1].isNull()
        out = F.when(none, state("skip")).when(total.isNull(), state("error")).otherwise(state("value", total))
    elif kind == "group_present":
        out = state("value", raw.isNotNull().cast("string"))
    elif kind == "str":
        out = given(json_text(text))
    elif kind == "lower":
        out = given(json_text(F.lower(text)))
    elif kind == "int":
        out = whole(raw)
    elif kind == "word_list":
        out = given(F.to_json(F.array_sort(F.array_remove(F.split(text, r"[,\s]+"), ""))))
    else:
        kinds = inferred(text)
        out = given(F.when(kinds == "bool", F.lower(text)).when(kinds == "int", F.coalesce(_number(text), json_text(text))).otherwise(json_text(text)))
    return F.when(line.rlike(java), out)
