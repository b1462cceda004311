"""Text to lines, and first-match extraction by ordered patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where str.splitlines would break a line.
BREAKS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def explode_lines(files: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line_no from 1, raw, stripped, indent): an empty last line is no line; a tab counts one column."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), BREAKS, -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = files.select(*keys, F.posexplode(whole).alias("at", "raw"))
    blank = F.lit(" \t")
    indent = F.char_length("raw") - F.char_length(F.ltrim("raw", blank))
    return rows.select(*keys, (F.col("at") + 1).alias("line_no"), "raw", F.btrim("raw", blank).alias("stripped"), indent.alias("indent"))


def significant(lines: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Without blank and comment lines and those that a pack ignores."""
    comment = F.col("stripped").startswith("!") | F.col("stripped").startswith("#") | F.col("stripped").startswith("^C")
    kept = lines.filter((F.col("stripped") != "") & ~comment)
    return kept.filter(~F.col("stripped").rlike("|".join(f"(?:{p})" for p in ignore))) if ignore else kept


def first_match(line: Column, patterns: list[tuple[str, str]]) -> Column:
    """The id of the first pattern that matches at the start of the line, null if none does."""
    return F.coalesce(*[F.when(line.rlike(f"^(?:{regex})"), F.lit(name)) for name, regex in patterns])


def detect(text: Column, packs: dict[str, dict]) -> Column:
    """(score, name) of the best pack for a text; packs have markers, and may have min_hits, anti and strong markers.

    0 with an anti-marker or below min_hits; ten more where all strong markers are there. Ties go to the larger name.
    """
    low = F.lower(text)

    def score(pack: dict) -> Column:
        has = [F.contains(low, F.lit(m)) for m in pack["markers"]]
        hits = reduce(lambda a, b: a + b, [h.cast("int") for h in has])
        strong = [F.contains(low, F.lit(m)) for m in pack.get("strong", [])]
        bonus = F.when(reduce(lambda a, b: a & b, strong), 10).otherwise(0) if strong else F.lit(0)
        anti = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in pack.get("anti", [])], F.lit(False))
        return F.when(anti | (hits < pack.get("min_hits", 1)), 0).otherwise(hits + bonus)

    return F.greatest(*[F.struct(score(p).alias("score"), F.lit(n).alias("name")) for n, p in packs.items()])


# The operands that a template hides, in the order in which they are looked for. Each is free of blanks or quoted,
# so that it can be matched again; names of which a number is a part, such as aes-cbc-256, stay.
MASKS = (
    r'"[^"]*"',
    r"'[^']*'",
    r"\$\d+\$\S+",
    r"\b[0-9A-Fa-f]{16,}\b",
    r"\b\d{1,3}(?:\.\d{1,3}){3}/\d{1,2}\b",
    r"\b\d{1,3}(?:\.\d{1,3}){3}\b",
    r"\b(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?:/\d{1,3})?",
    r"\b[A-Za-z][A-Za-z-]*\d\d*(?:[/.:]\d+)+\b",
    r"\b\d\d*(?:[.:][0-9A-Fa-f]+)+\b",
    r"\b\d+-\d+\b",
    r"(?<!\w-)\b\d+\b",
)
OPERAND = r"""("[^"]*"|'[^']*'|\S+)"""
#: A line without a match holds nothing that a mask could match, and no mark.
MASKABLE = r"""["'0-9:<]|[A-Fa-f]{16}"""


def template(line: Column) -> Column:
    """A line with its operands masked; masks without a blank between them become one."""
    bare = out = F.trim(F.when(line.rlike(r"[\t\r\n\x0b\x0c]|  "), F.regexp_replace(line, r"[ \t\r\n\x0b\x0c]+", " ")).otherwise(line))
    for pattern in MASKS:
        out = F.regexp_replace(out, pattern, "<*>")
    # most lines of prose have nothing to mask
    return F.when(line.rlike(MASKABLE), F.regexp_replace(out, r"(?:<\*>){2,}", "<*>")).otherwise(bare)


def template_id(template_: Column) -> Column:
    return F.concat(F.lit("taught:"), F.substring(F.sha2(template_, 256), 1, 12))


def template_regex(template_: Column) -> Column:
    """An anchored expression that matches every line of a template; each operand is a group."""
    escaped = F.regexp_replace(template_, r"([\\.\[\](){}^$|?+*])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit(r"<\*>"), F.lit(OPERAND)), F.lit(" "), F.lit(r"\s+")), F.lit("$"))
