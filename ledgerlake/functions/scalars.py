"""Scalar functions of the audit model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = {"cat i": "high", "cat ii": "medium", "cat iii": "low", "critical": "high", "important": "medium", "informational": "low"}


def normalise_severity(c: Column, names: dict[str, str] = SEVERITIES) -> Column:
    low = F.lower(F.trim(c))
    known = F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in names.items()])
    return F.coalesce(known, F.when(low == "", "unknown").otherwise(low), F.lit("unknown"))


def control_id(c: Column) -> Column:
    """ac-17 (2) (a) and ac-17.2 to AC-17(02); null where there is no control."""
    text = F.upper(F.trim(c))
    family, number = F.regexp_extract(text, r"^([A-Z]{2})-(\d+)", 1), F.regexp_extract(text, r"^[A-Z]{2}-(\d+)", 1)
    more = F.regexp_extract(text, r"^[A-Z]{2}-\d+\s*(?:\(|\.)\s*(\d+)", 1)
    base = F.concat(family, F.lit("-"), _two_digits(number))
    return F.when(family != "", F.when(more != "", F.concat(base, F.lit("("), _two_digits(more), F.lit(")"))).otherwise(base))


def _two_digits(number: Column) -> Column:
    """A run of digits as a number of two digits or more."""
    bare = F.regexp_replace(number, r"^0+(?=\d)", "")
    return F.when(F.char_length(bare) < 2, F.lpad(bare, 2, "0")).otherwise(bare)


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def natural_key(c: Column) -> Column:
    """A sort key under which digit runs of any length compare as numbers and come before text; case does not count."""

    def part(x: Column) -> Column:
        digits = F.regexp_replace(x, r"^0+(?=\d)", "")
        number = F.concat(F.lit("0"), F.lpad(F.char_length(digits).cast("string"), 6, "0"), digits)
        return F.when(x.rlike(r"^\d"), number).otherwise(F.concat(F.lit("1"), x))

    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0)), part), "\x01")


def inferred(c: Column) -> Column:
    """The kind of a taught value: bool, int or str."""
    return F.when(F.lower(F.trim(c)).isin("true", "false"), "bool").when(F.trim(c).rlike("^-?[0-9]+$"), "int").otherwise("str")


def score_band(c: Column, edges: list[float]) -> Column:
    """The number of the half-open band that holds c; the top band is closed."""
    return sum([(c >= e).cast("int") for e in edges[1:-1]], F.lit(0))


def network_of(address: Column, mask: Column) -> Column:
    """The network and its bits for a dotted quad and mask; null for other input and for /0, /31 and /32."""

    def number(c: Column) -> Column:
        parts = F.split(c, r"\.")
        return sum([parts[i].cast("long") * (1 << 8 * (3 - i)) for i in range(4)], F.lit(0).cast("long"))

    quad = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
    both = address.rlike(quad) & mask.rlike(quad)
    a, m = F.when(both, number(address)), F.when(both, number(mask))
    bits = F.bit_count(m)
    net = a.bitwiseAND(m)
    shown = F.concat_ws(".", *[F.shiftright(net, 8 * (3 - i)).bitwiseAND(F.lit(255)) for i in range(4)])
    return F.when(both & ~bits.isin(0, 31, 32), F.concat_ws("/", shown, bits))


def export_token(*parts: Column) -> Column:
    """A deterministic id of its parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def zoned_timestamp(c: Column) -> Column:
    """Whether the text is an RFC 3339 time with a zone."""
    return c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
