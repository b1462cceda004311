import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.coercions import COERCIONS, coerced

PATTERN = r"^(?P<neg>no )?timeout(?: (?P<value>[^;]+))?(?:;(?P<minutes>\d+)(?: (?P<seconds>\S+))?)?$"


def test_each_coercion_on_odd_lines(spark):
    lines = ["timeout +007", "no timeout", "timeout b,a  b ;1 30", "timeout TRUE;2", "timeout -5;1 x", "timeout say \"hi\";" + "9" * 30, "other", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, line string")
    got = rows.select("id", *[coerced(k, F.col("line"), PATTERN, literal=F.lit("[1]")).alias(k) for k in COERCIONS]).orderBy("id").collect()
    of = lambda kind: [r[kind] and (r[kind].value if r[kind].state == "value" else r[kind].state) for r in got]
    assert of("true") == ["true"] * 6 + [None] * 2 and of("false")[:6] == ["false"] * 6 and of("const")[:7] == ["[1]"] * 6 + [None]
    assert of("line")[5] == '"timeout say \\"hi\\";' + "9" * 30 + '"'
    assert of("negated_bool")[:6] == ["true", "false", "true", "true", "true", "true"]
    assert of("minutes_seconds")[:6] == ["skip", "skip", "90", "120", "error", "error"]
    assert of("group_present")[:6] == ["true", "false", "true", "true", "true", "true"]
    assert of("str")[:4] == ['"+007"', "skip", '"b,a  b"', '"TRUE"'] and of("lower")[3] == '"true"'
    assert of("int")[:6] == ["7", "skip", "error", "error", "-5", "error"]
    assert of("word_list")[1:3] == ["skip", '["a","b","b"]']
    assert of("auto")[2:6] == ['"b,a  b"', "true", "-5", '"say \\"hi\\""']


def test_broken_emissions_are_errors_when_planned():
    for kind, group in (("upper", "value"), ("int", "absent")):
        with pytest.raises(ValueError):
            coerced(kind, F.lit("x"), PATTERN, group)
