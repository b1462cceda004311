"""Queries of rule sets as data, and of the evidence behind outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import conditions as c
from ledgerlake.operators import rulebook as rb
from ledgerlake.plans.conditions import _COUNTS, _EACH, DISCOUNT, ENOUGH, LARGE, RETURNED, customer_facts
from ledgerlake.plans.facts import devices, facts
from ledgerlake.registry import query
from ledgerlake.session import table

#: Rules of the set below: somewhat more than a full pack has.
RULES = 500

_CONDITION = """{"type": "all_of", "children": [{"type": "fact_check", "path": "line.discount", "op": "lte", "expected": "%.2f"},
 {"type": "any_of", "children": [{"type": "count", "path": "line.quantity", "op": "gte", "threshold": %d}, {"type": "fact_check", "path": "order.total", "op": "gt", "expected": %d}]},
 {"type": "none_of", "children": [{"type": "fact_check", "path": "line.returnflag", "op": "in", "expected": ["%s"], "quantifier": "any", "on_missing": "fail"}]}]}"""


def rule_set(spark: SparkSession) -> DataFrame:
    """(rule_id, condition) of RULES rules that differ in thresholds and flags."""
    i = F.col("id")
    flag = F.element_at(F.array(*[F.lit(x) for x in "ARN"]), (i % 3 + 1).cast("int"))
    return spark.range(RULES).select(F.format_string("r%03d", i).alias("rule_id"), F.format_string(_CONDITION, i % 11 / 100, i % 8, i * 1000, flag).alias("condition"))


@query(f"""WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_discount) AS most, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1),
r AS (SELECT i, 'r' || lpad(i::VARCHAR, 3, '0') AS rule_id, (i % 11) / 100 AS discount, i % 8 AS least, i * 1000 AS total, ['A', 'R', 'N'][i % 3 + 1] AS flag FROM range({RULES}) g(i)),
o AS (SELECT rule_id, CASE WHEN most > discount THEN 'fail' WHEN coalesce(n, 0) < least AND NOT o_totalprice > total THEN 'fail' WHEN list_contains(flags, flag) THEN 'fail'
  WHEN n IS NULL THEN 'unknown' ELSE 'pass' END AS outcome FROM orders LEFT JOIN l ON l_orderkey = o_orderkey CROSS JOIN r)
SELECT rule_id, outcome, count(*) AS devices FROM o GROUP BY 1, 2""")
def rulebook_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rules = c.rules_of(rule_set(spark))
    return rb.outcome_counts(devices(spark, sf), facts(spark, sf), rules, ["device"])


@query(f"""WITH {_EACH}, w AS (SELECT c_custkey AS customer, e.outcome, b.o_orderkey, b.sub FROM customer JOIN e ON e.customer = c_custkey JOIN b ON b.o_custkey = c_custkey WHERE e.outcome IN ('pass', 'fail'))
SELECT DISTINCT customer, 'each' AS rule_id, outcome, 'line.discount' AS path, CASE WHEN outcome = 'fail' THEN l_linenumber ELSE min(l_linenumber) OVER (PARTITION BY o_orderkey) END AS line_no
FROM w JOIN lineitem ON l_orderkey = o_orderkey WHERE outcome = 'pass' OR (sub = 'fail' AND l_discount > 0.08)""")
def for_each_evidence(spark: SparkSession, sf: str) -> DataFrame:
    scope = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"))
    rule = {"each": c.ForEach(DISCOUNT, skip="^5")}
    return rb.evidence(scope, customer_facts(spark, sf), rule, ["customer"], block="device", label="label")


#: The rules of two controls.
CONTROLS = {"K1": {"discount": DISCOUNT, "enough": ENOUGH}, "K2": {"returned": RETURNED, "large": c.NoneOf((LARGE,))}}

_CONTROL = (
    _COUNTS
    + """, r AS (SELECT device, discount, enough, returned, CASE large WHEN 'pass' THEN 'fail' ELSE 'pass' END AS large FROM o),
k AS (SELECT *, CASE WHEN 'fail' IN (discount, enough) THEN 'fail' WHEN 'unknown' IN (discount, enough) THEN 'unknown' ELSE 'pass' END AS k1,
  CASE WHEN 'fail' IN (returned, large) THEN 'fail' WHEN 'unknown' IN (returned, large) THEN 'unknown' ELSE 'pass' END AS k2 FROM r)
"""
)


def controls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rules = {name: tree for own in CONTROLS.values() for name, tree in own.items()}
    scope, rows = devices(spark, sf).select("device"), facts(spark, sf)
    mapped = spark.createDataFrame([(r, k) for k, own in CONTROLS.items() for r in own], "rule_id string, control string")
    return rb.control_fold(rb.decide(scope, rows, rules, ["device"]), rb.evidence(scope, rows, rules, ["device"]), mapped, ["device"])


@query(_CONTROL + """, e AS (
SELECT device, 'K1' AS control, k1 AS outcome, 'line.discount' AS path, l_linenumber AS line_no FROM k JOIN lineitem ON l_orderkey = device WHERE discount = k1 AND (k1 = 'pass' OR (l_discount <= 0.08) IS NOT TRUE)
UNION SELECT device, 'K1', k1, 'line.quantity', l_linenumber FROM k JOIN lineitem ON l_orderkey = device WHERE enough = k1
UNION SELECT device, 'K2', k2, 'line.returnflag', l_linenumber FROM k JOIN lineitem ON l_orderkey = device WHERE returned = 'fail' AND k2 = 'fail'
UNION SELECT device, 'K2', k2, 'line.returnflag', min(l_linenumber) FROM k JOIN lineitem ON l_orderkey = device WHERE returned = 'pass' AND k2 = 'pass' AND l_returnflag = 'R' GROUP BY ALL
UNION SELECT device, 'K2', k2, 'order.total', NULL FROM k WHERE large = 'fail' AND k2 = 'fail'),
w AS (SELECT device, 'K1' AS control, k1 AS outcome FROM k UNION ALL SELECT device, 'K2', k2 FROM k)
SELECT device, control, w.outcome, path, line_no FROM w LEFT JOIN e USING (device, control)""")
def control_fold_evidence(spark: SparkSession, sf: str) -> DataFrame:
    folded, shown = controls(spark, sf)
    return folded.join(shown, ["device", "control"], "left")
