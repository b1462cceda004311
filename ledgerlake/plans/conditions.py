"""Queries of predicates and the condition algebra over orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import conditions as c
from ledgerlake.plans.facts import devices, facts, line_facts, order_facts
from ledgerlake.registry import query
from ledgerlake.session import table

DISCOUNT = c.FactCheck("line.discount", "lte", 0.08)
RETURNED = c.FactCheck("line.returnflag", "eq", "R", quantifier="any")
ENOUGH = c.Count("line.quantity", "gte", 3)
OPEN = c.FactCheck("order.status", "in", "O,F")
LARGE = c.FactCheck("order.total", "gt", 150_000)

#: One row of leaf counts for each order, as the oracles need them.
_COUNTS = """
WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_discount <= 0.08) AS disc_ok,
                  count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_returnflag = 'N') AS n_ok
           FROM lineitem GROUP BY 1),
o AS (SELECT o.o_orderkey AS device, o.o_custkey AS customer, o.o_orderstatus, o.o_orderpriority, o.o_totalprice, l.n,
        CASE WHEN l.n IS NULL THEN 'unknown' WHEN l.disc_ok = l.n THEN 'pass' ELSE 'fail' END AS discount,
        CASE WHEN l.n IS NULL THEN 'unknown' WHEN l.returned > 0 THEN 'pass' ELSE 'fail' END AS returned,
        CASE WHEN coalesce(l.n, 0) >= 3 THEN 'pass' ELSE 'fail' END AS enough,
        CASE WHEN o.o_orderstatus IN ('O', 'F') THEN 'pass' ELSE 'fail' END AS open,
        CASE WHEN o.o_totalprice > 150000 THEN 'pass' ELSE 'fail' END AS large
      FROM orders o LEFT JOIN l ON o.o_orderkey = l.l_orderkey)
"""


def _all(*names: str) -> str:
    has = lambda r: " OR ".join(f"{n} = '{r}'" for n in names)
    return f"CASE WHEN {has('error')} THEN 'error' WHEN {has('fail')} THEN 'fail' WHEN {has('unknown')} THEN 'unknown' ELSE 'pass' END"


def _any(*names: str) -> str:
    has = lambda r: " OR ".join(f"{n} = '{r}'" for n in names)
    return f"CASE WHEN {has('error')} THEN 'error' WHEN {has('pass')} THEN 'pass' WHEN {has('unknown')} THEN 'unknown' ELSE 'fail' END"


def _none(*names: str) -> str:
    has = lambda r: " OR ".join(f"{n} = '{r}'" for n in names)
    return f"CASE WHEN {has('error')} THEN 'error' WHEN {has('pass')} THEN 'fail' WHEN {has('unknown')} THEN 'unknown' ELSE 'pass' END"


def outcome(spark: SparkSession, sf: str, tree) -> DataFrame:
    return c.evaluate(devices(spark, sf), facts(spark, sf), tree, ["device"])


@query("SELECT o_orderkey, o_orderstatus = 'F' AS eq, o_orderstatus <> 'F' AS ne, lower(o_orderstatus) = 'f' AS eq_folded, o_totalprice = 2 AS number_eq FROM orders")
def op_eq_ne(spark: SparkSession, sf: str) -> DataFrame:
    status, total = c.value(s=F.col("o_orderstatus")), c.value(n=F.col("o_totalprice"))
    return table(spark, sf, "orders").select(
        "o_orderkey", c.compare("eq", status, "F").alias("eq"), c.compare("ne", status, "F").alias("ne"),
        c.compare("eq", status, "F", fold_case=True).alias("eq_folded"), c.compare("eq", total, 2).alias("number_eq"),
    )


@query("""SELECT op, result, count(*) AS n FROM (
  SELECT unnest(['gt', 'gte', 'lt', 'lte', 'text']) AS op, unnest([(l_discount > 0.05)::VARCHAR, (l_discount >= 0.05)::VARCHAR,
    (l_discount < 0.05)::VARCHAR, (l_discount <= 0.05)::VARCHAR, 'error']) AS result FROM lineitem) GROUP BY 1, 2""")
def op_ordered(spark: SparkSession, sf: str) -> DataFrame:
    discount, text = c.value(n=F.col("l_discount")), c.value(s=F.col("l_returnflag"))
    shown = lambda v, op: F.struct(F.lit("text" if v is text else op).alias("op"), F.coalesce(c.compare(op, v, 0.05).cast("string"), F.lit("error")).alias("result"))
    rows = table(spark, sf, "lineitem").select(F.explode(F.array(*[shown(discount, op) for op in ("gt", "gte", "lt", "lte")], shown(text, "lte"))).alias("r"))
    return rows.groupBy("r.op", "r.result").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_returnflag IN ('R', 'A') AS inside, l_returnflag NOT IN ('R', 'A') AS outside, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def op_in_not_in(spark: SparkSession, sf: str) -> DataFrame:
    flag = c.value(s=F.col("l_returnflag"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag", c.compare("in", flag, "R, A").alias("inside"), c.compare("not_in", flag, ["R", "A"]).alias("outside")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, contains(p_name, 'a') AS text_contains, list_contains(string_split(p_type, ' '), 'STEEL') AS list_contains FROM part""")
def op_contains(spark: SparkSession, sf: str) -> DataFrame:
    name, types = c.value(s=F.col("p_name")), c.value(l=F.split("p_type", " "))
    return table(spark, sf, "part").select("p_partkey", c.compare("contains", name, "a").alias("text_contains"), c.compare("contains", types, "STEEL").alias("list_contains"))


@query("SELECT p_partkey, regexp_matches(p_type, '^[A-M].*L$') AS found, NOT regexp_matches(p_type, '(?i)steel') AS absent FROM part")
def op_regex(spark: SparkSession, sf: str) -> DataFrame:
    kind = c.value(s=F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", c.compare("regex_match", kind, "^[A-M].*L$").alias("found"), c.compare("regex_not_match", kind, "steel", fold_case=True).alias("absent"))


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_filter(flags, lambda x: x NOT IN ('A', 'R'))) = 0 AS subset_of,
  list_contains(flags, 'A') AND list_contains(flags, 'R') AS superset_of,
  NOT list_has_any(flags, ['A', 'R']) AS disjoint_from FROM s""")
def op_set_algebra(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    v = c.value(l=F.col("flags"))
    return sets.select("l_orderkey", *[c.compare(op, v, ["A", "R"]).alias(op) for op in ("subset_of", "superset_of", "disjoint_from")])


@query(_COUNTS + "SELECT device, discount, returned FROM o")
def leaf_condition(spark: SparkSession, sf: str) -> DataFrame:
    left, right = c.compile_tree(DISCOUNT, "d"), c.compile_tree(RETURNED, "r")
    counted = facts(spark, sf).groupBy("device").agg(*left.aggregates, *right.aggregates)
    return devices(spark, sf).join(counted, "device", "left").select("device", left.outcome.alias("discount"), right.outcome.alias("returned"))


@query(_COUNTS + "SELECT device, CASE WHEN n IS NOT NULL THEN 'pass' ELSE 'fail' END AS outcome FROM o")
def presence_condition(spark: SparkSession, sf: str) -> DataFrame:
    return outcome(spark, sf, c.Presence("line.returnflag"))


@query(_COUNTS + "SELECT device, enough AS outcome FROM o")
def count_condition(spark: SparkSession, sf: str) -> DataFrame:
    return outcome(spark, sf, ENOUGH)


_EACH = """b AS (SELECT o_custkey, o_orderkey,
    CASE WHEN count(l_orderkey) = 0 THEN 'unknown' WHEN bool_and(l_discount <= 0.08) THEN 'pass' ELSE 'fail' END AS sub
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT regexp_matches(o_orderpriority, '^5') GROUP BY 1, 2),
e AS (SELECT c_custkey AS customer, CASE WHEN count(sub) = 0 THEN 'notapplicable' WHEN bool_or(sub = 'fail') THEN 'fail'
  WHEN bool_or(sub = 'unknown') THEN 'unknown' ELSE 'pass' END AS outcome
FROM customer LEFT JOIN b ON c_custkey = o_custkey GROUP BY 1)
"""


def customer_facts(spark: SparkSession, sf: str) -> DataFrame:
    """facts() with customers as devices, their orders as blocks and priorities as labels."""
    orders = table(spark, sf, "orders").withColumns({"customer": F.col("o_custkey"), "label": F.col("o_orderpriority")})
    # lines find their order before they become facts, of which there are several for each
    lines = table(spark, sf, "lineitem").join(orders.select("o_orderkey", "customer", "label"), F.col("l_orderkey") == F.col("o_orderkey"))
    return line_facts(lines, "customer", "label").unionByName(order_facts(orders, "customer", "label"))


@query(f"WITH {_EACH} SELECT customer, outcome FROM e")
def for_each_condition(spark: SparkSession, sf: str) -> DataFrame:
    scope = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"))
    return c.evaluate(scope, customer_facts(spark, sf), c.ForEach(DISCOUNT, skip="^5"), ["customer"], block="device", label="label")


_CHECK = '{"type": "fact_check", "path": "line.discount", "op": "lte", "expected": 0.08}'
#: A rule table as a pack would bring it; the last two are broken.
PACK = [
    ("each-and-enough", f'{{"type": "all_of", "children": [{{"type": "for_each", "sub": {_CHECK}, "skip": "^5"}}, {{"type": "count", "path": "line.quantity", "op": "gte", "threshold": 3}}]}}'),
    ("each-or-none", f'{{"type": "any_of", "children": [{{"type": "for_each", "sub": {_CHECK}, "skip": "^5"}}, {{"type": "presence", "path": "line.returnflag", "must_be_present": false}}]}}'),
    ("broken-pattern", '{"type": "fact_check", "path": "order.priority", "op": "regex_match", "expected": "("}'),
    ("broken-node", '{"type": "every_of", "children": []}'),
]


@query(f"""WITH {_EACH}, n AS (SELECT c_custkey AS customer, count(l_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
r AS (SELECT customer, outcome, CASE WHEN n >= 3 THEN 'pass' ELSE 'fail' END AS enough, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS bare FROM e JOIN n USING (customer))
SELECT customer, 'each-and-enough' AS rule_id, {_all("outcome", "enough")} AS outcome FROM r UNION ALL SELECT customer, 'each-or-none', {_any("outcome", "bare")} FROM r
UNION ALL SELECT customer, 'broken-pattern', 'error' FROM r UNION ALL SELECT customer, 'broken-node', 'error' FROM r""")
def audit_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = c.rules_of(spark.createDataFrame(PACK, "rule_id string, condition string"))
    scope = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer"))
    return c.audit(scope, customer_facts(spark, sf), rules, ["customer"], block="device", label="label")


@query("""SELECT l_orderkey AS device, 'discount' AS rule_id, 'line.discount' AS path, l_linenumber AS line_no FROM lineitem WHERE (l_discount <= 0.08) IS NOT TRUE
UNION ALL SELECT l_orderkey, 'returned', 'line.returnflag', min(l_linenumber) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def leaf_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return c.evidence(facts(spark, sf), {"discount": DISCOUNT, "returned": RETURNED}, ["device"])


@query(_COUNTS + f"SELECT device, {_all('discount', 'enough', 'open')} AS outcome FROM o")
def all_of(spark: SparkSession, sf: str) -> DataFrame:
    return outcome(spark, sf, c.AllOf((DISCOUNT, ENOUGH, OPEN)))


@query(_COUNTS + f"SELECT device, {_any('returned', 'large')} AS outcome FROM o")
def any_of(spark: SparkSession, sf: str) -> DataFrame:
    return outcome(spark, sf, c.AnyOf((RETURNED, LARGE)))


@query(_COUNTS + f"SELECT device, {_none('returned', 'large')} AS outcome FROM o")
def none_of(spark: SparkSession, sf: str) -> DataFrame:
    return outcome(spark, sf, c.NoneOf((RETURNED, LARGE)))


@query("""SELECT o_orderkey AS device, CASE WHEN coalesce(bool_or(l_discount > 0.05), false) THEN 'pass' ELSE 'notapplicable' END AS outcome
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def requires_paths(spark: SparkSession, sf: str) -> DataFrame:
    seen = facts(spark, sf).withColumn("present", (F.col("path") != "line.discount") | (F.col("value.n") > 0.05))
    met = c.required(devices(spark, sf), seen, ["line.discount"], ["device"])
    return met.select("device", F.when(F.col("applicable"), "pass").otherwise("notapplicable").alias("outcome"))


_RULES = "(VALUES ('r1', ['BUILDING', 'MACHINERY'], []), ('r2', [], ['ASIA', 'EUROPE']), ('r3', [], [])) r(rule_id, vendors, families)"


@query(f"""SELECT c_custkey, rule_id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
CROSS JOIN {_RULES} WHERE (len(vendors) = 0 OR list_contains(vendors, c_mktsegment)) AND (len(families) = 0 OR list_contains(families, r_name))""")
def rule_applicability(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("r1", ["BUILDING", "MACHINERY"], []), ("r2", [], ["ASIA", "EUROPE"]), ("r3", [], [])], "rule_id string, vendors array<string>, families array<string>")
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fits = ((F.size("vendors") == 0) | F.expr("array_contains(vendors, c_mktsegment)")) & ((F.size("families") == 0) | F.expr("array_contains(families, r_name)"))
    return customers.join(F.broadcast(rules), fits).select("c_custkey", "rule_id")


@query("""SELECT result, count(*) AS n FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'fail' WHEN '2-HIGH' THEN 'error' WHEN '3-MEDIUM' THEN 'unknown'
  ELSE CASE o_orderstatus WHEN 'O' THEN 'notchecked' WHEN 'F' THEN 'pass' ELSE 'informational' END END AS result FROM orders) GROUP BY 1""")
def result_domain(spark: SparkSession, sf: str) -> DataFrame:
    by_priority = F.when(F.col("o_orderpriority") == "1-URGENT", "fail").when(F.col("o_orderpriority") == "2-HIGH", "error").when(F.col("o_orderpriority") == "3-MEDIUM", "unknown")
    by_status = F.when(F.col("o_orderstatus") == "O", "notchecked").when(F.col("o_orderstatus") == "F", "pass").otherwise("informational")
    rows = table(spark, sf, "orders").select(F.coalesce(by_priority, by_status).alias("result"))
    checked = rows.withColumn("ok", F.assert_true(F.col("result").isin(*c.RESULTS), F.lit("a result outside the domain")))
    return checked.filter("ok IS NULL").groupBy("result").agg(F.count("*").alias("n"))


@query(_COUNTS + f", t AS (SELECT device, discount, {_any('returned', 'large')} AS inner_any, {_none('enough')} AS inner_none FROM o) SELECT device, {_all('discount', 'inner_any', 'inner_none')} AS outcome FROM t")
def condition_tree_eval(spark: SparkSession, sf: str) -> DataFrame:
    return outcome(spark, sf, c.AllOf((DISCOUNT, c.AnyOf((RETURNED, LARGE)), c.NoneOf((ENOUGH,)))))


_OUTCOMES = _COUNTS + f", r AS (SELECT device, customer, discount, enough, {_all('discount', 'enough', 'open')} AS combined FROM o)"


def control_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """(device, customer, outcome) of three rules that target one control, all from one aggregation."""
    trees = [c.compile_tree(t, f"t{i}") for i, t in enumerate((DISCOUNT, ENOUGH, c.AllOf((DISCOUNT, ENOUGH, OPEN))))]
    counted = facts(spark, sf).groupBy("device").agg(*[a for t in trees for a in t.aggregates])
    joined = devices(spark, sf).join(counted, "device", "left")
    return joined.select("device", "customer", F.explode(F.array(*[t.outcome for t in trees])).alias("outcome"))


@query(_OUTCOMES + """SELECT device, CASE WHEN 'fail' IN (discount, enough, combined) THEN 'fail' WHEN 'unknown' IN (discount, enough, combined) THEN 'unknown' ELSE 'pass' END AS outcome FROM r""")
def control_fold(spark: SparkSession, sf: str) -> DataFrame:
    return c.fold(control_outcomes(spark, sf), ["device"], c.CONTROL_RANK)


_SCORED = _OUTCOMES + """, f AS (SELECT device, n_name, CASE WHEN 'fail' IN (discount, enough, combined) THEN 'fail' WHEN 'unknown' IN (discount, enough, combined) THEN 'unknown' ELSE 'pass' END AS outcome
FROM r JOIN customer ON c_custkey = customer JOIN nation ON n_nationkey = c_nationkey)
"""


@query(_SCORED + """SELECT n_name, count(*) AS devices, count(*) FILTER (WHERE outcome = 'pass') AS passed, count(*) FILTER (WHERE outcome = 'fail') AS failed,
coalesce(round_even(100.0::DOUBLE * count(*) FILTER (WHERE outcome = 'pass') / nullif(count(*) FILTER (WHERE outcome IN ('pass', 'fail')), 0), 1), 0) AS score FROM f GROUP BY 1""")
def compliance_score(spark: SparkSession, sf: str) -> DataFrame:
    folded = c.fold(control_outcomes(spark, sf), ["device", "customer"], c.CONTROL_RANK)
    nations = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer"), "n_name")
    passed, failed = F.count_if(F.col("outcome") == "pass"), F.count_if(F.col("outcome") == "fail")
    return folded.join(nations, "customer").groupBy("n_name").agg(F.count("*").alias("devices"), passed.alias("passed"), failed.alias("failed"), c.score(passed, failed).alias("score"))


@query(_OUTCOMES + """, p AS (SELECT n_regionkey AS control, unnest([discount, combined]) AS outcome FROM r JOIN customer ON c_custkey = customer JOIN nation ON n_nationkey = c_nationkey)
SELECT r_name AS control, coalesce(CASE WHEN bool_or(outcome = 'fail') THEN 'fail' WHEN bool_or(outcome = 'pass') THEN 'pass' WHEN bool_or(outcome = 'unknown') THEN 'unknown' END, 'notchecked') AS outcome,
  count(outcome) FILTER (WHERE outcome = 'fail') AS failing, count(outcome) AS contributors
FROM region LEFT JOIN p ON r_regionkey = control GROUP BY 1""".replace("ON r_regionkey = control GROUP", "ON r_regionkey = p.control GROUP"))
def governance_projection(spark: SparkSession, sf: str) -> DataFrame:
    trees = [c.compile_tree(t, f"t{i}") for i, t in enumerate((DISCOUNT, c.AllOf((DISCOUNT, ENOUGH, OPEN))))]
    counted = facts(spark, sf).groupBy("device").agg(*[a for t in trees for a in t.aggregates])
    direct = devices(spark, sf).join(counted, "device", "left").select("customer", F.explode(F.array(*[t.outcome for t in trees])).alias("outcome"))
    homes = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer"), F.col("n_regionkey").alias("r_regionkey"))
    top = direct.join(homes, "customer").groupBy("r_regionkey").agg(
        F.max(c.ranked(F.col("outcome"), c.PROJECTION_RANK)).alias("rank"), F.count_if(F.col("outcome") == "fail").alias("failing"), F.count("outcome").alias("contributors")
    )
    joined = table(spark, sf, "region").join(top, "r_regionkey", "left")
    return joined.select(
        F.col("r_name").alias("control"), F.coalesce(c.unranked(F.col("rank"), c.PROJECTION_RANK), F.lit("notchecked")).alias("outcome"),
        F.coalesce("failing", F.lit(0)).alias("failing"), F.coalesce("contributors", F.lit(0)).alias("contributors"),
    )
