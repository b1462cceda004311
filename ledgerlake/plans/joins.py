"""Queries of joins: scope, crosswalks, prefixes, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators.networks import memberships, star_edges
from ledgerlake.registry import query
from ledgerlake.session import table


def sorted_set(c: Column | str) -> Column:
    """The distinct values of a group, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.transform(F.collect_set(c), lambda x: x.cast("string"))), ",")


def sql_set(expression: str) -> str:
    return f"array_to_string(list_sort(list(DISTINCT ({expression})::VARCHAR)), ',')"


def homes(spark: SparkSession, sf: str) -> DataFrame:
    """customer with nation and region."""
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


HOMES = "customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"

_CATALOGS = [("cis", "c1", ["BUILDING"], []), ("cis", "c2", [], ["ASIA"]), ("stig", "s1", ["MACHINERY", "AUTOMOBILE"], []), ("nist", "n1", [], [])]
_CATALOG_SQL = "(VALUES ('cis', 'c1', ['BUILDING'], []), ('cis', 'c2', [], ['ASIA']), ('stig', 's1', ['MACHINERY', 'AUTOMOBILE'], []), ('nist', 'n1', [], [])) k(framework, catalog_id, vendors, families)"


@query(f"SELECT c_custkey, framework, catalog_id FROM {HOMES} CROSS JOIN {_CATALOG_SQL} WHERE (len(vendors) = 0 OR list_contains(vendors, c_mktsegment)) AND (len(families) = 0 OR list_contains(families, r_name))")
def catalog_applicability_join(spark: SparkSession, sf: str) -> DataFrame:
    catalogs = spark.createDataFrame(_CATALOGS, "framework string, catalog_id string, vendors array<string>, families array<string>")
    fits = F.expr("(size(vendors) = 0 OR array_contains(vendors, c_mktsegment)) AND (size(families) = 0 OR array_contains(families, r_name))")
    return homes(spark, sf).join(F.broadcast(catalogs), fits).select("c_custkey", "framework", "catalog_id")


@query("""SELECT o_orderkey AS device, control, CASE WHEN control = 'lines' THEN CASE WHEN n IS NULL THEN 'unknown' WHEN n >= 3 THEN 'pass' ELSE 'fail' END
  WHEN control = 'urgent' AND o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'fail' END ELSE 'notchecked' END AS result,
  CASE WHEN control = 'urgent' AND o_orderpriority <> '1-URGENT' THEN 'a rule exists but is out of scope' WHEN control = 'manual' THEN 'no rule' END AS reason
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey CROSS JOIN (VALUES ('lines'), ('urgent'), ('manual')) c(control)""")
def scope_to_findings(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    scope = table(spark, sf, "orders").join(counted, "o_orderkey", "left").withColumn("control", F.explode(F.array(*[F.lit(x) for x in ("lines", "urgent", "manual")])))
    lines = F.when(F.col("n").isNull(), "unknown").when(F.col("n") >= 3, "pass").otherwise("fail")
    urgent = (F.col("control") == "urgent") & (F.col("o_orderpriority") == "1-URGENT")
    result = F.when(F.col("control") == "lines", lines).when(urgent, F.when(F.col("o_orderstatus") == "F", "pass").otherwise("fail")).otherwise("notchecked")
    reason = F.when(F.col("control") == "manual", "no rule").when((F.col("control") == "urgent") & ~urgent, "a rule exists but is out of scope")
    return scope.select(F.col("o_orderkey").alias("device"), "control", result.alias("result"), reason.alias("reason"))


@query("""SELECT 'part' AS target, count(*) AS dangling FROM lineitem ANTI JOIN part ON p_partkey = l_partkey
UNION ALL SELECT 'customer', count(*) FROM orders ANTI JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'lines', count(*) FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey""")
def rule_target_validation(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    missing = lambda name, left, right, on: left.join(right, on, "left_anti").agg(F.lit(name).alias("target"), F.count("*").alias("dangling"))
    return (
        missing("part", t("lineitem"), t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .union(missing("customer", t("orders"), t("customer"), F.col("o_custkey") == F.col("c_custkey")))
        .union(missing("lines", t("orders"), t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")))
    )


@query(f"SELECT p_name, count(*) AS n, {sql_set('p_brand')} AS brands FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_rule_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n"), sorted_set("p_brand").alias("brands")).filter("n > 1")


@query("SELECT event_type AS path, count(*) AS uses FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1")
def rule_vocabulary_check(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = spark.createDataFrame([(x,) for x in ("click", "view", "purchase")], "event_type string")
    used = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("uses"))
    return used.join(F.broadcast(vocabulary), "event_type", "left_anti").select(F.col("event_type").alias("path"), "uses")


@query(f"SELECT l_partkey AS control, {sql_set('l_suppkey')} AS first_hop, {sql_set('n_name')} AS second_hop FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def crosswalk_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    named = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    return pairs.join(named, "l_suppkey").groupBy(F.col("l_partkey").alias("control")).agg(sorted_set("l_suppkey").alias("first_hop"), sorted_set("n_name").alias("second_hop"))


_FAMILIES = ("brass", "steel", "small", "economy", "promo")


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_type), '{f}') THEN '{f}'" for f in _FAMILIES) + " ELSE 'neutral' END AS scope FROM part")
def scope_substring_join(spark: SparkSession, sf: str) -> DataFrame:
    patterns = spark.createDataFrame(list(enumerate(_FAMILIES)), "position int, match string")
    hit = table(spark, sf, "part").join(F.broadcast(patterns), F.expr("contains(lower(p_type), match)"), "left")
    return hit.groupBy("p_partkey").agg(F.coalesce(F.min_by("match", "position"), F.lit("neutral")).alias("scope"))


_PREFIXES = "list_transform(range(1, len(string_split(url, '/')) + 1), lambda i: array_to_string(string_split(url, '/')[1 : i], '/'))"


@query(f"WITH e AS (SELECT page_id, unnest({_PREFIXES}) AS prefix FROM pages), t AS (SELECT prefix, count(*) AS n FROM e GROUP BY 1 HAVING count(*) > 1) SELECT page_id, count(*) AS techniques, max(length(prefix)) AS longest FROM e JOIN t USING (prefix) GROUP BY 1")
def technique_prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    # a prefix join as an equi join: every path is exploded into its own prefixes
    parts = F.split("url", "/", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    exploded = table(spark, sf, "pages").select("page_id", F.explode(prefixes).alias("prefix"))
    known = exploded.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1")
    return exploded.join(known, "prefix").groupBy("page_id").agg(F.count("*").alias("techniques"), F.max(F.char_length("prefix")).alias("longest"))


@query(f"SELECT l_partkey AS technique, {sql_set('l_suppkey')} AS mitigations FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 0 AND p_size <= 40 GROUP BY 1")
def mitigation_join(spark: SparkSession, sf: str) -> DataFrame:
    relation = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    live = table(spark, sf, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    action = table(spark, sf, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return relation.join(live, "l_partkey").join(action, "l_suppkey").groupBy(F.col("l_partkey").alias("technique")).agg(sorted_set("l_suppkey").alias("mitigations"))


@query(f"SELECT p_brand AS technique, count(DISTINCT o_orderkey) AS failing, {sql_set('o_orderpriority')} AS controls FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' GROUP BY 1")
def threat_appendix(spark: SparkSession, sf: str) -> DataFrame:
    failing = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    paths = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return failing.join(paths, "l_orderkey").groupBy(F.col("p_brand").alias("technique")).agg(F.count_distinct("l_orderkey").alias("failing"), sorted_set("o_orderpriority").alias("controls"))


@query("""SELECT e.event_id, p.p_brand AS technique FROM events e LEFT JOIN part p ON p.p_partkey = try_cast(json_extract_string(e.props, '$.k') AS BIGINT)""")
def finding_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("p_partkey"))
    return keyed.join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey", "left").select("event_id", F.col("p_brand").alias("technique"))


@query("""WITH b AS (SELECT p_brand, p_type, p_size, min(p_partkey) AS fallback, count(*) AS installed FROM part GROUP BY 1, 2, 3)
SELECT x.p_partkey, coalesce(e.p_partkey, b.fallback) AS remediation, CASE WHEN e.p_partkey IS NULL THEN 'benchmark' ELSE 'exact' END AS via, b.installed
FROM part x LEFT JOIN part e ON e.p_partkey = x.p_partkey AND e.p_size % 2 = 0 LEFT JOIN b ON b.p_brand = x.p_brand AND b.p_type = x.p_type AND b.p_size = x.p_size""")
def remediation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    exact = part.filter("p_size % 2 = 0").select("p_partkey", F.col("p_partkey").alias("found"))
    keys = ["p_brand", "p_type", "p_size"]
    fallback = part.groupBy(*keys).agg(F.min("p_partkey").alias("fallback"), F.count("*").alias("installed"))
    joined = part.join(exact, "p_partkey", "left").join(fallback, keys, "left")
    return joined.select("p_partkey", F.coalesce("found", "fallback").alias("remediation"), F.when(F.col("found").isNull(), "benchmark").otherwise("exact").alias("via"), "installed")


_MAPPINGS = [("BUILDING", "1-URGENT", "m1", 1), ("*", "1-URGENT", "m2", 2), ("*", "2-HIGH", "m3", 3), ("MACHINERY", "2-HIGH", "m4", 4)]
_MAPPING_SQL = "(VALUES " + ", ".join(map(str, _MAPPINGS)) + ") m(vendor, template, mapping, updated)"


@query(f"SELECT o_orderkey, arg_min(mapping, updated) AS mapping FROM orders JOIN customer ON c_custkey = o_custkey JOIN {_MAPPING_SQL} ON template = o_orderpriority AND vendor IN ('*', c_mktsegment) GROUP BY 1")
def learned_mapping_match(spark: SparkSession, sf: str) -> DataFrame:
    mappings = spark.createDataFrame(_MAPPINGS, "vendor string, template string, mapping string, updated int")
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", F.col("o_orderpriority").alias("template"))
    own = rows.join(F.broadcast(mappings), (rows.template == mappings.template) & (rows.c_mktsegment == mappings.vendor)).select("o_orderkey", "mapping", "updated")
    anyone = rows.join(F.broadcast(mappings.filter("vendor = '*'")), "template").select("o_orderkey", "mapping", "updated")
    return own.union(anyone).groupBy("o_orderkey").agg(F.min_by("mapping", "updated").alias("mapping"))


@query("""WITH m AS (SELECT DISTINCT s_suppkey AS device, s_nationkey * 2 + s_suppkey % 2 AS network FROM supplier)
SELECT a.device AS a, b.device AS b, min(a.network) AS network FROM m a JOIN m b ON a.network = b.network AND a.device < b.device GROUP BY 1, 2""")
def subnet_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    member = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("device"), (F.col("s_nationkey") * 2 + F.col("s_suppkey") % 2).alias("network"))
    return adjacent_pairs(member)


#: Parts of a network's members on the left, so that a large network is many tasks.
NETWORK_PARTS = 16


def adjacent_pairs(member: DataFrame) -> DataFrame:
    """(a, b, network): every pair a < b of devices of member(device, network) that share a network, with their least one.

    A device carries its networks, so a pair tells by itself under which of them it is shown: pairs leave the join one by one and are never gathered.
    """
    nets = member.filter("device IS NOT NULL AND network IS NOT NULL").groupBy("device").agg(F.array_sort(F.collect_set("network")).alias("nets"))
    own = nets.select("device", F.when(F.size("nets") > 1, F.col("nets")).alias("others"), F.explode("nets").alias("network"))
    left = own.select(F.col("device").alias("a"), F.col("others").alias("a_nets"), "network", F.pmod(F.xxhash64("device"), F.lit(NETWORK_PARTS)).alias("part"))
    right = own.select(F.col("device").alias("b"), F.col("others").alias("b_nets"), "network", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NETWORK_PARTS - 1).cast("long"))).alias("part"))
    pairs = left.join(right.hint("merge"), ["network", "part"]).filter("a < b")
    # of two devices one of which has a single network, that one is all they share
    shown = F.col("a_nets").isNull() | F.col("b_nets").isNull() | (F.col("network") == F.array_min(F.array_intersect("a_nets", "b_nets")))
    return pairs.filter(shown).select("a", "b", "network")


@query("""WITH m AS (SELECT c_custkey AS device, CASE c_custkey % 3 WHEN 0 THEN '10.' || c_nationkey || '.0.0/16' WHEN 1 THEN '10.' || c_nationkey || '.' || (c_custkey % 7) || '.0/24'
  ELSE '10.' || c_nationkey || '.' || (c_custkey % 7) || '.' || (c_custkey % 200 // 64 * 64) || '/26' END AS network FROM customer WHERE c_custkey % 11 <> 0),
h AS (SELECT network, min(device) AS hub FROM m GROUP BY 1)
SELECT network, hub, device FROM m JOIN h USING (network) WHERE device > hub""")
def network_star_edges(spark: SparkSession, sf: str) -> DataFrame:
    k, part = F.col("c_custkey"), lambda c: c.cast("string")
    address = F.concat_ws(".", F.lit("10"), part(F.col("c_nationkey")), part(k % 7), part(k % 200))
    mask = F.when(k % 11 == 0, "255.255.255.255").when(k % 3 == 0, "255.255.0.0").when(k % 3 == 1, "255.255.255.0").otherwise("255.255.255.192")
    return star_edges(memberships(table(spark, sf, "customer").select(k.alias("id"), address.alias("address"), mask.alias("mask")), "id", "address", "mask"))


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS control, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS drift
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority""")
def control_binding_drift(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    pinned = orders.filter("o_orderkey % 7 <> 0").select("o_orderkey", F.col("o_orderpriority").alias("was"), F.lit(True).alias("old"))
    current = orders.filter("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("now"), F.lit(True).alias("new"))
    both = pinned.join(current, "o_orderkey", "full")
    drift = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(F.col("o_orderkey").alias("control"), drift.alias("drift")).filter("drift IS NOT NULL")


@query("""WITH p AS (SELECT o_orderpriority AS metric, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT o_orderpriority AS metric, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT coalesce(p.metric, m.metric) AS metric, p.n AS published, m.n AS measured FROM p FULL JOIN m ON p.metric = m.metric WHERE coalesce(p.metric, m.metric) <> '5-LOW' AND p.n IS DISTINCT FROM m.n""")
def metric_drift_check(spark: SparkSession, sf: str) -> DataFrame:
    # both sides come from one pass over the orders
    counted = table(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("published"), F.nullif(F.count_if(F.col("o_orderstatus") != "P"), F.lit(0)).alias("measured"))
    return counted.filter("NOT (published <=> measured)")
