"""Queries of windows, orders, top rows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.functions import scalars as s
from ledgerlake.plans.facts import LINES_SQL
from ledgerlake.plans.facts import lines as order_lines
from ledgerlake.plans.joins import sorted_set, sql_set
from ledgerlake.registry import query
from ledgerlake.session import table


@query("SELECT c_custkey, max(o_orderkey) AS latest, count(o_orderkey) AS audits, arg_max(o_orderstatus, o_orderkey) AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def latest_audit_per_device(spark: SparkSession, sf: str) -> DataFrame:
    newest = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("latest"), F.count("*").alias("audits"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return table(spark, sf, "customer").select("c_custkey").join(newest, "c_custkey", "left").withColumn("audits", F.coalesce("audits", F.lit(0)))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS seq, count(*) OVER (PARTITION BY o_custkey) AS n,
  100.0::DOUBLE * sum((o_orderstatus = 'F')::INT) OVER w / nullif(sum((o_orderstatus IN ('F', 'O'))::INT) OVER w, 0) AS score FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, seq, coalesce(round_even(score, 1), 0) AS score FROM s WHERE n >= 2""")
def score_trend(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    passed, decided = F.sum((F.col("o_orderstatus") == "F").cast("int")).over(upto), F.sum(F.col("o_orderstatus").isin("F", "O").cast("int")).over(upto)
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by).alias("seq"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"), F.coalesce(F.bround(100 * passed / F.nullif(decided, F.lit(0)), 1), F.lit(0.0)).alias("score"))
    return rows.filter("n >= 2").drop("n")


@query("SELECT p_brand, p_type, max(p_size) AS newest, count(*) - 1 AS superseded FROM part GROUP BY 1, 2")
def newest_release(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_size"), "p_partkey")
    ranked = table(spark, sf, "part").withColumn("r", F.row_number().over(by))
    return ranked.groupBy("p_brand", "p_type").agg(F.max(F.when(F.col("r") == 1, F.col("p_size"))).alias("newest"), F.count_if(F.col("r") > 1).alias("superseded"))


@query("SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier")
def natural_control_sort(spark: SparkSession, sf: str) -> DataFrame:
    # unpadded ids, so that text order would put V-10 before V-9
    key = s.natural_key(F.concat(F.lit("V-"), F.col("s_suppkey").cast("string")))
    return table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(key)).alias("place"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS place FROM orders")
def finding_order(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderstatus", s.natural_key(F.col("o_orderkey").cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(by).alias("place"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END,
CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END, o_orderdate, o_orderkey) AS place FROM orders""")
def report_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    severity = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(verdict, severity, "o_orderdate", "o_orderkey")).alias("place"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def dedup_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    # the first of a group is an aggregate: combined before the shuffle, no sort
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""WITH r AS (SELECT c_custkey, c_name, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS high, count(*) FILTER (WHERE o_orderstatus = 'F') AS fail
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_custkey, high, fail FROM r ORDER BY high DESC, fail DESC, c_name, c_custkey""")
def device_risk_ranking(spark: SparkSession, sf: str) -> DataFrame:
    failing = F.col("o_orderstatus") == "F"
    counted = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(failing & (F.col("o_orderpriority") == "1-URGENT")).alias("high"), F.count_if(failing).alias("fail"))
    named = counted.join(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")
    return named.orderBy(F.desc("high"), F.desc("fail"), "c_name", "c_custkey").select("c_custkey", "high", "fail")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment, c_custkey::VARCHAR)), 'auto')")
def device_search(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment", F.col("c_custkey").cast("string")))
    return table(spark, sf, "customer").filter(F.contains(text, F.lit("auto"))).select("c_custkey", "c_name")


@query(f"""WITH l AS {LINES_SQL}, k AS (SELECT l_orderkey, max(line_no) AS last, count(*) FILTER (WHERE l_returnflag <> 'N') AS known FROM l GROUP BY 1)
SELECT k.l_orderkey, n AS line_no, CASE WHEN l.l_returnflag <> 'N' THEN l.l_linestatus ELSE '' END AS text, round(known / last::DOUBLE, 4) AS coverage, last - known AS gaps
FROM (SELECT *, unnest(range(1, last + 1)) AS n FROM k) k LEFT JOIN l ON l.l_orderkey = k.l_orderkey AND l.line_no = n""")
def config_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    rows = order_lines(spark, sf)
    known = rows.filter("l_returnflag <> 'N'").select("l_orderkey", "line_no", F.col("l_linestatus").alias("piece"))
    last = rows.groupBy("l_orderkey").agg(F.max("line_no").alias("last"), F.count_if(F.col("l_returnflag") != "N").alias("known"))
    whole = last.select("*", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("line_no"))
    longest = known.groupBy("l_orderkey", "line_no").agg(F.max_by("piece", F.char_length("piece")).alias("text"))
    return whole.join(longest, ["l_orderkey", "line_no"], "left").select("l_orderkey", "line_no", F.coalesce("text", F.lit("")).alias("text"), F.round(F.col("known") / F.col("last"), 4).alias("coverage"), (F.col("last") - F.col("known")).alias("gaps"))


_UNION = "SELECT 'observed' AS kind, l_orderkey AS device FROM lineitem UNION ALL SELECT 'anchor', o_orderkey FROM orders UNION ALL SELECT 'child', l_orderkey FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT 'absence', o_orderkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey"


@query(f"SELECT kind, count(*) AS n, count(DISTINCT device) AS devices FROM ({_UNION}) GROUP BY 1")
def fact_union(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    shown = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("device"))
    absent = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    parts = [shown(lines, "observed", "l_orderkey"), shown(orders, "anchor", "o_orderkey"), shown(lines.filter("l_linestatus = 'O'"), "child", "l_orderkey"), shown(absent, "absence", "o_orderkey")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("device").alias("devices"))


@query("SELECT o_orderkey AS subject, 'direct' AS level, o_orderstatus AS result FROM orders UNION ALL SELECT o_custkey, 'projected', CASE WHEN bool_or(o_orderstatus = 'F') THEN 'F' ELSE 'O' END FROM orders GROUP BY 1")
def finding_union(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    direct = orders.select(F.col("o_orderkey").alias("subject"), F.lit("direct").alias("level"), F.col("o_orderstatus").alias("result"))
    rolled = orders.groupBy(F.col("o_custkey").alias("subject")).agg(F.when(F.bool_or(F.col("o_orderstatus") == "F"), "F").otherwise("O").alias("result"))
    return direct.unionByName(rolled.withColumn("level", F.lit("projected")))


@query("""SELECT 'dead' AS side, p_partkey::VARCHAR AS item FROM part ANTI JOIN lineitem ON l_partkey = p_partkey UNION ALL
SELECT DISTINCT 'unmapped', p_brand FROM part SEMI JOIN lineitem ON l_partkey = p_partkey WHERE p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13')""")
def dead_and_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    part, sold = table(spark, sf, "part"), table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    dead = part.join(sold, "p_partkey", "left_anti").select(F.lit("dead").alias("side"), F.col("p_partkey").cast("string").alias("item"))
    mapped = spark.createDataFrame([(f"Brand#{i}",) for i in (11, 12, 13)], "p_brand string")
    unmapped = part.join(sold, "p_partkey", "left_semi").select("p_brand").subtract(mapped).select(F.lit("unmapped").alias("side"), F.col("p_brand").alias("item"))
    return dead.unionByName(unmapped)


@query(f"SELECT l_orderkey, {sql_set('p_brand')} AS paths FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def path_set_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    return rows.groupBy("l_orderkey").agg(sorted_set("p_brand").alias("paths"))
