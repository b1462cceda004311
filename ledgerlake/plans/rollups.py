"""Queries of roll-ups: summaries, scores, coverage and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.operators.conditions import score
from ledgerlake.plans.joins import HOMES, homes, sorted_set, sql_set
from ledgerlake.registry import query
from ledgerlake.session import table

_SCORE = "coalesce(round_even(100.0::DOUBLE * {p} / nullif({p} + {f}, 0), 1), 0)"


def is_(result: str):
    return F.col("o_orderstatus") == result


def orders_at_home(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").join(homes(spark, sf), F.col("o_custkey") == F.col("c_custkey"))


@query("""SELECT kind, name, count(*) AS n FROM (SELECT unnest(['result', 'severity', 'failing']) AS kind, unnest([o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END]) AS name FROM orders)
WHERE name IS NOT NULL GROUP BY 1, 2""")
def finding_summary(spark: SparkSession, sf: str) -> DataFrame:
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    kinds = F.array(entry("result", F.col("o_orderstatus")), entry("severity", F.col("o_orderpriority")), entry("failing", F.when(is_("F"), F.col("o_orderpriority"))))
    return table(spark, sf, "orders").select(F.explode(kinds).alias("e")).select("e.*").filter("name IS NOT NULL").groupBy("kind", "name").agg(F.count("*").alias("n"))


@query("""SELECT count(DISTINCT r_regionkey) AS catalogs, count(DISTINCT c_custkey) AS controls, count(DISTINCT o_custkey) AS automated,
round(count(DISTINCT o_custkey) / count(DISTINCT c_custkey)::DOUBLE, 4) AS coverage FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey""")
def evaluation_stats(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("used", F.lit(1))
    per = homes(spark, sf).join(used, "c_custkey", "left").groupBy("r_regionkey").agg(F.count("*").alias("n"), F.sum("used").alias("u"))
    return per.agg(F.count("*").alias("catalogs"), F.sum("n").alias("controls"), F.sum("u").alias("automated"), F.round(F.sum("u") / F.sum("n"), 4).alias("coverage"))


@query(f"""WITH u AS (SELECT DISTINCT o_custkey FROM orders) SELECT r_name AS framework, n_name AS catalog, count(*) AS controls, count(o_custkey) AS automated, round(100.0::DOUBLE * count(o_custkey) / count(*), 2) AS coverage
FROM {HOMES} LEFT JOIN u ON o_custkey = c_custkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())""")
def framework_inventory(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("used", F.lit(1))
    rows = homes(spark, sf).join(used, "c_custkey", "left").select(F.col("r_name").alias("framework"), F.col("n_name").alias("catalog"), "used")
    return rows.rollup("framework", "catalog").agg(F.count("*").alias("controls"), F.count("used").alias("automated"), F.round(100 * F.count("used") / F.count("*"), 2).alias("coverage"))


@query("SELECT p_brand, count(*) AS controls, count(s) AS with_rule, round(count(s) / count(*)::DOUBLE, 4) AS coverage FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS s FROM lineitem WHERE l_discount > 0.09) ON s = p_partkey GROUP BY 1")
def benchmark_coverage(spark: SparkSession, sf: str) -> DataFrame:
    sold = table(spark, sf, "lineitem").filter("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("s", F.lit(1))
    rows = table(spark, sf, "part").join(sold, "p_partkey", "left")
    return rows.groupBy("p_brand").agg(F.count("*").alias("controls"), F.count("s").alias("with_rule"), F.round(F.count("s") / F.count("*"), 4).alias("coverage"))


@query(f"SELECT r_name, count(DISTINCT c_custkey) AS emitted, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN c_custkey END) AS decided, count(DISTINCT CASE WHEN c_acctbal < 0 THEN c_custkey END) AS in_baseline FROM {HOMES} LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def governance_reach(spark: SparkSession, sf: str) -> DataFrame:
    decided = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(is_("F")).alias("decided"))
    rows = homes(spark, sf).join(decided, "c_custkey", "left")
    return rows.groupBy("r_name").agg(F.count("*").alias("emitted"), F.count_if("decided").alias("decided"), F.count_if(F.col("c_acctbal") < 0).alias("in_baseline"))


@query("""SELECT o_custkey AS device, o_orderpriority AS framework, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, count(*) FILTER (WHERE o_orderstatus = 'P') AS unknown,
round_even(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')), 0), 1) AS score FROM orders GROUP BY 1, 2""")
def fixture_verdict_report(spark: SparkSession, sf: str) -> DataFrame:
    p, f, u = (F.count_if(is_(x)) for x in "FOP")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("device"), F.col("o_orderpriority").alias("framework")).agg(
        p.alias("passed"), f.alias("failed"), u.alias("unknown"), F.bround(100 * p / F.nullif(p + f, F.lit(0)), 1).alias("score")
    )


@query(f"SELECT r_name AS framework, count(*) FILTER (WHERE o_orderstatus = 'F') AS pass, count(*) FILTER (WHERE o_orderstatus = 'O') AS fail FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def framework_pass_fail(spark: SparkSession, sf: str) -> DataFrame:
    decided = orders_at_home(spark, sf).filter(F.col("o_orderstatus").isin("F", "O")).withColumn("result", F.when(is_("F"), "pass").otherwise("fail"))
    return decided.groupBy(F.col("r_name").alias("framework")).pivot("result", ["pass", "fail"]).count().fillna(0, ["pass", "fail"])


@query("SELECT o_orderpriority AS severity, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def failure_severity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter(is_("F")).groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n"))


_TYPES = ("click", "error", "purchase", "refund", "signup", "view")


@query(f"SELECT d.kind, count(event_id) AS n FROM (SELECT unnest({list(_TYPES)}) AS kind) d LEFT JOIN events ON event_type = d.kind GROUP BY 1")
def result_distribution(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    domain = spark.createDataFrame([(t,) for t in _TYPES], "kind string")
    return domain.join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT c_mktsegment, o_orderpriority AS reason, count(*) AS n, CASE WHEN count(*) <= 60 THEN array_to_string(list_sort(list(o_orderkey)), ',') ELSE count(*) || ' controls' END AS roster
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' GROUP BY 1, 2""")
def coverage_roster(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").filter(is_("P")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", F.col("o_orderpriority").alias("reason"), "o_orderkey")
    keys = ["c_mktsegment", "reason"]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    short = rows.join(counted.filter("n <= 60"), keys).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("roster"))
    return counted.join(short, keys, "left").withColumn("roster", F.coalesce("roster", F.concat(F.col("n").cast("string"), F.lit(" controls"))))


@query("""SELECT l_partkey AS control, count(*) FILTER (WHERE l_returnflag = 'R') AS failing, count(*) FILTER (WHERE l_returnflag = 'A') AS passing, count(*) FILTER (WHERE l_returnflag = 'N') AS undecided,
bool_and(l_returnflag = 'R') AS universal FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0""")
def estate_control_rollup(spark: SparkSession, sf: str) -> DataFrame:
    flag = lambda x: F.count_if(F.col("l_returnflag") == x)
    rolled = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("control")).agg(flag("R").alias("failing"), flag("A").alias("passing"), flag("N").alias("undecided"), F.bool_and(F.col("l_returnflag") == "R").alias("universal"))
    return rolled.filter("failing > 0")


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT sum(n) FILTER (WHERE event_type = 'purchase')::BIGINT AS passed, sum(n) FILTER (WHERE event_type = 'error')::BIGINT AS failed,
round(100.0::DOUBLE * sum(n) FILTER (WHERE event_type = 'purchase') / nullif(sum(n) FILTER (WHERE event_type IN ('purchase', 'error')), 0), 2) AS pass_rate FROM s""")
def estate_posture(spark: SparkSession, sf: str) -> DataFrame:
    per_type = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    summaries = per_type.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("summary"))
    rows = summaries.select(F.explode("summary").alias("kind", "n"))
    p, f = F.sum(F.when(F.col("kind") == "purchase", F.col("n"))), F.sum(F.when(F.col("kind") == "error", F.col("n")))
    return rows.agg(p.alias("passed"), f.alias("failed"), F.round(100 * p / F.nullif(p + f, F.lit(0)), 2).alias("pass_rate"))


@query("""SELECT o_custkey AS device, count(*) FILTER (WHERE o_orderstatus = 'F') AS fail, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS high, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS decided,
CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') > 0 THEN 'red' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'amber' ELSE 'green' END AS status FROM orders GROUP BY 1""")
def node_status(spark: SparkSession, sf: str) -> DataFrame:
    fail, high = F.count_if(is_("F")), F.count_if(is_("F") & (F.col("o_orderpriority") == "1-URGENT"))
    status = F.when(high > 0, "red").when(fail > 0, "amber").otherwise("green")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("device")).agg(fail.alias("fail"), high.alias("high"), F.count_if(F.col("o_orderstatus").isin("F", "O")).alias("decided"), status.alias("status"))


@query("""WITH c AS (SELECT c_mktsegment, o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2)
SELECT c_mktsegment, o_orderpriority, v, CASE WHEN v = 0 THEN -1 ELSE least(4, floor((v - 1) * 5.0::DOUBLE / greatest(1, max(v) OVER ())))::BIGINT END AS shade FROM c""")
def family_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    decided = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = decided.groupBy("c_mktsegment", "o_orderpriority").agg(F.count_if(is_("F")).alias("v"))
    peak = cells.agg(F.max("v").alias("peak"))  # one row: the heatmap itself is segments x priorities
    shade = F.when(F.col("v") == 0, -1).otherwise(F.least(F.lit(4), F.floor((F.col("v") - 1) * 5.0 / F.greatest(F.lit(1), F.col("peak"))))).cast("long")
    return cells.crossJoin(F.broadcast(peak)).select("c_mktsegment", "o_orderpriority", "v", shade.alias("shade"))


@query(f"SELECT d.status, count(DISTINCT user_id) AS n FROM (SELECT unnest({list(_TYPES)}) AS status) d LEFT JOIN events ON event_type = d.status GROUP BY 1")
def queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count_distinct("user_id").alias("n"))
    return spark.createDataFrame([(t,) for t in _TYPES], "status string").join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT count(*) AS paths, count(DISTINCT p_brand) AS techniques, count(s) AS mapped, count(*) - count(s) AS unmapped FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS s FROM lineitem) ON s = p_partkey")
def attack_coverage(spark: SparkSession, sf: str) -> DataFrame:
    sold = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("s", F.lit(1))
    return table(spark, sf, "part").join(sold, "p_partkey", "left").agg(F.count("*").alias("paths"), F.count_distinct("p_brand").alias("techniques"), F.count("s").alias("mapped"), (F.count("*") - F.count("s")).alias("unmapped"))


_MAILS = "len(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+'))"


@query(f"SELECT CASE WHEN {_MAILS} > 0 THEN 'cli' WHEN contains(text, 'License') THEN 'manual' ELSE 'none' END AS kind, count(*) AS n, sum({_MAILS})::BIGINT AS commands, count(*) FILTER (WHERE {_MAILS} = 1) AS runnable FROM documents GROUP BY 1")
def remediation_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("text", F.size(F.regexp_extract_all("text", F.lit("[a-z0-9.]+@[a-z0-9.]+"), F.lit(0))).alias("steps"))
    kind = F.when(F.col("steps") > 0, "cli").when(F.contains("text", F.lit("License")), "manual").otherwise("none")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("steps").alias("commands"), F.count_if(F.col("steps") == 1).alias("runnable"))


@query("""SELECT o_orderkey, c_mktsegment AS framework, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS severity_rank, CASE WHEN o_totalprice > 200000 THEN 'cli' WHEN o_totalprice > 100000 THEN 'manual' ELSE 'none' END AS kind,
row_number() OVER (PARTITION BY c_mktsegment, o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'P')""")
def remediation_plan(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    kind = F.when(F.col("o_totalprice") > 200_000, "cli").when(F.col("o_totalprice") > 100_000, "manual").otherwise("none")
    rows = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "P")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    by = Window.partitionBy("c_mktsegment", "o_custkey").orderBy(rank, "o_orderkey")
    return rows.select("o_orderkey", F.col("c_mktsegment").alias("framework"), rank.alias("severity_rank"), kind.alias("kind"), F.row_number().over(by).alias("place"))


_BASELINE = ("Brand#11", "Brand#22", "Brand#33")


@query(f"SELECT p_partkey, p_brand FROM part WHERE p_brand IN {_BASELINE}")
def baseline_scope(spark: SparkSession, sf: str) -> DataFrame:
    baseline = spark.createDataFrame([(x,) for x in _BASELINE], "p_brand string")
    return table(spark, sf, "part").join(F.broadcast(baseline), "p_brand", "left_semi").select("p_partkey", "p_brand")


@query(f"SELECT split_part(p_type, ' ', 1) AS family, count(*) AS patterns, count(DISTINCT p_type) AS paths, {sql_set('p_brand')} AS packs FROM part GROUP BY 1")
def vendor_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("family")).agg(F.count("*").alias("patterns"), F.count_distinct("p_type").alias("paths"), sorted_set("p_brand").alias("packs"))


@query("SELECT p_brand, count(*) FILTER (WHERE ends_with(p_type, 'L')) AS taught FROM part GROUP BY 1")
def taught_fact_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(F.endswith("p_type", F.lit("L"))).alias("taught"))


@query("SELECT source AS job, count(*) AS total, count(*) FILTER (WHERE n_chars <= 8000) AS succeeded, count(*) FILTER (WHERE n_chars > 8000) AS failed, CASE WHEN count(*) FILTER (WHERE n_chars > 8000) > 0 THEN 'done with errors' ELSE 'done' END AS state FROM documents GROUP BY 1")
def bulk_job_progress(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.count_if(F.col("n_chars") > 8000)
    return table(spark, sf, "documents").groupBy(F.col("source").alias("job")).agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") <= 8000).alias("succeeded"), bad.alias("failed"), F.when(bad > 0, "done with errors").otherwise("done").alias("state"))


@query(f"SELECT n_name, {_SCORE.format(p='count(*) FILTER (WHERE o_orderstatus = $$F$$)', f='count(*) FILTER (WHERE o_orderstatus = $$O$$)')} AS score FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def nation_score(spark: SparkSession, sf: str) -> DataFrame:
    return orders_at_home(spark, sf).groupBy("n_name").agg(score(F.count_if(is_("F")), F.count_if(is_("O"))).alias("score"))
