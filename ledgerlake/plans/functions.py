"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions import scalars as s
from ledgerlake.registry import query
from ledgerlake.session import table

_SEVERITIES = ("CAT I", " cat ii ", "Cat III", "critical", "IMPORTANT", "informational", "", "low", "odd")


@query("""WITH named AS (SELECT list_value('CAT I', ' cat ii ', 'Cat III', 'critical', 'IMPORTANT', 'informational', '', 'low', 'odd')[(o_orderkey % 9 + 1)::INT] AS raw FROM orders)
SELECT raw, CASE lower(trim(raw)) WHEN 'cat i' THEN 'high' WHEN 'cat ii' THEN 'medium' WHEN 'cat iii' THEN 'low' WHEN 'critical' THEN 'high' WHEN 'important' THEN 'medium'
WHEN 'informational' THEN 'low' WHEN '' THEN 'unknown' ELSE lower(trim(raw)) END AS severity, count(*) AS n FROM named GROUP BY 1, 2""")
def normalise_severity(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, _SEVERITIES)), (F.col("o_orderkey") % 9).cast("int"))
    return table(spark, sf, "orders").select(raw.alias("raw")).groupBy("raw", s.normalise_severity(F.col("raw")).alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'BR-' || printf('%02d', p_partkey % 400) || CASE WHEN p_size > 25 THEN '(' || lpad((p_size % 30)::VARCHAR, 2, '0') || ')' ELSE '' END AS control FROM part")
def normalise_control_id(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("br-"), (F.col("p_partkey") % 400).cast("string"), F.when(F.col("p_size") > 25, F.concat(F.lit(" ("), (F.col("p_size") % 30).cast("string"), F.lit(") (a)"))).otherwise(""))
    return table(spark, sf, "part").select("p_partkey", s.control_id(raw).alias("control"))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT 'BR-' || printf('%02d', p_partkey % 400) || '(' || lpad((p_size % 30)::VARCHAR, 2, '0') || ')')), ',') AS controls FROM part GROUP BY 1")
def normalise_oscal_id(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat_ws(".", F.concat(F.lit("br-"), (F.col("p_partkey") % 400).cast("string")), (F.col("p_size") % 30).cast("string"))
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set(s.control_id(raw))), ",").alias("controls"))


@query("SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS folded FROM part")
def slugify_fold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", s.slug(F.col("p_name")).alias("slug"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "").alias("folded"))


@query("""WITH v AS (SELECT event_id, json_extract_string(props, '$.k') AS v FROM events)
SELECT CASE WHEN lower(v) IN ('true', 'false') THEN 'bool' WHEN regexp_matches(v, '^-?[0-9]+$') THEN 'int' WHEN v IS NULL THEN NULL ELSE 'str' END AS kind, count(*) AS n FROM v GROUP BY 1""")
def infer_value(spark: SparkSession, sf: str) -> DataFrame:
    v = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").groupBy(F.when(v.isNotNull(), s.inferred(v)).alias("kind")).agg(F.count("*").alias("n"))


_STEPS = """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), l AS (SELECT doc_id, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS no FROM p)
"""


@query(_STEPS + """SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '^[A-Z][a-z]+ [a-z]+,')) AS steps, count(*) FILTER (WHERE NOT regexp_matches(line, '^[A-Z][a-z]+ [a-z]+,')) AS prose,
CASE WHEN count(*) FILTER (WHERE regexp_matches(line, '^[A-Z][a-z]+ [a-z]+,')) > 0 THEN 'cli' WHEN max(length(line)) > 0 THEN 'manual' ELSE 'none' END AS kind,
min(no) FILTER (WHERE regexp_matches(line, '^[A-Z][a-z]+ [a-z]+,')) AS first_step FROM l GROUP BY 1""")
def extract_fix_steps(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    step = F.col("line").rlike("^[A-Z][a-z]+ [a-z]+,")
    return rows.groupBy("doc_id").agg(
        F.count_if(step).alias("steps"), F.count_if(~step).alias("prose"),
        F.when(F.count_if(step) > 0, "cli").when(F.max(F.char_length("line")) > 0, "manual").otherwise("none").alias("kind"), F.min(F.when(step, F.col("at") + 1)).cast("long").alias("first_step"),
    )


@query("SELECT o_orderkey, sha256(concat_ws(chr(31), o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority)) AS fingerprint, '_' || o_orderpriority AS token FROM orders")
def export_tokens(spark: SparkSession, sf: str) -> DataFrame:
    token = F.when(F.col("o_orderpriority").rlike("^[A-Za-z_]"), F.col("o_orderpriority")).otherwise(F.concat(F.lit("_"), "o_orderpriority"))
    parts = [F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")]
    return table(spark, sf, "orders").select("o_orderkey", s.export_token(*parts).alias("fingerprint"), token.alias("token"))


_KINDS = [("F", "fail", "open", "error"), ("O", "pass", "none", "note"), ("P", "open", "investigating", "warning")]


@query("SELECT o_orderkey, kind, state, level FROM orders LEFT JOIN (VALUES " + ", ".join(map(str, _KINDS)) + ") m(status, kind, state, level) ON status = o_orderstatus")
def result_mappings(spark: SparkSession, sf: str) -> DataFrame:
    mapping = spark.createDataFrame(_KINDS, "o_orderstatus string, kind string, state string, level string")
    return table(spark, sf, "orders").join(F.broadcast(mapping), "o_orderstatus", "left").select("o_orderkey", "kind", "state", "level")


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '1') THEN 'section-' || split_part(p_brand, '#', 2) ELSE split_part(p_type, ' ', 1) END AS family FROM part")
def control_family(spark: SparkSession, sf: str) -> DataFrame:
    family = F.when(F.col("p_brand").contains("1"), F.concat(F.lit("section-"), F.split_part("p_brand", F.lit("#"), F.lit(2)))).otherwise(F.split_part("p_type", F.lit(" "), F.lit(1)))
    return table(spark, sf, "part").select("p_partkey", family.alias("family"))


@query("SELECT CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 2500 THEN 1 WHEN c_acctbal < 5000 THEN 2 ELSE 3 END AS band, count(*) AS n FROM customer GROUP BY 1")
def score_band(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").groupBy(s.score_band(F.col("c_acctbal"), [-1000, 0, 2500, 5000, 10000]).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN '10.' || (s_suppkey % 200) || '.0.0/16' WHEN s_suppkey % 4 = 2 THEN '10.' || (s_suppkey % 200) || '.7.0/24'
ELSE '10.' || (s_suppkey % 200) || '.7.128/26' END AS network FROM supplier""")
def network_of(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    address = F.concat(F.lit("10."), (k % 200).cast("string"), F.lit(".7.140"))
    mask = F.when(k % 4 == 0, "255.255.255.255").when(k % 4 == 1, "255.255.0.0").when(k % 4 == 2, "255.255.255.0").otherwise("255.255.255.192")
    return table(spark, sf, "supplier").select("s_suppkey", s.network_of(address, mask).alias("network"))


@query("SELECT event_id % 3 = 0 AS zoned, count(*) AS n FROM events GROUP BY 1")
def timestamp_check(spark: SparkSession, sf: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    given = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("Z"))).when(F.col("event_id") % 3 == 1, text).otherwise(F.regexp_replace(text, "T", " "))
    return table(spark, sf, "events").groupBy(s.zoned_timestamp(given).alias("zoned")).agg(F.count("*").alias("n"))
