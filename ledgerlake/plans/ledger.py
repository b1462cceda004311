"""Queries of the ledger: events are records, a user's events are a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.operators import ledger as led
from ledgerlake.plans.facts import LINES_SQL
from ledgerlake.plans.facts import lines as order_lines
from ledgerlake.registry import query
from ledgerlake.session import shared_folder, table
from ledgerlake.sources.segments import Ledger

#: The fields of a record, in the order of their names.
_FIELDS = ("event_id", "event_type", "merkle_root", "props", "ts", "user_id", "value")
_LEAF = "sha256(unhex('00') || encode({}))"
_ROOT = f"sha256(unhex('01') || unhex({_LEAF.format('event_type')}) || unhex({_LEAF.format('props')}))"
_HASH = f"""sha256(json_object('event_id', event_id, 'event_type', event_type, 'merkle_root', {_ROOT}, 'props', props, 'ts', epoch_us(ts), 'user_id', user_id, 'value', (value::DECIMAL(18,2))::VARCHAR)::VARCHAR)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumn("merkle_root", led.merkle_root(F.array(led.leaf(F.col("event_type")), led.leaf(F.col("props")))))
    shown = {"ts": F.unix_micros(F.col("ts").cast("timestamp")), "value": F.col("value").cast("decimal(18,2)").cast("string")}
    return rows.withColumn("record_hash", led.record_hash(**{c: shown.get(c, F.col(c)) for c in _FIELDS}))


@query(f"SELECT event_id, {_HASH} AS record_hash FROM events")
def record_hash(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).select("event_id", "record_hash")


@query(f"SELECT event_id, {_HASH} AS record_hash, lag({_HASH}, 1, '') OVER (PARTITION BY user_id ORDER BY event_id) AS prev_hash FROM events")
def ledger_prev_hash(spark: SparkSession, sf: str) -> DataFrame:
    return led.chained(records(spark, sf), "user_id", "event_id", "record_hash").select("event_id", "record_hash", "prev_hash")


def _merkle_sql() -> str:
    """Levels unrolled: an order has at most 2**5 lines in the test tables."""
    sql = f"""WITH RECURSIVE l AS {LINES_SQL}, t AS (
  SELECT l_orderkey AS k, line_no - 1 AS pos, sha256(unhex('00') || encode(concat_ws('|', l_partkey::VARCHAR, l_suppkey::VARCHAR, l_returnflag, l_linestatus))) AS h, 0 AS lvl,
         count(*) OVER (PARTITION BY l_orderkey) AS n FROM l)"""
    prev = "t"
    for i in range(1, 6):
        sql += f""", t{i} AS (SELECT k, pos // 2 AS pos, CASE WHEN count(*) = 2 THEN sha256(unhex('01') || unhex(min(h) FILTER (WHERE pos % 2 = 0)) || unhex(min(h) FILTER (WHERE pos % 2 = 1))) ELSE min(h) END AS h FROM {prev} GROUP BY k, pos // 2)"""
        prev = f"t{i}"
    return sql + f" SELECT k AS l_orderkey, h AS merkle_root FROM {prev}"


@query(_merkle_sql())
def merkle_root(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag", "l_linestatus")
    gathered = order_lines(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("line_no", led.leaf(text).alias("h")))).alias("l"))
    return gathered.select("l_orderkey", led.merkle_root(F.transform("l", lambda x: x["h"])).alias("merkle_root"))


@query(f"""WITH r AS (SELECT event_id, user_id, CASE WHEN event_id % 97 = 0 THEN repeat('0', 64) ELSE {_HASH} END AS stored, {_HASH} AS right_hash,
  CASE WHEN event_id % 89 = 0 THEN NULL ELSE event_id % 83 <> 0 END AS merkle_ok, user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') AS actor_ok FROM events),
c AS (SELECT *, lag(right_hash, 1, '') OVER w AS prev_hash, lag(stored, 1, '') OVER w AS before FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT event_id, stored = right_hash AS hash_ok, prev_hash = before AS link_ok, merkle_ok, actor_ok FROM c)
SELECT *, hash_ok AND link_ok AND coalesce(merkle_ok, true) AND actor_ok AS all_valid,
CASE WHEN hash_ok AND link_ok AND coalesce(merkle_ok, true) AND actor_ok THEN 'valid' ELSE concat_ws('; ', CASE WHEN NOT hash_ok THEN 'record hash differs' END,
  CASE WHEN NOT link_ok THEN 'link is broken' END, CASE WHEN NOT merkle_ok THEN 'Merkle root differs' END, CASE WHEN NOT actor_ok THEN 'actor is unknown' END) END AS detail FROM f""")
def verify_chain(spark: SparkSession, sf: str) -> DataFrame:
    # a chain in which some records and roots were tampered with after it was linked, and some records have no leaves to check
    chain = led.chained(records(spark, sf), "user_id", "event_id", "record_hash").withColumn("right", F.col("record_hash")).withColumn("actor", F.col("user_id"))
    zeros = F.repeat(F.lit("0"), F.lit(64))
    bad = chain.withColumn("record_hash", F.when(F.col("event_id") % 97 == 0, zeros).otherwise(F.col("record_hash")))
    root = F.when(F.col("event_id") % 89 != 0, F.col("merkle_root"))
    bad = bad.withColumn("root", root).withColumn("merkle_root", F.when(F.col("event_id") % 83 == 0, zeros).otherwise(F.col("merkle_root")))
    actors = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("actor"))
    checked = led.verified(bad, "user_id", "event_id", F.col("right"), F.col("root"), actors)
    return checked.select("event_id", "hash_ok", "link_ok", "merkle_ok", "actor_ok", "all_valid", "detail")


@query("SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events QUALIFY step > 1")
def ledger_append_only(spark: SparkSession, sf: str) -> DataFrame:
    step = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", step.alias("step")).filter("step > 1")


@query("""SELECT event_id, event_type, 1 + event_id % 3 AS commit, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1 AS seq, true AS holds FROM events""")
def ledger_segments(spark: SparkSession, sf: str) -> DataFrame:
    # three audits append to one ledger, each under the head that the one before left
    rows = table(spark, sf, "events").select("event_id", "event_type")
    ledger = Ledger(spark, shared_folder(spark, "ledger"))
    for part in range(3):
        ledger.append_retrying(rows.filter(F.col("event_id") % 3 == part), ["event_id"])
    broken = ledger.broken()
    return ledger.read().select("event_id", "event_type", F.col("commit").cast("long").alias("commit"), "seq", (~F.col("commit").isin(broken) if broken else F.lit(True)).alias("holds"))
