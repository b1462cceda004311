"""Queries of streams and of mappings; each stream's result is the one of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.registry import query
from ledgerlake.session import shared_folder, table
from ledgerlake.sources.tables import DeviceTable
from ledgerlake.streaming.streams import arriving, arriving_in_order, drained, run_available

FILES = 4
#: Rows of a mapping up to which it is sent to all executors.
MANY = 100_000


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("SELECT event_id, event_type, CASE WHEN value < 0 THEN 'error' ELSE 'ok' END AS state FROM events")
def stream_config_ingest(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark, "stream")
    out = f"{root}/out"

    def store(batch: DataFrame, n: int) -> None:
        rows = batch.select("event_id", "event_type", F.when(F.col("value") < 0, "error").otherwise("ok").alias("state"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={n}")  # a batch that is run again replaces its own rows

    run_available(arriving(spark, events(spark, sf), f"{root}/in", FILES), store, f"{root}/checkpoint")
    return spark.read.parquet(out).drop("batch")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_replace_by_device(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark, "stream")
    rows = events(spark, sf).select("user_id", "event_id", "event_type")
    kept = DeviceTable(spark, f"{root}/devices", rows.schema, "user_id", "event_id")
    # a batch that is run again, or comes late, leaves newer deliveries as they are
    run_available(arriving(spark, rows, f"{root}/in", FILES), lambda batch, n: kept.replace(batch, batch), f"{root}/checkpoint")
    return kept.read()


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'mapped.click' WHEN 'view' THEN 'mapped.view' END AS path FROM events")
def stream_static_mapping(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark, "stream")
    mappings, out = f"{root}/mappings", f"{root}/out"
    spark.createDataFrame([("click", "mapped.click"), ("view", "mapped.view")], "event_type string, path string").write.parquet(mappings)

    def mapped(batch: DataFrame, n: int) -> None:
        now = batch.sparkSession.read.parquet(mappings)  # read again for every batch: a mapping taught meanwhile is in force
        now = F.broadcast(now) if now.limit(MANY + 1).count() <= MANY else now
        batch.join(now, "event_type", "left").select("event_id", "path").write.mode("overwrite").parquet(f"{out}/batch={n}")

    run_available(arriving(spark, events(spark, sf), f"{root}/in", FILES), mapped, f"{root}/checkpoint")
    return spark.read.parquet(out).drop("batch")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS passed, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1")
def stream_latest_posture(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark, "stream")
    running = arriving(spark, events(spark, sf), f"{root}/in", FILES).groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("passed"), F.count_if(F.col("event_type") == "error").alias("failed"))
    updates = drained(running, "update", f"{root}/out", f"{root}/checkpoint")
    return updates.groupBy("user_id").agg(F.max_by("passed", "batch").alias("passed"), F.max_by("failed", "batch").alias("failed"))


#: A delivery comes again one slice later; rows are kept in mind for somewhat longer than that, and then no more.
SLICES, HORIZON = 10, "7 days"


@query("SELECT event_id, event_type FROM events")
def stream_dedup_config(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark, "stream")
    twice = arriving_in_order(events(spark, sf), "ts", f"{root}/in", SLICES, again=1)
    once = twice.withWatermark("ts", HORIZON).dropDuplicatesWithinWatermark(["event_id"])
    return drained(once.select("event_id", "event_type"), "append", f"{root}/out", f"{root}/checkpoint").drop("batch")


@query("SELECT p_brand AS template, count(*) AS version, arg_max(p_type, p_partkey) AS path, max(p_partkey) AS updated FROM part GROUP BY 1 HAVING arg_max(p_size, p_partkey) > 5")
def mapping_versions(spark: SparkSession, sf: str) -> DataFrame:
    latest = table(spark, sf, "part").groupBy(F.col("p_brand").alias("template")).agg(F.count("*").alias("version"), F.max_by("p_type", "p_partkey").alias("path"), F.max("p_partkey").alias("updated"), F.max_by("p_size", "p_partkey").alias("size"))
    return latest.filter("size > 5").drop("size")


@query("SELECT doc_id, count(*) AS n_lines, sum(length(l))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1")
def udtf_fact_extractor(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.functions import udtf

    @udtf(returnType="line_no int, line string")
    class Lines:
        """The contract of a parser for formats that no pattern covers: text in, rows out."""

        def eval(self, text: str):
            for n, line in enumerate((text or "").split("\n"), 1):
                yield n, line

    spark.udtf.register("lines_of", Lines)
    table(spark, sf, "documents").createOrReplaceTempView("udtf_documents")
    rows = spark.sql("SELECT doc_id, l.line FROM udtf_documents, LATERAL lines_of(text) l")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("chars"))
