"""Queries of sources and sinks. Inputs of other formats are made by Spark from the tables, so they grow with them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.operators import lines as ln
from ledgerlake.operators.conditions import AllOf, AnyOf, Count, FactCheck, NoneOf, Presence
from ledgerlake.plans.conditions import DISCOUNT, ENOUGH, LARGE, OPEN, RETURNED
from ledgerlake.plans.joins import sorted_set, sql_set
from ledgerlake.plans.lines import PATTERNS
from ledgerlake.registry import query
from ledgerlake.session import shared_folder, spread, table
from ledgerlake.sources.catalogs import controls
from ledgerlake.sources.tables import DeviceTable


#: Rows of a file of a format that is read file by file.
ROWS = 50_000


def stored(df: DataFrame, fmt: str, purpose: str, **options) -> str:
    path = shared_folder(df.sparkSession, purpose)
    df.write.format(fmt).options(**options).save(path)
    return path


@query("SELECT doc_id, strlen(text)::BIGINT AS length, sha256(text) AS content_sha256 FROM documents")
def config_files_source(spark: SparkSession, sf: str) -> DataFrame:
    # bytes, never text, so that decoding is decided once
    raw = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return raw.select("doc_id", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("content_sha256"))


@query("SELECT doc_id, length(text) AS chars, sha256(text) AS text_sha256 FROM documents WHERE nfc_normalize(text) = text AND NOT regexp_matches(text, '[ªº²³¹¼½¾ﬀ-ﬆ]')")
def decode_normalise(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf("string")
    def slow(values: pd.Series) -> pd.Series:
        import unicodedata

        def one(b: bytes) -> str:
            for codec in ("utf-8-sig", "cp1252", "latin-1"):
                try:
                    return unicodedata.normalize("NFKC", b.decode(codec))
                except UnicodeDecodeError:
                    continue
            return b.decode("latin-1")

        return values.map(one)

    content = table(spark, sf, "documents").select("doc_id", F.concat(F.unhex(F.when(F.col("doc_id") % 2 == 0, "EFBBBF").otherwise("")), F.encode("text", "UTF-8")).alias("content"))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    plain = text.isNotNull() & (F.octet_length(text) == F.char_length(text))
    quick = content.filter(plain).select("doc_id", text.alias("text"))
    decoded = quick.unionByName(content.filter(~plain | text.isNull()).select("doc_id", slow("content").alias("text")))
    return decoded.select("doc_id", F.char_length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


@query("""WITH t AS (SELECT doc_id, n_chars, n_chars <= 8000 AS fits, sum(CASE WHEN n_chars <= 8000 THEN n_chars ELSE 0 END) OVER (ORDER BY doc_id) AS total FROM documents)
SELECT doc_id, CASE WHEN NOT fits THEN 'oversize' WHEN total > 1000000 THEN 'over the total' ELSE 'ok' END AS state FROM t""")
def bulk_estate_ingest(spark: SparkSession, sf: str) -> DataFrame:
    # the running total in two steps: inside ranges of ids, then over the ranges' sums
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("n"), (F.col("n_chars") <= 8000).alias("fits"))
    rows = docs.withColumn("taken", F.when(F.col("fits"), F.col("n")).otherwise(0)).withColumn("range", F.floor(F.col("doc_id") / 4096))
    inside = rows.withColumn("upto", F.sum("taken").over(Window.partitionBy("range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy("range").agg(F.sum("taken").alias("s"))
    before = sums.select("range", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = inside.join(before, "range")
    state = F.when(~F.col("fits"), "oversize").when(F.col("upto") + F.col("before") > 1_000_000, "over the total").otherwise("ok")
    return total.select("doc_id", state.alias("state"))


@query("SELECT 'V-' || p_partkey AS control_id, p_name AS title, CASE WHEN p_size > 30 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END AS severity, 'CCI-' || p_size AS cci, 'OLD-' || p_partkey AS legacy_ids FROM part")
def xccdf_catalog_source(spark: SparkSession, sf: str) -> DataFrame:
    part = spread(table(spark, sf, "part"))
    severity = F.when(F.col("p_size") > 30, "high").when(F.col("p_size") > 10, "medium").otherwise("low")
    ident = lambda system, prefix, key: F.struct(F.lit(system).alias("_system"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("_VALUE"))
    group = part.select(
        F.concat(F.lit("V-"), "p_partkey").alias("_id"),
        F.struct(severity.alias("_severity"), F.col("p_name").alias("title"), F.array(ident("http://cyber.mil/cci", "CCI-", "p_size"), ident("http://cyber.mil/legacy", "OLD-", "p_partkey")).alias("ident")).alias("Rule"),
    )
    # an XML file is one task's, whatever its size
    path = stored(group, "xml", "xccdf", rowTag="Group", rootTag="Benchmark", maxRecordsPerFile=ROWS)
    schema = "_id string, Rule struct<_severity:string,title:string,ident:array<struct<_VALUE:string,_system:string>>>"
    read = spark.read.format("xml").option("rowTag", "Group").schema(schema).load(path)
    of = lambda word: F.array_join(F.array_sort(F.transform(F.filter("Rule.ident", lambda i: F.contains(i["_system"], F.lit(word))), lambda i: i["_VALUE"])), ",")
    return read.select(F.col("_id").alias("control_id"), F.col("Rule.title").alias("title"), F.col("Rule._severity").alias("severity"), of("cci").alias("cci"), of("legacy").alias("legacy_ids"))


@query("""SELECT 'RG-' || lpad(n_regionkey::VARCHAR, 2, '0') AS control_id, r_name AS title FROM region JOIN nation ON n_regionkey = r_regionkey UNION
SELECT 'RG-' || lpad(n_regionkey::VARCHAR, 2, '0') || '(' || lpad(n_nationkey::VARCHAR, 2, '0') || ')', n_name FROM nation WHERE n_nationkey % 7 <> 0""")
def oscal_catalog_source(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerlake.functions.scalars import control_id

    child = F.struct(F.concat(F.lit("rg-"), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 7 == 0, "withdrawn").otherwise("active").alias("status"))
    nested = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(child).alias("controls")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tree = nested.select(F.concat(F.lit("rg-"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("title"), "controls")
    path = stored(tree, "json", "oscal")
    read = spark.read.schema("id string, title string, controls array<struct<id:string,title:string,status:string>>").json(path)
    below = read.select(F.explode("controls").alias("c")).filter("c.status <> 'withdrawn'").select(control_id(F.col("c.id")).alias("control_id"), F.col("c.title").alias("title"))
    return read.select(control_id(F.col("id")).alias("control_id"), "title").unionByName(below)


_TREE_ID = "'RG-' || lpad(n_regionkey::VARCHAR, 2, '0')"


@query(f"""SELECT DISTINCT {_TREE_ID} AS control_id, r_name AS title, '' AS statement, 1 AS depth FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
UNION ALL SELECT {_TREE_ID} || '(' || lpad(n_nationkey::VARCHAR, 2, '0') || ')', n_name, 'Keep [assignment: ' || n_nationkey || '_prm]:' || chr(10) || '  a. ' || n_name, 2 FROM nation WHERE n_nationkey % 7 <> 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT {_TREE_ID} || '(' || (s_suppkey + 100) || ')', s_name, 'See ' || s_name, 3 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> 0""")
def oscal_catalog_tree(spark: SparkSession, sf: str) -> DataFrame:
    # regions hold nations, which hold suppliers; withdrawn nations keep what is below them
    text = lambda *c: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    field = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    props = lambda gone, label: F.array(field("label", label), field("status", F.when(gone, "withdrawn").otherwise("active")))
    region, nation, key = (F.col(c).cast("string") for c in ("n_regionkey", "n_nationkey", "s_suppkey"))
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    low = F.struct(
        text("rg-", region, ".", (F.col("s_suppkey") + 100).cast("string")).alias("id"), F.col("s_name").alias("title"), props(F.col("s_suppkey") % 5 == 0, key).alias("props"),
        F.array(F.struct(F.lit("statement").alias("name"), text("See ", F.col("s_name")).alias("prose"))).alias("parts"),
    )
    nations = rows.groupBy("n_nationkey", "n_regionkey", "n_name").agg(F.collect_list(low).alias("controls"))
    item = F.struct(F.lit("item").alias("name"), F.col("n_name").alias("prose"), F.array(field("label", F.lit("a."))).alias("props"))
    statement = F.struct(F.lit("statement").alias("name"), text("Keep {{ insert: param, ", nation, "_prm }}:").alias("prose"), F.array(item).alias("parts"))
    middle = F.struct(text("rg-", region, ".", nation).alias("id"), F.col("n_name").alias("title"), props(F.col("n_nationkey") % 7 == 0, nation).alias("props"), F.array(statement).alias("parts"), F.col("controls"))
    regions = nations.groupBy("n_regionkey").agg(F.collect_list(middle).alias("below")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    root = F.struct(text("rg-", region).alias("id"), F.col("r_name").alias("title"), F.col("below").alias("controls"))
    trees = regions.select(F.col("r_regionkey").alias("catalog"), F.to_json(F.struct(F.array(root).alias("controls"))).alias("text"))
    read = spark.read.schema("catalog int, text string").json(stored(trees, "json", "oscal-tree"))
    return controls(read, "catalog", "text").select("control_id", "title", "statement", F.size("place").alias("depth"))


@query("SELECT p_partkey::VARCHAR AS control_id, CASE WHEN p_size > 20 THEN p_name || chr(10) || chr(10) || p_type ELSE p_name END AS discussion FROM part WHERE p_partkey % 13 <> 0")
def cis_catalog_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 13 == 0, "").otherwise(F.col("p_partkey").cast("string")).alias("section"), F.col("p_name").alias("description"), F.when(F.col("p_size") > 20, F.col("p_type")).otherwise("").alias("rationale"))
    read = spark.read.schema("section string, description string, rationale string").json(stored(rows, "json", "cis"))
    text = F.concat_ws("\n\n", F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("rationale"), F.lit("")))
    return read.filter("section <> ''").select(F.col("section").alias("control_id"), text.alias("discussion"))


@query(f"SELECT l_suppkey AS element, {sql_set('l_partkey')} AS controls, l_suppkey // 10 AS theme FROM lineitem GROUP BY 1")
def iso_catalog_from_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_suppkey").alias("elements"))
    inverted = pairs.select("l_partkey", F.explode("elements").alias("element"))
    return inverted.groupBy("element").agg(sorted_set("l_partkey").alias("controls")).withColumn("theme", F.floor(F.col("element") / 10))


@query("SELECT n_regionkey AS cci, coalesce(max(n_name) FILTER (WHERE n_name LIKE 'I%'), max(n_name)) AS control FROM nation GROUP BY 1")
def cci_crosswalk_source(spark: SparkSession, sf: str) -> DataFrame:
    preferred = F.max(F.struct(F.startswith("n_name", F.lit("I")).alias("latest"), F.col("n_name").alias("title")))
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("cci")).agg(preferred["title"].alias("control"))


@query(f"SELECT n_name AS control, {sql_set('s_suppkey')} AS elements FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def olir_crosswalk_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", F.lit("").alias("b"), F.lit("").alias("c"), "s_suppkey")
    read = spark.read.schema("control string, b string, c string, element long").option("header", True).csv(stored(rows, "csv", "olir", header=True))
    return read.groupBy("control").agg(sorted_set("element").alias("elements"))


@query("SELECT doc_id AS id, lang AS name, CASE WHEN length(text) > 200 THEN left(text, 199) || '…' ELSE text END AS description, source AS phase FROM documents WHERE doc_id % 17 <> 0")
def stix_bundle_source(spark: SparkSession, sf: str) -> DataFrame:
    reference = F.array(F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id")), F.struct(F.lit("catalog").alias("source_name"), F.col("doc_id").cast("string").alias("external_id")))
    objects = table(spark, sf, "documents").select(reference.alias("external_references"), F.col("lang").alias("name"), F.col("text").alias("description"), F.array("source").alias("phases"), (F.col("doc_id") % 17 == 0).alias("revoked"))
    schema = "external_references array<struct<source_name:string,external_id:string>>, name string, description string, phases array<string>, revoked boolean"
    read = spark.read.schema(schema).json(stored(objects, "json", "stix"))
    own = F.filter("external_references", lambda r: r["source_name"] == "catalog")[0]["external_id"]
    short = F.when(F.char_length("description") > 200, F.concat(F.left("description", F.lit(199)), F.lit("…"))).otherwise(F.col("description"))
    return read.filter("NOT revoked").select(own.cast("long").alias("id"), "name", short.alias("description"), F.col("phases")[0].alias("phase"))


RULES = {"discount": DISCOUNT, "returned": RETURNED, "enough": ENOUGH, "large": LARGE, "both": AllOf((DISCOUNT, OPEN)), "either": AnyOf((RETURNED, LARGE)), "neither": NoneOf((RETURNED, Presence("order.missing")))}


def rule_nodes(tree, rule: str, node: str = "0") -> list[tuple]:
    """(rule_id, node_id, parent_id, depth, type, path, op) of a tree, parents first."""
    parent = node.rpartition(".")[0] or None
    leaf = tree if isinstance(tree, FactCheck | Presence | Count) else None
    row = (rule, node, parent, node.count("."), type(tree).__name__, getattr(leaf, "path", None), getattr(leaf, "op", None))
    return [row, *[r for i, c in enumerate(getattr(tree, "children", ())) for r in rule_nodes(c, rule, f"{node}.{i}")]]


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [r for rule, tree in RULES.items() for r in rule_nodes(tree, rule)]
    return spark.createDataFrame(rows, "rule_id string, node_id string, parent_id string, depth int, type string, path string, op string")


@query("""SELECT path, count(*) AS facts FROM (SELECT unnest(['line.discount', 'line.returnflag', 'line.quantity']) AS path FROM lineitem UNION ALL SELECT unnest(['order.total', 'order.status']) FROM orders) GROUP BY 1""")
def rule_pack_table(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerlake.plans.facts import facts

    wanted = rule_table(spark).filter("path IS NOT NULL").select("path").distinct()
    return facts(spark, sf).join(F.broadcast(wanted), "path", "left_semi").groupBy("path").agg(F.count("*").alias("facts"))


@query("SELECT doc_id, p.position, p.id FROM documents CROSS JOIN (VALUES " + ", ".join(f"({i}, '{n}', '{r}')" for i, (n, r) in enumerate(PATTERNS)) + ") p(position, id, regex) WHERE regexp_matches(text, '^(?:' || p.regex || ')')")
def pattern_pack_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(i, n, r) for i, (n, r) in enumerate(PATTERNS)]
    patterns = spark.createDataFrame(rows, "position int, id string, regex string")
    return table(spark, sf, "documents").join(F.broadcast(patterns), F.expr("text rlike concat('^(?:', regex, ')')")).select("doc_id", "position", "id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def device_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("""SELECT l_orderkey AS device, CASE WHEN l_orderkey % 5 = 0 THEN 2 ELSE 1 END AS version, l_linenumber, l_partkey, CASE WHEN l_orderkey % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END AS quantity
FROM lineitem WHERE l_orderkey % 5 <> 0 OR l_returnflag <> 'R'""")
def device_table_replace(spark: SparkSession, sf: str) -> DataFrame:
    # a fifth of the devices deliver again, some of them without any fact; then both deliveries come once more, the older one last
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("device"), F.lit(1).cast("long").alias("version"), "l_linenumber", "l_partkey", F.col("l_quantity").alias("quantity"), "l_returnflag")
    second = rows.filter("device % 5 = 0").withColumn("version", F.lit(2).cast("long")).withColumn("quantity", F.col("quantity") + 1)
    kept = DeviceTable(spark, shared_folder(spark, "devices"), rows.drop("l_returnflag").schema, "device", "version", 16)
    for heads, facts in ((rows, rows), (second, second.filter("l_returnflag <> 'R'")), (second, second.filter("l_returnflag <> 'R'")), (rows, rows)):
        kept.replace(heads.select("device", "version"), facts.drop("l_returnflag"))
    return kept.read()


@query("""SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, l_quantity + 1 FROM lineitem WHERE l_orderkey % 5 = 0 AND l_returnflag <> 'R') GROUP BY 1""")
def facts_replace_by_device(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    sent = old.filter("l_orderkey % 5 = 0")
    new = sent.filter("l_returnflag <> 'R'").select("l_orderkey", (F.col("l_quantity") + 1).alias("l_quantity"))
    kept = old.join(sent.select("l_orderkey").distinct(), "l_orderkey", "left_anti").select("l_orderkey", "l_quantity")
    return kept.unionByName(new).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM lineitem")
def findings_append(spark: SparkSession, sf: str) -> DataFrame:
    row = F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    path = shared_folder(spark, "findings")
    text = table(spark, sf, "lineitem").select(F.to_json(row).alias("finding"), (F.col("l_orderkey") % 2).alias("half"))
    for half in (0, 1):  # two audits append to one ledger
        text.filter(F.col("half") == half).select("finding").write.mode("append").parquet(path)
    back = F.from_json("finding", "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string")
    return spark.read.parquet(path).select(back.alias("f")).select("f.*")


@query("SELECT n_name, to_json({'customers': count(*), 'segments': list_sort(list(DISTINCT c_mktsegment))})::VARCHAR AS doc FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def catalog_json_sink(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    grouped = rows.groupBy("n_name").agg(F.count("*").alias("customers"), F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    return grouped.select("n_name", F.to_json(F.struct("customers", "segments")).alias("doc"))


@query("WITH u AS (SELECT user_id FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1), e AS (SELECT events.* FROM events JOIN u USING (user_id)) SELECT event_id, event_type, (SELECT count(*) FROM e) AS total FROM e ORDER BY event_id DESC LIMIT 200")
def access_log_append(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    actor = events.groupBy("user_id").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "user_id").limit(1)
    return events.join(F.broadcast(actor), "user_id").orderBy(F.desc("event_id")).limit(200).select("event_id", "event_type", "total")


@query("""SELECT o_custkey AS device, count(*) FILTER (WHERE o_orderstatus <> 'P') AS results, count(*) FILTER (WHERE o_orderstatus = 'P') AS omitted, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus <> 'P') AS rules,
array_to_string(list_sort(list(o_orderkey) FILTER (WHERE o_orderstatus <> 'P')), ',') AS result_keys FROM orders GROUP BY 1""")
def sarif_export_dataset(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.col("o_orderstatus") != "P"
    result = F.when(shown, F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("ruleId"), F.col("o_orderstatus").alias("kind")))
    doc = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("device")).agg(F.array_sort(F.collect_list(result)).alias("results"), F.count_if(~shown).alias("omitted"))
    document = doc.withColumn("document", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array_distinct(F.transform("results", lambda r: r["ruleId"])).alias("rules"), "results", "omitted")))
    parsed = F.from_json("document", "rules array<string>, results array<struct<key:long,ruleId:string,kind:string>>, omitted long")
    back = document.select("device", parsed.alias("d"))
    return back.select("device", F.size("d.results").cast("long").alias("results"), F.col("d.omitted").alias("omitted"), F.size("d.rules").cast("long").alias("rules"), F.nullif(F.array_join(F.transform("d.results", lambda r: r["key"].cast("string")), ","), F.lit("")).alias("result_keys"))


@query("""SELECT n_name, c_mktsegment, count(o_orderkey) AS observations, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS findings, count(*) FILTER (WHERE o_orderstatus = 'F') AS risks, count(DISTINCT o_orderpriority) AS tokens
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def oscal_export_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "c_mktsegment").agg(
        F.count("*").alias("observations"), F.count_if(F.col("o_orderstatus").isin("F", "O")).alias("findings"), F.count_if(F.col("o_orderstatus") == "F").alias("risks"), F.count_distinct("o_orderpriority").alias("tokens")
    )


@query("SELECT c_custkey AS device, CASE WHEN count(o_orderkey) = 0 THEN 'error' ELSE 'ok' END AS state, greatest(count(o_orderkey), 1) AS findings FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def audit_envelope_sink(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("device")).agg(F.count("*").alias("n"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("device")).join(counted, "device", "left")
    envelope = F.to_json(F.struct("device", F.when(F.col("n").isNull(), "error").otherwise("ok").alias("state"), F.coalesce("n", F.lit(1)).alias("findings"), F.lit(None).cast("string").alias("appendix")))
    # to_json leaves null keys out: an appendix without content is absent, not empty
    return rows.select(F.from_json(envelope, "device long, state string, findings long").alias("e")).select("e.*")


@query("SELECT DISTINCT 'taught:' || left(sha256(p_name), 12) AS id, p_name AS template, CASE WHEN contains(p_name, '#') THEN 'str' ELSE 'true' END AS type FROM part")
def taught_pattern_export(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(ln.template_id(F.col("p_name")).alias("id"), F.col("p_name").alias("template"), F.when(F.contains("p_name", F.lit("#")), "str").otherwise("true").alias("type")).distinct()


@query("SELECT user_id, event_id, event_type FROM events")
def ledger_reader(spark: SparkSession, sf: str) -> DataFrame:
    path = stored(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "json", "ledger")
    return spark.read.schema("user_id long, event_id long, event_type string").option("mode", "FAILFAST").json(path)
