"""Queries of line projection, extraction and redaction over document text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.functions.coercions import coerced
from ledgerlake.operators import lines as ln
from ledgerlake.operators.redact import CREDENTIALS, redact, redact_columns, redact_tail
from ledgerlake.plans.facts import LINES_SQL
from ledgerlake.plans.facts import lines as order_lines
from ledgerlake.registry import query
from ledgerlake.session import spread, table

PATTERNS = [("number_first", r"[0-9]"), ("license", r".*License"), ("upper", r"[A-Z]{2,}[ !.,]"), ("article", r"(The|Le|La|Der|Die|El)[ .,]"), ("short", r".{1,20}$")]

_LINES = """
parts AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS p FROM documents),
cut AS (SELECT doc_id, lang, source, CASE WHEN p[len(p)] = '' THEN p[1 : len(p) - 1] ELSE p END AS p FROM parts),
lines AS (SELECT doc_id, lang, source, unnest(p) AS raw, unnest(range(1, len(p) + 1)) AS line_no FROM cut),
sig AS (SELECT *, trim(raw, ' ' || chr(9)) AS stripped FROM lines
        WHERE trim(raw, ' ' || chr(9)) <> '' AND NOT regexp_matches(trim(raw, ' ' || chr(9)), '^([!#]|\\^C)'))
"""
_MATCH = "CASE " + " ".join(f"WHEN regexp_matches(stripped, '^(?:{p})') THEN '{n}'" for n, p in PATTERNS) + " END"
_CLAIMED = f"WITH {_LINES}, claimed AS (SELECT *, {_MATCH} AS pattern FROM sig)"


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ln.explode_lines(spread(table(spark, sf, "documents").select("text", "doc_id", "lang", "source")), "text", "doc_id", "lang", "source")


def claimed(spark: SparkSession, sf: str) -> DataFrame:
    return ln.significant(doc_lines(spark, sf)).withColumn("pattern", ln.first_match(F.col("stripped"), PATTERNS))


@query(f"WITH {_LINES} SELECT doc_id, line_no, raw, trim(raw, ' ' || chr(9)) AS stripped, length(raw) - length(ltrim(raw, ' ' || chr(9))) AS indent FROM lines")
def line_explode(spark: SparkSession, sf: str) -> DataFrame:
    return doc_lines(spark, sf).drop("lang", "source")


@query(f"WITH {_LINES} SELECT doc_id, line_no, stripped FROM sig WHERE NOT regexp_matches(stripped, 'License')")
def significant_line_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ln.significant(doc_lines(spark, sf), ["License"]).select("doc_id", "line_no", "stripped")


PACKS = {
    "de": {"markers": [" der ", " die ", " und ", " das "], "min_hits": 2, "anti": [" que "]},
    "en": {"markers": [" the ", " of ", " and ", " that "], "min_hits": 2, "strong": [" the ", " of "]},
    "es": {"markers": [" el ", " los ", " que ", " del "], "min_hits": 2},
    "fr": {"markers": [" le ", " les ", " des ", " que "], "min_hits": 2, "anti": [" und "]},
}


def _score_sql(pack: dict) -> str:
    has = lambda m: f"contains(low, '{m}')"
    hits = " + ".join(f"{has(m)}::INT" for m in pack["markers"])
    bonus = f"CASE WHEN {' AND '.join(map(has, pack['strong']))} THEN 10 ELSE 0 END" if "strong" in pack else "0"
    anti = " OR ".join(map(has, pack.get("anti", []))) or "false"
    return f"CASE WHEN ({anti}) OR ({hits}) < {pack['min_hits']} THEN 0 ELSE ({hits}) + {bonus} END"


@query("WITH low AS (SELECT doc_id, lower(text) AS low FROM documents), s AS (SELECT doc_id, unnest([" + ", ".join(f"'{n}'" for n in PACKS) + "]) AS name, unnest([" + ", ".join(_score_sql(p) for p in PACKS.values()) + "]) AS score FROM low) SELECT doc_id, score::INT AS score, name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name DESC) AS r FROM s) WHERE r = 1")
def vendor_detection(spark: SparkSession, sf: str) -> DataFrame:
    best = ln.detect(F.col("text"), PACKS)
    return table(spark, sf, "documents").select("doc_id", best.alias("best")).select("doc_id", F.col("best.score").alias("score"), F.col("best.name").alias("name"))


@query(_CLAIMED + " SELECT doc_id, line_no, pattern FROM claimed WHERE pattern IS NOT NULL")
def first_match_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return claimed(spark, sf).filter("pattern IS NOT NULL").select("doc_id", "line_no", "pattern")


@query("""SELECT p_partkey, unnest(['type.first', 'type.rest', 'name.first']) AS path,
  unnest([regexp_extract(p_type, '^(\\S+) ?(.*)$', 1), regexp_extract(p_type, '^(\\S+) ?(.*)$', 2), regexp_extract(p_name, '^(\\S+)', 1)]) AS value FROM part""".replace("SELECT p_partkey", "SELECT * FROM (SELECT p_partkey") + ") WHERE value <> ''")
def multi_emission(spark: SparkSession, sf: str) -> DataFrame:
    emit = lambda path, column, regex, group: F.struct(F.lit(path).alias("path"), F.regexp_extract(column, regex, group).alias("value"))
    facts = F.array(emit("type.first", "p_type", r"^(\S+) ?(.*)$", 1), emit("type.rest", "p_type", r"^(\S+) ?(.*)$", 2), emit("name.first", "p_name", r"^(\S+)", 1))
    return table(spark, sf, "part").select("p_partkey", F.explode(facts).alias("f")).select("p_partkey", "f.path", "f.value").filter("value <> ''")


@query("""SELECT p_partkey, p_size > 10 AS true_when_large, NOT (p_size > 10) AS negated, 'fixed' AS const, lower(p_brand) AS folded,
  try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS number, array_to_string(list_sort(list_distinct(string_split(p_type, ' '))), ',') AS word_list,
  (p_size * 60)::BIGINT AS seconds, CASE WHEN regexp_matches(p_name, '^[0-9]+$') THEN 'int' WHEN lower(p_name) IN ('true', 'false') THEN 'bool' ELSE 'str' END AS auto_kind FROM part""")
def value_coercion(spark: SparkSession, sf: str) -> DataFrame:
    auto = F.when(F.col("p_name").rlike("^[0-9]+$"), "int").when(F.lower("p_name").isin("true", "false"), "bool").otherwise("str")
    return table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") > 10).alias("true_when_large"), (~(F.col("p_size") > 10)).alias("negated"), F.lit("fixed").alias("const"),
        F.lower("p_brand").alias("folded"), F.regexp_extract("p_brand", "([0-9]+)", 1).try_cast("long").alias("number"),
        F.array_join(F.array_sort(F.array_distinct(F.split("p_type", " "))), ",").alias("word_list"), (F.col("p_size") * 60).cast("long").alias("seconds"), auto.alias("auto_kind"),
    )


_EMIT = r"^Brand#(?P<neg>1)?(?P<minutes>[0-4])?(?P<seconds>\d)? (?P<value>\S+(?: \S+)*?) (?P<size>\d+)$"
_EMITTED = [("true", "value"), ("false", "value"), ("const", "value"), ("line", "value"), ("negated_bool", "value"), ("minutes_seconds", "value"), ("group_present", "seconds"),
            ("str", "value"), ("lower", "value"), ("int", "seconds"), ("int", "value"), ("word_list", "value"), ("auto", "size"), ("auto", "value")]


@query(f"""WITH p AS (SELECT p_partkey, p_brand || ' ' || p_type || ' ' || p_size AS line FROM part),
g AS (SELECT *, nullif(regexp_extract(line, '{_EMIT}', 1), '') AS neg, nullif(regexp_extract(line, '{_EMIT}', 2), '') AS m, nullif(regexp_extract(line, '{_EMIT}', 3), '') AS s,
  regexp_extract(line, '{_EMIT}', 4) AS v, regexp_extract(line, '{_EMIT}', 5) AS size FROM p WHERE regexp_matches(line, '{_EMIT}')),
e AS (SELECT p_partkey, unnest(['true.value', 'false.value', 'const.value', 'line.value', 'negated_bool.value', 'minutes_seconds.value', 'group_present.seconds', 'str.value', 'lower.value', 'int.seconds', 'int.value', 'word_list.value', 'auto.size', 'auto.value']) AS path,
  unnest(['true', 'false', '"fixed"', to_json(line)::VARCHAR, (neg IS NULL)::VARCHAR, CASE WHEN m IS NULL AND s IS NULL THEN 'skip' ELSE (coalesce(m, '0')::BIGINT * 60 + coalesce(s, '0')::BIGINT)::VARCHAR END, (s IS NOT NULL)::VARCHAR,
    to_json(v)::VARCHAR, to_json(lower(v))::VARCHAR, coalesce(s, 'skip'), 'error', to_json(list_sort(string_split(v, ' ')))::VARCHAR, size, to_json(v)::VARCHAR]) AS x FROM g)
SELECT p_partkey, path, CASE WHEN x IN ('skip', 'error') THEN x ELSE 'value' END AS state, CASE WHEN x NOT IN ('skip', 'error') THEN x END AS value FROM e""")
def emitted_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every coercion over a line for each part."""
    line = F.concat_ws(" ", "p_brand", "p_type", "p_size")
    of = lambda kind, group: coerced(kind, F.col("line"), _EMIT, group, F.lit('"fixed"'))
    facts = F.array(*[F.struct(F.lit(f"{kind}.{group}").alias("path"), of(kind, group).alias("v")) for kind, group in _EMITTED])
    rows = table(spark, sf, "part").select("p_partkey", line.alias("line")).select("p_partkey", F.explode(facts).alias("f"))
    return rows.filter("f.v IS NOT NULL").select("p_partkey", "f.path", "f.v.state", "f.v.value")


@query(_CLAIMED + " SELECT doc_id, line_no, stripped FROM claimed WHERE pattern IS NULL")
def unparsed_residue(spark: SparkSession, sf: str) -> DataFrame:
    return claimed(spark, sf).filter("pattern IS NULL").select("doc_id", "line_no", "stripped")


@query(f"SELECT l_orderkey AS device, line_no AS line_start, line_no AS line_end, 'order-' || l_orderkey AS source_file, l_returnflag || '|' || l_linestatus AS raw_text, CASE WHEN l_linestatus = 'O' THEN 'lines+taught' ELSE 'lines' END AS parser_id, 1.0::DOUBLE AS confidence FROM {LINES_SQL}")
def observed_fact_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return order_lines(spark, sf).select(
        F.col("l_orderkey").alias("device"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.concat(F.lit("order-"), "l_orderkey").alias("source_file"),
        F.concat_ws("|", "l_returnflag", "l_linestatus").alias("raw_text"), F.concat(F.lit("lines"), F.when(F.col("l_linestatus") == "O", "+taught").otherwise("")).alias("parser_id"), F.lit(1.0).alias("confidence"),
    )


@query("""SELECT o_orderkey AS device, f.path, false AS present, 0 AS line_start, 0 AS line_end FROM orders CROSS JOIN (VALUES ('A'), ('N'), ('R')) f(path)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = f.path)""")
def absence_facts(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("device"), F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("path"))
    seen = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("device"), F.col("l_returnflag").alias("path")).distinct()
    return wanted.join(seen, ["device", "path"], "left_anti").select("device", "path", F.lit(False).alias("present"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"))


@query(f"""WITH l AS {LINES_SQL}, f AS (SELECT l_orderkey, l_partkey, min(line_no) AS first FROM l GROUP BY 1, 2)
SELECT l_orderkey AS device, 'order-' || l_orderkey AS device_id, array_to_string(list(l_partkey ORDER BY first), ',') AS hardware FROM f GROUP BY 1""")
def device_identity(spark: SparkSession, sf: str) -> DataFrame:
    seen = F.array_sort(F.collect_list(F.struct("line_no", "l_partkey")))
    hardware = F.array_distinct(F.transform(seen, lambda x: x["l_partkey"]))
    slug = F.regexp_replace(F.lower(F.concat(F.lit("Order "), F.col("l_orderkey"))), "[^a-z0-9]+", "-")
    return order_lines(spark, sf).groupBy("l_orderkey").agg(hardware.alias("h")).select(F.col("l_orderkey").alias("device"), slug.alias("device_id"), F.array_join(F.transform("h", lambda x: x.cast("string")), ",").alias("hardware"))


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS fact_seq, l_partkey FROM lineitem")
def fact_ordering(spark: SparkSession, sf: str) -> DataFrame:
    return order_lines(spark, sf).select("l_orderkey", F.col("line_no").alias("fact_seq"), "l_partkey")


@query("SELECT doc_id, 'sha256:' || sha256(text) AS config_hash FROM documents")
def config_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("config_hash"))


@query(_CLAIMED + " SELECT lang, count(*) AS n_lines, count(pattern) AS parsed, round(1 - (count(*) - count(pattern)) / count(*)::DOUBLE, 4) AS coverage FROM claimed GROUP BY GROUPING SETS ((lang), ())")
def parse_coverage(spark: SparkSession, sf: str) -> DataFrame:
    n, parsed = F.count("*"), F.count("pattern")
    return claimed(spark, sf).rollup("lang").agg(n.alias("n_lines"), parsed.alias("parsed"), F.round(1 - (n - parsed) / n, 4).alias("coverage"))


_REDACT = r"""regexp_replace(regexp_replace(regexp_replace(@, '(token|secret|password)( = )"[^"<]+"', '\1\2<redacted:key>', 'g'), '[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]', '<redacted:mail>', 'g'), '\b[0-9]{12,19}\b', '<redacted:number>', 'g')"""
_REDACTED = _REDACT.replace("@,", "text,")


@query(f"SELECT doc_id, sha256({_REDACTED}) AS text_sha256, {_REDACTED} <> text AS changed FROM documents")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.sha2(redact(F.col("text")), 256).alias("text_sha256"), (redact(F.col("text")) != F.col("text")).alias("changed"))


@query("SELECT doc_id, CASE WHEN lower(source) IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN source ELSE '<redacted:source>' END AS source FROM documents")
def redact_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    allowed = F.lower("source").isin("src0", "src1", "src2", "src3", "src4")
    return table(spark, sf, "documents").select("doc_id", F.when(allowed, F.col("source")).otherwise("<redacted:source>").alias("source"))


@query(f"""WITH {_LINES}, t AS (SELECT doc_id, line_no, regexp_extract(stripped, '(\\S+)$', 1) AS last FROM sig)
SELECT doc_id, line_no, CASE WHEN regexp_matches(last, '^[0-9]+$') OR last IN ('the', 'of', 'and') OR starts_with(last, '<redacted') THEN last ELSE '<redacted:tail>' END AS tail FROM t""")
def redact_untyped_tail(spark: SparkSession, sf: str) -> DataFrame:
    return ln.significant(doc_lines(spark, sf)).select("doc_id", "line_no", redact_tail(F.regexp_extract("stripped", r"(\S+)$", 1), ["the", "of", "and"]).alias("tail"))


@query(f"""WITH {_LINES}, r AS (SELECT doc_id, line_no, raw, stripped, {_REDACT.replace("@,", "raw,")} AS raw_out, {_REDACT.replace("@,", "stripped,")} AS value_out FROM sig)
SELECT doc_id, line_no, sha256(raw_out) AS raw_sha256, sha256(value_out) AS value_sha256, raw_out <> raw AS redacted, {_REDACT.replace("@,", "raw_out,")} <> raw_out AS changed_again FROM r""")
def redact_dataset(spark: SparkSession, sf: str) -> DataFrame:
    # the texts of facts, their values and what was not parsed, before anything is decided or stored; no row is lost
    rows = ln.significant(doc_lines(spark, sf)).select("doc_id", "line_no", F.col("raw").alias("before"), "raw", F.col("stripped").alias("value"))
    done = redact_columns(rows, ["raw"])
    # what is the same text has the same redaction, and a text that stayed as it was stays so again
    done = done.withColumn("value", F.when(F.col("value") == F.col("before"), F.col("raw")).otherwise(redact(F.col("value"))))
    again = F.when(F.col("raw") == F.col("before"), False).otherwise(redact(F.col("raw")) != F.col("raw"))
    return done.select("doc_id", "line_no", F.sha2("raw", 256).alias("raw_sha256"), F.sha2("value", 256).alias("value_sha256"), (F.col("raw") != F.col("before")).alias("redacted"), again.alias("changed_again"))


_TEMPLATE = "trim(regexp_replace(raw, '[ \\t\\r\\n\\x0b\\x0c]+', ' ', 'g'))"
for _p in ln.MASKS[:-1]:
    _TEMPLATE = f"""regexp_replace({_TEMPLATE}, '{_p.replace("'", "''")}', '<*>', 'g')"""
# without lookbehind, numbers after a word and a hyphen are joined to a mark that is a word, and the mark goes at the end
_TEMPLATE = f"regexp_replace({_TEMPLATE}, '(\\w-)(\\d+)\\b', '\\1_kept_\\2', 'g')"
_TEMPLATE = f"replace(regexp_replace({_TEMPLATE}, '\\b\\d+\\b', '<*>', 'g'), '_kept_', '')"
TEMPLATE_SQL = f"regexp_replace({_TEMPLATE}, '(?:<\\*>){{2,}}', '<*>', 'g')"
TEMPLATES = f"WITH {_LINES}, tpl AS (SELECT *, {TEMPLATE_SQL} AS template FROM lines)"


def templates(spark: SparkSession, sf: str) -> DataFrame:
    return doc_lines(spark, sf).withColumn("template", ln.template(F.col("raw")))


@query(TEMPLATES + " SELECT doc_id, line_no, template FROM tpl")
def mine_template(spark: SparkSession, sf: str) -> DataFrame:
    return templates(spark, sf).select("doc_id", "line_no", "template")


@query(TEMPLATES + " SELECT DISTINCT template, 'taught:' || left(sha256(template), 12) AS template_id, (length(template) - length(replace(template, '<*>', ''))) // 3 AS operands FROM tpl")
def template_id(spark: SparkSession, sf: str) -> DataFrame:
    operands = ((F.char_length("template") - F.char_length(F.replace(F.col("template"), F.lit("<*>"), F.lit("")))) / 3).cast("int")
    return templates(spark, sf).select("template").distinct().select("template", ln.template_id(F.col("template")).alias("template_id"), operands.alias("operands"))


_ESCAPED = r"regexp_replace(template, '([\\.\[\](){}^$|?+*])', '\\\1', 'g')"


@query(TEMPLATES + f" SELECT DISTINCT sha256(template) AS template_sha256, sha256('^' || replace(replace({_ESCAPED}, '<\\*>', '{ln.OPERAND.replace(chr(39), chr(39) * 2)}'), ' ', '\\s+') || '$') AS pattern_sha256 FROM tpl")
def template_to_regex(spark: SparkSession, sf: str) -> DataFrame:
    distinct = templates(spark, sf).select("template").distinct()
    return distinct.select(F.sha2("template", 256).alias("template_sha256"), F.sha2(ln.template_regex(F.col("template")), 256).alias("pattern_sha256"))


@query(TEMPLATES + " SELECT doc_id, template, count(*) AS size, min(line_no) AS first_line FROM tpl GROUP BY 1, 2")
def template_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return templates(spark, sf).groupBy("doc_id", "template").agg(F.count("*").alias("size"), F.min("line_no").alias("first_line"))


@query(TEMPLATES + ", q AS (SELECT template, count(*) AS occurrences, count(DISTINCT doc_id) AS devices, min(raw) AS example FROM tpl GROUP BY 1) SELECT * FROM q ORDER BY occurrences DESC, template LIMIT 200")
def training_queue(spark: SparkSession, sf: str) -> DataFrame:
    grouped = templates(spark, sf).groupBy("template").agg(F.count("*").alias("occurrences"), F.count_distinct("doc_id").alias("devices"), F.min("raw").alias("example"))
    return grouped.orderBy(F.desc("occurrences"), "template").limit(200)


@query(TEMPLATES + ", s AS (SELECT template, doc_id, line_no, raw, row_number() OVER (PARTITION BY template ORDER BY doc_id, line_no) AS r FROM tpl) SELECT template, array_to_string(list(raw ORDER BY r), chr(10)) AS samples FROM s WHERE r <= 5 GROUP BY 1")
def cluster_samples(spark: SparkSession, sf: str) -> DataFrame:
    # the filter on row_number lets Spark keep five rows of a template in each task before the shuffle
    five = templates(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("template").orderBy("doc_id", "line_no"))).filter("r <= 5")
    listed = five.groupBy("template").agg(F.array_sort(F.collect_list(F.struct("r", "raw"))).alias("s"))
    return listed.select("template", F.array_join(F.transform("s", lambda x: x["raw"]), "\n").alias("samples"))


@query(f"WITH {_LINES} SELECT regexp_extract(stripped, '^(\\S+( \\S+)?)', 1) AS command, count(*) AS n FROM sig GROUP BY 1 ORDER BY n DESC, command LIMIT 10")
def residue_by_command(spark: SparkSession, sf: str) -> DataFrame:
    counted = ln.significant(doc_lines(spark, sf)).groupBy(F.regexp_extract("stripped", r"^(\S+( \S+)?)", 1).alias("command")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "command").limit(10)


@query(f"WITH {_LINES}, c AS (SELECT doc_id FROM lines GROUP BY 1 HAVING count(*) >= 3) SELECT DISTINCT stripped AS line FROM sig SEMI JOIN c USING (doc_id)")
def corpus_line_collect(spark: SparkSession, sf: str) -> DataFrame:
    rows = doc_lines(spark, sf)
    # line 3 exists exactly where a document has three lines or more
    enough = rows.filter("line_no = 3").select("doc_id").distinct()
    return ln.significant(rows).join(enough, "doc_id", "left_semi").select(F.col("stripped").alias("line")).distinct()


_S = "<redacted:secret>"


@query(f"""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'enable secret 5 {_S}' WHEN 1 THEN 'username ' || c_mktsegment || ' privilege 15 password 7 {_S}'
WHEN 2 THEN 'snmp-server community ' || CASE WHEN c_custkey % 16 < 8 THEN 'public' ELSE '{_S}' END || ' RO' WHEN 3 THEN ' neighbor 10.0.0.2 password 7 {_S} up' WHEN 4 THEN 'set password ENC {_S}'
WHEN 5 THEN 'description ' || c_name WHEN 6 THEN ' key ' || c_custkey ELSE 'radius-server host h auth-port 1812 key {_S}' END AS line FROM customer""")
def redact_credentials(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    community = F.when(k % 16 < 8, "public").otherwise(name)
    forms = [
        F.concat(F.lit("enable secret 5 "), name), F.concat(F.lit("username "), "c_mktsegment", F.lit(" privilege 15 password 7 "), name), F.concat(F.lit("snmp-server community "), community, F.lit(" RO")),
        F.concat(F.lit(" neighbor 10.0.0.2 password 7 "), name, F.lit(" up")), F.concat(F.lit("set password ENC "), name), F.concat(F.lit("description "), name), F.concat(F.lit(" key "), k.cast("string")),
        F.concat(F.lit("radius-server host h auth-port 1812 key "), name),
    ]
    lines = table(spark, sf, "customer").select(k, F.element_at(F.array(*forms), (k % 8 + 1).cast("int")).alias("line"))
    return redact_columns(lines, ["line"], CREDENTIALS)
