"""Queries of blocks: depth, runs and containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.operators import blocks as b
from ledgerlake.plans.lines import doc_lines
from ledgerlake.registry import query
from ledgerlake.session import table


@query()
def block_extent_indent(spark: SparkSession, sf: str) -> DataFrame:
    # prose is not indented: a line's depth is taken from how it begins, so that blocks nest
    depth = F.when(F.col("stripped").rlike("^[A-Z]{2}"), 0).when(F.col("stripped").rlike("^(The|A|An|In|Le|La|Der|Die)\\b"), 1).otherwise(2)
    return b.indent_blocks(doc_lines(spark, sf).withColumn("indent", depth), "doc_id", r"(The|A|An|In|Le|La|Der|Die)\b")


_TAGS = """WITH t AS (SELECT page_id, regexp_extract_all(html, '</?ul>') AS tags FROM pages),
e AS (SELECT page_id, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS pos FROM t)
"""


@query(_TAGS + "SELECT page_id, pos, tag, (sum(CASE WHEN tag = '<ul>' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos))::BIGINT AS depth FROM e")
def block_extent_delimited(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("</?ul>"), F.lit(0))).alias("at", "tag"))
    rows = tags.select("page_id", (F.col("at") + 1).alias("pos"), "tag")
    opens = (F.col("tag") == "<ul>").cast("int")
    return b.running_depth(rows, ["page_id"], ["pos"], opens, 1 - opens)


@query("""WITH t AS (SELECT page_id, string_split(html, '>') AS p FROM pages), e AS (SELECT page_id, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS pos FROM t)
SELECT page_id, pos, (sum(length(part) - length(replace(part, '{', '')) - length(part) + length(replace(part, '}', ''))) OVER (PARTITION BY page_id ORDER BY pos))::BIGINT AS depth FROM e""")
def block_extent_brace(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", ">", -1)).alias("at", "part"))
    rows = b.running_depth(parts, ["page_id"], ["at"], b.occurrences(F.col("part"), "{"), b.occurrences(F.col("part"), "}"))
    return rows.select("page_id", (F.col("at") + 1).alias("pos"), "depth")


_RUNS = """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c),
g AS (SELECT user_id, run::BIGINT AS run, min(event_type) AS kind, min(event_id) AS start, max(event_id) AS stop, count(*) AS n FROM r GROUP BY 1, 2)
"""


def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.runs(table(spark, sf, "events"), ["user_id"], ["event_id"], "event_type")
    return rows.groupBy("user_id", "run").agg(F.min("event_type").alias("kind"), F.min("event_id").alias("start"), F.max("event_id").alias("stop"), F.count("*").alias("n"))


@query(_RUNS + "SELECT user_id, run, kind, start, stop, n FROM g")
def block_extent_run(spark: SparkSession, sf: str) -> DataFrame:
    return event_runs(spark, sf)


@query(_RUNS + "SELECT user_id, run, kind AS value, start AS line_start, stop AS line_end FROM g")
def anchor_facts(spark: SparkSession, sf: str) -> DataFrame:
    return event_runs(spark, sf).select("user_id", "run", F.col("kind").alias("value"), F.col("start").alias("line_start"), F.col("stop").alias("line_end"))


#: Intervals of a user: from each purchase to the next but two; they overlap.
_BLOCKS = """WITH p AS (SELECT user_id, event_id AS start, lead(event_id, 3, event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS stop FROM events WHERE event_type = 'purchase')
"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("event_id")
    bought = table(spark, sf, "events").filter("event_type = 'purchase'")
    return bought.select("user_id", F.col("event_id").alias("start"), F.lead("event_id", 3).over(by).alias("end")).select("user_id", F.col("start").alias("block"), "start", F.coalesce("end", "start").alias("end"))


@query(_BLOCKS + """SELECT user_id, event_id, block FROM (SELECT e.user_id, e.event_id, p.start AS block,
  row_number() OVER (PARTITION BY e.user_id, e.event_id ORDER BY p.stop - p.start, p.start) AS r
  FROM events e JOIN p ON e.user_id = p.user_id AND e.event_id BETWEEN p.start AND p.stop) WHERE r = 1""")
def enclosing_block(spark: SparkSession, sf: str) -> DataFrame:
    return b.tightest(table(spark, sf, "events").select("user_id", "event_id"), intervals(spark, sf), "user_id", "event_id", ["event_id"])


@query("""SELECT o_orderkey AS block, f.path, false AS present FROM orders CROSS JOIN (VALUES ('F'), ('O')) f(path)
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = f.path)""")
def child_default_facts(spark: SparkSession, sf: str) -> DataFrame:
    # a block's own children tell what it lacks: one aggregation, no join
    seen = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("block")).agg(F.collect_set("l_linestatus").alias("seen"))
    missing = F.explode(F.array_except(F.array(F.lit("F"), F.lit("O")), F.col("seen")))
    return seen.select("block", missing.alias("path"), F.lit(False).alias("present"))


@query("SELECT l_orderkey AS block, count(*) AS line_end FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def block_anchor_predicate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("block")).agg(F.count("*").alias("line_end")).filter("line_end > 1")


@query(_BLOCKS + """, q AS (SELECT * FROM p WHERE stop > start), m AS (SELECT e.user_id, e.event_id, q.start AS block,
  row_number() OVER (PARTITION BY e.user_id, e.event_id ORDER BY q.stop - q.start, q.start) AS r
  FROM events e JOIN q ON e.user_id = q.user_id AND e.event_id BETWEEN q.start AND q.stop WHERE e.event_type <> 'purchase')
SELECT user_id, block, count(*) AS members FROM m WHERE r = 1 GROUP BY 1, 2""")
def block_membership(spark: SparkSession, sf: str) -> DataFrame:
    anchors = intervals(spark, sf).filter("end > start")
    members = table(spark, sf, "events").filter("event_type <> 'purchase'").select("user_id", "event_id")
    return b.tightest(members, anchors, "user_id", "event_id", ["event_id"]).groupBy("user_id", "block").agg(F.count("*").alias("members"))


#: Kinds of elements whose extents are blocks; a line is what stands before each '>' of a page.
KINDS = ("html", "head", "body", "nav", "ul", "li", "article", "footer")

_PIECES = """WITH t AS (SELECT page_id, string_split(coalesce(html, ''), '>') AS p FROM pages),
e AS (SELECT page_id, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS pos, len(p) AS last FROM t),
"""
_SPANS = (
    _PIECES
    + f"""k AS (SELECT * FROM e, (VALUES {", ".join(f"('{k}')" for k in KINDS)}) g(kind)),
n AS (SELECT *, regexp_matches(part, '<' || kind || '( |$)')::INT - regexp_matches(part, '</' || kind || '$')::INT AS net FROM k),
d AS (SELECT *, sum(net) OVER (PARTITION BY page_id, kind ORDER BY pos) AS depth FROM n),
s AS (SELECT o.page_id, o.kind, o.pos AS start, coalesce(min(c.pos), any_value(o.last)) AS stop, any_value(o.depth)::BIGINT AS depth FROM d o LEFT JOIN d c
  ON o.page_id = c.page_id AND o.kind = c.kind AND c.pos > o.pos AND c.net < 0 AND c.depth < o.depth WHERE o.net = 1 GROUP BY 1, 2, 3)
"""
)


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, last, pos, part)"""
    split = F.split(F.coalesce("html", F.lit("")), ">", -1)
    return numbered(table(spark, sf, "pages"), split).select("page_id", "last", (F.col("at") + 1).alias("pos"), "part")


def numbered(pages: DataFrame, parts: Column) -> DataFrame:
    """(page_id, last, at, part). The parts are a column of their own first: whatever stands beside posexplode is worked out for every row that comes out of it."""
    cut = pages.select("page_id", parts.alias("parts")).select("page_id", "parts", F.size("parts").alias("last"))
    return cut.select("page_id", "last", F.posexplode("parts").alias("at", "part"))


def element_spans(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, kind, start, end, depth) of the elements of KINDS."""
    # a plain search tells most patterns apart that cannot match
    met = lambda part, regex: F.when(F.contains("part", F.lit(part)), F.col("part").rlike(regex).cast("int")).otherwise(0)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (met(f"<{k}", f"<{k}( |$)") - met(f"</{k}", f"</{k}$")).alias("net")) for k in KINDS])
    marks = pieces(spark, sf).filter(F.contains("part", F.lit("<"))).select("page_id", "last", "pos", F.inline(F.filter(kinds, lambda x: x["net"] != 0)))
    return b.spans(marks, ["page_id", "kind"], "pos", F.col("net"), F.col("net") > 0, F.col("last"))


@query(_SPANS + "SELECT page_id, kind, start, stop, depth FROM s")
def block_spans_delimited(spark: SparkSession, sf: str) -> DataFrame:
    return element_spans(spark, sf).select("page_id", "kind", "start", F.col("end").alias("stop"), "depth")


#: Lines of a page as code: cut at ';' and brackets of any kind count as braces; lines that begin with a comment sign count nothing.
_CODE = r"""WITH t AS (SELECT page_id, string_split(regexp_replace(coalesce(html, ''), '[(<]', '{', 'g').replace(')', '}').replace('>', '}'), ' ') AS p FROM pages),
e AS (SELECT page_id, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS pos, len(p) AS last FROM t),
n AS (SELECT *, CASE WHEN starts_with(part, '!') THEN 0 ELSE len(part) - len(replace(part, '{', '')) - len(part) + len(replace(part, '}', '')) END AS net FROM e),
d AS (SELECT *, sum(net) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM n),
"""


@query(_CODE + """o AS (SELECT * FROM d WHERE contains(part, '{') AND NOT starts_with(part, '!')),
c AS (SELECT o.page_id, o.pos, min(d.pos) AS stop FROM o JOIN d ON o.page_id = d.page_id AND d.pos > o.pos AND d.net < 0 AND d.depth <= o.depth - o.net WHERE o.net > 0 GROUP BY 1, 2)
SELECT o.page_id, o.pos AS start, CASE WHEN o.net <= 0 THEN o.pos ELSE coalesce(stop, o.last) END AS stop, (o.depth - o.net + 1)::BIGINT AS depth FROM o LEFT JOIN c USING (page_id, pos)""")
def block_spans_brace(spark: SparkSession, sf: str) -> DataFrame:
    braced = F.replace(F.replace(F.regexp_replace(F.coalesce("html", F.lit("")), "[(<]", "{"), F.lit(")"), F.lit("}")), F.lit(">"), F.lit("}"))
    split = F.split(braced, " ", -1)
    rows = numbered(table(spark, sf, "pages"), split).filter(F.contains("part", F.lit("{")) | F.contains("part", F.lit("}")))
    net = F.when(F.col("part").startswith("!"), 0).otherwise(b.occurrences(F.col("part"), "{") - b.occurrences(F.col("part"), "}"))
    marks = rows.select("page_id", "last", (F.col("at") + 1).alias("pos"), net.alias("net"), (F.contains("part", F.lit("{")) & ~F.col("part").startswith("!")).alias("anchor"))
    found = b.spans(marks.filter("net <> 0 OR anchor"), ["page_id"], "pos", F.col("net"), F.col("anchor"), F.col("last"))
    return found.select("page_id", "start", F.col("end").alias("stop"), "depth")


#: Patterns of the blocks, of the pack, and taught ones.
CHILDREN = {
    "head": [("head.title", ".*<title$"), ("head.any", "<.*")],
    "nav": [("nav.link", '<a href="/[a-z].*')],
    "li": [("li.link", '<a href="/[A-Z].*'), ("li.text", r"\w+</a$")],
    "article": [("article.heading", "<h1$"), ("article.paragraph", ".*<p$")],
}
PACK_PATTERNS = [("close", ".*</(a|p|b)$"), ("break", ".*<br$")]
TAUGHT = [("taught:ad", '<div class="ad".*'), ("taught:any-p", ".*<p$"), ("taught:comment", "<!--.*")]

_IN_ORDER = [(k, i, n, p) for k, ps in CHILDREN.items() for i, (n, p) in enumerate(ps)]
_SCOPED = (
    _SPANS
    + f""", r AS (SELECT page_id, pos, trim(part, ' ' || chr(9)) AS part FROM e WHERE trim(part, ' ' || chr(9)) <> '' AND NOT EXISTS (SELECT 1 FROM s WHERE s.page_id = e.page_id AND s.start = e.pos)),
i AS (SELECT r.page_id, r.pos, r.part, s.kind, s.start, row_number() OVER (PARTITION BY r.page_id, r.pos ORDER BY s.stop - s.start, s.start, s.kind) AS near FROM r JOIN s ON s.page_id = r.page_id AND r.pos BETWEEN s.start AND s.stop),
pt AS (SELECT * FROM (VALUES {", ".join("('" + k + "', " + str(i) + ", '" + n + "', '^(?:" + p + ")')" for k, i, n, p in _IN_ORDER)}) g(scope, i, name, regex)),
others AS (SELECT * FROM (VALUES {", ".join(f"('{scope}', {place + i}, '{n}', '^(?:{p})')" for scope, place, ps in (("pack", 100000, PACK_PATTERNS), ("taught", 200000, TAUGHT)) for i, (n, p) in enumerate(ps))}) g(scope, place, name, regex)),
hits AS (SELECT page_id, pos, near * 100 + pt.i AS place, scope, name FROM i JOIN pt ON pt.scope = i.kind AND regexp_matches(i.part, regex)
  UNION ALL SELECT page_id, pos, place, scope, name FROM r JOIN others ON regexp_matches(r.part, regex)),
m AS (SELECT page_id, pos, arg_min(scope, place) AS scope, arg_min(name, place) AS pattern FROM hits GROUP BY 1, 2)
"""
)


def scoped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = F.btrim("part", F.lit(" \t"))
    lines = pieces(spark, sf).select("page_id", F.col("pos").alias("line_no"), part.alias("stripped")).filter("stripped <> ''")
    found = element_spans(spark, sf).select("page_id", F.col("start").alias("block"), "start", "end", "kind")
    return b.extract(lines, found, "page_id", len(KINDS), CHILDREN, PACK_PATTERNS, TAUGHT)


@query(_SCOPED + "SELECT page_id, pos, scope, pattern FROM m")
def block_scoped_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(spark, sf)[0].select("page_id", F.col("line_no").alias("pos"), "scope", "pattern")


@query(_SCOPED + """SELECT r.page_id, r.pos, r.part, i.kind AS block_path, trim(a.part, ' ' || chr(9)) AS block_line FROM r LEFT JOIN m USING (page_id, pos)
LEFT JOIN i ON i.page_id = r.page_id AND i.pos = r.pos AND i.near = 1 LEFT JOIN e a ON a.page_id = r.page_id AND a.pos = i.start WHERE m.pattern IS NULL""")
def residue_with_block(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(spark, sf)[1].select("page_id", F.col("line_no").alias("pos"), F.col("stripped").alias("part"), "block_path", "block_line")
