"""Operator 2: secret scans, false positives removed by a random forest.

Candidates are the pieces of a text's words, cut at quotes, colons, equals signs, brackets and all other signs outside the
alphabets in which keys and tokens are written, of LONG_CHARS or more characters, or of MIN_CHARS or more if they hold a digit or an
inner capital or stand by a name. The piece before a cut, such as a name in token=value, is a neighbour of the next. The forest
sees a candidate's length, the number of changes between letters, digits and others, how usual its character transitions are, how
far the corpus's own words cover it, its path (source and language) and the words next to it. Transitions and coverage are
counted over the words of all documents. It is fitted on labelled findings, at most about MAX_FINDINGS of them chosen by a
hash, and judges every candidate.

Labelled findings are a table (doc_id, word, part, label), with text_hash where a doc_id may have several texts. Without one, findings
are labelled by what the forest is not shown: the sign between a name and its value, the share of digits, and the fixed forms in
which some services issue keys. Long values with digits behind a name such as token and a sign, values in such a form and the body of a
private key are findings; addresses, plain words, plain numbers and network addresses are false positives. All else, such as
values without a name, is left for the forest.

Null and empty texts have no candidates. Repeated rows have the same candidates each. A null doc_id stays null;
its candidates are judged and not fitted on. Rows that share a doc_id are told apart by their texts; a finding with both labels
is a finding. Where the labelled findings lack one of the two kinds, every candidate has the share of findings as its
probability. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import documents, written

MIN_CHARS = 8
#: From here on any value is a candidate; shorter ones hold a digit or an inner capital, or stand by a name.
LONG_CHARS = 16
MAX_FINDINGS = 10_000
TREES = 20
DEPTH = 6
NEIGHBOUR_DIMENSIONS = 32
#: Columns by which rules label findings and which the forest does not see.
HIDDEN = ("f_digits", "f_name", "f_sign")
#: Times that a word must stand in the corpus to count for coverage.
MIN_WORD_COUNT = 5
_PARTS = 1 << 40
_EDGES = "\"'`!#$%&*,;:()[]{}<>.?|"
_VALUE = r"^[A-Za-z0-9+/_=.@~-]+$"
#: A run of a value's signs with the quotes and the sign of a name that follow it.
_PIECE = r"[A-Za-z0-9+/_.@~-]+[\"'`]*[:=]*"
_IN_ADDRESS = r"(://[^\s/@:\"']*):([^\s/@\"']+)@"
#: Forms in which well-known services issue keys; fixed values.
_ISSUED = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^AIza[0-9A-Za-z_-]{35}$|^eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\."
_NAMES = r"(?i)(token|secret|passw|api.?key|access.?key|private.?key|credential|auth)"


def words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", "lang", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("words"))


def _classes(value: Column) -> Column:
    """The value with letters, digits and others each written as one sign."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Za-z]", "a"), "[0-9]", "0"), "[^a0]", "-")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, source, lang, word, part, value, before2, before1, after1); word counts a text's words from 0, part a word's pieces."""
    placed = words(docs).select("doc_id", "text_hash", "source", "lang", "words", F.posexplode("words").alias("word", "raw")).filter(F.octet_length("raw") >= MIN_CHARS)
    near = lambda i: F.coalesce(F.get("words", F.col("word") + i), F.lit(""))
    # the place of a password in an address is as good as a name
    plain = F.when(F.contains("raw", F.lit("://")), F.regexp_replace("raw", _IN_ADDRESS, "$1 password=$2 ")).otherwise(F.col("raw"))
    pieces = F.regexp_extract_all(plain, F.lit(_PIECE), 0)
    around = placed.select(
        "doc_id", "text_hash", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "word",
        near(-2).alias("b2"), near(-1).alias("b1"), near(1).alias("a1"), pieces.alias("pieces"),
    )
    each = around.select("*", F.posexplode("pieces").alias("part", "piece")).filter(F.octet_length("piece") >= MIN_CHARS)
    row = F.concat(F.array("b2", "b1"), F.col("pieces"), F.array("a1"))
    at = lambda i: F.lower(F.get(row, F.col("part") + 2 + i))
    named = each.select(
        "doc_id", "text_hash", "source", "lang", "word", "part", F.btrim("piece", F.lit(_EDGES)).alias("value"),
        at(-2).alias("before2"), at(-1).alias("before1"), at(1).alias("after1"),
    )
    size = F.octet_length("value")
    odd = F.col("value").rlike("[0-9]|[a-z][A-Z]") | F.col("before1").rlike(_NAMES) | F.col("before2").rlike(_NAMES)
    return named.filter((size >= MIN_CHARS) & ((size >= LONG_CHARS) | odd) & F.col("value").rlike(_VALUE))


def corpus_grams(docs: DataFrame) -> DataFrame:
    """(gram, n) of the three-character runs of the corpus's lower-case ASCII words: 26**3 rows at most."""
    plain = words(docs).select(F.explode("words").alias("w")).filter(F.octet_length("w").between(3, 24))
    counted = plain.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_WORD_COUNT)
    letters = counted.select(F.lower(F.btrim("w", F.lit(_EDGES))).alias("w"), "n").filter(F.col("w").rlike("^[a-z]{3,}$"))
    runs = letters.select("n", F.explode(F.sequence(F.lit(1), F.char_length("w") - 2)).alias("at"), "w")
    return runs.groupBy(F.substr("w", F.col("at"), F.lit(3)).alias("gram")).agg(F.sum("n").alias("n"))


def with_features(found: DataFrame, grams: DataFrame) -> DataFrame:
    """found with the forest's vector. grams is broadcast: it has 26**3 rows at most."""
    row = found.withColumn("row", F.monotonically_increasing_id())
    row = written(row, "secret-candidates")
    low = F.lower("value")
    runs = row.select("row", F.explode(F.sequence(F.lit(1), F.char_length("value") - 2)).alias("at"), low.alias("v"))
    seen = runs.select("row", F.substr("v", F.col("at"), F.lit(3)).alias("gram")).join(F.broadcast(grams), "gram", "left")
    usual = seen.groupBy("row").agg(F.avg(F.col("n").isNotNull().cast("double")).alias("coverage"), F.avg(F.log1p(F.coalesce("n", F.lit(0)))).alias("transition"))
    kinds = _classes(F.col("value"))
    size = F.char_length("value").cast("double")
    changes = F.char_length(F.regexp_replace(F.regexp_replace(kinds, "a+", "a"), "0+", "0")).cast("double")
    count = lambda pattern: F.regexp_count("value", F.lit(pattern)).cast("double") / size
    numbers = {
        "f_length": size, "f_changes": changes / size, "f_digits": count("[0-9]"), "f_upper": count("[A-Z]"),
        "f_other": count("[^0-9A-Za-z]"), "f_distinct": F.size(F.array_distinct(F.split(low, ""))) / size,
        "f_name": F.greatest(F.col("before1").rlike(_NAMES), F.col("before2").rlike(_NAMES)).cast("double"),
        "f_sign": F.greatest(F.col("before1").rlike("[=:]$"), F.col("value").contains("=")).cast("double"),
    }
    wide = row.join(usual, "row").withColumns(numbers)
    wide = FeatureHasher(inputCols=["source", "lang", "before2", "before1", "after1"], outputCol="context", numFeatures=NEIGHBOUR_DIMENSIONS).transform(wide)
    wide = VectorAssembler(inputCols=[*[n for n in numbers if n not in HIDDEN], "coverage", "transition", "context"], outputCol="vector").transform(wide)
    return wide.drop("row", "context")


def rule_labels(features: DataFrame) -> DataFrame:
    """Labelled findings by rules that are sure: (doc_id, text_hash, word, part, label)."""
    value = F.col("value")
    named = (F.col("f_name") == 1) & (F.col("f_sign") == 1) & (F.col("f_digits") > 0.1) & (F.char_length("value") >= 20) & ~value.contains("@")
    body = F.col("before1").endswith("key-----") & (F.col("before2") == "private") & (F.char_length("value") >= 40)
    no = value.contains("@") | value.rlike("^[A-Za-z'-]+$") | value.rlike("^[0-9]+$") | value.rlike(r"^\d+(\.\d+){3}$")
    label = F.when(named | body | value.rlike(_ISSUED), 1.0).when(no, 0.0)
    return features.select("doc_id", "text_hash", "word", "part", label.alias("label")).filter("label IS NOT NULL AND doc_id IS NOT NULL")


def judge(features: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, word, value_sha256, length, probability, is_secret) of every candidate; findings have (doc_id, [text_hash,] word, part, label)."""
    key = [c for c in ("doc_id", "text_hash", "word", "part") if c in findings.columns]
    findings = written(findings.filter("doc_id IS NOT NULL").groupBy(*key).agg(F.max("label").alias("label")), "secret-labels")
    part = {r.label: r.n for r in findings.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if sum(part.values()) > MAX_FINDINGS:  # of the rarer kind as many as of the other
        draw = F.pmod(F.xxhash64(F.lit("finding"), *key), F.lit(_PARTS))
        share = {k: int(_PARTS * min(1.0, MAX_FINDINGS / 2 / v)) for k, v in part.items()}
        findings = findings.filter(draw < F.when(F.col("label") == 1, share.get(1.0, _PARTS)).otherwise(share.get(0.0, _PARTS)))
    # bounded by MAX_FINDINGS
    train = written(features.join(F.broadcast(findings), key).select("vector", "label"), "secret-findings")
    kinds = [r[0] for r in train.select("label").distinct().collect()]
    if len(kinds) == 2:
        forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=7, probabilityCol="p", rawPredictionCol="raw", predictionCol="y")
        judged = forest.fit(train).transform(features).withColumn("probability", vector_to_array("p")[1])
    else:
        judged = features.withColumn("probability", F.lit(kinds[0] if kinds else 0.0))
    return judged.select(
        "doc_id", F.col("word").cast("long"), F.sha2("value", 256).alias("value_sha256"), F.char_length("value").cast("long").alias("length"),
        F.round("probability", 6).alias("probability"), (F.col("probability") >= 0.5).alias("is_secret"),
    )


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Every candidate of docs(doc_id, text, source, lang), judged by a forest fitted on findings, or on rule-labelled ones."""
    grams = written(corpus_grams(docs), "secret-grams")
    features = written(with_features(candidates(docs), grams), "secret-features")
    return judge(features, rule_labels(features) if findings is None else findings)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir, "doc_id", "text", "source", "lang"))


QUERIES = {"op2_secrets": op2_secrets}
ORACLES: dict[str, str] = {}
