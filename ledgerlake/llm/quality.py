"""Operator 3: quality classification by co-training of a text view and a page-metadata view.

The text view sees which of the telling words the whole text has; the metadata view sees language, source, length, line, word and
repetition statistics and the shares of some symbols. A labelled document is good, poor (quality 0) or toxic, and each view has a
multinomial logistic regression of these kinds, so that toxic words need not make up for good prose. They are fitted on labelled
documents, then for ROUNDS rounds each view labels the documents of an unlabelled pool of whose kind it is confident, and the other
view is fitted anew with them. A part of the labelled documents is held out from all of that; on it each view's odds of poor or
toxic against good are calibrated. The calibrated odds of both views, multiplied, score every document with the
probability that it is good; one below KEEP is rejected.

README.md has the shares of held-out documents kept and rejected at KEEP.

Only the fit is bounded: at most about MAX_LABELLED labelled rows, and half as many of the pool that may get labels, both chosen by a hash
of the doc_id, with their features in a table in the shared folder. Scoring reads every whole text.

Null texts count as empty, null languages and sources as "". Rows with a null doc_id are scored and never fitted on. Repeated
rows get equal scores. Labels that are null, or that name no document, are not used; of several for one document the worst
counts. Where good documents, or both other kinds, are missing among the labelled ones to fit on, every document has score 1 and is
kept; a kind that is missing alone is never found. Extra columns are not read, and clashing names do no harm.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import documents, written

MAX_LABELLED = 20_000
ROUNDS = 2
CONFIDENT = 0.97
#: More likely good than not.
KEEP = 0.5
#: Words of the text view: those whose shares of documents differ most between a kind and the good ones, by chi-square.
VOCABULARY = 10_000
#: A word counts if it stands in so many labelled documents of the fit: an insult may be rare.
WORD_DOCS = 3
CATEGORY_DIMENSIONS = 64
ITERATIONS = 40
#: L1 weight: few words decide, the rest count nothing.
PENALTY = 5e-3
#: Rows of the fit for each task; its steps are short, and more tasks would only wait for one another.
TASK_ROWS = 5_000
_SYMBOLS = "!?#*$%&|@=<>{}"
VIEWS = {"text_view": "text_score", "meta_view": "meta_score"}
_PARTS = 1 << 40


def _share(symbol: str) -> Column:
    return (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit(symbol), F.lit("")))) / (F.octet_length("text") + 1)


def features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) with words and the meta_view vector, their inputs dropped."""
    base = docs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("text", "lang", "source")})
    chars, lines = F.char_length("text"), F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    blanks = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    numbers = {
        "m_chars": F.log1p(chars), "m_lines": F.log1p(lines), "m_line": F.log1p(chars / (lines + 1)), "m_word": chars / (blanks + lines + 1),
        "m_bytes": F.octet_length("text") / (chars + 1),
    } | {f"m_{i}": _share(s) * 10 for i, s in enumerate(_SYMBOLS)}
    # letters only: case, digits and symbols are the other view's
    wide = base.withColumns(numbers).withColumn("words", F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), ""))
    n, next_ = F.size("words"), F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))
    repeated = F.size(F.filter(F.zip_with("words", next_, lambda a, b: a == b), lambda same: same))
    counts = {"m_words": F.log1p(n), "m_distinct": F.log1p(F.size(F.array_distinct("words"))), "m_repeated": repeated / (n + 1)}
    wide = wide.withColumns(counts)
    numbers |= counts
    wide = FeatureHasher(inputCols=["lang", "source"], outputCol="categories", numFeatures=CATEGORY_DIMENSIONS).transform(wide)
    wide = VectorAssembler(inputCols=[*numbers, "categories"], outputCol="meta_view").transform(wide)
    # a word that every document has: no vocabulary is empty
    return wide.withColumn("words", F.array_append("words", F.lit("*"))).drop("text", "lang", "source", "categories", *numbers)


def _sampled(ids: DataFrame, rows: int, seed: str) -> DataFrame:
    """At most about so many rows of ids(doc_id, ...), by a hash of the id: the same ones wherever they lie."""
    n = ids.count()
    if n <= rows:
        return ids
    return ids.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_PARTS)) < int(_PARTS * rows / n))


def fit_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, held, words, meta_view): the bounded rows; label is 0 good, 1 poor, 2 toxic, and null in the pool."""
    kind = F.when(F.coalesce("toxic", F.lit(0)) == 1, 2.0).when(F.col("quality") == 1, 0.0).otherwise(1.0)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max(kind).alias("label"))
    chosen = written(_sampled(known, MAX_LABELLED, "labelled"), "fit-labels")
    narrow = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", "lang", "source")
    ids = narrow.select("doc_id")
    pool = _sampled(ids, MAX_LABELLED // 2, "pool").join(known.select("doc_id"), "doc_id", "left_anti").distinct()
    pool = written(pool.withColumn("label", F.lit(None).cast("double")), "fit-pool")
    # both sides are bounded by the two parameters above
    picked = narrow.join(F.broadcast(chosen.unionByName(pool)), "doc_id").dropDuplicates(["doc_id"])
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(10)) < 3
    return written(features(picked).select("label", (held & F.col("label").isNotNull()).alias("held"), "words", "meta_view"), "fit-features")


def _logistic(view: str) -> LogisticRegression:
    return LogisticRegression(featuresCol=view, labelCol="label", family="multinomial", maxIter=ITERATIONS, regParam=PENALTY, elasticNetParam=1.0, rawPredictionCol="raw", probabilityCol="probability", predictionCol="prediction")


def _score(model, rows: DataFrame, name: str) -> DataFrame:
    """rows with the model's log-odds of each other kind against good, an array."""
    raw = vector_to_array("raw")
    return model.transform(rows).withColumn(name, F.transform(raw, lambda x: x - raw[0])).drop("raw", "probability", "prediction")


def _sure(model, pool: DataFrame) -> DataFrame:
    """The rows of pool of whose kind the model is confident, with that label."""
    p = vector_to_array("probability")
    known = model.transform(pool).withColumn("label", F.when(F.array_max(p) >= CONFIDENT, F.col("prediction")))
    return known.filter("label IS NOT NULL").drop("raw", "probability", "prediction")


class CoTrained:
    """Both views' models, their calibrations (slope, offset) and prior odds by kind; empty where nothing could be fitted."""

    def __init__(self, vocabulary=None, models=None, calibrations=None, priors=None):
        self.vocabulary, self.models, self.calibrations, self.priors = vocabulary, models, calibrations, priors

    def score(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, text, lang, source, ...) with text_score, meta_score (log-odds of good) and score (its probability)."""
        rows = features(docs)
        if self.models is None:
            return rows.drop("words", "meta_view").withColumns({"text_score": F.lit(0.0), "meta_score": F.lit(0.0), "score": F.lit(1.0)})
        scored = self.vocabulary.transform(rows).drop("words")
        odds = {kind: F.lit(-math.log(prior)) for kind, prior in self.priors.items()}
        for view, name in VIEWS.items():
            scored = _score(self.models[view], scored, "odds").drop(view)
            own = {kind: F.col("odds")[kind] * slope + offset for kind, (slope, offset) in self.calibrations[view].items()}
            # views that are independent given the kind: their calibrated odds multiply, the prior counts once
            scored = scored.withColumns({f"{name}_{kind}": value for kind, value in own.items()}).drop("odds")
            odds = {kind: value + F.col(f"{name}_{kind}") for kind, value in odds.items()}
        all_of = lambda values: reduce(lambda a, b: a + b, [F.exp(v) for v in values])
        out = scored.withColumn("score", 1 / (1 + all_of(odds.values())))
        for name in VIEWS.values():
            out = out.withColumn(name, -F.log(all_of([F.col(f"{name}_{kind}") for kind in odds])))
        return out.drop(*[f"{name}_{kind}" for name in VIEWS.values() for kind in odds])


def _calibrated(model, held: DataFrame, kind: int) -> tuple[float, float]:
    """Slope and offset that turn a view's log-odds of a kind into calibrated ones, from documents it was not fitted on."""
    rows = _score(model, held.filter(F.col("label").isin(0, kind)), "odds").select(F.col("odds")[kind].alias("x"), (F.col("label") == kind).cast("double").alias("label"))
    fitted = LogisticRegression(featuresCol="scores", labelCol="label", maxIter=ITERATIONS, regParam=1e-3).fit(VectorAssembler(inputCols=["x"], outputCol="scores").transform(rows))
    return max(0.0, float(fitted.coefficients[0])), float(fitted.intercept)


def _words(train: DataFrame, count: dict[int, int]) -> list[str]:
    """At most VOCABULARY words of train(label, words), whose kinds have so many rows; 0 is good."""
    each = train.select("label", F.explode(F.array_distinct("words")).alias("word"))
    seen = each.groupBy("word").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == k).alias(f"n{k}") for k in count])
    a, na = F.col("n0").cast("double"), float(count[0])
    found = []
    for k in count:
        if k:
            b, nb = F.col(f"n{k}").cast("double"), float(count[k])
            without = (na + nb) - a - b
            found.append(F.coalesce((a * (nb - b) - b * (na - a)) ** 2 * (na + nb) / F.nullif((a + b) * without * F.lit(na * nb), F.lit(0.0)), F.lit(0.0)))
    best = seen.filter(F.col("n") >= min(WORD_DOCS, sum(count.values()))).select("word", F.greatest(*found, F.lit(0.0)).alias("chi"))
    return [r.word for r in best.orderBy(F.desc("chi"), "word").limit(VOCABULARY).collect()] or ["*"]


def co_train(table: DataFrame) -> CoTrained:
    """Fits both views in rounds on fit_table()'s rows."""
    count = {(r.label, r.held): r.n for r in table.groupBy("label", "held").agg(F.count("*").alias("n")).collect()}
    kinds = [k for k in (1, 2) if count.get((k, False))]
    if not count.get((0, False)) or not kinds:
        return CoTrained()
    n = sum(count.values())
    told = _words(table.filter("label IS NOT NULL AND NOT held"), {k: count[k, False] for k in (0, *kinds)})
    vocabulary = CountVectorizerModel.from_vocabulary(told, "words", "text_view", binary=True)
    tasks = max(1, min(n // TASK_ROWS, table.sparkSession.sparkContext.defaultParallelism))
    table = written(vocabulary.transform(table).drop("words"), "fit-views").coalesce(tasks)
    train = table.filter("label IS NOT NULL AND NOT held")
    pool = table.filter("label IS NULL").drop("label")
    views = {"text_view": train, "meta_view": train}
    models = {}
    for r in range(ROUNDS + 1):
        models = {view: _logistic(view).fit(rows) for view, rows in views.items()}
        if r < ROUNDS:
            views = {other: train.unionByName(_sure(models[view], pool)) for view, other in (("text_view", "meta_view"), ("meta_view", "text_view"))}
    # kinds that the held-out rows lack are calibrated on the others
    aside = all(count.get((k, True)) for k in (0, *kinds))
    held = table.filter("held") if aside else train
    priors = {k: count[k, aside] / count[0, aside] for k in kinds}
    return CoTrained(vocabulary, models, {view: {k: _calibrated(model, held, k) for k in kinds} for view, model in models.items()}, priors)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of every row of docs."""
    columns = docs.select("doc_id", "text", "lang", "source")
    model = co_train(fit_table(columns, labels))
    return model.score(columns).withColumn("keep", F.col("score") >= KEEP)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' columns."""
    model = co_train(fit_table(docs, labels))
    kept = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("__row", "text", "lang", "source")
    return model.score(kept).filter(F.col("score") >= KEEP).select("__row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
