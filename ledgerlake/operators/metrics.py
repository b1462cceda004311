"""Folds of whole groups, and scores of predictions in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def folds(rows: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, n, fold): whole groups, largest first, go to k folds forwards and backwards in turn.

    The folds are balanced without a driver loop. Places are counted inside each size and then over the sizes, which are few.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    by_size = sizes.groupBy("n").agg(F.count("*").alias("k"))
    above = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("at", F.row_number().over(Window.partitionBy("n").orderBy(group)) - 1).join(by_size.select("n", above.alias("above")), "n")
    p = (F.col("above") + F.col("at")) % (2 * k)
    return placed.select(group, "n", F.when(p < k, p).otherwise(2 * k - 1 - p).alias("fold"))


def by_fold(predictions: DataFrame, fold: str, label: str, guess: str) -> DataFrame:
    """(fold, n, accuracy, macro_f1, weighted_f1) of each fold, and their means in a row whose fold is null.

    Classes are those seen as label or guess in the fold; a class without a hit has f1 0.
    """
    counted = predictions.groupBy(F.col(fold).alias("fold"), F.col(label).alias("y"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    right, n, none = F.col("y") == F.col("g"), F.col("n"), F.lit(0).cast("long")
    own = F.struct(F.col("y").alias("class"), F.when(right, n).otherwise(none).alias("tp"), none.alias("fp"), F.when(right, none).otherwise(n).alias("fn"))
    other = F.struct(F.col("g").alias("class"), none.alias("tp"), n.alias("fp"), none.alias("fn"))
    each = counted.select("fold", F.explode(F.when(right, F.array(own)).otherwise(F.array(own, other))).alias("r")).select("fold", "r.*")
    per = each.groupBy("fold", "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    f1, support = 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), F.col("tp") + F.col("fn")
    scores = per.groupBy("fold").agg(
        F.sum(support).alias("n"), (F.sum("tp") / F.sum(support)).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * support) / F.sum(support)).alias("weighted_f1")
    )
    mean = scores.agg(F.lit(None).cast(scores.schema["fold"].dataType).alias("fold"), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])
    return scores.unionByName(mean)
