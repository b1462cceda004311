"""The audit model bound to the order tables: devices are orders, facts are attributes of orders and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.operators.conditions import value
from ledgerlake.session import table

#: The total order of an order's lines; (l_orderkey, l_linenumber) alone repeats.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

LINES_SQL = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line_no FROM lineitem)"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with line_no, 1.. within its order."""
    by = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return table(spark, sf, "lineitem").withColumn("line_no", F.row_number().over(by))


def devices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("device"), F.col("o_custkey").alias("customer"))


def line_facts(rows: DataFrame, *more: str) -> DataFrame:
    """The attributes of order lines as facts, with more columns of rows."""
    return rows.select(
        F.col("l_orderkey").alias("device"),
        *more,
        F.col("l_linenumber").alias("line_no"),
        F.explode(F.array(
            F.struct(F.lit("line.discount").alias("path"), value(n=F.col("l_discount")).alias("value")),
            F.struct(F.lit("line.quantity").alias("path"), value(n=F.col("l_quantity")).alias("value")),
            F.struct(F.lit("line.returnflag").alias("path"), value(s=F.col("l_returnflag")).alias("value")),
        )).alias("f"),
    ).select("device", *more, "f.path", "f.value", "line_no", F.lit(True).alias("present"))


def order_facts(rows: DataFrame, *more: str) -> DataFrame:
    """The attributes of orders as facts, which have no line, with more columns of rows."""
    return rows.select(
        F.col("o_orderkey").alias("device"),
        *more,
        F.lit(None).cast("int").alias("line_no"),
        F.explode(F.array(
            F.struct(F.lit("order.status").alias("path"), value(s=F.col("o_orderstatus")).alias("value")),
            F.struct(F.lit("order.priority").alias("path"), value(s=F.col("o_orderpriority")).alias("value")),
            F.struct(F.lit("order.total").alias("path"), value(n=F.col("o_totalprice")).alias("value")),
        )).alias("f"),
    ).select("device", *more, "f.path", "f.value", "line_no", F.lit(True).alias("present"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """(device, path, value, line_no, present): one row for each attribute of a line, and order-level ones, which have no line."""
    return line_facts(table(spark, sf, "lineitem")).unionByName(order_facts(table(spark, sf, "orders")))
