"""Streams over files that arrive: ingestion, replacement, running posture, and state that ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> list[int]:
    """Runs handle on every micro-batch of what has arrived, then ends. Returns how many rows of state there were after each."""
    q = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return [sum(op.numRowsTotal for op in p.stateOperators) for p in q.recentProgress]


def drained(stream: DataFrame, mode: str, path: str, checkpoint: str) -> DataFrame:
    """The rows that a stream gives in the given output mode, each with the batch that gave it."""

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    run_available(stream, keep, checkpoint, mode)
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return stream.sparkSession.read.schema(schema).parquet(path)


def arriving(spark: SparkSession, table: DataFrame, folder: str, files: int) -> DataFrame:
    """A stream of the table's rows, dealt into files that arrive a few at a time."""
    table.repartition(files).write.parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, files // 2)).parquet(folder)


def arriving_in_order(table: DataFrame, at: str, folder: str, slices: int, again: int = 0) -> DataFrame:
    """A stream of the table's rows in the order of a time column, one slice of time a batch; each row comes again so many slices later, if any."""
    spark = table.sparkSession
    low, high = table.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    step = ((high or 0) - (low or 0)) // slices + 1
    number = F.floor((F.unix_micros(at) - F.lit(low or 0)) / step)
    for n in range(slices + again):  # files are read in the order in which they were written
        own = table.filter(number == n)
        late = table.filter(number == n - again) if again else None
        (own.unionByName(late) if late is not None else own).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)
