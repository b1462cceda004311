"""Facts by device, replaced as a whole when a device delivers again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerlake.session import kept

HEAD, BUCKET = "__head", "__bucket"


class DeviceTable:
    """A table with one delivery of each device: its newest.

    Rows lie in buckets by a hash of the device. A delivery rewrites the buckets of its devices and no others, by dynamic partition overwrite: new
    files are written beside the old ones, which go when all are there, so a lost executor or a failed job leaves the table as it was. Each device also
    has a head row, so one that delivers no facts any more keeps its place and its bucket. An older delivery, or the same again, changes
    nothing. One writer at a time; readers that began before a replacement may have to start anew.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, device: str, version: str, buckets: int = 64):
        """schema is that of a delivery: device, version (which orders a device's deliveries) and the columns of its facts."""
        self.spark, self.path, self.device, self.version, self.buckets = spark, path, device, version, buckets
        self.facts = [f.name for f in schema if f.name not in (device, version)]
        self.stored = StructType([*schema.fields, *[StructField(n, IntegerType()) for n in (HEAD, BUCKET)]])

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.stored).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.stored)

    def replace(self, heads: DataFrame, facts: DataFrame) -> None:
        """Takes a delivery: heads(device, version) of the devices and facts with the columns of the schema. Rows without a device are left out."""
        by = [self.device, self.version]
        bucket = F.pmod(F.xxhash64(self.device), F.lit(self.buckets)).cast("int").alias(BUCKET)
        newest = heads.filter(F.col(self.device).isNotNull()).groupBy(self.device).agg(F.max(self.version).alias(self.version))
        # heads alone tell which devices change; where both have the same version the stored rows stay
        has = self.devices().select(self.device, F.col(self.version).alias("__has"), F.lit(True).alias("__there"))
        later = F.col(self.version).isNotNull() & (F.col("__has").isNull() | (F.col(self.version) > F.col("__has")))
        newer = kept(newest.join(has, self.device, "left").filter(F.col("__there").isNull() | later).select(*by, bucket), "newer")
        touched = [r[0] for r in newer.select(BUCKET).distinct().collect()]  # as many as there are buckets at most
        if not touched:
            return
        own = facts.join(newer.select(*by), by, "left_semi").select(*by, *self.facts, F.lit(0).alias(HEAD), bucket)
        new = own.unionByName(newer.select(*by, F.lit(1).alias(HEAD), BUCKET), allowMissingColumns=True)
        stay = self._rows().filter(F.col(BUCKET).isin(touched)).join(newer.select(self.device), self.device, "left_anti")
        rows = stay.unionByName(new).select(*self.stored.names)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def read(self) -> DataFrame:
        """The facts of all devices."""
        return self._rows().filter(F.col(HEAD) == 0).drop(HEAD, BUCKET)

    def devices(self) -> DataFrame:
        """(device, version) of all devices, those without facts too."""
        return self._rows().filter(F.col(HEAD) == 1).select(self.device, self.version)
