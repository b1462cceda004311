"""Session and table helpers shared by the audit stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local sessions that name no shared one, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder, as a URI, below the one in spark.checkpoint.dir or that of setCheckpointDir(); on a local master a temporary one where neither is set.

    On a cluster without either this is a ValueError: executors on other hosts could not see a local folder.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _LOCAL.get(context.applicationId)
    if not root:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-checkpoint-")
    root = f"file://{root}" if root.startswith("/") else root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def kept(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """df as a table in the shared folder: what it was made of is neither planned nor run again, and a lost executor costs a reread."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where the input comes in fewer tasks, for work that costs far more than to move them; a large table stays as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
