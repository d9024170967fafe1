"""Session set-up and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "10g") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("citeloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for durable intermediates.

    Only a local[...] session, where driver and executors share one disk, may fall back to a
    scratch folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read many: a Parquet table in the shared folder.

    Used where several branches of one job read the same expensive intermediate. Unlike a cache it
    survives lost executors and later branches read only the columns they need. Zstandard, because digests and
    hashes written as text hardly shrink without entropy coding.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, object]]:
    """A stored table with aggregates that were observed while it was written, so that no further job counts its rows."""
    observation = Observation(f"{name}-{uuid.uuid4().hex}")
    columns = [column.alias(metric) for metric, column in metrics.items()]
    table = materialize(df.observe(observation, *columns), name)
    return table, observation.get


def small_batches(spark: SparkSession, rows: int = 200) -> None:
    """Rows per Arrow batch: long texts would make batches of the default 10,000 rows too large for a task."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
