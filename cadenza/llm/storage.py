"""Lineage cuts: tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; where it names none, one of our own, but only if all executors are on this machine."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        path = getattr(spark, "_cadenza_shared_dir", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="cadenza-")
            spark._cadenza_shared_dir = path
    return f"{path.rstrip('/')}/cadenza-{spark.sparkContext.applicationId}"


def made(spark: SparkSession) -> list[str]:
    """Paths of the tables that :func:`cut` wrote in this session and nobody deleted, oldest first."""
    if not hasattr(spark, "_cadenza_tables"):
        spark._cadenza_tables = []
    return spark._cadenza_tables


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables made after the first ``since``, save the last ``keep``: nothing may read them any more."""
    tables = made(spark)
    for path in tables[since : len(tables) - keep]:
        _delete(spark, path)
    del tables[since : len(tables) - keep]


def release(spark: SparkSession) -> None:
    """Delete every table that :func:`cut` wrote in this application."""
    _delete(spark, shared_dir(spark))
    made(spark).clear()


def parallelism(spark: SparkSession) -> int:
    """The number of partitions that a shuffle takes by the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
