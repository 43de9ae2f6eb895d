"""Cutting the lineage of bounded iterations, and dealing rows out to tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting under which the shuffle files of a query go when it ends, and not when the driver's memory is collected next.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a session on this machine alone, as in tests, may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="checkpoint-")


def kept_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, the shared one where none is set yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is made and run here leaves no shuffle files, as its result lies in a folder."""
    before = spark.conf.get(SWEEP)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def kept(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder."""
    kept_folder(df.sparkSession)
    with swept(df.sparkSession):
        # The setting holds for frames that are made under it.
        return df.select("*").checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table of compressed columns in the checkpoint folder: for large relations, which take a fraction of the disk of kept rows, but come back in parts of Spark's choice."""
    spark = df.sparkSession
    folder = f"{kept_folder(spark)}/table-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out by a hash of by, to four tasks a core or as many as a shuffle has, if these are more.

    A small file of many rows is one task's, and Spark joins small parts again where their number is
    its own choice; the number given here stays.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
