"""Helpers that the operators of this subpackage share.

Python stages get Arrow batches that Spark bounds both in rows and in bytes
(spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set), so long texts
come in small batches and no setting of the session is changed here.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Upper end of hash63().
TOP = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    The folder is the one the cluster names in spark.checkpoint.dir. Where none is
    set, a session on this machine alone, as in tests, takes a temporary folder; a
    cluster gets an error, as its executors would not share such a folder.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="checkpoint-")


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more, on whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hash63(*of: str | Column) -> Column:
    """A hash spread evenly over 0 to TOP."""
    return F.xxhash64(*of).bitwiseAND(F.lit(TOP))


def share_bound(share: float) -> int:
    """hash63() is at most this with the given chance; shares down to 1e-18 keep one."""
    return TOP if share >= 1 else int(share * TOP)


def carried(of: str = "doc_id") -> Column:
    """The 64-bit id as text, for the way through pandas, which would make a column that holds a null one of doubles."""
    return F.col(of).cast("long").cast("string").alias(of)


def restored(df: DataFrame, of: str = "doc_id") -> DataFrame:
    """df with a carried() id as a number again."""
    return df.withColumn(of, F.col(of).cast("long"))


def own_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores before it, so that no column of df has the name, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def fold(doc_id: str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
