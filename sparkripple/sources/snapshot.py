"""The metadata snapshot: parquet tables of one version each, the newest complete one counts.

All goes through Spark's readers and writers, so a snapshot may lie on any store
that they reach. A version appears under its number by one rename; readers see
whole versions.
"""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkripple.plans.config import Config

#: The form of a version's tables; it rises where metadata means another thing.
VERSION = 3
#: Versions that stay.
KEEP = 3


def config_hash(config: Config) -> str:
    """Of the settings that decide what is indexed."""
    parts = [*(",".join(sorted(x)) for x in (config.source_dirs, config.test_dirs, config.out_of_scope_source_dirs, config.out_of_scope_test_dirs)), str(config.kotlin_enabled).lower()]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def hash_of(source_dirs: Column, test_dirs: Column, out_of_scope_source_dirs: Column, out_of_scope_test_dirs: Column, kotlin_enabled: Column) -> Column:
    """config_hash() of settings in columns, four arrays and a boolean, as of many projects in rows."""
    joined = [F.array_join(F.array_sort(x), ",") for x in (source_dirs, test_dirs, out_of_scope_source_dirs, out_of_scope_test_dirs)]
    return F.sha2(F.concat_ws("\n", *joined, F.lower(kotlin_enabled.cast("string"))).cast("binary"), 256)


def drifted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Directories that are new, gone, or of another time or number of children."""
    a, b = old.alias("a"), new.alias("b")
    same = (F.col("a.mtime") == F.col("b.mtime")) & (F.col("a.child_count") == F.col("b.child_count"))
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").filter(~F.coalesce(same, F.lit(False))).select(F.coalesce("a.path", "b.path").alias("path"), F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "removed").otherwise("changed").alias("drift"))


def reusable(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Stored metadata of files whose time and size are the same; failed parses are never reused."""
    return stored.filter("parse_ok").join(files.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")


def to_parse(stored: DataFrame, files: DataFrame) -> DataFrame:
    return files.join(stored.filter("parse_ok").select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions there are, in order; none where there is no folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(int(n.removeprefix("v-")) for n in names if n.startswith("v-") and n[2:].isdigit())


def version_path(folder: str, number: int) -> str:
    return f"{folder}/v-{number:012d}"


def write(metadata: DataFrame, walk: DataFrame, config: Config, folder: str, keep: int = KEEP) -> int:
    """Write a new version of the metadata and of the walk that found its files, and return its number; of older ones the last keep - 1 stay.

    A version is written aside and then renamed to the next free number, which fails
    where another writer took that number first; so it appears whole and once,
    on stores whose renames are atomic, and clocks play no part.
    """
    spark = metadata.sparkSession
    aside = f"{folder}/.new-{uuid.uuid4().hex}"
    metadata.write.parquet(f"{aside}/metadata")
    walk.write.parquet(f"{aside}/walk")
    spark.createDataFrame([(VERSION, config_hash(config))], "version int, config string").coalesce(1).write.parquet(f"{aside}/settings")
    number = max(versions(spark, folder), default=0) + 1
    while not renamed(spark, aside, version_path(folder, number)):
        number += 1
    for old in versions(spark, folder):
        if old <= number - keep:
            clear(spark, version_path(folder, old))
    return number


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a folder to a name that is free; False where it is taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.getFileSystem(conf).getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(a, b, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or a.getFileSystem(conf).exists(b):
            return False
        raise
    return True


def load(spark: SparkSession, config: Config, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(metadata, walk) of the newest version, or None if absent, unreadable, of another form or other settings."""
    numbers = versions(spark, folder)
    if not numbers:
        return None
    path = version_path(folder, numbers[-1])
    try:
        said = spark.read.parquet(f"{path}/settings").first()
        if said is None or (said["version"], said["config"]) != (VERSION, config_hash(config)):
            return None
        return spark.read.parquet(f"{path}/metadata"), spark.read.parquet(f"{path}/walk")
    except AnalysisException:
        return None


def clear(spark: SparkSession, folder: str) -> None:
    """Delete the folder, on whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
