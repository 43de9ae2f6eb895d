"""Decisions for a stream of changed files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkripple.plans import engine
from sparkripple.plans.config import Config


#: Folders that the changed files are dealt to by their diff; a batch reads those of its diffs only.
BUCKETS = 256


def decide_each_batch(changed_files: DataFrame, index: Mapping[str, DataFrame], config: Config, out: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Analyse (diff_id, path) as it comes and append decisions and selected tests under out.

    A diff may come in several micro-batches: each batch's files are kept, by bucket of
    their diff, and a diff that it touches is decided anew from all its files so far;
    latest() gives the standing decisions. What a batch reads again are the buckets of
    its diffs, whatever else has come before. A batch writes under its own number, so
    that one that is run again replaces its rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.select("diff_id", "path", F.pmod(F.xxhash64("diff_id"), F.lit(buckets)).cast("int").alias("bucket"))
        own.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/changed/batch={number}")
        mine = spark.read.schema("diff_id string, path string, bucket int").parquet(f"{out}/changed/batch={number}")
        hit = [r["bucket"] for r in mine.select("bucket").distinct().collect()]  # at most so many numbers
        # Of later batches there are none yet, unless a folder of another run is used again.
        so_far = spark.read.schema("diff_id string, path string, batch long, bucket int").parquet(f"{out}/changed").filter(F.col("bucket").isin(hit) & (F.col("batch") <= number))
        touched = mine.select("diff_id").distinct()
        decisions, selected = engine.analyse(so_far.join(touched, "diff_id", "left_semi").select("diff_id", "path"), index, config)
        decisions.write.mode("overwrite").parquet(f"{out}/decisions/batch={number}")
        selected.write.mode("overwrite").parquet(f"{out}/selected/batch={number}")

    return changed_files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The decisions and selected tests that stand: those of each diff's last batch."""
    decisions = spark.read.parquet(f"{out}/decisions")
    last = F.row_number().over(Window.partitionBy("diff_id").orderBy(F.col("batch").desc()))
    standing = decisions.withColumn("n", last).filter("n = 1").drop("n")
    selected = spark.read.parquet(f"{out}/selected").join(standing.select("diff_id", "batch"), ["diff_id", "batch"], "left_semi")
    return standing, selected
