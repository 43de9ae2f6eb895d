"""What a query leaves on disk while it runs follows its input: no shuffle files of finished steps, no keys that can't meet a class."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkripple.operators import masks, selection
from sparkripple.operators.iterate import SWEEP, kept, written
from sparkripple.plans import corpus

SF = "/root/testdata/sf0.01"


def shuffled(spark) -> int:
    """Bytes of shuffle files on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if "shuffle_" in f.getName())


def settled(spark, size) -> int:
    """The size once no files of finished queries go any more."""
    last = None
    while (now := size(spark)) != last:
        last = now
        spark._jvm.System.gc()
        time.sleep(2)
    return now


def held(spark) -> int:
    """Bytes of shuffle files and of what is kept."""
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return shuffled(spark) + sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


@pytest.mark.parametrize("keep", [kept, written])
def test_no_shuffle_files_of_what_is_kept(spark, keep):
    before = settled(spark, shuffled)
    rows = spark.range(100_000).repartition(4, F.rand(1)).withColumn("text", F.sha2(F.col("id").cast("string"), 256))
    out = keep(rows.repartition(3, "id"))
    deadline = time.monotonic() + 20
    while shuffled(spark) > before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert shuffled(spark) <= before
    assert out.exceptAll(rows).isEmpty() and out.count() == 100_000
    assert spark.conf.get(SWEEP) == "false"


def test_written_rows_keep_types_and_nulls(spark):
    rows = spark.createDataFrame([(1, None, ["a"], True), (2, "x", None, None)], "id long, t string, a array<string>, b boolean")
    assert sorted(map(tuple, written(rows).collect())) == [(1, None, ["a"], True), (2, "x", None, None)]
    assert written(rows).schema == rows.schema
    assert written(rows.limit(0)).count() == 0


def test_keys_of_other_packages_go(spark):
    wanted = spark.createDataFrame([("a.b.C",), ("Top",), ("a.b.D",)], "fqn string")
    keys = spark.createDataFrame([(k,) for k in ("a", "a.b", "a.b.C", "a.b.C.In", "a.b.X", "Top", "b.C", None)], "key string")
    assert {r["key"] for r in selection.within_packages(wanted, keys)[0].collect()} == {"a", "Top", "a.b.C", "a.b.X"}
    assert selection.within_packages(wanted, keys, most=1)[0].count() == 8


@pytest.mark.parametrize("most", [0, 64])
def test_tiers_without_keys_are_those_with_keys(spark, most, monkeypatch):
    uses = selection.wildcard_uses
    monkeypatch.setattr(selection, "wildcard_uses", lambda *rows: uses(*rows, most))
    d = "/root/testdata/sf0.001"
    imports, refs, dotted = (f(spark, d) for f in (corpus.imports, corpus.simple_refs, corpus.dotted_refs))
    changed = corpus.changed(spark, d)
    expected = selection.usage(changed, selection.usage_keys(imports, refs, dotted))
    twice = [r.unionByName(r) for r in (changed, imports, refs, dotted)]
    assert sorted(map(tuple, selection.usage_in_tiers(*twice).collect())) == sorted(map(tuple, expected.collect()))


def test_few_diffs_are_not_dealt_out(spark):
    rows = spark.range(1000).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("diff_id"), F.col("id").cast("string").alias("fqn"))
    numbers = masks.numbered(rows)
    back = masks.of_diffs(masks.masked(rows, numbers, "fqn"), numbers, "fqn")
    assert back.exceptAll(rows).isEmpty() and back.count() == 1000
    assert back._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0


@pytest.mark.parametrize("name, most", [("usage_all", 4), ("impact_flagship", 2), ("explain_trace", 3)])
def test_disk_of_a_query(spark, name, most):
    read = sum(Path(SF, f"{t}.parquet").stat().st_size for t in ("customer", "lineitem", "orders", "part", "supplier"))
    kept(spark.range(1))
    before = settled(spark, held)
    rows = corpus.queries()[name](spark, SF)
    rows.write.format("noop").mode("overwrite").save()
    assert held(spark) - before < most * read
