"""Work on small tables of many rows is dealt out to all cores, and no task's memory follows its table."""

from pyspark.sql import functions as F

from sparkripple.operators import dispatch, selection
from sparkripple.operators.iterate import spread
from sparkripple.plans import corpus, index
from sparkripple.plans.config import Config

SF = "/root/testdata/sf0.001"


def test_spread_deals_one_task_out(spark):
    rows = spread(spark.range(1000).coalesce(1), "id")
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in sizes) == 1000


def test_made_up_sources_are_parsed_by_all_cores(spark):
    # part is one file of one row group, so one task read and parsed them all.
    assert corpus.classes(spark, SF).rdd.getNumPartitions() == 1
    assert corpus.syntax_metadata(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_an_index_parses_by_all_cores(spark):
    files = corpus.source_files(spark, SF).coalesce(1)
    built = index.build(files, Config())
    assert built["test_metadata"].rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_kotlin_alone_is_parsed_for_kotlin(spark):
    every, kotlin = corpus.syntax_metadata(spark, SF), corpus.syntax_metadata(spark, SF, "kt")
    assert {r["lang"] for r in kotlin.select("lang").distinct().collect()} == {"kt"}
    assert corpus.syntax_corpus.shown(every.filter("lang = 'kt'")).exceptAll(corpus.syntax_corpus.shown(kotlin)).isEmpty()
    assert every.filter("lang = 'kt'").count() == kotlin.count()


def test_classes_are_not_broadcast_for_their_file_size(spark):
    # part is small as a file, so each join of its classes had sent them whole through the driver.
    for rows in (corpus.tests(spark, SF), corpus.naming_match(spark, SF)):
        rows.collect()
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_no_key_of_a_path_is_grouped_but_a_module(spark):
    files = spark.createDataFrame([("a/b/c/X.java",), ("a/b/Y.java",), ("z/Z.java",), ("a/b/c/X.java",), ("Top.java",)], "path string").withColumn("n", F.monotonically_increasing_id())
    modules = spark.createDataFrame([("a", ":a"), ("a/b", ":a:b"), ("a/b/c/X.java", ":no")], "dir string, gradle_path string")
    out = dispatch.owning_module(files, modules)
    assert sorted((r["path"], r["gradle_path"]) for r in out.collect()) == [("Top.java", ""), ("a/b/Y.java", ":a:b"), ("a/b/c/X.java", ":a:b"), ("a/b/c/X.java", ":a:b"), ("z/Z.java", "")]
    assert out.columns == ["path", "n", "gradle_path"]
    assert "max_by" not in out._jdf.queryExecution().executedPlan().toString()


def test_wildcard_uses_are_the_keys_that_meet(spark):
    imports = spark.createDataFrame([("t1", "a", False, True), ("t1", "b.C", False, True), ("t2", "a", False, True), ("t2", "b", True, True), ("t3", "a.X", False, False), ("t1", "a", False, True)], "fqn string, name string, is_static boolean, is_asterisk boolean")
    refs = spark.createDataFrame([("t1", "p", "X"), ("t1", "p", "In"), ("t2", "p", "X"), ("t2", "p", "Y"), ("t3", "p", "X"), ("t2", "p", "Z")], "fqn string, pkg string, name string")
    wanted = spark.createDataFrame([("a.X", 0, 1), ("b.X", 0, 2), ("c.X", 0, 4), ("b.C.In", 1, 1), ("a.Y", 0, 8), ("Z", 0, 16), ("a.X", 1, 32)], "fqn string, word long, bits long")
    keys = selection.package_wildcards(imports, refs).withColumnRenamed("fqn", "test")
    expected = {(r["test"], r["word"], r["bits"]) for r in keys.join(wanted.withColumnRenamed("fqn", "key"), "key").collect()}
    assert expected == {("t1", 0, 1), ("t1", 1, 32), ("t1", 1, 1), ("t2", 0, 1), ("t2", 1, 32), ("t2", 0, 8)}
    for most in (0, 1, 2, 64):
        assert {tuple(r) for r in selection.wildcard_uses(wanted, imports, refs, most).select("fqn", "word", "bits").collect()} == expected


def test_import_keys_are_those_of_the_three_tiers(spark):
    imports = spark.createDataFrame([("t", name, static, star) for name in ("a.b.C", "C", "a.b.C.m") for static in (False, True) for star in (False, True)], "fqn string, name string, is_static boolean, is_asterisk boolean")
    for each in imports.collect():
        one = imports.filter((F.col("name") == each["name"]) & (F.col("is_static") == each["is_static"]) & (F.col("is_asterisk") == each["is_asterisk"]))
        tiers = selection.direct_imports(one).unionByName(selection.inner_imports(one)).unionByName(selection.class_wildcards(one))
        assert set(map(tuple, selection.import_keys(one).collect())) == set(map(tuple, tiers.collect()))
