"""Stored relations: a refresh is a rebuild that rewrites little, and keys that stay in their buckets."""

import os
import uuid
from pathlib import Path

from pyspark.sql import functions as F
from sparkripple.operators import selection
from sparkripple.plans import engine, index, stored
from sparkripple.plans.config import Config

RELATIONS = ("tests", "sources", "imports", "simple_refs", "dotted_refs", "decls", "edges")


def src(name, body, pkg="a", mtime=1):
    text = f"package {pkg};\n{body}"
    return f"src/main/java/{pkg}/{name}.java", text, mtime, len(text)


def test_file(name, body):
    return f"src/test/java/a/{name}.java", f"package a;\nimport b.*;\n{body}", 1, len(body)


test_file.__test__ = False
BASE = [src(f"C{i}", f"import b.*; class C{i} extends C{i - 1} {{ C{i - 2} x; Late y; }}") for i in range(2, 40)]
BASE += [src("C0", "class C0 { }"), src("C1", "class C1 { C0 c; }"), src("Bad", "class Bad { C1 c; ( }"), src("Late", "class Late { }", "b"), test_file("C1Test", "class C1Test { C1 c; a.C0.Inner d; }"), test_file("LateTest", "class LateTest { Late l; }")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string, mtime long, size long")


def rows_of(own, name):
    df = own[name].drop("ord")
    return sorted(map(repr, df.select(*sorted(df.columns)).distinct().collect()))


def stamps(folder):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(folder).rglob("bucket=*/*.parquet")}


def test_refresh_is_a_rebuild(spark, tmp_path):
    folder, config = f"{tmp_path}/index", Config()
    assert stored.refresh(spark, frame(spark, BASE), config, folder).count() == len(BASE)
    assert {r["path"] for r in stored.refresh(spark, frame(spark, BASE), config, folder).collect()} == {"src/main/java/a/Bad.java"}
    before = stamps(folder)
    # One file changes, one comes and takes over a name that others use, one goes.
    now = [r for r in BASE if not r[0].endswith(("/C5.java", "/C39.java"))]
    now += [src("C5", "class C5 extends C1 { }", mtime=2)]
    dirty = {r["path"].rpartition("/")[2] for r in stored.refresh(spark, frame(spark, now), config, folder).collect()}
    assert dirty == {"C5.java", "C39.java", "Bad.java"}
    untouched = [p for p, t in stamps(folder).items() if before.get(p) == t]
    assert len(untouched) > 0.7 * len(before)
    late = [*now, src("Late", "class Late { C0 c; }")]
    stored.refresh(spark, frame(spark, late), config, folder)
    full, own = index.build(frame(spark, late), config), stored.stored_index(spark, folder)
    for name in RELATIONS:
        assert rows_of(own, name) == rows_of(full, name), name
    assert rows_of(own, "edges") and own["edges"].filter("dependency = 'a.Late'").count() > 30 and own["edges"].filter("dependency = 'b.Late'").isEmpty()
    changed = spark.createDataFrame([("d", "src/main/java/a/Late.java")], "diff_id string, path string")
    a, b = (engine.analyse(changed, x, config) for x in (own, full))
    assert sorted(map(tuple, a[1].collect())) == sorted(map(tuple, b[1].collect())) and a[0].first()["n_failed"] == b[0].first()["n_failed"] == 1


def test_stored_keys_are_not_shuffled(spark, tmp_path):
    config, name = Config(), f"keys_{uuid.uuid4().hex}"
    own = dict(index.build(frame(spark, BASE), config))
    try:
        own["keys"] = stored.store_keys(own, name, 4)
        wanted = spark.range(50).select(F.concat(F.lit("a.C"), "id").alias("fqn"), F.lit(0).alias("word"))
        joined = own["keys"].select(F.col("fqn").alias("test"), F.col("key").alias("fqn")).hint("merge").join(wanted, "fqn")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        scan = plan.index("FileScan parquet")
        assert "Exchange" not in plan[:scan] and "SelectedBucketsCount" in plan[scan:] and "SortMergeJoin" in plan
        changed = spark.createDataFrame([("d", "src/main/java/a/C0.java"), ("e", "src/main/java/b/Late.java")], "diff_id string, path string")
        classes = engine.changed_classes(engine.classify(changed, config), config)
        plain = {k: v for k, v in own.items() if k != "keys"}
        assert sorted(map(tuple, engine.discover(classes, own, config).collect())) == sorted(map(tuple, engine.discover(classes, plain, config).collect()))
        assert selection.usage_keys(own["imports"], own["simple_refs"], own["dotted_refs"]).select("fqn", "key").distinct().count() == own["keys"].count()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
