"""Queries over the driver's tables, each with SQL for the same rows.

The tables hold no source code. Corpus views derive made-up stand-ins from them:
classes from parts, tests from customers, references from their orders, changed
paths from documents, parts and customers. Every class is changed in one of four
diffs, and every operator runs over these whole views.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkripple.functions import paths, source_text
from sparkripple.operators import dispatch, selection
from sparkripple.operators.iterate import kept, shared_folder, spread, written
from sparkripple.plans import engine, report, stored, syntax_corpus
from sparkripple.plans import index as project_index
from sparkripple.plans.config import DEFAULTS, IGNORED, SITUATIONS, Config
from sparkripple.sources import snapshot

CONFIG = Config(source_dirs=("src/main/java", "src/main/kotlin"), out_of_scope_test_dirs=("api-test", "perf/**"), mode="CI")
SUFFIXES = list(CONFIG.test_suffixes)
DEPTH = 4

# --- views, as Spark expressions -------------------------------------------------------------------------------


SCHEMAS: dict[str, object] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is read from the files once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def classes(spark: SparkSession, d: str) -> DataFrame:
    pkg = F.concat(F.lit("com."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    out = read(spark, d, "part").select(F.col("p_partkey").alias("k"), pkg.alias("pkg"), F.concat(F.lit("Part"), F.col("p_partkey").cast("string")).alias("simple"))
    # The file's size, by which Spark would send all classes to the driver and every task, is a twentieth of what they become.
    return out.withColumn("fqn", F.concat_ws(".", "pkg", "simple")).hint("merge")


def changed(spark: SparkSession, d: str) -> DataFrame:
    return classes(spark, d).select(F.expr("concat('d', cast(k % 4 AS string))").alias("diff_id"), "fqn", "simple", "pkg")


def n_parts(spark: SparkSession, d: str) -> Column:
    return read(spark, d, "part").agg(F.count(F.lit(1))).scalar()


def tests(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").withColumn("k", F.col("c_custkey") % n_parts(spark, d))
    own = c.join(classes(spark, d).select("k", F.col("pkg").alias("class_pkg")), "k")
    suffix = F.element_at(F.lit([*SUFFIXES, "Spec"]), (F.col("c_custkey") % 5 + 1).cast("int"))
    pkg = F.when(F.col("c_custkey") % 3 == 0, F.col("class_pkg")).otherwise(F.concat(F.lit("com."), F.lower("c_mktsegment")))
    out = own.select("c_custkey", F.concat(F.lit("Part"), F.col("k").cast("string"), suffix).alias("simple"), pkg.alias("pkg")).withColumn("fqn", F.concat_ws(".", "pkg", "simple"))
    where = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("m"), (F.col("c_custkey") % 25).cast("string"), F.lit("/src/test/java/"))).otherwise(F.concat(F.lit("m"), (F.col("c_custkey") % 25).cast("string"), F.lit("/sub/src/it/java/")))
    return out.withColumn("path", F.concat(where, F.replace("fqn", F.lit("."), F.lit("/")), F.lit(".java")))


def references(spark: SparkSession, d: str) -> DataFrame:
    """(test, pkg, kind, target, target_pkg, target_simple, even), some rows more than once; what is made of them is distinct."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    line = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") % 6).alias("kind"), (F.col("l_quantity") % 2 == 0).alias("even"))
    t = tests(spark, d).select("c_custkey", F.col("fqn").alias("test"), "pkg")
    c = classes(spark, d).select(F.col("k").alias("l_partkey"), F.col("pkg").alias("target_pkg"))
    # Tests come last, so that their names are not dealt out by part and a test's references lie together.
    out = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, "l_partkey").join(t, F.col("o_custkey") == F.col("c_custkey"))
    return out.select("test", "pkg", "kind", "target_pkg", F.concat(F.lit("Part"), F.col("l_partkey").cast("string")).alias("target_simple"), "even").transform(with_target)


def with_target(refs: DataFrame) -> DataFrame:
    return refs.withColumn("target", F.concat_ws(".", "target_pkg", "target_simple"))


def written_references(spark: SparkSession, d: str) -> DataFrame:
    """references, written without the target, which is put together again as they are read."""
    return written(references(spark, d).drop("target")).transform(with_target)


def imports_of(r: DataFrame) -> DataFrame:
    """imports of references, some rows more than once."""
    r = r.filter("kind IN (0, 1, 2, 3) OR (kind = 5 AND even)")
    name = F.when(F.col("kind") == 0, F.col("target")).when(F.col("kind") == 1, F.concat("target", F.lit(".Inner"))).when((F.col("kind") == 2) & ~F.col("even"), F.concat("target", F.lit(".helper"))).when(F.col("kind") == 3, F.col("target_pkg")).otherwise(F.col("target"))
    star = (F.col("kind") == 3) | (F.col("kind") == 5) | (F.col("kind") == 2) & F.col("even")
    return r.select(F.col("test").alias("fqn"), name.alias("name"), (F.col("kind") == 2).alias("is_static"), star.alias("is_asterisk"))


def imports(spark: SparkSession, d: str, refs: DataFrame | None = None) -> DataFrame:
    return imports_of(refs or references(spark, d)).distinct().withColumn("ord", F.col("name"))


def simple_refs_of(r: DataFrame) -> DataFrame:
    """simple_refs of references, some rows more than once."""
    return r.filter("kind IN (0, 3) OR (kind = 5 AND NOT even)").select(F.col("test").alias("fqn"), "pkg", F.col("target_simple").alias("name"))


def simple_refs(spark: SparkSession, d: str, refs: DataFrame | None = None) -> DataFrame:
    return simple_refs_of(refs or references(spark, d)).distinct()


def dotted_refs_of(r: DataFrame) -> DataFrame:
    """dotted_refs of references, some rows more than once."""
    r = r.filter("kind = 4")
    return r.select(F.col("test").alias("fqn"), F.when(F.col("even"), F.col("target")).otherwise(F.concat("target", F.lit(".Nested"))).alias("name"))


def dotted_refs(spark: SparkSession, d: str, refs: DataFrame | None = None) -> DataFrame:
    return dotted_refs_of(refs or references(spark, d)).distinct()


def decls(spark: SparkSession, d: str) -> DataFrame:
    return classes(spark, d).filter("k > 0").select("fqn", F.expr("concat('Part', cast(k div 7 AS string))").alias("supertype"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("s_suppkey") * 20 % n_parts(spark, d)).cast("string")
    simple = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Part"), k, F.lit("Impl"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("DefaultPart"), k)).otherwise(F.concat(F.lit("Part"), k, F.lit("Other")))
    own = read(spark, d, "supplier").select(simple.alias("simple")).withColumn("fqn", F.concat(F.lit("com.impl."), F.col("simple"))).distinct()
    return own.unionByName(classes(spark, d).select("simple", "fqn"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(consumer, dependency): parts that follow each other in an order."""
    line = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a, b = line.alias("a"), line.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1)).filter("a.l_partkey <> b.l_partkey").select(F.col("a.l_partkey").alias("ca"), F.col("b.l_partkey").alias("cb"))
    # Dealt out once for both the distinct rows and the first join.
    pairs = pairs.repartition("ca").distinct()
    c = classes(spark, d).select("k", "fqn")
    return pairs.join(c.select(F.col("k").alias("ca"), F.col("fqn").alias("consumer")), "ca").join(c.select(F.col("k").alias("cb"), F.col("fqn").alias("dependency")), "cb").select("consumer", "dependency")


PATHS = """CASE doc_id % 11
  WHEN 0 THEN concat('docs/d', cast(doc_id AS {s}), '.md')
  WHEN 1 THEN concat('src/main/java/com/b', cast(doc_id % 7 AS {s}), '/Part', cast(doc_id AS {s}), '.java')
  WHEN 2 THEN concat('src/test/java/com/b', cast(doc_id % 7 AS {s}), '/Part', cast(doc_id AS {s}), 'Test.java')
  WHEN 3 THEN concat('api-test/com/x/Smoke', cast(doc_id AS {s}), '.java')
  WHEN 4 THEN concat('perf/sub/x/P', cast(doc_id AS {s}), '.java')
  WHEN 5 THEN concat('m', cast(doc_id AS {s}), '/src/main/java/module-info.java')
  WHEN 6 THEN concat('a/../src/main/java/X', cast(doc_id AS {s}), '.java')
  WHEN 7 THEN concat('app/src/main/kotlin/com/K', cast(doc_id AS {s}), '.kt')
  WHEN 8 THEN concat('src/main/resources/r', cast(doc_id AS {s}), '.yml')
  WHEN 9 THEN concat('notsrc/main/java/N', cast(doc_id AS {s}), '.java')
  ELSE concat('lib/generated/G', cast(doc_id AS {s}), '.java') END"""
DIFFS = """CASE WHEN doc_id % 2 = 0 THEN concat('k', cast(doc_id % 11 AS {s})) ELSE concat(coalesce(source, ''), '-', cast(floor((doc_id % 11) / 3) AS {i})) END"""


def changed_paths(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "source").selectExpr(DIFFS.format(s="string", i="string") + " AS diff_id", PATHS.format(s="string") + " AS path").distinct()


def classified(spark: SparkSession, d: str) -> DataFrame:
    return engine.classify(changed_paths(spark, d), CONFIG)


def modules(spark: SparkSession, d: str) -> DataFrame:
    """Module directories m<nation>, and m<nation>/sub for every other nation."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("n"))
    top = n.select(F.concat(F.lit("m"), "n").alias("dir"), F.concat(F.lit(":m"), "n").alias("gradle_path"))
    return top.union(n.filter("cast(n AS int) % 2 = 0").select(F.concat(F.lit("m"), "n", F.lit("/sub")), F.concat(F.lit(":m"), "n", F.lit(":sub"))))


def log_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\t"), F.chr(F.col("doc_id") % 32 + 1), F.lit("\u0085\r\n"), F.coalesce("lang", F.lit(""))).alias("text"))


def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per diff, with made-up numbers of selected tests and failures."""
    counts = engine.bucket_counts(classified(spark, d))
    return counts.withColumn("n_selected", F.when(F.col("n_prod") + F.col("n_test") > 0, F.col("n_files") % 3).otherwise(0)).withColumn("n_failed", F.when(F.col("n_files") % 5 == 0, 1).otherwise(0))


def routes(spark: SparkSession, d: str) -> DataFrame:
    t = tests(spark, d).select(F.concat(F.lit("d"), (F.col("c_custkey") % 4).cast("string")).alias("diff_id"), "fqn", "path")
    return dispatch.routed(t, modules(spark, d), ["test", "it"])


def index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The relations; those that the strategies read again and again are written once."""
    refs = written_references(spark, d)
    own = {"imports": imports_of(refs), "simple_refs": simple_refs_of(refs), "dotted_refs": dotted_refs_of(refs)}
    return {"tests": written(tests(spark, d)), "sources": sources(spark, d), **own, "decls": decls(spark, d), "edges": written(edges(spark, d))}


def changed_with_kind(spark: SparkSession, d: str) -> DataFrame:
    return changed(spark, d).withColumn("kind", F.lit("prod"))


def found(spark: SparkSession, d: str) -> DataFrame:
    return engine.discover(changed_with_kind(spark, d), index(spark, d), CONFIG)


def all_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Changed paths of documents, of all classes and of all tests; those of tests outside the test directories are diffs of their own."""
    sources = changed(spark, d).select("diff_id", F.concat(F.lit("src/main/java/"), F.replace("fqn", F.lit("."), F.lit("/")), F.lit(".java")).alias("path"))
    own = tests(spark, d).select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "t").otherwise("u"), (F.col("c_custkey") % 3).cast("string")).alias("diff_id"), "path")
    return changed_paths(spark, d).unionByName(sources).unionByName(own)


def analysed(spark: SparkSession, d: str) -> tuple[engine.Trace, dict[str, DataFrame]]:
    own = index(spark, d)
    return engine.trace(all_changed_files(spark, d), own, CONFIG), own


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): Java text of every class, each tenth without its last bracket, and of the tests, of which some lie out of scope."""
    c = classes(spark, d)
    text = F.concat(F.lit("package "), "pkg", F.lit(";\nimport java.util.List;\npublic class "), "simple", F.expr("concat(' extends Part', cast(k div 7 AS string))"), F.lit(" { List<String> x; /* Hidden */ "), F.when(F.col("k") % 10 == 0, "\n").otherwise("}\n"))
    sources = c.select(F.concat(F.lit("src/main/java/"), F.replace("fqn", F.lit("."), F.lit("/")), F.lit(".java")).alias("path"), text.alias("content"))
    own = tests(spark, d).filter(F.col("path").contains("/src/test/java/"))
    where = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("api-test/"), "path")).otherwise(F.col("path"))
    body = F.concat(F.lit("package "), "pkg", F.lit(";\nimport com.used.Part"), F.col("c_custkey").cast("string"), F.lit(";\nclass "), "simple", F.lit(" { Other o; }\n"))
    return sources.unionByName(own.select(where.alias("path"), body.alias("content")))


def syntax_metadata(spark: SparkSession, d: str, *langs: str) -> DataFrame:
    """Metadata of the made-up files, or of those of some languages alone."""
    files = syntax_corpus.files(spread(classes(spark, d), "k"))
    return source_text.metadata(files.filter(paths.extension(F.col("path")).isin(*langs)) if langs else files)


def fingerprints(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored metadata and current files of made-up times and sizes."""
    o = read(spark, d, "orders").select(F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"), F.lit(".java")).alias("path"), F.col("o_custkey").alias("mtime"), F.length("o_orderpriority").cast("long").alias("size"), "o_orderkey")
    stored = o.filter("o_orderkey % 10 <> 0").select("path", F.expr("mtime + if(o_orderkey % 7 = 0, 1, 0)").alias("mtime"), "size", (F.col("o_orderkey") % 13 != 0).alias("parse_ok"))
    return stored, o.filter("o_orderkey % 11 <> 0").select("path", "mtime", "size")


def directories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = read(spark, d, "supplier").select(F.concat(F.lit("dir"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("n"))
    old = s.filter("k % 5 <> 0").select("path", F.col("k").alias("mtime"), F.col("n").alias("child_count"))
    return old, s.filter("k % 6 <> 0").select("path", F.expr("k + if(k % 7 = 0, 1, 0)").alias("mtime"), F.expr("n + if(k % 8 = 0, 1, 0)").alias("child_count"))


# --- the same views in SQL -------------------------------------------------------------------------------------

V = {
    "cv_syntax": syntax_corpus.expected_sql(),
    "cv_mismatch": r"SELECT path, pkg, replace(regexp_extract(path, 'src/main/kotlin/(.*)/[^/]*$', 1), '/', '.') path_pkg FROM cv_syntax WHERE path LIKE '%.kt' AND parse_ok AND pkg <> replace(regexp_extract(path, 'src/main/kotlin/(.*)/[^/]*$', 1), '/', '.')",
    "cv_class": "SELECT p_partkey k, 'com.' || lower(replace(p_brand, '#', '')) pkg, 'Part' || p_partkey simple, 'com.' || lower(replace(p_brand, '#', '')) || '.Part' || p_partkey fqn FROM part",
    "cv_changed": "SELECT 'd' || (k % 4) diff_id, fqn, simple, pkg FROM cv_class",
    "cv_test0": "SELECT c_custkey, 'Part' || k || ['Test', 'IT', 'ITTest', 'IntegrationTest', 'Spec'][c_custkey % 5 + 1] simple, CASE WHEN c_custkey % 3 = 0 THEN c.pkg ELSE 'com.' || lower(c_mktsegment) END pkg FROM customer JOIN cv_class c ON c.k = c_custkey % (SELECT count(*) FROM part)",
    "cv_test": "SELECT *, pkg || '.' || simple fqn, CASE WHEN c_custkey % 2 = 0 THEN 'm' || (c_custkey % 25) || '/src/test/java/' ELSE 'm' || (c_custkey % 25) || '/sub/src/it/java/' END || replace(pkg || '.' || simple, '.', '/') || '.java' path FROM cv_test0",
    "cv_ref": "SELECT DISTINCT t.fqn test, t.pkg, l_linenumber % 6 kind, c.fqn target, c.pkg target_pkg, c.simple target_simple, l_quantity % 2 = 0 even FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cv_test t ON t.c_custkey = o_custkey JOIN cv_class c ON c.k = l_partkey",
    "cv_import": "SELECT DISTINCT test fqn, CASE kind WHEN 0 THEN target WHEN 1 THEN target || '.Inner' WHEN 2 THEN CASE WHEN even THEN target ELSE target || '.helper' END WHEN 3 THEN target_pkg ELSE target END AS name, kind = 2 is_static, kind IN (3, 5) OR (kind = 2 AND even) is_asterisk FROM cv_ref WHERE kind < 4 OR (kind = 5 AND even)",
    "cv_simple": "SELECT DISTINCT test fqn, pkg, target_simple AS name FROM cv_ref WHERE kind IN (0, 3) OR (kind = 5 AND NOT even)",
    "cv_dotted": "SELECT DISTINCT test fqn, CASE WHEN even THEN target ELSE target || '.Nested' END AS name FROM cv_ref WHERE kind = 4",
    "cv_decl": "SELECT fqn, 'Part' || (k // 7) supertype FROM cv_class WHERE k > 0",
    "cv_source": "SELECT DISTINCT simple, 'com.impl.' || simple fqn FROM (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'Part' || n || 'Impl' WHEN 1 THEN 'DefaultPart' || n ELSE 'Part' || n || 'Other' END simple FROM (SELECT s_suppkey, s_suppkey * 20 % (SELECT count(*) FROM part) n FROM supplier)) UNION ALL SELECT simple, fqn FROM cv_class",
    "cv_edge": "SELECT ca.fqn consumer, cb.fqn dependency FROM (SELECT DISTINCT a.l_partkey x, b.l_partkey y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey) JOIN cv_class ca ON ca.k = x JOIN cv_class cb ON cb.k = y",
    "cv_path": f"SELECT DISTINCT {DIFFS.format(s='varchar', i='integer')} diff_id, {PATHS.format(s='varchar')} path FROM documents",
    "cv_bucket": r"""SELECT *, CASE WHEN regexp_matches(path, '(^|/)\.\.(/|$)') THEN 'unmapped'
      WHEN path LIKE '%/generated/%' OR path LIKE '%.md' THEN 'ignored'
      WHEN path LIKE 'api-test/%' OR path LIKE '%/api-test/%' OR path LIKE 'perf/%' THEN 'out_of_scope'
      WHEN NOT regexp_matches(path, '(?i)[^/]\.(java|kt)$') OR path LIKE '%/module-info.java' THEN 'unmapped'
      WHEN regexp_matches(path, '(^|/)src/test/java/') THEN 'test'
      WHEN regexp_matches(path, '(^|/)src/main/(java|kotlin)/') THEN 'production' ELSE 'unmapped' END bucket FROM cv_path""",
    "cv_count": "SELECT diff_id, count(*) n_files, count(*) FILTER (bucket = 'ignored') n_ignored, count(*) FILTER (bucket = 'out_of_scope') n_oos, count(*) FILTER (bucket = 'production') n_prod, count(*) FILTER (bucket = 'test') n_test, count(*) FILTER (bucket = 'unmapped') n_unmapped FROM cv_bucket GROUP BY diff_id",
    "cv_made": "SELECT *, CASE WHEN n_prod + n_test > 0 THEN n_files % 3 ELSE 0 END n_selected, CASE WHEN n_files % 5 = 0 THEN 1 ELSE 0 END n_failed FROM cv_count",
    "cv_situation": "SELECT *, CASE WHEN n_files = 0 THEN 'EMPTY_DIFF' WHEN n_ignored = n_files THEN 'ALL_FILES_IGNORED' WHEN n_ignored + n_oos = n_files THEN 'ALL_FILES_OUT_OF_SCOPE' WHEN n_unmapped > 0 THEN 'UNMAPPED_FILE' WHEN n_failed > 0 THEN 'DISCOVERY_INCOMPLETE' WHEN n_selected = 0 THEN 'DISCOVERY_EMPTY' ELSE 'DISCOVERY_SUCCESS' END situation FROM cv_made",
    "cv_action": "SELECT *, CASE WHEN situation IN ('EMPTY_DIFF', 'ALL_FILES_IGNORED', 'ALL_FILES_OUT_OF_SCOPE') THEN 'SKIPPED' WHEN situation = 'DISCOVERY_SUCCESS' THEN 'SELECTED' ELSE 'FULL_SUITE' END AS action, CASE WHEN situation = 'DISCOVERY_SUCCESS' THEN 'EXPLICIT' ELSE 'MODE_DEFAULT' END action_source FROM cv_situation",
    "cv_decided": "SELECT diff_id, n_files, n_ignored, n_oos, n_prod, n_test, n_unmapped, situation, action, action_source, CASE WHEN action = 'SELECTED' THEN n_selected ELSE 0 END n_selected, action = 'FULL_SUITE' run_all, action = 'SKIPPED' skipped, CASE WHEN action <> 'FULL_SUITE' THEN 'NONE' WHEN situation = 'UNMAPPED_FILE' THEN 'RUN_ALL_ON_NON_JAVA_CHANGE' WHEN situation = 'DISCOVERY_EMPTY' THEN 'RUN_ALL_IF_NO_MATCHES' ELSE 'RUN_ALL_ON_DISCOVERY_INCOMPLETE' END escalation_reason, CASE action WHEN 'SELECTED' THEN 'SELECTED' WHEN 'SKIPPED' THEN 'SKIPPED' ELSE 'FULL_SUITE' END outcome FROM cv_action",
    "cv_naming": "SELECT DISTINCT c.diff_id, c.fqn changed_fqn, t.fqn, t.pkg <> c.pkg cross_package FROM (SELECT *, unnest([simple || 'Test', simple || 'IT', simple || 'ITTest', simple || 'IntegrationTest']) named FROM cv_changed) c JOIN cv_test t ON t.simple = c.named",
    "cv_key": """SELECT DISTINCT fqn, CASE WHEN is_static AND NOT is_asterisk THEN regexp_extract(name, '^(.*)\\.[^.]*$', 1) ELSE name END AS key, 'import' tier FROM cv_import WHERE is_static OR NOT is_asterisk
      UNION SELECT fqn, regexp_replace(name, '[.][^.]*$', ''), 'inner_import' FROM cv_import WHERE name LIKE '%.%.%'
      UNION SELECT fqn, regexp_replace(name, '[.][^.]*[.][^.]*$', ''), 'inner_import' FROM cv_import WHERE name LIKE '%.%.%.%'
      UNION SELECT fqn, name, 'class_wildcard' FROM cv_import WHERE is_asterisk AND NOT is_static
      UNION SELECT i.fqn, i.name || '.' || s.name, 'package_wildcard' FROM cv_import i JOIN cv_simple s ON s.fqn = i.fqn WHERE is_asterisk AND NOT is_static
      UNION SELECT fqn, pkg || '.' || name, 'same_package' FROM cv_simple
      UNION SELECT fqn, name, 'inline' FROM cv_dotted
      UNION SELECT fqn, regexp_replace(name, '[.][^.]*$', ''), 'inline' FROM cv_dotted WHERE name LIKE '%.%.%'""",
    "cv_usage": "SELECT DISTINCT c.diff_id, c.fqn changed_fqn, k.fqn, k.tier FROM cv_changed c JOIN cv_key k ON k.key = c.fqn",
    "cv_impl_name": "SELECT DISTINCT c.diff_id, s.fqn FROM (SELECT *, unnest([simple || 'Impl', 'Impl' || simple, simple || 'Default', 'Default' || simple]) named FROM cv_changed) c JOIN cv_source s ON s.simple = c.named",
    "cv_impl_walk": "SELECT diff_id, fqn, 0 hop, false known FROM cv_changed UNION ALL SELECT diff_id, fqn, 0, true FROM cv_impl_name UNION SELECT w.diff_id, d.fqn, w.hop + 1, true FROM cv_impl_walk w JOIN cv_decl d ON d.supertype = regexp_extract(w.fqn, '[^.]*$') WHERE w.hop < 4",
    "cv_impl": "SELECT diff_id, fqn, min(hop) hop FROM cv_impl_walk w GROUP BY diff_id, fqn HAVING bool_and(known)",
    "cv_walk": "SELECT diff_id, fqn, 0 hop FROM cv_changed UNION SELECT w.diff_id, e.consumer, w.hop + 1 FROM cv_walk w JOIN cv_edge e ON e.dependency = w.fqn WHERE w.hop < 4",
    "cv_reached": "SELECT diff_id, fqn, min(hop) hop FROM cv_walk GROUP BY diff_id, fqn HAVING min(hop) > 0",
    "cv_more": "SELECT 'impl' strategy, diff_id, fqn FROM cv_impl UNION ALL SELECT 'transitive', diff_id, fqn FROM cv_reached",
    "cv_found": "SELECT DISTINCT diff_id, 'naming' strategy, fqn FROM cv_naming UNION SELECT diff_id, 'usage', fqn FROM cv_usage UNION SELECT m.diff_id, m.strategy, t.fqn FROM (SELECT *, unnest([regexp_extract(fqn, '[^.]*$') || x FOR x IN ['Test', 'IT', 'ITTest', 'IntegrationTest']]) named FROM cv_more) m JOIN cv_test t ON t.simple = m.named UNION SELECT m.diff_id, m.strategy, k.fqn FROM cv_more m JOIN cv_key k ON k.key = m.fqn",
    "cv_strategy": "SELECT diff_id, strategy, count(DISTINCT fqn) n_tests FROM cv_found GROUP BY ALL",
    "cv_afile": "SELECT diff_id, path FROM cv_path UNION SELECT diff_id, 'src/main/java/' || replace(fqn, '.', '/') || '.java' FROM cv_changed UNION SELECT CASE WHEN c_custkey % 2 = 0 THEN 't' ELSE 'u' END || (c_custkey % 3), path FROM cv_test",
    "cv_achanged": r"SELECT DISTINCT diff_id, fqn, regexp_extract(fqn, '[^.]*$') AS simple, regexp_replace(fqn, '\.?[^.]*$', '') pkg FROM (SELECT diff_id, unnest(CASE WHEN path LIKE '%.kt' THEN [f, f || 'Kt'] ELSE [f] END) fqn FROM (SELECT *, replace(regexp_replace(regexp_extract(path, '(?:^|/)src/main/(?:java|kotlin)/(.*)$', 1), '\.(java|kt)$', ''), '/', '.') f FROM cv_abucket WHERE bucket = 'production'))",
    "cv_aown": r"SELECT DISTINCT diff_id, replace(regexp_replace(regexp_extract(path, '(?:^|/)src/test/java/(.*)$', 1), '\.java$', ''), '/', '.') fqn FROM cv_abucket WHERE bucket = 'test'",
    "cv_all": "SELECT DISTINCT diff_id, strategy, fqn FROM (SELECT * FROM cv_afound UNION SELECT diff_id, 'changed', fqn FROM cv_aown)",
    "cv_apick": "SELECT DISTINCT f.diff_id, f.fqn, t.path FROM cv_all f JOIN cv_test t ON t.fqn = f.fqn",
    "cv_amade": "SELECT c.*, coalesce(n, 0) n_selected, coalesce(classes, 0) n_prod_classes, 0 n_failed FROM cv_acount c LEFT JOIN (SELECT diff_id, count(DISTINCT fqn) n FROM cv_apick GROUP BY diff_id) USING (diff_id) LEFT JOIN (SELECT diff_id, count(DISTINCT fqn) classes FROM cv_achanged GROUP BY diff_id) USING (diff_id)",
    "cv_achosen": "SELECT p.* FROM cv_apick p JOIN cv_adecided d ON d.diff_id = p.diff_id AND d.outcome = 'SELECTED'",
    "cv_aroute": "SELECT p.diff_id, p.fqn, coalesce(max_by(m.gradle_path, length(m.dir)), '') || ':' || CASE WHEN p.path LIKE '%/src/test/%' THEN 'test' WHEN p.path LIKE '%/src/it/%' THEN 'it' ELSE 'test' END task_key FROM cv_achosen p LEFT JOIN cv_module m ON starts_with(p.path, m.dir || '/') GROUP BY p.diff_id, p.fqn, p.path",
    "cv_asample": "SELECT diff_id, bucket, list(path ORDER BY path) FILTER (place <= 10) AS first, greatest(max(n) - 10, 0) more FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, bucket ORDER BY path) place, count(*) OVER (PARTITION BY diff_id, bucket) n FROM cv_abucket) GROUP BY diff_id, bucket",
    "cv_across": "SELECT diff_id, changed_fqn, fqn, row_number() OVER (PARTITION BY diff_id ORDER BY changed_fqn, fqn) place, count(*) OVER (PARTITION BY diff_id) total FROM (SELECT DISTINCT n.diff_id, n.changed_fqn, n.fqn FROM cv_anaming n JOIN cv_achosen c ON c.diff_id = n.diff_id AND c.fqn = n.fqn WHERE cross_package)",
    "cv_ajson_sample": "SELECT diff_id, string_agg('\"' || CASE bucket WHEN 'out_of_scope' THEN 'outOfScope' ELSE bucket END || '\":[' || array_to_string([f'\"{x}\"' FOR x IN first], ',') || ']', ',' ORDER BY bucket) body FROM cv_asample GROUP BY diff_id".replace("f'\"{x}\"'", "'\"' || x || '\"'"),
    "cv_ajson_module": "SELECT diff_id, string_agg('{\"task\":\"' || task_key || '\",\"fqns\":[' || fqns || ']}', ',' ORDER BY task_key) body FROM (SELECT diff_id, task_key, string_agg(DISTINCT '\"' || fqn || '\"', ',' ORDER BY '\"' || fqn || '\"') fqns FROM cv_aroute GROUP BY ALL) GROUP BY diff_id",
    "cv_ajson_run": "SELECT d.diff_id, string_agg('{\"name\":\"' || s.strategy || '\",\"millis\":0,\"tests\":' || coalesce(n, 0) || '}', ',' ORDER BY ord) body FROM cv_adecided d CROSS JOIN (VALUES ('naming', 1), ('usage', 2), ('impl', 3), ('transitive', 4)) s(strategy, ord) LEFT JOIN (SELECT diff_id, strategy, count(DISTINCT fqn) n FROM cv_all GROUP BY ALL) f ON f.diff_id = d.diff_id AND f.strategy = s.strategy WHERE outcome = 'SELECTED' AND n_prod > 0 GROUP BY d.diff_id",
    "cv_asample_line": "SELECT diff_id, list(line ORDER BY line) AS sample_lines FROM (SELECT diff_id, '  ' || replace(bucket, '_', '-') || ' sample: ' || array_to_string(first, ', ') || CASE WHEN more > 0 THEN ', … (+' || more || ' more)' ELSE '' END line FROM cv_asample) GROUP BY diff_id",
    "cv_across_line": "SELECT diff_id, list_concat(['Hint: naming selected ' || max(total) || CASE WHEN max(total) = 1 THEN ' test' ELSE ' tests' END || ' of another package than the changed class; the names may meet by chance.'], list('  * ' || changed_fqn || ' → ' || fqn ORDER BY place) FILTER (place <= 10), CASE WHEN max(total) > 10 THEN ['  … (+' || (max(total) - 10) || ' more)'] ELSE [] END, ['  They run all the same; move the test beside its class, or rename one of the classes.']) cross_lines FROM cv_across GROUP BY diff_id",
    "cv_atask": "SELECT diff_id, task_key, list_concat(['  ' || task_key || ' (' || max(n) || CASE WHEN max(n) = 1 THEN ' test class)' ELSE ' test classes)' END], list('    ' || fqn ORDER BY place) FILTER (place <= 5), CASE WHEN max(n) > 5 THEN ['    … and ' || (max(n) - 5) || ' more'] ELSE [] END) lines, max(n) n FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, task_key ORDER BY fqn) place, count(*) OVER (PARTITION BY diff_id, task_key) n FROM (SELECT DISTINCT diff_id, task_key, fqn FROM cv_aroute)) GROUP BY diff_id, task_key",
    "cv_amodule_line": "SELECT diff_id, list_concat(['Modules:         ' || count(*) || CASE WHEN count(*) = 1 THEN ' module, ' ELSE ' modules, ' END || sum(n) || CASE WHEN sum(n) = 1 THEN ' test class to dispatch' ELSE ' test classes to dispatch' END], flatten(list(lines ORDER BY task_key))) module_lines FROM cv_atask GROUP BY diff_id",
    "cv_akotlin": "SELECT diff_id, CASE WHEN bool_or(path LIKE '%.kt' AND bucket = 'unmapped') THEN ['Hint: a Kotlin source lies in no source or test directory and is unmapped.'] ELSE [] END || CASE WHEN bool_or(path LIKE '%.kt' AND bucket IN ('production', 'test')) THEN ['Hint: Kotlin sources are known by their path alone, their text is not read.'] ELSE [] END kotlin_lines FROM cv_abucket GROUP BY diff_id",
    "cv_module": "SELECT 'm' || n_nationkey dir, ':m' || n_nationkey gradle_path FROM nation UNION ALL SELECT 'm' || n_nationkey || '/sub', ':m' || n_nationkey || ':sub' FROM nation WHERE n_nationkey % 2 = 0",
    "cv_owner": "SELECT t.fqn, t.path, t.c_custkey, coalesce(max_by(m.gradle_path, length(m.dir)), '') gradle_path FROM cv_test t LEFT JOIN cv_module m ON starts_with(t.path, m.dir || '/') GROUP BY t.fqn, t.path, t.c_custkey",
    "cv_route": "SELECT 'd' || (c_custkey % 4) diff_id, fqn, path, gradle_path || ':' || CASE WHEN path LIKE '%/src/test/%' THEN 'test' WHEN path LIKE '%/src/it/%' THEN 'it' ELSE 'test' END task_key FROM cv_owner",
    "cv_log": "SELECT doc_id, text || chr(9) || chr((doc_id % 32 + 1)::integer) || chr(133) || chr(13) || chr(10) || coalesce(lang, '') AS text FROM documents",
    "cv_file": "SELECT 'src/' || o_orderkey || '.java' path, o_custkey mtime, length(o_orderpriority) size, o_orderkey k FROM orders",
    "cv_stored": "SELECT path, mtime + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END mtime, size, k % 13 <> 0 parse_ok FROM cv_file WHERE k % 10 <> 0",
    "cv_current": "SELECT path, mtime, size FROM cv_file WHERE k % 11 <> 0",
    "cv_old": "SELECT 'dir' || s_suppkey path, s_suppkey mtime, s_nationkey::bigint child_count FROM supplier WHERE s_suppkey % 5 <> 0",
    "cv_new": "SELECT 'dir' || s_suppkey path, s_suppkey + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END mtime, s_nationkey + CASE WHEN s_suppkey % 8 = 0 THEN 1 ELSE 0 END child_count FROM supplier WHERE s_suppkey % 6 <> 0",
}


def over_all_changes() -> None:
    """The views of a decision again, over all changed files instead of those of documents, and with the tests that discovery finds."""
    import re

    again = ("bucket", "count", "situation", "action", "decided", "naming", "usage", "impl_name", "impl_walk", "impl", "walk", "reached", "more", "found")
    other = {"cv_path": "cv_afile", "cv_made": "cv_amade", "cv_changed": "cv_achanged", **{f"cv_{n}": f"cv_a{n}" for n in again}}
    for name in again:
        V[f"cv_a{name}"] = re.sub(r"\bcv_\w+", lambda m: other.get(m[0], m[0]), V[f"cv_{name}"])


over_all_changes()


def sql(query: str) -> str:
    """The query with the views it needs before it."""
    import re

    ordered: list[str] = []

    def need(text: str, inside: tuple[str, ...] = ()) -> None:
        for name in re.findall(r"\bcv_\w+", text):
            if name not in ordered and name not in inside:
                need(V[name], (*inside, name))
                ordered.append(name)

    need(query)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({V[n]})" for n in ordered) + f" {query}" if ordered else query


# --- queries ---------------------------------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = sql(oracle)
        return f

    return add


@query(r"SELECT diff_id, path, regexp_matches(path, '(^|/)\.\.(/|$)') traverses FROM cv_path")
def path_traversal_guard(spark, d):
    return changed_paths(spark, d).withColumn("traverses", paths.traverses(F.col("path")))


@query("SELECT diff_id, path, path LIKE '%/generated/%' OR path LIKE '%.md' ignored FROM cv_path")
def ignore_glob(spark, d):
    return changed_paths(spark, d).withColumn("ignored", paths.any_glob(F.col("path"), list(IGNORED)))


@query("SELECT diff_id, path, path LIKE 'api-test/%' OR path LIKE '%/api-test/%' OR path LIKE 'perf/%' out_of_scope FROM cv_path")
def out_of_scope(spark, d):
    return changed_paths(spark, d).withColumn("out_of_scope", paths.in_directories(F.col("path"), CONFIG.out_of_scope()))


@query(r"SELECT path, regexp_matches(path, '(?i)[^/]\.(java|kt)$') is_source, lower(regexp_extract(path, '(?i)\.(java|kt)$', 1)) extension, regexp_replace(path, '(?i)\.(java|kt)$', '') stem, split_part(path, '/', -1) IN ('module-info.java', 'package-info.java') is_marker FROM cv_path")
def source_extension(spark, d):
    p = F.col("path")
    return changed_paths(spark, d).select("path", paths.is_source(p).alias("is_source"), paths.extension(p).alias("extension"), paths.without_extension(p).alias("stem"), paths.is_marker(p).alias("is_marker"))


@query(r"SELECT path, CASE WHEN regexp_matches(path, '(^|/)src/main/(java|kotlin)/.') THEN replace(regexp_replace(regexp_extract(path, '(?:^|/)src/main/(?:java|kotlin)/(.*)$', 1), '(?i)\.(java|kt)$', ''), '/', '.') END fqn FROM cv_path")
def path_to_fqn(spark, d):
    return changed_paths(spark, d).select("path", paths.fqn_under(F.col("path"), list(CONFIG.source_dirs)).alias("fqn"))


@query("SELECT diff_id, path, bucket FROM cv_bucket")
def bucket_classify(spark, d):
    return classified(spark, d)


@query("SELECT * FROM cv_count")
def bucket_counts(spark, d):
    return engine.bucket_counts(classified(spark, d))


@query(r"""SELECT DISTINCT diff_id, kind, fqn, regexp_extract(fqn, '[^.]*$') AS simple, regexp_replace(fqn, '\.?[^.]*$', '') pkg FROM (
  SELECT diff_id, CASE bucket WHEN 'production' THEN 'prod' ELSE 'test' END kind, unnest(CASE WHEN bucket = 'production' AND path LIKE '%.kt' THEN [f, f || 'Kt'] ELSE [f] END) fqn FROM (
    SELECT *, replace(regexp_replace(regexp_extract(path, '(?:^|/)src/(?:main|test)/(?:java|kotlin)/(.*)$', 1), '\.(java|kt)$', ''), '/', '.') f FROM cv_bucket WHERE bucket IN ('production', 'test')))""")
def kotlin_synthetic(spark, d):
    return engine.changed_classes(classified(spark, d), CONFIG)


@query(r"SELECT fqn, regexp_extract(fqn, '[^.]*$') AS simple_name, regexp_extract(fqn, '^(.*)\.[^.]*$', 1) AS package, regexp_extract(pkg, '^(.*)\.[^.]*$', 1) AS outer_name FROM cv_test")
def simple_package_split(spark, d):
    return tests(spark, d).select("fqn", paths.simple_name(F.col("fqn")).alias("simple_name"), paths.package_of(F.col("fqn")).alias("package"), paths.without_last_segment(F.col("pkg")).alias("outer_name"))


@query(r"SELECT word, regexp_full_match(word, '[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*') valid FROM (SELECT DISTINCT unnest(string_split(text, ' ')) word FROM documents)")
def fqn_validity(spark, d):
    words = read(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.withColumn("valid", paths.is_valid_fqn(F.col("word")) & ~F.col("word").contains("\n"))


@query(r"SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN c <> '' AND (ord(c) < 32 OR (ord(c) >= 127 AND ord(c) < 160)) THEN '\x' || printf('%02X', ord(c)) ELSE c END), '') safe FROM cv_log")
def log_sanitize(spark, d):
    return log_text(spark, d).select("doc_id", paths.sanitized(F.col("text")).alias("safe"))


@query("SELECT * FROM cv_naming")
def naming_match(spark, d):
    return selection.naming(changed(spark, d), tests(spark, d), SUFFIXES)


@query("SELECT changed_fqn, count(DISTINCT fqn) n_tests FROM cv_naming WHERE cross_package GROUP BY changed_fqn")
def naming_cross_package(spark, d):
    return naming_match(spark, d).filter("cross_package").groupBy("changed_fqn").agg(F.count_distinct("fqn").alias("n_tests"))


def usage_tier(tier: str, keys: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return selection.usage(changed(spark, d), keys(spark, d).withColumn("tier", F.lit(tier)))

    run.__name__ = f"usage_{tier}"
    return query(f"SELECT * FROM cv_usage WHERE tier = '{tier}'")(run)


usage_tier("import", lambda s, d: selection.direct_imports(imports(s, d)))
usage_tier("inner_import", lambda s, d: selection.inner_imports(imports(s, d)))
usage_tier("class_wildcard", lambda s, d: selection.class_wildcards(imports(s, d)))
usage_tier("package_wildcard", lambda s, d: selection.package_wildcards(imports(s, d), simple_refs(s, d)))
usage_tier("same_package", lambda s, d: selection.same_package(simple_refs(s, d)))
usage_tier("inline", lambda s, d: selection.inline_names(dotted_refs(s, d)))


@query("SELECT fqn, name, regexp_extract(name, '^(.*)\\.[^.]*$', 1) AS owner, is_asterisk FROM cv_import WHERE is_static")
def usage_static_import(spark, d):
    return imports(spark, d).filter("is_static").select("fqn", "name", paths.without_last_segment(F.col("name")).alias("owner"), "is_asterisk")


@query("SELECT * FROM cv_usage")
def usage_all(spark, d):
    refs = written_references(spark, d)
    return selection.usage_in_tiers(changed(spark, d), imports_of(refs), simple_refs_of(refs), dotted_refs_of(refs))


@query("SELECT * FROM cv_impl_name")
def impl_by_name(spark, d):
    return selection.implementations_by_name(changed(spark, d), sources(spark, d), list(CONFIG.implementation_naming))


@query("SELECT DISTINCT c.diff_id, d.fqn FROM cv_changed c JOIN cv_decl d ON d.supertype = c.simple WHERE NOT EXISTS (FROM cv_changed o WHERE o.diff_id = c.diff_id AND o.fqn = d.fqn)")
def impl_by_supertype(spark, d):
    return selection.implementations(changed(spark, d), sources(spark, d).limit(0), decls(spark, d), [], 1).select("diff_id", "fqn")


@query("SELECT diff_id, fqn, hop FROM cv_impl")
def impl_fixpoint(spark, d):
    return selection.implementations(changed(spark, d), sources(spark, d), decls(spark, d), list(CONFIG.implementation_naming), DEPTH)


@query(r"SELECT token, count(*) n_files FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9_$]*\b'))) token FROM documents) GROUP BY token")
def token_index(spark, d):
    files = read(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return selection.posting(files).groupBy("token").agg(F.count(F.lit(1)).alias("n_files"))


@query(r"""SELECT s.fqn consumer, s.name, coalesce(
    (SELECT min(i.name) FROM cv_import i WHERE i.fqn = s.fqn AND NOT i.is_static AND NOT i.is_asterisk AND regexp_extract(i.name, '[^.]*$') = s.name),
    (SELECT c.fqn FROM cv_class c WHERE c.fqn = s.pkg || '.' || s.name),
    (SELECT min(c.fqn) FROM cv_import i JOIN cv_class c ON c.fqn = i.name || '.' || s.name WHERE i.fqn = s.fqn AND NOT i.is_static AND i.is_asterisk)) AS dependency
  FROM cv_simple s QUALIFY dependency IS NOT NULL""".replace("QUALIFY", "WHERE").replace("WHERE dependency IS NOT NULL", ""))
def name_resolution(spark, d):
    refs = written_references(spark, d)
    return selection.resolved(simple_refs(spark, d, refs), imports(spark, d, refs), classes(spark, d).select("fqn"))


@query("SELECT DISTINCT consumer, dependency FROM (" + r"""SELECT s.fqn consumer, s.name, coalesce((SELECT min(i.name) FROM cv_import i WHERE i.fqn = s.fqn AND NOT i.is_static AND NOT i.is_asterisk AND regexp_extract(i.name, '[^.]*$') = s.name), (SELECT c.fqn FROM cv_class c WHERE c.fqn = s.pkg || '.' || s.name), (SELECT min(c.fqn) FROM cv_import i JOIN cv_class c ON c.fqn = i.name || '.' || s.name WHERE i.fqn = s.fqn AND NOT i.is_static AND i.is_asterisk)) AS dependency FROM cv_simple s""" + ") WHERE dependency <> consumer AND right(name, 1) <> '3'")
def used_by(spark, d):
    """Edges of resolved names that stand as words in the consumer's text; the made-up text lacks names that end in 3."""
    refs = written_references(spark, d)
    names = simple_refs_of(refs)
    words = names.filter(~F.col("name").endswith("3")).select(F.col("fqn").alias("path"), F.col("name").alias("token"))
    return selection.used_by(words, selection.resolved(names, imports(spark, d, refs), classes(spark, d).select("fqn")))


ORACLE["name_resolution"] = f"SELECT * FROM ({ORACLE['name_resolution']}) WHERE dependency IS NOT NULL"


@query("SELECT diff_id, fqn, hop FROM cv_reached")
def transitive_bfs(spark, d):
    return selection.transitive(changed(spark, d), kept(edges(spark, d)), DEPTH)


@query("SELECT diff_id, fqn FROM cv_found WHERE strategy = 'transitive'")
def transitive_tests(spark, d):
    only = Config(strategies=("transitive",))
    return engine.discover(changed_with_kind(spark, d), index(spark, d), only).filter("strategy = 'transitive'").select("diff_id", "fqn")


@query("SELECT diff_id, strategy, fqn FROM cv_found")
def strategy_union(spark, d):
    return found(spark, d)


@query("SELECT * FROM cv_strategy")
def strategy_counts(spark, d):
    return engine.strategy_counts(found(spark, d))


@query("SELECT diff_id, CASE WHEN count(*) > 1 AND count(*) FILTER (n_tests = top) = 1 THEN max_by(strategy, n_tests) END strategy FROM (SELECT *, max(n_tests) OVER (PARTITION BY diff_id) top FROM cv_strategy) GROUP BY diff_id")
def dominant_strategy(spark, d):
    return engine.dominant_strategy(engine.strategy_counts(found(spark, d)))


@query("SELECT DISTINCT f.diff_id, f.fqn, t.path FROM cv_found f JOIN cv_test t ON t.fqn = f.fqn AND t.c_custkey % 4 <> 0")
def known_test_semijoin(spark, d):
    return engine.on_disk(found(spark, d), tests(spark, d).filter("c_custkey % 4 <> 0"))


@query("SELECT diff_id, n_test AS n_selected, CASE WHEN n_test > 0 THEN 'DISCOVERY_SUCCESS' ELSE 'DISCOVERY_EMPTY' END situation FROM cv_count WHERE n_prod = 0 AND n_test > 0 AND n_unmapped = 0")
def test_only_fast_path(spark, d):
    counts = engine.bucket_counts(classified(spark, d)).filter("n_prod = 0 AND n_test > 0 AND n_unmapped = 0").withColumn("n_selected", F.col("n_test")).withColumn("n_failed", F.lit(0))
    return engine.decide(counts, CONFIG).select("diff_id", "n_selected", "situation")


@query("SELECT diff_id, situation FROM cv_situation")
def situation_resolve(spark, d):
    return engine.decide(decision_counts(spark, d), CONFIG).select("diff_id", "situation")


@query("SELECT diff_id, situation, mode, action FROM cv_situation JOIN (" + " UNION ALL ".join(f"SELECT '{s}' situation, '{m}' AS mode, '{DEFAULTS[s][i]}' AS action" for s in SITUATIONS for i, m in enumerate(("LOCAL", "CI", "STRICT"))) + ") USING (situation)")
def action_matrix(spark, d):
    """What every mode would do with each diff's situation."""
    found = engine.decide(decision_counts(spark, d), CONFIG).select("diff_id", "situation")
    rows = [Config(mode=m).action_matrix(spark).select("situation", F.lit(m).alias("mode"), "action") for m in ("LOCAL", "CI", "STRICT")]
    return found.join(F.broadcast(reduce(DataFrame.union, rows)), "situation").select("diff_id", "situation", "mode", "action")


@query("SELECT diff_id, situation, action, action_source FROM cv_action")
def action_resolve(spark, d):
    return engine.decide(decision_counts(spark, d), CONFIG).select("diff_id", "situation", "action", "action_source")


@query("SELECT diff_id, escalation_reason, run_all, skipped FROM cv_decided")
def escalation_reason(spark, d):
    return engine.decide(decision_counts(spark, d), CONFIG).select("diff_id", "escalation_reason", "run_all", "skipped")


@query("SELECT path, gradle_path FROM cv_owner")
def module_longest_prefix(spark, d):
    return dispatch.owning_module(tests(spark, d).select("path"), modules(spark, d)).select("path", "gradle_path")


@query("SELECT diff_id, fqn, task_key FROM cv_route")
def task_routing(spark, d):
    return routes(spark, d).select("diff_id", "fqn", "task_key")


@query("SELECT diff_id, task_key, count(*) OVER (PARTITION BY diff_id, task_key) n_tests, row_number() OVER (PARTITION BY diff_id, task_key ORDER BY fqn) place, fqn FROM (SELECT DISTINCT diff_id, task_key, fqn FROM cv_route)")
def dispatch_plan(spark, d):
    return dispatch.plan(routes(spark, d))


@query("SELECT diff_id, bucket, place, path, greatest(n - 10, 0) remaining FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, bucket ORDER BY path) place, count(*) OVER (PARTITION BY diff_id, bucket) n FROM cv_bucket) WHERE place <= 10")
def bucket_samples_top10(spark, d):
    return dispatch.bucket_samples(classified(spark, d))


@query("SELECT diff_id, task_key, place, fqn, greatest(n - 5, 0) remaining FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, task_key ORDER BY fqn) place, count(*) OVER (PARTITION BY diff_id, task_key) n FROM (SELECT DISTINCT diff_id, task_key, fqn FROM cv_route)) WHERE place <= 5")
def dispatch_preview_top5(spark, d):
    return dispatch.preview(routes(spark, d))


@query("SELECT c.path, s.path IS NOT NULL reused FROM cv_current c LEFT JOIN cv_stored s ON s.path = c.path AND s.mtime = c.mtime AND s.size = c.size AND s.parse_ok")
def fingerprint_refresh(spark, d):
    stored, files = fingerprints(spark, d)
    return snapshot.reusable(stored, files).select("path", F.lit(True).alias("reused")).union(snapshot.to_parse(stored, files).select("path", F.lit(False)))


@query("SELECT coalesce(a.path, b.path) path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END drift FROM cv_old a FULL JOIN cv_new b ON a.path = b.path WHERE NOT coalesce(a.mtime = b.mtime AND a.child_count = b.child_count, false)")
def dir_fingerprint_diff(spark, d):
    return snapshot.drifted(*directories(spark, d))


@query("SELECT n_nationkey, sha256('m' || n_nationkey || '/src/main/java,src/main/java' || chr(10) || 'src/test/java' || chr(10) || chr(10) || array_to_string(list_sort([lower(n_name) || '/**', 'api-test']), ',') || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END) AS config_hash FROM nation")
def config_hash(spark, d):
    """Hashes of the settings of a project per nation."""
    n = F.col("n_nationkey")
    own = [F.array(F.lit("src/main/java"), F.concat(F.lit("m"), n.cast("string"), F.lit("/src/main/java"))), F.array(F.lit("src/test/java")), F.array().cast("array<string>"), F.array(F.lit("api-test"), F.concat(F.lower("n_name"), F.lit("/**")))]
    return read(spark, d, "nation").select(n, snapshot.hash_of(*own, n % 2 == 0).alias("config_hash"))


MATRIX = [(s, *CONFIG.action(s, "CI")) for s in SITUATIONS]
SAYS = "CASE WHEN run_all THEN 'FULL_SUITE — ' || CASE situation WHEN 'UNMAPPED_FILE' THEN 'onUnmappedFile=FULL_SUITE — non-Java or unmapped file in diff' WHEN 'DISCOVERY_EMPTY' THEN 'onDiscoveryEmpty=FULL_SUITE — no affected tests discovered' END WHEN skipped THEN 'SKIPPED — no tests will run' ELSE 'SELECTED — ' || n_selected || ' test class(es) will run' END"


@query("SELECT diff_id, n_files, n_prod_classes, n_selected, situation, action, action_source, outcome, escalation_reason FROM cv_adecided JOIN (SELECT diff_id, n_prod_classes FROM cv_amade) USING (diff_id)")
def analyse_decisions(spark, d):
    """Decisions on all changed files, from classification through discovery."""
    return analysed(spark, d)[0].decisions.select("diff_id", "n_files", "n_prod_classes", "n_selected", "situation", "action", "action_source", "outcome", "escalation_reason")


@query("SELECT * FROM cv_achosen")
def analyse_selected(spark, d):
    """The tests that those decisions run."""
    return analysed(spark, d)[0].chosen()


@query("SELECT * FROM cv_across")
def cross_package_pairs(spark, d):
    trace, own = analysed(spark, d)
    return engine.cross_package(trace.classes, trace.chosen(), own, CONFIG)


@query(
    """SELECT diff_id, '{"version":2,"baseRef":"origin/master","mode":{"configured":"CI","effective":"CI"},"changedFiles":' || n_files
      || ',"buckets":{"ignored":' || n_ignored || ',"outOfScope":' || n_oos || ',"production":' || n_prod || ',"test":' || n_test || ',"unmapped":' || n_unmapped
      || '},"samples":{' || s.body || '},"situation":"' || situation || '","action":{"name":"' || action || '","source":"' || action_source
      || '"},"outcome":{"kind":"' || outcome || '","selectedClassCount":' || n_selected || ',"escalationReason":"' || escalation_reason
      || '"},"modules":[' || coalesce(m.body, '') || '],"discovery":{"parallelEnabled":false,"concurrencyLevel":0,"totalMillis":0,"perStrategy":[' || coalesce(r.body, '') || ']},"actionMatrix":{"""
    + ",".join(f'"{situation}":{{"action":"{action}","source":"{source}"}}' for situation, action, source in MATRIX)
    + """}}' AS json FROM cv_adecided JOIN cv_ajson_sample s USING (diff_id) LEFT JOIN cv_ajson_module m USING (diff_id) LEFT JOIN cv_ajson_run r USING (diff_id)"""
)
def explain_json(spark, d):
    trace, _ = analysed(spark, d)
    routes = dispatch.routed(trace.chosen(), modules(spark, d), ["test", "it"])
    return report.explain_json(trace.decisions, trace.classified, routes, trace.found, CONFIG)


@query("SELECT diff_id, 'Impacted Tests: ' || action || ' (' || situation || ') — ' || n_files || ' changed file(s)' || CASE WHEN run_all THEN '; running full suite (' || CASE situation WHEN 'UNMAPPED_FILE' THEN 'onUnmappedFile=FULL_SUITE — non-Java or unmapped file in diff' WHEN 'DISCOVERY_EMPTY' THEN 'onDiscoveryEmpty=FULL_SUITE — no affected tests discovered' ELSE 'onDiscoveryIncomplete=FULL_SUITE — discovery observed unparseable Java files, selection may be incomplete' END || ').' WHEN skipped THEN '; ' || CASE situation WHEN 'ALL_FILES_IGNORED' THEN 'every changed file matched ignorePaths' ELSE 'every changed file sat under out-of-scope dirs' END || '.' ELSE ', ' || n_prod || ' production class(es), ' || n_selected || ' test class(es) affected' END AS line FROM cv_decided")
def summary_line(spark, d):
    return report.summary(engine.decide(decision_counts(spark, d), CONFIG).withColumn("n_prod_classes", F.col("n_prod")))


@query(
    f"""SELECT diff_id, generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS line FROM (SELECT diff_id, list_concat(
      ['=== decision trace (explain) ===', 'Base ref:        origin/master', 'Mode:            CI (effective: CI)', 'Changed files:   ' || n_files, 'Buckets:',
       '  ignored         ' || n_ignored, '  out-of-scope    ' || n_oos, '  production      ' || n_prod, '  test            ' || n_test, '  unmapped        ' || n_unmapped],
      sample_lines, ['Situation:       ' || situation, 'Action:          ' || action || ' (source: ' || action_source || ')', 'Outcome:         ' || {SAYS}],
      CASE situation WHEN 'DISCOVERY_SUCCESS' THEN list_concat(CASE WHEN n_oos = 0 THEN ['Hint: out_of_scope_test_dirs (2 in all) met no changed file; entries are directories or globs, as api-test or api-test/**.'] ELSE [] END, coalesce(cross_lines, []))
        WHEN 'DISCOVERY_EMPTY' THEN ['Hint: no test found for ' || n_prod || CASE WHEN n_prod = 1 THEN ' changed production file' ELSE ' changed production files' END || '; it may be that',
          '  * the test''s name has none of the suffixes Test, IT, ITTest, IntegrationTest', '  * the test lies outside src/test/java', '  * there is no test yet'] ELSE [] END,
      kotlin_lines, CASE WHEN outcome = 'SELECTED' THEN coalesce(module_lines, []) ELSE [] END,
      {["Action matrix (situation → action [source]):", *(f"  {s:<24} {a} [{source}]" for s, a, source in MATRIX), "=== end explain ==="]}) AS lines
    FROM cv_adecided JOIN cv_asample_line USING (diff_id) JOIN cv_akotlin USING (diff_id) LEFT JOIN cv_across_line USING (diff_id) LEFT JOIN cv_amodule_line USING (diff_id))"""
)
def explain_trace(spark, d):
    trace, own = analysed(spark, d)
    routes = dispatch.routed(trace.chosen(), modules(spark, d), ["test", "it"])
    cross = engine.cross_package(trace.classes, trace.chosen(), own, CONFIG)
    return report.explain(trace.decisions, trace.classified, routes, CONFIG, cross=cross)


@query("SELECT diff_id, max(n) n_unmapped, string_agg(path, ', ' ORDER BY path) FILTER (place <= 5) examples FROM (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY path) place, count(*) OVER (PARTITION BY diff_id) n FROM cv_bucket WHERE bucket = 'unmapped') GROUP BY diff_id")
def unmapped_examples(spark, d):
    return dispatch.unmapped_examples(classified(spark, d)).withColumn("examples", F.array_join("examples", ", "))


@query("SELECT path, CASE WHEN regexp_matches(path, '(?i)[^/]\\.(kts|groovy|gvy|scala|sc)$') AND lower(path) NOT LIKE '%.gradle.kts' THEN lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) END extension FROM (SELECT 'x/f' || doc_id || ['.groovy', '.gradle.kts', '.kts', '.Scala', '.java'][doc_id % 5 + 1] path FROM documents)")
def polyglot_extension(spark, d):
    end = F.element_at(F.lit([".groovy", ".gradle.kts", ".kts", ".Scala", ".java"]), (F.col("doc_id") % 5 + 1).cast("int"))
    files = read(spark, d, "documents").select(F.concat(F.lit("x/f"), F.col("doc_id").cast("string"), end).alias("path"))
    return files.withColumn("extension", paths.polyglot_extension(F.col("path")))


@query("SELECT f.diff_id, t.fqn, t.path, count(DISTINCT f.strategy) n_strategies FROM cv_found f JOIN cv_test t ON t.fqn = f.fqn GROUP BY ALL")
def impact_flagship(spark, d):
    """All strategies over all diffs, and the tests they select."""
    rows = found(spark, d).join(tests(spark, d).select("fqn", "path"), "fqn")
    return rows.groupBy("diff_id", "fqn", "path").agg(F.count_distinct("strategy").alias("n_strategies"))


@query("SELECT * FROM cv_syntax")
def source_metadata(spark, d):
    """Metadata of made-up Java and Kotlin files, one per part, some of them broken, read from their text."""
    return syntax_corpus.shown(syntax_metadata(spark, d))


@query("SELECT CASE WHEN path LIKE '%.kt' THEN 'kt' ELSE 'java' END lang, count(*) n_files, count(*) FILTER (NOT parse_ok) n_failed FROM cv_syntax GROUP BY ALL")
def parse_failures(spark, d):
    return syntax_metadata(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("parse_ok")).alias("n_failed"))


@query("SELECT path, pkg, path_pkg FROM cv_mismatch")
def package_mismatch(spark, d):
    """Kotlin files that declare another package than their path says."""
    return source_text.path_package_mismatch(syntax_metadata(spark, d, "kt"), list(CONFIG.source_dirs)).select("path", "pkg", "path_pkg")


@query(
    """SELECT count(*) FILTER (NOT parse_ok) n_failed, count(*) FILTER (parse_ok) n_mapped, (SELECT count(*) FROM cv_mismatch) n_mismatch,
      (SELECT string_agg(pkg || '.' || primary_type, ',' ORDER BY path) FROM (SELECT * FROM cv_syntax WHERE path LIKE '%.kt' AND parse_ok ORDER BY path LIMIT 10)) mapped,
      (SELECT string_agg(path || ' ' || pkg || ' ' || path_pkg, ',' ORDER BY path) FROM (SELECT * FROM cv_mismatch ORDER BY path LIMIT 10)) mismatch FROM cv_syntax WHERE path LIKE '%.kt'"""
)
def kotlin_counters(spark, d):
    own = source_text.kotlin_counters(kept(syntax_metadata(spark, d, "kt")), list(CONFIG.source_dirs))
    said = F.transform("mismatch", lambda m: F.concat_ws(" ", m["path"], m["pkg"], m["path_pkg"]))
    return own.select("n_failed", "n_mapped", "n_mismatch", F.array_join("mapped", ",").alias("mapped"), F.array_join(said, ",").alias("mismatch"))


@query(
    """SELECT 'decl' relation, fqn a, 'Part' || (k // 7) b FROM cv_class WHERE k % 10 <> 0
      UNION ALL SELECT 'source', fqn, simple FROM cv_class
      UNION ALL SELECT 'failed', 'source', (count(*))::varchar FROM cv_class WHERE k % 10 = 0
      UNION ALL SELECT 'test', fqn, min(path) FROM cv_test WHERE c_custkey % 2 = 0 AND c_custkey % 11 <> 0 GROUP BY fqn
      UNION ALL SELECT 'import', t.fqn, 'com.used.Part' || t.c_custkey FROM cv_test t JOIN (SELECT fqn, min(path) path FROM cv_test WHERE c_custkey % 2 = 0 AND c_custkey % 11 <> 0 GROUP BY fqn) USING (fqn, path) WHERE c_custkey % 2 = 0 AND c_custkey % 11 <> 0"""
)
def index_build(spark, d):
    """Relations of the index that is built from made-up source files."""
    built = project_index.build(kept(source_files(spark, d)), CONFIG)
    parts = [
        built["decls"].select(F.lit("decl"), "fqn", "supertype"),
        built["sources"].select(F.lit("source"), "fqn", "simple"),
        built["metadata"].filter("NOT parse_ok").groupBy("kind").agg(F.count(F.lit(1)).cast("string").alias("n")).select(F.lit("failed"), "kind", "n"),
        built["tests"].select(F.lit("test"), "fqn", "path"),
        built["imports"].select(F.lit("import"), "fqn", "name"),
    ]
    return reduce(DataFrame.union, parts).toDF("relation", "a", "b")


@query(
    """SELECT 'decl' relation, fqn a, CASE WHEN k % 9 = 1 THEN 'NewPart' ELSE 'Part' END || (k // 7) b FROM cv_class WHERE k % 10 <> 0 AND k % 9 <> 2
      UNION ALL SELECT 'source', fqn, simple FROM cv_class WHERE k % 9 <> 2
      UNION ALL SELECT 'failed', 'source', (count(*))::varchar FROM cv_class WHERE k % 10 = 0 AND k % 9 <> 2"""
)
def index_refresh(spark, d):
    """Stored relations of made-up sources after a ninth of them changed and another ninth went."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    k = F.regexp_extract("path", r"Part(\d+)\.java$", 1).try_cast("int")
    first = source_files(spark, d).filter("path LIKE 'src/main/java/%'").withColumns({"mtime": F.lit(1).cast("long"), "size": F.length("content").cast("long")})
    changed = k % 9 == 1
    second = first.filter(k % 9 != 2).withColumns({"content": F.when(changed, F.replace("content", F.lit(" extends Part"), F.lit(" extends NewPart"))).otherwise(F.col("content")), "mtime": F.when(changed, 2).otherwise(1).cast("long")})
    for files in (first, second):
        stored.refresh(spark, kept(files), CONFIG, folder, buckets=8)
    own = stored.stored_index(spark, folder)
    failed = own["metadata"].filter("NOT parse_ok").groupBy("kind").agg(F.count(F.lit(1)).cast("string").alias("n"))
    parts = [own["decls"].select(F.lit("decl"), "fqn", "supertype"), own["sources"].select(F.lit("source"), "fqn", "simple"), failed.select(F.lit("failed"), "kind", "n")]
    return reduce(DataFrame.union, parts).toDF("relation", "a", "b")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
