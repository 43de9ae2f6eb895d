"""The index's relations as stored tables that follow the changed files.

Every relation has the path that its rows come from and lies in bucket folders by
a hash of it, so what a file gave can be taken back, and a refresh reads and writes
the buckets of changed files only. Rows are what the files say and nothing
summed up, but for edges: what a name means depends on which classes there are, so
where classes come or go, the files that name them are resolved again, changed or
not. The files' own table is written last: a refresh that fails is found to do again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkripple.functions import paths, source_text
from sparkripple.operators import selection
from sparkripple.operators.iterate import kept, spread
from sparkripple.plans.config import Config
from sparkripple.plans.index import located
from sparkripple.sources.snapshot import clear, renamed

BUCKETS = 64
#: What files say, each relation with its columns beside path.
PER_FILE = {
    "imports": "fqn string, name string, is_static boolean, is_asterisk boolean, ord int",
    "simple_refs": "fqn string, pkg string, name string",
    "dotted_refs": "fqn string, name string",
    "decls": "fqn string, supertype string",
    "source_imports": "fqn string, name string, is_static boolean, is_asterisk boolean, ord int",
    "source_refs": "fqn string, pkg string, name string",
    "postings": "fqn string, token string",
}
FILES = "path string, kind string, fqn string, simple string, pkg_of_path string, mtime long, size long, parse_ok boolean, words array<string>"
EDGES = "consumer string, dependency string"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")


def said_by(meta: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The PER_FILE relations of parsed files (path, kind, fqn, and what metadata finds)."""
    good = meta.filter("parse_ok")
    tests, sources = good.filter("kind = 'test'"), good.filter("kind = 'source'")
    tests = tests.withColumn("fqn", paths.fqn_of_test(F.col("path"), list(config.test_dirs), F.col("pkg"), F.col("primary_type")))
    each = sources.select("path", "pkg", F.explode("type_decls").alias("d"))
    name = F.when(F.col("pkg") == "", F.col("d.simple_name")).otherwise(F.concat_ws(".", "pkg", "d.simple_name"))
    imports = lambda rows: rows.select("path", "fqn", F.posexplode("imports").alias("ord", "i")).select("path", "fqn", "i.*", "ord")
    refs = lambda rows: rows.select("path", "fqn", "pkg", F.explode("type_ref_simple").alias("name"))
    return {
        "imports": imports(tests),
        "simple_refs": refs(tests),
        "dotted_refs": tests.select("path", "fqn", F.explode("type_ref_dotted").alias("name")),
        "decls": each.select("path", name.alias("fqn"), F.explode("d.supertypes").alias("supertype")).distinct(),
        "source_imports": imports(sources),
        "source_refs": refs(sources),
        "postings": sources.select("path", "fqn", F.explode("words").alias("token")),
    }


def table(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    """A stored relation; no rows where none is written yet."""
    schema = columns if columns.startswith("path ") else f"path string, {columns}"
    try:
        return spark.read.schema(f"{schema}, bucket int").parquet(f"{folder}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], f"{schema}, bucket int")
        raise


def touched_by(dirty: DataFrame, buckets: int) -> list[int]:
    return [r["bucket"] for r in dirty.select(bucket_of(buckets).alias("bucket")).distinct().collect()]  # at most so many numbers


def replace(spark: SparkSession, folder: str, name: str, columns: str, dirty: DataFrame, touched: list[int], rows: DataFrame, buckets: int) -> None:
    """Put rows in place of what the relation holds of the dirty(path) files; only their buckets, the touched ones, are read and written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    home, aside = f"{folder}/{name}", f"{folder}/.{name}-{uuid.uuid4().hex}"
    files = jvm.org.apache.hadoop.fs.Path(home).getFileSystem(conf)
    first = not files.exists(jvm.org.apache.hadoop.fs.Path(home))
    rows = rows.withColumn("bucket", bucket_of(buckets))
    if not first:
        rows = rows.unionByName(table(spark, folder, name, columns).filter(F.col("bucket").isin(touched)).join(dirty.select("path"), "path", "left_anti"))
    rows.repartition("bucket").write.partitionBy("bucket").parquet(home if first else aside)
    if first:
        return
    made = {s.getPath().getName() for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(aside))}
    for b in touched:
        clear(spark, f"{home}/bucket={b}")
        if f"bucket={b}" in made:
            renamed(spark, f"{aside}/bucket={b}", f"{home}/bucket={b}")
    clear(spark, aside)


def refresh(spark: SparkSession, files: DataFrame, config: Config, folder: str, buckets: int = BUCKETS) -> DataFrame:
    """Bring the tables in folder up to files(path, content, mtime, size) and return the (path) of files that were read or are gone.

    The first refresh of an empty folder writes all; the number of buckets is the folder's from then on. Only content of files that are new,
    of another time or size, or were not parsed is looked at.
    """
    own = kept(located(files, config).select("path", "kind", "fqn", "simple", "pkg_of_path", "mtime", "size"))
    old = table(spark, folder, "files", FILES)
    same = ["path", "kind", "fqn", "mtime", "size"]
    fresh = own.join(old.filter("parse_ok").select(*same), same, "left_anti")
    meta = kept(source_text.metadata(spread(fresh.join(files.select("path", "content"), "path"), "path"), config.kotlin_enabled))
    gone = old.select("path").join(own.select("path"), "path", "left_anti")
    dirty = kept(meta.select("path").union(gone).union(fresh.select("path")).distinct())
    touched = touched_by(dirty, buckets)
    if not touched:
        return dirty
    known_before = kept(old.filter("kind = 'source'").select("fqn").distinct())
    for name, rows in said_by(meta, config).items():
        replace(spark, folder, name, PER_FILE[name], dirty, touched, rows, buckets)
    known = kept(own.filter("kind = 'source'").select("fqn").distinct())
    changed = known.join(known_before, "fqn", "left_anti").union(known_before.join(known, "fqn", "left_anti"))
    names = changed.select(paths.simple_name(F.col("fqn")).alias("name")).distinct()
    refs = table(spark, folder, "source_refs", PER_FILE["source_refs"])
    again = kept(refs.join(names, "name", "left_semi").select("path").union(dirty.select("path")).distinct())
    part = lambda name: table(spark, folder, name, PER_FILE[name]).join(again, "path", "left_semi")
    words = part("postings").select(F.col("fqn").alias("path"), "token")
    edges = selection.used_by(words, selection.resolved(part("source_refs"), part("source_imports"), known))
    place = part("source_refs").select("path", F.col("fqn").alias("consumer")).distinct()
    replace(spark, folder, "edges", EDGES, again, touched_by(again, buckets), edges.join(place, "consumer").select("path", "consumer", "dependency"), buckets)
    # Files that no reader is for are located, and have no metadata.
    unread = fresh.join(meta.select("path"), "path", "left_anti").withColumns({"parse_ok": F.lit(None).cast("boolean"), "words": F.lit(None).cast("array<string>")})
    columns = [c.split()[0] for c in FILES.split(", ")]
    replace(spark, folder, "files", FILES, dirty, touched, reduce(DataFrame.unionByName, (rows.select(*columns) for rows in (meta, unread))), buckets)
    return dirty


def stored_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The relations that the engine joins, as the last refresh left them; nothing is parsed."""
    files = table(spark, folder, "files", FILES)
    own = {name: table(spark, folder, name, columns).drop("path", "bucket") for name, columns in PER_FILE.items()}
    return {
        "metadata": files.filter("parse_ok IS NOT NULL").select("path", "kind", "fqn", "parse_ok", "words"),
        "tests": files.filter("kind = 'test'").select("fqn", "simple", F.col("pkg_of_path").alias("pkg"), "path"),
        "sources": files.filter("kind = 'source'").select("fqn", "simple"),
        "edges": table(spark, folder, "edges", EDGES).select("consumer", "dependency").distinct(),
        **{name: own[name] for name in ("imports", "simple_refs", "dotted_refs")},
        "decls": own["decls"].distinct(),
    }


def store_keys(index: dict[str, DataFrame], name: str, buckets: int) -> DataFrame:
    """Write the usage keys of an index as a table (fqn, key), bucketed and sorted by key, for index["keys"].

    Classes that are looked up are then dealt to the buckets and the keys stay where they
    are. Where there are few wanted and many keys, Spark's runtime filter puts a Bloom
    filter of the wanted ones on the scan (spark.sql.optimizer.runtime.bloomFilter.*).
    """
    keys = selection.usage_keys(index["imports"], index["simple_refs"], index["dotted_refs"]).select("fqn", "key").distinct()
    keys.repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").format("parquet").saveAsTable(name)
    return keys.sparkSession.table(name)
