"""Source trees as rows: directories and files walked, and texts read, where Spark's tasks run.

Spark's file source hides names that begin with a dot or an underscore, so trees
are walked. The driver lists the first levels only and deals the directories below
to tasks. The tree must lie on storage that every executor mounts. Links are not
followed, so nothing outside the tree is read.
"""

from __future__ import annotations

import os
import stat
import time
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkripple.functions import paths
from sparkripple.operators.iterate import kept

#: Directories without sources of the project. Fixed values.
SKIPPED = (".git", ".gradle", ".idea", ".vscode", ".cursor", "build", "out", "target", "node_modules", "dist", "coverage", ".nx", "venv", ".venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox")


#: The driver lists levels until it has so many directories to deal to tasks.
STARTS = 64
#: Ms that must lie between a directory's change and its listing for the listing to count later.
SETTLED = 2000
WALK = "path string, is_dir boolean, mtime long, size long, child_count int, stamp string, listed_at long"


def entries(full: str) -> tuple[list[os.DirEntry], list[os.DirEntry]]:
    """Directories to look into and files of a directory, links left out; none where it can't be read."""
    try:
        with os.scandir(full) as found:
            own = sorted((e for e in found if not e.is_symlink()), key=lambda e: e.name)
    except OSError:
        return [], []
    return [e for e in own if e.is_dir() and e.name not in SKIPPED], [e for e in own if e.is_file()]


def own_rows(root: str, path: str) -> tuple[list[tuple], list[str]]:
    """Rows of a directory and its sources, and its directories' paths; none of a directory that is gone."""
    full, now = os.path.join(root, path), int(time.time() * 1000)
    try:
        # Before the listing, so that what comes while it lasts is seen as a change the next time.
        info = os.stat(full)
    except OSError:
        return [], []
    dirs, files = entries(full)
    rows = [(path, True, int(info.st_mtime * 1000), 0, len(dirs) + len(files), stamp(info), now)]
    for e in files:
        if e.name.lower().endswith((".java", ".kt")) and not e.name.startswith("."):
            rows += file_rows(root, os.path.join(path, e.name))
    return rows, [os.path.join(path, e.name) for e in dirs]


def file_rows(root: str, path: str) -> list[tuple]:
    try:
        info = os.stat(os.path.join(root, path))
    except OSError:
        return []
    return [(path, False, int(info.st_mtime * 1000), info.st_size, 0, None, None)]


def stamp(info: os.stat_result) -> str:
    """Another one whenever entries of a directory come or go; the change time can't be set by hand as the other can."""
    return f"{info.st_ino}:{info.st_mtime_ns}:{info.st_ctime_ns}"


def dealt(starts: DataFrame, tasks: int, work: Callable[..., Iterator[tuple]]) -> DataFrame:
    """work(row) of each row, in so many tasks, as WALK rows handed on in bounded parts."""
    columns = [c.split()[0] for c in WALK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (row for batch in batches for start in batch.itertuples(index=False) for row in work(start))
        for part in batched(each, 10_000):
            out = pd.DataFrame(part, columns=columns)
            yield out.astype({"mtime": "Int64", "size": "Int64", "child_count": "Int32", "listed_at": "Int64"})

    return starts.repartition(tasks, "path").mapInPandas(run, WALK)


def listed(starts: DataFrame, root: str, tasks: int) -> DataFrame:
    """WALK rows of starts(path, deep): of the directory alone, with its directories as rows whose is_dir is null, or of all below it."""

    def work(start) -> Iterator[tuple]:
        todo = [start.path]
        while todo:
            rows, dirs = own_rows(root, todo.pop())
            yield from rows
            if start.deep:
                todo += dirs
            else:
                yield from ((d, None, None, None, None, None, None) for d in dirs)

    return dealt(starts, tasks, work)


def walked(spark: SparkSession, root: str) -> DataFrame:
    """All directories and sources below root as WALK rows, paths relative to it: times in ms, a directory's number of children, its stamp and when it was listed."""
    level, above = [""], []
    while level and len(level) < STARTS:
        above += level
        level = [os.path.join(d, e.name) for d in level for e in entries(os.path.join(root, d))[0]]
    starts = spark.createDataFrame([(d, False) for d in above] + [(d, True) for d in level], "path string, deep boolean")
    return listed(starts, root, len(above) + len(level)).filter("is_dir IS NOT NULL")


def rewalked(spark: SparkSession, root: str, before: DataFrame) -> DataFrame:
    """walked(), where before is an earlier walk of the same root: directories whose stamp is the same aren't listed again.

    Every directory and source known is looked up once, by its path. Directories that are
    new under one that is listed again are listed level by level, and to the end once there are
    STARTS of them. A directory that had changed within SETTLED ms of its listing may have changed once
    more in the same tick of its clock, and is listed again.
    """
    known = before.filter("is_dir").select("path", "mtime", "child_count", "stamp", "listed_at")
    tasks = spark.sparkContext.defaultParallelism + known.count() // 1000

    def look(old) -> Iterator[tuple]:
        if not inside(root, old.path):
            return
        info = os.stat(os.path.join(root, old.path))
        if stamp(info) == old.stamp and old.listed_at - max(info.st_mtime, info.st_ctime) * 1000 > SETTLED:
            yield old.path, True, old.mtime, 0, old.child_count, old.stamp, old.listed_at
            return
        rows, dirs = own_rows(root, old.path)
        yield from rows
        yield from ((d, None, None, None, None, None, None) for d in dirs)

    looked = kept(dealt(known, tasks, look))
    held = looked.filter("is_dir").join(known.select("path", "listed_at"), ["path", "listed_at"], "left_semi").select(F.col("path").alias("parent"))
    sources = before.filter("NOT is_dir").select("path").withColumn("parent", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    found = [looked.filter("is_dir IS NOT NULL"), dealt(sources.join(held, "parent", "left_semi").select("path"), tasks, lambda old: file_rows(root, old.path))]
    new = looked.filter("is_dir IS NULL").select("path").join(known, "path", "left_anti")
    while n := new.limit(STARTS).count():
        step = kept(listed(new.withColumn("deep", F.lit(n == STARTS)), root, tasks))
        found.append(step.filter("is_dir IS NOT NULL"))
        new = step.filter("is_dir IS NULL").select("path")
    return reduce(DataFrame.union, found)


def inside(root: str, path: str) -> bool:
    """Whether all of path below root are directories and no links."""
    parts = path.split("/") if path else []
    try:
        return all(stat.S_ISDIR(os.lstat(os.path.join(root, *parts[: i + 1])).st_mode) for i in range(len(parts))) and os.path.isdir(root)
    except OSError:
        return False


def below(path: Column, dirs: list[str]) -> Column:
    """The first of dirs that the path lies in, at whole segments; null if none."""
    return F.coalesce(*(F.when(F.concat(F.lit("/"), path).contains(f"/{d.strip('/')}/"), d) for d in dirs), F.lit(None).cast("string"))


def files(spark: SparkSession, root: str, dirs: list[str], walk: DataFrame | None = None) -> DataFrame:
    """(path, dir, mtime, size) of the sources below any of dirs, wherever these lie; walk is walked(), if that is written already."""
    return (walked(spark, root) if walk is None else walk).filter("NOT is_dir").select("path", below(F.col("path"), dirs).alias("dir"), "mtime", "size").filter("dir IS NOT NULL")


def roots(spark: SparkSession, root: str, rel: str, strict_compat: bool = False) -> DataFrame:
    """(path): directories at any depth that end with rel; with strict_compat none below another."""
    found = walked(spark, root).filter("is_dir").select("path").filter(F.concat(F.lit("/"), "path").endswith(f"/{rel.strip('/')}"))
    return found.filter(below(F.col("path"), [rel]).isNull()) if strict_compat else found


def scan(spark: SparkSession, root: str, dirs: list[str]) -> DataFrame:
    """(path, fqn, simple, pkg, dir, mtime, size), one row per class name: the first directory's, then the least path."""
    rows = files(spark, root, dirs)
    rows = rows.withColumn("fqn", paths.fqn_under(F.col("path"), dirs)).withColumns({"simple": paths.simple_name(F.col("fqn")), "pkg": paths.package_of(F.col("fqn"))})
    order = F.array_position(F.lit(list(dirs)), F.col("dir"))
    first = F.row_number().over(Window.partitionBy("fqn").orderBy(order, "path"))
    return rows.withColumn("n", first).filter("n = 1").drop("n")


def texts(files: DataFrame, root: str) -> DataFrame:
    """files with content; null where a file can't be read."""

    def read(path: str) -> str | None:
        try:
            with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                return f.read()
        except OSError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(content=[read(p) for p in batch["path"]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInPandas(run, f"{fields}, content string")


def directories(spark: SparkSession, root: str, dirs: list[str], walk: DataFrame | None = None) -> DataFrame:
    """(path, mtime, child_count) of every directory in or below dirs, to tell whether a snapshot still holds."""
    inside = below(F.concat("path", F.lit("/")), dirs).isNotNull()
    return (walked(spark, root) if walk is None else walk).filter("is_dir").filter(inside).select("path", "mtime", "child_count")
