"""Source and test directories from a build's source sets and test tasks, given as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(source_sets: DataFrame, test_tasks: DataFrame) -> DataFrame:
    """source_sets with task, the test task that runs their classes, null where none does.

    source_sets(project, project_dir, name, src_dirs, class_dirs), test_tasks(project,
    task, class_dirs, ord). A task runs a set if they share a class directory; one
    without class directories runs the set of its name. Of several tasks the first counts.
    """
    dirs = source_sets.select("project", "name", F.explode("class_dirs").alias("dir"))
    by_dir = test_tasks.select("project", "task", "ord", F.explode("class_dirs").alias("dir")).join(dirs, ["project", "dir"]).select("project", "name", "task", "ord")
    bare = test_tasks.filter(F.size("class_dirs") == 0).select("project", F.col("task").alias("name"), "task", "ord")
    found = by_dir.unionByName(bare).groupBy("project", "name").agg(F.min_by("task", F.struct("ord", "task")).alias("task"))
    return source_sets.join(found, ["project", "name"], "left")


def directories(source_sets: DataFrame, test_tasks: DataFrame) -> DataFrame:
    """(kind, value): source and test directories relative to their project, and test tasks, each once; directories outside their project are left out."""
    sets = paired(source_sets, test_tasks)
    each = sets.select("project_dir", "task", F.explode("src_dirs").alias("full"))
    inside = F.col("full").startswith(F.concat("project_dir", F.lit("/")))
    suffix = F.expr("substring(full, length(project_dir) + 2)")
    kind = F.when(F.col("task").isNull(), "source_dir").otherwise("test_dir")
    dirs = each.filter(inside).select(kind.alias("kind"), suffix.alias("value"))
    tasks = sets.filter("task IS NOT NULL").select(F.lit("test_task").alias("kind"), F.col("task").alias("value"))
    return dirs.unionByName(tasks).distinct()
