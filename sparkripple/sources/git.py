"""Changed files of git repositories as rows.

Repositories are asked with the git command, which must be on every executor, as the
repositories must be on storage that they mount. Many diffs are asked for where
their requests lie, so tasks share them; one diff is asked for at once.
"""

from __future__ import annotations

import subprocess
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "diff_id string, path string, change_type string"


def git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed in {repo}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout.decode(errors="surrogateescape")


def resolve_base(repo: str, base: str) -> str:
    """The base's commit: the ref itself, or the remote branch of that name."""
    for name in (base, f"refs/remotes/{base}"):
        try:
            return git(repo, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}").strip()
        except RuntimeError:
            pass
    raise RuntimeError(f"base ref {base!r} can't be resolved in {repo}")


def merge_base(repo: str, base: str, head: str = "HEAD") -> str:
    """Common ancestor of base and head; the base's tip, with a warning, if they have none."""
    try:
        return git(repo, "merge-base", base, head).strip()
    except RuntimeError:
        warnings.warn(f"no common ancestor of {base} and {head}; comparing with its tip", stacklevel=2)
        return base


def name_status(text: str) -> list[tuple[str, str]]:
    parts = text.split("\0")
    return [(path, kind[:1]) for kind, path in zip(parts[::2], parts[1::2])]


def files_of(repo: str, base: str, head: str = "HEAD", include_uncommitted: bool = False, include_staged: bool = False) -> list[tuple[str, str]]:
    """(path, change_type) of merge-base...head and, if asked, the index and the worktree, by path.

    Renames come as a deletion and an addition, so the old class counts too. A
    repository without commits has no committed changes; git's errors are raised.
    """
    git(repo, "rev-parse", "--is-inside-work-tree")
    how = ("diff", "--no-renames", "--name-status", "-z")
    try:
        git(repo, "rev-parse", "--verify", "--quiet", f"{head}^{{commit}}")
        found = name_status(git(repo, *how, merge_base(repo, resolve_base(repo, base), head), head))
    except RuntimeError:
        if git(repo, "rev-list", "--all", "--max-count=1").strip():
            raise
        found = []
    if include_uncommitted:
        found += name_status(git(repo, *how))
    if include_staged:
        found += name_status(git(repo, *how, "--cached"))
    return sorted({path: kind for path, kind in found}.items())


def changed_files(spark: SparkSession, repo: str, base: str, include_uncommitted: bool = False, include_staged: bool = False, diff_id: str = "HEAD") -> DataFrame:
    """(diff_id, path, change_type) of files_of() for one diff."""
    return spark.createDataFrame([(diff_id, p, k) for p, k in files_of(repo, base, "HEAD", include_uncommitted, include_staged)], SCHEMA)


def changed_files_of(requests: DataFrame, include_uncommitted: bool = False, include_staged: bool = False, tasks: int | None = None) -> DataFrame:
    """(diff_id, path, change_type) of files_of() for every row of requests(diff_id, repo, base, head); a null head is HEAD.

    Requests are dealt to so many tasks, the session's parallelism unless given. An error
    of git in any of them is the job's.
    """
    own = requests.select(F.col("diff_id").cast("string").alias("diff_id"), "repo", "base", F.coalesce("head", F.lit("HEAD")).alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = files_of(r["repo"], r["base"], r["head"], include_uncommitted, include_staged)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([r["diff_id"]] * len(found), [p for p, _ in found], [k for _, k in found])], ["diff_id", "path", "change_type"])

    return own.repartition(tasks or own.sparkSession.sparkContext.defaultParallelism, "diff_id").mapInArrow(run, SCHEMA)
