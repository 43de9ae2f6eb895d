"""The project index: from source files to the relations that the strategies join."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkripple.functions import paths, source_text
from sparkripple.operators import selection
from sparkripple.operators.iterate import kept, spread
from sparkripple.plans import lazy
from sparkripple.plans.config import Config
from sparkripple.sources import snapshot, tree


class Index(Mapping):
    """Relations by name, each made when it is first asked for, so that a diff of tests alone parses nothing."""

    def __init__(self, makers: Mapping[str, Callable[[Index], DataFrame]]):
        self.makers, self.made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name](self)
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def located(files: DataFrame, config: Config) -> DataFrame:
    """files(path, ...) that are sources or tests in scope, with kind, fqn, simple and pkg of the path; the least path of a class name counts.

    With strict_compat a source's name begins behind the first place of its directory, at whole segments or not.
    """
    path, tests, sources = F.col("path"), list(config.test_dirs), list(config.source_dirs)
    as_test, as_source = paths.fqn_under(path, tests), paths.fqn_under(path, sources)
    rows = files.filter(paths.is_source(path) & ~paths.is_marker(path) & ~paths.in_directories(path, config.out_of_scope()))
    rows = rows.withColumns({"kind": F.when(as_test.isNotNull(), "test").when(as_source.isNotNull(), "source"), "fqn": F.coalesce(as_test, paths.fqn_after(path, sources) if config.strict_compat else as_source)}).filter("kind IS NOT NULL")
    first = rows.groupBy("kind", "fqn").agg(F.min("path").alias("path"))
    rows = rows.join(first, ["kind", "fqn", "path"], "left_semi")
    return rows.withColumns({"simple": paths.simple_name(F.col("fqn")), "pkg_of_path": paths.package_of(F.col("fqn"))})


def build(files: DataFrame, config: Config, gone: DataFrame | None = None, metadata: Callable[[DataFrame], DataFrame] | None = None) -> Index:
    """The index of files(path, content); gone(fqn) are classes that names may still mean, as deleted ones of a diff.

    metadata, if given, makes the files' metadata of located files otherwise than by
    parsing them all, as from a snapshot. Otherwise tests are parsed where usage asks for
    them, and sources, unless implementations need them all, as a search comes to them: the
    edges then are lazy.Edges. Files of a language that is switched off
    are located and have no metadata.
    """
    own = located(files, config)
    # With implementations all sources are parsed in any case, and a snapshot knows them without.
    every = metadata is not None or config.enabled("impl") and config.include_implementation_tests

    def parsed(kind: str) -> Callable[[Index], DataFrame]:
        def run(index: Index) -> DataFrame:
            if metadata:
                return index["metadata"].filter(F.col("kind") == kind)
            return kept(source_text.metadata(spread(own.filter(F.col("kind") == kind).select("path", "kind", "fqn", "pkg_of_path", "content"), "path"), config.kotlin_enabled))

        return run

    def all_parsed(index: Index) -> DataFrame:
        if metadata:
            return kept(metadata(own).join(own.select("path", "kind", "fqn", "pkg_of_path"), "path"))
        return index["test_metadata"].unionByName(index["source_metadata"])

    def good(index: Index, kind: str) -> DataFrame:
        rows = index[f"{kind}_metadata"].filter("parse_ok")
        if kind == "test":
            rows = rows.withColumn("fqn", paths.fqn_of_test(F.col("path"), list(config.test_dirs), F.col("pkg"), F.col("primary_type")))
        return rows

    def decls(index: Index) -> DataFrame:
        each = good(index, "source").select("pkg", F.explode("type_decls").alias("d"))
        name = F.when(F.col("pkg") == "", F.col("d.simple_name")).otherwise(F.concat_ws(".", "pkg", "d.simple_name"))
        return each.select(name.alias("fqn"), F.explode("d.supertypes").alias("supertype")).distinct()

    def edges(index: Index) -> DataFrame | lazy.Edges:
        known = own.filter("kind = 'source'").select("fqn")
        known = (known.union(gone.select("fqn")) if gone is not None else known).distinct()
        if not every:
            return lazy.Edges(own.filter("kind = 'source'"), known, config.kotlin_enabled)
        sources = good(index, "source")
        words = sources.select(F.col("fqn").alias("path"), F.explode("words").alias("token"))
        return kept(selection.used_by(words, selection.resolved(lazy.refs_of(sources), lazy.imports_of(sources), known)))

    return Index(
        {
            "metadata": all_parsed,
            "test_metadata": parsed("test"),
            "source_metadata": parsed("source"),
            "tests": lambda index: own.filter("kind = 'test'").select("fqn", "simple", F.col("pkg_of_path").alias("pkg"), "path"),
            "sources": lambda index: own.filter("kind = 'source'").select("fqn", "simple"),
            "imports": lambda index: lazy.imports_of(good(index, "test")),
            "simple_refs": lambda index: lazy.refs_of(good(index, "test")),
            "dotted_refs": lambda index: good(index, "test").select("fqn", F.explode("type_ref_dotted").alias("name")),
            "decls": decls,
            "edges": edges,
        }
    )


def from_tree(spark: SparkSession, root: str, config: Config, folder: str | None = None, gone: DataFrame | None = None) -> Index:
    """The index of the source tree at root; with a folder, what a snapshot there knows unchanged is neither listed nor read again, and a new one is written."""
    dirs = [*config.source_dirs, *config.test_dirs]
    stored = snapshot.load(spark, config, folder) if folder else None
    walk = kept(tree.rewalked(spark, root, stored[1]) if stored else tree.walked(spark, root))
    files = tree.files(spark, root, dirs, walk)

    def metadata(own: DataFrame) -> DataFrame:
        listed = own.select("path", "mtime", "size")
        if stored is None or not snapshot.drifted(*(tree.directories(spark, root, dirs, w) for w in (stored[1], walk))).isEmpty():
            fresh = listed
        else:
            fresh = snapshot.to_parse(stored[0], listed)
        meta = source_text.metadata(tree.texts(spread(fresh, "path"), root), config.kotlin_enabled)
        if fresh is not listed:
            meta = meta.unionByName(snapshot.reusable(stored[0], listed))
        if folder:
            meta = kept(meta)
            snapshot.write(meta, walk, config, folder)
        return meta

    return build(files, config, gone, metadata)
