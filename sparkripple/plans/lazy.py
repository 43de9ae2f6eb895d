"""Used-by edges of files that are parsed only when a search comes to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkripple.functions import paths, source_text
from sparkripple.operators import selection
from sparkripple.operators.iterate import kept, spread


def imports_of(meta: DataFrame) -> DataFrame:
    return meta.select("fqn", F.posexplode("imports").alias("ord", "i")).select("fqn", "i.*", "ord")


def refs_of(meta: DataFrame) -> DataFrame:
    return meta.select("fqn", "pkg", F.explode("type_ref_simple").alias("name"))


class Edges:
    """Edges between files(path, fqn, kind, pkg_of_path, content), made hop by hop.

    The capitalised words of all texts are written once, as postings. Each hop takes the
    files whose text names a class of its frontier, parses those that no hop parsed
    before, and resolves the names of the frontier in all of them; what is parsed is
    written and kept. known(fqn) are the classes that names may mean.
    """

    def __init__(self, files: DataFrame, known: DataFrame, kotlin_enabled: bool = True):
        self.files, self.known, self.kotlin_enabled = files, known, kotlin_enabled
        self.postings: DataFrame | None = None
        self.memo: list[DataFrame] = []

    def parsed(self) -> DataFrame:
        """Metadata of the files that were parsed so far."""
        none = source_text.metadata(self.files.limit(0).select("path", "fqn", "kind", "pkg_of_path", "content"), self.kotlin_enabled)
        return reduce(DataFrame.unionByName, self.memo) if self.memo else none

    def toward(self, frontier: DataFrame) -> DataFrame:
        """(target, fqn): files that use a class of frontier(target)."""
        if self.postings is None:
            self.postings = kept(selection.posting(self.files).repartition("token"))
        names = kept(frontier.select("target", paths.simple_name(F.col("target")).alias("name")).distinct())
        touched = kept(self.postings.join(names.select(F.col("name").alias("token")), "token", "left_semi").select("path").distinct())
        fresh = touched
        for parsed in self.memo:
            fresh = fresh.join(parsed.select("path"), "path", "left_anti")
        files = self.files.join(fresh, "path", "left_semi").select("path", "fqn", "kind", "pkg_of_path", "content")
        self.memo.append(kept(source_text.metadata(spread(files, "path"), self.kotlin_enabled)))
        meta = self.parsed().filter("parse_ok").join(touched, "path", "left_semi")
        refs = refs_of(meta).join(names.select("name"), "name", "left_semi")
        # A name counts where it stands as a capitalised word, as the postings have it.
        words = meta.select(F.col("fqn").alias("path"), F.explode("words").alias("token"))
        edges = selection.used_by(words, selection.resolved(refs, imports_of(meta), self.known))
        return edges.join(names.select(F.col("target").alias("dependency")), "dependency", "left_semi").select(F.col("dependency").alias("target"), F.col("consumer").alias("fqn"))
