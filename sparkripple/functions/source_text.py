"""Class metadata of Java and Kotlin source text.

Files are read by the grammars of java_syntax and kotlin_syntax where Spark's tasks
hold them, a batch of bounded rows and bytes at a time; each reader sees one text
and keeps nothing. A file that its grammar doesn't take is not parsed, and gives no
package, imports, declarations or references.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from sparkripple.functions import java_syntax, kotlin_syntax, paths
from sparkripple.functions.reading import SyntaxFault

READERS = {"java": java_syntax.read, "kt": kotlin_syntax.read}
#: Texts whose metadata is handed on at once.
ROWS = 256
#: Calls that reading may nest; a text that nests deeper is not parsed.
DEPTH = 5000
FOUND = "parse_ok boolean, pkg string, primary_type string, imports array<struct<name:string,is_static:boolean,is_asterisk:boolean>>, type_decls array<struct<simple_name:string,supertypes:array<string>>>, type_ref_simple array<string>, type_ref_dotted array<string>, jvm_name boolean"
NOTHING = {"parse_ok": False, "pkg": "", "primary_type": None, "imports": [], "type_decls": [], "type_ref_simple": [], "type_ref_dotted": [], "jvm_name": False}


def metadata_of(path: str, lang: str, text: str | None) -> dict:
    """Metadata of one file; parse_ok tells whether its text is of the language."""
    if text is None:
        return NOTHING
    try:
        return {"parse_ok": True, **READERS[lang](text, path.replace("\\", "/").rpartition("/")[2])}
    except (SyntaxFault, RecursionError):
        return NOTHING


def metadata(files: DataFrame, kotlin_enabled: bool = True) -> DataFrame:
    """(path, content, ...) to file metadata: the columns but content, lang, words and those of FOUND, which take the place of any of their names.

    words are the capitalised words of the whole text, comments included; jvm_name
    tells whether a Kotlin file names its facade itself.

    Files are read by the tasks that hold them, so many files that few tasks hold should be spread first. Null content counts as a failed parse; files of other languages, or Kotlin
    where it is off, are left out and are no failures.
    """
    rows = files.withColumn("lang", paths.extension(F.col("path"))).filter(F.col("lang").isin("java", *["kt"] * kotlin_enabled))
    rows = rows.withColumn("words", F.array_sort(paths.capitalised_words(F.coalesce("content", F.lit("")))))
    found: StructType = _parse_datatype_string(FOUND)
    own = [c for c in rows.columns if c not in ("content", *found.names)]
    arrow = {"parse_ok": pa.bool_(), "jvm_name": pa.bool_(), "pkg": pa.string(), "primary_type": pa.string()}
    arrow |= {"imports": pa.list_(pa.struct([("name", pa.string()), ("is_static", pa.bool_()), ("is_asterisk", pa.bool_())])), "type_decls": pa.list_(pa.struct([("simple_name", pa.string()), ("supertypes", pa.list_(pa.string()))]))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(DEPTH, sys.getrecursionlimit()))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                got = [metadata_of(*x) for x in zip(*(part.column(c).to_pylist() for c in ("path", "lang", "content")))]
                new = [pa.array([g[n] for g in got], arrow.get(n, pa.list_(pa.string()))) for n in found.names]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *new], [*own, *found.names])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in own), *found.fields]))


def path_package_mismatch(meta: DataFrame, dirs: list[str]) -> DataFrame:
    """Kotlin files whose declared package differs from the one their path says."""
    of_path = paths.package_of(paths.fqn_under(F.col("path"), dirs))
    return meta.filter((F.col("lang") == "kt") & F.col("parse_ok") & (F.col("pkg") != of_path)).select("path", "pkg", of_path.alias("path_pkg"))


def kotlin_counters(meta: DataFrame, dirs: list[str], most: int = 10) -> DataFrame:
    """One row: n_failed, n_mapped, n_mismatch of the Kotlin files, and the first names mapped and mismatches in order of their paths."""
    kotlin = meta.filter("lang = 'kt'")
    of_path = paths.package_of(paths.fqn_under(F.col("path"), dirs))
    mapped = F.when(F.col("parse_ok"), F.when(F.col("pkg") == "", F.col("primary_type")).otherwise(F.concat_ws(".", "pkg", "primary_type")))
    mismatch = F.when(F.col("parse_ok") & (F.col("pkg") != of_path), F.struct("path", "pkg", of_path.alias("path_pkg")))
    rows = kotlin.select("path", "parse_ok", mapped.alias("mapped"), mismatch.alias("mismatch"))

    def first(column: str) -> DataFrame:
        some = rows.filter(F.col(column).isNotNull()).orderBy("path").limit(most)
        return some.agg(F.transform(F.array_sort(F.collect_list(F.struct("path", F.col(column).alias("value")))), lambda x: x["value"]).alias(column))

    counts = rows.agg(F.count_if(~F.col("parse_ok")).alias("n_failed"), F.count("mapped").alias("n_mapped"), F.count("mismatch").alias("n_mismatch"))
    return counts.crossJoin(first("mapped")).crossJoin(first("mismatch"))
