"""Paths, class names and log text as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE = r"(?i)[^/\\]\.(java|kt)$"
EXTENSION = r"(?i)\.(java|kt)$"
MARKERS = ("module-info.java", "package-info.java")
BUCKETS = ("ignored", "out_of_scope", "production", "test", "unmapped")
#: Capitalised words, bounded as by an ASCII word boundary whatever the JVM's idea of one.
CAPITALISED = r"(?<![A-Za-z0-9_])[A-Z](?:[A-Za-z0-9_$]*[A-Za-z0-9_])?(?![A-Za-z0-9_])"
IDENTIFIERS = r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*$"


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression over the whole path: * and ? stop at a slash, ** doesn't, and **/ needs its slash."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            deep = glob[i : i + 2] == "**"
            out += ".*" if deep else "[^/]*"
            i += deep
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed [ in glob {glob!r}")
            inner = glob[i + 1 : end]
            negated = inner.startswith("!")
            out += "(?!/)[" + "^" * negated + inner[negated:].replace("\\", r"\\").replace("[", r"\[").replace("^", r"\^").replace("&&", r"&\&") + "]"
            i = end
        elif c == "{":
            if depth:
                raise ValueError(f"nested {{ in glob {glob!r}")
            out, depth = out + "(?:", 1
        elif c == "}" and depth:
            out, depth = out + ")", 0
        elif c == "," and depth:
            out += "|"
        elif c == "\\":
            i += 1
            if i == len(glob):
                raise ValueError(f"nothing to escape at the end of glob {glob!r}")
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed {{ in glob {glob!r}")
    return f"^(?:{out})$"


def any_glob(path: Column, globs: list[str], knob: str = "ignore_paths") -> Column:
    """Whether any glob matches the whole path; a glob that can't be read is an error that names its place."""
    patterns = []
    for i, glob in enumerate(globs):
        try:
            patterns.append(glob_regex(glob))
        except ValueError as e:
            raise ValueError(f"{knob}[{i}]: {e}") from e
    return path.rlike("|".join(patterns)) if patterns else F.lit(False)


def in_directories(path: Column, entries: list[str], knob: str = "out_of_scope_dirs") -> Column:
    """Whether a glob entry matches, or a literal entry is the path or one of its directories, at whole segments."""
    entries = [e.strip().replace("\\", "/").strip("/") for e in entries if e and e.strip()]
    out = any_glob(path, [e for e in entries if re.search(r"[*?\[{]", e)], knob)
    for d in entries:
        if not re.search(r"[*?\[{]", d):
            out = out | (path == d) | path.startswith(f"{d}/") | path.endswith(f"/{d}") | path.contains(f"/{d}/")
    return out


def traverses(path: Column) -> Column:
    return path.rlike(r"(^|/)\.\.(/|$)")


def is_source(path: Column) -> Column:
    return path.rlike(SOURCE)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, EXTENSION, 1))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, EXTENSION, "")


def is_marker(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin(*MARKERS)


def fqn_under(path: Column, dirs: list[str]) -> Column:
    """Class name of a path below the first of dirs it holds at whole segments; null if none."""
    found = [F.nullif(F.regexp_extract(path, f"(?:^|/){re.escape(d.strip('/'))}/(.*)$", 1), F.lit("")) for d in dirs]
    rest = F.coalesce(*found) if found else F.lit(None).cast("string")
    return F.replace(without_extension(rest), F.lit("/"), F.lit("."))


def fqn_after(path: Column, dirs: list[str]) -> Column:
    """Class name of a path behind the first place of the first of dirs it holds, at whole segments or not; null if none."""
    at = [(F.instr(path, f"{d.strip('/')}/"), len(d.strip("/")) + 1) for d in dirs]
    found = [F.when(place > 0, F.substring(path, place + F.lit(length), F.length(path))) for place, length in at]
    rest = F.coalesce(*found) if found else F.lit(None).cast("string")
    return F.replace(without_extension(rest), F.lit("/"), F.lit("."))


def fqn_of_test(path: Column, dirs: list[str], pkg: Column, primary_type: Column) -> Column:
    """Class name of a test file below the deepest directory that ends with the first of dirs found above it; else package and primary type."""
    below = [F.nullif(F.regexp_extract(path, f"^.*{re.escape(d.strip('/'))}/(.*)$", 1), F.lit("")) for d in dirs]
    own = [F.replace(without_extension(b), F.lit("/"), F.lit(".")) for b in below]
    declared = F.when(pkg == "", primary_type).otherwise(F.concat(pkg, F.lit("."), primary_type))
    return F.coalesce(*own, declared)


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def package_of(fqn: Column) -> Column:
    return F.when(fqn.contains("."), F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)).otherwise("")


def without_last_segment(name: Column) -> Column:
    return F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1))


def dotted_prefixes(name: Column) -> Column:
    """All leading parts of a dotted name, itself included; turns a prefix join into an equi-join."""
    return leading(name, ".", parts(name, "."))


def parts(text: Column, separator: str) -> Column:
    """How many parts a separator of one character makes of a text."""
    return F.length(text) - F.length(F.replace(text, F.lit(separator), F.lit(""))) + 1


def leading(text: Column, separator: str, most: Column) -> Column:
    """The first part of a text, the first two with what is between, and so on to the first most."""
    return F.transform(F.sequence(F.lit(1), most), lambda i: F.call_function("substring_index", text, F.lit(separator), i))


def is_valid_fqn(fqn: Column) -> Column:
    return fqn.rlike(IDENTIFIERS)


def bucket(path: Column, ignore: list[str], out_of_scope: list[str], source_dirs: list[str], test_dirs: list[str]) -> Column:
    """The one bucket of a changed path, rules in order."""
    return (
        F.when(traverses(path), "unmapped")
        .when(any_glob(path, ignore), "ignored")
        .when(in_directories(path, out_of_scope), "out_of_scope")
        .when(~is_source(path) | is_marker(path), "unmapped")
        .when(fqn_under(path, test_dirs).isNotNull(), "test")
        .when(fqn_under(path, source_dirs).isNotNull(), "production")
        .otherwise("unmapped")
    )


def with_facade(fqn: Column, path: Column, production: Column) -> Column:
    """Class names of a changed file: a production Kotlin file also stands for its top-level facade."""
    return F.when(production & (extension(path) == "kt"), F.array(fqn, F.concat(fqn, F.lit("Kt")))).otherwise(F.array(fqn))


def polyglot_extension(path: Column) -> Column:
    """Extension of a Groovy or Scala source or a Kotlin script, build scripts excepted; null for others."""
    found = F.lower(F.regexp_extract(path, r"(?i)[^/]\.(kts|groovy|gvy|scala|sc)$", 1))
    return F.when((found != "") & ~F.lower(path).endswith(".gradle.kts"), found)


def sanitized(text: Column) -> Column:
    """Text safe for one log line: line breaks and tabs escaped, other controls as \\xHH, null as (null)."""

    def one(c: Column) -> Column:
        code = F.ascii(c)
        control = (c != "") & ((code < 32) | ((code >= 127) & (code < 160)))
        return F.when(c == "\n", r"\n").when(c == "\r", r"\r").when(c == "\t", r"\t").when(control, F.concat(F.lit(r"\x"), F.lpad(F.hex(code), 2, "0"))).otherwise(c)

    return F.coalesce(F.array_join(F.transform(F.split(text, ""), one), ""), F.lit("(null)"))


def capitalised_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0)))


def owning_test_task(path: Column, tasks: list[str]) -> Column:
    """First configured task whose source set the path lies in, else the first."""
    return F.coalesce(*(F.when(path.contains(f"/src/{t}/") | path.startswith(f"src/{t}/"), t) for t in tasks), F.lit(tasks[0]))
