"""Path rules, names and log text."""

import pytest
from pyspark.sql import functions as F
from sparkripple.functions import paths
from sparkripple.plans import index
from sparkripple.plans.config import Config


def on(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p string")
    return [r[1] for r in sorted(rows.select("i", column.alias("x")).collect())]


GLOBS = ["**/generated/**", "*.md", "**/*.md", "LICENSE.*", "a/?.txt", "x[!a-c].kt", "{a,b}/**", "**", "docs/*/end", r"a\*b", "[a-c]?"]
PATHS = ["generated/A.java", "x/generated/A.java", "a.md", "b/a.md", "LICENSE.txt", "a/b.txt", "a/bc.txt", "xa.kt", "xd.kt", "a/q/r", "c/q", "docs/x/end", "docs/x/y/end", "a*b", "ab", "b/"]


def test_globs_are_the_jvms(spark):
    jvm = spark._jvm
    matcher = jvm.java.nio.file.FileSystems.getDefault()
    for glob in GLOBS:
        theirs = matcher.getPathMatcher("glob:" + glob)
        want = [bool(theirs.matches(jvm.java.nio.file.Paths.get(p, spark.sparkContext._gateway.new_array(jvm.String, 0)))) for p in PATHS if not p.endswith("/")]
        assert on(spark, paths.any_glob(F.col("p"), [glob]), [p for p in PATHS if not p.endswith("/")]) == want, glob


@pytest.mark.parametrize("glob", ["a[b", "{a", "a\\", "{a,{b}}"])
def test_bad_glob_names_its_place(glob):
    with pytest.raises(ValueError, match=r"ignore_paths\[1\]"):
        paths.any_glob(F.col, ["*.md", glob])


def bucket(spark, values, ignore=("*.md", "**/*.md"), oos=("api-test",), source=("src/main/java",), test=("src/test/java",)):
    return on(spark, paths.bucket(F.col("p"), list(ignore), list(oos), list(source), list(test)), values)


def test_buckets(spark):
    got = bucket(spark, ["README.md", "api-test-utils/src/main/java/A.java", "api-test/A.java", "m/api-test/A.java", "notsrc/main/java/A.java", "a/../src/main/java/A.java", "src/main/java/foo..bar.java", "src/main/java/module-info.java", "src/test/java/package-info.java", "src/main/java/c/K.kt", "src/test/java/c/T.JAVA", "src/main/java/.java", "a/src/main/java/x.yml"])
    assert got == ["ignored", "production", "out_of_scope", "out_of_scope", "unmapped", "unmapped", "production", "unmapped", "unmapped", "production", "test", "unmapped", "unmapped"]
    assert bucket(spark, ["api-test/A.java", "api-test-utils/src/main/java/A.java"], oos=("api-test/**",)) == ["out_of_scope", "production"]


def test_names(spark):
    assert on(spark, paths.fqn_under(F.col("p"), ["src/main/java"]), ["m/src/main/java/a/B.java", "notsrc/main/java/B.kt", "src/main/java/B.KT"]) == ["a.B", None, "B"]
    assert on(spark, paths.package_of(F.col("p")), ["a.b.C", "C", ""]) == ["a.b", "", ""]
    assert on(spark, paths.dotted_prefixes(F.col("p")), ["a.b.C"]) == [["a", "a.b", "a.b.C"]]
    assert on(spark, paths.with_facade(paths.without_extension(F.col("p")), F.col("p"), F.lit(True)), ["U.kt", "U.java"]) == [["U", "UKt"], ["U"]]
    assert on(spark, paths.is_valid_fqn(F.col("p")), ["a.B$1", "1a", "a..b", "", "a b"]) == [True, False, False, False, False]


def test_sanitized(spark):
    assert on(spark, paths.sanitized(F.col("p")), ["a\nb\r\tc\x07\x7f\x85é", "", None]) == [r"a\nb\r\tc\x07\x7F\x85é", "", "(null)"]


def test_words(spark):
    assert on(spark, paths.capitalised_words(F.col("p")), ["Foo x.Bar fooBar BAZ_1 Q$ äBc", ""]) == [["Foo", "Bar", "BAZ_1", "Q", "Bc"], []]


def test_polyglot(spark):
    assert on(spark, paths.polyglot_extension(F.col("p")), ["a.groovy", "b.gradle.kts", "c.kts", "d.SC", "e.java"]) == ["groovy", None, "kts", "sc", None]


def test_names_behind_the_first_place(spark):
    dirs = ["src/main/java", "src/main/kotlin"]
    rows = spark.createDataFrame([("mysrc/main/java/x/src/main/java/a/B.java",), ("m/src/main/kotlin/c/D.kt",), ("other/E.java",)], "path string")
    got = {tuple(r) for r in rows.select(paths.fqn_after(F.col("path"), dirs), paths.fqn_under(F.col("path"), dirs)).collect()}
    assert got == {("x.src.main.java.a.B", "a.B"), ("c.D", "c.D"), (None, None)}
    files = rows.withColumn("content", F.lit(""))
    names = lambda cfg: {r["fqn"] for r in index.located(files, cfg).collect()}
    assert names(Config(source_dirs=tuple(dirs))) == {"a.B", "c.D"} and names(Config(source_dirs=tuple(dirs), strict_compat=True)) == {"x.src.main.java.a.B", "c.D"}
