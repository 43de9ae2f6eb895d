"""Strategies, decisions and reports on small trees."""

import json

import pytest
from pyspark.sql import functions as F
from sparkripple.functions import paths, source_text
from sparkripple.operators import dispatch, selection
from sparkripple.plans import config as settings
from sparkripple.plans import engine, index, report
from sparkripple.plans.config import DEFAULTS, SITUATIONS, Config
from sparkripple.sources import snapshot


def tree(spark, files, cfg=None, gone=("gone.Gone",)):
    """The index of a tree of path: text."""
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    return index.build(rows, cfg or Config(), spark.createDataFrame([(x,) for x in gone], "fqn string"))


def src(name, body, pkg="com.example"):
    return f"src/main/java/{pkg.replace('.', '/')}/{name}.java", f"package {pkg};\n{body}"


def test(name, body, pkg="com.example"):
    return f"src/test/java/{pkg.replace('.', '/')}/{name}.java", f"package {pkg};\n{body}"


test.__test__ = False


def run(spark, files, changed, cfg=None, **more):
    files, cfg = dict(files), cfg or Config()
    diff = spark.createDataFrame([("d", p) for p in changed], "diff_id string, path string")
    decisions, selected = engine.analyse(diff, tree(spark, files, cfg), cfg, **more)
    return decisions.collect()[0], {r["fqn"].rpartition(".")[2] for r in selected.collect()}


GREETERS = [
    src("Greeter", "public interface Greeter { String hi(); }"),
    src("EnglishGreeter", "public class EnglishGreeter implements Greeter { public String hi() { return \"Hi\"; } }"),
    src("GreetService", "public class GreetService { private final Greeter greeter; }"),
    test("EnglishGreeterTest", "class EnglishGreeterTest { EnglishGreeter g; }"),
    test("GreetServiceTest", "class GreetServiceTest { GreetService s = new GreetService(new EnglishGreeter()); }"),
    test("GreeterContractTest", "abstract class GreeterContractTest { abstract Greeter create(); }"),
]


def test_all_strategies(spark):
    decision, found = run(spark, GREETERS, [GREETERS[0][0]])
    assert found == {"EnglishGreeterTest", "GreetServiceTest", "GreeterContractTest"}
    assert (decision["situation"], decision["action"], decision["n_selected"]) == ("DISCOVERY_SUCCESS", "SELECTED", 3)
    _, found = run(spark, GREETERS, [GREETERS[0][0]], Config(strategies=("usage", "implementation")))
    assert found == {"GreeterContractTest"}
    _, found = run(spark, GREETERS, [GREETERS[0][0]], Config(strategies=("usage", "impl")))
    assert found == {"EnglishGreeterTest", "GreetServiceTest", "GreeterContractTest"}


def test_transitive_depth(spark):
    files = [src("A", "class A { B b; }"), src("B", "class B { C c; }"), src("C", "class C { }"), *(test(f"{x}Test", f"class {x}Test {{ }}") for x in "ABC")]
    for depth, want in ((0, {"CTest"}), (1, {"CTest", "BTest"}), (2, {"CTest", "BTest", "ATest"})):
        assert run(spark, files, [files[2][0]], Config(strategies=("naming", "transitive"), transitive_depth=depth))[1] == want


def test_deleted_class_reaches_consumers(spark):
    files = [src("User", "import gone.Gone;\nclass User { Gone g; }"), test("UserTest", "class UserTest { }")]
    assert run(spark, files, ["src/main/java/gone/Gone.java"], Config(strategies=("transitive",)))[1] == {"UserTest"}


@pytest.mark.parametrize(
    ("body", "pkg", "hit"),
    [
        ("import com.example.Bar;\nclass T { }", "o", True),
        ("class T { Bar b; }", "com.example", True),
        ("class T { Bar b; }", "o", False),
        ("import com.example.*;\nclass T { java.util.List<Bar> b; }", "o", True),
        ("import com.example.*;\nclass T { Other b; }", "o", False),
        ("import com.example.Bar.*;\nclass T { }", "o", True),
        ("import static com.example.Bar.helper;\nclass T { }", "o", True),
        ("import static com.example.Bar.*;\nclass T { }", "o", True),
        ("import com.example.Bar.Inner;\nclass T { }", "o", True),
        ("class T { com.example.Bar b; }", "o", True),
        ("class T { com.example.Bar.Inner b; }", "o", True),
        ("import com.example.BarException;\nclass T { BarException b; }", "o", False),
        ("class T { Object b = new Bar(); }", "com.example", True),
        ("class T { /* Bar */ String s = \"Bar\"; // Bar\n }", "com.example", False),
    ],
)
def test_usage(spark, body, pkg, hit):
    files = [src("Bar", "class Bar { }"), test("T", body, pkg)]
    assert run(spark, files, [files[0][0]], Config(strategies=("usage",)))[1] == ({"T"} if hit else set())


def test_implementations(spark):
    files = [
        src("Foo", "interface Foo { }"),
        src("DefaultFoo", "class DefaultFoo { }"),
        src("RecordFoo", "record RecordFoo(int x) implements Foo { }"),
        src("EnumFoo", "enum EnumFoo implements java.io.Serializable, Foo { A }"),
        src("Child", "class Child extends RecordFoo { }"),
        src("Generic", "class Generic<T extends Comparable<T>> extends Base<Foo> { }"),
        *(test(f"{x}Test", f"class {x}Test {{ }}") for x in ("DefaultFoo", "RecordFoo", "EnumFoo", "Child", "Generic")),
    ]
    assert run(spark, files, [files[0][0]], Config(strategies=("naming", "impl")))[1] == {"DefaultFooTest", "RecordFooTest", "EnumFooTest", "ChildTest"}


def test_naming_and_kotlin_facade(spark):
    files = [src("Foo", "class Foo { }"), *(test(f"Foo{s}", "class X { }", f"p{i}") for i, s in enumerate(("Test", "IT", "ITTest", "IntegrationTest", "Spec"))), test("UtilKtTest", "class UtilKtTest { }"), test("UtilKtKtTest", "class UtilKtKtTest { }")]
    only = Config(strategies=("naming",))
    assert run(spark, files, [files[0][0]], only)[1] == {"FooTest", "FooIT", "FooITTest", "FooIntegrationTest"}
    assert run(spark, files, ["src/main/java/com/example/Util.kt"], only)[1] == {"UtilKtTest"}


CANNED = {
    "EMPTY_DIFF": ([], {}),
    "ALL_FILES_IGNORED": (["docs/a.md"], {}),
    "ALL_FILES_OUT_OF_SCOPE": (["api-test/A.java", "x.md"], {"out_of_scope_test_dirs": ("api-test/**",)}),
    "UNMAPPED_FILE": (["src/main/resources/application.yml", GREETERS[0][0]], {}),
    "DISCOVERY_EMPTY": (["src/main/java/com/example/Lonely.java"], {}),
    "DISCOVERY_SUCCESS": ([GREETERS[0][0]], {}),
    "DISCOVERY_INCOMPLETE": ([GREETERS[0][0]], {}),
}


def test_situations_and_modes(spark):
    own = tree(spark, dict(GREETERS))
    diff = lambda s: spark.createDataFrame([("d", p) for p in CANNED[s][0]], "diff_id string, path string")
    broken = spark.createDataFrame([("d", 1)], "diff_id string, n_failed int")
    for situation, (_, knobs) in CANNED.items():
        config = Config(mode="CI", **knobs)
        decision = engine.analyse(diff(situation), own, config, diffs=spark.createDataFrame([("d",)], "diff_id string"), failures=broken if situation == "DISCOVERY_INCOMPLETE" else None)[0].collect()[0]
        assert (decision["situation"], decision["action"]) == (situation, DEFAULTS[situation][1])
        assert decision["run_all"] == (decision["action"] == "FULL_SUITE") == (decision["escalation_reason"] != "NONE")
    for i, mode in enumerate(("LOCAL", "CI", "STRICT")):
        got = {r["situation"]: r["action"] for r in Config(mode=mode).action_matrix(spark).collect()}
        assert got == {s: DEFAULTS[s][i] for s in SITUATIONS}


def test_explicit_action_beats_mode(spark):
    config = Config(mode="STRICT", on={"UNMAPPED_FILE": "selected"})
    diff = spark.createDataFrame([("d", "a.yml"), ("d", GREETERS[0][0])], "diff_id string, path string")
    decision = engine.analyse(diff, tree(spark, dict(GREETERS)), config)[0].collect()[0]
    assert (decision["situation"], decision["outcome"]) == ("DISCOVERY_SUCCESS", "SELECTED")


def test_test_only_diff(spark):
    decision, found = run(spark, GREETERS, [GREETERS[3][0], "src/test/java/com/example/GoneTest.java"])
    assert found == {"EnglishGreeterTest"} and decision["situation"] == "DISCOVERY_SUCCESS"


def test_config_rules():
    assert Config(transitive_depth=9).transitive_depth == 5 and len(Config().ignore_paths) == 21
    assert settings.effective_mode("AUTO", {"TF_BUILD": "x"}) == "CI" and settings.effective_mode("AUTO", {"CI": " "}) == "LOCAL"
    for bad in ({"mode": "fast"}, {"base_ref": "a\nb"}, {"base_ref": " "}, {"test_task_names": ("a:b",)}, {"timeout_seconds": -1}, {"on": {"EMPTY_DIFF": "maybe"}}):
        with pytest.raises(ValueError):
            Config(**bad)
    for good in ("master", "origin/master", "HEAD~2", "v1.0^", "abcdef1"):
        assert Config(base_ref=good)
    with pytest.raises(ValueError, match="on_discovery_empty"):
        settings.from_knobs({"run_all_if_no_matches": True})
    assert settings.boolean("Off") is False and settings.boolean("yes") is True
    with pytest.warns(UserWarning, match="no boolean"):
        assert settings.boolean("maybe") is True


def test_modules_and_tasks(spark):
    files = spark.createDataFrame([("d", "a.T1", "api/src/test/java/a/T1.java"), ("d", "a.T2", "api/v1/src/it/java/a/T2.java"), ("d", "a.T3", "apix/src/test/java/a/T3.java"), ("d", "bad name", "src/test/java/bad name.java")], "diff_id string, fqn string, path string")
    modules = spark.createDataFrame([("api", ":api"), ("api/v1", ":api:v1")], "dir string, gradle_path string")
    routes = dispatch.routed(files, modules, ["test", "it"])
    assert {r["fqn"]: r["task_key"] for r in routes.collect()} == {"a.T1": ":api:test", "a.T2": ":api:v1:it", "a.T3": ":test", "bad name": ":test"}
    assert {(r["task_key"], r["n_tests"], r["place"], r["fqn"]) for r in dispatch.plan(routes).collect()} == {(":api:test", 1, 1, "a.T1"), (":api:v1:it", 1, 1, "a.T2"), (":test", 1, 1, "a.T3")}
    deep = "/".join(f"d{i}" for i in range(100))
    far = spark.createDataFrame([("d", "a.T", f"{deep}/src/test/java/a/T.java")], "diff_id string, fqn string, path string")
    assert dispatch.routed(far, spark.createDataFrame([(deep, ":deep")], "dir string, gradle_path string"), ["test"]).first()["task_key"] == ":deep:test"
    ordered = spark.createDataFrame([("d", ":test", f"a.T{9 - i}", i) for i in range(8)], "diff_id string, task_key string, fqn string, ord int")
    assert [(r["fqn"], r["remaining"]) for r in dispatch.preview(ordered).orderBy("place").collect()] == [(f"a.T{9 - i}", 3) for i in range(5)]


NO_MODULES = "dir string, gradle_path string"


def test_reports(spark):
    diff = spark.createDataFrame([("d", GREETERS[0][0]), ("d", "x.md")], "diff_id string, path string")
    config = Config(mode="LOCAL", out_of_scope_test_dirs=("api-test",))
    own = tree(spark, dict(GREETERS))
    trace = engine.trace(diff, own, config)
    assert report.summary(trace.decisions).first()["line"] == "Impacted Tests: SELECTED (DISCOVERY_SUCCESS) — 2 changed file(s), 1 production class(es), 3 test class(es) affected"
    routes = dispatch.routed(trace.chosen(), spark.createDataFrame([], NO_MODULES), ["test"])
    profile = trace.profile
    assert [(r["strategy"], r["ord"]) for r in profile.collect()] == [(s, i) for i, s in enumerate(settings.STRATEGIES)] and profile.filter("strategy = 'impl'").first()["tests"] == 2
    lines = [r["line"] for r in report.explain(trace.decisions, trace.classified, routes, config, found=trace.found, profile=profile).orderBy("line_no").collect()]
    assert "Changed files:   2" in lines and "  ignored sample: x.md" in lines and "  DISCOVERY_EMPTY          SKIPPED [MODE_DEFAULT]" in lines
    assert "Modules:         1 module, 3 test classes to dispatch" in lines and "  :test (3 test classes)" in lines and "    com.example.GreetServiceTest" in lines
    assert any(x.startswith("Hint: out_of_scope_test_dirs (1 in all)") for x in lines)
    block = lines[[x.startswith("Discovery:") for x in lines].index(True) :][:5]
    assert block[0].startswith("Discovery:       serial (") and [x.split()[0] for x in block[1:]] == list(settings.STRATEGIES) and "(2 tests" in block[3]


def test_hints(spark):
    """Lines per situation, of cross-package matches, unread languages and Kotlin sources."""
    config = Config(mode="CI")
    files = [src("Foo", "class Foo { }"), *(test("FooTest", "class FooTest { }", f"p{i:02}") for i in range(12)), ("src/main/java/com/example/K.kt", "package other\nclass K"), ("src/main/java/com/example/Bad.kt", "package com.example\nclass Bad {")]
    diff = [("cross", files[0][0]), ("empty", "src/main/java/com/example/None.java"), ("odd", "a/b.scala"), ("odd", "c.groovy"), ("odd", "build.gradle.kts"), ("odd", "z/K.kt"), ("kt", "src/main/java/com/example/K.kt")]
    only = Config(mode="CI", strategies=("naming",))
    own = tree(spark, dict(files), only)
    trace = engine.trace(spark.createDataFrame(diff, "diff_id string, path string"), own, only)
    cross = engine.cross_package(trace.classes, trace.chosen(), own, only)
    kotlin = source_text.kotlin_counters(own["metadata"], ["src/main/java"])
    routes = dispatch.routed(trace.chosen(), spark.createDataFrame([], NO_MODULES), ["test"])
    lines = {}
    for r in report.explain(trace.decisions, trace.classified, routes, config, cross=cross, kotlin=kotlin).orderBy("line_no").collect():
        lines.setdefault(r["diff_id"], []).append(r["line"])
    assert "Hint: naming selected 12 tests of another package than the changed class; the names may meet by chance." in lines["cross"]
    assert "  * com.example.Foo → p00.FooTest" in lines["cross"] and "  … (+2 more)" in lines["cross"]
    assert "    … and 7 more" in lines["cross"] and "Hint: Kotlin source read as other.K." in lines["cross"]
    assert "Hint: no test found for 1 changed production file; it may be that" in lines["empty"] and "  * the test lies outside src/test/java" in lines["empty"]
    assert "Hint: Kotlin file src/main/java/com/example/K.kt declares package other, its path says com.example; naming goes by the path, other strategies by the declaration." in lines["kt"]
    assert "Hint: a Kotlin file could not be parsed; it counts towards DISCOVERY_INCOMPLETE." in lines["kt"]
    assert [x for x in lines["odd"] if x.startswith("Hint")] == ["Hint: .groovy files are known by their path alone; no strategy reads them.", "Hint: .scala files are known by their path alone; no strategy reads them.", "Hint: a Kotlin source lies in no source or test directory and is unmapped."]
    off = Config(mode="CI", kotlin_enabled=False, strategies=("naming",))
    told = [r["line"] for r in report.explain(trace.decisions, trace.classified, routes, off, kotlin=kotlin).filter("diff_id = 'kt'").collect()]
    assert "Hint: Kotlin sources are known by their path alone, their text is not read." in told
    counters = kotlin.first()
    assert (counters["n_failed"], counters["n_mapped"], counters["n_mismatch"]) == (1, 1, 1)


def test_unparsed_files_that_strategies_touch(spark):
    """Which of two unparsed sources and one unparsed test count, by the strategies that are on."""
    files = [*GREETERS, src("Broken", "class Broken { Greeter g;"), src("Apart", "class Apart { (")] + [test("BrokenTest", "class BrokenTest {")]
    changed = [GREETERS[0][0]]
    for strategies, failed in ((("naming",), 0), (("usage",), 1), (("impl",), 2), (("usage", "impl"), 3), (("transitive",), 2), (("naming", "usage", "impl", "transitive"), 3)):
        cfg = Config(mode="LOCAL", strategies=strategies)
        decision, found = run(spark, files, changed, cfg)
        assert (decision["n_failed"], decision["situation"]) == (failed, "DISCOVERY_INCOMPLETE" if failed else "DISCOVERY_SUCCESS" if found else "DISCOVERY_EMPTY"), strategies
    decision, _ = run(spark, files, changed, Config(mode="CI"))
    assert (decision["action"], decision["escalation_reason"]) == ("FULL_SUITE", "RUN_ALL_ON_DISCOVERY_INCOMPLETE")
    local = Config(mode="LOCAL")
    trace = engine.trace(spark.createDataFrame([("d", changed[0])], "diff_id string, path string"), tree(spark, dict(files)), local)
    assert report.warnings(trace.decisions, local).first()["line"].startswith("partial selection of 3 test classes: ") and report.warnings(trace.decisions, Config(mode="CI")).isEmpty()
    lines = [r["line"] for r in report.explain(trace.decisions, trace.classified, dispatch.routed(trace.chosen(), spark.createDataFrame([], NO_MODULES), ["test"]), local).collect()]
    assert any("the selection lacks their tests" in x for x in lines)


def test_out_of_scope_and_markers_are_not_indexed(spark):
    cfg = Config(out_of_scope_test_dirs=("api-test",), out_of_scope_source_dirs=("old/**",))
    files = [*GREETERS, ("api-test/src/test/java/a/ApiTest.java", "package a; class ApiTest { }"), ("old/src/main/java/a/Old.java", "package a; class Old { }"), ("src/main/java/a/package-info.java", "package a;"), ("b/src/main/java/com/example/Greeter.java", "package com.example; class Greeter { }")]
    own = tree(spark, dict(files), cfg)
    assert {r["fqn"] for r in own["tests"].collect()} == {f"com.example.{x}" for x in ("EnglishGreeterTest", "GreetServiceTest", "GreeterContractTest")}
    assert sorted(r["fqn"] for r in own["sources"].collect()) == [f"com.example.{x}" for x in ("EnglishGreeter", "GreetService", "Greeter")]
    assert own["metadata"].filter("fqn = 'com.example.Greeter'").first()["path"] == "b/src/main/java/com/example/Greeter.java"


def test_diff_of_tests_alone_parses_nothing(spark):
    own = tree(spark, dict(GREETERS))
    diff = spark.createDataFrame([("d", GREETERS[3][0]), ("e", "src/test/java/com/example/GoneTest.java")], "diff_id string, path string")
    decisions, selected = engine.analyse(diff, own, Config(mode="CI"))
    assert {r["diff_id"]: r["situation"] for r in decisions.collect()} == {"d": "DISCOVERY_SUCCESS", "e": "DISCOVERY_EMPTY"}
    assert [r["fqn"] for r in selected.collect()] == ["com.example.EnglishGreeterTest"] and set(own.made) == {"tests"}


def test_class_name_of_a_test_file(spark):
    rows = [("a/src/test/java/x/src/test/java/y/T.java", "p", "T"), ("odd/place/T.kt", "p.q", "T"), ("odd/T.java", "", "T"), ("nosrc/test/java/z/U.java", "p", "U")]
    df = spark.createDataFrame(rows, "path string, pkg string, primary_type string")
    got = [r[0] for r in df.select(paths.fqn_of_test(F.col("path"), ["src/test/java"], F.col("pkg"), F.col("primary_type"))).collect()]
    assert got == ["y.T", "p.q.T", "T", "z.U"]


def test_settings_hash_of_rows(spark):
    cfg = Config(source_dirs=("z", "a"), out_of_scope_test_dirs=("q", "b"), kotlin_enabled=False)
    arrays = [F.lit(list(x)).cast("array<string>") for x in (cfg.source_dirs, cfg.test_dirs, cfg.out_of_scope_source_dirs, cfg.out_of_scope_test_dirs)]
    assert spark.range(1).select(snapshot.hash_of(*arrays, F.lit(False)).alias("h")).first()["h"] == snapshot.config_hash(cfg)


def test_json(spark):
    diff = spark.createDataFrame([("d", GREETERS[0][0]), ("d", "x.md"), ("m", "x.md")], "diff_id string, path string")
    config = Config(mode="LOCAL")
    own = tree(spark, dict(GREETERS))
    trace = engine.trace(diff, own, config)
    routes = dispatch.routed(trace.chosen(), spark.createDataFrame([], NO_MODULES), ["test"])
    got = {r["diff_id"]: json.loads(r["json"]) for r in report.explain_json(trace.decisions, trace.classified, routes, trace.found, config, profile=trace.profile).collect()}
    body = got["d"]
    assert list(body) == ["version", "baseRef", "mode", "changedFiles", "buckets", "samples", "situation", "action", "outcome", "modules", "discovery", "actionMatrix"]
    assert body["version"] == 2 and body["mode"] == {"configured": "LOCAL", "effective": "LOCAL"} and body["samples"] == {"ignored": ["x.md"], "production": [GREETERS[0][0]]}
    assert body["outcome"] == {"kind": "SELECTED", "selectedClassCount": 3, "escalationReason": "NONE"} and body["action"] == {"name": "SELECTED", "source": "EXPLICIT"}
    assert [m["task"] for m in body["modules"]] == [":test"] and len(body["modules"][0]["fqns"]) == 3
    counts = {r["strategy"]: r["n_tests"] for r in engine.strategy_counts(trace.found).collect()}
    assert [(x["name"], x["tests"]) for x in body["discovery"]["perStrategy"]] == [(s, counts.get(s, 0)) for s in settings.STRATEGIES] and counts
    assert body["discovery"]["totalMillis"] == sum(x["millis"] for x in body["discovery"]["perStrategy"]) > 0 and body["discovery"]["concurrencyLevel"] > 0
    assert body["actionMatrix"] == {s: dict(zip(("action", "source"), config.action(s, "LOCAL"))) for s in SITUATIONS}
    assert got["m"]["modules"] == [] and got["m"]["discovery"] == {"parallelEnabled": False, "concurrencyLevel": 0, "totalMillis": 0, "perStrategy": []} and got["m"]["situation"] == "ALL_FILES_IGNORED"


def test_search_parses_what_it_comes_to(spark):
    """Of fifty sources, those that name a class of a frontier are parsed, each once, and unparsed ones among them count as failures."""
    files = [src("Foo", "class Foo {}"), src("UsesFoo", "class UsesFoo { private Foo foo; }"), src("UsesUsesFoo", "class UsesUsesFoo { private UsesFoo usesFoo; }"), src("Bad", "class Bad { Foo foo(; }"), src("Far", "class Far { Bad ( }")]
    files += [src(f"Unrelated{i}", f"class Unrelated{i} {{ private String id; }}") for i in range(45)]
    files += [test("UsesUsesFooTest", "class UsesUsesFooTest {}")]
    df = spark.createDataFrame(files, "path string, content string")
    changed = spark.createDataFrame([("d", "src/main/java/com/example/Foo.java")], "diff_id string, path string")
    only = Config(strategies=("transitive",), transitive_depth=2)
    own = index.build(df, only)
    decisions, _ = engine.analyse(changed, own, only)
    assert decisions.first()["n_failed"] == 1
    parsed = [r["path"] for r in own["edges"].parsed().collect()]
    assert len(parsed) == len(set(parsed)) and {p.rpartition("/")[2] for p in parsed} == {"Foo.java", "UsesFoo.java", "UsesUsesFoo.java", "Bad.java"}
    classes = engine.changed_classes(engine.classify(changed, only), only)
    assert {(r["strategy"], r["fqn"]) for r in engine.discover(classes, own, only).collect()} == {("transitive", "com.example.UsesUsesFooTest")}
    full = index.build(df, Config(transitive_depth=2))
    changed_only = classes.select("diff_id", "fqn").distinct()
    walk = lambda built: sorted(map(tuple, selection.transitive(changed_only, built["edges"], 2).collect()))
    assert walk(own) == walk(full)
