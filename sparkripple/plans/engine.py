"""The decision over many diffs at once."""

from __future__ import annotations

import time
from collections.abc import Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkripple.functions import paths
from sparkripple.operators import masks, selection
from sparkripple.operators.iterate import kept, written
from sparkripple.operators.ranking import placed
from sparkripple.plans.config import STRATEGIES, Config

#: Why the whole suite runs, by situation. Fixed values.
ESCALATIONS = {
    "EMPTY_DIFF": "RUN_ALL_ON_EMPTY_CHANGESET",
    "ALL_FILES_IGNORED": "RUN_ALL_ON_ALL_FILES_IGNORED",
    "ALL_FILES_OUT_OF_SCOPE": "RUN_ALL_ON_ALL_FILES_OUT_OF_SCOPE",
    "UNMAPPED_FILE": "RUN_ALL_ON_NON_JAVA_CHANGE",
    "DISCOVERY_EMPTY": "RUN_ALL_IF_NO_MATCHES",
    "DISCOVERY_INCOMPLETE": "RUN_ALL_ON_DISCOVERY_INCOMPLETE",
}
COUNTS = {"n_ignored": "ignored", "n_oos": "out_of_scope", "n_prod": "production", "n_test": "test", "n_unmapped": "unmapped"}


def classify(changed_files: DataFrame, config: Config) -> DataFrame:
    """changed_files(diff_id, path) with the bucket of each distinct path; ord, where given, is the path's first place."""
    bucket = paths.bucket(F.col("path"), list(config.ignore_paths), config.out_of_scope(), list(config.source_dirs), list(config.test_dirs))
    each = changed_files.groupBy("diff_id", "path").agg(F.min("ord").alias("ord")) if "ord" in changed_files.columns else changed_files.select("diff_id", "path").distinct()
    return each.withColumn("bucket", bucket)


def changed_classes(classified: DataFrame, config: Config) -> DataFrame:
    """(diff_id, kind, fqn, simple, pkg) of production and test files."""
    path, production = F.col("path"), F.col("bucket") == "production"
    fqn = F.when(production, paths.fqn_under(path, list(config.source_dirs))).otherwise(paths.fqn_under(path, list(config.test_dirs)))
    rows = classified.filter(F.col("bucket").isin("production", "test")).select("diff_id", F.when(production, "prod").otherwise("test").alias("kind"), F.explode(paths.with_facade(fqn, path, production)).alias("fqn"))
    return rows.withColumn("simple", paths.simple_name(F.col("fqn"))).withColumn("pkg", paths.package_of(F.col("fqn"))).distinct()


def bucket_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("diff_id").agg(F.count(F.lit(1)).alias("n_files"), *(F.count_if(F.col("bucket") == b).alias(n) for n, b in COUNTS.items()))


def situation() -> Column:
    """The situation from the counts, rules in order; unmapped_action is what an unmapped file would lead to."""
    n = F.col("n_files")
    return (
        F.when(n == 0, "EMPTY_DIFF")
        .when(F.col("n_ignored") == n, "ALL_FILES_IGNORED")
        .when(F.col("n_ignored") + F.col("n_oos") == n, "ALL_FILES_OUT_OF_SCOPE")
        .when((F.col("n_unmapped") > 0) & (F.col("unmapped_action") != "SELECTED"), "UNMAPPED_FILE")
        .when(F.col("n_failed") > 0, "DISCOVERY_INCOMPLETE")
        .when(F.col("n_selected") == 0, "DISCOVERY_EMPTY")
        .otherwise("DISCOVERY_SUCCESS")
    )


def decide(counts: DataFrame, config: Config, env: Mapping[str, str] | None = None) -> DataFrame:
    """Counts per diff to decisions: situation, action, its source, outcome, escalation_reason, run_all, skipped, n_selected."""
    matrix = config.action_matrix(counts.sparkSession, env)
    unmapped = next(r["action"] for r in matrix.filter("situation = 'UNMAPPED_FILE'").collect())
    out = counts.withColumn("unmapped_action", F.lit(unmapped)).withColumn("situation", situation()).join(F.broadcast(matrix.drop("ord")), "situation")
    stopped = (F.col("action") != "SELECTED") | F.col("situation").isin("EMPTY_DIFF", "ALL_FILES_IGNORED", "ALL_FILES_OUT_OF_SCOPE")
    out = out.withColumn("n_selected", F.when(stopped, F.lit(0)).otherwise(F.col("n_selected")).cast("long"))
    run_all = F.col("action") == "FULL_SUITE"
    skipped = (F.col("action") == "SKIPPED") | (F.col("action") == "SELECTED") & (F.col("situation") != "DISCOVERY_SUCCESS") & (F.col("n_selected") == 0)
    reasons = F.element_at(F.create_map(*(F.lit(x) for pair in ESCALATIONS.items() for x in pair)), F.col("situation"))
    out = out.withColumns({"run_all": run_all, "skipped": skipped})
    out = out.withColumn("escalation_reason", F.when(F.col("run_all"), F.coalesce(reasons, F.lit("NONE"))).otherwise("NONE"))
    return out.withColumn("outcome", F.when(F.col("run_all"), "FULL_SUITE").when(F.col("skipped"), "SKIPPED").otherwise("SELECTED")).drop("unmapped_action")


def prod_and_test(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return classes.filter("kind = 'prod'").select("diff_id", "fqn", "simple", "pkg"), classes.filter("kind = 'test'").select("diff_id", "fqn")


class Clock:
    """Wall times of the parts of one discovery in milliseconds, under a strategy's name."""

    def __init__(self):
        self.millis: dict[str, int] = {}

    @contextmanager
    def of(self, strategy: str):
        start = time.monotonic()
        yield
        self.millis[strategy] = self.millis.get(strategy, 0) + int((time.monotonic() - start) * 1000)


def discover(classes: DataFrame, index: Mapping[str, DataFrame], config: Config, clock: Clock | None = None) -> DataFrame:
    """(diff_id, strategy, fqn) over the index relations tests, sources, imports, simple_refs, dotted_refs, decls, edges, or keys (fqn, key) in place of the three in the middle.

    Changed classes, their implementations and the classes that reach them are masks of
    diffs, a column per strategy, so that all diffs and strategies are joined to the
    tests at once, and only the tests found are told apart by diff. The clock, if given, gets
    the times of both searches and of the join by name; the rest is usage's.
    """
    clock = clock or Clock()
    changed, changed_tests = prod_and_test(classes)
    numbers = masks.numbered(classes)
    own = kept(masks.masked(changed, numbers, "fqn", "simple"))
    by_name, by_use = [], []

    def wanted(strategy: str, found: DataFrame, name: bool, use: bool) -> None:
        tagged = found.select("fqn", "word", *(F.col("bits").alias(s) if s == strategy else F.lit(0).cast("long").alias(s) for s in STRATEGIES))
        by_name.extend([tagged] * name)
        by_use.extend([tagged] * use)

    wanted("naming", own, config.enabled("naming"), False)
    wanted("usage", own, False, config.enabled("usage"))
    if config.enabled("impl") and config.include_implementation_tests:
        with clock.of("impl"):
            found = selection.implementation_masks(own, index["sources"], index["decls"], list(config.implementation_naming), config.transitive_depth, config.strict_compat)
        wanted("impl", found, config.enabled("naming"), config.enabled("usage"))
    if config.enabled("transitive"):
        with clock.of("transitive"):
            found = selection.transitive_masks(own.select("fqn", "word", "bits"), index["edges"], config.transitive_depth)
        wanted("transitive", found, True, True)

    def united(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by, "word").agg(*(F.bit_or(s).alias(s) for s in STRATEGIES))

    hit = []
    if by_name:
        named = united(reduce(DataFrame.unionByName, by_name).withColumn("simple", paths.simple_name(F.col("fqn"))), "simple")
        named = named.withColumn("simple", F.explode(F.transform(F.lit(list(config.test_suffixes)), lambda s: F.concat(F.col("simple"), s))))
        with clock.of("naming"):
            hit.append(kept(united(named.join(index["tests"].select("fqn", "simple"), "simple"), "fqn")))
    if by_use:
        users = kept(united(reduce(DataFrame.unionByName, by_use), "fqn"))
        if "keys" in index:
            keys = [index["keys"]]
        else:
            others = selection.same_package(index["simple_refs"]).unionByName(selection.inline_names(index["dotted_refs"]))
            keys = selection.within_packages(users, selection.import_keys(index["imports"]), others)
        # Written one by one, so that the shuffles of one are gone before the next.
        with clock.of("usage"):
            parts = [kept(united(k.select(F.col("fqn").alias("test"), F.col("key").alias("fqn")).join(users, "fqn").select(F.col("test").alias("fqn"), "word", *STRATEGIES), "fqn")) for k in keys]
            if "keys" not in index:
                parts.append(kept(united(selection.wildcard_uses(users, index["imports"], index["simple_refs"]), "fqn")))
        used = reduce(DataFrame.unionByName, parts)
        used = used.withColumn("own", F.lit(0).cast("long"))
        # Tests that changed themselves use nothing in their diffs.
        out = masks.masked(changed_tests, numbers, "fqn").select("fqn", "word", *(F.lit(0).cast("long").alias(s) for s in STRATEGIES), F.col("bits").alias("own"))
        used = used.unionByName(out).groupBy("fqn", "word").agg(*(F.bit_or(s).alias(s) for s in (*STRATEGIES, "own")))
        hit.append(used.select("fqn", "word", *(F.col(s).bitwiseAND(F.bitwise_not("own")).alias(s) for s in STRATEGIES)))
    changed_rows = changed_tests.select("diff_id", F.lit("changed").alias("strategy"), "fqn").distinct()
    if not hit:
        return changed_rows
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), F.col(s).alias("bits")) for s in STRATEGIES))).alias("own")
    rows = united(reduce(DataFrame.unionByName, hit), "fqn").select("fqn", "word", each).select("fqn", "word", "own.strategy", "own.bits").filter("bits <> 0")
    return masks.of_diffs(rows, numbers, "strategy", "fqn").unionByName(changed_rows)


def cross_package(classes: DataFrame, selected: DataFrame, index: Mapping[str, DataFrame], config: Config) -> DataFrame:
    """(diff_id, changed_fqn, fqn, place, total): selected tests that naming found in another package than the changed class's, in order, and how many a diff has."""
    changed, _ = prod_and_test(classes)
    pairs = selection.naming(changed, index["tests"], list(config.test_suffixes)).filter("cross_package").join(selected.select("diff_id", "fqn").distinct(), ["diff_id", "fqn"], "left_semi")
    return placed(pairs.select("diff_id", "changed_fqn", "fqn"), ["diff_id"], ["changed_fqn", "fqn"]).select("diff_id", "changed_fqn", "fqn", "place", F.col("n").alias("total"))


def parse_failures(classes: DataFrame, index: Mapping[str, DataFrame], config: Config) -> DataFrame:
    """(diff_id, n_failed): unparsed files that the enabled strategies touch; index has metadata(kind, parse_ok, words, fqn), or that of tests and sources by itself.

    A diff with a production class touches all tests by usage and all sources by
    implementation. Without these, the transitive walk touches the sources whose
    text names a class of its frontier, and all tests once it finds one. Naming
    touches nothing.
    """
    changed, _ = prod_and_test(classes)
    diffs = changed.select("diff_id").distinct()
    parts = []

    def failed(kind: str) -> DataFrame:
        own = f"{kind}_metadata"
        meta = index[own] if own in index else index["metadata"].filter(F.col("kind") == kind)
        return meta.filter("NOT parse_ok").select("path", "words")

    def number(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))

    if config.enabled("usage"):
        parts.append(diffs.crossJoin(number(failed("test"))))
    if config.enabled("impl") and config.include_implementation_tests:
        parts.append(diffs.crossJoin(number(failed("source"))))
    if config.enabled("transitive") and len(parts) < 2:
        found = selection.transitive(changed, index["edges"], config.transitive_depth)
        if not config.enabled("usage"):
            parts.append(found.select("diff_id").distinct().crossJoin(number(failed("test"))))
        if not (config.enabled("impl") and config.include_implementation_tests):
            frontier = found.filter(F.col("hop") < config.transitive_depth).select("diff_id", "fqn").union(changed.select("diff_id", "fqn"))
            names = frontier.select("diff_id", paths.simple_name(F.col("fqn")).alias("word")).distinct()
            # A lazy search has parsed all files that its frontiers name, and no others count.
            unread = index["edges"].parsed().filter("NOT parse_ok") if hasattr(index["edges"], "parsed") else failed("source")
            touched = unread.select("path", F.explode("words").alias("word")).join(names, "word")
            parts.append(touched.groupBy("diff_id").agg(F.count_distinct("path").alias("n")))
    if not parts:
        return diffs.withColumn("n_failed", F.lit(0).cast("long"))
    return reduce(DataFrame.unionByName, parts).groupBy("diff_id").agg(F.sum("n").alias("n_failed"))


def strategy_counts(found: DataFrame) -> DataFrame:
    return found.filter("strategy <> 'changed'").groupBy("diff_id", "strategy").agg(F.count_distinct("fqn").alias("n_tests"))


def dominant_strategy(counts: DataFrame) -> DataFrame:
    """(diff_id, strategy): the one with strictly the most, null on a tie or with fewer than two."""
    top = counts.groupBy("diff_id").agg(F.max_by("strategy", "n_tests").alias("best"), F.max("n_tests").alias("most"), F.count(F.lit(1)).alias("n"))
    ties = counts.join(top, "diff_id").filter(F.col("n_tests") == F.col("most")).groupBy("diff_id").agg(F.count(F.lit(1)).alias("tied"))
    return top.join(ties, "diff_id").select("diff_id", F.when((F.col("n") > 1) & (F.col("tied") == 1), F.col("best")).alias("strategy"))


def on_disk(found: DataFrame, known_tests: DataFrame) -> DataFrame:
    """(diff_id, fqn, path): the candidates that still are tests."""
    return found.select("diff_id", "fqn").distinct().join(known_tests.select("fqn", "path"), "fqn").select("diff_id", "fqn", "path")


@dataclass(frozen=True)
class Trace:
    """All that a report needs; found is (diff_id, strategy, fqn), selected (diff_id, fqn, path) before the decision.

    profile is (strategy, millis, tests, ord) of the strategies that ran: their times and
    the tests they found in all diffs, as measured while the analysis ran; None without a search.
    """

    classified: DataFrame
    classes: DataFrame
    found: DataFrame
    selected: DataFrame
    decisions: DataFrame
    profile: DataFrame | None = None

    def chosen(self) -> DataFrame:
        """The selected tests of the diffs that run a selection."""
        return self.selected.join(self.decisions.filter("outcome = 'SELECTED'").select("diff_id"), "diff_id", "left_semi")


def profiled(spark: SparkSession, clock: Clock, tests_of: Mapping[str, int], config: Config) -> DataFrame:
    ran = [s for s in STRATEGIES if config.enabled(s) and (s != "impl" or config.include_implementation_tests)]
    return spark.createDataFrame([(s, clock.millis.get(s, 0), int(tests_of.get(s) or 0), i) for i, s in enumerate(ran)], "strategy string, millis long, tests long, ord int")


def trace(changed_files: DataFrame, index: Mapping[str, DataFrame], config: Config, diffs: DataFrame | None = None, failures: DataFrame | None = None, env: Mapping[str, str] | None = None) -> Trace:
    """The analysis of changed_files(diff_id, path[, ord]).

    diffs(diff_id) adds diffs without a changed file. Unparsed files are counted
    from the index's metadata where it has that, unless failures(diff_id, n_failed)
    are given. Where no diff has a production class, only the index's tests are
    looked at, so that a lazy index parses nothing.
    """
    classified, profile = kept(classify(changed_files, config)), None
    classes = changed_classes(classified, config)
    if classes.filter("kind = 'prod'").isEmpty():
        found = classes.select("diff_id", F.lit("changed").alias("strategy"), "fqn").distinct()
        failures = None
    else:
        clock, tests_of = Clock(), Observation("tests of strategies")
        searched = discover(classes, index, config, clock)
        with clock.of("usage"):
            found = written(searched.observe(tests_of, *(F.count_if(F.col("strategy") == s).alias(s) for s in STRATEGIES)))
        profile = profiled(classes.sparkSession, clock, tests_of.get, config)
        if failures is None and "metadata" in index:
            failures = parse_failures(classes, index, config)
    selected = written(on_disk(found, index["tests"]))
    counts = bucket_counts(classified)
    if diffs is not None:
        counts = diffs.select("diff_id").distinct().join(counts, "diff_id", "left")
    counts = counts.join(selected.groupBy("diff_id").agg(F.count_distinct("fqn").alias("n_selected")), "diff_id", "left")
    counts = counts.join(classes.filter("kind = 'prod'").groupBy("diff_id").agg(F.count_distinct("fqn").alias("n_prod_classes")), "diff_id", "left")
    counts = counts.join(failures.select("diff_id", "n_failed"), "diff_id", "left") if failures is not None else counts.withColumn("n_failed", F.lit(0))
    return Trace(classified, classes, found, selected, decide(counts.fillna(0), config, env), profile)


def analyse(changed_files: DataFrame, index: Mapping[str, DataFrame], config: Config, diffs: DataFrame | None = None, failures: DataFrame | None = None, env: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions per diff, and the selected tests (diff_id, fqn, path) of those that select; see trace()."""
    own = trace(changed_files, index, config, diffs, failures, env)
    return own.decisions, own.chosen()
