"""Configuration: knobs, their rules, and the actions per situation and mode."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

#: They decide results.
SITUATIONS = ("EMPTY_DIFF", "ALL_FILES_IGNORED", "ALL_FILES_OUT_OF_SCOPE", "UNMAPPED_FILE", "DISCOVERY_INCOMPLETE", "DISCOVERY_EMPTY", "DISCOVERY_SUCCESS")
ACTIONS = ("SELECTED", "FULL_SUITE", "SKIPPED")
MODES = ("AUTO", "LOCAL", "CI", "STRICT")
STRATEGIES = ("naming", "usage", "impl", "transitive")
CI_VARIABLES = ("CI", "GITLAB_CI", "GITHUB_ACTIONS", "JENKINS_HOME", "CIRCLECI", "TRAVIS", "BUILDKITE", "TF_BUILD")
DEFAULTS = {
    "EMPTY_DIFF": ("SKIPPED", "SKIPPED", "FULL_SUITE"),
    "ALL_FILES_IGNORED": ("SKIPPED", "SKIPPED", "FULL_SUITE"),
    "ALL_FILES_OUT_OF_SCOPE": ("SKIPPED", "SKIPPED", "SKIPPED"),
    "UNMAPPED_FILE": ("FULL_SUITE", "FULL_SUITE", "FULL_SUITE"),
    "DISCOVERY_EMPTY": ("SKIPPED", "FULL_SUITE", "FULL_SUITE"),
    "DISCOVERY_INCOMPLETE": ("SELECTED", "FULL_SUITE", "FULL_SUITE"),
    "DISCOVERY_SUCCESS": ("SELECTED", "SELECTED", "SELECTED"),
}
BOTH_LEVELS = ("*.md", "*.txt", "LICENSE", "LICENSE.*", "CHANGELOG*", "*.png", "*.jpg", "*.jpeg", "*.svg", "*.gif")
IGNORED = ("**/generated/**", *(g for name in BOTH_LEVELS for g in (name, f"**/{name}")))
REMOVED_KNOBS = {"run_all_if_no_matches": "on_discovery_empty", "run_all_on_non_java_change": "on_unmapped_file", "exclude_paths": "ignore_paths"}


@dataclass(frozen=True)
class Config:
    base_ref: str = "origin/master"
    include_uncommitted: bool = False
    include_staged: bool = False
    strategies: tuple[str, ...] = STRATEGIES
    transitive_depth: int = 4
    test_suffixes: tuple[str, ...] = ("Test", "IT", "ITTest", "IntegrationTest")
    source_dirs: tuple[str, ...] = ("src/main/java",)
    test_dirs: tuple[str, ...] = ("src/test/java",)
    test_task_names: tuple[str, ...] = ("test",)
    ignore_paths: tuple[str, ...] = IGNORED
    out_of_scope_test_dirs: tuple[str, ...] = ()
    out_of_scope_source_dirs: tuple[str, ...] = ()
    include_implementation_tests: bool = True
    implementation_naming: tuple[str, ...] = ("Impl", "Default")
    kotlin_enabled: bool = True
    timeout_seconds: int = 0
    mode: str = "AUTO"
    on: Mapping[str, str] = field(default_factory=dict)  # situation -> action
    strict_compat: bool = False

    def __post_init__(self):
        object.__setattr__(self, "transitive_depth", min(5, max(0, self.transitive_depth)))
        object.__setattr__(self, "mode", choice(self.mode, MODES, "mode"))
        object.__setattr__(self, "on", {choice(s, SITUATIONS, "situation"): choice(a, ACTIONS, f"on {s}") for s, a in self.on.items()})
        if "DISCOVERY_SUCCESS" in self.on:
            raise ValueError("DISCOVERY_SUCCESS always selects")
        if not acceptable_ref(self.base_ref):
            raise ValueError(f"base_ref {self.base_ref!r} is no commit or ref")
        if not self.test_task_names or any(not t or re.search(r"[:/\\\s\x00-\x1f\x7f]", t) for t in self.test_task_names):
            raise ValueError("test_task_names must be plain task names")
        if self.timeout_seconds < 0:
            raise ValueError("timeout_seconds must not be negative")

    def enabled(self, strategy: str) -> bool:
        return strategy in self.strategies and (strategy != "transitive" or self.transitive_depth > 0)

    def out_of_scope(self) -> list[str]:
        return [*self.out_of_scope_test_dirs, *self.out_of_scope_source_dirs]

    def action(self, situation: str, mode: str) -> tuple[str, str]:
        """Action and its source; an explicit setting beats the mode's default, success always selects."""
        if situation == "DISCOVERY_SUCCESS":
            return "SELECTED", "EXPLICIT"
        if situation in self.on:
            return self.on[situation], "EXPLICIT"
        return DEFAULTS[situation][("LOCAL", "CI", "STRICT").index(mode)], "MODE_DEFAULT"

    def action_matrix(self, spark: SparkSession, env: Mapping[str, str] | None = None) -> DataFrame:
        mode = effective_mode(self.mode, env or {})
        rows = [(s, *self.action(s, mode), i) for i, s in enumerate(SITUATIONS)]
        return spark.createDataFrame(rows, "situation string, action string, action_source string, ord int")


def from_knobs(knobs: Mapping[str, object]) -> Config:
    """A configuration from plain knobs; removed ones say what replaced them."""
    for name in knobs:
        if name in REMOVED_KNOBS:
            raise ValueError(f"{name} was removed; use {REMOVED_KNOBS[name]}")
    known = {f.name for f in fields(Config)}
    if unknown := set(knobs) - known:
        raise ValueError(f"unknown knobs: {', '.join(sorted(unknown))}")
    return Config(**knobs)


def choice(value: str, allowed: tuple[str, ...], what: str) -> str:
    name = value.strip().upper()
    if name not in allowed:
        raise ValueError(f"{what} {value!r}: expected one of {', '.join(allowed)}")
    return name


def boolean(value: str) -> bool:
    """true, 1, on, yes or false, 0, off, no; anything else counts as true, with a warning."""
    name = value.strip().lower()
    if name not in ("true", "1", "on", "yes", "false", "0", "off", "no"):
        warnings.warn(f"{value!r} is no boolean; it counts as true", stacklevel=2)
    return name not in ("false", "0", "off", "no")


def effective_mode(mode: str, env: Mapping[str, str]) -> str:
    if mode != "AUTO":
        return mode
    return "CI" if any(env.get(v, "").strip() for v in CI_VARIABLES) else "LOCAL"


def acceptable_ref(ref: str) -> bool:
    if not ref or not ref.strip() or re.search(r"[\x00-\x1f\x7f-\x9f]", ref):
        return False
    if re.fullmatch(r"[0-9a-fA-F]{7,40}", ref):
        return True
    name = re.sub(r"(?:~\d*|\^\d*|@\{[^}]*\})+$", "", ref)
    bad = r"\.\.|[\s~^:?*\[\\]|@\{|//|^/|/$|\.$|\.lock(?:/|$)|(?:^|/)\."
    return bool(name) and not re.search(bad, name)
