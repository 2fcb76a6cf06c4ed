import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfind.functions import landmarks as L
from wayfind.functions import modules as M
from wayfind.functions import paths as P
from wayfind.functions import text as X
from wayfind.settings import HistorySettings, MapSettings


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return row.select(expr.alias("r")).first()["r"]


def kinds(spark, path):
    return [(c["kind"], c["reason"]) for c in one(spark, P.classify(F.col("p")), p=path)]


def test_classification_of_paths(spark):
    assert kinds(spark, "src/vendor/tracked.rs") == [("vendor", "vendor_directory:vendor")]
    assert kinds(spark, "src/generated_parser.rs") == []
    assert kinds(spark, "a/bin") == [("generated", "generated_directory:bin")]  # the file name counts
    assert kinds(spark, "target/x.min.js") == [("generated", "generated_directory:target"), ("minified", "minified_filename")]
    assert kinds(spark, "a//vendor/x") == []  # what follows an empty component does not
    assert [k for k, _ in kinds(spark, "web/app.js.map")] == ["source_map"]
    assert kinds(spark, "api_pb.go") == [("generated", "generated_filename")]
    assert one(spark, P.classified_prefix(F.col("p")), p="a/target/b/c.rs") == "a/target"


def test_scope_and_ancestors(spark):
    assert one(spark, P.in_scope(F.col("p"), "src"), p="src/a") and not one(spark, P.in_scope(F.col("p"), "src"), p="srcs/a")
    assert one(spark, P.ancestors(F.col("p")), p="a") == ["."]
    assert one(spark, P.ancestors(F.col("p")), p="a/b/c") == [".", "a", "a/b"]
    assert one(spark, P.parent(F.col("p"), ""), p="a") == ""
    assert one(spark, P.extension(F.col("p")), p="x/.bashrc") == "" and one(spark, P.extension(F.col("p")), p="x/A.TAR.GZ") == "gz"


@pytest.mark.parametrize(
    ("patterns", "path", "want"),
    [
        (("*.log",), "a/b.log", True), (("*.log", "!keep.log"), "a/keep.log", False), (("/a",), "b/a", False), (("/a",), "a/c", True), (("d/",), "x/d/y", True), (("d/",), "x/d", False),
        (("a/**/b",), "a/b", True), (("a/**/b",), "a/x/y/b", True), (("a/**",), "a/q", True), (("[ab].c",), "b.c", True), (("[!ab].c",), "b.c", False), (("x?z",), "xyz", True), (("#c",), "#c", False),
    ],
)
def test_gitignore(spark, patterns, path, want):
    assert one(spark, P.excluded(F.col("p"), patterns), p=path) is want


def test_empty_exclusion_is_an_error():
    with pytest.raises(ValueError):
        P.excluded(F.lit("x"), (" ",))


@pytest.mark.parametrize(
    ("path", "want"),
    [("", "empty"), ("a\0b", "nul"), ("/a", "absolute"), ("a/../b", "parent"), ("./a", "current"), ("a//b", "empty_component"), ("a\\b", "platform_separator"), ("C:x", "prefix"), ("a/b", None)],
)
def test_path_safety(spark, path, want):
    assert one(spark, P.safety_kind(F.col("p")), p=path) == want


def test_keywords_as_words(spark):
    message = "Fix: prefix debug_fix, BUG! bugs"
    assert one(spark, X.matched_keywords(F.col("m"), ("fix", "bug", " ", "broken")), m=message) == ["bug", "fix"]
    assert one(spark, X.matched_keywords(F.col("m"), ("fix",)), m="prefix") == []
    assert one(spark, X.matched_keywords(F.col("m"), ("fix",), substring=True), m="prefix") == ["fix"]
    assert one(spark, X.matched_keywords(F.col("m"), ("a.b",)), m="axb") == []


def test_times_before_1970(spark):
    assert spark.range(1).select(X.month(F.lit(-1)).alias("m")).first()["m"] == "1969-12"


def test_generated_and_minified(spark):
    assert one(spark, X.generated_marker(F.col("c")), c="// Code generated by x; DO NOT EDIT.\n")
    assert not one(spark, X.generated_marker(F.col("c")), c="Code generated; do not edit\n")
    assert not one(spark, X.generated_marker(F.col("c")), c="\n" * 16 + "# @generated")
    assert one(spark, X.minified(F.lit("js"), F.col("c")), c="x" * 1200)
    assert not one(spark, X.minified(F.lit("py"), F.col("c")), c="x" * 1200)


def test_hints(spark):
    def hints(context, lang):
        return one(spark, M.import_hints(F.col("c"), F.col("l")), c=context, l=lang)

    assert hints("use crate::target::target;", "rust") == ["crate/target/target"]
    assert hints("import { t } from './foo.bar.js';", "javascript") == ["foo.bar"]
    assert hints("local h = require('app.helper')", "lua") == ["app.helper", "app/helper"]
    assert hints("from pkg.mod import x", "python") == ["pkg.mod"]
    assert hints("import os", "python") == []
    matches = lambda path, hint: one(spark, M.module_path_matches(F.col("p"), F.array(F.col("h"))), p=path, h=hint)
    assert matches("target.rs", "crate/target/target") and matches("internal/client/build.go", "x/internal/client")
    assert matches("foo.bar.js", "foo.bar") and not matches("foo/bar.js", "foo.bar")


def test_manifests(spark):
    role = lambda n, c: one(spark, L.manifest_role(F.col("n"), F.col("c")), n=n, c=c)
    assert role("cargo.toml", "[WORKSPACE]\n") == "workspace" and role("cargo.toml", "[package]") == "package" and role("go.work", "") == "workspace"
    assert one(spark, L.file_landmarks(F.col("p")), p="a/pom.xml") == ["manifest", "build_entry_point"]
    assert one(spark, L.file_landmarks(F.col("p")), p=".github/workflows/x.yml") == ["ci"]


@pytest.mark.parametrize("bad", [{"tokens": 0}, {"cache_mode": "files"}, {"excludes": ("",)}, {"profile": "x"}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        MapSettings(**bad)
    with pytest.raises(ValueError):
        HistorySettings(now=0, days=0)


def test_selection_budget():
    assert MapSettings(tokens=19).selection_budget == 19 and MapSettings(tokens=1000).selection_budget == 667 and MapSettings(tokens=1000, profile="evidence").selection_budget == 1000


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=60))
def test_token_estimate_and_relative_paths(spark, text):
    text = text.replace("\0", "").encode("utf-8", "ignore").decode()
    assert one(spark, X.token_estimate(F.col("t")), t=text) == max(1, -(-len(text) // 4))
    normal = one(spark, P.normalize_relative(F.col("t")), t=text)
    assert normal is None or (".." not in normal.split("/") and "." not in normal.split("/"))
