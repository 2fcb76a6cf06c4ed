import datetime
import json

import pytest

from wayfind.operators import cache, inventory, landmarks, selection
from wayfind.plans import explain, reading
from wayfind.settings import MapSettings

AT = {"start": {"line": 1, "column": 1}, "end": {"line": 2, "column": 3}}


def scored(spark, n):
    rows = [(f"p{k}", "rust", f"name{k}", "function", [], AT, "x" * (7 * k % 90), 100 - k % 5) for k in range(n)]
    schema = "path string, language string, name string, kind string, scope array<string>, location struct<start:struct<line:int,column:int>,end:struct<line:int,column:int>>, context string, score long"
    return spark.createDataFrame(rows, schema)


def test_every_small_budget_holds(spark):
    frame = scored(spark, 12).cache()
    for budget in (*range(1, 25, 3), 40, 64, 500):
        made = selection.select_snippets(frame, budget)
        assert made["estimated_tokens"] <= budget and made["estimated_tokens"] == sum(s["estimated_tokens"] for s in made["snippets"])
        assert [s["score"] for s in made["snippets"]] == sorted((s["score"] for s in made["snippets"]), reverse=True)
    assert len(selection.select_snippets(frame, 10_000)["snippets"]) == 12


def test_a_cut_snippet_uses_its_room():
    row = {"path": "p", "kind": "function", "name": "n", "scope": [], "location": AT, "context": "c" * 200}
    for budget in range(1, 70):
        made = selection.fit(row, budget)
        if made:
            context, cost, cut = made
            assert cost <= budget and cut == (context != row["context"])
            assert not cut or selection.tokens(f"{selection.snippet_prefix(row)} {row['context'][: len(context)]}…") > budget
    assert selection.fit(row, 1) is None


def test_shrinking():
    report = {"findings": ["f" * 40] * 3, "snippets": ["s" * 40] * 3, "files": ["a" * 40] * 3}
    small = selection.shrink(report, 45)
    assert small["findings"] == [] and selection.payload_tokens(small) <= 45 and small["files"]
    assert len(json.dumps(selection.halve({"a": list(range(1000)), "b": [1]}, 500))) <= 500


def test_greedy_passes_over_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (1, "c", 4), (2, "d", 100), (2, "e", 10)], "g int, path string, size long")
    got = {r["path"]: r["kept"] for r in inventory.greedy_within(rows, ["g"], ["path"], "size", 10).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": True}


def candidate(purpose, path, score, root=None, confidence="high", reasons=("why",)):
    return {"purpose": purpose, "path": path, "score": score, "project_root": root, "confidence": confidence, "strength": {"high": 3, "medium": 2, "low": 1}[confidence], "reasons": list(reasons), "evidence_kinds": ["graph"], "limitations": []}


def test_plan_takes_each_purpose_then_roots_then_fills_from_the_weakest():
    found = [candidate("start_here", "README", 30), candidate("architecture", "lib", 20, "."), candidate("architecture", "README", 99), candidate("runtime", "main", 10, "sub")]
    found += [candidate("supporting_context", f"s{k}", k) for k in range(9)]
    plan = reading.choose(found, [{"path": ".", "manifests": ["Cargo.toml"]}, {"path": "sub", "manifests": []}])
    paths = [r["path"] for r in plan["recommendations"]]
    assert paths[:3] == ["README", "lib", "main"] and len(paths) == 10 and "s7" not in paths and "s8" in paths and "s0" in paths
    assert [r["ordinal"] for r in plan["recommendations"]] == list(range(1, 11))
    strong = [r["path"] for r in reading.choose(found, [], "strongest")["recommendations"]]
    assert "s7" in strong and "s0" not in strong
    assert reading.choose(found[:2], [])["shortfall"]["returned"] == 2


def test_manifests_are_raised_or_added(spark):
    schema = "purpose string, path string, project_root string, evidence_kinds array<string>, reasons array<string>, limitations array<string>, score long, confidence string"
    have = spark.createDataFrame([("start_here", "Cargo.toml", ".", ["landmark"], ["x"], [], 5, "high")], schema)
    roots = spark.createDataFrame([(".", ["Cargo.toml", "package.json"]), ("sub", ["sub/go.mod"])], "path string, manifests array<string>")
    got = {r["path"]: r["score"] for r in reading.with_manifests(have, roots).collect()}
    assert got == {"Cargo.toml": 3_095_250_000, "package.json": 3_090_000_000, "sub/go.mod": 3_000_000_000}


def test_roots_and_landmarks(spark):
    files = [("Cargo.toml", "[workspace]"), ("a/package.json", "{}"), ("a/pyproject.toml", ""), ("b/go.mod", None), ("README.md", ""), ("b/tests/x.go", ""), (".github/workflows/ci.yml", "")]
    frame = spark.createDataFrame([(p, c, "modified" if p == "b/tests/x.go" else "tracked") for p, c in files], "path string, content string, state string")
    roots = landmarks.project_roots(frame)
    assert {r["path"]: r["kind"] for r in roots.collect()} == {".": "workspace", "a": "mixed", "b": "unknown"}
    deep = {r["path"]: r["project_root"] for r in landmarks.deepest_root(frame, roots).collect()}
    assert deep["b/tests/x.go"] == "b" and deep["README.md"] == "."
    marks = {(r["kind"], r["path"]): r for r in landmarks.landmarks(frame, roots, MapSettings(focuses=("readme",))).collect()}
    assert marks["readme", "README.md"]["focus_matches"] == 1 and marks["test_root", "b/tests"]["worktree_state"] == "modified"
    assert ("ci", ".github/workflows") in marks and ("workspace_root", "Cargo.toml") in marks and marks["readme", "README.md"]["priority"] == 95


def test_first_failing_gate(spark):
    rows = [
        ("x.log", "a", False), ("l.rs", "a", True), ("target/a.rs", "a", False), ("a.c", "a", False), ("a.bin", "a", False), ("r.rs", None, False), ("n.rs", "\0", False), ("ok.rs", "fn a() {}", False),
        ("scripts/run", "#!/usr/bin/env lua\n", False), ("scripts/other", "#!/bin/sh\n", False), ("bin/run", "#!/usr/bin/env lua\n", False), ("g.rs", "// @generated\n", False), ("m.js", "x" * 1200, False),
    ]
    frame = spark.createDataFrame(rows, "path string, content string, symlink boolean")
    got = {r["path"]: (r["omission_reason"], r["language"]) for r in inventory.gated(frame, MapSettings(excludes=("*.log",))).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "x.log": "explicit_exclusion", "l.rs": "symlink", "target/a.rs": "classified", "a.c": "unsupported_language", "a.bin": "non_source", "r.rs": "read_error", "n.rs": "binary",
        "ok.rs": None, "scripts/run": None, "scripts/other": "non_source", "bin/run": "classified", "g.rs": "classified", "m.js": "classified",
    }
    assert got["scripts/run"][1] == "lua"
    focused = inventory.gated(frame, MapSettings(focus_paths=("target",))).where("path = 'target/a.rs'").first()
    assert focused["omission_reason"] is None


def test_cache_modes_and_retention(spark):
    t = datetime.datetime(2024, 1, 10)
    old, new = t - datetime.timedelta(days=40), t - datetime.timedelta(days=1)
    schema = "repository_id string, path string, language string, query_digest string, fingerprint string, created_at timestamp, bytes long, payload string"
    records = spark.createDataFrame([("r", "a", "rust", "q", "f1", new, 10, "A"), ("r", "b", "rust", "q", "f2", old, 10, "B"), ("r", "c", "rust", "q", "f3", t, 90, "C")], schema)
    assert {x["path"] for x in cache.retained(records, cache.F.lit(t), max_bytes=95).collect()} == {"c"}
    assert {x["path"] for x in cache.retained(records, cache.F.lit(t)).collect()} == {"a", "c"}
    files = spark.createDataFrame([("r", "a", "rust", "q", "f1"), ("r", "b", "rust", "q", "zz"), ("r", "x", "rust", "q", "zz")], "repository_id string, path string, language string, query_digest string, fingerprint string")
    status = lambda mode: {x["path"]: x["cache_status"] for x in cache.lookup(files, records, mode).collect()}
    assert status("auto") == {"a": "hit", "b": "refreshed", "x": "refreshed"} and status("manual") == {"a": "hit", "b": "stale", "x": "miss"}
    assert set(status("no_cache").values()) == {"disabled"} and cache.overall_status("auto", 3, 1, 0) == "refreshed" and cache.overall_status("auto", 0, 0, 0) == "miss"


def test_explain_targets(spark):
    files, none = spark.createDataFrame([("src/a.rs",)], "path string"), spark.createDataFrame([], "path string, reason string")
    symbols = spark.createDataFrame([("src/a.rs", 0, "run", ["M"])], "path string, seq int, name string, scope array<string>")
    kind = lambda t: explain.target_kind(t, files, none, symbols)
    assert (kind("./src/a.rs"), kind("run"), kind("M::run"), kind("other/b.rs"), kind("zzz")) == ("path", "symbol", "symbol", "path", "unmatched")
    with pytest.raises(ValueError):
        kind(" ")


def test_shrunk_rows_are_those_that_shrinking_leaves(spark):
    from wayfind.operators import selection

    rows = [(c, k, "x" * ((k * 7 + len(c)) % 23), None) for c in ("findings", "edges", "omissions", "other") for k in range(9)]
    df = spark.createDataFrame(rows, "collection string, place long, path string, note string")
    df = df.withColumn("tokens", selection.text_tokens(df, ["path", "note"]))
    report = {c: [{"path": r[2], "note": None} for r in rows if r[0] == c] for c in ("findings", "edges", "omissions")}
    whole = selection.payload_tokens(report)
    for budget in (0, 1, whole // 3, whole // 2, whole - 1, whole, whole + 5):
        left = selection.shrink(report, budget)
        got = selection.shrunk(df, budget).collect()
        assert {c: sorted(r["place"] for r in got if r["collection"] == c) for c in report} == {c: list(range(len(v))) for c, v in left.items()}
        assert sum(r["collection"] == "other" for r in got) == 9
    assert selection.shrunk(df.limit(0), 5).collect() == []
