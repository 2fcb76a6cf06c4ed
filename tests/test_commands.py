import json
import os
import subprocess
import sys

import pytest

from wayfind import cli, storage
from wayfind.plans.engine import Repository, cache_control
from wayfind.sources.snapshots import Snapshots
from wayfind.settings import HistorySettings, MapSettings
from wayfind.sources import git, worktree
from wayfind.streaming.activity import keyword_alerts

NOW = 1_700_000_000
FILES = {
    ".gitignore": "src/ignored.rs\n", "README.md": "# x\n", "Cargo.toml": "[package]\nname = 'x'\n", "src/lib.rs": "use crate::one::single;\npub fn run() { single(); duplicate(); }\n",
    "src/one.rs": "pub fn duplicate() {}\npub fn single() {}\n", "src/two.rs": "pub fn duplicate() {}\n", "src/use.rs": "fn f() { duplicate(); }\n", "src/broken.rs": "fn (\n",
    "tests/a.py": "def test_a(): pass\n", "vendor/v.js": "x\n", "svc/service.go": "package svc\nfunc NewService() {}\n", "svc/service_test.go": "package svc\nfunc TestIt() { NewService() }\n",
}


def sh(repo, *args):
    env = os.environ | {"GIT_AUTHOR_DATE": f"{NOW} +0000", "GIT_COMMITTER_DATE": f"{NOW} +0000", "GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x", "GIT_CONFIG_GLOBAL": "/dev/null"}
    subprocess.run(["git", "-C", str(repo), *args], env=env, check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = tmp_path_factory.mktemp("map")
    sh(r, "init", "-q", "-b", "main")
    for path, text in FILES.items():
        (r / path).parent.mkdir(parents=True, exist_ok=True)
        (r / path).write_text(text)
    sh(r, "add", "-A")
    sh(r, "commit", "-q", "-m", "Initial import")
    (r / "src/lib.rs").write_text(FILES["src/lib.rs"] + "// more\n")
    (r / "src/untracked.rs").write_text("fn u() {}\n")
    (r / "src/ignored.rs").write_text("fn i() {}\n")
    outside = tmp_path_factory.mktemp("outside") / "secret.rs"
    outside.write_text("fn secret() {}\n")
    os.symlink(outside, r / "src/link.rs")
    (r / "src/nul.rs").write_bytes(b"\0")
    return r


@pytest.fixture(scope="module")
def found(spark, repo):
    return Repository(spark, str(repo), MapSettings(focuses=("duplicate",), focus_paths=("src/one.rs",)), HistorySettings(now=NOW + 10))


def test_map(found):
    made = found.map()
    assert made["inventory"] == {"tracked": 12, "modified": 1, "untracked": 3}
    reasons = {o["path"]: o["reason"] for o in made["omissions"]}
    assert reasons["src/link.rs"] == "symlink" and reasons["src/nul.rs"] == "binary" and reasons["vendor/v.js"] == "classified" and reasons["src/ignored.rs"] == "ignored_untracked"
    edges = {(e["source"], e["target"], e["symbol"], e["resolution_reason"]) for e in made["edges"]}
    assert ("svc/service_test.go", "svc/service.go", "NewService", "same_module") in edges and ("src/lib.rs", "src/one.rs", "single", "imported_module") in edges
    assert not any(s == "src/use.rs" and n == "duplicate" for s, _, n, _ in edges)
    assert made["ranking"][0]["path"] == "src/one.rs" and "parse_error" in {f["kind"] for f in made["findings"]}
    assert made["selection"]["estimated_tokens"] <= made["selection"]["token_budget"]
    assert "secret" not in json.dumps(made, default=str)


def test_quality_and_availability(found):
    made = found.map()
    assert made["availability"]["partial_path_names"] == ["src/broken.rs"] and made["availability"]["unsafe_paths"] == 1 and not made["availability"]["resource_limited"]
    assert made["quality"]["issues"] == [] and made["cache"]["status"] == "disabled"  # only the focused path counts
    whole = Repository(found.spark, found.path, MapSettings(), HistorySettings(now=NOW + 10))
    assert whole.quality()["issues"] == ["partial"]
    roots = {r["path"]: r for r in made["project_roots"]}
    assert roots["."]["landmark_total"] > 0 and roots["."]["recommendation_total"] == 0


def test_cache_modes(spark, repo, tmp_path):
    table = str(tmp_path / "records")

    def run(mode, now=NOW, files=()):
        r = Repository(spark, str(repo), MapSettings(cache_mode=mode, cache_files=files), HistorySettings(now=now), table)
        return r, r.cache_stats()

    first, stats = run("manual")
    n = first.eligible.count()
    assert stats["unavailable"] == n and first.symbols.isEmpty() and {r["reason"] for r in first.omissions.collect()} >= {"cache_unavailable"}
    first, stats = run("auto")
    assert (stats["status"], stats["refreshed"], stats["hits"]) == ("refreshed", n, 0)
    second, stats = run("auto")
    assert (stats["status"], stats["refreshed"], stats["hits"]) == ("hit", 0, n)
    assert sorted(map(str, second.symbols.collect())) == sorted(map(str, first.symbols.collect())) and sorted(map(str, second.findings.collect())) == sorted(map(str, first.findings.collect()))
    was = (repo / "src/two.rs").read_text()
    try:
        (repo / "src/two.rs").write_text(was + "pub fn more() {}\n")
        third, stats = run("manual")
        assert stats["status"] == "stale" and stats["stale"] == 1 and third.quality()["issues"] == ["stale", "partial"]
        third, stats = run("files", files=("./src/one.rs", "gone.rs"))
        assert (stats["refreshed"], stats["unavailable"], stats["matched"], stats["unmatched"]) == (1, 1, 1, 1)
        assert third.quality()["issues"] == ["incomplete", "partial"]
        assert run("always", NOW + 5)[1]["refreshed"] == n
    finally:
        (repo / "src/two.rs").write_text(was)
    assert cache_control(spark, table, "status").first()["records"] == 2 * n + 1
    code, text = cli.run(["cache", "prune", table])
    assert code == cli.OK and json.loads(text)["repositories"] == []
    assert run("no_cache")[1]["status"] == "disabled"


def test_strict_runs(repo, spark):
    code, text = cli.run(["map", str(repo), "--strict", "--json", "--now", str(NOW)])
    assert code == cli.STRICT and json.loads(text)["quality"]["issues"] == ["partial"]
    assert cli.run(["map", str(repo), "--strict", "--json", "--now", str(NOW), "--focus-path", "src/one.rs"])[0] == cli.OK
    assert cli.run(["map", str(repo), "--no-cache", "--cache-mode", "auto"])[0] == cli.USAGE and cli.run(["map", str(repo), "--cache-mode", "files"])[0] == cli.USAGE
    assert "\x1b[1m# Source map" in cli.run(["map", str(repo), "--color", "always", "--now", str(NOW)])[1]


def test_plan_and_explain(found):
    plan = found.reading_plan()["recommendations"]
    assert plan[0]["path"] == "README.md" and plan[0]["purpose"] == "start_here" and 5 <= len(plan) <= 10
    assert {p["purpose"] for p in plan} >= {"start_here", "architecture", "tests"}
    one = found.explain("duplicate")
    assert one["kind"] == "symbol" and {s["path"] for s in one["symbols"]} >= {"src/one.rs", "src/two.rs"}
    assert found.explain("src/nul.rs")["omissions"][0]["reason"] == "binary" and found.explain("zzz")["kind"] == "unmatched"


def test_scopes(repo):
    assert git.discover(str(repo / "src")) == os.path.realpath(repo) and git.resolve_scope(str(repo), str(repo / "src")) == "src"
    for bad in ("/", str(repo / "src/link.rs"), str(repo / "README.md")):
        with pytest.raises(git.RepositoryError):
            git.resolve_scope(str(repo), bad)


def test_bounded_reads_follow_no_link(repo):
    assert worktree.read_bounded(str(repo), "README.md", 2) == b"# x" and worktree.read_bounded(str(repo), "src/link.rs", 9) is None and worktree.read_bounded(str(repo), "gone", 9) is None
    assert ("src/link.rs", True) in list(worktree.walk(str(repo)))


def test_nested_repositories_are_passed_over(repo, tmp_path):
    sh(tmp_path, "init", "-q")
    (tmp_path / "in").mkdir()
    sh(tmp_path / "in", "init", "-q")
    (tmp_path / "in/x").write_text("")
    assert list(worktree.walk(str(tmp_path))) == [] and ("in/x", False) in list(worktree.walk(str(tmp_path), recursive=True))


def test_mailmap_forms():
    assert git.mailmap_entry("Proper <p@x>") == ("Proper", None, None, "p@x")
    assert git.mailmap_entry("<p@x> <c@x>") == (None, "p@x", None, "c@x")
    assert git.mailmap_entry("P <p@x> C N <c@x>  # note") == ("P", "p@x", "C N", "c@x") and git.mailmap_entry("# note") is None


def test_command_line(repo, tmp_path, spark):
    code, text = cli.run(["history", "churn", str(repo), "--json", "--now", str(NOW)])
    assert code == cli.OK and json.loads(text)["churn"] and "activity" not in json.loads(text)
    assert cli.run(["map", str(repo), "--tokens", "0"])[0] == cli.USAGE and cli.run(["explain", " ", str(repo)])[0] == cli.USAGE
    assert cli.run(["map", str(tmp_path)])[0] == cli.UNSAFE and cli.run(["nonsense"])[0] == cli.USAGE
    assert cli.run(["doctor"])[0] == cli.OK and "python" in cli.run(["capabilities"])[1]


def test_cache_table(spark, tmp_path):
    path = str(tmp_path / "cache")
    import datetime

    from wayfind.operators.cache import RECORDS

    none = ", ".join(f"null as {c}" for c in ("language", "query_digest", "fingerprint", "payload"))
    table = Snapshots(spark, path, RECORDS)
    table.append(spark.sql(f"select 'r' as repository_id, 'a' as path, timestamp'2024-01-01' as created_at, 5L as bytes, {none}").select(*(c.split()[0] for c in RECORDS.split(", "))))

    assert cache_control(spark, path, "status").first()["bytes"] == 5
    assert cache_control(spark, path, "prune", datetime.datetime(2024, 1, 5)).first()["records"] == 1
    cache_control(spark, path, "clear")
    assert table.read().count() == 0 and table.versions() == [1, 2, 3]


def test_shared_tables(spark):
    df = storage.materialize(spark.range(10), "test")
    assert df.count() == 10 and "wayfind-tables/test-" in df.inputFiles()[0]
    held = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(held)
    storage.release(df)
    storage.release(df)
    storage.release(spark.range(3))
    assert not os.path.exists(held)
    assert storage.fresh(spark.range(1).withColumnRenamed("id", "Near_x"), "near") == "_near"


def test_stream_of_commits(spark, tmp_path):
    spark.createDataFrame([("a", "Fix bug"), ("b", "prefix")], "id string, message string").write.parquet(str(tmp_path / "in"))
    stream = keyword_alerts(spark.readStream.schema("id string, message string").parquet(str(tmp_path / "in")), ("fix", "bug"))
    query = stream.writeStream.format("memory").queryName("alerts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.sql("select id, matched_terms from alerts").collect()] == [("a", ["bug", "fix"])]


def test_without_the_optional_subpackage(tmp_path):
    import shutil
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "wayfind", tmp_path / "wayfind", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'churn' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
