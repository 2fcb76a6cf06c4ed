import os
import subprocess
from dataclasses import replace

import pytest

from wayfind.operators import history as H
from wayfind.operators import trees as T
from wayfind.plans import report
from wayfind.plans.engine import Repository
from wayfind.settings import BUG_KEYWORDS, COMPACT, FIREFIGHTING_KEYWORDS, HistorySettings, MapSettings
from wayfind.sources import git

NOW = 1_700_000_000


def sh(repo, *args, day=0, who=("Maintainer", "maintainer@example.com")):
    at = f"{NOW - day * 86_400} +0000"
    env = os.environ | {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at, "GIT_AUTHOR_NAME": who[0], "GIT_AUTHOR_EMAIL": who[1], "GIT_COMMITTER_NAME": who[0], "GIT_COMMITTER_EMAIL": who[1], "GIT_CONFIG_GLOBAL": "/dev/null"}
    return subprocess.run(["git", "-C", str(repo), *args], env=env, check=True, capture_output=True, text=True).stdout


def put(repo, path, text):
    target = repo / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = tmp_path_factory.mktemp("history")
    alice, bob = ("Alice", "alice@example.com"), ("Bob", "bob@example.com")
    sh(r, "init", "-q", "-b", "main")

    def commit(message, day, who, **files):
        for path, text in files.items():
            put(r, path.replace("__", "/").replace("_dot_", "."), text)
        sh(r, "add", "-A")
        sh(r, "commit", "-q", "-m", message, day=day, who=who)

    commit("Initial import", 400, alice, legacy_dot_txt="x")
    commit("Implement fixture prefix debug parser", 200, ("Robert Alias", "ALIAS@example.com"), src__lib_dot_rs="pub fn a() {}\n")
    sh(r, "branch", "side")
    commit("Fix parser bug", 20, alice, src__lib_dot_rs="pub fn a() { b() }\n")
    sh(r, "checkout", "-q", "side")
    commit("Emergency hotfix side work", 15, ("Carol", "carol@example.com"), src__lib_dot_rs="pub fn a() { b() }\n", src__side_dot_rs="fn s() {}\n")
    sh(r, "checkout", "-q", "main")
    sh(r, "merge", "-q", "--no-ff", "side", "-m", "Merge side work", day=5)
    sh(r, "rm", "-q", "src/side.rs")
    commit("Rollback entrypoint", 2, bob, _dot_mailmap="Bob <bob@example.com> Robert Alias <alias@example.com>\n", src__binary_dot_rs=b"\0\1", src__empty_dot_rs="", src__generated_dot_rs="// generated\n", src__main_dot_rs="fn main() {}\n")
    return r


@pytest.fixture(scope="module")
def relations(spark, repo):
    return git.read(spark, "git_commits", str(repo)).cache(), git.read(spark, "git_paths", str(repo)).cache()


def test_counts_and_churn(relations):
    commits, paths = relations
    assert H.commit_counts(commits).first().asDict() == {"commits_seen": 6, "non_merge_commits_seen": 5}
    counts = {r["path"]: r["commits"] for r in H.churn(commits, paths, HistorySettings(now=NOW)).collect()}
    assert counts["src/lib.rs"] == 3 and "legacy.txt" not in counts and "src" not in counts


def test_scope(relations):
    commits, paths = relations
    scoped = H.scoped_commits(commits, paths, "src")
    assert H.commit_counts(scoped).first().asDict() == {"commits_seen": 4, "non_merge_commits_seen": 4}
    assert sum(r["commits"] for r in H.activity(scoped).collect()) == 4
    assert sum(r["commits"] for r in H.activity(commits).collect()) == 6


def test_bugs_and_fires(relations):
    commits, paths = relations
    s = HistorySettings(now=NOW)
    bugs = H.evidence_commits(commits, paths, s, BUG_KEYWORDS).collect()
    assert [(b["subject"], b["paths"], b["matched_terms"]) for b in bugs] == [("Fix parser bug", ["src/lib.rs"], ["bug", "fix"])]
    loose = HistorySettings(now=NOW, substring=True)
    assert H.evidence_commits(commits, paths, loose, BUG_KEYWORDS).count() == 3
    assert H.evidence_commits(commits, paths, s, FIREFIGHTING_KEYWORDS).count() == 2
    overlap = H.bug_overlap(H.keyword_paths(commits, paths, s, BUG_KEYWORDS), H.churn(commits, paths, s)).collect()
    assert [(r["path"], r["commits"]) for r in overlap] == [("src/lib.rs", 1)]


def test_mailmap(spark, relations, repo):
    commits, _ = relations
    entries = git.committed_mailmap(str(repo))
    assert entries == [("Bob", "bob@example.com", "Robert Alias", "alias@example.com")]
    mailmap = spark.createDataFrame(entries, "proper_name string, proper_email string, commit_name string, commit_email string")
    people = {r["name"]: r["commits"] for r in H.contributors(H.identities(commits, mailmap), HistorySettings(now=NOW)).collect()}
    assert people == {"Bob": 2, "Alice": 2, "Carol": 1}
    assert H.identity_mappings(H.identities(commits, mailmap)).collect()[0]["raw_name"] == "Robert Alias"


def test_sizes_at_head(spark, relations, repo):
    commits, paths = relations
    blobs = git.read(spark, "git_tree", str(repo), content=True).select("path", "content")
    s = HistorySettings(now=NOW)
    status = {r["path"]: r["size_status"] for r in H.head_sizes(H.churn(commits, paths, s), blobs, s, 50).collect()}
    want = {"src/lib.rs": "text", "src/generated.rs": "generated", "src/empty.rs": "empty", "src/binary.rs": "binary", "src/side.rs": "missing_at_head"}
    assert {k: status[k] for k in want} == want


def test_windows_use_their_own_time(spark):
    commits = spark.createDataFrame([(0, "a", ["p"], "N", "n@x", NOW - 10, NOW - 400 * 86_400, "fix"), (1, "b", ["p"], "N", "n@x", NOW - 400 * 86_400, NOW + 5, "fix")], "seq int, id string, parents array<string>, author_name string, author_email string, author_seconds long, committer_seconds long, message string")
    paths = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, path string")
    s = HistorySettings(now=NOW)
    assert [r["path"] for r in H.churn(commits, paths, s).collect()] == ["y"]  # committer time, and no end
    assert H.contributors(H.identities(commits), s, recent=True).collect()[0]["commits"] == 1


def test_observations():
    rows = {"churn": [{"path": "a", "commits": 2}], "contributors_recent": [{"name": "x", "commits": 1}], "contributors_overall": [{"name": "x", "commits": 3}],
            "bug_overlap": [{"path": "a", "commits": 1}], "activity": [{"month": "2020-01", "commits": 2}, {"month": "2020-02", "commits": 2}], "firefighting": [{"paths": ["a", "b"]}, {"paths": ["b"]}]}
    made = {o["kind"]: o for o in H.observations(rows, {"bug_commits": 1})}
    assert list(made) == ["churn", "contributors", "bug_overlap", "activity", "firefighting"]
    assert made["contributors"]["window"] == "overall" and made["activity"]["busiest"]["month"] == "2020-02"
    assert made["firefighting"]["paths"][0] == {"path": "b", "commits": 2}
    assert H.observations({}, {}) == []
    assert H.completeness(True, 0, {"paths": 0}) == {"status": "shallow", "authoritative": False}
    assert H.completeness(False, 0, {"paths": 3, "commits": 0}) == {"status": "partial", "authoritative": False, "losses": {"paths": 3}}
    assert H.completeness(True, 0, {"unread_commits": 1})["status"] == "missing_objects"


def test_whole_history_report(spark, repo):
    r = Repository(spark, str(repo), MapSettings(), HistorySettings(now=NOW))
    made = r.history()
    assert made["counts"]["commits_seen"] == 6 and made["completeness"]["status"] == "complete"
    assert report.render_json(made) == report.render_json(r.history())  # the same again
    assert "## Churn" in report.render_markdown(made)
    with pytest.raises(report.TooLarge):
        report.render_json(made, ceiling=10)


def test_tree_comparison_equals_git_and_skips_equal_subtrees(spark, repo):
    """Changed paths of every commit by joint descent over the objects themselves, and by Git's own diff."""
    lines = sh(repo, "log", "--format=%H %T %P").split("\n")
    commits = {x[0]: (x[1], x[2:]) for line in lines if (x := line.split())}
    plain = [(c, commits[p[0]][0] if p else None, tree) for c, (tree, p) in commits.items() if len(p) < 2]
    opened = []

    def lookup(wanted):
        opened.extend(r["tree"] for r in wanted.collect())
        return git.tree_lookup(str(repo))(wanted)

    found, lost = T.changed_paths(spark.createDataFrame(plain, "id string, old string, new string"), lookup)
    assert {(r["id"], r["path"]) for r in found.collect()} == {(r["id"], r["path"]) for r in git.read(spark, "git_paths", str(repo)).where("path is not null").collect()}
    assert lost.collect() == [] and len(opened) < 2 * sum(len(sh(repo, "ls-tree", "-r", "-t", t).split("\n")) for _, _, t in plain)
    top = sh(repo, "rev-parse", "HEAD^{tree}").strip()
    walked, lost = T.walk(spark.createDataFrame([("h", top)], "id string, tree string"), git.tree_lookup(str(repo)), prune=lambda p: p == "src")
    assert {(r["path"], r["mode"], r["oid"]) for r in walked.collect()} == {(r["path"], r["mode"], r["oid"]) for r in git.read(spark, "git_tree", str(repo)).where("path not like 'src/%'").collect()}
    assert lost.collect() == []


def test_ceilings_of_trees_count_what_they_leave_out(spark):
    entries = [("r", f"f{k}", "100644", f"o{k}") for k in range(6)] + [("r", "d", T.DIRECTORY, "s"), ("r", "gone", T.DIRECTORY, "x"), ("s", "a", "100644", "1"), ("s", "a", "100644", "2"), ("s", "b", "100644", "3")]
    lookup = T.stored(spark.createDataFrame(entries, "tree string, name string, mode string, oid string"))
    roots = spark.createDataFrame([("h", "r"), ("empty", "none")], "id string, tree string")
    losses = lambda got: {(r["id"], r["reason"]): r["n"] for r in got[1].collect()}
    whole = T.walk(roots, lookup)
    assert losses(whole) == {("h", "missing"): 1, ("h", "collisions"): 1, ("empty", "missing"): 1}
    assert sorted(r["path"] for r in whole[0].collect()) == ["d/a", "d/b", *(f"f{k}" for k in range(6))]
    assert losses(T.walk(roots, lookup, max_nodes=4))["h", "nodes"] == 6 and losses(T.walk(roots, lookup, max_entries=3))["h", "entries"] == 5
    assert losses(T.walk(roots, lookup, max_depth=1))["h", "depth"] == 2
    pairs = spark.createDataFrame([("c", None, "r"), ("same", "r", "r"), ("d", "r", None)], "id string, old string, new string")
    changed = T.changed_paths(pairs, lookup)
    assert sorted((r["id"], r["path"], r["before"], r["after"]) for r in changed[0].collect() if r["path"] in ("d/b", "f0")) == [("c", "d/b", None, "3"), ("c", "f0", None, "o0"), ("d", "d/b", "3", None), ("d", "f0", "o0", None)]
    assert losses(T.changed_paths(pairs, lookup, max_paths=5)) == {(i, r): n for i in ("c", "d") for r, n in (("missing", 1), ("collisions", 1), ("paths", 3))}


def test_completeness_goes_by_what_the_scan_lost(spark, repo, monkeypatch):
    def status(limits):
        return Repository(spark, str(repo), MapSettings(), HistorySettings(now=NOW, limits=limits)).history()["completeness"]

    assert status(replace(COMPACT, history_items=1)) == {"status": "complete", "authoritative": True}  # shown in part, counted in full
    assert status(replace(COMPACT, commits=2)) == {"status": "partial", "authoritative": False, "losses": {"commits": 4}}


def test_damaged_clone_is_said_to_miss_objects(spark, repo, tmp_path):
    clone = tmp_path / "damaged"
    subprocess.run(["git", "clone", "-q", "--no-hardlinks", str(repo), str(clone)], check=True, capture_output=True)
    for pack in list((clone / ".git/objects/pack").glob("*.pack")):
        moved = tmp_path / pack.name
        pack.rename(moved)
        with moved.open("rb") as data:
            subprocess.run(["git", "-C", str(clone), "unpack-objects", "-q"], stdin=data, check=True)
    tree = sh(repo, "rev-parse", "HEAD:src").strip()
    (clone / ".git/objects" / tree[:2] / tree[2:]).unlink()
    lost = git.read(spark, "git_paths", str(clone)).where("path is null").collect()
    assert [r["lost"] for r in lost] == [-1]
    assert H.completeness(False, 0, Repository(spark, str(clone), MapSettings(), HistorySettings(now=NOW)).losses)["status"] == "missing_objects"
