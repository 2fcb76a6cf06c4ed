import pytest
from pyspark.sql import functions as F

from wayfind.operators import graph as G
from wayfind.schemas import SYMBOLS
from wayfind.sources import parser

AT = {"start": {"line": 1, "column": 1}, "end": {"line": 1, "column": 2}}


def symbols(spark, rows):
    """(path, language, name, kind, role, context, visibility, evidence) rows, numbered by file."""
    seq, out = {}, []
    for path, lang, name, kind, role, context, seen, evidence in rows:
        seq[path] = seq.get(path, -1) + 1
        out.append((path, seq[path], lang, name, kind, role, [], AT, context, seen, evidence))
    return spark.createDataFrame(out, SYMBOLS)


def define(path, lang, name, seen="public", kind="function"):
    return path, lang, name, kind, "definition", "", seen, "declaration"


def use(path, lang, name, evidence="call"):
    return path, lang, name, "function", "reference", "", "unknown", evidence


def take(path, lang, name, context):
    return path, lang, name, "import", "definition", context, "unknown", "import"


def package(path, name):
    return path, "go", name, "module", "definition", "", "unknown", "declaration"


def edges(spark, rows, **caps):
    return [(r["source"], r["target"], r["symbol"], r["resolution_reason"], r["confidence"]) for r in G.lexical_edges(symbols(spark, rows), **caps).orderBy("source", "target").collect()]


def test_a_bare_name_across_files_is_no_edge(spark):
    assert edges(spark, [define("target.rs", "rust", "target"), use("caller.rs", "rust", "target")]) == []


def test_imported_module(spark):
    rows = [define("target.rs", "rust", "target"), take("imported.rs", "rust", "target", "use crate::target::target;"), use("imported.rs", "rust", "target")]
    assert edges(spark, rows) == [("imported.rs", "target.rs", "target", "imported_module", "high")]
    rows = [define("app/helper.lua", "lua", "transform"), define("app/helper.js", "javascript", "transform"), take("app/main.lua", "lua", "h", "local h = require('app.helper')"), use("app/main.lua", "lua", "transform")]
    assert edges(spark, rows) == [("app/main.lua", "app/helper.lua", "transform", "imported_module", "high")]


def test_dotted_module_is_one_file(spark):
    rows = [define("foo.bar.js", "javascript", "t"), define("foo/bar.js", "javascript", "t"), take("c.js", "javascript", "t", "import { t } from './foo.bar.js';"), use("c.js", "javascript", "t")]
    assert [e[1] for e in edges(spark, rows)] == ["foo.bar.js"]


def test_go_packages(spark):
    same = [package("service/build.go", "service"), define("service/build.go", "go", "New"), package("service/caller.go", "service"), use("service/caller.go", "go", "New")]
    assert edges(spark, same) == []  # New is a generic name
    same = [tuple("Build" if x == "New" else x for x in r) for r in same]
    assert edges(spark, same) == [("service/caller.go", "service/build.go", "Build", "same_module", "high")]
    apart = [package("one/a.go", "service"), define("one/a.go", "go", "Build"), package("two/b.go", "service"), use("two/b.go", "go", "Build")]
    assert edges(spark, apart) == []
    path = [define("internal/client/build.go", "go", "Build"), take("cmd/app/main.go", "go", "client", 'import "example.com/x/internal/client"'), use("cmd/app/main.go", "go", "Build")]
    assert edges(spark, path) == [("cmd/app/main.go", "internal/client/build.go", "Build", "imported_module", "high")]


def test_own_file_comes_first_and_ends_the_search(spark):
    rows = [define("a.py", "python", "f"), define("b.py", "python", "f"), take("a.py", "python", "f", "from b import f"), use("a.py", "python", "f")]
    assert edges(spark, rows) == [("a.py", "a.py", "f", "same_file_explicit", "high")]
    bare = rows[:-1] + [use("a.py", "python", "f", "bare_reference")]
    assert edges(spark, bare) == []


def test_ambiguity_and_caps(spark):
    rows = [define("one.js", "javascript", "dup"), define("two.js", "javascript", "dup", "private"), take("x.js", "javascript", "dup", "import { dup } from 'unknown-module';"), use("x.js", "javascript", "dup"), use("x.js", "javascript", "dup")]
    found = G.lexical_edges(symbols(spark, rows)).collect()
    assert {(e["target"], e["ambiguous"], e["confidence"], e["target_visibility"]) for e in found} == {("one.js", True, "medium", "public"), ("two.js", True, "medium", "private")}
    assert len({e["candidate_group"] for e in found}) == 1 and G.ambiguity_groups(G.lexical_edges(symbols(spark, rows))).first()["candidates"] == 2
    assert len(edges(spark, rows, max_candidates=1)) == 1 and len(edges(spark, rows, max_edges=1)) == 1 and edges(spark, rows, max_edges=0) == []


def plain_rank(nodes, links, passes=24, d=0.85):
    rank = {n: 1 / len(nodes) for n in nodes}
    out = {}
    for s, _, w in links:
        out[s] = out.get(s, 0) + w
    for _ in range(passes):
        lost = sum(r for n, r in rank.items() if n not in out)
        new = {n: (1 - d) / len(nodes) + d * lost / len(nodes) for n in nodes}
        for s, t, w in links:
            new[t] += d * rank[s] * w / out[s]
        rank = new
    return rank


@pytest.mark.parametrize("small", [True, False])
def test_rank_equals_plain_passes(spark, monkeypatch, small):
    nodes = [f"n{k}" for k in range(9)]
    links = [(f"n{k}", f"n{(k * k + 1) % 9}", 1.0 + k % 3) for k in range(7)] + [("n1", "n1", 2.0), ("n0", "n3", 1.0), ("n0", "n3", 1.0)]
    if not small:
        monkeypatch.setattr(G, "SMALL_GRAPH", 0)
    frame, edge = spark.createDataFrame([(n,) for n in nodes], "path string"), spark.createDataFrame(links, "source string, target string, weight double")
    got = {r["path"]: r["rank"] for r in G.page_rank(frame, edge).collect()}
    want = plain_rank(nodes, links)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in nodes) and abs(sum(got.values()) - 1) < 1e-9
    assert G.page_rank(frame.where("false"), edge).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_rank_leaves_out_edges_to_unknown_paths(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(G, "SMALL_GRAPH", 0)
    nodes, links = ["a", "b", "c"], [("a", "b", 1.0), ("a", "gone", 3.0), ("b", "gone", 1.0), ("gone", "c", 1.0)]
    edge = spark.createDataFrame(links, "source string, target string, weight double")
    got = {r["path"]: r["rank"] for r in G.page_rank(spark.createDataFrame([(n,) for n in nodes], "path string"), edge).collect()}
    want = plain_rank(nodes, links[:1])
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in nodes)


def test_focus_boosts(spark):
    ranks = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "path string, rank double")
    matches = spark.createDataFrame([("b", 2, True)], "path string, text_matches int, path_match boolean")
    assert [(r["path"], r["score"], r["focus_matches"]) for r in G.file_ranking(ranks, matches).collect()] == [("b", 1_900_000, 3), ("a", 500_000, 0)]


SOURCES = {
    "rust": ("use crate::a::b;\npub struct S { pub x: i32,\n}\nfn f() { g(h); }\n", {("struct", "S", "public"), ("function", "f", "unknown"), ("import", "b", "unknown")}, {("g", "call"), ("h", "call")}),
    "javascript": ("import { t } from './m.js';\nexport function run() { t(); }\nclass A {}\n", {("function", "run", "public"), ("class", "A", "unknown"), ("import", "t", "unknown")}, {("t", "call")}),
    "typescript": ("interface I {}\nexport const z = 1;\ntype T = string;\nenum E {}\n", {("interface", "I", "unknown"), ("variable", "z", "public"), ("type", "T", "unknown"), ("enum", "E", "unknown")}, set()),
    "python": ("from a import b as c\nclass K:\n    def m(self):\n        return c(1)\n", {("import", "c", "unknown"), ("class", "K", "unknown"), ("function", "m", "unknown")}, {("c", "call")}),
    "ruby": ("class A\n  def run(x)\n    foo(x)\n  end\nend\n", {("class", "A", "unknown"), ("method", "run", "unknown")}, {("foo", "call")}),
    "java": ("package p.q;\nimport x.Y;\npublic class C {\n    private int v;\n    public void m() { h(); }\n}\n", {("module", "p.q", "unknown"), ("class", "C", "public"), ("field", "v", "private"), ("method", "m", "public"), ("import", "Y", "unknown")}, {("h", "call")}),
    "c_sharp": ("using System.Text;\nnamespace N {\n  public class C {\n    internal void M() { H(); }\n  }\n}\n", {("module", "N", "unknown"), ("class", "C", "public"), ("method", "M", "internal"), ("import", "Text", "unknown")}, {("H", "call")}),
    "go": ('package p\nimport "a/b"\nfunc Run() { call(x) }\ntype t struct {\n\tName string\n}\n', {("module", "p", "unknown"), ("function", "Run", "public"), ("struct", "t", "internal"), ("field", "Name", "public"), ("import", "a/b", "unknown")}, {("call", "call")}),
    "lua": ('local h = require("a.b")\nfunction M.run() h.go(1) end\n', {("variable", "h", "internal"), ("import", "a.b", "unknown"), ("function", "run", "public")}, {("go", "call")}),
}


@pytest.mark.parametrize("lang", SOURCES)
def test_parser_by_language(lang):
    source, defs, calls = SOURCES[lang]
    found = parser.parse(source, lang)
    assert {(s["kind"], s["name"], s["visibility"]) for s in found.symbols if s["role"] == "definition"} == defs
    assert calls <= {(s["name"], s["evidence"]) for s in found.symbols if s["role"] == "reference"}
    assert found.status == "complete"


def test_parser_reports_broken_sources_and_ignores_comments():
    assert parser.parse("fn f( {", "rust").findings[0]["kind"] == "parse_error" and parser.parse("def f(:", "python").status == "partial"
    assert [s for s in parser.parse('// fn no() {}\n/* struct N; */ let s = "fn nor";', "rust").symbols if s["role"] == "definition"] == []
    assert len(parser.parse("fn a() {}\nfn b() {}\n", "rust", max_symbols=1).symbols) == 1
    assert parser.parse("", "go").symbols == []


def test_parse_files_in_spark(spark):
    files = spark.createDataFrame([("a.rs", "rust", b"fn a() {}"), ("b.py", "python", b"def b(): pass")], "path string, language string, content binary")
    assert {(r["path"], r["name"]) for r in parser.parse_files(files).where(F.col("role") == "definition").collect()} == {("a.rs", "a"), ("b.py", "b")}
    assert parser.parse_findings(files).count() == 0
