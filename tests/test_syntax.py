import pytest

from wayfind.operators import syntax
from wayfind.sources import parser
from wayfind.storage import materialize

COLUMNS = "path string, language string, source string"
N = syntax.MAX_DEPTH
BROKEN = (") fn a() { [ ) }\nfn b(", "fn a() {}", "}}((", "(" * (N + 2))
HIDDEN = {"rust": "// (\n/* { */ fn a() {}", "python": '# (\nx = """(\n"""\n', "lua": "--[[ (\n]] -- (\n", "javascript": "let a = `(\n`;", "go": 'x := ")"'}
SOURCES = {
    "rust": ("rust", "pub fn run(cart: Cart) -> u8 {\n  cart.total(Item::new(f((x))));\n}\nstruct Cart {\n  size: Item,\n}\n"),
    "lua": ("lua", "local a = 1\nfunction M.go(x) if x then y() end end\nfunction M:hit() repeat until z end\nM.k = 2\n"),
    "ruby": ("ruby", "def a\n  b if c\n  if d\nend\n"),
    "unended": ("javascript", "a = 'x\nb = \"y\n"),
    "deep": ("rust", "(" * N + ")" * N),
    "deeper": ("rust", ("(" * (N + 3) + ")" * (N + 3)) * 2),
    "escapes": ("javascript", 'a("' + r"\"x" * 3000 + '", `' + "y" * 100_000 + "`)"),
    "null": ("rust", None), "empty": ("rust", ""), "none": (None, "fn x() {}"), "other": ("cobol", "fn x() {}"), "blank": ("go", " \n\t"),
    **{f"broken{k}": ("rust", s) for k, s in enumerate(BROKEN)},
    **{f"hidden {k}": (k, s) for k, s in HIDDEN.items()},
}


@pytest.fixture(scope="module")
def found(spark):
    """By path: declarations, references and errors."""
    rows = materialize(syntax.analysed(spark.createDataFrame([(k, *v) for k, v in SOURCES.items()], COLUMNS)), "syntax")
    declared = materialize(syntax.declarations(rows), "declared")
    out = {k: ([], [], []) for k in SOURCES}
    for r in declared.collect():
        out[r.path][0].append((r.start, r.name, r.kind, r.owner))
    for r in syntax.references(rows, declared).collect():
        out[r.path][1].append((r.start, r.name, r.kind, r.evidence))
    for r in syntax.errors(rows).collect():
        out[r.path][2].append((r.line, r.start, r.detail))
    return {k: tuple(map(sorted, v)) for k, v in out.items()}


def test_declarations_and_references_share_no_span(found):
    declared, referred, errors = found["rust"]
    assert [d[1:] for d in declared] == [("run", "function", None), ("Cart", "struct", None), ("size", "field", "Cart")]
    assert ("x", "identifier", "call") in [r[1:] for r in referred] and ("total", "field", "call") in [r[1:] for r in referred]
    assert ("Item", "type", "type_reference") in [r[1:] for r in referred]
    assert errors == [] and all(not {d[0] for d in d_} & {r[0] for r in r_} for d_, r_, _ in found.values())


def test_blocks_of_words(found):
    assert [d[1:3] for d in found["lua"][0]] == [("a", "variable"), ("go", "function"), ("hit", "method"), ("k", "field")]
    assert found["lua"][2] == [] and [e[2] for e in found["ruby"][2]] == ["unclosed def"]


def test_comments_and_texts_hide_brackets(found):
    assert [found[f"hidden {k}"][2] for k in HIDDEN] == [[]] * len(HIDDEN)


def test_every_error_is_said_and_reading_goes_on(found):
    assert [e[2] for e in found["broken0"][2]] == ["unexpected )", "closed otherwise: [ )", "unclosed ("]
    assert [(e[0], e[2]) for e in found["unended"][2]] == [(1, "unended text"), (2, "unended text")]


def test_deep_nesting_is_safe_and_said_once_for_each_branch(found):
    assert found["deep"][2] == []
    assert [(e[1], e[2]) for e in found["deeper"][2]] == [(N, f"deeper than {N}"), (3 * N + 6, f"deeper than {N}")]


def test_parser_finds_the_same_errors(found):
    for k, source in enumerate(BROKEN):
        mine = sorted((f["location"]["start"]["line"], f["detail"]) for f in parser.parse(source, "rust").findings)
        assert mine == sorted((line, d if "deeper" not in d else f"Syntax deeper than {N} levels is left out.") for line, _, d in found[f"broken{k}"][2])


def test_nulls_empties_other_languages_and_long_texts(found):
    assert all(found[k] == ([], [], []) for k in ("null", "empty", "none", "other", "blank"))
    assert found["escapes"][2] == []
