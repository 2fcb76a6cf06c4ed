"""The syntax queries read each source in one pass: tokens never become rows that are sorted or dealt out."""

import pyarrow as pa
import pytest

from tests.compare import SF
from wayfind import catalog


@pytest.mark.parametrize("name", ["syntax_declarations", "syntax_errors", "syntax_nodes", "syntax_references"])
def test_tokens_are_never_rows(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "MapInArrow" in plan
    # Documents are dealt out, not the longer sources made of them; sums by path are dealt out once more.
    assert plan.count("Exchange ") == (2 if name == "syntax_nodes" else 1) and plan.index("MapInArrow") < plan.rindex("Exchange ") < plan.rindex("FileScan")


SOURCES = ["class A { b(c) { d(e); } }\nif (f", ") `g\n\n", "", "class H {\n  i(j) { /* ( */ new K(l.m); }\n}", "const\n\n\nn = 'é😀\n' ) o", "/* unended"]


@pytest.mark.parametrize("made", ["_declarations", "_errors", "_nodes", "_references"])
def test_sources_read_at_once_are_read_as_each_alone(made):
    from wayfind.operators import syntax as S

    more = {"_errors": (1,), "_nodes": (tuple(S.NODE),), "_references": (False,)}.get(made, ())
    make = lambda chunk: getattr(S, made)(chunk, *more)

    def rows(sources):
        chunk = S._Chunk("javascript", sources, True)
        found = make(chunk)
        files = [int(k) for k in chunk.file[found.pop("at")]]
        return sorted(zip(files, *(pa.array(v).to_pylist() for v in found.values()), strict=True), key=repr)

    assert rows(SOURCES) == sorted(((k, *r[1:]) for k, s in enumerate(SOURCES) for r in rows([s])), key=repr) != []


def test_chunks_hold_every_source_once(monkeypatch):
    from wayfind.operators import syntax as S

    monkeypatch.setattr(S, "CHUNK_CHARS", 5)
    made = [(f"p{k}", "go" if k % 3 else "lua", "x" * (k % 4)) for k in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made[a : a + 20], strict=True)], ["path", "language", "source"]) for a in (0, 20, 40)]
    found = [(p, lang, s) for lang, paths, sources in S._chunks(batches) for p, s in zip(paths, sources, strict=True)]
    assert sorted(found) == sorted(made) and max(sum(map(len, x[2])) for x in S._chunks(batches)) < 5 + 3


def test_words_that_begin_as_reserved_ones_are_not_reserved():
    from wayfind.operators import syntax as S

    chunk = S._Chunk("typescript", ["class interfacf {} class interface {} class interfaces {} class functio {} class function1 {} class é {}"], True)
    assert S._declarations(chunk)["name"].to_pylist() == ["interfacf", "interfaces", "functio", "function1"]


def test_sources_are_made_of_documents_in_arrow(spark):
    """Statements are not written by Spark's interpreted functions over arrays of words."""
    from wayfind.suite import syntax as X

    plan = X.sources(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "transform" not in plan
    words = " ".join(f"a{'b' * k}" for k in (0, 1, 6, 0, 1, 2, 8, 3, 0, 0, 10, 1, 0, 0, 12, 1, 2))
    batch = pa.RecordBatch.from_arrays([pa.array([3, 12, None, 4]), pa.array([words, None, "a b c d", "é-a.b1c d"])], ["doc_id", "text"])
    found = {r["path"]: r for made in X._sources([batch]) for r in made.to_pylist()}
    assert {k: r["language"] for k, r in found.items()} == {"3": "python", "12": "python", "4": "ruby"}
    assert found["12"]["source"] == "" and found["4"]["source"] == "def a(b)\n  c.d(b)\nend\n"
    assert found["3"]["source"] == (
        "def a(ab, abbbbbb]:\n    return a(ab.abbbbbb]\n"
        "class ab:\n    abb = abbbbbbbb(abbb)\n"
        "a = [a, abbbbbbbbbb(\n    ab)]\n# a ( a\n)\n"
        'a.a(abbbbbbbbbbbb=ab)\nx = """a (\na"""\n\'open\n'
    )
