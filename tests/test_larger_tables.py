"""Queries over tables that are large where it matters: many rows of one folder, one name, one file."""

import duckdb
import pytest

from tests.compare import SF, connection, rows
from wayfind import catalog


@pytest.fixture(scope="module")
def one_folder(tmp_path_factory):
    """5,000 parts of one type and brand: more than a folder's usual ceiling."""
    at = str(tmp_path_factory.mktemp("one_folder"))
    con = duckdb.connect()
    con.sql(f"copy (select * replace (20 * i + p_partkey % 20 as p_partkey, 'ECONOMY BRASS' as p_type, 'Brand#11' as p_brand) from '{SF}/part.parquet', range(250) r(i) where p_partkey < 20) to '{at}/part.parquet'")
    con.sql(f"copy (select * from '{SF}/nation.parquet') to '{at}/nation.parquet'")
    return at


@pytest.mark.parametrize("name", ["tree_changes", "tree_losses", "tree_walk"])
def test_trees_of_one_large_folder(spark, one_folder, name):
    got = catalog.queries()[name](spark, one_folder).toPandas()
    assert rows(got) == rows(connection(one_folder).sql(catalog.oracle_sql()[name]).df())


def test_files_of_one_read_are_parsed_in_many_parts(spark):
    """A small table is read by one task; its files are parsed by as many as shuffles have."""
    from wayfind.sources import parser

    files = spark.range(64).coalesce(1).selectExpr("cast(id as string) as path", "'rust' as language", "cast(concat('fn name', id, '() {}') as binary) as content")
    made = parser.parse_payloads(files)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert {r["name"] for r in parser.parse_files(files).collect()} == {f"name{k}" for k in range(64)}


def test_a_common_names_candidates_are_cut_before_references_meet_them(spark):
    from wayfind.operators import graph as G

    targets = spark.range(100).selectExpr("'go' as language", "'n' as name", "lpad(id, 3, '0') as target", "'public' as target_visibility")
    found = G._first_candidates(targets.unionAll(targets), ["language", "name"], 32).collect()
    assert len(found) == 1 and sorted(c["target"] for c in found[0]["found"]) == [f"{k:03d}" for k in range(32)]


def test_syntax_of_more_text_is_dealt_out_in_more_parts_once(spark):
    """Memory of a task goes by its part of the text; no window or join deals tokens out again."""
    from wayfind.operators import syntax

    files = spark.range(6).selectExpr("cast(id as string) as path", "'rust' as language", "repeat('fn a(b: C) { d(e); }\n', 50000) as source")
    rows = syntax.analysed(files)
    assert rows.rdd.getNumPartitions() == syntax.parts(files) == 7 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for found in (syntax.nodes(rows), syntax.errors(rows), syntax.declarations(rows), syntax.references(rows)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_references_of_more_symbols_are_dealt_out_in_more_parts(spark, monkeypatch):
    """Memory of a task goes by its symbols, and candidates are cut before the one time that they are dealt out."""
    from wayfind.operators import graph as G

    monkeypatch.setattr(G, "PART_SYMBOLS", 40)
    line = "'go' as language, 'a' as name, '{}' as kind, '{}' as role, 1 as seq, cast(null as string) as context, 'public' as visibility, 'call' as evidence"
    make = lambda kind, role: spark.range(200).selectExpr("concat('d/f', id, '.go') as path", *line.format(kind, role).split(", "))
    edges = G.lexical_edges(make("function", "definition").unionAll(make("identifier", "reference")))
    assert edges.count() == 200 and edges.rdd.getNumPartitions() == 10 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    targets = spark.range(100).selectExpr("'n' as name", "cast(id as string) as target", "'public' as target_visibility")
    assert G._first_candidates(targets, ["name"], 32)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_passes_of_the_ranking_leave_edges_where_they_are(spark):
    from wayfind.storage import bucketed

    share = spark.range(1000).selectExpr("cast(id % 10 as string) as source", "cast(id as string) as target", "0.01d as share")
    ranks = spark.range(10).selectExpr("cast(id as string) as path", "0.1d as rank")
    with bucketed(share, "source", 6, "test") as table:
        joined = table.join(ranks.hint("shuffle_hash"), table["source"] == ranks["path"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000 and plan.count("Exchange ") == 1 and "Sort " not in plan
    assert not [t.name for t in spark.catalog.listTables() if "wayfind_test" in t.name]


def test_candidates_of_a_plan_are_summed_once(spark, monkeypatch):
    from wayfind.plans import reading as R

    rows = spark.range(30).selectExpr(
        "'tests' as purpose", "cast(id as string) as path", "'r' as project_root", "array('graph') as evidence_kinds", "'why' as reason", "array('x') as limitations", "id as score", "'high' as confidence"
    )
    made = []
    monkeypatch.setattr(R, "materialize", lambda df, label, keep=R.materialize: made.append(keep(df, label)) or made[-1])
    assert len(R.shortlist(R.combine(rows))) == 30 and len(made) == 1
