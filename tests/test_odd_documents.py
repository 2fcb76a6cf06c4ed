"""Queries over documents that hold no letter, no text or nothing at all."""

import pytest

from tests.compare import connection, rows
from wayfind import catalog

TEXTS = ["4566 0956 5849\n---", "Python speaks.\nQuel kgn", "", None, "12\n34", "123 été"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Each text once in every language: 4 x 6 documents."""
    at = str(tmp_path_factory.mktemp("odd"))
    made = [(k * 10 + i, text, lang, "s", len(text or "")) for k, lang in enumerate(("en", "de", "fr", "es")) for i, text in enumerate(TEXTS)]
    frame = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").toPandas()
    frame.to_parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["focus_matches", "focus_matches_many"])
def test_files_without_a_symbol_are_counted_too(spark, odd, name):
    got = catalog.queries()[name](spark, odd).toPandas()
    want = connection(odd).sql(catalog.oracle_sql()[name]).df()
    assert len(want) == 20 and rows(got) == rows(want)
