"""The queries of tries, repeats and manifests against their SQL."""

import pytest

from tests.compare import SF, connection, rows
from wayfind.llm import queries


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_suffix_dedup", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(connection().sql(queries.oracle_sql()[name]).df())
