"""Every query with SQL against DuckDB; the others by shape."""

import pytest
from compare import compare

from netloom import queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", ["cal_pcnet", "d_regulation", "make_networks", "manifold_alignment", "pca_tables"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
