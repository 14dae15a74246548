"""Every SQL-checked registered query equals its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE
from tests.helpers import canon

SQL = E.oracle_sql()
QUERIES = E.queries()


def test_every_query_is_registered_with_ids():
    from strata.plans import REGISTRY

    assert len(QUERIES) >= 80
    for name, entry in REGISTRY.items():
        assert entry.ids, name
        assert not name.startswith("op"), name


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMOKE)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    res = duck.execute(SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == canon(res.fetchall(), cols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "total_revenue" in df.columns
