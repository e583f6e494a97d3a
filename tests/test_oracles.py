"""Every query with an SQL meaning matches its DuckDB oracle (sf0.001 here;
the driver and ``python -m ratelens.plans.verify`` run sf0.01)."""
import pytest

from ratelens.plans.catalog import MODEL_QUERIES, QUERIES
from ratelens.plans.oracles import oracle_sql
from ratelens.plans.verify import compare, duck_connect
from conftest import SF_SMALL

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


def test_every_non_model_query_has_an_oracle():
    assert set(QUERIES) - MODEL_QUERIES == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert ok, msg
