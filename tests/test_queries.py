import pytest

from tests.compare import assert_same, connection
from tests.conftest import DATA
from treeline.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert_same(QUERIES[name](spark, DATA), con, SQL[name])


def test_entry_runs_without_training_data_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["map_by_id"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,42)]" in plan
    plan = QUERIES["unread_count_by_user"](spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<user_id:bigint,props:string>" in plan
