import pytest
from compare import same, tables

from rotorlake.plans import queries_eval, queries_stream

SF = "/root/testdata/sf0.001"
Q, O = {**queries_eval.Q, **queries_stream.Q}, {**queries_eval.O, **queries_stream.O}


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(O))
def test_query_equals_sql(spark, con, name):
    same(Q[name](spark, SF), con, O[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
