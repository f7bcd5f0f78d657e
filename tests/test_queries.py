import pytest

from runweave import queries

from . import duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    con.execute(queries.ORACLES[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    assert duck.rows(columns, df.columns, df.collect()) == duck.rows(columns, names, con.fetchall())


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
