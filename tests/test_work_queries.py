import pytest
from compare import assert_same, connection

from lineweave.queries import QUERIES
from lineweave.work_queries import WORK_QUERIES
from lineweave.work_sql import WORK_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(WORK_SQL))
def test_against_sql(spark, con, name):
    assert_same({**QUERIES, **WORK_QUERIES}[name](spark, SF), con, WORK_SQL[name])


def test_every_query_has_sql():
    assert set(WORK_QUERIES) <= set(WORK_SQL) <= set(WORK_QUERIES) | set(QUERIES)
