import pytest
from compare import assert_same, connection

from lineweave.queries import QUERIES
from lineweave.sql import SQL
from lineweave.work_sql import WORK_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - set(WORK_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark):
    """Scans read what they need, filters reach them, and as-of and interval joins are no nested loops."""
    plan = lambda n: QUERIES[n](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan("line_explode_stats")
    assert "EqualTo(event_type,click)" in plan("asof_prev_event")
    for name in ("asof_prev_event", "interval_match", "name_tier_join", "anchor_match", "longest_prefix"):
        assert "NestedLoop" not in plan(name) and "Cartesian" not in plan(name)
    for name in ("resegment_local", "split_and_render", "legal_cut_levels"):  # folds of columns, no Python worker
        assert "EvalPython" not in plan(name)
