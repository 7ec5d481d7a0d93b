"""Every query of the memory engine against its SQL, or that it runs."""

import pytest

from palimpsest.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, same, name):
    same(QUERIES[name](spark, sf), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_nearest_needs_no_shuffle_of_rows(spark, sf):
    plan = QUERIES["knn_l1_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange hashpartitioning" not in plan
    plan = QUERIES["point_lookup_pushdown"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
