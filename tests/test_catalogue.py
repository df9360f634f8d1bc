"""Every query against its SQL on the smallest tables."""

import pytest

from foliospark.plans.catalogue import QUERIES, SQL

from .conftest import SF


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_the_columns_they_need(spark):
    plan = QUERIES["q_clean_stats_page"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = QUERIES["q_logs_after_cursor"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,10)" in plan and "TakeOrderedAndProject" in plan


def test_no_plan_has_a_product(spark):
    for name in ("q_normalized_merge", "q_audit_summary", "q_resume_violations", "q_render_markdown", "q_batch_plan"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
