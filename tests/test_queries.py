"""Every registered query against its SQL, and the shape of its plan."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from verification import registry
from verification.compare import canonical, oracle_rows

SF = "/root/testdata/sf0.001"
PYTHON = {
    "composed_text", "similarity_scores", "near_duplicates_removed", "near_duplicates_removed_per_source",
    "contained_duplicates_removed", "cleaned_and_deduplicated", "cleaning_audit_with_near_duplicates", "batch_labeller",
    "labeller_out_of_quota", "near_duplicates_of_one_opening",
}
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and {"source", "total", "toxic", "toxic_rate_pct"} == set(rows[0].asDict())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "REPARTITION_BY" not in plan
    if name not in PYTHON:
        assert "ArrowEvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan
    result = canonical(df.columns, df.collect())
    if name in ORACLES:
        assert result == oracle_rows(SF, ORACLES[name])
