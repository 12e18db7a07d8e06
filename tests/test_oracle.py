"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

import __spark_entry__ as entry
from limnetic.catalog import QUERIES
import check

PYTHON = {"regression_pvalue", "anova_pvalue", "tukey_pvalue", "grouped_map_udf", "mean_ci_boot", "smooth_spline", "smooth_spline_early"}


@pytest.fixture(scope="module")
def con(small):
    return check.connect(small)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, small, key):
    df = QUERIES[key](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if key not in PYTHON:
        assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan
    state, rows, note = check.compare_frame(df, con, key)
    assert state in ("ok", "rows"), note
    assert rows > 0
    assert not note, note


def test_entry(spark):
    df = entry.entry(spark)
    assert "fish_ha" in df.columns and df.count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
