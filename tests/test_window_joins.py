"""Rows of windows meet per-window values where they are, and made columns are made once."""

import pytest

from winnow.operators import estimate as E
from winnow.plans import estimation as Q
from winnow.plans import measures as M  # noqa: F401 - registers a36
from winnow.plans.registry import QUERIES
from winnow.settings import DEFAULTS as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_window_rows_are_not_shuffled(spark, sf, no_auto_broadcast):
    rows = Q.window_rows(spark, sf, keys=())
    assert rows.columns == ["batch_id", "step", "x", "h"]
    assert "SortMergeJoin" not in plan(rows)
    ranked, _ = E.size_classes(rows, Q.exact_reference(spark, sf), Q.BS, S.size_classes)
    assert "SortMergeJoin" not in plan(ranked)


def test_scan_columns_are_made_once(spark, sf):
    assert "lineitem" not in plan(QUERIES["a36_solver_tables_by_snr"](spark, sf))
