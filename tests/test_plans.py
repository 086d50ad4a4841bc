"""Plan properties that the scale design relies on (checked on the physical
plans Catalyst produces, at the smallest scale factor)."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

STREAMS = {"cdc_stream", "cdc_stream_dead_letter", "alert_stream"}


def _plan(spark, name):
    return E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def _formatted(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[name](spark, SF_SMALL).explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - STREAMS))
def test_no_cross_join(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name,pushed", [("agg_match", "EqualTo(o_orderstatus,F)"),
                                         ("slow_queries", "GreaterThanOrEqual(value,100.0)")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in _formatted(spark, name)


@pytest.mark.parametrize("name", ["latest_run", "run_history", "slow_queries", "alert_rule_list"])
def test_per_key_top_k_is_a_group_limit(spark, name):
    assert "WindowGroupLimit" in _plan(spark, name)


def test_cdc_apply_shuffles_events_once(spark):
    plan = _plan(spark, "cdc_apply_upsert")
    assert plan.count("Exchange hashpartitioning") <= 2


def test_rate_window_is_not_partitioned_by_connection_alone(spark):
    plan = _plan(spark, "rate_1m")
    assert "RangeFrame" in plan
    for line in plan.splitlines():
        if "RangeFrame" in line and "Window [" in line:
            assert "_b" in line          # (connection, day) partitions with a halo, not (connection)


@pytest.mark.parametrize("name", ["cdc_norm_mysql", "op_rates", "rate_1m"])
def test_prefix_scans_leave_no_stage_with_all_rows_in_one_partition(spark, name):
    assert "SinglePartition" not in _plan(spark, name)
