"""Every registered query against its DuckDB oracle at sf0.01 (the same
check the correctness gate runs), plus the smoke entry point."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.oracle_check import compare, duck
from tidewater.plans import catalog

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "column_name" in df.columns


def test_every_query_has_an_oracle():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF_ORACLE), con, E.oracle_sql()[name])
    assert ok, msg


@pytest.mark.parametrize("name", ["infer_schema", "op_rates", "alert_state", "cdc_apply_upsert", "agg_lookup"])
def test_runs_on_smallest_scale(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() >= 0
