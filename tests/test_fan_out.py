"""Costly per-row work stays above the fan-out of a small scan."""

from __future__ import annotations

from tidewater.operators import mapping as mp
from tidewater.operators.mapping import Col
from tidewater.plans.q_mapping import crm_docs
from tidewater.sources.tables import fan_out_small

from tests.conftest import SF_SMALL


def _below_fan_out(df) -> list[str]:
    """The nodes of the optimized plan between a fan-out and its scan."""
    plan, found = df._jdf.queryExecution().optimizedPlan().toString().split("\n"), []
    for i, line in enumerate(plan):
        if "Repartition " in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            for below in plan[i + 1:]:
                if len(below) - len(below.lstrip(" :+-")) <= depth:
                    break
                found.append(below)
    assert found
    return found


def test_documents_are_not_parsed_below_the_fan_out(spark):
    cols = [Col("score", "int"), Col("address", "string")]
    mapped, rejects, warnings = mp.map_doc_to_sql(crm_docs(spark, SF_SMALL), cols, "mysql", keep=["doc_id"])
    for df in (mapped, rejects, warnings):
        below = _below_fan_out(df)
        assert not [x for x in below if "parse_json" in x or "variant" in x or "concat" in x]


def test_scans_of_few_splits_are_fanned_out(spark):
    cores = spark.sparkContext.defaultParallelism
    assert fan_out_small(spark.range(0, 100, 1, cores)).rdd.getNumPartitions() == 2 * cores
    assert fan_out_small(spark.range(0, 100, 1, 4 * cores)).rdd.getNumPartitions() == 4 * cores
