"""A change log is read and parsed once."""

from __future__ import annotations

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tidewater.operators import cdc

COLS = "db string, coll string, op string, key long, doc string, pos_hi long, pos_lo long, pos_seq long, old_key long"


def test_key_changes_are_split_in_one_pass(spark):
    rows = [("d", "c", "update", 2, "{}", 1, 1, 0, 1), ("d", "c", "update", 3, "{}", 1, 2, 0, 3), ("d", "c", "insert", 4, "{}", 1, 3, 0, None),
            ("d", "c", "update", None, "{}", 1, 4, 0, None), ("d", "c", "update", None, "{}", 1, 5, 0, 7), ("d", "c", "delete", 5, None, 1, 6, 0, 9)]
    out = cdc.split_key_changes(spark.createDataFrame(rows, COLS))
    assert out.columns == ["db", "coll", "op", "key", "doc", "pos_hi", "pos_lo", "pos_seq"]
    found = sorted((r.pos_lo, r.pos_seq, r.op, r.key, r.doc) for r in out.collect())
    assert found == [(1, 0, "delete", 1, None), (1, 1, "insert", 2, "{}"), (2, 1, "update", 3, "{}"), (3, 1, "insert", 4, "{}"),
                     (4, 1, "update", None, "{}"), (6, 1, "delete", 5, None)]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_orders_are_fanned_out_before_keys_are_made(spark):
    for name in ("cdc_composite_key", "cdc_oid_keys"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition " in plan, name
