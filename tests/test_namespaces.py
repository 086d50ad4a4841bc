"""Loads and change logs keep collections with the same keys apart."""

import pytest

from tidewater.operators import cdc, load
from tidewater.session import checkpoint_dir, ensure_checkpoint_dir

EVENT = "db string, coll string, op string, key long, doc string, pos_hi long, pos_lo long, pos_seq long, committed_ms long"


def test_existing_keys_of_another_collection_block_nothing(spark):
    rows = spark.createDataFrame([("d", "a", 1), ("d", "b", 1)], "db string, coll string, k int")
    existing = spark.createDataFrame([("d", "a", 1)], "db string, coll string, k int")
    inserted, skipped = load.insert_only(rows, existing, "k", ["db", "coll"])
    assert [tuple(r) for r in inserted.collect()] == [("d", "b", 1)] and [tuple(r) for r in skipped.collect()] == [("d", "a", 1, 1)]


@pytest.mark.parametrize("apply", [cdc.apply_upsert, cdc.apply_replace])
def test_apply_keeps_collections_apart(spark, apply):
    events = spark.createDataFrame([("d", "a", "insert", 1, '{"v": 5}', 1, 0, 0, 0), ("d", "b", "delete", 1, None, 2, 0, 0, 0)], EVENT)
    target = spark.createDataFrame([("d", "a", 1, 0), ("d", "b", 1, 7), ("d", "c", 1, 9)], "db string, coll string, k long, v int")
    got = {tuple(r) for r in apply(target, events, "k", {"k": "long", "v": "int"}).select("db", "coll", "k", "v").collect()}
    assert got == {("d", "a", 1, 5), ("d", "c", 1, 9)}


def test_shared_folder(spark):
    assert checkpoint_dir(spark).startswith(ensure_checkpoint_dir(spark).rstrip("/"))
