"""Canonical keys: order, equality, round trips, and change apply on keys of any shape."""

import decimal
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import keys
from tidewater.operators import cdc

NUMBERS = ["0", "-0", "1", "-1", "9", "10", "-9", "-10", "1.5", "-1.5", "-1.25", "1.05", "0.1", "-0.1", "100", "100.0", "9223372036854775808", "-9223372036854775809", "1e3", "0.0000000001"]


def test_numbers_order_by_value_and_come_back(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x string").select("x", keys.number(F.col("x")).alias("k"))
    rows = [(decimal.Decimal(r.x), r.k, r.v) for r in df.select("x", "k", keys.value_of(F.col("k")).alias("v")).collect()]
    assert [x for x, _, _ in sorted(rows, key=lambda r: r[0])] == [x for x, _, _ in sorted(rows, key=lambda r: (r[1].encode(), r[0]))]
    assert all((a[1] == b[1]) == (a[0] == b[0]) for a in rows for b in rows)
    assert all(decimal.Decimal(v) == x for x, _, v in rows)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(alphabet="a\x00\x01bé", max_size=4), st.integers(-200, 200)), min_size=2, max_size=12))
def test_composite_keys_order_and_come_back(spark, pairs):
    df = spark.createDataFrame(pairs, "s string, i long")
    k = keys.key(keys.of_column(F.col("s"), "string"), keys.of_column(F.col("i"), "bigint"))
    rows = df.select("s", "i", k.alias("k")).select("*", keys.typed(keys.part(F.col("k")), "string").alias("s2"), keys.typed(keys.part(F.col("k"), 1), "bigint").alias("i2")).collect()
    assert all((r.s, r.i) == (r.s2, r.i2) for r in rows)
    assert [(r.s, r.i) for r in sorted(rows, key=lambda r: r.k.encode())] == sorted(((r.s, r.i) for r in rows), key=lambda p: (p[0].encode(), p[1]))


def test_ids_of_documents(spark):
    ids = [5, 5.0, "5", {"$oid": "00000000000000000000000A"}, {"$numberLong": "5"}, {"$date": {"$numberLong": "1000"}}, True, None, {"a": 1, "b": [2]}, [1, 2], "", "$oid"]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(ids)], "i int, j string")
    part = keys.of_variant(F.parse_json("j"))
    got = {r.i: (r.kind, r.value, r.p) for r in df.select("i", part.alias("p")).select("i", "p", keys.kind_of(F.col("p")).alias("kind"), keys.value_of(F.col("p")).alias("value")).collect()}
    assert got[0][2] == got[1][2] == got[4][2] != got[2][2]
    assert [got[i][:2] for i in (2, 3, 5, 6, 7, 8, 9, 10)] == [
        ("string", "5"), ("objectid", "00000000000000000000000a"), ("date", "1000"), ("boolean", "true"), ("null", None), ("object", '{"a":1,"b":[2]}'), ("array", "[1,2]"), ("string", "")]
    kinds = [got[i][0] for i in sorted(got, key=lambda i: got[i][2])]
    assert list(dict.fromkeys(kinds)) == ["null", "number", "string", "object", "array", "objectid", "boolean", "date"]


def test_change_stream_with_ids_of_several_types(spark):
    raw = [(1, {"operationType": "insert", "ns": {"db": "d", "coll": "c"}, "documentKey": {"_id": i}, "fullDocument": {"v": n}, "clusterTime": {"t": 1, "i": n}}) for n, i in enumerate([5, "5", {"$oid": "a" * 24}])]
    raw += [(2, {"operationType": "delete", "ns": {"db": "d", "coll": "c"}, "documentKey": {"_id": "5"}, "clusterTime": {"t": 2, "i": 0}}),
            (3, {"operationType": "update", "ns": {"db": "d", "coll": "c"}, "documentKey": {"_id": {"$numberLong": "5"}}, "fullDocument": {"v": 9}, "clusterTime": {"t": 2, "i": 1}})]
    events = cdc.normalise_mongo(spark.createDataFrame([(a, json.dumps(m)) for a, m in raw], "arrival long, raw string"), any_key=True)
    empty = spark.createDataFrame([], "_id string, v long")
    out = cdc.apply_replace(empty, events, "_id", {"_id": "string", "v": "bigint"})
    got = {(r.kind, r.id): r.v for r in out.select(keys.kind_of(keys.part(F.col("_id"))).alias("kind"), keys.value_of(keys.part(F.col("_id"))).alias("id"), "v").collect()}
    assert got == {("number", "5"): 9, ("objectid", "a" * 24): 2}


def test_binlog_with_a_text_key_and_a_key_change(spark):
    rows = [(1, {"type": "rotate", "next_file": "binlog.000001"}),
            (2, {"type": "write_rows", "schema": "s", "table": "t", "position": 4, "timestamp": 1, "rows": ['{"code":"a","n":1,"v":1}', '{"code":"a","n":2,"v":2}', '{"code":"b","n":1,"v":3}']}),
            (3, {"type": "delete_rows", "schema": "s", "table": "t", "position": 9, "timestamp": 2, "rows": ['{"code":"a","n":2}']})]
    events = cdc.normalise_mysql(spark.createDataFrame([(a, json.dumps(m)) for a, m in rows], "arrival long, raw string"), {"code": "string", "n": "bigint"})
    columns = {"code": "string", "n": "bigint", "v": "bigint"}
    target = spark.createDataFrame([("a", 1, 7), ("z", 1, 8)], "code string, n long, v long")
    assert sorted(map(tuple, cdc.apply_upsert(target, events, ["code", "n"], columns).collect())) == [("a", 1, 1), ("b", 1, 3), ("z", 1, 8)]
