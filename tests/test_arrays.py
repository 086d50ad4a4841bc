"""Predicates and lookups that go through arrays, on hand-made documents with known answers."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import doc_query as dq

DOCS = [
    (1, [(1, "a", [1, 2]), (5, "b", None)], [1, 5, None], None, "x"),
    (2, [(5, "a", [9])], [5], 3, "y"),
    (3, [], [], None, None),
    (4, None, None, 4, "x"),
    (5, [(None, "c", [])], [None], 5, "z"),
]
SCHEMA = "_id long, items array<struct<q:long,f:string,t:array<long>>>, qs array<long>, n long, s string"


@pytest.mark.parametrize(("query", "ids"), [
    ({"items.q": 5}, [1, 2]), ({"items.q": {"$gt": 1}}, [1, 2]), ({"items.q": {"$ne": 5}}, [3, 4, 5]), ({"items.q": {"$nin": [1, 5]}}, [3, 4, 5]),
    ({"items.0.q": 5}, [2]), ({"items.1.q": {"$exists": True}}, [1]), ({"items.t": 2}, [1]), ({"items.t": {"$size": 1}}, [2]), ({"items.t.0": 9}, [2]),
    ({"items.q": None}, [4, 5]), ({"items.q": {"$exists": False}}, [3, 4, 5]), ({"items.nope": {"$exists": True}}, []), ({"items.nope": None}, [1, 2, 4, 5]),
    ({"qs": 5}, [1, 2]), ({"qs": {"$in": [1, 7]}}, [1]), ({"qs": [5]}, [2]), ({"qs": {"$all": [1, 5]}}, [1]), ({"qs": {"$size": 0}}, [3]), ({"qs": {"$not": {"$gt": 1}}}, [3, 4, 5]),
    ({"qs": {"$elemMatch": {"$gt": 1, "$lt": 6}}}, [1, 2]), ({"qs": None}, [1, 4, 5]), ({"qs": {"$type": "array"}}, [1, 2, 3, 5]),
    ({"items": {"$elemMatch": {"q": 5, "f": "a"}}}, [2]), ({"items": {"$elemMatch": {"$or": [{"q": 1}, {"f": "c"}]}}}, [1, 5]), ({"items": {"$elemMatch": {"t": {"$elemMatch": {"$gte": 2, "$lt": 9}}}}}, [1]),
    ({"items.f": {"$all": ["a", "b"]}}, [1]), ({"items": {"$all": [{"$elemMatch": {"q": 1}}, {"$elemMatch": {"f": "b"}}]}}, [1]), ({"items": {"$not": {"$elemMatch": {"q": 5}}}}, [3, 4, 5]),
    ({"s": 5}, []), ({"n": "3"}, []), ({"s": {"$in": ["x", 5]}}, [1, 4]), ({"items.f": {"$regex": "^[ab]"}}, [1, 2]), ({"qs": {"$all": []}}, []), ({"n": {"$elemMatch": {"$gt": 1}}}, []),
    ({"$nor": [{"items.q": 5}, {"s": None}]}, [4, 5]), ({"n": {"$exists": True, "$gte": 4}}, [4, 5]),
])
def test_filters_on_arrays(spark, query, ids):
    df = spark.createDataFrame(DOCS, SCHEMA)
    assert sorted(r._id for r in dq.find(df, query, {"_id": 1}).collect()) == ids


def test_plain_paths_still_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(f"{tmp_path}/d")
    plan = dq.find(spark.read.parquet(f"{tmp_path}/d"), {"n": {"$gt": 3}, "s": {"$in": ["x", "y"]}}, {"n": 1})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,3)" in plan and "In(s, [x,y])" in plan


@pytest.mark.parametrize(("local", "foreign"), [("k", "k"), ("ks", "k"), ("k", "ks"), ("ks", "ks")])
def test_lookup_by_element_and_null(spark, local, foreign):
    left = [(1, 5, [5, 6, 5]), (2, None, None), (3, 7, []), (4, 9, [None, 8]), (5, 5, [5]), (5, 5, [5])]
    right = [(10, 5, [5, 6]), (11, None, None), (12, 8, []), (13, 6, [6, 6, None]), (13, 6, [6, 6, None])]

    def values(x, many):
        return [None] if x is None else x if many else [x]

    want = []
    for i, k, ks in left:
        mine = values(ks if local == "ks" else k, local == "ks")
        want.append((i, [j for j, fk, fks in right if any(a == b for a in mine for b in values(fks if foreign == "ks" else fk, foreign == "ks"))]))
    df, other = (spark.createDataFrame(rows, "_id long, k long, ks array<long>") for rows in (left, right))
    out = dq.pipeline(df, [{"$lookup": {"from": "o", "localField": local, "foreignField": foreign, "as": "found"}}], collections={"o": other.coalesce(1)})
    assert out.columns == ["_id", "k", "ks", "found"]
    assert sorted((r._id, [x._id for x in r.found]) for r in out.collect()) == sorted(want)


def test_lookup_with_an_empty_collection(spark):
    df = spark.createDataFrame([(1, [1])], "_id long, ks array<long>")
    other = spark.createDataFrame([], "_id long, k long")
    out = dq.pipeline(df, [{"$lookup": {"from": "o", "localField": "ks", "foreignField": "k", "as": "found"}}, {"$addFields": {"n": {"$size": "$found"}}}], collections={"o": other})
    assert out.select("_id", F.col("n")).collect() == [(1, 0)]


def test_lookup_of_a_key_with_many_documents(spark):
    """Hundreds of documents without the field on one side, thousands on the other (F1): each match once, in order, soon."""
    import time
    df = spark.range(600).select(F.col("id").alias("_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(2))).alias("ks"))
    other = spark.range(0, 6000, 1, 1).select("id", F.when(F.col("id") % 2 == 0, F.array(F.lit(1), F.lit(2), F.lit(1))).alias("k"))
    began = time.monotonic()
    out = dq.pipeline(df, [{"$lookup": {"from": "o", "localField": "ks", "foreignField": "k", "as": "found"}}], collections={"o": other})
    ids = F.transform("found", lambda x: x["id"])
    got = out.select("_id", F.size(ids).alias("n"), F.expr("size(array_distinct(transform(found, x -> x.id)))").alias("different"), (F.array_sort(ids) == ids).alias("sorted"), ids[0].alias("first")).collect()
    assert time.monotonic() - began < 60
    assert sorted(tuple(r) for r in got) == [(i, 3000, 3000, True, 0 if i % 3 == 0 else 1) for i in range(600)]
