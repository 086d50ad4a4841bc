"""Queries for the document query surface."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewater.operators import doc_query as dq
from tidewater.plans.fixture_sql import F1_TEXT, with_ctes
from tidewater.plans.registry import query
from tidewater.sources import fixtures as fx
from tidewater.sources.tables import read_table

ADDRESS = "struct<nation:int,segment:string,geo:struct<region:int,zone:string>>"


def customers(spark, sf_dir):
    """The customer documents (F1) as a typed collection; ``_keys`` keeps
    which top-level keys each document really has."""
    t = fx.f1_documents_text(spark, sf_dir).filter(F.col("database") == "crm")
    d = F.parse_json("doc_text")
    return t.select(
        F.variant_get(d, "$._id", "bigint").alias("_id"), "coll",
        F.variant_get(d, "$.name", "string").alias("name"),
        F.variant_get(d, "$.address", ADDRESS).alias("address"),
        F.try_variant_get(d, "$.score", "double").alias("score"),
        F.try_variant_get(d, "$.note", "string").alias("note"),
        F.try_variant_get(d, "$.tags", "array<string>").alias("tags"),
        F.variant_get(d, "$.active", "boolean").alias("active"),
        F.json_object_keys("doc_text").alias("_keys"))


CUSTOMERS_SQL = with_ctes(F1_TEXT) + """,
customers AS (
  SELECT CAST(json_extract(doc_text, '$._id') AS BIGINT) AS _id, coll,
         json_extract_string(doc_text, '$.name') AS name,
         CAST(json_extract(doc_text, '$.address.nation') AS INTEGER) AS nation,
         json_extract_string(doc_text, '$.address.segment') AS segment,
         CAST(json_extract(doc_text, '$.score') AS DOUBLE) AS score,
         json_extract_string(doc_text, '$.note') AS note,
         CAST(json_extract(doc_text, '$.tags') AS VARCHAR[]) AS tags,
         CAST(json_extract(doc_text, '$.active') AS BOOLEAN) AS active,
         json_keys(doc_text) AS _keys
  FROM f1t WHERE database = 'crm'
)"""


def orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("_id"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                    F.split("o_orderpriority", "-").alias("tags"))


ORDERS_SQL = """
WITH od AS (
  SELECT o_orderkey AS _id, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, string_split(o_orderpriority, '-') AS tags
  FROM orders
)"""

FIND_FILTER = {"active": True, "score": {"$gte": 1000, "$lt": 5000}, "address.segment": {"$in": ["BUILDING", "MACHINERY"]}}


@query("find_filter", CUSTOMERS_SQL + """
SELECT _id, name, score FROM customers
WHERE active AND score >= 1000 AND score < 5000 AND segment IN ('BUILDING', 'MACHINERY')""")
def find_filter(spark, sf_dir):
    """Q1: implicit equality, range and $in on a nested path; inclusion projection."""
    return dq.find(customers(spark, sf_dir), FIND_FILTER, {"name": 1, "score": 1}, limit=None)


FIND_LOGICAL = {
    "$or": [{"tags": "machinery"}, {"score": {"$lt": 0}}],
    "$nor": [{"note": None}],
    "name": {"$regex": "[0-4]$"},
    "score": {"$exists": True, "$ne": 100},
    "address.nation": {"$nin": [0, 1, 2], "$not": {"$gt": 20}},
    "$and": [{"tags": {"$not": {"$size": 3}}}, {"coll": {"$type": "string"}}],
}


@query("find_logical", CUSTOMERS_SQL + """
SELECT _id, name, score, note FROM customers
WHERE (coalesce(list_contains(tags, 'machinery'), false) OR coalesce(score < 0, false))
  AND NOT (note IS NULL)
  AND coalesce(regexp_matches(name, '[0-4]$'), false)
  AND list_contains(_keys, 'score') AND NOT coalesce(score = 100, false)
  AND NOT coalesce(nation IN (0, 1, 2), false) AND NOT coalesce(nation > 20, false)
  AND NOT coalesce(len(tags) = 3, false) AND coll IS NOT NULL""")
def find_logical(spark, sf_dir):
    """Q1: $or/$nor/$and/$not, $regex, $exists (missing vs null), $ne/$nin
    matching missing values, $size and $type."""
    return dq.find(customers(spark, sf_dir), FIND_LOGICAL, {"name": 1, "score": 1, "note": 1}, limit=None)


@query("find_project", CUSTOMERS_SQL + """
SELECT _id, coll, name, score, note, active FROM customers WHERE note IS NOT NULL""")
def find_project(spark, sf_dir):
    """Q2: exclusion projection."""
    return dq.find(customers(spark, sf_dir), {"note": {"$ne": None}}, {"address": 0, "tags": 0}, limit=None)


@query("find_sort", CUSTOMERS_SQL + """
SELECT _id, score FROM customers""")
def find_sort(spark, sf_dir):
    """Q3: sort +1 (nulls first) / -1 as a distributed range-partitioned sort
    (order itself is unit-tested; the gate compares the sorted rows)."""
    return dq.find(customers(spark, sf_dir), None, {"score": 1}, sort={"score": 1, "_id": -1}, limit=None)


@query("find_page", CUSTOMERS_SQL + """,
tot AS (SELECT count(*) AS total FROM customers WHERE active)
SELECT _id, coll, name, score, note, active, CAST(total AS BIGINT) AS total, CAST(ceil(total / 50) AS BIGINT) AS pages
FROM (SELECT * FROM customers WHERE active ORDER BY _id LIMIT 50 OFFSET 20), tot""")
def find_page(spark, sf_dir):
    """Q4/Q5/Q17: a page (skip 20, limit 50) with the filtered total and page
    count; display columns drop nested fields (first 10 columns)."""
    c = customers(spark, sf_dir)
    total = dq.find_total(c, {"active": True})
    page = dq.find(c, {"active": True}, {"address": 0, "tags": 0}, sort={"_id": 1}, skip=20, limit=50)
    page = page.select(*page.columns[:10])
    return page.withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(math.ceil(total / 50)).cast("long")})


@query("agg_match", ORDERS_SQL + """
SELECT _id, o_custkey, o_totalprice FROM od WHERE o_orderstatus = 'F' AND list_contains(tags, 'URGENT')""")
def agg_match(spark, sf_dir):
    """Q6 $match (array equality matches any element)."""
    p = dq.pipeline(orders(spark, sf_dir), [{"$match": {"o_orderstatus": "F", "tags": "URGENT"}},
                                            {"$project": {"o_custkey": 1, "o_totalprice": 1}}], limit=None)
    return p


@query("agg_group", ORDERS_SQL + """
SELECT o_custkey AS _id, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total,
       avg(o_totalprice) AS avg_price, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price,
       arg_min(_id, (o_totalprice, _id)) AS first_id, arg_max(_id, (o_totalprice, _id)) AS last_id,
       list(_id ORDER BY o_totalprice, _id) AS ids, list_sort(list(DISTINCT o_orderpriority)) AS priorities
FROM od GROUP BY o_custkey""")
def agg_group(spark, sf_dir):
    """Q7 $group with every accumulator; $first/$last/$push follow the $sort."""
    p = dq.pipeline(orders(spark, sf_dir), [
        {"$sort": {"o_totalprice": 1, "_id": 1}},
        {"$group": {"_id": "$o_custkey", "n": {"$sum": 1}, "total": {"$sum": "$o_totalprice"},
                    "avg_price": {"$avg": "$o_totalprice"}, "min_price": {"$min": "$o_totalprice"},
                    "max_price": {"$max": "$o_totalprice"}, "first_id": {"$first": "$_id"},
                    "last_id": {"$last": "$_id"}, "ids": {"$push": "$_id"},
                    "priorities": {"$addToSet": "$o_orderpriority"}}}], limit=None)
    return p.withColumns({"n": F.col("n").cast("long"), "total": F.round("total", 2),
                          "avg_price": F.col("avg_price")})


@query("agg_sort_limit", ORDERS_SQL + """
SELECT _id, o_totalprice FROM od ORDER BY o_totalprice DESC, _id LIMIT 20""")
def agg_sort_limit(spark, sf_dir):
    """Q8/Q10: $sort + $limit (a bounded top-k), caller limit appended."""
    return dq.pipeline(orders(spark, sf_dir), [{"$sort": {"o_totalprice": -1, "_id": 1}}, {"$limit": 20},
                                               {"$project": {"o_totalprice": 1}}], limit=1000)


@query("agg_project", ORDERS_SQL + """
SELECT _id AS o_key, round(o_totalprice / 1000, 3) AS price_k, o_orderstatus AS status FROM od""")
def agg_project(spark, sf_dir):
    """Q9 $project with computed fields and _id excluded."""
    return dq.pipeline(orders(spark, sf_dir), [{"$project": {
        "_id": 0, "o_key": "$_id", "price_k": {"$round": [{"$divide": ["$o_totalprice", 1000]}, 3]},
        "status": "$o_orderstatus"}}], limit=None)


@query("agg_unwind", CUSTOMERS_SQL + """
SELECT _id, t.tag AS tags, t.i - 1 AS idx FROM customers, unnest(tags) WITH ORDINALITY AS t(tag, i)""")
def agg_unwind(spark, sf_dir):
    """Q11 $unwind with includeArrayIndex (missing/empty arrays drop)."""
    c = customers(spark, sf_dir).select("_id", "tags")
    return dq.pipeline(c, [{"$unwind": {"path": "$tags", "includeArrayIndex": "idx"}}], limit=None) \
        .withColumn("idx", F.col("idx").cast("long"))


@query("agg_lookup", ORDERS_SQL + """
SELECT o._id, CAST(count(l.l_orderkey) AS BIGINT) AS n_items, round(coalesce(sum(l.l_quantity), 0), 2) AS qty
FROM od o LEFT JOIN lineitem l ON l.l_orderkey = o._id GROUP BY o._id""")
def agg_lookup(spark, sf_dir):
    """Q12/J1 $lookup: orders with an array of their lineitems (empty when none)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    p = dq.pipeline(orders(spark, sf_dir), [
        {"$lookup": {"from": "lineitem", "localField": "_id", "foreignField": "l_orderkey", "as": "items"}},
        {"$addFields": {"n_items": {"$size": "$items"}}}], limit=None, collections={"lineitem": li})
    return p.select("_id", F.col("n_items").cast("long").alias("n_items"),
                    F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_quantity"]), 2).alias("qty"))


@query("agg_add_fields", ORDERS_SQL + """
SELECT _id, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, tags,
       o_totalprice * 2 AS double_price, o_orderstatus || '-' || o_orderpriority AS flag FROM od""")
def agg_add_fields(spark, sf_dir):
    """Q13 $addFields."""
    return dq.pipeline(orders(spark, sf_dir), [{"$addFields": {
        "double_price": {"$multiply": ["$o_totalprice", 2]},
        "flag": {"$concat": ["$o_orderstatus", "-", "$o_orderpriority"]}}}], limit=None)


@query("agg_count", ORDERS_SQL + """
SELECT CAST(count(*) AS BIGINT) AS n FROM od WHERE o_totalprice > 200000""")
def agg_count(spark, sf_dir):
    """Q14 $count."""
    return dq.pipeline(orders(spark, sf_dir), [{"$match": {"o_totalprice": {"$gt": 200000}}}, {"$count": "n"}])


@query("agg_facet", ORDERS_SQL + """,
st AS (SELECT '{"_id":"' || o_orderstatus || '","n":' || CAST(count(*) AS VARCHAR) || '}' AS doc FROM od GROUP BY o_orderstatus),
tp AS (SELECT '{"_id":' || CAST(_id AS VARCHAR) || ',"o_orderstatus":"' || o_orderstatus || '"}' AS doc,
              row_number() OVER (ORDER BY o_totalprice DESC, _id) AS rn FROM od)
SELECT 'by_status' AS facet, CAST(count(*) AS BIGINT) AS n_docs, '[' || coalesce(string_agg(doc, ',' ORDER BY doc), '') || ']' AS docs FROM st
UNION ALL
SELECT 'top', CAST(count(*) AS BIGINT), '[' || coalesce(string_agg(doc, ',' ORDER BY rn), '') || ']' FROM tp WHERE rn <= 3
UNION ALL
SELECT 'dear', CAST(1 AS BIGINT), '[{"n":' || CAST(count(*) AS VARCHAR) || '}]' FROM od WHERE o_totalprice > 200000
UNION ALL
SELECT 'nothing', CAST(0 AS BIGINT), '[]'""")
def agg_facet(spark, sf_dir):
    """Q15 $facet: sub-pipelines of any shape over one input, one row per
    branch with its documents in branch order (empty array: no document)."""
    return dq.pipeline(orders(spark, sf_dir), [{"$facet": {
        "by_status": [{"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}],
        "top": [{"$sort": {"o_totalprice": -1, "_id": 1}}, {"$limit": 3}, {"$project": {"_id": 1, "o_orderstatus": 1}}],
        "dear": [{"$match": {"o_totalprice": {"$gt": 200000}}}, {"$count": "n"}],
        "nothing": [{"$match": {"o_totalprice": {"$lt": 0}}}, {"$project": {"_id": 1}}]}}])


@query("coll_stats", with_ctes(F1_TEXT) + """
SELECT database, coll, CAST(count(*) AS BIGINT) AS count, CAST(sum(strlen(doc_text)) AS BIGINT) AS size,
       round(avg(strlen(doc_text)), 4) AS avg_obj_size
FROM f1t GROUP BY database, coll""")
def coll_stats(spark, sf_dir):
    """Q16: collection count, size and average object size."""
    return dq.coll_stats(fx.f1_documents_text(spark, sf_dir), ["database", "coll"])


# ---- arrays on a path (Q1, Q6, Q12) ----------------------------------------------------------------------------------
BASKETS_SQL = """
WITH items AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem),
baskets AS (SELECT o_orderkey AS _id, o_orderpriority AS priority FROM orders)"""


def baskets(spark, sf_dir):
    """Orders as documents with an array of item documents (part, qty, flag, in order) and one of quantities; orders
    without items have no such fields."""
    li = read_table(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")).alias("item"))
    lists = li.groupBy(F.col("l_orderkey").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("items"))
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_orderpriority").alias("priority"))
    return o.join(lists, "_id", "left").withColumn("qtys", F.transform("items", lambda x: x["qty"]))


FIND_ARRAY = {"items.qty": {"$gt": 45}, "items.flag": {"$in": ["R", "A"], "$ne": "N"}, "items.0.qty": {"$lt": 40}, "qtys": {"$not": {"$size": 1}},
              "$or": [{"items.part": {"$exists": True}, "qtys": 10}, {"priority": {"$regex": "^[12]"}}]}


@query("find_array", BASKETS_SQL + """
SELECT _id, priority FROM baskets b WHERE
  EXISTS (FROM items WHERE l_orderkey = _id AND l_quantity > 45) AND EXISTS (FROM items WHERE l_orderkey = _id AND l_returnflag IN ('R', 'A'))
  AND NOT EXISTS (FROM items WHERE l_orderkey = _id AND l_returnflag = 'N') AND EXISTS (FROM items WHERE l_orderkey = _id AND pos = 0 AND l_quantity < 40)
  AND (SELECT count(*) FROM items WHERE l_orderkey = _id) <> 1
  AND (EXISTS (FROM items WHERE l_orderkey = _id AND l_quantity = 10) OR regexp_matches(priority, '^[12]'))""")
def find_array(spark, sf_dir):
    """Q1: paths through arrays of documents, by element and by place; any element matches, a negation means none."""
    return dq.find(baskets(spark, sf_dir), FIND_ARRAY, {"priority": 1})


FIND_ELEM = {"items": {"$elemMatch": {"qty": {"$gte": 30, "$lt": 48}, "$or": [{"flag": "A"}, {"part": {"$lt": 500}}]}}, "qtys": {"$elemMatch": {"$gt": 5, "$lt": 20}},
             "items.flag": {"$all": ["N", "R"]}, "$nor": [{"items": {"$elemMatch": {"qty": 1}}}]}


@query("find_elem_match", BASKETS_SQL + """
SELECT _id FROM baskets WHERE
  EXISTS (FROM items WHERE l_orderkey = _id AND l_quantity >= 30 AND l_quantity < 48 AND (l_returnflag = 'A' OR l_partkey < 500))
  AND EXISTS (FROM items WHERE l_orderkey = _id AND l_quantity > 5 AND l_quantity < 20)
  AND EXISTS (FROM items WHERE l_orderkey = _id AND l_returnflag = 'N') AND EXISTS (FROM items WHERE l_orderkey = _id AND l_returnflag = 'R')
  AND NOT EXISTS (FROM items WHERE l_orderkey = _id AND l_quantity = 1)""")
def find_elem_match(spark, sf_dir):
    """Q1: $elemMatch holds all conditions on one element, of documents and of numbers; $all; $nor."""
    return dq.find(baskets(spark, sf_dir), FIND_ELEM, {"_id": 1})


def _parts(spark, sf_dir):
    """Parts with an array of codes, their key and its half; no codes (null) for p % 40 = 0."""
    k = F.col("p_partkey")
    return read_table(spark, sf_dir, "part").select(
        k.alias("p_partkey"), F.col("p_size").cast("long").alias("p_size"),
        F.when(k % 40 != 0, F.array(k, F.floor(k / 2).cast("long"), k)).alias("codes"))


@query("agg_lookup_array", """
WITH codes AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, unnest([p_partkey, p_partkey // 2]) AS code FROM part WHERE p_partkey % 40 <> 0
  UNION ALL SELECT p_partkey, CAST(p_size AS BIGINT), NULL FROM part WHERE p_partkey % 40 = 0),
wanted AS (SELECT DISTINCT l_orderkey AS _id, l_partkey AS code FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 10 <> 1
  UNION ALL SELECT DISTINCT o_orderkey, CAST(NULL AS BIGINT) FROM orders WHERE o_orderkey % 10 <> 1 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)),
found AS (SELECT DISTINCT _id, p_partkey, p_size FROM wanted w JOIN codes c ON w.code IS NOT DISTINCT FROM c.code)
SELECT o_orderkey AS _id, count(p_partkey) AS n_parts, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS sizes, CAST(min(p_partkey) AS BIGINT) AS first_part
FROM orders LEFT JOIN found ON _id = o_orderkey GROUP BY o_orderkey""")
def agg_lookup_array(spark, sf_dir):
    """Q12: part codes of an order's items (no items: null; o % 10 = 1: an empty array) looked up in the parts' code
    arrays: by element on both sides, null matches null, a part once whatever the number of its codes that match."""
    b = baskets(spark, sf_dir)
    local = b.select("_id", F.when(F.col("_id") % 10 == 1, F.array().cast("array<bigint>")).otherwise(F.transform("items", lambda x: x["part"])).alias("parts"))
    out = dq.pipeline(local, [{"$lookup": {"from": "part", "localField": "parts", "foreignField": "codes", "as": "found"}}], collections={"part": _parts(spark, sf_dir)})
    total = F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["p_size"])
    return out.select("_id", F.size("found").cast("long").alias("n_parts"), total.alias("sizes"), F.array_min(F.transform("found", lambda x: x["p_partkey"])).alias("first_part"))
