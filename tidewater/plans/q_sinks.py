"""Queries for exports, snapshots and restores (S13-S20), scalar functions
(section 2.11) and the self join of the fixtures (J7). Written files are
read back, so each result checks the sink round trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import doc_query as dq
from tidewater.operators import infer
from tidewater.plans.fixture_sql import F1_TEXT, with_ctes
from tidewater.plans.q_docs import FIND_FILTER, customers
from tidewater.plans.q_mapping import crm_docs
from tidewater.plans.registry import query
from tidewater.session import checkpoint_dir
from tidewater.sources import fixtures as fx
from tidewater.sources import sinks
from tidewater.sources.tables import read_table

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("export_csv", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       CAST(o_totalprice AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS o_orderdate,
       o_orderpriority
FROM orders""")
def export_csv(spark, sf_dir):
    """Table export to CSV (';' delimiter, header, declared column
    order, ISO dates), read back as text."""
    path = checkpoint_dir(spark, "export_csv")
    sinks.export_csv(read_table(spark, sf_dir, "orders"), path, ORDER_COLS, delimiter=";", header=True)
    return spark.read.option("sep", ";").option("header", True).csv(path)


@query("export_json", with_ctes(F1_TEXT) + """
SELECT CAST(json_extract(doc_text, '$._id') AS BIGINT) AS _id, json_extract_string(doc_text, '$.ref."$oid"') AS ref,
       json_extract_string(doc_text, '$.name') AS name, CAST(len(json_keys(doc_text)) AS BIGINT) AS n_keys
FROM f1t WHERE database = 'crm' AND coll NOT LIKE 'system.%'""")
def export_json(spark, sf_dir):
    """Documents exported as JSON Lines with BSON-style values rendered
    (ObjectId -> hex), read back."""
    path = checkpoint_dir(spark, "export_json")
    sinks.export_json(crm_docs(spark, sf_dir), path)
    back = spark.read.text(path)
    return back.select(F.get_json_object("value", "$._id").cast("long").alias("_id"),
                       F.get_json_object("value", "$.ref").alias("ref"),
                       F.get_json_object("value", "$.name").alias("name"),
                       F.size(F.json_object_keys("value")).cast("long").alias("n_keys"))


@query("export_union_header", with_ctes(F1_TEXT) + """,
kv AS (SELECT coll, doc_id, k.key, k.ord FROM f1t, unnest(json_keys(doc_text)) WITH ORDINALITY AS k(key, ord)
       WHERE database = 'crm' AND coll NOT LIKE 'system.%'),
fk AS (SELECT coll, key, min(doc_id) AS d, arg_min(ord, doc_id) AS o FROM kv GROUP BY coll, key)
SELECT coll, string_agg(key, ',' ORDER BY d, o) AS header, CAST(count(*) AS BIGINT) AS n_columns,
       (SELECT CAST(count(*) AS BIGINT) FROM f1t WHERE f1t.coll = fk.coll AND database = 'crm') AS n_rows
FROM fk GROUP BY coll""")
def export_union_header(spark, sf_dir):
    """Database export to CSV: per collection the header is the union of
    document keys (first-seen order); rows are written under it, one file
    set per collection, and counted back."""
    docs = crm_docs(spark, sf_dir)
    kv = infer.explode_fields(docs, ("coll",))
    headers = sinks.union_header(kv, ["coll"], ["doc_id", "pos"])
    base = checkpoint_dir(spark, "export_db")
    keys = [r["column_name"] for r in infer.infer_schema(docs, ns_cols=("database",)).orderBy("ordinal").collect()]
    m = F.col("doc").try_cast("map<string,variant>")
    rows = docs.select("coll", *[sinks.csv_value(m[k]).alias(k) for k in keys])
    rows.write.mode("overwrite").partitionBy("coll").option("header", True).csv(base)
    counts = spark.read.option("header", True).csv(base).groupBy("coll").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    return headers.join(counts, "coll")


@query("export_metadata", with_ctes(F1_TEXT) + """
SELECT database, coll, CAST(count(*) AS BIGINT) AS count FROM f1t WHERE coll NOT LIKE 'system.%' GROUP BY 1, 2""")
def export_metadata(spark, sf_dir):
    """Export metadata: document count per exported collection
    (system collections excluded), written as JSON next to the data."""
    t = fx.f1_documents_text(spark, sf_dir).filter(~F.col("coll").startswith("system."))
    meta = t.groupBy("database", "coll").agg(F.count(F.lit(1)).cast("long").alias("count"))
    path = checkpoint_dir(spark, "export_meta")
    meta.write.mode("overwrite").json(path)
    return spark.read.schema("database string, coll string, count bigint").json(path)


@query("export_filtered", with_ctes(F1_TEXT) + """
SELECT CAST(json_extract(doc_text, '$._id') AS VARCHAR) AS _id, json_extract_string(doc_text, '$.name') AS name,
       CAST(CAST(json_extract(doc_text, '$.score') AS DOUBLE) AS VARCHAR) AS score
FROM f1t WHERE database = 'crm' AND CAST(json_extract(doc_text, '$.active') AS BOOLEAN)
  AND CAST(json_extract(doc_text, '$.score') AS DOUBLE) >= 1000 AND CAST(json_extract(doc_text, '$.score') AS DOUBLE) < 5000
  AND json_extract_string(doc_text, '$.address.segment') IN ('BUILDING', 'MACHINERY')""")
def export_filtered(spark, sf_dir):
    """Export driven by a find filter (filter pushed into the query, then CSV)."""
    path = checkpoint_dir(spark, "export_filtered")
    rows = dq.find(customers(spark, sf_dir), FIND_FILTER, {"name": 1, "score": 1}, limit=None)
    sinks.export_csv(rows, path)
    return spark.read.option("header", True).csv(path)


@query("snapshot_write", """
SELECT 'run-1' AS run_id, CAST(count(*) AS BIGINT) AS n_rows FROM orders""")
def snapshot_write(spark, sf_dir):
    """Snapshot of a table as Parquet under run_id=<id>, catalogued with its row count."""
    base = checkpoint_dir(spark, "snapshots")
    return sinks.snapshot_write(read_table(spark, sf_dir, "orders"), base, "run-1")


@query("snapshot_restore", """
SELECT * FROM orders""")
def snapshot_restore(spark, sf_dir):
    """Write two snapshots, restore one (partition-pruned read) over a target."""
    base = checkpoint_dir(spark, "snapshots")
    o = read_table(spark, sf_dir, "orders")
    sinks.snapshot_write(o, base, "run-1").collect()
    sinks.snapshot_write(o.filter(F.col("o_orderkey") % 2 == 0), base, "run-2").collect()
    return sinks.snapshot_restore(spark, base, "run-1", checkpoint_dir(spark, "restore_target"))


# ---- 2.11 scalar functions --------------------------------------------------------------------
@query("scalar_suite", """
SELECT event_id,
       contains(lower(event_type), 'ur') AS str_contains, starts_with(props, '{"k"') AS str_prefix,
       substring(props, 1, 500) AS str_slice, regexp_replace(event_type, '[aeiou]', '_', 'g') AS str_regex,
       regexp_matches(event_type, '^(v|c)') AS str_rlike, event_type || '|' || CAST(user_id AS VARCHAR) AS str_join,
       greatest(0.0, least(100.0, value)) AS math_clamp,
       CAST(round(CAST(CAST(value / 4 AS VARCHAR) AS DECIMAL(38, 12)), 2) AS DOUBLE) AS math_round,
       CAST(trunc(value * -1.5) AS BIGINT) AS math_trunc, value = floor(value) AS math_integral,
       CAST(epoch_us(ts) // 1000000 AS BIGINT) AS date_epoch_s,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS date_iso,
       strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS date_from_ms,
       strftime(ts - INTERVAL 24 HOUR, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS date_minus_24h,
       to_base64(encode(event_type)) AS enc_base64, hex(event_id) AS enc_hex,
       CAST(json_extract(props, '$.k') AS BIGINT) AS json_k, array_to_string(json_keys(props), ',') AS json_keys,
       json(props)::VARCHAR AS json_text,
       list_max(list_filter([value, value * 2, NULL], lambda x: x IS NOT NULL)) AS arr_max,
       CAST(len([event_id, user_id, event_id + user_id][1:2]) AS INTEGER) AS arr_slice_len,
       CAST(len(flatten([[event_id], [user_id, 1]])) AS INTEGER) AS arr_flat_len,
       coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE event_type END, 'n/a') AS cond_coalesce
FROM events""")
def scalar_suite(spark, sf_dir):
    """2.11: one column per scalar-function group the reference uses (string,
    math, date, encoding, JSON, array, conditional), all built-in and codegen'd."""
    e = read_table(spark, sf_dir, "events")
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    ms = F.unix_millis("ts")
    return e.select(
        "event_id",
        F.lower("event_type").contains("ur").alias("str_contains"), F.col("props").startswith('{"k"').alias("str_prefix"),
        F.substring("props", 1, 500).alias("str_slice"), F.regexp_replace("event_type", "[aeiou]", "_").alias("str_regex"),
        F.col("event_type").rlike("^(v|c)").alias("str_rlike"),
        F.array_join(F.array("event_type", F.col("user_id").cast("string")), "|").alias("str_join"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), "value")).alias("math_clamp"),
        F.round(F.col("value") / 4, 2).alias("math_round"),
        (F.col("value") * -1.5).cast("long").alias("math_trunc"),
        (F.col("value") == F.floor("value")).alias("math_integral"),
        F.unix_seconds("ts").alias("date_epoch_s"), F.date_format("ts", iso).alias("date_iso"),
        F.date_format(F.timestamp_millis(ms), iso).alias("date_from_ms"),
        F.date_format(F.col("ts") - F.expr("INTERVAL 24 HOURS"), iso).alias("date_minus_24h"),
        F.base64(F.col("event_type").cast("binary")).alias("enc_base64"), F.hex("event_id").alias("enc_hex"),
        F.get_json_object("props", "$.k").cast("long").alias("json_k"),
        F.array_join(F.json_object_keys("props"), ",").alias("json_keys"),
        F.to_json(F.parse_json("props")).alias("json_text"),
        F.array_max(F.filter(F.array("value", F.col("value") * 2, F.lit(None).cast("double")), lambda x: x.isNotNull()))
        .alias("arr_max"),
        F.size(F.slice(F.array("event_id", "user_id", F.col("event_id") + F.col("user_id")), 1, 2)).alias("arr_slice_len"),
        F.size(F.flatten(F.array(F.array("event_id"), F.array("user_id", F.lit(1).cast("long"))))).alias("arr_flat_len"),
        F.coalesce(F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("event_type")), F.lit("n/a"))
        .alias("cond_coalesce"))


@query("self_join_parent", """
SELECT c.p_partkey AS id, c.p_name AS name, p.p_partkey AS parent_id, p.p_name AS parent_name
FROM part c LEFT JOIN part p ON p.p_partkey = CASE WHEN c.p_partkey >= 10 THEN c.p_partkey // 10 END""")
def self_join_parent(spark, sf_dir):
    """Categories with a parent (key // 10) resolved by a self join."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    child = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                     F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10)).cast("long").alias("pid"))
    parent = p.select(F.col("p_partkey").alias("parent_id"), F.col("p_name").alias("parent_name"))
    return child.join(parent, child.pid == parent.parent_id, "left").select("id", "name", "parent_id", "parent_name")
