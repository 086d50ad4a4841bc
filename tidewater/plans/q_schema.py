"""Queries for scans, schema inference and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import infer
from tidewater.plans.fixture_sql import F1, F1_KV, F1_TEXT, with_ctes
from tidewater.plans.registry import query
from tidewater.sources import fixtures as fx
from tidewater.sources.tables import list_namespaces, read_table, row_page, sample_n

MONGO_NS_OK = "database NOT IN ('admin', 'local', 'config') AND coll NOT LIKE 'system.%'"


def _user_docs(spark, sf_dir, text=True):
    """F1 documents of user namespaces (S3 filter applied as a semi join)."""
    t = fx.f1_documents_text(spark, sf_dir)
    ns = list_namespaces(t.select("database", F.col("coll").alias("name")), "mongo")
    t = t.join(ns.withColumnRenamed("name", "coll"), ["database", "coll"], "left_semi")
    return t.withColumn("doc", F.parse_json("doc_text"))


# ---- S1 -------------------------------------------------------------------------
@query("doc_scan", with_ctes(F1_TEXT) + """
SELECT database, coll, doc_id, CAST(len(json_keys(doc_text)) AS BIGINT) AS n_keys,
       CAST(length(doc_text) AS BIGINT) AS doc_chars
FROM f1t""")
def doc_scan(spark, sf_dir):
    t = fx.f1_documents_text(spark, sf_dir)
    return t.select("database", "coll", "doc_id",
                    F.size(F.json_object_keys("doc_text")).cast("long").alias("n_keys"),
                    F.length("doc_text").cast("long").alias("doc_chars"))


# ---- S2 -------------------------------------------------------------------------
@query("table_scan", """
SELECT * FROM orders""")
def table_scan(spark, sf_dir):
    return read_table(spark, sf_dir, "orders")


# ---- S3 -------------------------------------------------------------------------
@query("namespace_list", with_ctes(F1_TEXT) + f"""
SELECT DISTINCT database, coll AS name FROM f1t WHERE {MONGO_NS_OK}""")
def namespace_list(spark, sf_dir):
    t = fx.f1_documents_text(spark, sf_dir)
    return list_namespaces(t.select("database", F.col("coll").alias("name")), "mongo")


# ---- S4/S5 ----------------------------------------------------------------------
@query("exact_counts", with_ctes(F1_TEXT) + """
SELECT database, coll, CAST(count(*) AS BIGINT) AS n_rows FROM f1t GROUP BY database, coll""")
def exact_counts(spark, sf_dir):
    from tidewater.sources.tables import exact_counts as ec
    return ec(fx.f1_documents_text(spark, sf_dir), ["database", "coll"])


# ---- S6 -------------------------------------------------------------------------
@query("sample_n", with_ctes(F1_TEXT) + """
SELECT database, coll, doc_id FROM (
  SELECT database, coll, doc_id,
         row_number() OVER (PARTITION BY database, coll ORDER BY (doc_id * 1103515245 + 12387) % 2147483647, doc_id) AS rn
  FROM f1t) WHERE rn <= 25""")
def sample_n_q(spark, sf_dir):
    t = fx.f1_documents_text(spark, sf_dir).select("database", "coll", "doc_id")
    return sample_n(t, "doc_id", 25, seed=42, partition_by=["database", "coll"])


# ---- S8 -------------------------------------------------------------------------
@query("row_page", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, (SELECT count(*) FROM orders) AS total, true AS total_exact
FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100""")
def row_page_q(spark, sf_dir):
    """A page of rows in key order with the table total (exact here;
    a document collection without a count would report total_exact false)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    total = o.count()
    return row_page(o, ["o_orderkey"], limit=50, offset=100).withColumns(
        {"total": F.lit(total).cast("long"), "total_exact": F.lit(True)})


# ---- T1-T3 ----------------------------------------------------------------------
_INFER_SQL = with_ctes(F1_KV) + f""",
kv AS (SELECT * FROM f1c WHERE {MONGO_NS_OK}),
nd AS (SELECT database, coll, CAST(count(*) AS BIGINT) AS n_docs FROM f1t WHERE {MONGO_NS_OK} GROUP BY 1, 2),
pk AS (
  SELECT database, coll, key, CAST(count(*) AS BIGINT) AS presence_count,
         list_sort(list(DISTINCT ctype)) AS types,
         min(doc_id) AS first_doc, arg_min(ord, doc_id) AS first_ord
  FROM kv GROUP BY 1, 2, 3
),
res AS (
  SELECT pk.*, nd.n_docs, list_filter(types, lambda x: x <> 'null') AS nn FROM pk JOIN nd USING (database, coll)
)
SELECT database, coll,
       CAST(row_number() OVER (PARTITION BY database, coll ORDER BY first_doc, first_ord) AS INTEGER) AS ordinal,
       key AS column_name,
       CASE WHEN len(nn) = 0 THEN 'null' WHEN len(nn) = 1 THEN nn[1]
            WHEN nn = ['int', 'long'] THEN 'long' ELSE 'mixed' END AS type,
       (presence_count < n_docs OR len(nn) = 0 OR list_contains(types, 'null')) AS nullable,
       key = '_id' AS primary_key,
       presence_count,
       CASE WHEN len(nn) > 1 THEN array_to_string(nn, ',') END AS observed_types,
       n_docs
FROM res"""


@query("infer_schema", _INFER_SQL)
def infer_schema_q(spark, sf_dir):
    return infer.infer_schema(_user_docs(spark, sf_dir))


def _region_namespaces(spark, sf_dir):
    """Collections named after regions exist in the catalog but hold no documents."""
    r = read_table(spark, sf_dir, "region")
    return r.select(F.lit("crm").alias("database"),
                    F.concat(F.lit("archive_"), F.lower(F.regexp_replace("r_name", " ", "_"))).alias("coll"))


_EMPTY_NS_SQL = """
empty_ns AS (
  SELECT 'crm' AS database, 'archive_' || lower(replace(r_name, ' ', '_')) AS coll FROM region
)"""

_INFER_EMPTY_SQL = (_INFER_SQL.replace("WITH ", "WITH " + _EMPTY_NS_SQL.strip() + ",\n", 1) + """
UNION ALL
SELECT database, coll, 1 AS ordinal, '_id' AS column_name, 'objectid' AS type, false AS nullable,
       true AS primary_key, CAST(0 AS BIGINT) AS presence_count, CAST(NULL AS VARCHAR) AS observed_types,
       CAST(0 AS BIGINT) AS n_docs
FROM empty_ns""")


@query("infer_empty", _INFER_EMPTY_SQL)
def infer_empty_q(spark, sf_dir):
    docs = _user_docs(spark, sf_dir)
    return infer.infer_schema(docs, namespaces=_region_namespaces(spark, sf_dir))


_WARN_SQL = "WITH s AS (" + _INFER_EMPTY_SQL + """)
SELECT * FROM (
  SELECT database, coll, ordinal, column_name, 'warn' AS severity, 'mixed_type_field' AS code,
         printf('Field "%s" holds several types (%s); it is stored as TEXT.', column_name,
                replace(observed_types, ',', ', ')) AS message
  FROM s WHERE type = 'mixed'
  UNION ALL
  SELECT database, coll, ordinal, column_name, 'info', 'all_null_field',
         printf('Field "%s" is null in every document; it is created as nullable TEXT.', column_name)
  FROM s WHERE type = 'null'
  UNION ALL
  SELECT database, coll, 0, CAST(NULL AS VARCHAR), 'info', 'empty_collection',
         printf('Collection "%s.%s" has no documents; only _id is created.', database, coll)
  FROM s WHERE n_docs = 0
) w ORDER BY database, coll, ordinal, code"""


@query("infer_warnings", _WARN_SQL)
def infer_warnings_q(spark, sf_dir):
    """T4 + L11: all warnings of the dry run in first-seen order (a view may cap them, the operator doesn't)."""
    docs = _user_docs(spark, sf_dir)
    schema = infer.infer_schema(docs, namespaces=_region_namespaces(spark, sf_dir))
    return (infer.schema_warnings(schema)
            .orderBy("database", "coll", "ordinal", "code"))


# ---- T5 + S7 ----------------------------------------------------------------------
_DISCOVER_SQL = with_ctes(F1_KV) + f""",
firstn AS (
  SELECT database, coll, doc_id FROM (
    SELECT database, coll, doc_id, row_number() OVER (PARTITION BY database, coll ORDER BY doc_id) AS rn
    FROM f1t WHERE {MONGO_NS_OK}) WHERE rn <= 100
),
kv AS (
  SELECT f1c.*, CASE WHEN ctype = 'timestamp' THEN 'date' WHEN ctype = 'jsonb' THEN 'object'
                     WHEN ctype = 'long' AND jt <> 'OBJECT' THEN 'int' ELSE ctype END AS dtype
  FROM f1c JOIN firstn USING (database, coll, doc_id)
),
nd AS (SELECT database, coll, CAST(count(*) AS BIGINT) AS n_docs FROM firstn GROUP BY 1, 2),
pk AS (
  SELECT database, coll, key, CAST(count(*) AS BIGINT) AS presence_count,
         list_sort(list(DISTINCT dtype)) AS types, min(doc_id) AS first_doc, arg_min(ord, doc_id) AS first_ord
  FROM kv GROUP BY 1, 2, 3
)
SELECT database, coll,
       CAST(row_number() OVER (PARTITION BY database, coll ORDER BY first_doc, first_ord) AS INTEGER) AS ordinal,
       key AS column_name, CASE WHEN len(types) = 1 THEN types[1] ELSE 'mixed' END AS type,
       presence_count < n_docs AS nullable, key = '_id' AS primary_key, presence_count,
       CASE WHEN len(types) > 1 THEN array_to_string(types, ',') END AS observed_types
FROM pk JOIN nd USING (database, coll)"""


@query("discover_schema", _DISCOVER_SQL)
def discover_schema_q(spark, sf_dir):
    return infer.discover_schema(_user_docs(spark, sf_dir), first_n=100)


# ---- T6-T8 -------------------------------------------------------------------------
_PROFILE_BASE = f"""
WITH RECURSIVE
{F1_TEXT.strip()},
docs AS (SELECT database, coll, doc_id, CAST(doc_text AS JSON) AS doc FROM f1t WHERE {MONGO_NS_OK}),
walk(database, coll, doc_id, path, v, depth) AS (
  SELECT database, coll, doc_id, k.key, json_extract(doc, '$."' || k.key || '"'), 0
  FROM docs, unnest(json_keys(doc)) AS k(key)
  WHERE k.key <> '_id'
  UNION ALL
  SELECT database, coll, doc_id, path || '.' || k.key, json_extract(v, '$."' || k.key || '"'), depth + 1
  FROM walk, unnest(json_keys(v)) AS k(key)
  WHERE depth < 5 AND json_type(v) = 'OBJECT'
    AND NOT (len(json_keys(v)) = 1 AND json_keys(v)[1] IN ('$oid', '$date', '$numberLong', '$numberDecimal', '$binary', '$uuid'))
),
typed AS (
  SELECT *, CASE
      WHEN json_type(v) = 'NULL' THEN 'null'
      WHEN json_type(v) = 'VARCHAR' THEN 'string'
      WHEN json_type(v) = 'BOOLEAN' THEN 'boolean'
      WHEN json_type(v) = 'ARRAY' THEN 'array'
      WHEN json_type(v) = 'OBJECT' THEN CASE
          WHEN json_keys(v) = ['$oid'] THEN 'objectid' WHEN json_keys(v) = ['$date'] THEN 'date'
          WHEN json_keys(v) = ['$numberLong'] THEN 'long' WHEN json_keys(v) = ['$numberDecimal'] THEN 'decimal128'
          WHEN json_keys(v) IN (['$binary'], ['$uuid']) THEN 'binary' ELSE 'object' END
      WHEN CAST(v AS DOUBLE) <> floor(CAST(v AS DOUBLE)) THEN 'double'
      ELSE 'int' END AS ptype
  FROM walk
),
nd AS (SELECT database, coll, count(*) AS n_docs FROM docs GROUP BY 1, 2)"""


@query("profile_fields", _PROFILE_BASE + """
SELECT database, coll, path, array_to_string(list_sort(list(DISTINCT ptype) FILTER (WHERE ptype <> 'null')), ',') AS types,
       count(DISTINCT ptype) FILTER (WHERE ptype <> 'null') > 1 AS is_mixed_type,
       round(count(*) / any_value(n_docs) * 100, 4) AS presence_percent,
       round(count(*) FILTER (WHERE ptype = 'null') / any_value(n_docs) * 100, 4) AS null_rate,
       CAST(count(DISTINCT CASE
            WHEN ptype IN ('int') AND abs(CAST(v AS DOUBLE)) < 9e15 THEN CAST(CAST(CAST(v AS DOUBLE) AS BIGINT) AS VARCHAR)
            WHEN ptype IN ('int', 'double') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR)
            WHEN ptype IN ('string', 'boolean') THEN json_extract_string(v, '$') END) AS BIGINT) AS cardinality,
       count(DISTINCT CASE
            WHEN ptype IN ('int') AND abs(CAST(v AS DOUBLE)) < 9e15 THEN CAST(CAST(CAST(v AS DOUBLE) AS BIGINT) AS VARCHAR)
            WHEN ptype IN ('int', 'double') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR)
            WHEN ptype IN ('string', 'boolean') THEN json_extract_string(v, '$') END) > 1000 AS cardinality_capped
FROM typed JOIN nd USING (database, coll)
GROUP BY database, coll, path""")
def profile_fields_q(spark, sf_dir):
    return infer.profile_fields(_user_docs(spark, sf_dir))


@query("profile_numeric", _PROFILE_BASE + """
SELECT database, coll, path, CAST(count(*) AS BIGINT) AS n_numeric,
       round(min(CAST(v AS DOUBLE)), 4) AS min, round(max(CAST(v AS DOUBLE)), 4) AS max,
       round(avg(CAST(v AS DOUBLE)), 4) AS avg
FROM typed WHERE ptype IN ('int', 'double')
GROUP BY database, coll, path""")
def profile_numeric_q(spark, sf_dir):
    return infer.profile_numeric(_user_docs(spark, sf_dir))


@query("approx_counts", """
WITH st AS (
  SELECT 't_' || CAST(p_partkey AS VARCHAR) AS table_name,
         CASE WHEN p_partkey % 13 = 0 THEN -1.0 ELSE CAST(count(l_orderkey) AS DOUBLE) END AS pg_reltuples,
         CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE count(l_orderkey) END AS mysql_table_rows
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey
)
SELECT table_name, CASE WHEN pg_reltuples >= 0 THEN CAST(pg_reltuples AS BIGINT) END AS pg_approx,
       CASE WHEN mysql_table_rows > 0 THEN CAST(mysql_table_rows AS BIGINT) END AS mysql_approx,
       CAST(coalesce(CASE WHEN pg_reltuples >= 0 THEN CAST(pg_reltuples AS BIGINT) END, 0)
            + coalesce(CASE WHEN mysql_table_rows > 0 THEN CAST(mysql_table_rows AS BIGINT) END, 0) AS BIGINT) AS approx_total
FROM st""")
def approx_counts_q(spark, sf_dir):
    """Catalog statistics per table t_<partkey> (row count = its lineitems;
    never analysed when key % 13 = 0 in PG, reported as 0 when % 17 = 0 in MySQL)."""
    from tidewater.sources.tables import approx_counts
    p = read_table(spark, sf_dir, "part").select("p_partkey")
    li = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    st = p.join(li, p.p_partkey == li.l_partkey, "left").select(
        F.concat(F.lit("t_"), F.col("p_partkey").cast("string")).alias("table_name"),
        F.when(F.col("p_partkey") % 13 == 0, F.lit(-1.0)).otherwise(F.coalesce("n", F.lit(0)).cast("double"))
        .alias("pg_reltuples"),
        F.when(F.col("p_partkey") % 17 == 0, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).alias("mysql_table_rows"))
    return approx_counts(st)
