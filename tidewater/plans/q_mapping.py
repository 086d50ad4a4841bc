"""Queries for row mapping between document, PG and MySQL models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import cdc, infer
from tidewater.operators import mapping as mp
from tidewater.operators.mapping import Col
from tidewater.plans.fixture_sql import F1_TEXT, F2, F3, F3_RAW_MONGO, with_ctes
from tidewater.plans.q_ddl import DECLARED_SQL, declared_pg
from tidewater.plans.registry import query
from tidewater.sources import fixtures as fx
from tidewater.sources.tables import computed_once, fan_out_small, read_table


def crm_docs(spark, sf_dir):
    t = fx.f1_documents_text(spark, sf_dir).filter((F.col("database") == "crm") & ~F.col("coll").startswith("system."))
    return t.withColumn("doc", F.parse_json("doc_text"))


def crm_schema(spark, sf_dir) -> list[Col]:
    """Job 1 of a migration: infer the collection schema; only this small
    table comes back to the driver to build the projection."""
    s = infer.infer_schema(crm_docs(spark, sf_dir), ns_cols=("database",))
    return mp.schema_cols(s)


_CRM = with_ctes(F1_TEXT) + """,
d AS (SELECT doc_id, CAST(doc_text AS JSON) AS j FROM f1t WHERE database = 'crm' AND coll NOT LIKE 'system.%')"""


def _js(path):
    return (f"CASE WHEN json_type(j, '{path}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN "
            f"CASE WHEN CAST(json_extract(j, '{path}') AS DOUBLE) = floor(CAST(json_extract(j, '{path}') AS DOUBLE)) "
            f"THEN CAST(CAST(CAST(json_extract(j, '{path}') AS DOUBLE) AS BIGINT) AS VARCHAR) "
            f"ELSE CAST(CAST(json_extract(j, '{path}') AS DOUBLE) AS VARCHAR) END "
            f"ELSE json_extract_string(j, '{path}') END")


_DOC_COMMON = f"""
CAST(json_extract(j, '$._id') AS BIGINT) AS doc_id, json_extract_string(j, '$.name') AS name,
CAST(json_extract(j, '$.address') AS VARCHAR) AS address, {_js('$.age')} AS age, {_js('$.score')} AS score,
json_extract_string(j, '$.note') AS note, CAST(json_extract(j, '$.tags') AS VARCHAR) AS tags,
json_extract_string(j, '$.ref."$oid"') AS ref, CAST(NULL AS VARCHAR) AS legacy,
CAST(json_extract(j, '$.big') AS BIGINT) AS big, CAST(json_extract(j, '$._id') AS INTEGER) AS _id"""


@query("map_doc_to_pg", _CRM + f"""
SELECT {_DOC_COMMON}, CAST(json_extract(j, '$.active') AS BOOLEAN) AS active FROM d""")
def map_doc_to_pg(spark, sf_dir):
    """Documents -> PG rows (schema columns only, cleaned names)."""
    mapped, _, _ = mp.map_doc_to_sql(crm_docs(spark, sf_dir), crm_schema(spark, sf_dir), "pg", keep=["doc_id"])
    return mapped


@query("map_doc_to_mysql", _CRM + f"""
SELECT {_DOC_COMMON}, CAST(CAST(json_extract(j, '$.active') AS BOOLEAN) AS INTEGER) AS active FROM d""")
def map_doc_to_mysql(spark, sf_dir):
    """Documents -> MySQL rows (ObjectId as hex, booleans 1/0, ints truncated)."""
    mapped, _, _ = mp.map_doc_to_sql(crm_docs(spark, sf_dir), crm_schema(spark, sf_dir), "mysql", keep=["doc_id"])
    return mapped


ORDERS_COLS = [Col("o_orderkey", "long", True), Col("o_custkey", "long", references="customer.c_custkey"),
               Col("o_orderstatus", "string"), Col("o_totalprice", "double"), Col("o_orderdate", "timestamp"),
               Col("o_orderpriority", "string")]


def _doc_summary(docs):
    return docs.select(F.get_json_object("doc", "$._id").alias("_id"),
                       F.size(F.json_object_keys("doc")).cast("long").alias("n_keys"),
                       F.get_json_object("doc", "$.o_orderstatus").alias("status"),
                       F.get_json_object("doc", "$.o_totalprice").cast("double").alias("price"),
                       F.get_json_object("doc", "$.o_orderdate['$date']").alias("date"))


@query("map_pg_to_doc", """
SELECT CAST(o_orderkey AS VARCHAR) AS _id, CAST(6 AS BIGINT) AS n_keys, o_orderstatus AS status, o_totalprice AS price,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS date
FROM orders""")
def map_pg_to_doc(spark, sf_dir):
    """PG rows -> documents; the single PK becomes ``_id`` (native type)."""
    docs, _ = mp.map_sql_to_doc(read_table(spark, sf_dir, "orders"), ORDERS_COLS, "pg")
    return _doc_summary(docs)


CUST_COLS = [Col("c_custkey", "long", True), Col("c_name", "string"), Col("c_nationkey", "int"),
             Col("c_acctbal", "double"), Col("active", "boolean"), Col("prefs", "json"), Col("since", "date")]


def customer_source(spark, sf_dir, engine: str):
    """``customer`` as a SQL source table: a boolean (tinyint(1) in MySQL),
    a JSON preferences column and a date."""
    c = read_table(spark, sf_dir, "customer")
    active = F.col("c_acctbal") > 0
    return c.select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                    (active.cast("int") if engine == "mysql" else active).alias("active"),
                    F.concat(F.lit('{"segment":"'), F.col("c_mktsegment"), F.lit('","nation":'),
                             F.col("c_nationkey").cast("string"), F.lit("}")).alias("prefs"),
                    F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int")).alias("since"))


@query("map_mysql_to_doc", """
SELECT CAST(c_custkey AS VARCHAR) AS _id, c_acctbal > 0 AS active, c_mktsegment AS segment, CAST(7 AS BIGINT) AS n_keys
FROM customer""")
def map_mysql_to_doc(spark, sf_dir):
    """MySQL rows -> documents; ``_id`` = String(pk), tinyint(1) -> boolean,
    JSON text parsed into a sub-document."""
    docs, _ = mp.map_sql_to_doc(customer_source(spark, sf_dir, "mysql"), CUST_COLS, "mysql")
    return docs.select(F.get_json_object("doc", "$._id").alias("_id"),
                       F.get_json_object("doc", "$.active").cast("boolean").alias("active"),
                       F.get_json_object("doc", "$.prefs.segment").alias("segment"),
                       F.size(F.json_object_keys("doc")).cast("long").alias("n_keys"))


_CUST_SQL = """
WITH src AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_acctbal > 0 AS active,
         '{"segment":"' || c_mktsegment || '","nation":' || CAST(c_nationkey AS VARCHAR) || '}' AS prefs,
         DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS since
  FROM customer
)"""


@query("map_pg_to_mysql", _CUST_SQL + """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, CAST(active AS INTEGER) AS active, prefs, since FROM src""")
def map_pg_to_mysql(spark, sf_dir):
    """Booleans -> 1/0, JSON -> text, dates kept as dates."""
    return mp.map_sql_to_sql(customer_source(spark, sf_dir, "pg"), CUST_COLS, "pg", "mysql")


@query("map_mysql_to_pg", _CUST_SQL + """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, active, prefs, CAST(since AS VARCHAR) AS since FROM src""")
def map_mysql_to_pg(spark, sf_dir):
    """0/1 -> boolean, JSON -> text, dates cut to 10 characters."""
    return mp.map_sql_to_sql(customer_source(spark, sf_dir, "mysql"), CUST_COLS, "mysql", "pg")


@query("map_identity", _CUST_SQL + """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, active, prefs, since FROM src""")
def map_identity(spark, sf_dir):
    """Same-engine pairs pass rows through (names cleaned only)."""
    return mp.map_sql_to_sql(customer_source(spark, sf_dir, "pg"), CUST_COLS, "pg", "pg")


LINE_COLS = [Col("l_orderkey", "long", True), Col("l_linenumber", "int", True), Col("l_partkey", "long"),
             Col("l_quantity", "double")]


@query("map_composite_pk", """
SELECT substring(sha256(json_object('l_orderkey', l_orderkey, 'l_linenumber', l_linenumber)::VARCHAR), 1, 24) AS _id,
       l_orderkey AS pk_order, l_linenumber AS pk_line,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
         AS violations
FROM lineitem""")
def map_composite_pk(spark, sf_dir):
    """Composite PK -> generated ``_id`` + ``pk`` sub-document; the unique
    check on pk.* reports violating keys (joined back as a count)."""
    li = read_table(spark, sf_dir, "lineitem")
    docs, _ = mp.map_sql_to_doc(li, LINE_COLS, "pg")
    viol = mp.composite_pk_violations(li, ["l_orderkey", "l_linenumber"])
    n_viol = viol.count()
    return docs.select(F.get_json_object("doc", "$._id").alias("_id"),
                       F.get_json_object("doc", "$.pk.l_orderkey").cast("long").alias("pk_order"),
                       F.get_json_object("doc", "$.pk.l_linenumber").cast("int").alias("pk_line"),
                       F.lit(n_viol).cast("long").alias("violations"))


@query("fk_warnings", with_ctes(F2, DECLARED_SQL) + """
SELECT schema, table_name, column_name, 'info' AS severity, 'fk_kept_as_reference' AS code, "references"
FROM decl_pg WHERE "references" IS NOT NULL""")
def fk_warnings(spark, sf_dir):
    """X11: every FK column is kept as a plain field, with an info warning."""
    d = declared_pg(spark, sf_dir).filter(F.col("references").isNotNull())
    return d.select("schema", "table_name", "column_name", F.lit("info").alias("severity"),
                    F.lit("fk_kept_as_reference").alias("code"), "references")


@query("map_matrix", with_ctes(F1_TEXT) + """,
n AS (
  SELECT (SELECT count(*) FROM f1t WHERE database = 'crm' AND coll NOT LIKE 'system.%') AS n_doc,
         (SELECT count(*) FROM orders) AS n_pg, (SELECT count(*) FROM customer) AS n_my
)
SELECT source, dest, mapper, needs_database,
       CAST(CASE source WHEN 'mongodb' THEN n_doc WHEN 'postgres' THEN n_pg ELSE n_my END AS BIGINT) AS n_rows
FROM n, (VALUES ('mongodb', 'postgres', 'map_doc_to_pg', true), ('mongodb', 'mysql', 'map_doc_to_mysql', true),
                ('mongodb', 'mongodb', 'map_identity', true), ('postgres', 'mongodb', 'map_pg_to_doc', false),
                ('postgres', 'mysql', 'map_pg_to_mysql', false), ('postgres', 'postgres', 'map_identity', false),
                ('mysql', 'mongodb', 'map_mysql_to_doc', true), ('mysql', 'postgres', 'map_mysql_to_pg', true),
                ('mysql', 'mysql', 'map_identity', true)) AS t(source, dest, mapper, needs_database)""")
def map_matrix(spark, sf_dir):
    """Every direction dispatched to its mapper and run on its source
    (documents, orders as PG, customer as MySQL); one row per direction."""
    docs = crm_docs(spark, sf_dir)
    cols = crm_schema(spark, sf_dir)
    orders = read_table(spark, sf_dir, "orders")
    cust_my = customer_source(spark, sf_dir, "mysql")
    cust_pg = customer_source(spark, sf_dir, "pg")
    runs = {
        ("mongodb", "postgres"): lambda: mp.map_doc_to_sql(docs, cols, "pg")[0],
        ("mongodb", "mysql"): lambda: mp.map_doc_to_sql(docs, cols, "mysql")[0],
        ("mongodb", "mongodb"): lambda: docs.select("doc"),
        ("postgres", "mongodb"): lambda: mp.map_sql_to_doc(orders, ORDERS_COLS, "pg")[0],
        ("postgres", "mysql"): lambda: mp.map_sql_to_sql(orders, ORDERS_COLS, "pg", "mysql"),
        ("postgres", "postgres"): lambda: mp.map_sql_to_sql(orders, ORDERS_COLS, "pg", "pg"),
        ("mysql", "mongodb"): lambda: mp.map_sql_to_doc(cust_my, CUST_COLS, "mysql")[0],
        ("mysql", "postgres"): lambda: mp.map_sql_to_sql(cust_my, CUST_COLS, "mysql", "pg"),
        ("mysql", "mysql"): lambda: mp.map_sql_to_sql(cust_pg, CUST_COLS, "mysql", "mysql"),
    }
    parts = []
    for src, dst, mapper, needs in mp.DIRECTIONS:
        df = runs[(src, dst)]()
        parts.append(df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(
            F.lit(src).alias("source"), F.lit(dst).alias("dest"), F.lit(mapper).alias("mapper"),
            F.lit(needs).alias("needs_database"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("coercion_warnings", _CRM + """
SELECT 'object_to_json' AS code, "column", CAST(count(*) AS BIGINT) AS n_rows FROM (
  SELECT 'address' AS "column" FROM d WHERE json_type(j, '$.address') = 'OBJECT'
  UNION ALL SELECT 'tags' FROM d WHERE json_type(j, '$.tags') = 'ARRAY')
GROUP BY "column" """)
def coercion_warnings(spark, sf_dir):
    """Row warnings aggregated by (code, column): documents mapped to MySQL
    with ``address`` and ``tags`` declared as text (a user type override),
    so every object/array value raises ``object_to_json``."""
    cols = [Col(c.name, "string") if c.name in ("address", "tags") else c for c in crm_schema(spark, sf_dir)]
    _, _, warnings = mp.map_doc_to_sql(crm_docs(spark, sf_dir), cols, "mysql")
    return warnings


LEDGER_COLS = [Col("id", "long", True), Col("big", "long"), Col("amount", "decimal"), Col("note", "json"), Col("extra", "mixed")]
LEDGER_SQL = """
WITH src AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderkey % 13 = 0 THEN 'x' || CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 5 = 0 THEN NULL
              WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey + 3000000000 AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS big,
         CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' WHEN o_orderkey % 19 = 0 THEN repeat('7', 35) WHEN o_orderkey % 3 = 0 THEN NULL
              ELSE CAST(o_custkey AS VARCHAR) || '.50' END AS amount,
         CASE WHEN o_orderkey % 11 = 0 THEN '{broken' WHEN o_orderkey % 7 = 0 THEN NULL
              ELSE '{"s":"' || o_orderstatus || '"}' END AS note,
         CASE WHEN o_orderkey % 4 <> 0 THEN '{"c":' || CAST(o_custkey AS VARCHAR) || '}' END AS extra
  FROM orders
)"""


def ledger(spark, sf_dir):
    """A SQL source over ``orders`` whose drivers hand big integers and decimals over as text, some of it no number; a JSON
    column with some broken text; a column of no one type that holds objects."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = k.cast("string")
    return o.select(
        k.cast("long").alias("id"),
        F.when(k % 13 == 0, F.concat(F.lit("x"), text)).when(k % 5 == 0, F.lit(None).cast("string"))
         .when(k % 2 == 0, (k + 3000000000).cast("string")).otherwise(text).alias("big"),
        F.when(k % 17 == 0, F.lit("n/a")).when(k % 19 == 0, F.repeat(F.lit("7"), 35)).when(k % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".50"))).alias("amount"),
        F.when(k % 11 == 0, F.lit("{broken")).when(k % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit('{"s":"'), F.col("o_orderstatus"), F.lit('"}'))).alias("note"),
        F.when(k % 4 != 0, F.struct(F.col("o_custkey").alias("c"))).alias("extra"))


_LEDGER_BAD = {
    "long_coerce_failed": ("big", "id % 13 = 0"),
    "decimal_coerce_failed": ("amount", "amount = 'n/a' OR length(amount) = 35"),
    "mixed_to_subdoc": ("extra", "extra IS NOT NULL"),
    "json_stringify_failed": ("note", "note = '{broken'"),
    "binary_coerce_failed": ("note", "note IS NOT NULL"),
}


def _ledger_warnings(direction: str, codes: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{direction}' AS direction, '{c}' AS code, '{_LEDGER_BAD[c][0]}' AS \"column\", CAST(count(*) AS BIGINT) AS n_rows "
        f"FROM src WHERE {_LEDGER_BAD[c][1]} HAVING count(*) > 0" for c in codes)


@query("coercion_codes", LEDGER_SQL + " UNION ALL ".join([
    _ledger_warnings("pg-doc", ["long_coerce_failed", "decimal_coerce_failed"]),
    _ledger_warnings("mysql-doc", ["long_coerce_failed", "decimal_coerce_failed", "mixed_to_subdoc"]),
    _ledger_warnings("pg-mysql", ["json_stringify_failed"]), _ledger_warnings("mysql-pg", ["json_stringify_failed"]),
    _ledger_warnings("doc-pg", ["binary_coerce_failed"])]))
def coercion_codes(spark, sf_dir):
    """The other five row warnings, by direction: numbers that do not parse,
    objects in columns of no one type, broken JSON, and text declared binary."""
    src = ledger(spark, sf_dir)
    docs = src.select("id", F.to_json(F.struct("id", "note")).alias("doc_text")).withColumn("doc", F.parse_json("doc_text"))
    parts = {
        "pg-doc": mp.row_warnings(src, LEDGER_COLS, "pg", "doc"), "mysql-doc": mp.row_warnings(src, LEDGER_COLS, "mysql", "doc"),
        "pg-mysql": mp.row_warnings(src, LEDGER_COLS, "pg", "mysql"), "mysql-pg": mp.row_warnings(src, LEDGER_COLS, "mysql", "pg"),
        "doc-pg": mp.map_doc_to_sql(docs, [Col("id", "long"), Col("note", "binary")], "pg")[2]}
    out = None
    for direction, w in parts.items():
        w = w.select(F.lit(direction).alias("direction"), "code", "column", "n_rows")
        out = w if out is None else out.unionByName(w)
    return out


def _number(limit: str) -> str:
    return f"CASE WHEN big IS NULL THEN 'null' WHEN id % 13 = 0 THEN '\"' || big || '\"' WHEN {limit} THEN '{{\"$numberLong\":\"' || big || '\"}}' ELSE big END"


@query("map_coerced_docs", LEDGER_SQL + """
SELECT id, '{"_id":' || CAST(id AS VARCHAR) || ',"big":' || """ + _number("CAST(big AS BIGINT) > 2147483647") + """
  || ',"amount":' || CASE WHEN amount IS NULL THEN 'null' WHEN amount = 'n/a' OR length(amount) = 35 THEN '"' || amount || '"'
                          ELSE '{"$numberDecimal":"' || amount || '"}' END
  || ',"note":' || CASE WHEN note IS NULL THEN 'null' WHEN note = '{broken' THEN '"{broken"' ELSE note END
  || ',"extra":' || coalesce(extra, 'null') || '}' AS doc
FROM src""")
def map_coerced_docs(spark, sf_dir):
    """Whole documents, with the values that did not convert kept as text."""
    docs, _ = mp.map_sql_to_doc(ledger(spark, sf_dir), LEDGER_COLS, "pg")
    return docs.select(F.col("_id").cast("long").alias("id"), "doc")


def shop_docs(spark, sf_dir):
    """Two collections of unlike shape: ``code`` is a number in one and text in
    the other, every item has a key of its own, some totals are no number."""
    p, o = fan_out_small(read_table(spark, sf_dir, "part")), fan_out_small(read_table(spark, sf_dir, "orders"))
    k, n = F.col("p_partkey").cast("string"), F.col("o_orderkey").cast("string")
    items = p.select(F.lit("items").alias("coll"), F.col("p_partkey").alias("doc_id"),
                     F.concat(F.lit('{"_id":'), k, F.lit(',"code":'), F.col("p_size").cast("string"), F.lit(',"attr.'), k, F.lit('":'), k, F.lit("}")).alias("doc_text"))
    total = F.when(F.col("o_orderkey") % 29 == 0, F.lit('"n/a"')).otherwise(F.format_string("%.2f", "o_totalprice"))
    orders = o.select(F.lit("orders").alias("coll"), F.col("o_orderkey").alias("doc_id"),
                      F.concat(F.lit('{"_id":'), n, F.lit(',"code":"'), F.col("o_orderstatus"), F.lit('","total":'), total,
                               F.lit(',"meta":{"p":"'), F.col("o_orderpriority"), F.lit('","c":'), F.col("o_custkey").cast("string"), F.lit("}}")).alias("doc_text"))
    return computed_once(computed_once(items.unionByName(orders).withColumnRenamed("doc_text", "_text"), F.col("_text").alias("doc_text")).drop("_text"), F.parse_json("doc_text").alias("doc"))


def _shop_fields(spark, sf_dir, dialect: str):
    docs = shop_docs(spark, sf_dir)
    schema = infer.infer_schema(docs, ns_cols=NS_COLL)
    # the user's override of a type: totals are numbers
    schema = schema.withColumn("type", F.when((F.col("coll") == "orders") & (F.col("column_name") == "total"), F.lit("double")).otherwise(F.col("type")))
    return mp.map_doc_fields(docs, mp.destination_schema(schema, dialect, NS_COLL), dialect, NS_COLL)


NS_COLL = ["coll"]
_SHOP_SQL = """
WITH f AS (
  SELECT 'items' AS coll, p_partkey AS doc_id, '_id' AS column_name, 'int' AS type, CAST(p_partkey AS VARCHAR) AS value, true AS ok FROM part
  UNION ALL SELECT 'items', p_partkey, 'code', 'int', CAST(p_size AS VARCHAR), true FROM part
  UNION ALL SELECT 'items', p_partkey, 'attr_' || CAST(p_partkey AS VARCHAR), 'int', CAST(p_partkey AS VARCHAR), true FROM part
  UNION ALL SELECT 'orders', o_orderkey, '_id', 'int', CAST(o_orderkey AS VARCHAR), true FROM orders
  UNION ALL SELECT 'orders', o_orderkey, 'code', 'string', o_orderstatus, true FROM orders
  UNION ALL SELECT 'orders', o_orderkey, 'total', 'double',
                   CASE WHEN o_orderkey % 29 <> 0 THEN CAST(CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS VARCHAR) END, o_orderkey % 29 <> 0 FROM orders
  UNION ALL SELECT 'orders', o_orderkey, 'meta', 'jsonb', '{"p":"' || o_orderpriority || '","c":' || CAST(o_custkey AS VARCHAR) || '}', true FROM orders
)"""


@query("map_doc_collections", _SHOP_SQL + """
SELECT coll, doc_id, column_name, type, value, ok FROM f""")
def map_doc_collections(spark, sf_dir):
    """Collections of unlike shape through their own schemas, every field of every document."""
    return _shop_fields(spark, sf_dir, "pg").select("coll", "doc_id", "column_name", "type", "value", "ok")


@query("map_doc_rejects", _SHOP_SQL + """
SELECT coll, CAST(count(*) FILTER (WHERE bad = 0) AS BIGINT) AS written, CAST(count(*) FILTER (WHERE bad > 0) AS BIGINT) AS rejected,
       max(failed) AS failed_columns
FROM (SELECT coll, doc_id, count(*) FILTER (WHERE NOT ok) AS bad, max(CASE WHEN NOT ok THEN column_name END) AS failed FROM f GROUP BY 1, 2)
GROUP BY coll""")
def map_doc_rejects(spark, sf_dir):
    """The rows that a load of each collection would write and reject, with the columns at fault."""
    rows = mp.field_rows(_shop_fields(spark, sf_dir, "mysql"), shop_docs(spark, sf_dir), NS_COLL)
    bad = F.size("failed_columns") > 0
    return rows.groupBy("coll").agg(F.count_if(~bad).cast("long").alias("written"), F.count_if(bad).cast("long").alias("rejected"),
                                    F.max(F.when(bad, F.array_join("failed_columns", ","))).alias("failed_columns"))


@query("cdc_mapped", with_ctes(F3, F3_RAW_MONGO) + """,
n AS (
  SELECT CASE WHEN t IN ('insert', 'replace') THEN 'insert' WHEN t = 'update' THEN 'update' WHEN t = 'delete' THEN 'delete' END AS op,
         CAST(json_extract(raw, '$.documentKey._id') AS BIGINT) AS key, json_extract(raw, '$.fullDocument') AS fulldoc,
         json_extract_string(raw, '$.ns.coll') AS coll
  FROM (SELECT *, json_extract_string(raw, '$.operationType') AS t FROM f3mongo)
)
SELECT key, op, json_extract_string(fulldoc, '$.o_orderstatus') AS o_orderstatus,
       CAST(json_extract(fulldoc, '$.o_totalprice') AS DOUBLE) AS o_totalprice,
       CAST(json_extract(fulldoc, '$.o_custkey') AS BIGINT) AS o_custkey
FROM n WHERE op IN ('insert', 'update') AND coll IS NOT NULL AND fulldoc IS NOT NULL
  AND NOT coalesce(json_type(fulldoc, '$.o_totalprice') = 'VARCHAR', false)""")
def cdc_mapped(spark, sf_dir):
    """Change events mapped with the document -> PG mapper before apply;
    events whose values do not convert become rejects (not applied)."""
    n = cdc.normalise_mongo(fx.f3_raw_mongo(spark, sf_dir)).filter(F.col("op") != "delete")
    n = n.withColumn("doc_text", F.col("doc")).withColumn("doc", F.parse_json("doc"))
    cols = [Col("o_orderstatus", "string"), Col("o_totalprice", "double"), Col("o_custkey", "long")]
    mapped, _, _ = mp.map_doc_to_sql(n, cols, "pg", keep=["key", "op"])
    return mapped


NATION_COLS = [Col("n_nationkey", "int"), Col("n_name", "string"), Col("n_regionkey", "int")]


@query("map_no_pk", """
SELECT substring(sha256(json_object('n_nationkey', n_nationkey, 'n_name', n_name, 'n_regionkey', n_regionkey)::VARCHAR), 1, 24)
         AS _id, n_name
FROM nation""")
def map_no_pk(spark, sf_dir):
    """A table without a primary key gets a deterministic generated
    ``_id`` (a hash of the row), so re-running the migration gives the same ids."""
    docs, _ = mp.map_sql_to_doc(read_table(spark, sf_dir, "nation"), NATION_COLS, "pg")
    return docs.select(F.get_json_object("doc", "$._id").alias("_id"), F.get_json_object("doc", "$.n_name").alias("n_name"))


DUP_COLS = [Col("l_returnflag", "string"), Col("l_linenumber", "int")]


@query("map_no_pk_duplicates", """
SELECT l_returnflag, CAST(l_linenumber AS INTEGER) AS l_linenumber, count(*) AS n_rows, count(*) AS n_ids FROM lineitem GROUP BY 1, 2""")
def map_no_pk_duplicates(spark, sf_dir):
    """X10 on a table of few different rows, each there thousands of times: every row has an id of its own."""
    docs, _ = mp.map_sql_to_doc(read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"), DUP_COLS, "pg")
    each = docs.select(F.get_json_object("doc", "$._id").alias("id"), F.get_json_object("doc", "$.l_returnflag").alias("l_returnflag"),
                       F.get_json_object("doc", "$.l_linenumber").cast("int").alias("l_linenumber"))
    each = each.groupBy("l_returnflag", "l_linenumber", "id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("l_returnflag", "l_linenumber").agg(F.sum("n").cast("long").alias("n_rows"), F.count("id").cast("long").alias("n_ids"))
