"""Scans, exports, feeds and mappings in their whole-row and per-engine forms: what S1, S3, S8, S14, S16, S19, L4, L5, O4, A2,
A9 and C18 ask for beside the queries of the other modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import alerts as al
from tidewater.operators import cdc, infer, load
from tidewater.operators import mapping as mp
from tidewater.operators import monitor as mon
from tidewater.operators.mapping import Col
from tidewater.plans import q_alerts, q_ddl, q_monitor, q_schema
from tidewater.plans.fixture_sql import F1_TEXT, F2, F3, F3_RAW_MONGO, F4, F7_MY, F7_PG, with_ctes
from tidewater.plans.q_mapping import crm_docs
from tidewater.plans.registry import query
from tidewater.session import checkpoint_dir
from tidewater.sources import fixtures as fx
from tidewater.sources import sinks
from tidewater.sources.fixtures import MYSQL_STATUS_NAMES
from tidewater.sources.tables import catalog_namespaces, fetch_rows, read_documents, read_table


# ---- S1: documents as files ----------------------------------------------------------------
@query("doc_scan_files", with_ctes(F1_TEXT) + """
SELECT CAST(json_extract(doc_text, '$._id') AS BIGINT) AS _id, json_extract_string(doc_text, '$.name') AS name,
       json_extract_string(doc_text, '$.address.geo.zone') AS zone, json_extract_string(doc_text, '$.tags[1]') AS tag,
       CAST(json_extract(doc_text, '$.score') AS DOUBLE) AS score, CAST(len(json_keys(doc_text)) AS BIGINT) AS n_keys
FROM f1t""")
def doc_scan_files(spark, sf_dir):
    """Documents lie in the shared folder as JSON Lines and are scanned whole, one VARIANT each."""
    path = checkpoint_dir(spark, "doc_files")
    fx.f1_documents_text(spark, sf_dir).select("doc_text").write.mode("overwrite").text(path)
    doc = read_documents(spark, path)
    get = lambda at, kind: F.try_variant_get("doc", at, kind)
    return doc.select(get("$._id", "long").alias("_id"), get("$.name", "string").alias("name"), get("$.address.geo.zone", "string").alias("zone"),
                      get("$.tags[1]", "string").alias("tag"), get("$.score", "double").alias("score"),
                      F.size(F.map_keys(F.col("doc").try_cast("map<string,variant>"))).cast("long").alias("n_keys"))


# ---- S3: namespaces of the SQL engines ---------------------------------------------------------
@query("namespace_list_sql", with_ctes(F2) + """
SELECT DISTINCT 'pg' AS engine, pg_schema AS database, table_name AS name FROM f2
WHERE pg_schema NOT IN ('pg_catalog', 'information_schema') AND NOT table_key % 11 = 0
UNION ALL
SELECT DISTINCT 'mysql', my_schema, table_name FROM f2
WHERE my_schema NOT IN ('mysql', 'information_schema', 'performance_schema', 'sys') AND NOT table_key % 11 = 0""")
def namespace_list_sql(spark, sf_dir):
    """S3: tables of PG (ordinary and partitioned) and MySQL (base tables) without views and system schemas."""
    c = fx.f2_catalog(spark, sf_dir)
    view = F.col("table_key") % 11 == 0
    pg = c.select(F.col("pg_schema").alias("database"), F.col("table_name").alias("name"),
                  F.when(view, "v").when(F.col("table_key") % 7 == 0, "p").otherwise("r").alias("kind"))
    my = c.select(F.col("my_schema").alias("database"), F.col("table_name").alias("name"), F.when(view, "VIEW").otherwise("BASE TABLE").alias("kind"))
    both = [catalog_namespaces(t, e).select(F.lit(e).alias("engine"), "database", "name") for t, e in ((pg, "pg"), (my, "mysql"))]
    return both[0].unionByName(both[1])


# ---- S8: pages without a key, pages of documents --------------------------------------------------
@query("row_page_no_key", """
SELECT *, (SELECT count(*) FROM lineitem) AS total, true AS total_exact FROM lineitem ORDER BY ALL LIMIT 200 OFFSET 300""")
def row_page_no_key(spark, sf_dir):
    """A page of a table without a key, in the order of its columns, all of them."""
    return fetch_rows(read_table(spark, sf_dir, "lineitem"), None, 200, 300)


@query("row_page_documents", with_ctes(F1_TEXT) + """
SELECT doc_id, doc_text, (SELECT count(*) FROM f1t) AS total, false AS total_exact FROM f1t ORDER BY doc_id LIMIT 20 OFFSET 40""")
def row_page_documents(spark, sf_dir):
    """A page of whole documents; their total is not marked exact."""
    return fetch_rows(fx.f1_documents_text(spark, sf_dir).select("doc_id", "doc_text"), ["doc_id"], 20, 40, documents=True)


# ---- S14: whole documents, values rendered at every depth -------------------------------------------
@query("export_json_nested", """
SELECT '{"_id":"' || lpad(lower(hex(o_orderkey)), 24, '0') || '","zeta":{"owner":"' || lpad(lower(hex(o_custkey)), 24, '0')
       || '","lines":[{"price":"' || printf('%.2f', o_totalprice) || '"},{"seen":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z')
       || '","at":"' || CAST(epoch_ms(o_orderdate) AS VARCHAR) || '"}]},"blob":"' || to_base64(CAST(o_orderpriority AS BLOB))
       || '","alpha":"say \\"{$oid}\\" ' || o_orderstatus || '","note":null}' AS value
FROM orders""")
def export_json_nested(spark, sf_dir):
    """Documents with wrapped values in arrays and nested documents, exported and read back as whole texts."""
    o = read_table(spark, sf_dir, "orders")
    oid = lambda c: F.concat(F.lit('{"$oid":"'), F.lpad(F.lower(F.hex(c)), 24, "0"), F.lit('"}'))
    wrap = lambda tag, c: F.concat(F.lit(f'{{"${tag}":"'), c, F.lit('"}'))
    text = F.concat(
        F.lit('{"_id":'), oid("o_orderkey"), F.lit(',"zeta":{"owner":'), oid("o_custkey"),
        F.lit(',"lines":[{"price":'), wrap("numberDecimal", F.format_string("%.2f", "o_totalprice")),
        F.lit('},{"seen":'), wrap("date", F.date_format("o_orderdate", sinks.ISO_MS)),
        F.lit(',"at":{"$date":'), wrap("numberLong", F.unix_millis("o_orderdate").cast("string")),
        F.lit('}}]},"blob":{"$binary":{"base64":"'), F.base64(F.encode("o_orderpriority", "UTF-8")),
        F.lit('","subType":"00"}},"alpha":"say \\"{$oid}\\" '), F.col("o_orderstatus"), F.lit('","note":null}'))
    path = checkpoint_dir(spark, "export_json_nested")
    sinks.export_documents(o.select(text.alias("doc_text")), path)
    return spark.read.text(path)


# ---- S16: a header for each collection ------------------------------------------------------------
@query("export_collection_csv", with_ctes(F1_TEXT) + """,
d AS (SELECT coll, doc_id, doc_text FROM f1t WHERE database = 'crm' AND coll NOT LIKE 'system.%'),
k AS (SELECT coll, doc_id, k.key, k.ord FROM d, unnest(json_keys(doc_text)) WITH ORDINALITY AS k(key, ord)),
fk AS (SELECT coll, key, min(doc_id) AS f, arg_min(ord, doc_id) AS o FROM k GROUP BY coll, key),
cell AS (SELECT d.coll, d.doc_id, fk.key, fk.f, fk.o, json_type(d.doc_text, '$."' || fk.key || '"') AS jt,
                json_extract_string(d.doc_text, '$."' || fk.key || '"') AS t
         FROM d JOIN fk USING (coll)),
txt AS (SELECT *, CASE WHEN t IS NULL OR jt = 'NULL' THEN ''
                       WHEN jt = 'DOUBLE' THEN regexp_replace(CAST(CAST(t AS DOUBLE) AS VARCHAR), '[.]0$', '') ELSE t END AS c FROM cell)
SELECT coll, 'header' AS part, string_agg(key, ',' ORDER BY f, o) AS value FROM fk GROUP BY coll
UNION ALL
SELECT coll, 'rows', string_agg(CASE WHEN regexp_matches(c, '[",]') THEN '"' || replace(c, '"', '""') || '"' ELSE c END, ',' ORDER BY f, o)
FROM txt GROUP BY coll, doc_id""")
def export_collection_csv(spark, sf_dir):
    """Database export to CSV with every collection under its own header; headers and rows read back as lines."""
    docs = crm_docs(spark, sf_dir)
    headers = sinks.union_columns(infer.explode_fields(docs, ("coll",)), ["coll"], ["doc_id", "pos"])
    base = sinks.export_collections(docs, headers, checkpoint_dir(spark, "export_colls"))
    back = [spark.read.text(f"{base}/{part}").select("coll", F.lit(part).alias("part"), "value") for part in ("header", "rows")]
    return back[0].unionByName(back[1])


# ---- S19: files of a snapshot ---------------------------------------------------------------------
@query("snapshot_sizes", """
SELECT 'run-1' AS run_id, count(*) AS n_rows, true AS has_files, true AS bytes_cover_rows FROM orders""")
def snapshot_sizes(spark, sf_dir):
    """A written snapshot's rows, files and bytes (each row takes a byte at least; tests hold the sizes against the disk)."""
    base = checkpoint_dir(spark, "snapshots")
    sinks.snapshot_write(read_table(spark, sf_dir, "orders"), base, "run-1")
    return sinks.snapshot_files(spark, base, "run-1").select("run_id", "n_rows", (F.col("n_files") > 0).alias("has_files"), (F.col("n_bytes") >= F.col("n_rows")).alias("bytes_cover_rows"))


# ---- L5: warnings of a preview --------------------------------------------------------------------
@query("preview_warnings", "WITH w AS (" + q_schema._WARN_SQL + "),\nns AS (SELECT DISTINCT database, coll FROM (" + q_schema._INFER_EMPTY_SQL + """)),
per AS (SELECT ns.database, ns.coll, CAST(count(*) FILTER (WHERE severity = 'warn') AS BIGINT) AS n_warn,
               CAST(count(*) FILTER (WHERE severity = 'info') AS BIGINT) AS n_info
        FROM ns LEFT JOIN w ON w.database = ns.database AND w.coll = ns.coll GROUP BY 1, 2)
SELECT * FROM per UNION ALL SELECT '*', '*', CAST(sum(n_warn) AS BIGINT), CAST(sum(n_info) AS BIGINT) FROM per""")
def preview_warnings(spark, sf_dir):
    """Warnings of each namespace of the dry run and their totals."""
    schema = infer.infer_schema(q_schema._user_docs(spark, sf_dir), namespaces=q_schema._region_namespaces(spark, sf_dir))
    return load.preview_warnings(infer.schema_warnings(schema), schema, ["database", "coll"])


# ---- L4: the plan of a dry run ----------------------------------------------------------------------
@query("dry_run_plan", "WITH s AS (" + q_schema._INFER_EMPTY_SQL + "),\nw AS (" + q_schema._WARN_SQL + """),
n AS (SELECT database, coll, column_name, count(*) AS n FROM w WHERE column_name IS NOT NULL GROUP BY ALL)
""" + "\nUNION ALL\n".join(f"""
SELECT '{d}' AS dest, s.database, s.coll, s.ordinal, s.column_name, {clean.format(x='s.column_name')} AS dest_name,
       coalesce({q_ddl.sql_case('s.type', kinds)}, 'TEXT') AS dest_type, s.nullable AND NOT s.primary_key AS nullable, s.primary_key,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n_warnings
FROM s LEFT JOIN n USING (database, coll, column_name)""" for d, clean, kinds in (
    ("pg", q_ddl.PG_CLEAN_SQL, q_ddl.CANONICAL_TO_PG), ("mysql", q_ddl.MY_CLEAN_SQL, q_ddl.CANONICAL_TO_MYSQL))))
def dry_run_plan(spark, sf_dir):
    """L4: the columns that a migration of the collections would create in PG and in MySQL."""
    schema = infer.infer_schema(q_schema._user_docs(spark, sf_dir), namespaces=q_schema._region_namespaces(spark, sf_dir))
    told = infer.schema_warnings(schema)
    both = [load.dry_run(schema, told, d, ["database", "coll"]).withColumn("dest", F.lit(d)) for d in ("pg", "mysql")]
    return both[0].unionByName(both[1])


# ---- O4: reports by any column --------------------------------------------------------------------
_BY = [("data_size", True), ("storage_size", False), ("n_collections", True), ("db", False)]


@query("size_report_sorted", "WITH r AS (" + q_monitor.SIZE_SQL + ")\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS sorted_by, db, CAST(row_number() OVER (ORDER BY {c} {'DESC' if d else 'ASC'} NULLS LAST, db) AS BIGINT) AS place FROM r" for c, d in _BY))
def size_report_sorted(spark, sf_dir):
    """The size report in the order of each of its columns."""
    report = q_monitor.size_report(spark, sf_dir)
    out = None
    for column, down in _BY:
        one = mon.sorted_report(report, column, down).select(F.lit(column).alias("sorted_by"), "db", "place")
        out = one if out is None else out.unionByName(one)
    return out


# ---- A2: MySQL snapshots as alert metrics -----------------------------------------------------------
@query("alert_metric_mysql", with_ctes(F4, F7_PG, F7_MY) + f""",
w AS (SELECT connection_id, event_id, {", ".join(f"coalesce(CAST(max(value) FILTER (WHERE variable_name = '{n}') AS DOUBLE), 0.0) AS {n}" for n in MYSQL_STATUS_NAMES)}
      FROM f7my GROUP BY connection_id, event_id),
m AS (
  SELECT connection_id, event_id, Threads_connected AS "currentConnections", greatest(0.0, 500.0 - Threads_connected) AS "availableConnections",
         CASE WHEN Uptime > 0 THEN round((Com_commit + Com_rollback) / Uptime, 2) + round(Questions / Uptime, 2) ELSE 0.0 END AS "opsPerSecTotal",
         CASE WHEN connection_id % 4 = 1 THEN CAST(event_id % 90 AS DOUBLE) END AS "replicationLag",
         CASE WHEN Innodb_buffer_pool_read_requests + Innodb_buffer_pool_reads > 0
              THEN round(Innodb_buffer_pool_read_requests / (Innodb_buffer_pool_read_requests + Innodb_buffer_pool_reads), 4) ELSE 0.0 END * 100 AS "wtCachePercent"
  FROM w)
SELECT connection_id, event_id, metric, round(value, 6) AS value
FROM (UNPIVOT m ON "currentConnections", "availableConnections", "opsPerSecTotal", "replicationLag", "wtCachePercent" INTO NAME metric VALUE value)""")
def alert_metric_mysql(spark, sf_dir):
    """A2: MySQL snapshots in the alert metric shape: operations are questions and transactions a second together."""
    wide = mon.status_pivot(fx.f7_mysql_status(spark, sf_dir), ["connection_id", "event_id"], MYSQL_STATUS_NAMES)
    replica = fx.f7_pg_stats(spark, sf_dir).select("connection_id", "event_id", "ts_ms", "is_replica", "replica_lag_s")
    snap = mon.mysql_snapshot(wide).join(replica, ["connection_id", "event_id"])
    return al.sql_metrics(snap, F.lit(500.0)).select("connection_id", "event_id", "metric", F.round("value", 6).alias("value"))


# ---- A9: the feed of chosen connections -------------------------------------------------------------
@query("alert_feed_connections", q_alerts.EVENTS_SQL + """
SELECT e.rule_id, e.island, r.name, r.metric, r.connection_id, e.status, e.fired_ms
FROM events e JOIN f6r r USING (rule_id)
WHERE e.status = 'firing' AND r.connection_id IN (SELECT user_id FROM events_of_errors)
ORDER BY e.fired_ms DESC, e.rule_id, e.island LIMIT 200""".replace("events_of_errors", "(SELECT DISTINCT connection_id AS user_id FROM f4b WHERE d_delete = 1)"))
def alert_feed_connections(spark, sf_dir):
    """Firing events of the connections that had an error, newest first, at most 200 whatever the limit asked for."""
    chosen = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select(F.col("user_id").alias("connection_id"))
    return al.feed(q_alerts.events(spark, sf_dir), q_alerts.rules(spark, sf_dir), chosen, "firing", 1000)


# ---- C18: all events through the mapper ----------------------------------------------------------------
CHANGE_COLS = [Col("o_orderstatus", "string"), Col("o_totalprice", "double"), Col("o_custkey", "long")]


@query("cdc_mapped_changes", with_ctes(F3, F3_RAW_MONGO) + """,
n AS (
  SELECT CASE WHEN t IN ('insert', 'replace') THEN 'insert' WHEN t = 'update' THEN 'update' WHEN t = 'delete' THEN 'delete' END AS op,
         CAST(json_extract(raw, '$.documentKey._id') AS BIGINT) AS key, json_extract(raw, '$.fullDocument') AS doc,
         json_extract_string(raw, '$.ns.coll') AS coll
  FROM (SELECT *, json_extract_string(raw, '$.operationType') AS t FROM f3mongo)),
o AS (SELECT *, CASE WHEN op = 'delete' THEN 'delete' WHEN json_type(doc, '$.o_totalprice') = 'VARCHAR' THEN 'reject' ELSE 'apply' END AS outcome
      FROM n WHERE op IS NOT NULL AND coll IS NOT NULL AND (op = 'delete' OR doc IS NOT NULL))
SELECT coll, key, outcome, CASE WHEN outcome = 'reject' THEN 'o_totalprice' END AS failed_columns,
       CASE WHEN outcome = 'apply' THEN json_extract_string(doc, '$.o_orderstatus') END AS o_orderstatus,
       CASE WHEN outcome = 'apply' THEN CAST(json_extract(doc, '$.o_totalprice') AS DOUBLE) END AS o_totalprice,
       CASE WHEN outcome = 'apply' THEN CAST(json_extract(doc, '$.o_custkey') AS BIGINT) END AS o_custkey
FROM o""")
def cdc_mapped_changes(spark, sf_dir):
    """Every change event mapped, deleted or rejected; the outcomes add up to the events."""
    return mp.map_changes(cdc.normalise_mongo(fx.f3_raw_mongo(spark, sf_dir)), CHANGE_COLS, "pg", ["coll", "key"])
