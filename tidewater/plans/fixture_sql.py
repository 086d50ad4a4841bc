"""DuckDB twins of the F1-F6 fixture recipes (``tidewater.sources.fixtures``),
used as CTEs inside ``oracle_sql()`` entries."""

from __future__ import annotations

from tidewater.sources.fixtures import (COLUMN_WORDS, MYSQL_NATIVE_TYPES, MYSQL_SCHEMAS,
                                        PG_NATIVE_TYPES, PG_SCHEMAS, RUN_KINDS)


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


F1_TEXT = """
f1t AS (
  SELECT CASE WHEN c_custkey % 89 = 0 THEN 'admin' ELSE 'crm' END AS database,
         CASE WHEN c_custkey % 97 = 0 THEN 'system.profile' ELSE lower(c_mktsegment) END AS coll,
         c_custkey AS doc_id,
         '{' || concat_ws(',',
           '"_id":' || CAST(c_custkey AS VARCHAR),
           '"name":"' || c_name || '"',
           '"address":{"nation":' || CAST(c_nationkey AS VARCHAR) || ',"segment":"' || c_mktsegment
             || '","geo":{"region":' || CAST(c_nationkey % 5 AS VARCHAR) || ',"zone":"z'
             || CAST(c_custkey % 7 AS VARCHAR) || '"}}',
           CASE WHEN c_custkey % 20 = 0 THEN '"age":"' || CAST(18 + c_custkey % 60 AS VARCHAR) || '"'
                ELSE '"age":' || CAST(18 + c_custkey % 60 AS VARCHAR) END,
           CASE WHEN c_custkey % 10 <> 0 THEN '"score":' || printf('%.2f', c_acctbal) END,
           CASE WHEN c_custkey % 5 < 2 THEN '"note":null'
                ELSE '"note":"' || lower(c_mktsegment) || ' buyer"' END,
           CASE WHEN c_custkey % 3 = 0 THEN '"tags":["' || lower(c_mktsegment) || '","n'
                || CAST(c_nationkey AS VARCHAR) || '"]' END,
           '"active":' || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END,
           '"ref":{"$oid":"' || lpad(lower(hex(c_custkey)), 24, '0') || '"}',
           CASE WHEN c_custkey % 8 = 0 THEN '"legacy":null' END,
           '"big":' || CAST(c_custkey * 2000003 AS VARCHAR)
         ) || '}' AS doc_text
  FROM customer
)"""

F1 = F1_TEXT + """,
f1 AS (SELECT database, coll, doc_id, CAST(doc_text AS JSON) AS doc FROM f1t)"""

# one row per (document, top-level key) with the canonical type of the value
F1_KV = F1 + """,
f1kv AS (
  SELECT database, coll, doc_id, key, ord, v, json_type(v) AS jt FROM (
    SELECT database, coll, doc_id, k.key AS key, k.ord AS ord,
           json_extract(doc, '$."' || k.key || '"') AS v
    FROM f1, unnest(json_keys(doc)) WITH ORDINALITY AS k(key, ord)
  )
),
f1c AS (
  SELECT *, CASE
      WHEN jt = 'NULL' THEN 'null'
      WHEN jt = 'VARCHAR' THEN 'string'
      WHEN jt = 'BOOLEAN' THEN 'boolean'
      WHEN jt = 'ARRAY' THEN 'array'
      WHEN jt = 'OBJECT' THEN CASE
          WHEN json_keys(v) = ['$oid'] THEN 'objectid'
          WHEN json_keys(v) = ['$date'] THEN 'timestamp'
          WHEN json_keys(v) = ['$numberLong'] THEN 'long'
          WHEN json_keys(v) = ['$numberDecimal'] THEN 'decimal'
          WHEN json_keys(v) = ['$binary'] THEN 'binary'
          WHEN json_keys(v) = ['$uuid'] THEN 'uuid'
          ELSE 'jsonb' END
      WHEN jt IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CASE
          WHEN CAST(v AS DOUBLE) <> floor(CAST(v AS DOUBLE)) THEN 'double'
          WHEN CAST(v AS DOUBLE) BETWEEN -2147483648 AND 2147483647 THEN 'int'
          WHEN CAST(v AS DOUBLE) BETWEEN -9223372036854775808 AND 9223372036854775807 THEN 'long'
          ELSE 'double' END
      ELSE 'unknown' END AS ctype
  FROM f1kv
)"""

F2 = f"""
f2 AS (
  SELECT {_list(PG_SCHEMAS)}[p_partkey % 10 + 1] AS pg_schema,
         {_list(MYSQL_SCHEMAS)}[p_partkey % 10 + 1] AS my_schema,
         't_' || CAST(p_partkey AS VARCHAR) AS table_name,
         p_partkey AS table_key,
         CAST(j AS INTEGER) AS ordinal,
         CASE WHEN j = 1 THEN 'id' WHEN is_fk THEN 'parent_id'
              ELSE {_list(COLUMN_WORDS)}[(p_partkey + j) % {len(COLUMN_WORDS)} + 1] || '_' || CAST(j AS VARCHAR)
         END AS column_name,
         CASE WHEN j = 1 OR is_fk THEN key_pg
              ELSE {_list(PG_NATIVE_TYPES)}[(p_partkey * 7 + j) % {len(PG_NATIVE_TYPES)} + 1] END AS pg_type,
         my_type,
         CASE WHEN my_type = 'tinyint' AND (p_partkey + j) % 2 = 0 THEN 'tinyint(1)'
              WHEN my_type = 'varchar' THEN 'varchar(255)'
              WHEN my_type = 'decimal' THEN 'decimal(10,2)'
              ELSE my_type END AS my_column_type,
         CASE WHEN is_pk THEN 'NO' WHEN (p_partkey + j) % 3 = 0 THEN 'NO' ELSE 'YES' END AS is_nullable,
         is_pk,
         CASE WHEN is_fk THEN 't_' || CAST(p_partkey - 1 AS VARCHAR) END AS fk_table,
         CASE WHEN is_fk THEN 'id' END AS fk_column,
         CASE WHEN j = 1 AND p_partkey % 9 <> 0 AND p_partkey % 3 = 1
              THEN 'nextval(''t_' || CAST(p_partkey AS VARCHAR) || '_id_seq''::regclass)' END AS column_default,
         CASE WHEN j = 1 AND p_partkey % 9 <> 0 AND p_partkey % 3 = 2 THEN 'YES' ELSE 'NO' END AS is_identity,
         CASE WHEN j = 1 AND p_partkey % 9 <> 0 AND p_partkey % 3 IN (1, 2) THEN 'auto_increment' ELSE '' END
           AS my_extra
  FROM (
    SELECT *,
           CASE WHEN j = 1 OR is_fk THEN key_my
                ELSE {_list(MYSQL_NATIVE_TYPES)}[(p_partkey * 5 + j) % {len(MYSQL_NATIVE_TYPES)} + 1] END AS my_type
    FROM (
      SELECT p_partkey, j,
             (j = 2 AND p_partkey % 4 = 1 AND p_partkey > 0) AS is_fk,
             (j = 1 OR (j = 2 AND p_partkey % 6 = 0)) AS is_pk,
             CASE WHEN p_partkey % 9 = 0 THEN 'uuid' WHEN p_partkey % 2 = 0 THEN 'int4' ELSE 'int8' END AS key_pg,
             CASE WHEN p_partkey % 9 = 0 THEN 'varchar' WHEN p_partkey % 2 = 0 THEN 'int' ELSE 'bigint' END AS key_my
      FROM part, unnest(generate_series(1, 2 + p_size % 5)) AS g(j)
    )
  )
)"""

_F3_FULL = """'{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_custkey":' || CAST(o_custkey AS VARCHAR)
  || ',"o_orderstatus":' || __STATUS__ || ',"o_totalprice":' || __PRICE__
  || ',"o_orderpriority":"' || o_orderpriority || '"}'"""

F3 = """
f3 AS (
  SELECT 'shop' AS db, coll, op, key, doc, CAST(step AS BIGINT) AS pos_hi, key AS pos_lo, CAST(0 AS BIGINT) AS pos_seq, d.seq AS delivery,
         base_ms + step * 3600000 AS committed_ms
  FROM (
    SELECT o_orderkey AS key, (epoch_us(o_orderdate) // 1000) AS base_ms,
           CASE WHEN o_orderkey % 4 = 3 THEN 'archive' ELSE 'orders' END AS coll,
           s.step, s.op, s.doc, s.on_
    FROM orders, unnest([
      {'step': 0, 'op': 'insert', 'doc': """ + _F3_FULL.replace("__STATUS__", "'\"' || o_orderstatus || '\"'").replace("__PRICE__", "printf('%.2f', o_totalprice)") + """, 'on_': true},
      {'step': 1, 'op': 'update', 'doc': CASE
          WHEN o_orderkey % 26 = 13 THEN '{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_orderstatus":"U","o_totalprice":"n/a"}'
          WHEN o_orderkey % 2 = 0 THEN '{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_orderstatus":"U","o_totalprice":' || printf('%.2f', o_totalprice + 1.0) || '}'
          ELSE """ + _F3_FULL.replace("__STATUS__", "'\"U\"'").replace("__PRICE__", "printf('%.2f', o_totalprice + 1.0)") + """ END,
       'on_': o_orderkey % 3 = 0},
      {'step': 2, 'op': 'delete', 'doc': CAST(NULL AS VARCHAR), 'on_': o_orderkey % 7 = 0},
      {'step': 3, 'op': 'insert', 'doc': '{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_orderstatus":"R"}',
       'on_': o_orderkey % 14 = 0}
    ]) AS t(s)
  ) e, unnest(CASE WHEN step = 0 AND key % 11 = 0 THEN [0, 1] ELSE [0] END) AS d(seq)
  WHERE on_
)"""

F4 = """
f4b AS (
  SELECT user_id AS connection_id, event_id, ts, (epoch_us(ts) // 1000) AS ts_ms,
         CAST((epoch_us(ts) // 1000) >= 1705276800000 + (user_id % 24) * 3600000 AS INTEGER) AS epoch,
         CAST(event_type = 'purchase' AS BIGINT) AS d_insert,
         CAST(event_type = 'click' AS BIGINT) AS d_query,
         CAST(event_type = 'signup' AS BIGINT) AS d_update,
         CAST(event_type = 'error' AS BIGINT) AS d_delete,
         CAST(event_type = 'view' AS BIGINT) AS d_getmore,
         CAST(1 AS BIGINT) AS d_command,
         CAST(round(value * 100) AS BIGINT) AS d_bytes,
         CAST(event_type = 'error' AS BIGINT) AS d_pages_read
  FROM events
),
f4 AS (
  SELECT connection_id, event_id, ts, ts_ms,
         sum(d_insert) OVER w AS "insert", sum(d_query) OVER w AS query, sum(d_update) OVER w AS "update",
         sum(d_delete) OVER w AS "delete", sum(d_getmore) OVER w AS getmore, sum(d_command) OVER w AS command,
         sum(d_bytes) OVER w AS bytes_in, sum(d_bytes) OVER w * 3 AS bytes_out,
         sum(d_pages_read) OVER w AS pages_read, sum(d_command) OVER w AS pages_requested,
         d_bytes * 1000 AS cache_used_bytes,
         CAST(CASE WHEN connection_id % 9 = 0 THEN 0 ELSE 50000000 END AS BIGINT) AS cache_max_bytes,
         CAST((connection_id * 7 + event_id) % 200 AS BIGINT) AS connections_current,
         CAST(800 AS BIGINT) AS connections_max,
         CAST(512 + connection_id % 100 AS BIGINT) AS mem_resident_mb,
         CAST(2048 + event_id % 1000 AS BIGINT) AS mem_virtual_mb
  FROM f4b
  WINDOW w AS (PARTITION BY connection_id, epoch ORDER BY ts_ms, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

F4_REPLICA = """
f4r AS (
  SELECT user_id % 10 AS set_id, user_id AS member_id, date_trunc('hour', ts) AS sample_ts,
         CASE WHEN user_id < 10 THEN 1 WHEN user_id % 7 = 0 THEN 8 WHEN user_id % 5 = 0 THEN 7 ELSE 2 END AS state,
         max(ts) AS optime, min(CASE WHEN (user_id >= 10 AND user_id % 7 = 0) OR user_id % 25 = 0 THEN 0 ELSE 1 END) AS health
  FROM events GROUP BY 1, 2, 3, 4
)"""

F5 = """
f5 AS (
  SELECT event_id AS op_id, user_id AS connection_id, db,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE db || '.' || event_type END AS ns,
         CASE WHEN event_type = 'purchase' THEN 'insert' WHEN event_type = 'signup' THEN 'update'
              WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'view' THEN 'getmore'
              WHEN event_id % 6 = 0 THEN 'command' ELSE 'query' END AS op,
         value AS millis, ts, (epoch_us(ts) // 1000) AS ts_ms,
         '{"find":"' || event_type || '"' || CASE WHEN event_id % 4 = 0 THEN ',"query":' ELSE ',"filter":' END
           || '{"k":' || json_extract_string(props, '$.k')
           || CASE WHEN event_id % 3 = 0 THEN ',"user":' || CAST(user_id AS VARCHAR) ELSE '' END
           || CASE WHEN event_id % 5 = 0 THEN ',"$comment":"probe"' ELSE '' END || '}}' AS command,
         event_type <> 'view' AS active,
         CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE round(value * 1000) END AS BIGINT) AS microsecs_running,
         CAST(floor(value / 100) AS BIGINT) AS secs_running,
         CASE WHEN event_id % 7 <> 0 THEN 'conn' || CAST(user_id AS VARCHAR) END AS "desc",
         CASE WHEN event_id % 9 <> 0 THEN '10.0.0.' || CAST(user_id % 250 AS VARCHAR) || ':27017' END AS client,
         event_id % 31 = 0 AS waiting_for_lock,
         CASE WHEN event_id % 2 = 0 THEN 'COLLSCAN' WHEN event_id % 5 <> 0 THEN 'IXSCAN { k: 1 }' END AS plan_summary,
         CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS keys_examined,
         CAST(floor(value * 10) AS BIGINT) AS docs_examined,
         CASE WHEN event_id % 4 <> 0 THEN CAST(user_id % 100 AS BIGINT) END AS nreturned
  FROM (SELECT *, CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'db' || CAST(user_id % 10 AS VARCHAR) END AS db
        FROM events)
)"""

F6 = f"""
f6 AS (
  SELECT o_orderkey AS run_id, o_custkey AS job_id,
         {_list(RUN_KINDS)}[o_orderkey % 3 + 1] AS kind,
         CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'running' END
           AS status,
         (epoch_us(o_orderdate) // 1000) + (o_orderkey % 86400) * 1000 AS started_ms,
         CASE WHEN o_orderstatus IN ('F', 'P')
              THEN (epoch_us(o_orderdate) // 1000) + (o_orderkey % 86400) * 1000 + (CAST(floor(o_totalprice) AS BIGINT) % 7200) * 1000
         END AS ended_ms,
         CAST(round(o_totalprice * 1000) AS BIGINT) AS size_bytes,
         o_orderpriority AS label
  FROM orders
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"

F7_PG = """
f7s AS (SELECT connection_id, min(ts_ms) - 60000 AS start_ms FROM f4 GROUP BY 1),
f7pg AS (
  SELECT connection_id, event_id, ts_ms,
         CAST(floor((ts_ms - start_ms) / 1000) AS BIGINT) AS uptime_s,
         "insert" + query + "delete" AS xact, bytes_in AS blks_hit, pages_read AS blks_read,
         connections_current AS sessions_total, connections_current % 17 AS sessions_active,
         connections_current - connections_current % 17 - connections_current % 3 AS sessions_idle,
         connection_id % 4 = 1 AS is_replica, CAST(event_id % 90 AS DOUBLE) AS replica_lag_s
  FROM f4 JOIN f7s USING (connection_id)
)"""

F7_MY = """
f7w AS (
  SELECT p.connection_id, p.event_id, uptime_s AS "Uptime", sessions_total AS "Threads_connected",
         sessions_active AS "Threads_running", f4."insert" + f4.query AS "Com_commit", f4."delete" AS "Com_rollback",
         f4.command AS "Questions", f4.pages_requested * 10 AS "Innodb_buffer_pool_read_requests",
         f4.pages_read AS "Innodb_buffer_pool_reads"
  FROM f7pg p JOIN f4 USING (connection_id, event_id)
),
f7my AS (
  SELECT connection_id, event_id, variable_name, CAST(v AS VARCHAR) AS value
  FROM (UNPIVOT f7w ON "Uptime", "Threads_connected", "Threads_running", "Com_commit", "Com_rollback", "Questions",
        "Innodb_buffer_pool_read_requests", "Innodb_buffer_pool_reads" INTO NAME variable_name VALUE v)
)"""


F6_RULES = """
f6r AS (
  SELECT u.user_id * 8 + t.j AS rule_id, u.user_id AS connection_id, u.user_id % 3 AS profile_id,
         t.metric || '@conn-' || CAST(u.user_id AS VARCHAR) AS name, t.metric, t.condition, t.threshold,
         t.duration_minutes, (u.user_id + t.j) % 13 <> 0 AS enabled
  FROM (SELECT DISTINCT user_id FROM events) u, (VALUES
    (0, 'currentConnections', 'gt', 150.0::DOUBLE, 5),
    (1, 'availableConnections', 'lt', 700.0::DOUBLE, 1),
    (2, 'memResident', 'gte', 600.0::DOUBLE, 10),
    (3, 'opsPerSecTotal', 'gt', 0.0005::DOUBLE, 2),
    (4, 'replicationLag', 'gt', 30.0::DOUBLE, 3),
    (5, 'wtCachePercent', 'gt', 50.0::DOUBLE, 5),
    (6, 'networkBytesIn', 'gt', 100000.0::DOUBLE, 60),
    (7, 'memVirtual', 'lte', 2100.0::DOUBLE, 1)
  ) AS t(j, metric, condition, threshold, duration_minutes)
)"""

F3_RAW_MONGO = """
f3mongo AS (
  SELECT pos_hi * 1000000000 + key * 2 + delivery AS arrival,
         '{"operationType":"' || CASE WHEN op = 'insert' AND pos_hi = 0 AND key % 5 = 0 THEN 'replace' ELSE op END
         || '","ns":{"db":"shop","coll":"' || coll || '"},"documentKey":{"_id":' || CAST(key AS VARCHAR) || '}'
         || CASE WHEN op <> 'delete' AND NOT (op = 'update' AND key % 26 = 0) THEN ',"fullDocument":' || doc ELSE '' END
         || ',"clusterTime":{"t":' || CAST(pos_hi + 1700000000 AS VARCHAR) || ',"i":' || CAST(key AS VARCHAR) || '}}' AS raw
  FROM f3
  UNION ALL
  SELECT 9000000000 + o_orderkey * 2,
         '{"operationType":"drop","ns":{"db":"shop","coll":"orders"},"clusterTime":{"t":1700000009,"i":' || CAST(o_orderkey AS VARCHAR) || '}}'
  FROM orders WHERE o_orderkey % 50 = 0
  UNION ALL
  SELECT 9500000000 + o_orderkey * 2,
         '{"operationType":"invalidate","clusterTime":{"t":1700000010,"i":' || CAST(o_orderkey AS VARCHAR) || '}}'
  FROM orders WHERE o_orderkey % 60 = 1
)"""

F3_RAW_PG = """
f3pgl AS (
  SELECT *, hex(pos_hi) || '/' || hex(pos_lo * 16) AS lsn FROM f3
),
f3pg AS (
  SELECT pos_hi * 1000000000 + key * 4 + delivery + 1 AS arrival,
         '{"lsn":"' || lsn || '","action":"' || CASE op WHEN 'insert' THEN 'I' WHEN 'update' THEN 'U' ELSE 'D' END
         || '","schema":"public","table":"' || coll || '"'
         || CASE WHEN op = 'delete' THEN ',"identity":{"o_orderkey":' || CAST(key AS VARCHAR) || '}' ELSE ',"columns":' || doc END
         || '}' AS raw
  FROM f3pgl
  UNION ALL
  SELECT pos_hi * 1000000000 + key * 4, '{"lsn":"' || lsn || '","action":"B"}' FROM f3pgl WHERE delivery = 0 AND key % 10 = 0
  UNION ALL
  SELECT pos_hi * 1000000000 + key * 4 + 3, '{"lsn":"' || lsn || '","action":"C"}' FROM f3pgl WHERE delivery = 0 AND key % 10 = 0
  UNION ALL
  SELECT 8000000000 + key, '{"lsn":"9/' || hex(key * 16) || '","action":"T","schema":"public","table":"orders"}'
  FROM f3pgl WHERE delivery = 0 AND pos_hi = 0 AND key % 100 = 1
)"""

F3_RAW_MYSQL = """
f3myg AS (
  SELECT pos_hi, coll, CASE op WHEN 'insert' THEN 'write_rows' WHEN 'update' THEN 'update_rows' ELSE 'delete_rows' END AS type,
         CAST(floor(key / 4) AS BIGINT) AS grp,
         string_agg(CASE op WHEN 'insert' THEN doc WHEN 'update' THEN '{"before":null,"after":' || doc || '}'
                    ELSE '{"o_orderkey":' || CAST(key AS VARCHAR) || '}' END, ',' ORDER BY key) AS rows,
         min(committed_ms) AS committed_ms, max(CAST(pos_hi = 0 AND key % 11 = 0 AS INTEGER)) AS dup
  FROM f3 WHERE delivery = 0 GROUP BY 1, 2, 3, 4
),
f3my AS (
  SELECT pos_hi * 1000000000 + grp * 8 + CAST(coll = 'archive' AS INTEGER) * 4 + 1 + c.copy AS arrival,
         '{"type":"' || type || '","schema":"shop","table":"' || coll || '","position":' || CAST(grp * 100 + 4 AS VARCHAR)
         || ',"timestamp":' || CAST(CAST(floor(committed_ms / 1000) AS BIGINT) AS VARCHAR) || ',"rows":[' || rows || ']}' AS raw
  FROM f3myg, unnest(CASE WHEN dup = 1 THEN [0, 2] ELSE [0] END) AS c(copy)
  UNION ALL
  SELECT pos_hi * 1000000000, '{"type":"rotate","next_file":"binlog.' || lpad(CAST(pos_hi + 1 AS VARCHAR), 6, '0') || '","position":4}'
  FROM (SELECT DISTINCT pos_hi FROM f3 WHERE delivery = 0)
)"""
