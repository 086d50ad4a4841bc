"""Queries for monitoring analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import monitor as mon
from tidewater.plans.fixture_sql import F4, F4_REPLICA, F5, F7_MY, F7_PG, with_ctes
from tidewater.plans.registry import query
from tidewater.sources import fixtures as fx
from tidewater.sources.fixtures import MYSQL_STATUS_NAMES
from tidewater.sources.tables import read_table

_OPS = ["insert", "query", "update", "delete", "getmore", "command"]


def _q(c):
    return f'"{c}"'


def _rates_sql(div: str) -> str:
    cols = ",\n".join(
        f"CASE WHEN prev_ts IS NULL THEN 0.0 ELSE greatest(0.0, ({_q(c)} - {_q('p_' + c)}) / {div}) END AS {c}_per_s"
        for c in _OPS)
    lags = ", ".join(f"lag({_q(c)}) OVER w AS {_q('p_' + c)}" for c in _OPS)
    return with_ctes(F4) + f"""
SELECT connection_id, event_id, ts_ms,
{cols}
FROM (SELECT *, lag(ts_ms) OVER w AS prev_ts, {lags} FROM f4
      WINDOW w AS (PARTITION BY connection_id ORDER BY ts_ms, event_id))"""


@query("op_rates", _rates_sql("greatest(1.0, (ts_ms - prev_ts) / 1000.0)"))
def op_rates(spark, sf_dir):
    return mon.op_rates(fx.f4_counter_samples(spark, sf_dir))


@query("op_rates_fixed", _rates_sql("15.0"))
def op_rates_fixed(spark, sf_dir):
    return mon.op_rates(fx.f4_counter_samples(spark, sf_dir), fixed_interval_s=15)


@query("rate_1m", with_ctes(F4) + """,
inc AS (
  SELECT connection_id, event_id, ts_ms,
         CAST(CASE WHEN p IS NULL THEN NULL WHEN query >= p THEN query - p ELSE query END AS DOUBLE) AS inc,
         row_number() OVER (PARTITION BY connection_id ORDER BY ts_ms, event_id) AS rk
  FROM (SELECT *, lag(query) OVER (PARTITION BY connection_id ORDER BY ts_ms, event_id) AS p FROM f4)
)
SELECT connection_id, event_id, ts_ms,
       round(CASE WHEN count(*) OVER w >= 2
             THEN (sum(coalesce(inc, 0.0)) OVER w - arg_min(coalesce(inc, 0.0), rk) OVER w) / 60.0 END, 6) AS query_rate
FROM inc
WINDOW w AS (PARTITION BY connection_id ORDER BY ts_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW)""")
def rate_1m(spark, sf_dir):
    return mon.rate_window(fx.f4_counter_samples(spark, sf_dir), "query", range_s=60)


@query("cache_hit", with_ctes(F4) + """
SELECT connection_id, event_id,
       round(CASE WHEN pages_requested > 0
                  THEN greatest(0.0, least(100.0, (1 - pages_read / pages_requested) * 100)) ELSE 100.0 END, 6)
         AS cache_hit_pct
FROM f4""")
def cache_hit(spark, sf_dir):
    s = fx.f4_counter_samples(spark, sf_dir)
    return s.select("connection_id", "event_id",
                    F.round(mon.cache_hit_pct(F.col("pages_read"), F.col("pages_requested")), 6).alias("cache_hit_pct"))


@query("cache_fill", with_ctes(F4) + """
SELECT connection_id, event_id, round(pct, 6) AS cache_fill_pct,
       CASE WHEN pct > 80 THEN 'danger' WHEN pct > 60 THEN 'warn' ELSE 'ok' END AS band
FROM (SELECT *, CASE WHEN cache_max_bytes > 0 THEN cache_used_bytes / cache_max_bytes * 100 ELSE 0.0 END AS pct
      FROM f4)""")
def cache_fill(spark, sf_dir):
    s = fx.f4_counter_samples(spark, sf_dir)
    pct = mon.cache_fill_pct(F.col("cache_used_bytes"), F.col("cache_max_bytes"))
    return s.select("connection_id", "event_id", F.round(pct, 6).alias("cache_fill_pct"), mon.fill_band(pct).alias("band"))


_STATE_SQL = "CASE state " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in mon.STATE_NAMES.items()) + " ELSE 'UNKNOWN' END"


@query("replica_lag", with_ctes(F4_REPLICA) + f""",
r AS (
  SELECT *, {_STATE_SQL} AS state_name,
         max(CASE WHEN state = 1 THEN optime END) OVER (PARTITION BY set_id, sample_ts) AS p,
         count(*) FILTER (WHERE health = 1) OVER (PARTITION BY set_id, sample_ts) AS healthy_members,
         count(*) OVER (PARTITION BY set_id, sample_ts) AS members
  FROM f4r
),
l AS (
  SELECT *, CASE WHEN state_name = 'SECONDARY' AND p IS NOT NULL AND optime IS NOT NULL
                 THEN greatest(0.0, (epoch_us(p) - epoch_us(optime)) / 1e6)
                 WHEN state_name = 'PRIMARY' THEN 0.0 END AS lag
  FROM r
)
SELECT set_id, sample_ts, member_id, state, state_name, round(lag, 6) AS lag_seconds,
       CASE WHEN lag IS NULL THEN 'none' WHEN lag > 30 THEN 'danger' WHEN lag > 10 THEN 'warn' ELSE 'ok' END AS lag_band,
       CAST(healthy_members AS BIGINT) AS healthy_members, CAST(members AS BIGINT) AS members
FROM l""")
def replica_lag(spark, sf_dir):
    return mon.replica_lag(fx.f4_replica_members(spark, sf_dir))


def _ops_with_state(spark, sf_dir):
    o = fx.f5_oplog(spark, sf_dir)
    return o.withColumn("op", F.when(F.col("active"), F.col("op")).otherwise(F.lit("none")))


@query("current_ops", with_ctes(F5) + """
SELECT op_id, ns, op, round(duration_ms, 3) AS duration_ms, coalesce("desc", 'op') AS type, coalesce(client, '') AS client,
       coalesce("desc", '') AS "desc", waiting_for_lock, command AS query, plan_summary
FROM (
  SELECT * REPLACE (coalesce(ns, '') AS ns, CASE WHEN active THEN op ELSE 'none' END AS op),
         CASE WHEN microsecs_running > 0 THEN microsecs_running / 1000.0 ELSE secs_running * 1000.0 END AS duration_ms
  FROM f5)
WHERE NOT (starts_with(ns, 'admin.') OR starts_with(ns, 'local.') OR starts_with(ns, 'config.'))
  AND NOT (ns = '' AND op = 'none')
  AND contains(lower(ns), 'db1') AND duration_ms >= 100""")
def current_ops(spark, sf_dir):
    return mon.current_ops(_ops_with_state(spark, sf_dir), ns_contains="DB1", min_ms=100)


_SLOW_SQL = with_ctes(F5) + """,
s AS (
  SELECT op_id, db, coalesce(ns, db || '.?') AS ns, op, millis AS duration_ms, ts_ms, coalesce(keys_examined, 0) AS keys_examined,
         docs_examined, coalesce(nreturned, 0) AS docs_returned, command AS query, coalesce(plan_summary, '') AS plan_summary,
         row_number() OVER (PARTITION BY db ORDER BY ts_ms DESC, op_id DESC) AS rn
  FROM f5 WHERE db NOT IN ('admin', 'local', 'config') AND millis >= 100
)"""


@query("slow_queries", _SLOW_SQL + """
SELECT op_id, db, ns, op, duration_ms, ts_ms, keys_examined, docs_examined, docs_returned, query, plan_summary FROM s WHERE rn <= 50 ORDER BY ts_ms DESC, op_id DESC LIMIT 100""")
def slow_queries(spark, sf_dir):
    return mon.slow_queries(fx.f5_oplog(spark, sf_dir))


@query("slow_severity", with_ctes(F5) + """
SELECT op_id, CASE WHEN millis > 500 THEN 'danger' WHEN millis > 100 THEN 'warn' ELSE 'none' END AS severity
FROM f5 WHERE db NOT IN ('admin', 'local', 'config')""")
def slow_severity(spark, sf_dir):
    o = fx.f5_oplog(spark, sf_dir).filter(~F.col("db").isin("admin", "local", "config"))
    return o.select("op_id", mon.slow_band(F.col("millis")).alias("severity"))


@query("index_suggest", with_ctes(F5) + """
SELECT collection, field, CAST(count(*) AS BIGINT) AS n_ops,
       printf('db.%s.createIndex({ %s: 1 })', collection, field) AS suggestion
FROM (
  SELECT coalesce(json_extract_string(command, '$.find'), json_extract_string(command, '$.update'),
                  json_extract_string(command, '$.delete'), json_extract_string(command, '$.aggregate'),
                  'collection') AS collection,
         unnest(list_filter(json_keys(coalesce(json_extract(command, '$.filter'), json_extract(command, '$.query'),
                                               json_extract(command, '$.q'), '{}')),
                            lambda k: NOT starts_with(k, '$'))) AS field
  FROM f5 WHERE millis >= 100)
GROUP BY collection, field""")
def index_suggest(spark, sf_dir):
    return mon.index_suggestions(fx.f5_oplog(spark, sf_dir).filter(F.col("millis") >= 100))


@query("sql_snapshot_pg", with_ctes(F4, F7_PG) + """
SELECT connection_id, event_id, sessions_total + 1 AS connections_current, sessions_active, sessions_idle,
       CASE WHEN uptime_s > 0 THEN round(xact / uptime_s, 2) ELSE 0.0 END AS tps,
       CASE WHEN blks_hit + blks_read > 0 THEN round(blks_hit / (blks_hit + blks_read), 4) END AS cache_hit_ratio,
       is_replica, CASE WHEN is_replica THEN replica_lag_s END AS replica_lag_s
FROM f7pg""")
def sql_snapshot_pg(spark, sf_dir):
    return mon.pg_snapshot(fx.f7_pg_stats(spark, sf_dir))


_PIVOT_SQL = ", ".join(f"max(value) FILTER (WHERE variable_name = '{n}') AS \"{n}\"" for n in MYSQL_STATUS_NAMES)


@query("status_pivot", with_ctes(F4, F7_PG, F7_MY) + f"""
SELECT connection_id, event_id, {_PIVOT_SQL} FROM f7my GROUP BY connection_id, event_id""")
def status_pivot(spark, sf_dir):
    return mon.status_pivot(fx.f7_mysql_status(spark, sf_dir), ["connection_id", "event_id"], MYSQL_STATUS_NAMES)


@query("sql_snapshot_mysql", with_ctes(F4, F7_PG, F7_MY) + f""",
w AS (SELECT connection_id, event_id, {", ".join(f"coalesce(CAST(max(value) FILTER (WHERE variable_name = '{n}') AS DOUBLE), 0.0) AS {n}" for n in MYSQL_STATUS_NAMES)}
      FROM f7my GROUP BY connection_id, event_id)
SELECT connection_id, event_id, CAST(Threads_connected AS BIGINT) AS connections_current,
       CAST(Threads_running AS BIGINT) AS connections_active,
       CAST(greatest(0.0, Threads_connected - Threads_running) AS BIGINT) AS connections_idle,
       CASE WHEN Uptime > 0 THEN round((Com_commit + Com_rollback) / Uptime, 2) ELSE 0.0 END AS tps,
       CASE WHEN Uptime > 0 THEN round(Questions / Uptime, 2) ELSE 0.0 END AS qps,
       CASE WHEN Innodb_buffer_pool_read_requests + Innodb_buffer_pool_reads > 0
            THEN round(Innodb_buffer_pool_read_requests / (Innodb_buffer_pool_read_requests + Innodb_buffer_pool_reads), 4)
       END AS cache_hit_ratio
FROM w""")
def sql_snapshot_mysql(spark, sf_dir):
    wide = mon.status_pivot(fx.f7_mysql_status(spark, sf_dir), ["connection_id", "event_id"], MYSQL_STATUS_NAMES)
    return mon.mysql_snapshot(wide)


@query("session_states", """
SELECT user_id % 10 AS connection_id, date_trunc('hour', ts) AS sample_ts, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS BIGINT) AS active,
       CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS idle
FROM events GROUP BY 1, 2""")
def session_states(spark, sf_dir):
    """G1: conditional counts over activity rows (one backend per event)."""
    e = read_table(spark, sf_dir, "events")
    return (e.groupBy((F.col("user_id") % 10).alias("connection_id"), F.date_trunc("hour", "ts").alias("sample_ts"))
            .agg(F.count(F.lit(1)).cast("long").alias("total"),
                 F.count_if(F.col("event_type").isin("click", "purchase")).cast("long").alias("active"),
                 F.count_if(F.col("event_type") == "view").cast("long").alias("idle")))


# ---- O1-O4 sizes ------------------------------------------------------------------------
def _table_sizes(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_partkey")
            .agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                 F.round(F.sum(F.col("l_extendedprice") * 100)).cast("long").alias("size_bytes"))
            .select(F.concat(F.lit("t_"), F.col("l_partkey").cast("string")).alias("table_name"),
                    "n_rows", "size_bytes"))


_SIZES_SQL = """
sizes AS (
  SELECT 't_' || CAST(l_partkey AS VARCHAR) AS table_name, CAST(count(*) AS BIGINT) AS n_rows,
         CAST(round(sum(l_extendedprice * 100)) AS BIGINT) AS size_bytes
  FROM lineitem GROUP BY l_partkey
)"""


@query("top_tables", with_ctes(_SIZES_SQL) + """
SELECT table_name, n_rows, size_bytes FROM sizes ORDER BY size_bytes DESC, table_name LIMIT 10""")
def top_tables(spark, sf_dir):
    """O1: the 10 largest tables (a bounded top-k, no global sort)."""
    return _table_sizes(spark, sf_dir).orderBy(F.col("size_bytes").desc(), "table_name").limit(10)


@query("topk_gauge", """
SELECT day, table_name, size_bytes, rnk FROM (
  SELECT day, table_name, size_bytes, rank() OVER (PARTITION BY day ORDER BY size_bytes DESC) AS rnk
  FROM (SELECT date_trunc('day', l_shipdate) AS day, 't_' || CAST(l_partkey % 100 AS VARCHAR) AS table_name,
               CAST(round(sum(l_extendedprice * 100)) AS BIGINT) AS size_bytes
        FROM lineitem GROUP BY 1, 2))
WHERE rnk <= 10""")
def topk_gauge(spark, sf_dir):
    """O2 ``topk(10, size)`` per scrape: rank within each scrape time."""
    li = read_table(spark, sf_dir, "lineitem")
    g = (li.groupBy(F.date_trunc("day", "l_shipdate").alias("day"),
                    F.concat(F.lit("t_"), (F.col("l_partkey") % 100).cast("string")).alias("table_name"))
         .agg(F.round(F.sum(F.col("l_extendedprice") * 100)).cast("long").alias("size_bytes")))
    w = Window.partitionBy("day").orderBy(F.col("size_bytes").desc())
    return g.withColumn("rnk", F.rank().over(w).cast("long")).filter(F.col("rnk") <= 10)


@query("active_queries", with_ctes(F5) + """
SELECT op_id, ns, ts_ms, substring(command, 1, 500) AS query_text
FROM f5 WHERE active ORDER BY ts_ms, op_id LIMIT 25""")
def active_queries(spark, sf_dir):
    """O3: the 25 oldest active queries, query text cut to 500 characters."""
    o = fx.f5_oplog(spark, sf_dir).filter("active")
    return (o.select("op_id", "ns", "ts_ms", F.substring("command", 1, 500).alias("query_text"))
            .orderBy("ts_ms", "op_id").limit(25))


SIZE_SQL = """
SELECT n_name AS db, CAST(round(sum(l_extendedprice * 100)) AS BIGINT) AS data_size,
       CAST(round(sum(l_extendedprice * 60)) AS BIGINT) AS storage_size,
       CAST(count(DISTINCT l_partkey % 100) AS BIGINT) AS n_collections,
       CAST(rank() OVER (ORDER BY round(sum(l_extendedprice * 100)) DESC) AS BIGINT) AS size_rank
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_name"""


@query("size_report", SIZE_SQL)
def size_report(spark, sf_dir):
    """Databases by data size, largest first (rank is the sort key)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    g = (li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
         .groupBy(F.col("n_name").alias("db"))
         .agg(F.round(F.sum(F.col("l_extendedprice") * 100)).cast("long").alias("data_size"),
              F.round(F.sum(F.col("l_extendedprice") * 60)).cast("long").alias("storage_size"),
              F.count_distinct(F.col("l_partkey") % 100).cast("long").alias("n_collections")))
    return g.withColumn("size_rank", F.rank().over(Window.orderBy(F.col("data_size").desc())).cast("long"))


# ---- S21 / U1 / M15 gauges -------------------------------------------------------------
# Gauge names exported for document and SQL connections.
MONGO_GAUGES = [
    "mongodb_connections_current", "mongodb_connections_available", "mongodb_ops_insert_per_sec",
    "mongodb_ops_query_per_sec", "mongodb_ops_update_per_sec", "mongodb_ops_delete_per_sec",
    "mongodb_ops_getmore_per_sec", "mongodb_memory_resident_mb", "mongodb_memory_virtual_mb",
    "mongodb_network_bytes_in_total", "mongodb_network_bytes_out_total", "mongodb_replication_lag_seconds",
    "mongodb_wt_cache_used_bytes", "mongodb_wt_cache_max_bytes",
]
SQL_GAUGES = [
    "sqlmon_connections_current", "sqlmon_connections_max", "sqlmon_connections_active", "sqlmon_connections_idle",
    "sqlmon_transactions_per_sec", "sqlmon_queries_per_sec", "sqlmon_cache_hit_ratio", "sqlmon_uptime_seconds",
    "sqlmon_active_queries", "sqlmon_table_size_bytes", "sqlmon_table_rows", "sqlmon_replication_lag_seconds",
    "sqlmon_is_replica",
]


def gauges(spark, sf_dir):
    """Wide snapshots -> long gauge rows (connection, sample, gauge,
    label, value); both families unioned; null values are not emitted.
    Op rates use the exporter's fixed 15 s interval (W2)."""
    s = mon.op_rates(fx.f4_counter_samples(spark, sf_dir), fixed_interval_s=15, keep_all=True)
    name = F.concat(F.lit("conn-"), F.col("connection_id").cast("string"))
    lag = F.when((F.col("connection_id") % 3 == 0) & (F.col("event_id") % 2 == 0), (F.col("event_id") % 45))
    m = s.select(
        name.alias("connection_name"), "event_id", F.lit(None).cast("string").alias("label"),
        F.col("connections_current").cast("double").alias("mongodb_connections_current"),
        (F.col("connections_max") - F.col("connections_current")).cast("double").alias("mongodb_connections_available"),
        *[F.col(f"{op}_per_s").alias(f"mongodb_ops_{op}_per_sec") for op in ("insert", "query", "update", "delete", "getmore")],
        F.col("mem_resident_mb").cast("double").alias("mongodb_memory_resident_mb"),
        F.col("mem_virtual_mb").cast("double").alias("mongodb_memory_virtual_mb"),
        F.col("bytes_in").cast("double").alias("mongodb_network_bytes_in_total"),
        F.col("bytes_out").cast("double").alias("mongodb_network_bytes_out_total"),
        lag.cast("double").alias("mongodb_replication_lag_seconds"),
        F.col("cache_used_bytes").cast("double").alias("mongodb_wt_cache_used_bytes"),
        F.col("cache_max_bytes").cast("double").alias("mongodb_wt_cache_max_bytes"))
    mongo = m.unpivot(["connection_name", "event_id", "label"], MONGO_GAUGES, "gauge", "value") \
             .withColumn("label", F.when(F.col("gauge") == "mongodb_replication_lag_seconds", F.lit("member=secondary-1")))
    p = fx.f7_pg_stats(spark, sf_dir)
    snap = mon.pg_snapshot(p).join(p.select("connection_id", "event_id", "uptime_s"), ["connection_id", "event_id"])
    q = snap.select(
        name.alias("connection_name"), "event_id", F.lit(None).cast("string").alias("label"),
        F.col("connections_current").cast("double").alias("sqlmon_connections_current"),
        F.lit(800.0).alias("sqlmon_connections_max"),
        F.col("sessions_active").cast("double").alias("sqlmon_connections_active"),
        F.col("sessions_idle").cast("double").alias("sqlmon_connections_idle"),
        F.col("tps").cast("double").alias("sqlmon_transactions_per_sec"),
        F.lit(None).cast("double").alias("sqlmon_queries_per_sec"),
        F.col("cache_hit_ratio").cast("double").alias("sqlmon_cache_hit_ratio"),
        F.col("uptime_s").cast("double").alias("sqlmon_uptime_seconds"),
        F.col("sessions_active").cast("double").alias("sqlmon_active_queries"),
        F.lit(None).cast("double").alias("sqlmon_table_size_bytes"),
        F.lit(None).cast("double").alias("sqlmon_table_rows"),
        F.col("replica_lag_s").cast("double").alias("sqlmon_replication_lag_seconds"),
        F.col("is_replica").cast("double").alias("sqlmon_is_replica"))
    sql = q.unpivot(["connection_name", "event_id", "label"], SQL_GAUGES, "gauge", "value")
    tables = _table_sizes(spark, sf_dir).orderBy(F.col("size_bytes").desc(), "table_name").limit(10)
    per_table = tables.select(
        F.lit("warehouse").alias("connection_name"), F.lit(0).cast("long").alias("event_id"),
        F.concat(F.lit("schema=public,table_name="), F.col("table_name")).alias("label"),
        F.explode(F.array(
            F.struct(F.lit("sqlmon_table_size_bytes").alias("gauge"), F.col("size_bytes").cast("double").alias("value")),
            F.struct(F.lit("sqlmon_table_rows").alias("gauge"), F.col("n_rows").cast("double").alias("value")))).alias("g"))
    per_table = per_table.select("connection_name", "event_id", "label", "g.gauge", "g.value")
    return mongo.unionByName(sql).unionByName(per_table).filter(F.col("value").isNotNull())


_GAUGES_SQL = with_ctes(F4, F7_PG, _SIZES_SQL) + """,
lagged AS (SELECT *, lag(ts_ms) OVER w AS prev_ts, lag("insert") OVER w AS p_insert, lag(query) OVER w AS p_query,
                  lag("update") OVER w AS p_update, lag("delete") OVER w AS p_delete, lag(getmore) OVER w AS p_getmore
           FROM f4 WINDOW w AS (PARTITION BY connection_id ORDER BY ts_ms, event_id)),
mw AS (
  SELECT 'conn-' || CAST(connection_id AS VARCHAR) AS connection_name, event_id,
         CAST(connections_current AS DOUBLE) AS mongodb_connections_current,
         CAST(connections_max - connections_current AS DOUBLE) AS mongodb_connections_available,
         CASE WHEN prev_ts IS NULL THEN 0.0 ELSE greatest(0.0, ("insert" - p_insert) / 15.0) END AS mongodb_ops_insert_per_sec,
         CASE WHEN prev_ts IS NULL THEN 0.0 ELSE greatest(0.0, (query - p_query) / 15.0) END AS mongodb_ops_query_per_sec,
         CASE WHEN prev_ts IS NULL THEN 0.0 ELSE greatest(0.0, ("update" - p_update) / 15.0) END AS mongodb_ops_update_per_sec,
         CASE WHEN prev_ts IS NULL THEN 0.0 ELSE greatest(0.0, ("delete" - p_delete) / 15.0) END AS mongodb_ops_delete_per_sec,
         CASE WHEN prev_ts IS NULL THEN 0.0 ELSE greatest(0.0, (getmore - p_getmore) / 15.0) END AS mongodb_ops_getmore_per_sec,
         CAST(mem_resident_mb AS DOUBLE) AS mongodb_memory_resident_mb, CAST(mem_virtual_mb AS DOUBLE) AS mongodb_memory_virtual_mb,
         CAST(bytes_in AS DOUBLE) AS mongodb_network_bytes_in_total, CAST(bytes_out AS DOUBLE) AS mongodb_network_bytes_out_total,
         CASE WHEN connection_id % 3 = 0 AND event_id % 2 = 0 THEN CAST(event_id % 45 AS DOUBLE) END AS mongodb_replication_lag_seconds,
         CAST(cache_used_bytes AS DOUBLE) AS mongodb_wt_cache_used_bytes, CAST(cache_max_bytes AS DOUBLE) AS mongodb_wt_cache_max_bytes
  FROM lagged
),
sw AS (
  SELECT 'conn-' || CAST(connection_id AS VARCHAR) AS connection_name, event_id,
         CAST(sessions_total + 1 AS DOUBLE) AS sqlmon_connections_current, 800.0 AS sqlmon_connections_max,
         CAST(sessions_active AS DOUBLE) AS sqlmon_connections_active, CAST(sessions_idle AS DOUBLE) AS sqlmon_connections_idle,
         CASE WHEN uptime_s > 0 THEN round(xact / uptime_s, 2) ELSE 0.0 END AS sqlmon_transactions_per_sec,
         CAST(NULL AS DOUBLE) AS sqlmon_queries_per_sec,
         CASE WHEN blks_hit + blks_read > 0 THEN round(blks_hit / (blks_hit + blks_read), 4) END AS sqlmon_cache_hit_ratio,
         CAST(uptime_s AS DOUBLE) AS sqlmon_uptime_seconds, CAST(sessions_active AS DOUBLE) AS sqlmon_active_queries,
         CAST(NULL AS DOUBLE) AS sqlmon_table_size_bytes, CAST(NULL AS DOUBLE) AS sqlmon_table_rows,
         CASE WHEN is_replica THEN replica_lag_s END AS sqlmon_replication_lag_seconds,
         CAST(CAST(is_replica AS INTEGER) AS DOUBLE) AS sqlmon_is_replica
  FROM f7pg
),
top10 AS (SELECT * FROM sizes ORDER BY size_bytes DESC, table_name LIMIT 10),
g AS (
  SELECT connection_name, event_id,
         CASE WHEN gauge = 'mongodb_replication_lag_seconds' THEN 'member=secondary-1' END AS label, gauge, value
  FROM (UNPIVOT mw ON COLUMNS(* EXCLUDE (connection_name, event_id)) INTO NAME gauge VALUE value)
  UNION ALL
  SELECT connection_name, event_id, CAST(NULL AS VARCHAR), gauge, value
  FROM (UNPIVOT sw ON COLUMNS(* EXCLUDE (connection_name, event_id)) INTO NAME gauge VALUE value)
  UNION ALL
  SELECT 'warehouse', CAST(0 AS BIGINT), 'schema=public,table_name=' || table_name, 'sqlmon_table_size_bytes',
         CAST(size_bytes AS DOUBLE) FROM top10
  UNION ALL
  SELECT 'warehouse', CAST(0 AS BIGINT), 'schema=public,table_name=' || table_name, 'sqlmon_table_rows',
         CAST(n_rows AS DOUBLE) FROM top10
)"""


@query("gauge_long", _GAUGES_SQL + "SELECT * FROM g WHERE value IS NOT NULL")
def gauge_long(spark, sf_dir):
    """The 14 document and 13 SQL gauges in long form, nulls not emitted."""
    return gauges(spark, sf_dir)


@query("gauge_select", _GAUGES_SQL + """
SELECT connection_name, event_id, round(value * 100, 4) AS hit_pct FROM g
WHERE gauge = 'sqlmon_cache_hit_ratio' AND value IS NOT NULL AND regexp_full_match(connection_name, 'conn-1.*')""")
def gauge_select(spark, sf_dir):
    """Hit % panel = ratio * 100 for connections whose name matches an anchored regex."""
    g = gauges(spark, sf_dir)
    return (g.filter((F.col("gauge") == "sqlmon_cache_hit_ratio") & F.col("connection_name").rlike("^(conn-1.*)$"))
            .select("connection_name", "event_id", F.round(F.col("value") * 100, 4).alias("hit_pct")))


@query("collection_sizes", """
SELECT db, coll, data_size, CAST(rank() OVER (PARTITION BY db ORDER BY data_size DESC) AS BIGINT) AS size_rank
FROM (SELECT n_name AS db, 'c' || CAST(l_partkey % 100 AS VARCHAR) AS coll,
             CAST(round(sum(l_extendedprice * 100)) AS BIGINT) AS data_size
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      WHERE l_partkey % 100 < 95
      GROUP BY 1, 2)""")
def collection_sizes(spark, sf_dir):
    """Collections of each database by size, largest first; views
    (collection ids 95-99 here) are excluded. The rank is per database."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice") \
        .filter(F.col("l_partkey") % 100 < 95)
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    g = (li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
         .groupBy(F.col("n_name").alias("db"), F.concat(F.lit("c"), (F.col("l_partkey") % 100).cast("string")).alias("coll"))
         .agg(F.round(F.sum(F.col("l_extendedprice") * 100)).cast("long").alias("data_size")))
    return g.withColumn("size_rank", F.rank().over(Window.partitionBy("db").orderBy(F.col("data_size").desc())).cast("long"))
