"""Queries for alert rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import alerts as al
from tidewater.operators import monitor as mon
from tidewater.plans.fixture_sql import F4, F6_RULES, F7_PG, with_ctes
from tidewater.plans.registry import query
from tidewater.session import materialize
from tidewater.sources import fixtures as fx
from tidewater.sources.tables import read_table

AS_OF_MS = 1706659200000  # 2024-01-31T00:00:00Z, after every event
DAY_MS = 86_400_000
_OPS = ["insert", "query", "update", "delete", "getmore", "command"]


# ---- Spark building blocks ---------------------------------------------------------------
def samples(spark, sf_dir):
    s = fx.f4_counter_samples(spark, sf_dir)
    return mon.op_rates(s, keep_all=True).withColumn("member_lags", fx.member_lags())


def metrics(spark, sf_dir):
    return al.mongo_metrics(samples(spark, sf_dir))


def rules(spark, sf_dir):
    return fx.f6_rules(spark, sf_dir)


def evals(spark, sf_dir):
    """Rule evaluations: the table the alert stages share (materialized in the
    shared checkpoint folder, so the sample/rate/metric stages run once)."""
    return materialize(al.evaluations(metrics(spark, sf_dir), rules(spark, sf_dir)))


def events(spark, sf_dir):
    return materialize(al.alert_events(evals(spark, sf_dir)))


# ---- DuckDB twins ---------------------------------------------------------------------------
_RATE_COLS = ",\n".join(
    f'CASE WHEN prev_ts IS NULL THEN 0.0 ELSE greatest(0.0, ("{c}" - "p_{c}") / greatest(1.0, (ts_ms - prev_ts) / 1000.0)) END AS r_{c}'
    for c in _OPS)
_LAGS = ", ".join(f'lag("{c}") OVER w AS "p_{c}"' for c in _OPS)

METRICS_SQL = with_ctes(F4, F6_RULES) + f""",
lagged AS (SELECT *, lag(ts_ms) OVER w AS prev_ts, {_LAGS} FROM f4
           WINDOW w AS (PARTITION BY connection_id ORDER BY ts_ms, event_id)),
rates AS (SELECT connection_id, event_id, r_insert + r_query + r_update + r_delete + r_getmore + r_command AS ops
          FROM (SELECT connection_id, event_id, {_RATE_COLS} FROM lagged)),
wide AS (
  SELECT connection_id, event_id, ts_ms,
         CAST(connections_current AS DOUBLE) AS "currentConnections",
         CAST(connections_max - connections_current AS DOUBLE) AS "availableConnections",
         CAST(mem_resident_mb AS DOUBLE) AS "memResident", CAST(mem_virtual_mb AS DOUBLE) AS "memVirtual",
         ops AS "opsPerSecTotal",
         CASE WHEN connection_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 45 AS DOUBLE) ELSE 0.0 END
         END AS "replicationLag",
         CASE WHEN cache_max_bytes > 0 THEN cache_used_bytes / cache_max_bytes * 100 END AS "wtCachePercent",
         CAST(bytes_in AS DOUBLE) AS "networkBytesIn", CAST(bytes_out AS DOUBLE) AS "networkBytesOut"
  FROM f4 JOIN rates USING (connection_id, event_id)
),
metrics AS (
  UNPIVOT wide ON "currentConnections", "availableConnections", "memResident", "memVirtual", "opsPerSecTotal",
                 "replicationLag", "wtCachePercent", "networkBytesIn", "networkBytesOut"
  INTO NAME metric VALUE value
),
evals AS (
  SELECT r.rule_id, r.connection_id, r.metric, r.condition, r.threshold, r.duration_minutes, m.event_id, m.ts_ms, m.value,
         CASE r.condition WHEN 'gt' THEN m.value > r.threshold WHEN 'lt' THEN m.value < r.threshold
              WHEN 'gte' THEN m.value >= r.threshold WHEN 'lte' THEN m.value <= r.threshold ELSE false END AS cond
  FROM metrics m JOIN f6r r ON m.connection_id = r.connection_id AND m.metric = r.metric
  WHERE r.enabled
)"""

# ``events`` is materialized because DuckDB 2.0 never ends with a LIMIT around its left join (the rows are the same).
EVENTS_SQL = METRICS_SQL + """,
g AS (SELECT *, CAST(sum(CASE WHEN cond THEN 0 ELSE 1 END) OVER (PARTITION BY rule_id ORDER BY ts_ms, event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS grp FROM evals),
t AS (SELECT *, first_value(ts_ms) OVER (PARTITION BY rule_id, grp ORDER BY ts_ms, event_id) AS t0_ts,
             first_value(event_id) OVER (PARTITION BY rule_id, grp ORDER BY ts_ms, event_id) AS t0_e
      FROM g WHERE cond),
c AS (SELECT *, row_number() OVER (PARTITION BY rule_id, grp ORDER BY ts_ms, event_id) AS rn FROM t
      WHERE (ts_ms > t0_ts OR (ts_ms = t0_ts AND event_id > t0_e)) AND ts_ms - t0_ts >= duration_minutes * 60000),
res AS (SELECT rule_id, grp - 1 AS grp, ts_ms AS resolved_ms FROM g WHERE NOT cond),
events AS MATERIALIZED (
  SELECT c.rule_id, c.grp AS island, c.t0_ts AS started_ms, c.ts_ms AS fired_ms, c.event_id AS fired_event_id,
         c.value, res.resolved_ms, CASE WHEN res.resolved_ms IS NULL THEN 'firing' ELSE 'resolved' END AS status
  FROM c LEFT JOIN res USING (rule_id, grp) WHERE c.rn = 1
)"""

NOTIFY_SQL = "WITH RECURSIVE " + EVENTS_SQL[len("WITH "):] + """,
fr AS (SELECT rule_id, island, fired_ms, row_number() OVER (PARTITION BY rule_id ORDER BY fired_ms, island) AS k FROM events),
nt AS (
  SELECT rule_id, k, island, fired_ms, true AS notified, fired_ms AS last FROM fr WHERE k = 1
  UNION ALL
  SELECT f.rule_id, f.k, f.island, f.fired_ms, (f.fired_ms - n.last) > 1800000,
         CASE WHEN (f.fired_ms - n.last) > 1800000 THEN f.fired_ms ELSE n.last END
  FROM nt n JOIN fr f ON f.rule_id = n.rule_id AND f.k = n.k + 1
)"""


def _r6(c):
    return F.round(c, 6)


@query("alert_metric", METRICS_SQL + """
SELECT connection_id, event_id, metric, round(value, 6) AS value FROM metrics""")
def alert_metric(spark, sf_dir):
    """Snapshot metrics in long form (nulls skipped); only metrics
    the engine exposes (a semi join against the fixed applicability table)."""
    m = metrics(spark, sf_dir)
    app = spark.createDataFrame([(k, e) for k, es in al.METRIC_ENGINES.items() for e in es], "metric string, engine string")
    m = m.join(F.broadcast(app.filter(F.col("engine") == "mongodb")), "metric", "left_semi")
    return m.select("connection_id", "event_id", "metric", _r6(F.col("value")).alias("value"))


@query("alert_metric_sql", with_ctes(F4, F7_PG) + """,
snap AS (
  SELECT connection_id, event_id, ts_ms, CAST(sessions_total + 1 AS DOUBLE) AS cur,
         CASE WHEN uptime_s > 0 THEN round(xact / uptime_s, 2) ELSE 0.0 END AS tps,
         CASE WHEN blks_hit + blks_read > 0 THEN round(blks_hit / (blks_hit + blks_read), 4) END AS ratio,
         is_replica, replica_lag_s
  FROM f7pg
),
w AS (
  SELECT connection_id, event_id, cur AS "currentConnections", greatest(0.0, 800.0 - cur) AS "availableConnections",
         tps + 0.0 AS "opsPerSecTotal", CASE WHEN is_replica THEN coalesce(replica_lag_s, 0.0) END AS "replicationLag",
         coalesce(ratio, 0.0) * 100 AS "wtCachePercent"
  FROM snap
)
SELECT connection_id, event_id, metric, round(value, 6) AS value
FROM (UNPIVOT w ON "currentConnections", "availableConnections", "opsPerSecTotal", "replicationLag", "wtCachePercent"
      INTO NAME metric VALUE value)""")
def alert_metric_sql(spark, sf_dir):
    """A2: SQL snapshots adapted to the alert metric shape (max connections 800)."""
    p = fx.f7_pg_stats(spark, sf_dir)
    snap = mon.pg_snapshot(p).join(p.select("connection_id", "event_id", "ts_ms"), ["connection_id", "event_id"])
    snap = snap.withColumn("qps", F.lit(None).cast("double"))
    m = al.sql_metrics(snap, F.lit(800.0))
    return m.select("connection_id", "event_id", "metric", _r6(F.col("value")).alias("value"))


@query("alert_condition", EVENTS_SQL.split(",\ng AS")[0] + """
SELECT rule_id, event_id, round(value, 6) AS value, cond FROM evals""")
def alert_condition(spark, sf_dir):
    """A3: condition per (rule, sample)."""
    return evals(spark, sf_dir).select("rule_id", "event_id", _r6(F.col("value")).alias("value"), "cond")


@query("alert_state", EVENTS_SQL + """
SELECT rule_id, island, started_ms, fired_ms, fired_event_id, round(value, 6) AS value, resolved_ms, status FROM events""")
def alert_state(spark, sf_dir):
    """Alert events as islands of condition-true samples."""
    return events(spark, sf_dir).withColumn("value", _r6(F.col("value")))


@query("alert_notify", NOTIFY_SQL + """
SELECT e.rule_id, e.island, e.fired_ms, n.notified FROM events e JOIN nt n USING (rule_id, island)""")
def alert_notify(spark, sf_dir):
    """A5: notification flags with the 30-minute cooldown."""
    return al.notify_flags(events(spark, sf_dir)).select("rule_id", "island", "fired_ms", "notified")


@query("alert_notify_dense", """
WITH RECURSIVE fired AS (SELECT user_id % 5 AS rule_id, event_id AS island, epoch_us(ts) // 1000 AS fired_ms FROM events),
fr AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY fired_ms, island) AS k FROM fired),
nt AS (
  SELECT rule_id, k, island, fired_ms, true AS notified, fired_ms AS last FROM fr WHERE k = 1
  UNION ALL
  SELECT f.rule_id, f.k, f.island, f.fired_ms, (f.fired_ms - n.last) > 1800000, CASE WHEN (f.fired_ms - n.last) > 1800000 THEN f.fired_ms ELSE n.last END
  FROM nt n JOIN fr f ON f.rule_id = n.rule_id AND f.k = n.k + 1)
SELECT rule_id, island, fired_ms, notified FROM nt""")
def alert_notify_dense(spark, sf_dir):
    """A5 on rules that fire all the time: every event of a fifth of the users is a firing of one rule, most of them
    within the cooldown of the one before."""
    fired = read_table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("rule_id"), F.col("event_id").alias("island"), fx.epoch_ms("ts").alias("fired_ms"))
    return al.notify_flags(fired).select("rule_id", "island", "fired_ms", "notified")


def _acks(ev):
    """Ack requests (keyed by event) a user issued 0-60 minutes after firing, for rules with id % 4 = 0."""
    return ev.filter(F.col("rule_id") % 4 == 0).select(
        "rule_id", "island", (F.col("fired_ms") + (F.col("rule_id") % 7) * 600000).alias("ack_ms"))


@query("alert_ack", EVENTS_SQL + """
SELECT e.rule_id, e.island,
       CASE WHEN a.ack_ms IS NOT NULL AND e.status IN ('firing', 'resolved') AND a.ack_ms >= e.fired_ms
                 AND (e.resolved_ms IS NULL OR a.ack_ms < e.resolved_ms) THEN 'acknowledged' ELSE e.status END AS status,
       CASE WHEN a.ack_ms IS NOT NULL AND a.ack_ms >= e.fired_ms AND (e.resolved_ms IS NULL OR a.ack_ms < e.resolved_ms)
            THEN NULL ELSE e.resolved_ms END AS resolved_ms
FROM events e LEFT JOIN (SELECT rule_id, island, fired_ms + (rule_id % 7) * 600000 AS ack_ms FROM events WHERE rule_id % 4 = 0) a
  USING (rule_id, island)""")
def alert_ack(spark, sf_dir):
    """An ack applies only while the event is firing; an acknowledged
    event is no longer auto-resolved."""
    ev = events(spark, sf_dir)
    j = ev.join(_acks(ev), ["rule_id", "island"], "left")
    live = (F.col("ack_ms").isNotNull() & (F.col("ack_ms") >= F.col("fired_ms"))
            & (F.col("resolved_ms").isNull() | (F.col("ack_ms") < F.col("resolved_ms"))))
    return j.select("rule_id", "island",
                    F.when(live, F.lit("acknowledged")).otherwise(F.col("status")).alias("status"),
                    F.when(live, F.lit(None).cast("long")).otherwise(F.col("resolved_ms")).alias("resolved_ms"))


@query("alert_rule_list", EVENTS_SQL + f""",
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY fired_ms DESC, island DESC) AS rn
                          FROM events) WHERE rn = 1),
c24 AS (SELECT rule_id, count(*) AS n FROM events WHERE fired_ms >= {AS_OF_MS - DAY_MS} GROUP BY rule_id)
SELECT r.rule_id, r.name, r.enabled, l.status AS last_status, l.fired_ms AS last_fired_ms,
       CAST(coalesce(c24.n, 0) AS BIGINT) AS fired_24h
FROM f6r r LEFT JOIN latest l USING (rule_id) LEFT JOIN c24 USING (rule_id)""")
def alert_rule_list(spark, sf_dir):
    """Every rule with its latest event (exact row_number = 1,
    not a sample of recent rows) and its count of firings in the last 24 h."""
    ev = events(spark, sf_dir)
    w = Window.partitionBy("rule_id").orderBy(F.col("fired_ms").desc(), F.col("island").desc())
    latest = ev.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1) \
               .select("rule_id", F.col("status").alias("last_status"), F.col("fired_ms").alias("last_fired_ms"))
    c24 = ev.filter(F.col("fired_ms") >= AS_OF_MS - DAY_MS).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return (rules(spark, sf_dir).join(latest, "rule_id", "left").join(c24, "rule_id", "left")
            .select("rule_id", "name", "enabled", "last_status", "last_fired_ms",
                    F.coalesce("n", F.lit(0)).cast("long").alias("fired_24h")))


@query("alert_feed", EVENTS_SQL + """
SELECT e.rule_id, e.island, r.name, r.connection_id, e.status, e.fired_ms
FROM events e JOIN f6r r USING (rule_id)
WHERE e.status = 'resolved'
ORDER BY e.fired_ms DESC, e.rule_id, e.island LIMIT 50""")
def alert_feed(spark, sf_dir):
    """Event feed filtered by status, newest first, min(limit or 50, 200) rows."""
    limit = min(50 or 50, 200)
    ev = events(spark, sf_dir).filter(F.col("status") == "resolved")
    j = ev.join(rules(spark, sf_dir).select("rule_id", "name", "connection_id"), "rule_id")
    return (j.select("rule_id", "island", "name", "connection_id", "status", "fired_ms")
            .orderBy(F.col("fired_ms").desc(), "rule_id", "island").limit(limit))


@query("alert_active", EVENTS_SQL + """
SELECT r.connection_id, CAST(count(*) AS BIGINT) AS active_alerts
FROM events e JOIN f6r r USING (rule_id) WHERE e.status = 'firing' AND r.enabled GROUP BY r.connection_id""")
def alert_active(spark, sf_dir):
    """Firing events of enabled rules, counted per connection."""
    ev = events(spark, sf_dir).filter(F.col("status") == "firing")
    j = ev.join(rules(spark, sf_dir).filter("enabled").select("rule_id", "connection_id"), "rule_id")
    return j.groupBy("connection_id").agg(F.count(F.lit(1)).cast("long").alias("active_alerts"))


@query("alert_duration", EVENTS_SQL + """
SELECT rule_id, island, CASE
    WHEN resolved_ms IS NULL THEN CASE WHEN status = 'firing' THEN 'ongoing' ELSE '—' END
    WHEN floor((resolved_ms - fired_ms) / 1000.0 + 0.5) < 60 THEN printf('%ds', CAST(floor((resolved_ms - fired_ms) / 1000.0 + 0.5) AS BIGINT))
    ELSE printf('%dm', CAST(floor(floor((resolved_ms - fired_ms) / 1000.0 + 0.5) / 60.0 + 0.5) AS BIGINT)) END AS duration_label
FROM events""")
def alert_duration(spark, sf_dir):
    """Event duration labels."""
    ev = events(spark, sf_dir)
    return ev.select("rule_id", "island",
                     al.duration_label(F.col("fired_ms"), F.col("resolved_ms"), F.col("status")).alias("duration_label"))


@query("alert_message", NOTIFY_SQL + f""",
msg AS (
  SELECT e.rule_id, e.island, 'Alert: ' || r.name || chr(10)
         || {" ".join(f"CASE r.metric WHEN '{k}' THEN '{v}'" for k, v in [next(iter(al.METRIC_LABELS.items()))])}
         {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in list(al.METRIC_LABELS.items())[1:])} ELSE r.metric END
         || ' ' || CASE r.condition {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in al.CONDITION_LABELS.items())} ELSE r.condition END
         || ' ' || CASE WHEN r.threshold = floor(r.threshold) THEN CAST(CAST(r.threshold AS BIGINT) AS VARCHAR)
                        ELSE rtrim(printf('%.10f', r.threshold), '0') END
         || chr(10) || 'Current value: ' || printf('%.2f', round(e.value, 2))
         || chr(10) || 'Host: conn-' || CAST(r.connection_id AS VARCHAR)
         || chr(10) || 'Time: ' || strftime(make_timestamp(e.fired_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS message
  FROM events e JOIN f6r r USING (rule_id) JOIN nt n USING (rule_id, island)
  WHERE n.notified
)
SELECT * FROM msg""")
def alert_message(spark, sf_dir):
    """Message text for every notified firing."""
    ev = al.notify_flags(events(spark, sf_dir)).filter("notified")
    j = ev.join(rules(spark, sf_dir), "rule_id")
    thr = F.when(F.col("threshold") == F.floor("threshold"), F.col("threshold").cast("long").cast("string")) \
           .otherwise(F.regexp_replace(F.format_string("%.10f", F.col("threshold")), "0+$", ""))
    msg = al.alert_message(F.col("name"), F.col("metric"), F.col("condition"), thr, F.col("value"),
                           F.concat(F.lit("conn-"), F.col("connection_id").cast("string")), F.col("fired_ms"))
    return j.select("rule_id", "island", msg.alias("message"))


def _rule_changes(r):
    """Rule-change feed derived from the rules: disable 2 days before the
    as-of time when rule_id % 6 = 0, re-enable a day later when % 12 = 0."""
    dis = r.filter(F.col("rule_id") % 6 == 0).select("rule_id", F.lit(AS_OF_MS - 2 * DAY_MS).alias("change_ms"),
                                                    F.lit("disable").alias("action"))
    en = r.filter(F.col("rule_id") % 12 == 0).select("rule_id", F.lit(AS_OF_MS - DAY_MS).alias("change_ms"),
                                                    F.lit("enable").alias("action"))
    return dis.unionByName(en)


@query("alert_pause", with_ctes(F6_RULES) + f""",
ch AS (
  SELECT rule_id, {AS_OF_MS - 2 * DAY_MS} AS change_ms, 'disable' AS action FROM f6r WHERE rule_id % 6 = 0
  UNION ALL
  SELECT rule_id, {AS_OF_MS - DAY_MS}, 'enable' FROM f6r WHERE rule_id % 12 = 0
),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY change_ms DESC) AS rn FROM ch) WHERE rn = 1)
SELECT r.rule_id, coalesce(l.action, 'none') AS last_action,
       CASE WHEN l.action = 'disable' THEN 'paused' WHEN l.action = 'enable' THEN 'ok' END AS status,
       l.action IS NOT NULL AS clock_cleared, coalesce(l.action = 'enable', false) AS last_notified_cleared
FROM f6r r LEFT JOIN last l USING (rule_id)""")
def alert_pause(spark, sf_dir):
    """Rule state after the change feed: disable -> paused and clock
    cleared; re-enable -> ok with clock and last-notified cleared."""
    r = rules(spark, sf_dir)
    w = Window.partitionBy("rule_id").orderBy(F.col("change_ms").desc())
    last = _rule_changes(r).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1)
    j = r.select("rule_id").join(last, "rule_id", "left")
    return j.select("rule_id", F.coalesce("action", F.lit("none")).alias("last_action"),
                    F.when(F.col("action") == "disable", F.lit("paused"))
                     .when(F.col("action") == "enable", F.lit("ok")).alias("status"),
                    F.col("action").isNotNull().alias("clock_cleared"),
                    F.coalesce(F.col("action") == "enable", F.lit(False)).alias("last_notified_cleared"))


@query("alert_targets", with_ctes(F6_RULES) + """
SELECT DISTINCT connection_id, profile_id FROM f6r WHERE enabled""")
def alert_targets(spark, sf_dir):
    """Distinct (connection, profile) pairs the sweep evaluates."""
    return rules(spark, sf_dir).filter("enabled").select("connection_id", "profile_id").distinct()


@query("anti_exclude", EVENTS_SQL + """
SELECT rule_id, connection_id FROM f6r r
WHERE enabled AND NOT EXISTS (SELECT 1 FROM events e WHERE e.rule_id = r.rule_id AND e.status = 'firing')""")
def anti_exclude(spark, sf_dir):
    """Scheduled (enabled) rules that are not currently firing (left anti)."""
    firing = events(spark, sf_dir).filter(F.col("status") == "firing").select("rule_id")
    return rules(spark, sf_dir).filter("enabled").join(firing, "rule_id", "left_anti").select("rule_id", "connection_id")


PAUSE_SQL = METRICS_SQL + f""",
ch AS (
  SELECT rule_id, {AS_OF_MS - 2 * DAY_MS} AS change_ms, 'disable' AS action FROM f6r WHERE rule_id % 6 = 0
  UNION ALL
  SELECT rule_id, {AS_OF_MS - DAY_MS}, 'enable' FROM f6r WHERE rule_id % 12 = 0
),
chc AS (SELECT *, sum(CASE WHEN action = 'enable' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY rule_id ORDER BY change_ms ROWS UNBOUNDED PRECEDING) AS seg FROM ch),
act AS (
  SELECT e.*, CAST(coalesce(c.seg, 0) AS BIGINT) AS seg
  FROM evals e ASOF LEFT JOIN chc c ON e.rule_id = c.rule_id AND e.ts_ms >= c.change_ms
  WHERE coalesce(c.action, 'enable') <> 'disable'
),
g AS (SELECT *, CAST(sum(CASE WHEN cond THEN 0 ELSE 1 END) OVER (PARTITION BY rule_id, seg ORDER BY ts_ms, event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS grp FROM act),
t AS (SELECT *, first_value(ts_ms) OVER (PARTITION BY rule_id, seg, grp ORDER BY ts_ms, event_id) AS t0_ts,
             first_value(event_id) OVER (PARTITION BY rule_id, seg, grp ORDER BY ts_ms, event_id) AS t0_e
      FROM g WHERE cond),
c AS (SELECT *, row_number() OVER (PARTITION BY rule_id, seg, grp ORDER BY ts_ms, event_id) AS rn FROM t
      WHERE (ts_ms > t0_ts OR (ts_ms = t0_ts AND event_id > t0_e)) AND ts_ms - t0_ts >= duration_minutes * 60000),
res AS (SELECT rule_id, seg, grp - 1 AS grp, ts_ms AS resolved_ms FROM g WHERE NOT cond),
ev1 AS (
  SELECT c.rule_id, c.seg, c.grp AS island, c.t0_ts AS started_ms, c.ts_ms AS fired_ms, c.event_id AS fired_event_id,
         c.value, res.resolved_ms
  FROM c LEFT JOIN res USING (rule_id, seg, grp) WHERE c.rn = 1
),
ev2 AS (
  SELECT *, min(resolved_ms) OVER (PARTITION BY rule_id ORDER BY seg RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM ev1
)"""


@query("alert_pause_replay", "WITH RECURSIVE " + PAUSE_SQL[len("WITH "):] + """,
fr AS (SELECT rule_id, seg, island, fired_ms,
              row_number() OVER (PARTITION BY rule_id, seg ORDER BY fired_ms, island) AS k FROM ev2),
nt AS (
  SELECT rule_id, seg, k, island, fired_ms, true AS notified, fired_ms AS last FROM fr WHERE k = 1
  UNION ALL
  SELECT f.rule_id, f.seg, f.k, f.island, f.fired_ms, (f.fired_ms - n.last) > 1800000,
         CASE WHEN (f.fired_ms - n.last) > 1800000 THEN f.fired_ms ELSE n.last END
  FROM nt n JOIN fr f ON f.rule_id = n.rule_id AND f.seg = n.seg AND f.k = n.k + 1
)
SELECT e.rule_id, e.seg, e.island, e.started_ms, e.fired_ms, e.fired_event_id, round(e.value, 6) AS value,
       coalesce(e.resolved_ms, CASE WHEN e.nxt > e.fired_ms THEN e.nxt END) AS resolved_ms,
       CASE WHEN coalesce(e.resolved_ms, CASE WHEN e.nxt > e.fired_ms THEN e.nxt END) IS NULL THEN 'firing' ELSE 'resolved' END
         AS status,
       n.notified
FROM ev2 e JOIN nt n USING (rule_id, seg, island)""")
def alert_pause_replay(spark, sf_dir):
    """A13 replayed into A4: samples taken while a rule is paused are skipped;
    re-enabling clears the clock (islands restart per enabled segment); an
    event left firing when its rule was disabled is resolved only when the
    rule later fires and resolves again. Notification cooldown chains restart
    per enabled segment."""
    ev = materialize(al.events_with_pauses(evals(spark, sf_dir), _rule_changes(rules(spark, sf_dir))))
    ev = al.notify_flags(ev, keys=("rule_id", "seg"))      # re-enabling clears the last-notified time
    return ev.select("rule_id", F.col("seg").cast("long").alias("seg"), "island", "started_ms", "fired_ms",
                     "fired_event_id", _r6(F.col("value")).alias("value"), "resolved_ms", "status", "notified")
