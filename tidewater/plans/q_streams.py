"""Streaming queries (C19, A4 stream). Each drains its input with an
``availableNow`` trigger and returns the resulting table; the oracle is the
batch semantics the stream must reproduce."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import alerts as al
from tidewater.operators import cdc
from tidewater.plans import q_alerts, q_cdc
from tidewater.plans.fixture_sql import F3, F3_RAW_MONGO, F3_RAW_PG, with_ctes
from tidewater.plans.registry import query
from tidewater.session import checkpoint_dir, materialize
from tidewater.sources import fixtures as fx
from tidewater.streaming import alert_stream as ast
from tidewater.streaming import cdc_stream as cst

FILES_PER_TRIGGER = 8   # of the alert stream; a week of its log has as many files at most


def _by_bucket(df, bucket_col: str):
    """The log made once and written by bucket, so that what takes one bucket reads that bucket alone."""
    path = checkpoint_dir(df.sparkSession, "log_by_bucket")
    df.write.partitionBy(bucket_col).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_in_order(df, bucket_col: str, path: str, fmt: str) -> None:
    """Write a log in bucket order (one append per bucket), so the file
    source sees older buckets first. The bucket list is tiny (steps/weeks)."""
    log = _by_bucket(df, bucket_col)
    for b in sorted(r[0] for r in log.select(bucket_col).distinct().collect()):
        _append(log.filter(F.col(bucket_col) == b).drop(bucket_col), path, fmt)


def _append(part, path: str, fmt: str) -> None:
    getattr(part.write.mode("append"), fmt)(path)


_NORM_MONGO = """,
nm AS (
  SELECT * FROM (
    SELECT json_extract_string(raw, '$.ns.db') AS db, json_extract_string(raw, '$.ns.coll') AS coll,
           CASE WHEN t IN ('insert', 'replace') THEN 'insert' WHEN t = 'update' THEN 'update' WHEN t = 'delete' THEN 'delete' END AS op,
           CAST(json_extract(raw, '$.documentKey._id') AS BIGINT) AS key, json_extract(raw, '$.fullDocument') AS fulldoc,
           CAST(json_extract(raw, '$.clusterTime.t') AS BIGINT) AS pos_hi, CAST(json_extract(raw, '$.clusterTime.i') AS BIGINT) AS pos_lo
    FROM (SELECT *, json_extract_string(raw, '$.operationType') AS t FROM f3mongo))
  WHERE op IS NOT NULL AND coll IS NOT NULL AND (op = 'delete' OR fulldoc IS NOT NULL)
),
ev AS (SELECT db, coll, op, key, CASE WHEN op = 'delete' THEN NULL ELSE CAST(fulldoc AS VARCHAR) END AS doc, pos_hi, pos_lo
       FROM nm WHERE db = 'shop' AND coll = 'orders'),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, pos_hi, pos_lo ORDER BY op) AS rn FROM ev) WHERE rn = 1),
valid AS (SELECT *, (pos_hi - 1700000000) * 1000000000000 + pos_lo * 100 AS p FROM dd WHERE """ + q_cdc._valid_pred() + ")"


@query("cdc_stream", with_ctes(F3, F3_RAW_MONGO) + _NORM_MONGO + ",\n" + q_cdc.TARGET_SQL + "," + q_cdc._upsert_sql("tgt", "valid")
       + """
SELECT * FROM applied""")
def cdc_stream(spark, sf_dir):
    """The document change log streamed in delivery order onto the
    destination snapshot (even keys), one new target version per micro-batch."""
    return cst.read_target(spark, _drained(spark, sf_dir))


def _drained(spark, sf_dir) -> str:
    """The target of a stream that has read the whole document change log."""
    base = checkpoint_dir(spark, "cdc_stream")
    raw = fx.f3_raw_mongo(spark, sf_dir).withColumn("step", F.floor(F.col("arrival") / 1_000_000_000))
    _write_in_order(raw.select("raw", "step"), "step", f"{base}/log", "text")
    cst.init_target(spark, f"{base}/target", q_cdc.target(spark, sf_dir), q_cdc.KEY)
    cst.run_cdc_stream(spark, f"{base}/log", f"{base}/target", f"{base}/_checkpoint", q_cdc.KEY, q_cdc.COLUMNS,
                       q_cdc.ALLOWED, max_files_per_trigger=64)
    return f"{base}/target"


@query("cdc_stream_pg", with_ctes(F3, F3_RAW_PG) + """,
nm AS (
  SELECT CASE json_extract_string(raw, '$.action') WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' WHEN 'D' THEN 'delete' END AS op,
         json_extract_string(raw, '$.table') AS coll,
         CAST(coalesce(json_extract(raw, '$.columns.o_orderkey'), json_extract(raw, '$.identity.o_orderkey')) AS BIGINT) AS key,
         CAST(json_extract(raw, '$.columns') AS VARCHAR) AS doc,
         CAST('0x' || split_part(json_extract_string(raw, '$.lsn'), '/', 1) AS BIGINT) * 1000000000000
           + CAST('0x' || split_part(json_extract_string(raw, '$.lsn'), '/', 2) AS BIGINT) AS p
  FROM f3pg),
valid AS (SELECT DISTINCT op, key, doc, p FROM nm WHERE op IS NOT NULL AND coll = 'orders' AND """ + q_cdc._valid_pred() + """),
""" + q_cdc.TARGET_SQL + "," + q_cdc._upsert_sql("tgt", "valid") + """
SELECT * FROM applied""")
def cdc_stream_pg(spark, sf_dir):
    """The logical-decoding log streamed onto the destination snapshot, key changes split, redeliveries dropped."""
    base = checkpoint_dir(spark, "cdc_stream_pg")
    raw = fx.f3_raw_pg(spark, sf_dir).withColumn("step", F.floor(F.col("arrival") / 1_000_000_000))
    _write_in_order(raw.select("raw", "step"), "step", f"{base}/log", "text")
    cst.init_target(spark, f"{base}/target", q_cdc.target(spark, sf_dir), q_cdc.KEY)
    cst.run_cdc_stream(spark, f"{base}/log", f"{base}/target", f"{base}/_checkpoint", q_cdc.KEY, q_cdc.COLUMNS, [("public", "orders")],
                       max_files_per_trigger=64, normalise=lambda raw: cdc.normalise_pg(raw, q_cdc.KEY))
    return cst.read_target(spark, f"{base}/target")


@query("cdc_stream_dead_letter", with_ctes(F3, F3_RAW_MONGO) + _NORM_MONGO + """
SELECT coll, key, op, pos_hi, pos_lo, 'o_totalprice: cannot convert to double' AS error FROM dd WHERE NOT (""" + q_cdc._valid_pred() + """)""")
def cdc_stream_dead_letter(spark, sf_dir):
    """The poison events that the stream met, kept with their error."""
    return cst.dead_letters(spark, _drained(spark, sf_dir)).select("coll", "key", "op", "pos_hi", "pos_lo", "error")


@query("stream_heartbeat", with_ctes(F3, F3_RAW_MONGO) + _NORM_MONGO + """,
steps AS (SELECT step, row_number() OVER (ORDER BY step) - 1 AS batch_id FROM (SELECT DISTINCT arrival // 1000000000 AS step FROM f3mongo)),
seen AS (SELECT pos_hi - 1700000000 AS step, count(*) AS events, max(pos_lo) AS last_key FROM ev GROUP BY 1),
bad AS (SELECT pos_hi - 1700000000 AS step, count(*) AS dead FROM dd WHERE NOT (""" + q_cdc._valid_pred() + """) GROUP BY 1)
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(coalesce(events, 0) AS BIGINT) AS events, CAST(coalesce(dead, 0) AS BIGINT) AS dead,
       CASE WHEN events > 0 THEN step + 1700000000 END AS last_hi, last_key AS last_lo,
       CAST(sum(coalesce(events, 0)) OVER (ORDER BY batch_id) AS BIGINT) AS total_events
FROM steps LEFT JOIN seen USING (step) LEFT JOIN bad USING (step)""")
def stream_heartbeat(spark, sf_dir):
    """ST5: the heartbeat table of a stream that ends and starts again after
    every step of the log: a row per micro-batch, whichever run wrote it."""
    base = checkpoint_dir(spark, "stream_heartbeat")
    raw = fx.f3_raw_mongo(spark, sf_dir).withColumn("step", F.floor(F.col("arrival") / 1_000_000_000))
    log = _by_bucket(raw.select("raw", "step"), "step")
    cst.init_target(spark, f"{base}/target", q_cdc.target(spark, sf_dir), q_cdc.KEY)
    for step in sorted(r[0] for r in log.select("step").distinct().collect()):
        _append(log.filter(F.col("step") == step).select("raw"), f"{base}/log", "text")
        cst.run_cdc_stream(spark, f"{base}/log", f"{base}/target", f"{base}/_checkpoint", q_cdc.KEY, q_cdc.COLUMNS,
                           q_cdc.ALLOWED, max_files_per_trigger=1_000_000)
    beats = cst.heartbeats(spark, f"{base}/target")
    total = F.sum("events").over(Window.orderBy("batch_id"))        # one row per micro-batch
    return beats.select("batch_id", "events", "dead", F.col("last_position.pos_hi").alias("last_hi"),
                        F.col("last_position.pos_lo").alias("last_lo"), total.cast("long").alias("total_events"))


@query("stream_pause_resume", with_ctes(F3, F3_RAW_MONGO) + _NORM_MONGO + ",\n" + q_cdc.TARGET_SQL + "," + q_cdc._upsert_sql("tgt", "valid")
       + """
SELECT * FROM applied""")
def stream_pause_resume(spark, sf_dir):
    """C17: the stream runs, is paused after a micro-batch or more, and goes
    on from there; the table is that of a stream without a pause."""
    base = checkpoint_dir(spark, "stream_pause")
    raw = fx.f3_raw_mongo(spark, sf_dir).withColumn("step", F.floor(F.col("arrival") / 1_000_000_000))
    _write_in_order(raw.select("raw", "step"), "step", f"{base}/log", "text")
    cst.init_target(spark, f"{base}/target", q_cdc.target(spark, sf_dir), q_cdc.KEY)
    stream = cst.PausableStream(spark, f"{base}/log", f"{base}/target", f"{base}/_checkpoint", q_cdc.KEY, q_cdc.COLUMNS,
                                q_cdc.ALLOWED, max_files_per_trigger=16)
    stream.start()
    stream.wait_for_batch()
    stream.pause()
    stream.drain(resume=True)
    return cst.read_target(spark, f"{base}/target")


@query("alert_stream", q_alerts.EVENTS_SQL + """
SELECT rule_id, island, started_ms, fired_ms, fired_event_id, round(value, 6) AS value, resolved_ms, status FROM events""")
def alert_stream(spark, sf_dir):
    """A4 streamed: metric samples arrive week by week; a stateful operator
    over groups of rules emits firings and resolutions; the latest row per
    island is the event table (equal to ``alert_state``). A micro-batch sorts
    its samples, and may end anywhere between the files of a week: those hold
    a connection's samples of the week in one file, so no rule meets them out
    of order. Samples without a time are in no week."""
    base = checkpoint_dir(spark, "alert_stream")
    wide = al.wide_metrics(q_alerts.samples(spark, sf_dir)).withColumn("week", F.floor(F.col("ts_ms") / (7 * 86_400_000)))
    log = _by_bucket(wide.filter(F.col("week").isNotNull()), "week")
    for week in sorted(r[0] for r in log.select("week").distinct().collect()):
        part = log.filter(F.col("week") == week).repartition(FILES_PER_TRIGGER, "connection_id").coalesce(FILES_PER_TRIGGER)
        _append(al.long_metrics(part), f"{base}/metrics", "parquet")
    schema = "connection_id long, event_id long, ts_ms long, metric string, value double"
    ast.run_alert_stream(spark, f"{base}/metrics", schema, materialize(q_alerts.rules(spark, sf_dir)), f"{base}/out",
                         f"{base}/_checkpoint", max_files_per_trigger=FILES_PER_TRIGGER)
    ev = ast.final_events(spark, f"{base}/out")
    return ev.select("rule_id", "island", "started_ms", "fired_ms", "fired_event_id",
                     F.round("value", 6).alias("value"), "resolved_ms", "status")


