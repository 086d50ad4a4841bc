"""Queries for run, snapshot and job history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import history as hist
from tidewater.plans.fixture_sql import F5, F6, with_ctes
from tidewater.plans.registry import query
from tidewater.sources import fixtures as fx
from tidewater.sources.tables import read_table

# Fixed as-of instant for "now" (2002-01-01T00:00:00Z, after every run start).
AS_OF_MS = 1009843200000


@query("latest_run", with_ctes(F6) + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_ms DESC, run_id DESC) AS rn FROM f6)
WHERE rn = 1""")
def latest_run(spark, sf_dir):
    return hist.newest_per_job(fx.f6_runs(spark, sf_dir), 1)


@query("run_history", with_ctes(F6) + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_ms DESC, run_id DESC) AS rn FROM f6)
WHERE rn <= 20""")
def run_history(spark, sf_dir):
    return hist.newest_per_job(fx.f6_runs(spark, sf_dir), 20)


@query("retention_prune", with_ctes(F6) + """
SELECT * EXCLUDE (r), CASE WHEN r <= 3 THEN r END AS rn, r <= 3 AS keep FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started_ms DESC, run_id DESC) AS r
  FROM f6 WHERE status = 'succeeded')""")
def retention_prune(spark, sf_dir):
    return hist.retention_prune(fx.f6_runs(spark, sf_dir))


@query("run_elapsed", with_ctes(F6) + f"""
SELECT run_id, elapsed_s,
       CASE WHEN elapsed_s < 60 THEN printf('%ds', elapsed_s)
            WHEN elapsed_s < 3600 THEN printf('%dm %ds', CAST(floor(elapsed_s / 60) AS BIGINT), elapsed_s % 60)
            ELSE printf('%dh %dm', CAST(floor(elapsed_s / 3600) AS BIGINT), CAST(floor((elapsed_s % 3600) / 60) AS BIGINT))
       END AS duration_label
FROM (SELECT run_id, CAST(greatest(0, floor((coalesce(ended_ms, {AS_OF_MS}) - started_ms) / 1000)) AS BIGINT) AS elapsed_s
      FROM f6)""")
def run_elapsed(spark, sf_dir):
    r = fx.f6_runs(spark, sf_dir)
    e = hist.elapsed_seconds(F.col("started_ms"), F.col("ended_ms"), AS_OF_MS)
    return r.select("run_id", e.alias("elapsed_s")).withColumn("duration_label", hist.duration_label(F.col("elapsed_s")))


@query("snapshot_catalog", with_ctes(F6) + """
SELECT job_id, CAST(count(*) AS BIGINT) AS n_snapshots, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
       max(started_ms) AS newest_started_ms
FROM f6 WHERE kind = 'backup' AND status = 'succeeded' GROUP BY job_id""")
def snapshot_catalog(spark, sf_dir):
    """Successful backups only, with count and size totals per job."""
    r = fx.f6_runs(spark, sf_dir).filter((F.col("kind") == "backup") & (F.col("status") == "succeeded"))
    return r.groupBy("job_id").agg(F.count(F.lit(1)).cast("long").alias("n_snapshots"),
                                   F.sum("size_bytes").cast("long").alias("total_bytes"),
                                   F.max("started_ms").alias("newest_started_ms"))


_LABEL_SQL = with_ctes(F5, F6) + f""",
b AS (
  SELECT run_id AS item_id, size_bytes AS b, started_ms,
         least(floor(ln(CAST(size_bytes AS DOUBLE)) / ln(1024.0)), 4) AS i
  FROM f6
)
SELECT item_id,
       CASE WHEN b = 0 THEN '0 B' ELSE regexp_replace(CAST(round(b / pow(1024.0, i), 1) AS VARCHAR), '\\.0$', '') || ' '
            || ['B', 'KB', 'MB', 'GB', 'TB'][CAST(i AS INTEGER) + 1] END AS bytes_label,
       CASE WHEN {AS_OF_MS} - started_ms < 60000 THEN 'just now'
            WHEN {AS_OF_MS} - started_ms < 3600000 THEN printf('%dm ago', CAST(floor(({AS_OF_MS} - started_ms) / 60000 + 0.5) AS BIGINT))
            WHEN {AS_OF_MS} - started_ms < 86400000 THEN printf('%dh ago', CAST(floor(({AS_OF_MS} - started_ms) / 3600000 + 0.5) AS BIGINT))
            ELSE printf('%dd ago', CAST(floor(({AS_OF_MS} - started_ms) / 86400000 + 0.5) AS BIGINT)) END AS age_label,
       CASE WHEN q < 1000 THEN regexp_replace(CAST(q AS VARCHAR), '\\.0$', '') || 'ms'
            WHEN q / 1000.0 < 60 THEN printf('%.1fs', round(q / 1000.0, 1))
            WHEN q / 60000.0 < 60 THEN printf('%.1fm', round(q / 60000.0, 1))
            ELSE printf('%.1fh', round(q / 3600000.0, 1)) END AS query_time_label
FROM b JOIN (SELECT op_id, millis * 1000 AS q FROM f5) ON item_id = op_id"""


@query("label_suite", _LABEL_SQL)
def label_suite(spark, sf_dir):
    """H6: bytes, age and query-time labels as columns (one row per run with a
    matching profiled op, so every label kind is exercised)."""
    r = fx.f6_runs(spark, sf_dir).select(F.col("run_id").alias("item_id"), "size_bytes", "started_ms")
    o = fx.f5_oplog(spark, sf_dir).select(F.col("op_id").alias("item_id"), (F.col("millis") * 1000).alias("q"))
    j = r.join(o, "item_id")
    return j.select("item_id", hist.bytes_label(F.col("size_bytes")).alias("bytes_label"),
                    hist.age_label(F.col("started_ms"), AS_OF_MS).alias("age_label"),
                    hist.query_time_label(F.col("q")).alias("query_time_label"))


@query("load_peek", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 3""")
def load_peek(spark, sf_dir):
    """H7: the first 3 loaded rows in key order (a bounded top-k)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.orderBy("o_orderkey").limit(3)


def _restores(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") == 1)
    status = (F.when(F.col("l_returnflag") == "N", F.lit("queued"))
              .when(F.col("l_linestatus") == "O", F.lit("running")).otherwise(F.lit("done")))
    return li.select(F.col("l_orderkey").alias("restore_id"), F.col("l_partkey").alias("snapshot_run_id"),
                     status.alias("status"))


@query("restore_inflight", with_ctes(F6) + """
SELECT run_id, EXISTS (
  SELECT 1 FROM lineitem
  WHERE l_linenumber = 1 AND l_partkey = run_id AND (l_returnflag = 'N' OR l_linestatus = 'O')) AS in_flight
FROM f6 WHERE kind = 'backup' AND status = 'succeeded'""")
def restore_inflight(spark, sf_dir):
    """H5: a snapshot is busy when any restore for it is queued or running
    (an EXISTS evaluated as a left join against the distinct busy ids)."""
    snaps = fx.f6_runs(spark, sf_dir).filter((F.col("kind") == "backup") & (F.col("status") == "succeeded"))
    busy = (_restores(spark, sf_dir).filter(F.col("status").isin("queued", "running"))
            .select(F.col("snapshot_run_id").alias("run_id")).distinct().withColumn("in_flight", F.lit(True)))
    return snaps.select("run_id").join(busy, "run_id", "left").select(
        "run_id", F.coalesce("in_flight", F.lit(False)).alias("in_flight"))
