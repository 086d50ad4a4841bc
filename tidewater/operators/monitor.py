"""Monitoring analytics over counter samples, replica status and op logs
(W1-W3, W7-W8, M1-M16, O1-O4, G1, G9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.types import map_literal
from tidewater.functions.windows import range_lag

OP_COUNTERS = ["insert", "query", "update", "delete", "getmore", "command"]

# Replica member state code -> name.
STATE_NAMES = {0: "STARTUP", 1: "PRIMARY", 2: "SECONDARY", 3: "RECOVERING", 5: "STARTUP2",
               6: "UNKNOWN", 7: "ARBITER", 8: "DOWN", 9: "ROLLBACK", 10: "REMOVED"}

HALO_SHARE = 60       # ranges in a stretch of time: one in 60 samples is also context of the next stretch
SYSTEM_NS_PREFIXES = ("admin.", "local.", "config.")
SYSTEM_DATABASES = ("admin", "local", "config")


def op_rates(samples: DataFrame, conn: str = "connection_id", ts_ms: str = "ts_ms",
             counters: list[str] = OP_COUNTERS, fixed_interval_s: float | None = None,
             tie: str = "event_id", keep_all: bool = False) -> DataFrame:
    """W1/M1 (W2 with ``fixed_interval_s``): per-sample rate of cumulative
    counters, ``max(0, delta / max(1, seconds since previous sample))``; the
    first sample of a connection is 0. Lag is computed per range of
    (connection, time) and stitched at the ranges' edges, so neither a hot
    connection nor a dense day of it is one task."""
    d = range_lag(samples, [conn], [ts_ms, tie], [ts_ms, *counters])
    if fixed_interval_s:
        dt = F.lit(float(fixed_interval_s))
    else:
        dt = F.greatest(F.lit(1.0), (F.col(ts_ms) - F.col("prev_" + ts_ms)) / 1000.0)
    rates = [F.when(F.col("prev_" + ts_ms).isNull(), F.lit(0.0))
             .otherwise(F.greatest(F.lit(0.0), (F.col(c) - F.col("prev_" + c)) / dt)).alias(c + "_per_s")
             for c in counters]
    if keep_all:
        return d.select(*samples.columns, *rates)
    return d.select(conn, tie, ts_ms, *rates)


def rate_window(samples: DataFrame, counter: str, conn: str = "connection_id", ts_ms: str = "ts_ms",
                range_s: int = 60, tie: str = "event_id") -> DataFrame:
    """W3 ``rate(counter[range])`` at every sample: reset-aware increase
    (a drop counts the new value) between samples that both fall inside
    ``(t - range, t]``, divided by the range. No extrapolation; null when
    the window holds fewer than two samples.

    Skew-safe: the range frame runs per connection and stretch of
    ``HALO_SHARE`` ranges (an hour for a minute's rate); samples of the last
    ``range`` of a stretch are copied into the next one as frame-only context
    rows (a halo), so few samples are processed twice and a hot connection is
    spread over its stretches."""
    rng = range_s * 1000
    span = rng * HALO_SHARE
    bucket = F.floor(F.col(ts_ms) / span).cast("long")
    d = range_lag(samples, [conn], [ts_ms, tie], [counter])
    inc = (F.when(F.col("prev_" + counter).isNull(), F.lit(None))
           .when(F.col(counter) >= F.col("prev_" + counter), F.col(counter) - F.col("prev_" + counter))
           .otherwise(F.col(counter)))
    d = d.select(conn, tie, ts_ms, inc.cast("double").alias("_inc"), bucket.alias("_b"), F.lit(False).alias("_halo"))
    halo = (d.filter(F.col(ts_ms) > (F.col("_b") + 1) * F.lit(span) - rng)
            .withColumn("_b", F.col("_b") + 1).withColumn("_halo", F.lit(True)))
    u = d.unionByName(halo)
    w = Window.partitionBy(conn, "_b").orderBy(F.col(ts_ms)).rangeBetween(-(rng - 1), 0)
    first_inc = F.min_by(F.coalesce("_inc", F.lit(0.0)), F.struct(ts_ms, tie)).over(w)
    total = F.sum(F.coalesce("_inc", F.lit(0.0))).over(w)
    n = F.count(F.lit(1)).over(w)
    rate = F.when(n >= 2, (total - first_inc) / F.lit(float(range_s)))
    return (u.select(conn, tie, ts_ms, "_halo", F.round(rate, 6).alias(f"{counter}_rate"))
            .filter(~F.col("_halo")).drop("_halo"))


def cache_hit_pct(pages_read: Column, pages_requested: Column) -> Column:
    """M2: clamp((1 - read/requested) * 100, 0, 100); 100 when nothing was requested."""
    return (F.when(pages_requested > 0,
                   F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - pages_read / pages_requested) * 100)))
            .otherwise(F.lit(100.0)))


def cache_fill_pct(used: Column, max_bytes: Column) -> Column:
    """M3: used / max * 100 (0 when no maximum is configured)."""
    return F.when(max_bytes > 0, used / max_bytes * 100).otherwise(F.lit(0.0))


def fill_band(pct: Column) -> Column:
    return F.when(pct > 80, F.lit("danger")).when(pct > 60, F.lit("warn")).otherwise(F.lit("ok"))


def replica_lag(members: DataFrame, set_col: str = "set_id", ts_col: str = "sample_ts") -> DataFrame:
    """Per member lag to the primary of its set at the same
    sample, ``max(0, primary optime - member optime)`` for secondaries, 0 for
    the primary, null otherwise. The primary's optime comes from a window
    ``max(CASE PRIMARY)`` over the set, so there is no self-join."""
    w = Window.partitionBy(set_col, ts_col)
    state_name = F.coalesce(map_literal(STATE_NAMES)[F.col("state")], F.lit("UNKNOWN"))
    primary_opt = F.max(F.when(F.col("state") == 1, F.col("optime"))).over(w)
    healthy = F.col("health") == 1
    d = members.select("*", state_name.alias("state_name"), primary_opt.alias("_p"),
                       F.count_if(healthy).over(w).alias("healthy_members"),
                       F.count(F.lit(1)).over(w).alias("members"))
    secs = F.unix_micros(F.col("_p")) - F.unix_micros(F.col("optime"))
    lag = (F.when((F.col("state_name") == "SECONDARY") & F.col("_p").isNotNull() & F.col("optime").isNotNull(),
                  F.greatest(F.lit(0.0), secs / 1e6))
           .when(F.col("state_name") == "PRIMARY", F.lit(0.0)))
    band = (F.when(lag.isNull(), F.lit("none")).when(lag > 30, F.lit("danger")).when(lag > 10, F.lit("warn"))
            .otherwise(F.lit("ok")))
    return d.select(set_col, ts_col, "member_id", "state", "state_name", F.round(lag, 6).alias("lag_seconds"),
                    band.alias("lag_band"), F.col("healthy_members").cast("long").alias("healthy_members"),
                    F.col("members").cast("long").alias("members"))


def _known(ops: DataFrame, name: str, other: Column | None = None) -> Column:
    """A column that not every server reports: ``other`` (or null) where it is null or absent."""
    x = F.col(name) if name in ops.columns else F.lit(None).cast("string" if other is None else ops.select(other).schema[0].dataType)
    return x if other is None else F.coalesce(x, other)


def current_ops(ops: DataFrame, ns_contains: str | None = None, op_equals: str | None = None,
                min_ms: float = 0) -> DataFrame:
    """M6/M7: running operations minus system namespaces and idle no-ns ops;
    duration = microseconds/1000 when positive, else seconds*1000; ``type`` is
    the description if the server names none; then the
    optional user filters (each skipped when empty)."""
    ns = F.coalesce(F.col("ns"), F.lit(""))
    keep = F.lit(True)
    for prefix in SYSTEM_NS_PREFIXES:
        keep &= ~ns.startswith(prefix)
    keep &= ~((ns == "") & (F.col("op") == "none"))
    dur = F.when(F.col("microsecs_running") > 0, F.col("microsecs_running") / 1000.0) \
           .otherwise(F.col("secs_running") * 1000.0)
    d = ops.filter(keep).withColumn("duration_ms", dur).withColumn("ns", ns)
    if ns_contains:
        d = d.filter(F.lower("ns").contains(ns_contains.lower()))
    if op_equals:
        d = d.filter(F.col("op") == op_equals)
    if min_ms > 0:
        d = d.filter(F.col("duration_ms") >= min_ms)
    return d.select("op_id", "ns", "op", F.round("duration_ms", 3).alias("duration_ms"),
                    _known(ops, "type", _known(ops, "desc", F.lit("op"))).alias("type"),
                    _known(ops, "client", F.lit("")).alias("client"), _known(ops, "desc", F.lit("")).alias("desc"),
                    _known(ops, "waiting_for_lock", F.lit(False)).alias("waiting_for_lock"),
                    _known(ops, "command").alias("query"), _known(ops, "plan_summary").alias("plan_summary"))


def slow_queries(ops: DataFrame, threshold_ms: float = 100, per_db: int = 50, top: int = 100) -> DataFrame:
    """Per user database the newest ``per_db`` profiled ops with
    millis >= threshold, then the newest ``top`` overall. Both steps are
    top-k: a per-db ``row_number`` filter and a bounded TakeOrderedAndProject."""
    d = ops.filter(~F.col("db").isin(*SYSTEM_DATABASES) & (F.col("millis") >= threshold_ms))
    w = Window.partitionBy("db").orderBy(F.col("ts_ms").desc(), F.col("op_id").desc())
    d = d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_db)
    return (d.select("op_id", "db", F.coalesce("ns", F.concat("db", F.lit(".?"))).alias("ns"), "op",
                     F.col("millis").alias("duration_ms"), "ts_ms",
                     *[_known(ops, n, F.lit(0).cast("long")).alias(as_) for n, as_ in
                       (("keys_examined", "keys_examined"), ("docs_examined", "docs_examined"), ("nreturned", "docs_returned"))],
                     _known(ops, "command", F.lit("{}")).alias("query"), _known(ops, "plan_summary", F.lit("")).alias("plan_summary"))
            .orderBy(F.col("ts_ms").desc(), F.col("op_id").desc()).limit(top))


def slow_band(ms: Column) -> Column:
    """M9: > 500 ms danger, > 100 ms warn, else none."""
    return F.when(ms > 500, F.lit("danger")).when(ms > 100, F.lit("warn")).otherwise(F.lit("none"))


def filter_keys(command_json: Column) -> Column:
    """Keys of ``filter ?? query ?? q`` that do not start with '$'."""
    filt = F.coalesce(F.get_json_object(command_json, "$.filter"), F.get_json_object(command_json, "$.query"),
                      F.get_json_object(command_json, "$.q"), F.lit("{}"))
    return F.filter(F.json_object_keys(filt), lambda k: ~k.startswith("$"))


def index_suggestions(ops: DataFrame) -> DataFrame:
    """M10 extended to a ranking: how often each (collection, field) appears
    in slow-op filters, with the suggested index text."""
    target = F.coalesce(*[F.get_json_object("command", f"$.{k}") for k in ("find", "update", "delete", "aggregate")],
                        F.lit("collection"))
    d = ops.select(target.alias("collection"), F.explode(filter_keys(F.col("command"))).alias("field"))
    return (d.groupBy("collection", "field").agg(F.count(F.lit(1)).cast("long").alias("n_ops"))
            .withColumn("suggestion", F.format_string("db.%s.createIndex({ %s: 1 })", "collection", "field")))


def pg_snapshot(s: DataFrame) -> DataFrame:
    """PG snapshot metrics from stats samples."""
    io = F.col("blks_hit") + F.col("blks_read")
    return s.select(
        "connection_id", "event_id",
        (F.col("sessions_total") + 1).alias("connections_current"),
        "sessions_active", "sessions_idle",
        F.when(F.col("uptime_s") > 0, F.round(F.col("xact") / F.col("uptime_s"), 2)).otherwise(F.lit(0.0))
         .alias("tps"),
        F.when(io > 0, F.round(F.col("blks_hit") / io, 4)).alias("cache_hit_ratio"),
        "is_replica", F.when(F.col("is_replica"), F.col("replica_lag_s")).alias("replica_lag_s"))


def status_pivot(status_rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """key/value status rows -> one column per variable (explicit value
    list, so the pivot needs no extra distinct pass)."""
    return status_rows.groupBy(*keys).pivot("variable_name", names).agg(F.first("value"))


def mysql_snapshot(wide: DataFrame) -> DataFrame:
    """MySQL snapshot metrics from pivoted status variables."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    up = n("Uptime")
    bp = n("Innodb_buffer_pool_read_requests") + n("Innodb_buffer_pool_reads")
    return wide.select(
        "connection_id", "event_id",
        n("Threads_connected").cast("long").alias("connections_current"),
        n("Threads_running").cast("long").alias("connections_active"),
        F.greatest(F.lit(0.0), n("Threads_connected") - n("Threads_running")).cast("long").alias("connections_idle"),
        F.when(up > 0, F.round((n("Com_commit") + n("Com_rollback")) / up, 2)).otherwise(F.lit(0.0)).alias("tps"),
        F.when(up > 0, F.round(n("Questions") / up, 2)).otherwise(F.lit(0.0)).alias("qps"),
        F.when(bp > 0, F.round(n("Innodb_buffer_pool_read_requests") / bp, 4)).alias("cache_hit_ratio"))


def sorted_report(report: DataFrame, column: str, descending: bool = True, tie: str = "db") -> DataFrame:
    """A size report sorted by any of its columns; nulls last, ties by name. ``place`` is a row's place from 1."""
    by = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    order = [by] if column == tie else [by, F.col(tie)]
    return report.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).orderBy("place")
