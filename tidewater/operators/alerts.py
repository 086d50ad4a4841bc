"""Alert rules over monitor snapshots.

The per-rule state machine (A4) is rebuilt as gaps-and-islands with
aggregations and joins only: a bucketed running count of false samples
numbers the islands, then per-island aggregates find the start, the firing
sample and the resolving sample. No step needs a rule's whole history in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.types import map_literal
from tidewater.functions.windows import DAY_MS, day_bucket, split_cumsum, split_ffill, split_lag
from tidewater.operators.monitor import OP_COUNTERS
from tidewater.session import materialize

NOTIFY_COOLDOWN_MS = 30 * 60 * 1000

METRICS = ["currentConnections", "availableConnections", "memResident", "memVirtual", "opsPerSecTotal",
           "replicationLag", "wtCachePercent", "networkBytesIn", "networkBytesOut"]

# Metric and condition labels used in alert messages.
METRIC_LABELS = {
    "currentConnections": "Current Connections",
    "availableConnections": "Available Connections",
    "memResident": "Resident Memory (MB)",
    "memVirtual": "Virtual Memory (MB)",
    "opsPerSecTotal": "Operations/sec",
    "replicationLag": "Replication Lag (s)",
    "wtCachePercent": "WiredTiger Cache (%)",
    "networkBytesIn": "Network In (bytes/s)",
    "networkBytesOut": "Network Out (bytes/s)",
}
CONDITION_LABELS = {"gt": "exceeded", "lt": "dropped below", "gte": "reached", "lte": "fell to"}

# Which engines expose which alert metric.
METRIC_ENGINES = {
    "currentConnections": ["mongodb", "postgres", "mysql"],
    "availableConnections": ["mongodb", "postgres", "mysql"],
    "memResident": ["mongodb"],
    "memVirtual": ["mongodb"],
    "opsPerSecTotal": ["mongodb", "postgres", "mysql"],
    "replicationLag": ["mongodb", "postgres", "mysql"],
    "wtCachePercent": ["mongodb", "postgres", "mysql"],
    "networkBytesIn": ["mongodb"],
    "networkBytesOut": ["mongodb"],
}


def condition_met(value: Column, condition: Column, threshold: Column) -> Column:
    """A3: gt / lt / gte / lte; an unknown condition is false."""
    return (F.when(condition == "gt", value > threshold).when(condition == "lt", value < threshold)
            .when(condition == "gte", value >= threshold).when(condition == "lte", value <= threshold)
            .otherwise(F.lit(False)))


def wide_metrics(samples_with_rates: DataFrame) -> DataFrame:
    """The nine snapshot metrics, a column each (connection_id,
    event_id, ts_ms, METRICS); input: samples with their op rates
    (``op_rates(..., keep_all=True)``, one pass, no self-join). Replication lag is the max of the members'
    known lags (``member_lags``), 0 when none is known, null without a replica set."""
    s = samples_with_rates
    repl = F.when(F.col("member_lags").isNotNull(), F.coalesce(F.array_max("member_lags"), F.lit(0.0)))
    return s.select(
        "connection_id", "event_id", "ts_ms",
        F.col("connections_current").cast("double").alias("currentConnections"),
        (F.col("connections_max") - F.col("connections_current")).cast("double").alias("availableConnections"),
        F.col("mem_resident_mb").cast("double").alias("memResident"),
        F.col("mem_virtual_mb").cast("double").alias("memVirtual"),
        sum([F.col(c + "_per_s") for c in OP_COUNTERS]).alias("opsPerSecTotal"),
        repl.alias("replicationLag"),
        F.when(F.col("cache_max_bytes") > 0, F.col("cache_used_bytes") / F.col("cache_max_bytes") * 100)
         .alias("wtCachePercent"),
        F.col("bytes_in").cast("double").alias("networkBytesIn"),
        F.col("bytes_out").cast("double").alias("networkBytesOut"))


def long_metrics(wide: DataFrame) -> DataFrame:
    """A1: ``wide_metrics`` in long form (connection_id, event_id, ts_ms,
    metric, value); null values are dropped (the rule is skipped for that sample)."""
    return (wide.unpivot(["connection_id", "event_id", "ts_ms"], METRICS, "metric", "value")
            .filter(F.col("value").isNotNull()))


def mongo_metrics(samples_with_rates: DataFrame) -> DataFrame:
    """The nine snapshot metrics of the samples in long form."""
    return long_metrics(wide_metrics(samples_with_rates))


def sql_metrics(snap: DataFrame, max_connections: Column) -> DataFrame:
    """A2: a SQL snapshot in the same long shape. available = max(0, max -
    current) (0 when max unknown), ops = qps + tps, cache = ratio * 100;
    memory and network metrics are not available (null, so skipped)."""
    wide = snap.select(
        "connection_id", "event_id", "ts_ms",
        F.col("connections_current").cast("double").alias("currentConnections"),
        F.when(max_connections.isNotNull(),
               F.greatest(F.lit(0.0), max_connections - F.col("connections_current"))).otherwise(F.lit(0.0))
         .alias("availableConnections"),
        (F.coalesce("tps", F.lit(0.0)) + F.coalesce("qps", F.lit(0.0))).alias("opsPerSecTotal"),
        F.when(F.col("is_replica"), F.coalesce("replica_lag_s", F.lit(0.0))).alias("replicationLag"),
        (F.coalesce("cache_hit_ratio", F.lit(0.0)) * 100).alias("wtCachePercent"))
    metrics = ["currentConnections", "availableConnections", "opsPerSecTotal", "replicationLag", "wtCachePercent"]
    return (wide.unpivot(["connection_id", "event_id", "ts_ms"], metrics, "metric", "value")
            .filter(F.col("value").isNotNull()))


def feed(events: DataFrame, rules: DataFrame, connections: DataFrame | None = None, status: str | None = None, limit: int | None = 50) -> DataFrame:
    """Events with their rule, newest first: of the connections named (one column ``connection_id``) and of a status,
    either left out at will; min(limit or 50, 200) rows."""
    ev = events if status is None else events.filter(F.col("status") == status)
    r = rules.select("rule_id", "name", "metric", "connection_id")
    if connections is not None:
        r = r.join(connections.select("connection_id").distinct(), "connection_id", "left_semi")
    rows = ev.join(r, "rule_id").select("rule_id", "island", "name", "metric", "connection_id", "status", "fired_ms")
    return rows.orderBy(F.col("fired_ms").desc(), "rule_id", "island").limit(min(limit or 50, 200))


def evaluations(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """A1+A3+A14: every enabled rule against every sample of its connection,
    as an equi-join on (connection, metric) — rules never cross connections."""
    r = rules.filter("enabled")
    e = metrics.join(r, ["connection_id", "metric"])
    return e.select("rule_id", "connection_id", "metric", "condition", "threshold", "duration_minutes",
                    "event_id", "ts_ms", "value",
                    condition_met(F.col("value"), F.col("condition"), F.col("threshold")).alias("cond"))


def alert_events(evals: DataFrame, keys: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """A4 + A6: one event per island of condition-true samples that lasted
    long enough. The first true sample only starts the clock; the event
    fires at the first later sample with ``(t - t0) >= duration minutes``;
    the next false sample resolves it (status stays ``firing`` otherwise).
    ``keys`` are the state-machine keys (a rule, or a rule's enabled segment)."""
    order = ["ts_ms", "event_id"]
    k = list(keys)
    d = split_cumsum(evals, k, order, day_bucket(F.col("ts_ms")),
                     F.when(F.col("cond"), F.lit(0)).otherwise(F.lit(1)), "grp")
    true_s = d.filter("cond")
    isl = true_s.groupBy(*k, "grp").agg(F.min(F.struct(*order)).alias("t0"))
    cand = (true_s.join(isl, [*k, "grp"])
            .filter((F.struct(*order) > F.col("t0"))
                    & (F.col("ts_ms") - F.col("t0.ts_ms") >= F.col("duration_minutes") * 60000)))
    fired = cand.groupBy(*k, "grp").agg(
        F.min(F.struct("ts_ms", "event_id", "value", F.col("t0.ts_ms").alias("t0_ms"))).alias("f"))
    resolve = (d.filter(~F.col("cond"))
               .select(*k, (F.col("grp") - 1).alias("grp"), F.col("ts_ms").alias("resolved_ms")))
    ev = fired.join(resolve, [*k, "grp"], "left")
    return ev.select(
        *k, F.col("grp").cast("long").alias("island"), F.col("f.t0_ms").alias("started_ms"),
        F.col("f.ts_ms").alias("fired_ms"), F.col("f.event_id").alias("fired_event_id"),
        F.col("f.value").alias("value"), "resolved_ms",
        F.when(F.col("resolved_ms").isNull(), F.lit("firing")).otherwise(F.lit("resolved")).alias("status"))


def with_rule_changes(evals: DataFrame, changes: DataFrame) -> DataFrame:
    """A13 replayed into evaluation: drop samples taken while the rule is
    paused (latest change before the sample is a disable) and number the
    enabled segments (re-enables so far). The re-enables are counted over the
    changes alone; state and count reach the samples by one keyed forward
    fill over the union of samples and changes, bucketed by day (no
    whole-rule window). Rules without a change have nothing to fill. Samples
    without a time are in no segment."""
    segment = lambda count: F.when(F.col("ts_ms").isNotNull(), count).cast("long").alias("seg")
    changes = changes.select("rule_id", F.col("change_ms").alias("ts_ms"), F.col("action").alias("_act"))
    changes = split_cumsum(changes, ["rule_id"], ["ts_ms"], day_bucket(F.col("ts_ms")), F.when(F.col("_act") == "enable", 1).otherwise(0), "_seg")
    changed = changes.select("rule_id").distinct()
    e = evals.join(changed, "rule_id", "left_semi").select("*", (F.col("ts_ms") * 2 + 1).alias("_o"))
    c = changes.select("rule_id", "ts_ms", (F.col("ts_ms") * 2).alias("_o"), F.struct("_act", "_seg").alias("_change"))
    u = split_ffill(e.unionByName(c, allowMissingColumns=True), "_o", day_bucket(F.col("ts_ms")), "_change", "_state", keys=["rule_id"])
    on = u.filter(F.col("_change").isNull() & (F.coalesce(F.col("_state._act"), F.lit("enable")) != "disable"))
    on = on.select(*evals.columns, segment(F.coalesce("_state._seg", F.lit(0))))
    still = evals.join(changed, "rule_id", "left_anti").select(*evals.columns, segment(F.lit(0)))
    return on.unionByName(still)


def events_with_pauses(evals: DataFrame, changes: DataFrame) -> DataFrame:
    """A4 + A6 + A13: islands per enabled segment; an event left open when
    its rule was disabled stays ``firing`` until the rule later fires and
    resolves again (auto-resolve closes every open event of the rule then).
    The samples are written once: the islands read them several times."""
    ev = alert_events(materialize(with_rule_changes(evals, changes)), keys=("rule_id", "seg"))
    from pyspark.sql import Window
    later = Window.partitionBy("rule_id").orderBy("seg").rangeBetween(1, Window.unboundedFollowing)
    nxt = F.min("resolved_ms").over(later)
    resolved = F.coalesce(F.col("resolved_ms"), F.when(nxt > F.col("fired_ms"), nxt))
    return (ev.withColumn("resolved_ms", resolved)
            .withColumn("status", F.when(F.col("resolved_ms").isNull(), F.lit("firing")).otherwise(F.lit("resolved"))))


def notify_flags(events: DataFrame, cooldown_ms: int = NOTIFY_COOLDOWN_MS,
                 keys: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """A5: notify a firing when the rule was never notified or the last
    *notified* firing is more than the cooldown ago (strictly).

    After a notified firing the next one is the first firing more than the
    cooldown later: a pointer from each firing to another, found by one
    backward fill over firings and the ends of their cooldowns. A firing
    whose previous one is that far away is notified in any case; the others
    that are, are those the pointers lead to from there. They are found by
    doubling: round j joins pointers of 2^j steps with themselves, and the
    marks then follow them from the longest down. So the rounds are the
    logarithm of the longest chain, every join is on (rule, time) and spread
    evenly, and no task holds a rule's firings, however long a rule keeps
    firing at short gaps.
    ``keys``: the notification state (a rule, or a rule's enabled segment,
    since re-enabling a rule clears its last-notified time)."""
    k = list(keys)
    firsts = materialize(events.groupBy(*k, F.col("fired_ms").alias("t")).agg(F.min("island").alias("first_island")))
    gaps = split_lag(firsts.select(*k, "t"), k, ["t"], day_bucket(F.col("t")), ["t"])
    seeds = materialize(gaps.filter(F.col("prev_t").isNull() | (F.col("t") - F.col("prev_t") > cooldown_ms)).select(*k, "t"))
    # latest first; a firing at the very end of a cooldown comes after that end, so it isn't seen from it
    ends = firsts.select(*k, (-(F.col("t") + cooldown_ms) * 2 - 1).alias("o"), F.lit(None).cast("long").alias("at"), F.col("t").alias("a"))
    seen = firsts.select(*k, (-F.col("t") * 2).alias("o"), F.col("t").alias("at"), F.lit(None).cast("long").alias("a"))
    follow = split_ffill(seen.unionByName(ends), "o", F.floor(F.col("o") / (2 * DAY_MS)), "at", "b", keys=k)
    follow = follow.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(*k, "a", "b")
    step = materialize(follow.join(seeds.withColumnRenamed("t", "b"), [*k, "b"], "left_anti").select(*k, "a", "b"))
    steps = []
    while not step.isEmpty():
        steps.append(step)
        further = step.select(*k, F.col("a").alias("b"), F.col("b").alias("c"))
        step = materialize(step.join(further, [*k, "b"]).select(*k, "a", F.col("c").alias("b")))
    marked = seeds
    for step in reversed(steps):
        reached = marked.withColumnRenamed("t", "a").join(step, [*k, "a"]).select(*k, F.col("b").alias("t"))
        marked = marked.unionByName(reached)
        marked = materialize(marked) if len(steps) > 4 else marked
    marked = marked.withColumn("_marked", F.lit(True))
    flags = firsts.join(marked, [*k, "t"], "left").withColumnRenamed("t", "fired_ms")
    notified = F.col("_marked").isNotNull() & (F.col("island") == F.col("first_island"))
    return events.join(flags, [*k, "fired_ms"]).withColumn("notified", notified).drop("_marked", "first_island")


def duration_label(fired_ms: Column, resolved_ms: Column, status: Column) -> Column:
    """A11: 'ongoing' for an open firing, '—' for other open events, '<n>s'
    under a minute, else rounded minutes."""
    sec = F.floor((resolved_ms - fired_ms) / 1000.0 + 0.5)
    return (F.when(resolved_ms.isNull(), F.when(status == "firing", F.lit("ongoing")).otherwise(F.lit("—")))
            .when(sec < 60, F.format_string("%ds", sec.cast("long")))
            .otherwise(F.format_string("%dm", F.floor(sec / 60.0 + 0.5).cast("long"))))


def alert_message(name: Column, metric: Column, condition: Column, threshold: Column, value: Column,
                  host: Column, fired_ms: Column) -> Column:
    """Notification text; value with two decimals."""
    mlabel = F.coalesce(map_literal(METRIC_LABELS)[metric], metric)
    clabel = F.coalesce(map_literal(CONDITION_LABELS)[condition], condition)
    ts = F.date_format(F.timestamp_millis(fired_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(F.lit("Alert: "), name, F.lit("\n"), mlabel, F.lit(" "), clabel, F.lit(" "),
                    threshold.cast("string"), F.lit("\nCurrent value: "), F.format_string("%.2f", value),
                    F.lit("\nHost: "), host, F.lit("\nTime: "), ts)
