"""The streamed alert state machine: rules in groups, samples in order however many files a week has (F1)."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tidewater.operators import alerts as al
from tidewater.session import checkpoint_dir
from tidewater.streaming import alert_stream as ast

SCHEMA = "connection_id long, event_id long, ts_ms long, metric string, value double"
RULES = "rule_id long, connection_id long, metric string, condition string, threshold double, duration_minutes int, enabled boolean"


def _one_by_one(samples, state):
    """The rules' samples in order of time, one at a time (lib/alertEvaluator.ts)."""
    out = []
    for rule, eid, ts, value, minutes, cond in sorted(samples, key=lambda x: (x[0], x[2], x[1])):
        s = state.setdefault(rule, {"n": 0, "t0": None, "fired": None})
        if cond:
            if s["t0"] is None:
                s["t0"] = ts
            elif s["fired"] is None and ts - s["t0"] >= minutes * 60000:
                s["fired"] = (ts, eid, value)
                out.append((rule, s["n"], s["t0"], *s["fired"], None, "firing"))
        else:
            if s["fired"] is not None:
                out.append((rule, s["n"], s["t0"], *s["fired"], ts, "resolved"))
            s.update(n=s["n"] + 1, t0=None, fired=None)
    return out


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_rules_advanced_at_once_are_rules_advanced_one_by_one(share):
    rnd = random.Random(share)
    state, kept = {}, np.zeros(0, ast.RULE_STATE)
    for batch in range(6):
        rules = rnd.sample(range(-3, 40), 25)
        samples = [(r, rnd.randrange(1000), batch * 600_000 + rnd.randrange(12) * 60_000, rnd.random(), r % 4, rnd.random() < share)
                   for r in rules for _ in range(rnd.randrange(1, 12))]
        samples = list({x[:3]: x for x in samples}.values())
        a = np.array(samples, ast.SAMPLE)
        kept, rows = ast.advance(kept, a[np.lexsort((a["event_id"], a["ts_ms"], a["rule_id"]))])
        got = [tuple(None if v is None or v != v else v for v in r) for r in rows.astype(object).where(rows.notna(), None).itertuples(index=False)]
        assert sorted(got, key=repr) == sorted(_one_by_one(samples, state), key=repr)
    assert {r["rule_id"]: r["n_false"] for r in kept} == {r: s["n"] for r, s in state.items()}
    assert {r["rule_id"] for r in kept[kept["fired"]]} == {r for r, s in state.items() if s["fired"]}


def test_many_rules_meet_the_operator_in_groups(spark, monkeypatch):
    monkeypatch.setattr(ast, "ADVANCE_ROWS", 7)
    n = 3000
    base = checkpoint_dir(spark, "alert_groups")
    rules = spark.range(n).select((F.col("id") * 5).alias("rule_id"), F.col("id").alias("connection_id"), F.lit("m").alias("metric"),
                                  F.when(F.col("id") % 7 == 0, "gt").otherwise("lte").alias("condition"), F.lit(50.0).alias("threshold"),
                                  (F.col("id") % 3).cast("int").alias("duration_minutes"), (F.col("id") % 11 != 0).alias("enabled"))
    every = None
    for part in range(3):                                   # the stream ends and goes on from its state
        m = spark.range(0, n * 5, 1, 3).select(
            (F.col("id") % n).alias("connection_id"), (F.col("id") + part * n * 5).alias("event_id"),
            ((F.floor(F.col("id") / n) + part * 5) * 60_000).alias("ts_ms"), F.lit("m").alias("metric"),
            F.pmod(F.xxhash64("id", F.lit(part)), F.lit(100)).cast("double").alias("value"))
        m.write.mode("append").parquet(f"{base}/metrics")
        every = m if every is None else every.unionByName(m)
        q = ast.run_alert_stream(spark, f"{base}/metrics", SCHEMA, rules, f"{base}/out", f"{base}/ck", max_files_per_trigger=100)
    assert 0 < q.lastProgress.stateOperators[0].numRowsTotal <= 1024
    key = lambda r: (r.rule_id, r.island)
    want = al.alert_events(al.evaluations(every, rules))
    got = ast.final_events(spark, f"{base}/out").select(*want.columns).collect()
    assert len(got) > 1000 and sorted(got, key=key) == sorted(want.collect(), key=key)


def test_conditions_that_are_unknown_count_as_false(spark):
    base = checkpoint_dir(spark, "alert_unknown")
    rules = spark.createDataFrame([(1, 1, "m", "gt", 5.0, 1, True), (2, 1, "m", "gt", 5.0, None, True)], RULES)
    values = [9.0, None, 9.0, 9.0, None]
    spark.createDataFrame([(1, i, i * 60_000, "m", v) for i, v in enumerate(values)], SCHEMA).write.parquet(f"{base}/metrics")
    ast.run_alert_stream(spark, f"{base}/metrics", SCHEMA, rules, f"{base}/out", f"{base}/ck", max_files_per_trigger=100)
    got = [tuple(r) for r in ast.final_events(spark, f"{base}/out").collect()]
    assert got == [(1, 1, 120_000, 180_000, 3, 9.0, 240_000, "resolved")]


def test_a_week_in_many_files_stays_in_order(spark, tmp_path):
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 8)
    events = [(i, t0 + dt.timedelta(minutes=7 * i) if i else None, 3 * (i % 2), rnd.choice(["view", "click", "purchase", "error", "signup"]),
               rnd.random() * 2000, "{}") for i in range(4000)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string") \
         .write.parquet(str(tmp_path / "events.parquet"))
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = E.queries()["alert_stream"](spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    timed = spark.read.parquet(str(tmp_path / "events.parquet")).filter("ts IS NOT NULL")
    timed.write.parquet(str(tmp_path / "timed/events.parquet"))
    want = E.queries()["alert_state"](spark, str(tmp_path / "timed")).select(*got[0].__fields__).collect()
    assert len(want) > 20 and {r.status for r in want} == {"firing", "resolved"}
    assert sorted(got, key=lambda r: (r.rule_id, r.island)) == sorted(want, key=lambda r: (r.rule_id, r.island))
