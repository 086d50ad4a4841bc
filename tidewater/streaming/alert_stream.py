"""A4 as a stream: the alert state machine as a stateful operator over groups
of rules (``transformWithStateInPandas``), one small record of state per rule.

Metric rows stream in (``readStream``), join the static rule table (a
stream-static equi-join on connection and metric), and each rule's samples
drive its state: island counter, clock start, open firing. Rows are sorted
by sample time inside each micro-batch; the state carries across batches.
The output is one row when an alert fires and one when it resolves; the
latest row per (rule, island) equals the batch ``alert_events``.

A call of the operator costs milliseconds and a row that enters Python
microseconds, however little they hold. So rules meet the operator in
groups, a group's samples enter it packed, and ``advance`` moves all rules
of a group at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewater.operators.alerts import condition_met

# Groups of rules. A checkpoint's state is kept by group, so the number holds as long as the checkpoint.
GROUPS = 1024
PACK_ROWS = 200_000      # samples packed at a time, at 41 bytes
ADVANCE_ROWS = 200_000   # samples that a group advances over at a time
RULE_STATE = np.dtype([("rule_id", "<i8"), ("n_false", "<i8"), ("running", "?"), ("t0_ms", "<i8"), ("t0_eid", "<i8"),
                       ("fired", "?"), ("fired_ms", "<i8"), ("fired_eid", "<i8"), ("value", "<f8")])
SAMPLE = np.dtype([("rule_id", "<i8"), ("event_id", "<i8"), ("ts_ms", "<i8"), ("value", "<f8"),
                   ("duration_minutes", "<f8"), ("cond", "?")])
STATE_SCHEMA = "rules binary"                       # RULE_STATE records
PACKED_SCHEMA = "rule_group long, samples binary"   # SAMPLE records
OUT_SCHEMA = ("rule_id long, island long, started_ms long, fired_ms long, fired_event_id long, value double, "
              "resolved_ms long, status string")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(state: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """The state machines of many rules moved over their samples, in order of
    (rule, time, event): the new RULE_STATE and the rows fired and resolved. A
    run of samples up to a false one is an island; a rule's first run goes on
    from its state."""
    rules, first = np.unique(s["rule_id"], return_index=True)
    was = np.zeros(len(rules), RULE_STATE)
    was["rule_id"] = rules
    at = np.minimum(np.searchsorted(rules, state["rule_id"]), len(rules) - 1)
    seen = rules[at] == state["rule_id"]
    was[at[seen]] = state[seen]
    ends = ~s["cond"]
    starts = np.concatenate(([True], ends[:-1]))
    starts[first] = True
    run, begin = np.cumsum(starts) - 1, np.flatnonzero(starts)
    last = np.append(begin[1:], len(s)) - 1
    of = np.searchsorted(first, begin, side="right") - 1       # each run's rule
    nth = np.arange(len(begin)) - run[first][of]
    now = was[of]
    now["n_false"] += nth
    now["running"] &= nth == 0
    now["fired"] &= nth == 0
    new = ~now["running"] & ~ends[begin]                       # the first true sample only starts the clock
    now["running"] |= new
    now["t0_ms"][new], now["t0_eid"][new] = s["ts_ms"][begin[new]], s["event_id"][begin[new]]
    due = s["cond"] & ~now["fired"][run] & (s["ts_ms"] - now["t0_ms"][run] >= s["duration_minutes"] * 60000)
    due[begin[new]] = False
    due = np.flatnonzero(due)
    fires, i = np.unique(run[due], return_index=True)
    fired = s[due[i]]
    now["fired"][fires] = True
    now["fired_ms"][fires], now["fired_eid"][fires], now["value"][fires] = fired["ts_ms"], fired["event_id"], fired["value"]
    ended = ends[last]
    resolved = np.flatnonzero(ended & now["fired"])            # auto-resolve the open firing
    out = np.concatenate((now[fires], now[resolved]))
    open_ = np.arange(len(out)) < len(fires)
    resolved_ms = np.concatenate((np.zeros(len(fires), "<i8"), s["ts_ms"][last[resolved]]))
    rows = pd.DataFrame({
        "rule_id": out["rule_id"], "island": out["n_false"], "started_ms": out["t0_ms"], "fired_ms": out["fired_ms"],
        "fired_event_id": out["fired_eid"], "value": out["value"], "resolved_ms": pd.arrays.IntegerArray(resolved_ms, open_),
        "status": np.where(open_, "firing", "resolved").astype(object)})
    final = np.append(run[first][1:], len(begin)) - 1
    now, ended = now[final], ended[final]
    now["n_false"] += ended
    now["running"] &= ~ended
    now["fired"] &= ~ended
    return np.concatenate((state[~seen], now)), rows


class AlertProcessor(StatefulProcessor):
    """State machines of a group of rules (one small record of state per rule)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alert", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        samples = np.frombuffer(b"".join(x for pdf in rows for x in pdf["samples"]), SAMPLE)
        kept = self.state.get()
        state = np.frombuffer(kept[0] if kept else b"", RULE_STATE)
        order = np.lexsort((samples["event_id"], samples["ts_ms"], samples["rule_id"]))
        for a in range(0, len(order), ADVANCE_ROWS):
            state, out = advance(state, samples[order[a:a + ADVANCE_ROWS]])
            if len(out):
                yield out
        self.state.update((state.tobytes(),))

    def close(self) -> None:
        pass


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    column = lambda c: t[c].chunk(0).to_numpy()  # noqa: E731  (an error if there are nulls)
    group = column("rule_group")
    order = np.argsort(group, kind="stable")
    s = np.empty(len(order), SAMPLE)
    for c in ("rule_id", "event_id", "ts_ms"):
        s[c] = column(c)[order]
    for c in ("value", "duration_minutes"):
        s[c] = t[c].chunk(0).to_numpy(zero_copy_only=False)[order]
    s["cond"] = t["cond"].chunk(0).fill_null(False).to_numpy(zero_copy_only=False)[order]
    groups, begin = np.unique(group[order], return_index=True)
    cells = [s[a:b].tobytes() for a, b in zip(begin, np.append(begin[1:], len(s)))]
    return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(cells, pa.binary())], ["rule_group", "samples"])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The samples of each group as SAMPLE records, so that few rows carry them."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= PACK_ROWS:
            yield _packed(held)
            held, n = [], 0
    if n:
        yield _packed(held)


def run_alert_stream(spark: SparkSession, metrics_path: str, metrics_schema: str, rules: DataFrame,
                     out_path: str, checkpoint: str, max_files_per_trigger: int = 1):
    """Drain the metric stream with ``availableNow`` into ``out_path`` (append).
    A task's rules are far fewer than its samples: they are hashed, so the
    samples need no sort. Each micro-batch reads ``rules`` again, so they
    should be a table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    m = (spark.readStream.schema(metrics_schema).option("maxFilesPerTrigger", max_files_per_trigger)
         .parquet(metrics_path))
    r = rules.filter("enabled").select("rule_id", "connection_id", "metric", "condition", "threshold",
                                       "duration_minutes")
    group = F.pmod(F.xxhash64("rule_id"), F.lit(GROUPS)).alias("rule_group")
    ev = m.join(r.hint("shuffle_hash"), ["connection_id", "metric"])
    ev = ev.select(group, "rule_id", "event_id", "ts_ms", "value", F.col("duration_minutes").cast("double"),
                   condition_met(F.col("value"), F.col("condition"), F.col("threshold")).alias("cond"))
    out = ev.mapInArrow(pack, PACKED_SCHEMA).groupBy("rule_group").transformWithStateInPandas(
        statefulProcessor=AlertProcessor(), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="None")
    q = (out.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def final_events(spark: SparkSession, out_path: str) -> DataFrame:
    """The latest state of each (rule, island): resolved wins over firing."""
    o = spark.read.schema(OUT_SCHEMA).parquet(out_path)
    last = F.max_by(F.struct("started_ms", "fired_ms", "fired_event_id", "value", "resolved_ms", "status"),
                    F.coalesce("resolved_ms", F.lit(-1)))
    return o.groupBy("rule_id", "island").agg(last.alias("e")).select("rule_id", "island", "e.*")
