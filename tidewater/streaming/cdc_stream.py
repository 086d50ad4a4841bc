"""Continuous CDC apply with Structured Streaming.

``readStream`` (change-log text files of any of the three engines) -> normalise
-> namespace filter -> validate -> ``foreachBatch``: the micro-batch's changes,
one row per key with the latest carrier of each column, are written as one
change table beside the target, so a micro-batch costs what its events cost,
whatever the size of the target. Every ``COMPACT_EVERY`` micro-batches the change
tables are merged into a new version of the whole target; readers merge the
latest version with the change tables after it.
A version keeps, per key, a tombstone flag and the position of the last event
and of the last carrier of every column, so a redelivered event changes
nothing and a late one only what no later event has set. Poison events go to
``<target>_dead_letter``. With columns db and coll a target holds several
namespaces.
The stream checkpoint is the resume cursor (C12); a version or change table is
published by a ``_SUCCESS``-style marker only after its files are complete.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import cdc
from tidewater.streaming import progress as beats

#: Micro-batches between two versions of the whole target.
COMPACT_EVERY = 32
HIDDEN = ("_col_pos", "_pos", "_deleted")


def _versions(spark: SparkSession, target: str, kind: str = "v") -> list[int]:
    """The numbers of the published versions (``v``: the next micro-batch) or change tables (``d``: their micro-batch)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_COMMITTED")):
            out.append(int(name[2:]))
    return sorted(out)


def _mark(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path, "_COMMITTED")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()


def current_state(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame | None:
    """The latest version with the changes after it (of micro-batches to ``upto``), tombstones and positions included."""
    vs = [v for v in _versions(spark, target) if upto is None or v <= upto]
    if not vs:
        return None
    state = spark.read.parquet(f"{target}/v={vs[-1]:012d}")
    late = [f"{target}/d={d:012d}" for d in _versions(spark, target, "d") if d >= vs[-1] and (upto is None or d <= upto)]
    if not late:
        return state
    return _merged(state, _latest(spark.read.option("mergeSchema", True).parquet(*late), state))


def _latest(changes: DataFrame, state: DataFrame) -> DataFrame:
    """One row per key of the rows of several change tables: the latest carrier of each column and the last operation."""
    ns = [c for c in ("db", "coll") if c in state.columns]
    carriers = [F.max_by(c, F.col(c)["p"]).alias(c) for c in changes.columns if c.endswith("__s")]
    return changes.groupBy(*ns, "key").agg(F.max_by("_last_op", "_last").alias("_last_op"), F.max("_last").alias("_last"), *carriers)


def _merged(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Each column takes the value of the later position, the state's or the changes', so redelivered and late events
    give the same table as the batch apply in any order of arrival."""
    ns = [c for c in ("db", "coll") if c in state.columns]
    cols = state.schema["_col_pos"].dataType.names
    key = next(c for c in state.columns if c not in (*ns, *cols, *HIDDEN))
    old = state.select(*ns, F.col(key).alias("key"), *[F.col(c).alias(c + "__t") for c in cols],
                       "_col_pos", F.col("_pos").alias("_old"), F.col("_deleted").alias("_was_deleted"))
    m = old.join(changes, [*ns, "key"], "full_outer")

    def later(new, known):
        return new.isNotNull() & (known.isNull() | (new >= known))

    out, places = {c: F.col(c) for c in ns} | {key: F.col("key")}, []
    for c in cols:
        value, place = F.col(c + "__t"), F.col("_col_pos")[c]
        if c + "__s" in changes.columns:
            s = F.col(c + "__s")
            new = later(s["p"], place)
            value, place = F.when(new, F.when(~s["d"], s["v"])).otherwise(value), F.when(new, s["p"]).otherwise(place)
        out[c] = value.cast(state.schema[c].dataType)
        places.append(place.alias(c))
    new = later(F.col("_last"), F.col("_old"))
    out["_col_pos"] = F.struct(*places)
    out["_pos"] = F.when(new, F.col("_last")).otherwise(F.col("_old"))
    out["_deleted"] = F.when(new, F.col("_last_op") == "delete").otherwise(F.col("_was_deleted"))
    return m.select(*[out[c].alias(c) for c in state.columns])


def read_target(spark: SparkSession, target: str) -> DataFrame:
    """The live rows of the target as of the last published micro-batch."""
    s = current_state(spark, target)
    return s.filter(~F.col("_deleted")).drop("_pos", "_deleted", "_col_pos")


def init_target(spark: SparkSession, target: str, snapshot: DataFrame, key: str) -> None:
    """Seed version 0 from the snapshot, every row at position minus infinity."""
    neg = F.struct(*[F.lit(-1).cast("long").alias(c) for c in cdc.POS])
    path = f"{target}/v={0:012d}"
    places = F.struct(*[neg.alias(c) for c in snapshot.columns if c not in (key, "db", "coll")])
    snapshot.select("*", places.alias("_col_pos"), neg.alias("_pos"), F.lit(False).alias("_deleted")).write.mode("overwrite").parquet(path)
    _mark(spark, path)


def apply_batch(spark: SparkSession, events: DataFrame, target: str, key: str, columns: dict[str, str],
                batch_id: int, compact_every: int = COMPACT_EVERY) -> None:
    """Publish the changes of one micro-batch, and after every ``compact_every`` of them a version of the whole target.
    A micro-batch run again rewrites its own change table with the same rows."""
    base = spark.read.parquet(f"{target}/v={max(v for v in _versions(spark, target) if v <= batch_id):012d}")
    ns = [c for c in ("db", "coll") if c in base.columns]
    path = f"{target}/d={batch_id:012d}"
    cdc.column_changes(events, ns, key, columns).write.mode("overwrite").parquet(path)
    _mark(spark, path)
    if (batch_id + 1) % compact_every == 0:
        compact(spark, target, batch_id)


def compact(spark: SparkSession, target: str, batch_id: int) -> None:
    """Write the target as of the micro-batch ``batch_id`` as a new version. It reads earlier versions only, so it may
    be run again after a failure."""
    path = f"{target}/v={batch_id + 1:012d}"
    current_state(spark, target, batch_id).write.mode("overwrite").parquet(path)
    _mark(spark, path)


def dead_letters(spark: SparkSession, target: str) -> DataFrame:
    """The poison events of all micro-batches, once each, with position and error."""
    return spark.read.parquet(f"{target}_dead_letter").dropDuplicates(["db", "coll", "key", *cdc.POS])


class Gate:
    """``busy`` is held while a micro-batch is applied; none begins once ``shut`` is set."""

    def __init__(self):
        self.busy, self.shut = threading.Lock(), threading.Event()


def _start(spark: SparkSession, log_path: str, target: str, checkpoint: str, key: str, columns: dict[str, str],
           allowed: list[tuple[str, str]], max_files_per_trigger: int, name: str | None, trigger: dict, gate: Gate | None = None,
           normalise: Callable[[DataFrame], DataFrame] = cdc.normalise_mongo):
    """The stream from the log to the target; each micro-batch leaves its heartbeat in ``<target>_progress``."""
    gate = gate or Gate()
    if len(allowed) > 1 and not {"db", "coll"} <= set(current_state(spark, target).columns):
        raise ValueError("a target of several namespaces needs the columns db and coll")
    raw = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
           .load(log_path).select(F.col("value").alias("raw"), F.lit(0).cast("long").alias("arrival")))
    ev = cdc.filter_namespaces(normalise(raw), allowed)

    def each(batch: DataFrame, batch_id: int) -> None:
        with gate.busy:
            if gate.shut.is_set():
                raise RuntimeError("paused before the micro-batch began")
            apply(batch, batch_id)

    def apply(batch: DataFrame, batch_id: int) -> None:
        # the micro-batch feeds several joins: read it from the source once
        # (bounded by the trigger size; recomputable from its fixed offsets)
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            events = cdc.split_key_changes(batch) if "old_key" in batch.columns else batch
            valid, dead = cdc.validate(cdc.drop_redeliveries(events), columns, key)
            dead_path = f"{target}_dead_letter/batch={batch_id}"
            dead.write.mode("overwrite").parquet(dead_path)
            apply_batch(spark, valid, target, key, columns, batch_id)
            beats.beat(f"{target}_progress", batch_id, batch, spark.read.schema(dead.schema).parquet(dead_path))
        finally:
            batch.unpersist()

    w = ev.writeStream.queryName(name) if name else ev.writeStream
    return w.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_cdc_stream(spark: SparkSession, log_path: str, target: str, checkpoint: str, key: str,
                   columns: dict[str, str], allowed: list[tuple[str, str]], max_files_per_trigger: int = 1,
                   progress=None, normalise: Callable[[DataFrame], DataFrame] = cdc.normalise_mongo):
    """Drain the change log with ``availableNow``; returns the finished
    query. ``normalise`` turns raw messages (``raw``, ``arrival``) into change events,
    row by row: the change stream's, or those of a PG log. ``progress`` (a ``ProgressLog``) receives the listener's events;
    the lasting heartbeat is the table ``heartbeats``."""
    if progress is not None:
        spark.streams.addListener(progress)
    try:
        q = _start(spark, log_path, target, checkpoint, key, columns, allowed, max_files_per_trigger,
                   progress.name if progress is not None else None, {"availableNow": True}, normalise=normalise)
        q.awaitTermination()
        if progress is not None:
            progress.wait_for(q.lastProgress["batchId"] if q.lastProgress else None)
    finally:
        if progress is not None:
            spark.streams.removeListener(progress)
    return q


def heartbeats(spark: SparkSession, target: str) -> DataFrame:
    """One row per micro-batch of all runs (see ``progress.heartbeats``)."""
    return beats.heartbeats(spark, f"{target}_progress")


class PausableStream:
    """C17: a stream that runs until it is paused and goes on where it stood.

    ``start`` runs it with a processing-time trigger; ``pause`` lets the
    micro-batch under way end, then stops it (a batch that was about to begin
    is run under its id on resumption); ``drain`` goes on until the log is empty and ends. Each change of status
    is a row of ``status``, so a new driver sees a paused stream as paused:
    ``start`` refuses it unless told to resume."""

    def __init__(self, spark: SparkSession, log_path: str, target: str, checkpoint: str, key: str, columns: dict[str, str],
                 allowed: list[tuple[str, str]], max_files_per_trigger: int = 1):
        self.spark, self.target, self._query, self._gate = spark, target, None, Gate()
        self._args = (spark, log_path, target, checkpoint, key, columns, allowed, max_files_per_trigger, None)

    def status(self) -> DataFrame:
        return beats.status(self.spark, f"{self.target}_status")

    def _now(self) -> str | None:
        return self.status().agg(F.max_by("status", "seq")).first()[0]

    def _tell(self, new: str) -> None:
        beats.set_status(self.spark, f"{self.target}_status", new, self.last_batch())

    def last_batch(self) -> int | None:
        """The last micro-batch that is published in the target."""
        done = [v - 1 for v in _versions(self.spark, self.target)] + _versions(self.spark, self.target, "d")
        return max(done) if done and max(done) >= 0 else None

    def start(self, resume: bool = False, every: str = "1 second") -> None:
        self._begin(resume, {"processingTime": every})

    def _begin(self, resume: bool, trigger: dict) -> None:
        if self._query is not None and self._query.isActive:
            raise RuntimeError("the stream is running")
        if self._now() == "paused" and not resume:
            raise RuntimeError("the stream is paused")
        self._tell("running")
        self._gate = Gate()
        self._query = _start(*self._args, trigger, self._gate)

    def pause(self) -> None:
        """A second pause changes nothing."""
        if self._query is not None:
            self._gate.shut.set()
            with self._gate.busy:
                pass
            self._query.stop()
            self._query = None
        if self._now() != "paused":
            self._tell("paused")

    def drain(self, resume: bool = False) -> None:
        self._begin(resume, {"availableNow": True})
        self._query.awaitTermination()
        self._query = None
        self._tell("finished")

    def wait_for_batch(self, timeout_s: float = 300.0) -> bool:
        """True once a micro-batch is published."""
        end = time.monotonic() + timeout_s
        while self.last_batch() is None and time.monotonic() < end:
            if self._query is not None and self._query.exception() is not None:
                raise self._query.exception()
            time.sleep(0.1)
        return self.last_batch() is not None
