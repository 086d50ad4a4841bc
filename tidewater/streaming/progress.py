"""Stream heartbeat (2.15) and pause (C17).

``ProgressLog``: Structured Streaming's own progress events of a running
query, collected by a listener (batch id, input rows, rate, duration); they
are gone with the driver. ``beat`` / ``heartbeats``: one row per micro-batch
in a table beside the target, written under its batch id before the batch is
committed, so a batch that runs again replaces its row and a restarted stream
finds all earlier ones. ``set_status`` / ``status``: running, paused,
finished, one row per change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewater.operators import cdc

STATUS = "seq long, status string, batch_id long, at timestamp"


def beat(path: str, batch_id: int, events: DataFrame, dead: DataFrame) -> None:
    """Write the batch's row: events read, poison events among them, and the position of the last event."""
    position = F.struct(*cdc.POS)
    both = events.select(position.alias("p"), F.lit(0).alias("dead")).unionByName(dead.select(position.alias("p"), F.lit(1).alias("dead")))
    row = both.agg(F.count_if(F.col("dead") == 0).cast("long").alias("events"), F.count_if(F.col("dead") == 1).cast("long").alias("dead"),
                   F.max("p").alias("last_position"))
    row.withColumn("at", F.current_timestamp()).coalesce(1) \
       .write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def heartbeats(spark: SparkSession, path: str) -> DataFrame:
    """All batches of all runs of the stream, once each: batch_id, events, dead, last_position, at."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").withColumnRenamed("batch", "batch_id") \
                .withColumn("batch_id", F.col("batch_id").cast("long"))


def _last_seq(spark: SparkSession, path: str) -> int:
    found = status(spark, path).agg(F.max("seq")).first()[0]
    return -1 if found is None else found


def set_status(spark: SparkSession, path: str, new: str, batch_id: int | None) -> None:
    """Append a change of status; one stream has one driver, which is its only writer."""
    row = spark.createDataFrame([(_last_seq(spark, path) + 1, new, batch_id)], "seq long, status string, batch_id long")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def status(spark: SparkSession, path: str) -> DataFrame:
    """The changes of status in order of ``seq`` (empty before the first)."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(STATUS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATUS)


class ProgressLog(StreamingQueryListener):
    """Keeps one small record per finished micro-batch of the watched query."""

    def __init__(self, name: str | None = None):
        self.name = name
        self._seen: dict[tuple[str, int], dict] = {}
        self.terminated = False

    @property
    def batches(self) -> list[dict]:
        return list(self._seen.values())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name is None or p.name == self.name:
            # keyed by (run, batch): a listener bus may deliver an event more than once
            self._seen[(str(p.runId), p.batchId)] = {
                "batch_id": p.batchId, "input_rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond,
                "duration_ms": p.durationMs.get("triggerExecution")}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.terminated = True

    def wait_for(self, batch_id, timeout_s: float = 10.0) -> None:
        """Listener events are delivered asynchronously; wait (bounded) until
        the given batch has been seen."""
        import time
        end = time.monotonic() + timeout_s
        while batch_id is not None and time.monotonic() < end and \
                not any(b["batch_id"] == batch_id for b in self.batches):
            time.sleep(0.05)
