"""Run, snapshot and job-history analytics.

Per-job rankings use ``row_number`` filtered to a constant, which Spark
plans as a WindowGroupLimit: each task keeps only the top rows per job
before the shuffle, so a job with a huge history does not land whole on
one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per_job(runs: DataFrame, n: int, job: str = "job_id", started: str = "started_ms",
                   tie: str = "run_id") -> DataFrame:
    """W5 (n = 1), W6 (n = 20), H4 (n = 3 over successes): the newest n runs per job."""
    w = Window.partitionBy(job).orderBy(F.col(started).desc(), F.col(tie).desc())
    return runs.withColumn("rn", F.row_number().over(w).cast("long")).filter(F.col("rn") <= n)


def retention_prune(runs: DataFrame, keep: int = 3, job: str = "job_id", started: str = "started_ms",
                    tie: str = "run_id") -> DataFrame:
    """Successful runs beyond the ``keep`` newest per job are pruned. The
    newest ``keep`` come from a per-job top-k (bounded per task before the
    shuffle), joined back by run id; ``rn`` is set for kept runs only."""
    ok = runs.filter(F.col("status") == "succeeded")
    kept = newest_per_job(ok, keep, job, started, tie).select(tie, "rn")   # WindowGroupLimit top-k
    return ok.join(kept, tie, "left").withColumn("keep", F.col("rn").isNotNull())


def elapsed_seconds(start_ms: Column, end_ms: Column, now_ms: int) -> Column:
    """H1: max(0, floor((end or now) - start) seconds)."""
    return F.greatest(F.lit(0), F.floor((F.coalesce(end_ms, F.lit(now_ms)) - start_ms) / 1000)).cast("long")


def duration_label(sec: Column) -> Column:
    """H2: '5s', '1m 23s', '1h 4m'."""
    return (F.when(sec < 60, F.format_string("%ds", sec))
            .when(sec < 3600, F.format_string("%dm %ds", F.floor(sec / 60), sec % 60))
            .otherwise(F.format_string("%dh %dm", F.floor(sec / 3600), F.floor((sec % 3600) / 60))))


def _trim_zero(x: Column) -> Column:
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def bytes_label(b: Column) -> Column:
    """H6: 1024 steps, one decimal without a trailing .0, '0 B' for zero."""
    i = F.least(F.floor(F.log(b.cast("double")) / F.log(F.lit(1024.0))), F.lit(4)).cast("int")
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")])
    v = F.round(b / F.pow(F.lit(1024.0), i), 1)
    return F.when(b == 0, F.lit("0 B")).otherwise(F.concat(_trim_zero(v), F.lit(" "), F.element_at(units, i + 1)))


def _js_round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def age_label(ts_ms: Column, now_ms: int) -> Column:
    """H6: 'just now', 'Nm ago', 'Nh ago', 'Nd ago' (half-up rounding)."""
    d = F.lit(now_ms) - ts_ms
    return (F.when(d < 60_000, F.lit("just now"))
            .when(d < 3_600_000, F.format_string("%dm ago", _js_round(d / 60_000)))
            .when(d < 86_400_000, F.format_string("%dh ago", _js_round(d / 3_600_000)))
            .otherwise(F.format_string("%dd ago", _js_round(d / 86_400_000))))


def query_time_label(ms: Column) -> Column:
    """H6: '<ms>ms', then seconds / minutes / hours with one decimal."""
    s = ms / 1000.0
    return (F.when(ms < 1000, F.concat(_trim_zero(ms), F.lit("ms")))
            .when(s < 60, F.format_string("%.1fs", s))
            .when(s / 60 < 60, F.format_string("%.1fm", s / 60))
            .otherwise(F.format_string("%.1fh", s / 3600)))
