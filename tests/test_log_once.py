"""A stream's log is made once, whatever its number of steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans import q_streams


def test_log_is_made_once_and_written_in_order(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def told(x):
        made.add(1)
        return str(x)

    df = spark.range(0, 40, 1, 4).select(F.udf(told)("id").alias("raw"), (F.col("id") % 5).alias("step"))
    q_streams._write_in_order(df, "step", str(tmp_path / "log"), "text")
    assert made.value == 40
    files = sorted((tmp_path / "log").glob("*.txt"), key=lambda f: f.stat().st_mtime_ns)
    steps = [int(line) % 5 for f in files for line in f.read_text().split()]
    assert len(steps) == 40 and steps == sorted(steps)
