"""The writer of atomic batches, its runs, and row numbers over ranges."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.windows import row_ordinal
from tidewater.session import checkpoint_dir
from tidewater.sources import batch_sink


def _write(rows, path, run, size, bad=()):
    error = F.when(F.col("id").isin(*bad), F.concat(F.lit("bad "), F.col("id").cast("string"))) if bad else F.lit(None).cast("string")
    batch_sink.write_batches(batch_sink.chunks(rows, ["ns"], "id", size), error, path, run, ["ns"], F.col("_batch"))


def _ids(spark, path, rows, run=None):
    return sorted(((r.ns or "", r.id) for r in batch_sink.landed(spark, path, rows.schema, run).collect()))


def test_a_bad_row_fails_its_batch_only(spark):
    path = checkpoint_dir(spark, "sink")
    rows = spark.range(1230).select("id", F.when(F.col("id") < 820, F.lit("a")).when(F.col("id") < 1200, F.lit("b")).alias("ns"), F.lit("x").alias("v"))
    _write(rows, path, "r1", 50, bad=(60, 61, 825))
    lost = set(range(50, 100)) | set(range(820, 870))
    assert [i for _, i in sorted(_ids(spark, path, rows), key=lambda x: x[1])] == [i for i in range(1230) if i not in lost]
    told = {(r.ns, r._batch): (r.rows, r.bad_rows, r.error) for r in batch_sink.outcomes(spark, path, rows.select("ns").schema).collect()}
    assert len(told) == 17 + 8 + 1 and told[("a", 1)] == (50, 2, "bad 60") and told[("b", 0)] == (50, 1, "bad 825")
    assert told[("a", 16)] == (20, 0, None) and told[("b", 7)] == (30, 0, None) and told[(None, 0)] == (30, 0, None)


def test_runs_add_up_and_a_run_written_again_replaces_itself(spark):
    path = checkpoint_dir(spark, "sink")
    rows = spark.range(100).select("id", F.lit("a").alias("ns"))
    _write(rows, path, "r1", 10)
    _write(rows, path, "r2", 10, bad=(5,))
    assert len(_ids(spark, path, rows)) == 190 and len(_ids(spark, path, rows, "r2")) == 90
    _write(rows, path, "r2", 10)
    assert len(_ids(spark, path, rows)) == 200 and len(_ids(spark, path, rows, "r1")) == 100


def test_a_run_that_fails_lands_nothing(spark):
    path = checkpoint_dir(spark, "sink")
    rows = spark.range(100).select("id", F.lit("a").alias("ns"))
    error = F.when(F.col("id") == 77, F.raise_error(F.lit("source lost"))).cast("string")
    with pytest.raises(Exception, match="source lost"):
        batch_sink.write_batches(rows, error, path, "r1", ["ns"], F.floor(F.col("id") / 10))
    assert _ids(spark, path, rows) == [] and batch_sink.outcomes(spark, path, rows.select("ns").schema).count() == 0


def test_empty_input_and_batches_without_a_good_one(spark):
    path = checkpoint_dir(spark, "sink")
    rows = spark.range(20).select("id", F.lit("a").alias("ns"))
    _write(rows.limit(0), path, "r1", 10)
    assert _ids(spark, path, rows) == []
    _write(rows, path, "r2", 10, bad=(3, 13))
    assert _ids(spark, path, rows) == []
    assert [(r.rows, r.bad_rows) for r in batch_sink.outcomes(spark, path, rows.select("ns").schema).collect()] == [(10, 1)] * 2


def test_a_batch_over_many_record_batches_is_whole(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        path = checkpoint_dir(spark, "sink")
        rows = spark.range(500).select("id", F.lit("a").alias("ns"))
        _write(rows, path, "r1", 100, bad=(250,))
        assert [i for _, i in _ids(spark, path, rows)] == [*range(200), *range(300, 500)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_row_ordinal_equals_row_number(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("k"), F.when(F.col("id") % 50 > 0, F.col("id") * 7 % 1000).alias("o"), "id")
    got = row_ordinal(rows.repartition(7), ["k"], "o", "n").groupBy("k", "o").agg(F.sort_array(F.collect_list("n")).alias("n")).collect()
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o"))).groupBy("k", "o").agg(F.sort_array(F.collect_list("n")).alias("n")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_an_appended_run_counts_its_own_rows(spark):
    from tidewater.operators import load
    path = checkpoint_dir(spark, "runs")
    rows = spark.range(10).select("id", F.lit("a").alias("ns"))
    for n, run in ((10, "7"), (4, "8")):
        got = load.write_load(rows.limit(n), F.col("id") == 3, F.lit("bad"), path, ["ns"], mode="append", run_id=run)
        assert sorted((r.status, r.n_rows, r.error) for r in got.collect()) == [("rejected", 1, "bad"), ("written", n - 1, None)]
    assert spark.read.parquet(path).count() == 14
