"""Namespaces loaded side by side, and ids of identical rows."""

import threading
import time

from pyspark.sql import functions as F

from tidewater.functions.windows import dup_ordinal
from tidewater.operators import load, mapping
from tidewater.operators.mapping import Col


def test_a_failing_namespace_fails_alone_and_workers_are_bounded(spark):
    running, most, lock = [0], [0], threading.Lock()

    def work(name):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.3)
        try:
            if name == "c":
                raise ValueError("no such table\nmore")
            if name == "e":
                return spark.range(3).select(F.raise_error(F.lit("bad row")).alias("n_rows"))
            return spark.createDataFrame([(name, ord(name))], "namespace string, n_rows long")
        finally:
            with lock:
                running[0] -= 1

    rows = load.in_parallel(spark, list("abcdef"), work, workers=2).orderBy("position").collect()
    assert [(r.namespace, r.status, r.n_rows) for r in rows] == [(c, "failed" if c in "ce" else "written", 0 if c in "ce" else ord(c)) for c in "abcdef"]
    assert rows[2].error == "no such table" and "bad row" in rows[4].error and rows[0].error is None
    assert most[0] == 2
    assert load.in_parallel(spark, [], work).collect() == []


def test_ids_of_identical_rows_are_the_same_on_every_run(spark):
    df = spark.createDataFrame([("a", 1)] * 500 + [("b", None)] * 3 + [(None, None)] * 2, "x string, y int")
    runs = []
    for parts in (1, 7, 3):
        docs, _ = mapping.map_sql_to_doc(df.repartition(parts), [Col("x", "string"), Col("y", "int")], "pg")
        runs.append(sorted(r[0] for r in docs.select(F.get_json_object("doc", "$._id")).collect()))
    assert runs[0] == runs[1] == runs[2] and len(set(runs[0])) == 505


def test_no_row_is_lost_when_partitions_are_planned_anew(spark):
    df = spark.range(2000).repartition(13, F.col("id")).select((F.col("id") % 3).alias("k"))
    got = dup_ordinal(df.withColumn("k", F.when(F.col("k") < 2, F.col("k"))), F.col("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_dup").alias("d"), F.max("_dup").alias("m")).collect()
    assert sorted((str(r.k), r.n, r.d, r.m) for r in got) == [("0", 667, 667, 667), ("1", 667, 667, 667), ("None", 666, 666, 666)]
