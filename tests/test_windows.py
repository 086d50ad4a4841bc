"""The skew-safe window helpers must equal the plain whole-key windows they
replace, on random data (random keys, times, buckets and nulls)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.windows import dup_ordinal, range_ffill, range_lag, split_cumsum, split_ffill, split_lag

rows_st = st.lists(
    st.tuples(st.integers(0, 3), st.integers(0, 400), st.one_of(st.none(), st.integers(-5, 5))),
    min_size=1, max_size=60)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _df(spark, rows):
    data = [(k, t, i, v) for i, (k, t, v) in enumerate(rows)]
    return spark.createDataFrame(data, "k int, t long, id long, v int")


@SETTINGS
@given(rows=rows_st, width=st.integers(1, 50))
def test_split_lag_equals_lag(spark, rows, width):
    df = _df(spark, rows)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {r["id"]: (r["pt"], r["pv"]) for r in
            df.select("id", F.lag("t").over(w).alias("pt"), F.lag("v").over(w).alias("pv")).collect()}
    got = split_lag(df, ["k"], ["t", "id"], F.floor(F.col("t") / width), ["t", "v"])
    assert {r["id"]: (r["prev_t"], r["prev_v"]) for r in got.collect()} == want


@SETTINGS
@given(rows=rows_st, width=st.integers(1, 50))
def test_split_cumsum_equals_running_sum(spark, rows, width):
    df = _df(spark, rows).withColumn("v", F.coalesce("v", F.lit(0)))
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: r["s"] for r in df.select("id", F.sum("v").over(w).alias("s")).collect()}
    got = split_cumsum(df, ["k"], ["t", "id"], F.floor(F.col("t") / width), {"s": F.col("v"), "n": F.lit(1)})
    out = got.collect()
    assert {r["id"]: r["s"] for r in out} == want
    assert all(r["n"] >= 1 for r in out)


@SETTINGS
@given(rows=rows_st, width=st.integers(1, 50))
def test_split_ffill_equals_last_ignore_nulls(spark, rows, width):
    df = _df(spark, rows).withColumn("o", F.col("t") * 1000 + F.col("id"))
    w = Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: r["f"] for r in df.select("id", F.last("v", ignorenulls=True).over(w).alias("f")).collect()}
    got = split_ffill(df, "o", F.floor(F.col("t") / width), "v", "f")
    assert {r["id"]: r["f"] for r in got.collect()} == want


@SETTINGS
@given(rows=rows_st, parts=st.integers(1, 5))
def test_dup_ordinal_numbers_each_group(spark, rows, parts):
    df = _df(spark, rows).repartition(parts)
    got = dup_ordinal(df, F.col("k")).groupBy("k").agg(F.sort_array(F.collect_list("_dup")).alias("o"),
                                                       F.count(F.lit(1)).alias("n")).collect()
    assert all(r["o"] == list(range(1, r["n"] + 1)) for r in got)


@SETTINGS
@given(rows=rows_st)
def test_range_lag_equals_lag(spark, rows):
    df = _df(spark, rows).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    w = Window.partitionBy("k").orderBy("t", "id")
    want = {r["id"]: (r["pt"], r["pv"]) for r in df.select("id", F.lag("t").over(w).alias("pt"), F.lag("v").over(w).alias("pv")).collect()}
    assert {r["id"]: (r["prev_t"], r["prev_v"]) for r in range_lag(df, ["k"], ["t", "id"], ["t", "v"]).collect()} == want


@SETTINGS
@given(rows=rows_st, keyed=st.booleans())
def test_range_ffill_equals_last_ignore_nulls(spark, rows, keyed):
    df = _df(spark, rows).withColumn("o", F.col("t") * 1000 + F.col("id")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    keys = ["k"] if keyed else []
    w = Window.partitionBy(*keys).orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: r["f"] for r in df.select("id", F.last("v", ignorenulls=True).over(w).alias("f")).collect()}
    assert {r["id"]: r["f"] for r in range_ffill(df, "o", "v", "f", keys).collect()} == want


def test_a_dense_day_of_one_key_is_spread_and_stitched(spark):
    """Without coalescing, 5,000 samples of one key in one minute fill many ranges; values far apart are carried over them."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") % 60000).alias("o"), F.when(F.col("id") % 1700 == 900, F.col("id")).alias("v"))
        assert {r.o: r.f for r in range_ffill(df, "o", "v", "f").collect()} == {i: None if i < 900 else (i - 900) // 1700 * 1700 + 900 for i in range(5000)}
        assert {r.o: r.prev_o for r in range_lag(df, ["k"], ["o"], ["o"]).collect()} == {i: i - 1 if i else None for i in range(5000)}
        from tidewater.functions import windows
        assert windows._ranges(df, ["k"], ["o"]).select("_range").distinct().count() == 13
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
