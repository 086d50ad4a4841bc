"""Window helpers that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import materialize

DAY_MS = 86_400_000


def day_bucket(ts_ms: Column) -> Column:
    return F.floor(ts_ms / F.lit(DAY_MS)).cast("long")


def split_lag(df: DataFrame, keys: list[str], order: list[str], bucket: Column, cols: list[str],
              prefix: str = "prev_") -> DataFrame:
    """``lag(col)`` over ``partition by keys order by order`` without putting a
    whole key into one task.

    The window runs per ``(keys, bucket)`` (e.g. one day of one connection),
    so a hot key is spread over many tasks. The first row of each bucket is
    then patched with the last row of the previous non-empty bucket, taken
    from a per-bucket ``max_by`` table whose size is keys x buckets."""
    b = "_bucket"
    base = df.withColumn(b, bucket)          # one object: both branches share its plan (exchange reuse)
    w = Window.partitionBy(*keys, b).orderBy(*order)
    d = base.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in cols],
                    (F.row_number().over(w) == 1).alias("_first"))
    last = base.groupBy(*keys, b).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    wb = Window.partitionBy(*keys).orderBy(b)
    prev_bucket = last.select(*keys, b, F.lag("_last").over(wb).alias("_pb"))
    d = d.join(prev_bucket, [*keys, b], "left")
    patched = [F.when(F.col("_first"), F.col("_pb")[c]).otherwise(F.col(prefix + c)).alias(prefix + c)
               for c in cols]
    keep = [c for c in d.columns if c not in {b, "_first", "_pb", *[prefix + c for c in cols]}]
    return d.select(*keep, *patched)


def split_cumsum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, col: Column | dict,
                 out: str | None = None) -> DataFrame:
    """Running ``sum`` over ``partition by keys order by order`` computed per
    ``(keys, bucket)`` plus the totals of all earlier buckets (a per-bucket
    aggregate with its own small window), so no task holds a whole key.
    ``col`` is one Column (named by ``out``) or a dict {out: Column}; all
    sums share one window, one aggregate and one join."""
    cols = {out: col} if not isinstance(col, dict) else col
    b = "_bucket"
    names = list(cols)
    d = df.withColumn(b, bucket).select("*", *[c.alias(f"_v_{n}") for n, c in cols.items()])
    w = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select("*", *[F.sum(f"_v_{n}").over(w).alias(f"_w_{n}") for n in names])
    totals = d.groupBy(*keys, b).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    wb = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, b, *[F.coalesce(F.sum(f"_t_{n}").over(wb), F.lit(0)).alias(f"_o_{n}") for n in names])
    j = d.join(offsets, [*keys, b], "left")
    j = j.select("*", *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in names])
    return j.drop(b, *[f"_{p}_{n}" for n in names for p in ("v", "w", "o")])


def split_ffill(df: DataFrame, order: str, bucket: Column, col: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """``last(col, ignoreNulls)`` carried forward in ``order`` without a global
    single-task window: fill within each bucket, then seed each bucket with
    the last non-null value of the buckets before it (a tiny per-bucket table)."""
    keys = keys or []
    b = "_bucket"
    d = df.withColumn(b, bucket)
    w = Window.partitionBy(*keys, b).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_in", F.last(col, ignorenulls=True).over(w))
    last = (d.filter(F.col(col).isNotNull()).groupBy(*keys, b)
            .agg(F.max_by(col, order).alias("_bl")))
    wb = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    # buckets without any non-null value still need a seed: take it from the nearest earlier bucket
    allb = d.select(*keys, b).distinct().join(last.select(*keys, b, "_bl"), [*keys, b], "left")
    seeds = allb.select(*keys, b, F.last("_bl", ignorenulls=True).over(wb).alias("_seed"))
    return (d.join(seeds, [*keys, b], "left")
            .withColumn(out, F.coalesce("_in", "_seed")).drop(b, "_in", "_seed"))


def dup_ordinal(df: DataFrame, key: Column, out: str = "_dup") -> DataFrame:
    """1..n among rows sharing ``key`` (e.g. a hash of identical rows) without
    a window over a possibly huge group: number rows inside each (key,
    partition), then add the counts of the key's earlier partitions
    (a small per-(key, partition) table). The rows are written with their
    partition first (a reliable checkpoint), so the count and the numbering
    read the same partitions, whatever is planned or run again. Which
    identical row gets which number may vary, the set of numbers per key is
    always 1..n. A null key is a key."""
    d = materialize(df.withColumn("_k", key).withColumn("_pid", F.spark_partition_id()))
    counts = d.groupBy("_k", "_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_k").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(F.col("_k").alias("_k2"), F.col("_pid").alias("_pid2"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_k", "_pid").orderBy("_k")
    return (d.withColumn("_rn", F.row_number().over(local))
            .join(offs, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_pid") == F.col("_pid2")))
            .withColumn(out, F.col("_rn") + F.col("_off")).drop("_k", "_pid", "_k2", "_pid2", "_rn", "_off"))


def _ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows dealt into ranges of (keys, order) of about equal size and
    written with their range's number (a reliable checkpoint, so all that
    reads them sees the same ranges). The input is read once. A key's rows,
    however dense in time, are spread over as many ranges as they fill."""
    return materialize(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def _with_carry(d: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its (keys, range)'s row of ``carry`` (a small table), if there is one; a null key is a key."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)} | {"_range": "_range2"}
    right = carry.select(*[F.col(c).alias(names.get(c, c)) for c in carry.columns])
    same = F.col("_range") == F.col("_range2")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(names[k]))
    return d.join(right, same, "left").drop(*names.values())


def range_lag(df: DataFrame, keys: list[str], order: list[str], cols: list[str], prefix: str = "prev_") -> DataFrame:
    """``lag(col)`` over ``partition by keys order by order``: the lag inside
    each (keys, range), and for a range's first row the last row of the key's
    range before, from a table of one row per (key, range). ``order`` tells
    all rows of a key apart."""
    d = _ranges(df, keys, order)
    w = Window.partitionBy(*keys, "_range").orderBy(*order)
    rows = d.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in cols], (F.row_number().over(w) == 1).alias("_first"))
    last = d.groupBy(*keys, "_range").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    carry = last.select(*keys, "_range", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")).alias("_before"))
    rows = _with_carry(rows, carry, keys)
    return rows.select(*df.columns, *[F.when(F.col("_first"), F.col("_before")[c]).otherwise(F.col(prefix + c)).alias(prefix + c) for c in cols])


# levels of the tree of ranges in range_ffill: 2 ** 20 ranges at most, far beyond any number of partitions
LEVELS = 20


def range_ffill(df: DataFrame, order: str, col: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """``last(col, ignoreNulls)`` carried forward in ``order``, also without a
    key: filled inside each range, then seeded with the last value before it.
    Ranges are leaves of a binary tree: each range's last value goes up to
    its ancestors, and the ranges before one are at most ``LEVELS`` whole
    subtrees, whose latest value is its seed. So no task sees all ranges.
    ``order`` tells the rows of a key apart."""
    keys = keys or []
    d = _ranges(df, keys, [order])
    w = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = d.withColumn("_in", F.last(col, ignorenulls=True).over(w))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    last = d.filter(F.col(col).isNotNull()).groupBy(*keys, "_range").agg(F.max_by(col, order).alias("_v"))
    up = last.select(*keys, "_range", "_v", levels.alias("_level"))
    node = F.floor(F.col("_range") / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    tree = up.groupBy(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], F.col("_level").alias("_l2"), node.alias("_node")) \
             .agg(F.max(F.struct("_range", "_v")).alias("_latest"))
    # a range lies right of the subtree beside it on each level where its own node is a right child
    need = d.select(*keys, "_range").distinct().select("*", levels.alias("_level")).withColumn("_mine", node).filter(F.col("_mine") % 2 == 1)
    same = (F.col("_level") == F.col("_l2")) & (F.col("_mine") - 1 == F.col("_node"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_t{i}"))
    seeds = need.join(tree, same).groupBy(*keys, "_range").agg(F.max("_latest")["_v"].alias("_seed"))
    return _with_carry(rows, seeds, keys).withColumn(out, F.coalesce("_in", "_seed")).drop("_in", "_seed", "_range")


def row_ordinal(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """1..n per ``keys`` in the order of ``order``, equal to ``row_number`` but
    without a window over a whole key: numbered inside (keys, range) and
    raised by the rows of the key's earlier ranges (a small table). Rows with
    equal ``order`` lie in one range; their order is free. Nulls come first,
    and a null key is a key."""
    d = _ranges(df, keys, [order])
    counts = d.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    return _with_carry(d.withColumn("_rn", local), offs, keys).withColumn(out, F.col("_rn") + F.col("_off")).drop("_range", "_rn", "_off")
