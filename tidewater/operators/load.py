"""Load accounting and reconciliation.

A load is a validity split (mapped rows vs rejects) plus, for insert-only
document targets, an anti join against keys already present. Outcomes are
aggregated per namespace in one grouped pass; verdicts and the run roll-up
are CASE expressions over those aggregates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _existing_on(existing_keys: DataFrame, key: str, ns_cols: list[str]) -> list[str]:
    """A key present in one namespace says nothing about the others; existing
    keys without namespace columns are those of a single-collection target."""
    return [*(c for c in ns_cols if c in existing_keys.columns), key]


def insert_only(rows: DataFrame, existing_keys: DataFrame, key: str, ns_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Unordered insert into a document target. Duplicates of a key
    inside the load and keys already in the target are skipped; returns
    (inserted, skipped with a count ``_n`` per row). dropDuplicates plus a
    left anti / semi join on the namespace (where the existing keys carry it)
    and the key; no per-row lookups."""
    on = _existing_on(existing_keys, key, ns_cols)
    keys = existing_keys.select(*on).distinct()
    first = rows.dropDuplicates([*ns_cols, key])
    inserted = first.join(keys, on, "left_anti")
    skipped_existing = first.join(keys, on, "left_semi").select(*ns_cols, key, F.lit(1).alias("_n"))
    dups = (rows.groupBy(*ns_cols, key).agg((F.count(F.lit(1)) - 1).alias("_n")).filter(F.col("_n") > 0))
    return inserted, skipped_existing.unionByName(dups)


def outcome_one_pass(rows: DataFrame, existing_keys: DataFrame, key: str, ns_cols: list[str],
                     bad: Column, error: Column) -> DataFrame:
    """L1 in a single pass over the mapped rows: a row is failed when it does
    not convert; of the good rows of a key, the first is written unless the
    key already exists, every other one is skipped. One join against the
    existing keys, a per-key aggregate (partial, so hot keys combine map-side)
    and a per-namespace aggregate."""
    on = _existing_on(existing_keys, key, ns_cols)
    ex = existing_keys.select(*on).distinct().withColumn("_exists", F.lit(True))
    r = rows.select(*ns_cols, key, bad.alias("_bad"), error.alias("_err")).join(ex, on, "left")
    k = r.groupBy(*ns_cols, key).agg(
        F.count_if(F.col("_bad")).alias("bad_rows"), F.count_if(~F.col("_bad")).alias("good_rows"),
        F.max(F.coalesce("_exists", F.lit(False))).alias("exists"),
        F.max(F.when(F.col("_bad"), F.col("_err"))).alias("err"))
    written = F.when((F.col("good_rows") > 0) & ~F.col("exists"), F.lit(1)).otherwise(F.lit(0))
    k = k.withColumn("w", written).withColumn("s", F.col("good_rows") - F.col("w"))
    return k.groupBy(*ns_cols).agg(
        F.sum("w").cast("long").alias("written"), F.sum("s").cast("long").alias("skipped"),
        F.sum("bad_rows").cast("long").alias("failed"),
        F.max_by("err", F.when(F.col("bad_rows") > 0, F.col(key))).alias("last_error"))


def batch_atomic(rows: DataFrame, ok: Column, batch: Column, ns_cols: list[str]) -> DataFrame:
    """All-or-nothing batches: a batch with any failed row writes
    nothing. Returns one row per (namespace, batch) with its row counts and
    status; ``landed_nothing`` flags a load whose every batch failed."""
    b = rows.withColumn("_batch", batch).withColumn("_ok", ok)
    per = b.groupBy(*ns_cols, "_batch").agg(F.count(F.lit(1)).cast("long").alias("rows"),
                                            F.count_if(~F.col("_ok")).cast("long").alias("bad_rows"))
    per = per.withColumn("status", F.when(F.col("bad_rows") > 0, F.lit("failed")).otherwise(F.lit("written")))
    return per.withColumn("written", F.when(F.col("status") == "written", F.col("rows")).otherwise(F.lit(0)).cast("long")) \
              .withColumnRenamed("_batch", "batch_id")


def verdict(out: DataFrame, threw: Column | None = None) -> DataFrame:
    """L2: threw -> failed; failed rows and nothing written -> failed; failed
    rows and some written -> succeeded with an error entry; else succeeded."""
    threw = threw if threw is not None else F.lit(False)
    v = (F.when(threw, F.lit("failed"))
         .when((F.col("failed") > 0) & (F.col("written") == 0), F.lit("failed"))
         .otherwise(F.lit("succeeded")))
    err = F.when((F.col("failed") > 0) & (F.col("written") > 0), F.col("last_error"))
    return out.withColumn("verdict", v).withColumn("error_entry", err)


def rollup(verdicts: DataFrame, run_cols: list[str]) -> DataFrame:
    """L3: all namespaces failed (and at least one) -> failed; any failure,
    error entry or row loss -> partial; else succeeded."""
    g = verdicts.groupBy(*run_cols).agg(
        F.count(F.lit(1)).cast("long").alias("namespaces"),
        F.count_if(F.col("verdict") == "failed").cast("long").alias("failed_namespaces"),
        F.sum("written").cast("long").alias("written"), F.sum("skipped").cast("long").alias("skipped"),
        F.sum("failed").cast("long").alias("failed"),
        F.count_if(F.col("error_entry").isNotNull()).cast("long").alias("errors"))
    phase = (F.when((F.col("namespaces") > 0) & (F.col("failed_namespaces") == F.col("namespaces")), F.lit("failed"))
             .when((F.col("failed_namespaces") > 0) | (F.col("errors") > 0) | (F.col("failed") > 0), F.lit("partial"))
             .otherwise(F.lit("succeeded")))
    return g.withColumn("phase", phase)


def gate(verdicts: DataFrame, run_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Tailing is blocked by any failed namespace, failed row or error;
    the message joins the first three errors with ' | '."""
    msg = F.when(F.col("verdict") == "failed", F.coalesce("last_error", F.lit("namespace failed"))) \
           .when(F.col("failed") > 0, F.col("last_error"))
    g = verdicts.withColumn("_msg", msg).groupBy(*run_cols).agg(
        F.count_if(F.col("_msg").isNotNull()).alias("_n"),
        F.array_sort(F.collect_list(F.when(F.col("_msg").isNotNull(),
                                           F.struct(*[F.col(c) for c in order_cols], F.col("_msg").alias("m")))))
        .alias("_errs"))
    return g.select(*run_cols, (F.col("_n") > 0).alias("blocked"),
                    F.when(F.col("_n") > 0, F.array_join(F.transform(F.slice("_errs", 1, 3), lambda s: s["m"]), " | "))
                    .alias("reason"))


def progress_pct(written: Column, approx: Column, done: Column) -> Column:
    """min(100, round(written / approx * 100)) with half-up rounding;
    without a total: 100 when done, else null."""
    return (F.when(approx.isNotNull() & (approx > 0), F.least(F.lit(100), F.floor(written / approx * 100 + 0.5)))
            .when(done, F.lit(100))).cast("long")


def reconcile(source: DataFrame, target: DataFrame, ns_cols: list[str], key: str) -> DataFrame:
    """Counts (and an order-free fingerprint: bit_xor and sum of the
    key) on both sides, full outer join, difference."""
    def side(df, p):
        return df.groupBy(*ns_cols).agg(F.count(F.lit(1)).cast("long").alias(f"{p}_rows"),
                                        F.bit_xor(F.col(key)).alias(f"{p}_xor"),
                                        F.sum(F.col(key)).cast("long").alias(f"{p}_sum"))
    j = side(source, "src").join(side(target, "dst"), ns_cols, "full_outer")
    return j.select(*ns_cols, F.coalesce("src_rows", F.lit(0)).alias("src_rows"),
                    F.coalesce("dst_rows", F.lit(0)).alias("dst_rows"),
                    (F.coalesce("src_rows", F.lit(0)) - F.coalesce("dst_rows", F.lit(0))).alias("diff"),
                    ((F.col("src_xor") == F.col("dst_xor")) & (F.col("src_sum") == F.col("dst_sum"))
                     & (F.col("src_rows") == F.col("dst_rows"))).alias("matches"))


def write_load(rows: DataFrame, bad: Column, error: Column, path: str, ns_cols: list[str],
               mode: str = "overwrite", run_id: str | None = None) -> DataFrame:
    """S9/S12 sink: one distributed write of the mapped rows, partitioned by
    status (``written`` rows, ``rejected`` rows with their error), so valid
    rows and rejects come from a single pass; ``overwrite`` is
    drop-and-create, ``append`` create-if-missing. Rows carry their run
    (``run_id``, by default a new one). Returns the per-namespace counts of
    this run read back from the written files (partition pruning, no rescan
    of the source)."""
    run_id = run_id or uuid.uuid4().hex
    out = rows.withColumn("status", F.when(bad, F.lit("rejected")).otherwise(F.lit("written"))) \
              .withColumn("error", F.when(bad, error))
    out = out.drop(*[c for c in out.columns if c.startswith("_")])     # working columns stay behind
    out.withColumn("run_id", F.lit(run_id)).write.mode(mode).partitionBy("run_id", "status").parquet(path)
    back = rows.sparkSession.read.parquet(path).filter(F.col("run_id") == run_id)
    return back.groupBy(*ns_cols, "status").agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                                                 F.max("error").alias("error"))


def in_parallel(spark: SparkSession, namespaces: list[str], work: Callable[[str], DataFrame], workers: int = 4) -> DataFrame:
    """``work(namespace)`` for several namespaces at a time, at most
    ``workers`` (0 or less: 1), each serial inside and in a scheduler pool of
    its own, so that small namespaces share the cluster with a large one
    (under ``spark.scheduler.mode=FAIR``). ``work`` writes and returns its
    counts (namespace, n_rows). A namespace that throws fails alone; one row
    per namespace with its status, rows and error, in the given order of
    ``position``. Only the list of namespaces and their counts are on the driver."""
    def one(namespace: str) -> tuple[int, str]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"load-{namespace}")
        try:
            return sum(r.n_rows for r in work(namespace).collect()), ""
        except Exception as e:  # noqa: BLE001  (any failure is the namespace's own, and reported)
            return 0, str(e).strip().split("\n")[0] or type(e).__name__
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(one), namespaces))
    rows = [(i, name, "failed" if error else "written", n, error or None) for i, (name, (n, error)) in enumerate(zip(namespaces, found, strict=True))]
    return spark.createDataFrame(rows, "position int, namespace string, status string, n_rows long, error string")


def preview_warnings(warnings: DataFrame, namespaces: DataFrame, ns_cols: list[str]) -> DataFrame:
    """Warnings and infos of each namespace of a dry run (zero where there is none), and their totals (all
    namespace columns '*'), for the summary above the list."""
    per = warnings.groupBy(*ns_cols).agg(F.count_if(F.col("severity") == "warn").cast("long").alias("n_warn"), F.count_if(F.col("severity") == "info").cast("long").alias("n_info"))
    per = namespaces.select(*ns_cols).distinct().join(per, ns_cols, "left").select(*ns_cols, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_warn", "n_info")])
    total = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_warn", "n_info")])
    return per.unionByName(total.select(*[F.lit("*").alias(c) for c in ns_cols], "n_warn", "n_info"))


def dry_run(schema: DataFrame, warnings: DataFrame, dialect: str, ns_cols: list[str]) -> DataFrame:
    """L4: what a migration would create, without a write: each inferred column with its name and type at the
    destination, whether it may be null there (a key may not), and how many warnings it has. One row per column."""
    from tidewater.functions.types import canonical_to_mysql, canonical_to_pg
    from tidewater.operators.mapping import destination_schema
    at = canonical_to_pg if dialect == "pg" else canonical_to_mysql
    named = destination_schema(schema, dialect, ns_cols).select(
        *ns_cols, "ordinal", "column_name", F.col("final_name").alias("dest_name"), at(F.col("type")).alias("dest_type"),
        (F.col("nullable") & ~F.col("primary_key")).alias("nullable"), "primary_key")
    told = warnings.filter(F.col("column_name").isNotNull()).groupBy(*ns_cols, "column_name").agg(F.count(F.lit(1)).cast("long").alias("n_warnings"))
    return named.join(told, [*ns_cols, "column_name"], "left").withColumn("n_warnings", F.coalesce("n_warnings", F.lit(0).cast("long")))
