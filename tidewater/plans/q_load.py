"""Queries for load accounting and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import infer, load
from tidewater.operators import mapping as mp
from tidewater.operators.mapping import Col
from tidewater.plans.fixture_sql import F1_TEXT, F2, with_ctes
from tidewater.plans.q_mapping import crm_docs, crm_schema
from tidewater.plans.registry import query
from tidewater.sources import batch_sink
from tidewater.sources import fixtures as fx
from tidewater.sources.tables import read_table

NS = ["coll"]


def load_cols(spark, sf_dir) -> list[Col]:
    """The destination schema: as inferred, except ``score`` declared ``int``
    (as a sample of integral scores would have typed it)."""
    return [Col(c.name, "int") if c.name == "score" else c for c in crm_schema(spark, sf_dir)]


def run_load(spark, sf_dir):
    """Documents -> PG rows; rejects fail, keys already loaded by an earlier
    partial run (doc_id % 3 = 0) are skipped, the rest written."""
    docs = crm_docs(spark, sf_dir)
    mapped, rejects, _ = mp.map_doc_to_sql(docs, load_cols(spark, sf_dir), "pg", keep=["database", "coll", "doc_id"])
    failed = rejects.withColumn("error", F.concat(F.lit("invalid value for "), F.col("failed_columns")))
    existing = docs.filter(F.col("doc_id") % 3 == 0).select("doc_id")
    written, skipped = load.insert_only(mapped, existing, "doc_id", ["database", "coll"])
    return written, skipped, failed


def outcome(spark, sf_dir):
    """L1 from one pass over the mapped documents."""
    docs = crm_docs(spark, sf_dir)
    rows = mp.map_doc_rows(docs, load_cols(spark, sf_dir), "pg", keep=["database", "coll", "doc_id"])
    existing = docs.filter(F.col("doc_id") % 3 == 0).select("doc_id")
    return load.outcome_one_pass(rows, existing, "doc_id", ["database", "coll"], F.size("_bad") > 0,
                                 F.concat(F.lit("invalid value for "), F.array_join("_bad", ",")))


LOAD_SQL = with_ctes(F1_TEXT) + """,
d AS (
  SELECT database, coll, doc_id,
         coalesce(json_type(doc_text, '$.score') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
                  AND CAST(json_extract(doc_text, '$.score') AS DOUBLE) <> floor(CAST(json_extract(doc_text, '$.score') AS DOUBLE)), false) AS bad
  FROM f1t WHERE database = 'crm' AND coll NOT LIKE 'system.%'
),
out AS (
  SELECT database, coll,
         CAST(count(*) FILTER (WHERE NOT bad AND doc_id % 3 <> 0) AS BIGINT) AS written,
         CAST(count(*) FILTER (WHERE NOT bad AND doc_id % 3 = 0) AS BIGINT) AS skipped,
         CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS failed,
         CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN 'invalid value for score' END AS last_error
  FROM d GROUP BY database, coll
),
ver AS (
  SELECT *, CASE WHEN failed > 0 AND written = 0 THEN 'failed' ELSE 'succeeded' END AS verdict,
         CASE WHEN failed > 0 AND written > 0 THEN last_error END AS error_entry
  FROM out
)"""


@query("load_outcome", LOAD_SQL + "SELECT * FROM out")
def load_outcome(spark, sf_dir):
    """L1: written / skipped / failed per namespace with the last error."""
    return outcome(spark, sf_dir)


@query("load_verdict", LOAD_SQL + "SELECT * FROM ver")
def load_verdict(spark, sf_dir):
    """L2: per-namespace verdict and error entry."""
    return load.verdict(outcome(spark, sf_dir))


@query("run_rollup", LOAD_SQL + """
SELECT database, CAST(count(*) AS BIGINT) AS namespaces, CAST(count(*) FILTER (WHERE verdict = 'failed') AS BIGINT) AS failed_namespaces,
       CAST(sum(written) AS BIGINT) AS written, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(failed) AS BIGINT) AS failed,
       CAST(count(error_entry) AS BIGINT) AS errors,
       CASE WHEN count(*) > 0 AND count(*) FILTER (WHERE verdict = 'failed') = count(*) THEN 'failed'
            WHEN count(*) FILTER (WHERE verdict = 'failed') > 0 OR count(error_entry) > 0 OR sum(failed) > 0 THEN 'partial'
            ELSE 'succeeded' END AS phase
FROM ver GROUP BY database""")
def run_rollup(spark, sf_dir):
    """L3: run phase from the namespace verdicts."""
    return load.rollup(load.verdict(outcome(spark, sf_dir)), ["database"])


@query("snapshot_gate", LOAD_SQL + """
SELECT database, count(*) FILTER (WHERE verdict = 'failed' OR failed > 0) > 0 AS blocked,
       CASE WHEN count(*) FILTER (WHERE verdict = 'failed' OR failed > 0) > 0 THEN
         array_to_string(list(CASE WHEN verdict = 'failed' THEN coalesce(last_error, 'namespace failed') ELSE last_error END
                              ORDER BY coll) FILTER (WHERE verdict = 'failed' OR failed > 0)[1:3], ' | ') END AS reason
FROM ver GROUP BY database""")
def snapshot_gate(spark, sf_dir):
    """CDC tailing is blocked by a failed namespace, failed rows or errors."""
    return load.gate(load.verdict(outcome(spark, sf_dir)), ["database"], ["coll"])


@query("load_insert_only", LOAD_SQL + """
SELECT database, coll, doc_id FROM d WHERE NOT bad AND doc_id % 3 <> 0""")
def load_insert_only(spark, sf_dir):
    """Rows actually inserted (existing keys and in-load duplicates skipped)."""
    written, _, _ = run_load(spark, sf_dir)
    return written.select("database", "coll", "doc_id")


@query("load_batch_atomic", LOAD_SQL + """
SELECT dialect, coll, batch_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS bad_rows,
       CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN 'failed' ELSE 'written' END AS status,
       CAST(CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN 0 ELSE count(*) END AS BIGINT) AS written
FROM (SELECT 'pg' AS dialect, coll, doc_id // 1000 AS batch_id, bad FROM d
      UNION ALL SELECT 'mysql', coll, doc_id // 500, bad FROM d)
GROUP BY dialect, coll, batch_id""")
def load_batch_atomic(spark, sf_dir):
    """S9 (PG COPY, 1000-row batches) and S10 (MySQL, 500-row chunks): a batch
    or chunk with any bad row writes nothing. Batches are key ranges; what is
    counted is what landed."""
    return _landed_batches(spark, sf_dir, lambda rows, size: rows.withColumn("_batch", F.floor(F.col("doc_id") / size)))


@query("load_batch_chunks", LOAD_SQL + """,
b AS (SELECT 'pg' AS dialect, coll, doc_id, bad, (row_number() OVER (PARTITION BY coll ORDER BY doc_id) - 1) // 1000 AS batch_id FROM d
      UNION ALL SELECT 'mysql', coll, doc_id, bad, (row_number() OVER (PARTITION BY coll ORDER BY doc_id) - 1) // 500 FROM d)
SELECT dialect, coll, batch_id, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS bad_rows,
       CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN 'failed' ELSE 'written' END AS status,
       CAST(CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN 0 ELSE count(*) END AS BIGINT) AS written
FROM b GROUP BY dialect, coll, batch_id""")
def load_batch_chunks(spark, sf_dir):
    """Full batches of consecutive rows per collection, written
    batch by batch; a bad row takes its batch with it and no other."""
    return _landed_batches(spark, sf_dir, lambda rows, size: batch_sink.chunks(rows, NS, "doc_id", size))


def _landed_batches(spark, sf_dir, cut):
    """The load through the batch writer in the batch size of each dialect.
    A row is bad by the strict conversion of the declared columns, the same
    for both; counts of rows come from the writer, ``written`` from the files."""
    from tidewater.session import checkpoint_dir
    docs, cols = crm_docs(spark, sf_dir), load_cols(spark, sf_dir)
    rows = mp.map_doc_rows(docs, cols, "pg", keep=["coll", "doc_id"])
    error = F.when(F.size("_bad") > 0, F.concat(F.lit("invalid value for "), F.array_join("_bad", ",")))
    rows = rows.withColumn("_why", error)
    out = None
    for dialect, size in batch_sink.BATCH_ROWS.items():
        path = checkpoint_dir(spark, f"load_batches_{dialect}")
        batch_sink.write_batches(cut(rows, size), F.col("_why"), path, "run-1", NS, F.col("_batch"))
        told = batch_sink.outcomes(spark, path, rows.select(*NS).schema)
        found = batch_sink.landed(spark, path, rows.schema).groupBy(*NS, "_batch").agg(F.count(F.lit(1)).alias("written"))
        part = told.join(found, [*NS, "_batch"], "left").select(
            F.lit(dialect).alias("dialect"), "coll", F.col("_batch").alias("batch_id"), "rows", "bad_rows",
            F.when(F.col("bad_rows") > 0, F.lit("failed")).otherwise(F.lit("written")).alias("status"),
            F.coalesce("written", F.lit(0)).cast("long").alias("written"))
        out = part if out is None else out.unionByName(part)
    return out


@query("preview_totals", with_ctes(F1_TEXT) + """,
kv AS (SELECT coll, key FROM f1t, unnest(json_keys(doc_text)) AS t(key) WHERE database = 'crm' AND coll NOT LIKE 'system.%'),
nd AS (SELECT coll, count(*) AS n_docs FROM f1t WHERE database = 'crm' AND coll NOT LIKE 'system.%' GROUP BY coll),
per AS (SELECT coll, count(DISTINCT key) AS n_columns FROM kv GROUP BY coll)
SELECT coll, CAST(n_columns AS BIGINT) AS n_columns, CAST(n_docs AS BIGINT) AS approx_count FROM per JOIN nd USING (coll)
UNION ALL
SELECT '*', CAST(count(*) AS BIGINT), CAST(sum(coalesce(n_docs, 0)) AS BIGINT) FROM per JOIN nd USING (coll)""")
def preview_totals(spark, sf_dir):
    """Dry-run preview: columns and approximate count per namespace,
    plus a totals row ('*': number of schemas, summed counts)."""
    s = infer.infer_schema(crm_docs(spark, sf_dir), ns_cols=("coll",))
    per = s.groupBy("coll").agg(F.count(F.lit(1)).cast("long").alias("n_columns"),
                                F.max("n_docs").cast("long").alias("approx_count"))
    tot = per.agg(F.count(F.lit(1)).cast("long").alias("n_columns"),
                  F.sum(F.coalesce("approx_count", F.lit(0))).cast("long").alias("approx_count")) \
             .select(F.lit("*").alias("coll"), "n_columns", "approx_count")
    return per.unionByName(tot)


@query("progress_pct", LOAD_SQL + """
SELECT coll, CAST(least(100, floor(written / n * 100 + 0.5)) AS BIGINT) AS pct FROM (
  SELECT coll, written, (SELECT count(*) FROM d WHERE d.coll = out.coll) AS n FROM out)
UNION ALL
SELECT 'archive_' || lower(replace(r_name, ' ', '_')), CAST(100 AS BIGINT) FROM region""")
def progress_pct(spark, sf_dir):
    """Progress of each namespace; namespaces without a total (the empty
    region archives) are done, hence 100."""
    out = outcome(spark, sf_dir)
    totals = crm_docs(spark, sf_dir).groupBy("coll").agg(F.count(F.lit(1)).alias("n"))
    p = out.join(totals, "coll").select("coll", load.progress_pct(F.col("written"), F.col("n"), F.lit(True)).alias("pct"))
    r = read_table(spark, sf_dir, "region").select(
        F.concat(F.lit("archive_"), F.lower(F.regexp_replace("r_name", " ", "_"))).alias("coll"))
    empty = r.select("coll", load.progress_pct(F.lit(0), F.lit(None).cast("long"), F.lit(True)).alias("pct"))
    return p.unionByName(empty)


@query("identity_next", with_ctes(F2) + """
SELECT f2.table_name, CAST(coalesce(max(l.l_orderkey), 0) + 1 AS BIGINT) AS next_value
FROM f2 LEFT JOIN lineitem l ON l.l_partkey = f2.table_key
WHERE f2.ordinal = 1 AND (f2.is_identity = 'YES' OR f2.column_default IS NOT NULL)
GROUP BY f2.table_name""")
def identity_next(spark, sf_dir):
    """Next identity value per auto-increment table: coalesce(max(id), 0) + 1
    (ids of table t_<k> are the order keys of lineitems of part k)."""
    c = fx.f2_catalog(spark, sf_dir).filter((F.col("ordinal") == 1) & ((F.col("is_identity") == "YES")
                                                                    | F.col("column_default").isNotNull()))
    ids = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("table_key")) \
        .agg(F.max("l_orderkey").alias("max_id"))
    return c.join(ids, "table_key", "left").select(
        "table_name", (F.coalesce("max_id", F.lit(0)) + 1).cast("long").alias("next_value"))


@query("reconcile_counts", LOAD_SQL + """
SELECT coll, CAST(count(*) AS BIGINT) AS src_rows, CAST(count(*) FILTER (WHERE NOT bad) AS BIGINT) AS dst_rows,
       CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS diff, count(*) FILTER (WHERE bad) = 0 AS matches
FROM d GROUP BY coll""")
def reconcile_counts(spark, sf_dir):
    """Source vs destination counts (destination = rows already there
    plus rows written), diff and an order-free fingerprint match."""
    docs = crm_docs(spark, sf_dir).select("coll", "doc_id")
    written, skipped, _ = run_load(spark, sf_dir)
    existing = docs.filter(F.col("doc_id") % 3 == 0).join(
        skipped.select("coll", "doc_id"), ["coll", "doc_id"], "left_semi")
    dst = written.select("coll", "doc_id").unionByName(existing)
    return load.reconcile(docs, dst, ["coll"], "doc_id")


@query("load_write", LOAD_SQL + """
SELECT database, coll, CASE WHEN bad THEN 'rejected' ELSE 'written' END AS status, CAST(count(*) AS BIGINT) AS n_rows,
       max(CASE WHEN bad THEN 'invalid value for score' END) AS error
FROM d GROUP BY 1, 2, 3""")
def load_write(spark, sf_dir):
    """The load written once (valid rows and rejects in one job,
    partitioned by status under the shared folder) and counted back."""
    from tidewater.session import checkpoint_dir
    docs = crm_docs(spark, sf_dir)
    rows = mp.map_doc_rows(docs, load_cols(spark, sf_dir), "pg", keep=["database", "coll", "doc_id"])
    return load.write_load(rows, F.size("_bad") > 0,
                           F.concat(F.lit("invalid value for "), F.array_join("_bad", ",")),
                           checkpoint_dir(spark, "load_target"), ["database", "coll"])


STRICT = "FURNITURE"


@query("load_parallel", LOAD_SQL + f"""
SELECT coll, CASE WHEN coll = '{STRICT}' AND count(*) FILTER (WHERE bad) > 0 THEN 'failed' ELSE 'written' END AS status,
       CAST(CASE WHEN coll = '{STRICT}' AND count(*) FILTER (WHERE bad) > 0 THEN 0 ELSE count(*) FILTER (WHERE NOT bad) END AS BIGINT) AS n_rows,
       CASE WHEN coll = '{STRICT}' AND count(*) FILTER (WHERE bad) > 0 THEN 'invalid value for score' END AS error
FROM d GROUP BY coll""")
def load_parallel(spark, sf_dir):
    """The collections loaded side by side, each written to a table of its own; one of them is loaded strictly (its
    first bad row ends it) and fails without touching the others."""
    from tidewater.session import checkpoint_dir
    docs, cols = crm_docs(spark, sf_dir), load_cols(spark, sf_dir)
    names = sorted(r.coll for r in docs.select("coll").distinct().collect())  # the namespaces to load
    out = checkpoint_dir(spark, "load_parallel")

    def work(name):
        rows = mp.map_doc_rows(docs.filter(F.col("coll") == name), cols, "pg", keep=["database", "coll", "doc_id"])
        error = F.concat(F.lit("invalid value for "), F.array_join("_bad", ","))
        bad = F.size("_bad") > 0
        if name == STRICT:
            bad = F.when(bad, F.raise_error(error).cast("boolean")).otherwise(F.lit(False))
        counts = load.write_load(rows, bad, error, f"{out}/{name}", ["coll"])
        return counts.filter(F.col("status") == "written").select(F.col("coll").alias("namespace"), "n_rows")

    found = load.in_parallel(spark, names, work)
    error = F.regexp_extract("error", "invalid value for \\w+", 0)
    return found.select(F.col("namespace").alias("coll"), "status", "n_rows", F.when(F.col("error").isNotNull(), F.when(error != "", error).otherwise(F.col("error"))).alias("error"))
