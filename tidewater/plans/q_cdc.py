"""Queries for change data capture in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.windows import split_cumsum
from tidewater.operators import cdc
from tidewater.plans.fixture_sql import F3, F3_RAW_MONGO, F3_RAW_MYSQL, F3_RAW_PG, with_ctes
from tidewater.plans.registry import query
from tidewater.sources import fixtures as fx
from tidewater.sources.tables import read_table

KEY = "o_orderkey"
COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
           "o_orderpriority": "string"}
ALLOWED = [("shop", "orders")]
AS_OF_MS = 1009843200000  # 2002-01-01T00:00:00Z


# ---- Spark building blocks --------------------------------------------------------------------
def target(spark, sf_dir):
    """The snapshot already loaded at the destination: orders with even keys."""
    return read_table(spark, sf_dir, "orders").filter(F.col(KEY) % 2 == 0).select(*COLUMNS)


def clean_events(spark, sf_dir, dedupe: bool = True):
    """C4 + C13 + C15: configured namespace, redeliveries dropped, poison split
    off. Applying needs no de-dup (apply is idempotent under redelivery), so
    the apply queries skip that shuffle; counts and listings keep it."""
    ev = cdc.filter_namespaces(fx.f3_changes(spark, sf_dir).drop("delivery"), ALLOWED)
    if dedupe:
        ev = cdc.drop_redeliveries(ev)
    return cdc.validate(ev, COLUMNS, KEY)


# ---- DuckDB twins ------------------------------------------------------------------------------
def _valid_pred(doc="doc"):
    conds = ["key IS NOT NULL"]
    for c, t in COLUMNS.items():
        if c == KEY:
            continue
        st = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}[t]
        conds.append(f"NOT (json_extract_string({doc}, '$.{c}') IS NOT NULL AND "
                     f"TRY_CAST(json_extract_string({doc}, '$.{c}') AS {st}) IS NULL)")
    return " AND ".join(conds)


CLEAN_SQL = with_ctes(F3) + f""",
ev AS (SELECT * FROM f3 WHERE db = 'shop' AND coll = 'orders'),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db, coll, key, pos_hi, pos_lo, pos_seq ORDER BY delivery) AS rn
                      FROM ev) WHERE rn = 1),
valid AS (SELECT *, pos_hi * 1000000000000 + pos_lo * 100 + pos_seq AS p FROM dd WHERE {_valid_pred()}),
dead AS (SELECT * FROM dd WHERE NOT ({_valid_pred()}))"""


def _upsert_sql(tgt: str, evs: str) -> str:
    sel, per = [], []
    for c, t in COLUMNS.items():
        if c == KEY:
            continue
        st = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}[t]
        per.append(f"arg_max_null(TRY_CAST(json_extract_string(doc, '$.{c}') AS {st}), p) "
                   f"FILTER (WHERE json_exists(doc, '$.{c}')) AS {c}_v, bool_or(json_exists(doc, '$.{c}')) AS {c}_has")
        sel.append(f"CASE WHEN ch.{c}_has THEN ch.{c}_v WHEN ch.d IS NOT NULL THEN NULL ELSE t.{c} END AS {c}")
    return f"""
dels AS (SELECT key, max(CASE WHEN op = 'delete' THEN p END) AS d, arg_max(op, p) AS last_op FROM {evs} GROUP BY key),
live AS (SELECT e.* FROM {evs} e JOIN dels USING (key) WHERE e.op <> 'delete' AND (dels.d IS NULL OR e.p > dels.d)),
per AS (SELECT key, {", ".join(per)} FROM live GROUP BY key),
ch AS (SELECT * FROM dels LEFT JOIN per USING (key)),
applied AS (
  SELECT coalesce(t.{KEY}, ch.key) AS {KEY}, {", ".join(sel)}
  FROM {tgt} t FULL OUTER JOIN ch ON t.{KEY} = ch.key
  WHERE ch.last_op IS NULL OR ch.last_op <> 'delete'
)"""


TARGET_SQL = f"tgt AS (SELECT {', '.join(COLUMNS)} FROM orders WHERE o_orderkey % 2 = 0)"


# ---- C1-C3 ----------------------------------------------------------------------------------------
@query("cdc_norm_doc", with_ctes(F3, F3_RAW_MONGO) + """
SELECT db, coll, op, key, pos_hi, pos_lo, CAST(0 AS BIGINT) AS pos_seq, pos_hi * 1000 AS committed_ms, arrival,
       json_extract_string(fulldoc, '$.o_orderstatus') AS status
FROM (SELECT arrival,
             CASE WHEN t IN ('insert', 'replace') THEN 'insert' WHEN t = 'update' THEN 'update' WHEN t = 'delete' THEN 'delete' END AS op,
             json_extract_string(raw, '$.ns.db') AS db, json_extract_string(raw, '$.ns.coll') AS coll,
             CAST(json_extract(raw, '$.documentKey._id') AS BIGINT) AS key, json_extract(raw, '$.fullDocument') AS fulldoc,
             CAST(json_extract(raw, '$.clusterTime.t') AS BIGINT) AS pos_hi, CAST(json_extract(raw, '$.clusterTime.i') AS BIGINT) AS pos_lo
      FROM (SELECT *, json_extract_string(raw, '$.operationType') AS t FROM f3mongo))
WHERE op IS NOT NULL AND coll IS NOT NULL AND (op = 'delete' OR fulldoc IS NOT NULL)""")
def cdc_norm_doc(spark, sf_dir):
    """Document change-stream messages -> normalised events."""
    n = cdc.normalise_mongo(fx.f3_raw_mongo(spark, sf_dir))
    return n.select("db", "coll", "op", "key", "pos_hi", "pos_lo", "pos_seq", "committed_ms", "arrival",
                    F.get_json_object("doc", "$.o_orderstatus").alias("status"))


@query("cdc_norm_pg", with_ctes(F3, F3_RAW_PG) + """
SELECT db, coll, op, key, pos_hi, pos_lo, arrival, json_extract_string(doc, '$.o_orderstatus') AS status
FROM (SELECT arrival, json_extract_string(raw, '$.schema') AS db, json_extract_string(raw, '$.table') AS coll,
             CASE json_extract_string(raw, '$.action') WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' WHEN 'D' THEN 'delete' END AS op,
             CAST(coalesce(json_extract(raw, '$.columns.o_orderkey'), json_extract(raw, '$.identity.o_orderkey'),
                           json_extract(raw, '$.old.o_orderkey')) AS BIGINT) AS key,
             json_extract(raw, '$.columns') AS doc,
             CAST('0x' || split_part(json_extract_string(raw, '$.lsn'), '/', 1) AS BIGINT) AS pos_hi,
             CAST('0x' || split_part(json_extract_string(raw, '$.lsn'), '/', 2) AS BIGINT) AS pos_lo
      FROM f3pg)
WHERE op IS NOT NULL""")
def cdc_norm_pg(spark, sf_dir):
    """C2 (+C5 LSN): logical-decoding rows -> normalised events ordered by LSN."""
    n = cdc.normalise_pg(fx.f3_raw_pg(spark, sf_dir), KEY)
    return n.select("db", "coll", "op", "key", "pos_hi", "pos_lo", "arrival",
                    F.get_json_object("doc", "$.o_orderstatus").alias("status"))


@query("cdc_norm_mysql", with_ctes(F3, F3_RAW_MYSQL) + """,
filled AS (
  SELECT *, last_value(json_extract_string(raw, '$.next_file') IGNORE NULLS)
              OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file,
         json_extract_string(raw, '$.type') AS type
  FROM f3my
),
rws AS (
  SELECT f.*, r.row, r.ord - 1 AS ordinal
  FROM filled f, unnest(CAST(json_extract(raw, '$.rows') AS JSON[])) WITH ORDINALITY AS r(row, ord)
  WHERE type IN ('write_rows', 'update_rows', 'delete_rows')
),
n AS (
  SELECT json_extract_string(raw, '$.schema') AS db, json_extract_string(raw, '$.table') AS coll,
         CASE type WHEN 'write_rows' THEN 'insert' WHEN 'update_rows' THEN 'update' ELSE 'delete' END AS op,
         CASE type WHEN 'update_rows' THEN json_extract(row, '$.after') WHEN 'write_rows' THEN row END AS doc,
         row, CAST(split_part(file, '.', 2) AS BIGINT) AS pos_hi, CAST(json_extract(raw, '$.position') AS BIGINT) AS pos_lo,
         CAST(ordinal AS BIGINT) AS pos_seq, CAST(json_extract(raw, '$.timestamp') AS BIGINT) * 1000 AS committed_ms, arrival
  FROM rws
)
SELECT db, coll, op, CAST(json_extract(coalesce(doc, row), '$.o_orderkey') AS BIGINT) AS key, pos_hi, pos_lo, pos_seq,
       committed_ms, arrival, json_extract_string(doc, '$.o_orderstatus') AS status
FROM n""")
def cdc_norm_mysql(spark, sf_dir):
    """Binlog row messages -> one event per row, file carried from rotates."""
    n = cdc.normalise_mysql(fx.f3_raw_mysql(spark, sf_dir), KEY)
    return n.select("db", "coll", "op", "key", "pos_hi", "pos_lo", "pos_seq", "committed_ms", "arrival",
                    F.get_json_object("doc", "$.o_orderstatus").alias("status"))


# ---- C4-C6, C13 ---------------------------------------------------------------------------------------
@query("cdc_filter_ns", with_ctes(F3) + """
SELECT db, coll, op, key, pos_hi, pos_lo, pos_seq FROM f3 WHERE db = 'shop' AND coll = 'orders'""")
def cdc_filter_ns(spark, sf_dir):
    """C4: only the configured namespaces."""
    return cdc.filter_namespaces(fx.f3_changes(spark, sf_dir), ALLOWED).select(
        "db", "coll", "op", "key", "pos_hi", "pos_lo", "pos_seq")


@query("cdc_order", with_ctes(F3, F3_RAW_PG) + """,
n AS (
  SELECT json_extract_string(raw, '$.table') AS coll,
         CASE json_extract_string(raw, '$.action') WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' WHEN 'D' THEN 'delete' END AS op,
         CAST(coalesce(json_extract(raw, '$.columns.o_orderkey'), json_extract(raw, '$.identity.o_orderkey')) AS BIGINT) AS key,
         CAST('0x' || split_part(json_extract_string(raw, '$.lsn'), '/', 1) AS BIGINT) AS pos_hi,
         CAST('0x' || split_part(json_extract_string(raw, '$.lsn'), '/', 2) AS BIGINT) AS pos_lo
  FROM f3pg
),
d AS (SELECT DISTINCT coll, op, key, pos_hi, pos_lo FROM n WHERE op IS NOT NULL)
SELECT coll, key, op, pos_hi, pos_lo, row_number() OVER (PARTITION BY coll, key ORDER BY pos_hi, pos_lo) AS seq_in_key FROM d""")
def cdc_order(spark, sf_dir):
    """Events in explicit position order (LSN halves), numbered per key
    (a running count bucketed by the LSN's high half, so a hot key is split)."""
    n = cdc.drop_redeliveries(cdc.normalise_pg(fx.f3_raw_pg(spark, sf_dir), KEY))
    n = split_cumsum(n, ["coll", "key"], ["pos_hi", "pos_lo"], F.col("pos_hi"), F.lit(1), "seq_in_key")
    return n.select("coll", "key", "op", "pos_hi", "pos_lo", F.col("seq_in_key").cast("long").alias("seq_in_key"))


@query("cdc_redelivery", with_ctes(F3) + """
SELECT DISTINCT db, coll, op, key, pos_hi, pos_lo FROM f3""")
def cdc_redelivery(spark, sf_dir):
    """Redelivered events appear once."""
    return cdc.drop_redeliveries(fx.f3_changes(spark, sf_dir)).select("db", "coll", "op", "key", "pos_hi", "pos_lo")


@query("cdc_collapse", CLEAN_SQL + """
SELECT db, coll, key, arg_max(op, p) AS op, max(p) // 1000000000000 AS pos_hi, CAST(count(*) AS BIGINT) AS n_events,
       json_extract_string(arg_max_null(doc, p), '$.o_orderstatus') AS status
FROM valid GROUP BY db, coll, key""")
def cdc_collapse(spark, sf_dir):
    """The last event per key."""
    valid, _ = clean_events(spark, sf_dir)
    c = cdc.collapse(valid)
    return c.select("db", "coll", "key", "op", "pos_hi", "n_events", F.get_json_object("doc", "$.o_orderstatus").alias("status"))


# ---- C7-C12 ------------------------------------------------------------------------------------------------
@query("cdc_apply_upsert", CLEAN_SQL + ",\n" + TARGET_SQL + "," + _upsert_sql("tgt", "valid") + """
SELECT * FROM applied""")
def cdc_apply_upsert(spark, sf_dir):
    """SQL-target apply (present columns only, deletes reset)."""
    valid, _ = clean_events(spark, sf_dir, dedupe=False)
    return cdc.apply_upsert(target(spark, sf_dir), valid, KEY, COLUMNS)


@query("cdc_apply_replace", CLEAN_SQL + ",\n" + TARGET_SQL + f""",
last AS (SELECT key, arg_max(op, p) AS last_op, arg_max(doc, p) AS doc FROM valid GROUP BY key)
SELECT coalesce(t.o_orderkey, l.key) AS o_orderkey,
       CASE WHEN l.last_op IS NULL THEN t.o_custkey ELSE TRY_CAST(json_extract_string(l.doc, '$.o_custkey') AS BIGINT) END AS o_custkey,
       CASE WHEN l.last_op IS NULL THEN t.o_orderstatus ELSE json_extract_string(l.doc, '$.o_orderstatus') END AS o_orderstatus,
       CASE WHEN l.last_op IS NULL THEN t.o_totalprice ELSE TRY_CAST(json_extract_string(l.doc, '$.o_totalprice') AS DOUBLE) END AS o_totalprice,
       CASE WHEN l.last_op IS NULL THEN t.o_orderpriority ELSE json_extract_string(l.doc, '$.o_orderpriority') END AS o_orderpriority
FROM tgt t FULL OUTER JOIN last l ON t.o_orderkey = l.key
WHERE l.last_op IS NULL OR l.last_op <> 'delete'""")
def cdc_apply_replace(spark, sf_dir):
    """Document-target apply (last whole document wins)."""
    valid, _ = clean_events(spark, sf_dir, dedupe=False)
    return cdc.apply_replace(target(spark, sf_dir), valid, KEY, COLUMNS)


def _key_only_events(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").filter(F.col(KEY) % 9 == 0)
    return o.select(F.lit("shop").alias("db"), F.lit("orders").alias("coll"), F.lit("insert").alias("op"),
                    F.col(KEY).alias("key"), F.concat(F.lit('{"o_orderkey":'), F.col(KEY).cast("string"), F.lit("}")).alias("doc"),
                    F.lit(4).cast("long").alias("pos_hi"), F.col(KEY).alias("pos_lo"), F.lit(0).cast("long").alias("pos_seq"),
                    F.lit(None).cast("long").alias("committed_ms"))


@query("cdc_key_only", with_ctes(TARGET_SQL) + """,
ko AS (SELECT o_orderkey AS key, 'insert' AS op, '{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || '}' AS doc,
              4 * 1000000000000 + o_orderkey * 100 AS p FROM orders WHERE o_orderkey % 9 = 0),""" + _upsert_sql("tgt", "ko") + """
SELECT * FROM applied""")
def cdc_key_only(spark, sf_dir):
    """Key-only rows insert when absent and change nothing otherwise."""
    return cdc.apply_upsert(target(spark, sf_dir), _key_only_events(spark, sf_dir), KEY, COLUMNS)


@query("cdc_snapshot_tail", CLEAN_SQL + ",\n" + TARGET_SQL + """,
snap AS (
  SELECT o_orderkey AS key, 'insert' AS op,
         json_object('o_orderkey', o_orderkey, 'o_custkey', o_custkey, 'o_orderstatus', o_orderstatus,
                     'o_totalprice', o_totalprice, 'o_orderpriority', o_orderpriority) AS doc,
         CAST(-1 AS BIGINT) AS p
  FROM tgt
),
tail AS (SELECT key, op, doc, p FROM valid WHERE pos_hi >= 1),
both_ AS (SELECT * FROM snap UNION ALL SELECT * FROM tail),
empty_t AS (SELECT * FROM tgt WHERE false),""" + _upsert_sql("empty_t", "both_") + """
SELECT * FROM applied""")
def cdc_snapshot_tail(spark, sf_dir):
    """Snapshot rows at position minus infinity plus the tail from
    the start position (step 1), applied to an empty destination."""
    valid, _ = clean_events(spark, sf_dir, dedupe=False)
    tgt = target(spark, sf_dir)
    return cdc.bootstrap(tgt, tgt, valid, KEY, COLUMNS, "snapshot", (1, 0, 0), "shop", "orders")


@query("cdc_resume", CLEAN_SQL + """,
ck AS (SELECT max(p) AS p FROM valid WHERE pos_hi = 0)
SELECT key, op, pos_hi, pos_lo, pos_seq FROM valid WHERE p > (SELECT p FROM ck)""")
def cdc_resume(spark, sf_dir):
    """Resume strictly after the last applied position (here: the end
    of step 0, read back from the applied events as one scalar)."""
    valid, _ = clean_events(spark, sf_dir)
    ck = valid.filter(F.col("pos_hi") == 0).agg(F.max(cdc.position()).alias("p")).first()["p"]
    start = tuple(ck) if ck is not None else (-1, -1, -1)      # nothing applied yet: from the beginning
    return cdc.after_position(valid, *start).select(
        "key", "op", "pos_hi", "pos_lo", "pos_seq")


# ---- C14-C16, C20 ---------------------------------------------------------------------------------------------
_ALL_SQL = with_ctes(F3) + f""",
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db, coll, key, pos_hi, pos_lo, pos_seq ORDER BY delivery) AS rn
                      FROM f3) WHERE rn = 1),
valid AS (SELECT * FROM dd WHERE {_valid_pred()}),
dead AS (SELECT *, pos_hi * 1000000000000 + pos_lo * 100 + pos_seq AS p,
                'o_totalprice: cannot convert to double' AS error FROM dd WHERE NOT ({_valid_pred()})),
cnt AS (
  SELECT coalesce(v.coll, d.coll) AS coll, CAST(coalesce(v.inserts, 0) AS BIGINT) AS inserts,
         CAST(coalesce(v.updates, 0) AS BIGINT) AS updates, CAST(coalesce(v.deletes, 0) AS BIGINT) AS deletes,
         CAST(coalesce(d.errors, 0) AS BIGINT) AS errors, v.last_event_ms, d.last_error,
         CASE WHEN coalesce(d.errors, 0) > 0 THEN 'failed' ELSE 'tailing' END AS status
  FROM (SELECT coll, count(*) FILTER (WHERE op = 'insert') AS inserts, count(*) FILTER (WHERE op = 'update') AS updates,
               count(*) FILTER (WHERE op = 'delete') AS deletes, max(committed_ms) AS last_event_ms
        FROM valid GROUP BY coll) v
  FULL OUTER JOIN (SELECT coll, count(*) AS errors, arg_max(error, p) AS last_error FROM dead GROUP BY coll) d USING (coll)
)"""


def _counters(spark, sf_dir):
    ev = cdc.drop_redeliveries(fx.f3_changes(spark, sf_dir))
    valid, dead = cdc.validate(ev, COLUMNS, KEY)
    return cdc.run_counters(valid, dead, ["coll"])


@query("cdc_counts", _ALL_SQL + "SELECT * FROM cnt")
def cdc_counts(spark, sf_dir):
    """Per-run counters, last event time, last error and final status."""
    return _counters(spark, sf_dir)


@query("cdc_dead_letter", _ALL_SQL + """
SELECT coll, key, op, pos_hi, pos_lo, error FROM dead""")
def cdc_dead_letter(spark, sf_dir):
    """Poison events kept with their position and error, not lost."""
    ev = cdc.drop_redeliveries(fx.f3_changes(spark, sf_dir))
    _, dead = cdc.validate(ev, COLUMNS, KEY)
    return dead.select("coll", "key", "op", "pos_hi", "pos_lo", "error")


@query("cdc_freshness", _ALL_SQL + f"""
SELECT coll, CAST(floor(({AS_OF_MS} - last_event_ms) / 1000) AS BIGINT) AS seconds_since_event,
       inserts, updates, deletes FROM cnt""")
def cdc_freshness(spark, sf_dir):
    """C20: seconds since the last event (floor; null when none) and the run's counters."""
    c = _counters(spark, sf_dir)
    return c.select("coll", F.floor((F.lit(AS_OF_MS) - F.col("last_event_ms")) / 1000).cast("long").alias("seconds_since_event"),
                    "inserts", "updates", "deletes")
