"""Change data capture in batch (C1-C16, C20): normalise raw change logs,
order them by an explicit position, drop redeliveries, collapse, and apply
them to a target table.

Every step is keyed: changes are pre-aggregated per key (partial
aggregation absorbs a hot key) and merged with one full outer join, so the
target is rewritten as a new version rather than updated row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import keys as keys_of
from tidewater.functions.windows import range_ffill
from tidewater.sources.tables import computed_once

POS = ["pos_hi", "pos_lo", "pos_seq"]


# -- C1-C3 normalisers ---------------------------------------------------------------------
def parse_once(raw: DataFrame, schema: str, keep: list[str], col: str = "raw") -> DataFrame:
    """Parse each message once and expose its fields as columns. The struct
    is expanded by a generator (``inline``), so the optimizer cannot split
    one ``from_json`` into one pruned parse per accessed field."""
    return raw.select(*keep, F.inline(F.array(F.from_json(F.col(col), schema))))


MONGO_MSG = ("operationType string, ns struct<db:string,coll:string>, documentKey struct<_id:bigint>, "
             "fullDocument string, clusterTime struct<t:bigint,i:bigint>")


def normalise_mongo(raw: DataFrame, any_key: bool = False) -> DataFrame:
    """``any_key``: documents are keyed by values of any type (object ids, text, numbers, documents), and ``key`` is their
    canonical text (see ``tidewater.functions.keys``); else by whole numbers.

    C1: insert/replace -> insert, update, delete; drop/invalidate/rename and
    messages without a namespace or (for insert/update) a fullDocument are
    skipped. Position (t, i); committedAt = t * 1000. Each message is parsed
    once (``from_json`` into a struct; the document stays JSON text)."""
    d = parse_once(raw, MONGO_MSG.replace("_id:bigint", "_id:variant") if any_key else MONGO_MSG, ["arrival"])
    key = keys_of.key(keys_of.of_variant(F.col("documentKey._id"))) if any_key else F.col("documentKey._id")
    t = F.col("operationType")
    op = (F.when(t.isin("insert", "replace"), F.lit("insert")).when(t == "update", F.lit("update"))
          .when(t == "delete", F.lit("delete")))
    d = d.select("arrival", op.alias("op"), F.col("ns.db").alias("db"), F.col("ns.coll").alias("coll"),
                 key.alias("key"), F.col("fullDocument").alias("full"),
                 F.col("clusterTime.t").alias("pos_hi"), F.col("clusterTime.i").alias("pos_lo"))
    d = d.filter(F.col("op").isNotNull() & F.col("coll").isNotNull()
                 & ((F.col("op") == "delete") | F.col("full").isNotNull()))
    return d.select("db", "coll", "op", "key", F.when(F.col("op") != "delete", F.col("full")).alias("doc"),
                    "pos_hi", "pos_lo", F.lit(0).cast("long").alias("pos_seq"),
                    (F.col("pos_hi") * 1000).alias("committed_ms"), "arrival")


def lsn_parts(lsn: Column) -> tuple[Column, Column]:
    """PG LSN 'X/Y' (hex) -> (hi, lo) as exact integers."""
    return (F.conv(F.split_part(lsn, F.lit("/"), F.lit(1)), 16, 10).cast("long"),
            F.conv(F.split_part(lsn, F.lit("/"), F.lit(2)), 16, 10).cast("long"))


def _texts(kinds: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"`{c}`:string" for c in kinds) + ">"


def _row_key(kinds: dict[str, str], *rows: Column) -> Column:
    """The canonical key of columns of the given SQL types, each from the first of the rows (structs of texts) that has it."""
    return keys_of.key(*[F.when(c.isNotNull(), keys_of.of_column(c, kind)) for name, kind in kinds.items() for c in [F.coalesce(*[r[name] for r in rows])]])


def normalise_pg(raw: DataFrame, key_col: str | dict[str, str]) -> DataFrame:
    """``key_col``: the key's column if it is a whole number, or its columns with their SQL types; ``key`` and
    ``old_key`` are canonical texts then (see ``tidewater.functions.keys``).

    C2: only I/U/D; the key comes from the row (``key ?? old``); truncate
    and transaction frames are dropped; no commit time. Position = LSN.
    ``old_key`` is the before-image key of an update (for ``split_key_changes``)."""
    one = isinstance(key_col, str)
    schema = "lsn string, action string, schema string, table string, columns string, " + (
        f"identity struct<{key_col}:bigint>, old struct<{key_col}:bigint>" if one else "identity {0}, old {0}".format(_texts(key_col)))
    d = parse_once(raw, schema, ["arrival"])
    action = F.col("action")
    hi, lo = lsn_parts(F.col("lsn"))
    op = F.when(action == "I", F.lit("insert")).when(action == "U", F.lit("update")).when(action == "D", F.lit("delete"))
    if one:
        key = F.coalesce(F.get_json_object(F.col("columns"), f"$.{key_col}").cast("long"),
                         F.col(f"identity.{key_col}"), F.col(f"old.{key_col}"))
        before = F.coalesce(F.col(f"old.{key_col}"), F.col(f"identity.{key_col}"))
    else:
        d = d.select("*", F.inline(F.array(F.struct(F.from_json("columns", _texts(key_col)).alias("_new")))))
        now, old, identity = F.col("_new"), F.col("old"), F.col("identity")
        key, before = _row_key(key_col, now, identity, old), _row_key(key_col, old, identity, now)
        before = F.when(old.isNotNull() | identity.isNotNull(), before)
    return (d.select(F.col("schema").alias("db"), F.col("table").alias("coll"), op.alias("op"),
                     key.alias("key"), F.col("columns").alias("doc"),
                     hi.alias("pos_hi"), lo.alias("pos_lo"), F.lit(0).cast("long").alias("pos_seq"),
                     F.lit(None).cast("long").alias("committed_ms"), "arrival",
                     F.when(op == "update", before).alias("old_key"))
            .filter(F.col("op").isNotNull()))


MYSQL_MSG = ("type string, next_file string, schema string, table string, position bigint, timestamp bigint, "
             "rows array<string>")


def normalise_mysql(raw: DataFrame, key_col: str | dict[str, str]) -> DataFrame:
    """``key_col``: as for ``normalise_pg``.

    C3: one binlog message carries many rows (posexplode); update rows take
    ``after``; the current file is carried forward from the last rotate
    (a forward fill over ranges of arrival, not a global window). Position = (file number,
    event position, row ordinal); commit time = timestamp * 1000."""
    d = parse_once(raw, MYSQL_MSG, ["arrival"])
    d = d.select("arrival", F.struct(*[F.col(c) for c in ("type", "schema", "table", "position", "timestamp", "rows")])
                 .alias("m"), "next_file")
    d = range_ffill(d, "arrival", "next_file", "file")
    ev = d.filter(F.col("m.type").isin("write_rows", "update_rows", "delete_rows"))
    ev = ev.select("arrival", "m", "file", F.posexplode("m.rows").alias("ordinal", "row"))
    typ = F.col("m.type")
    op = (F.when(typ == "write_rows", F.lit("insert")).when(typ == "update_rows", F.lit("update"))
          .otherwise(F.lit("delete")))
    doc = (F.when(typ == "update_rows", F.get_json_object("row", "$.after"))
           .when(typ == "write_rows", F.col("row")))
    if isinstance(key_col, str):
        key = F.get_json_object(F.coalesce(doc, F.col("row")), f"$.{key_col}").cast("long")
    else:
        ev = ev.select("*", F.inline(F.array(F.struct(F.from_json(F.coalesce(doc, F.col("row")), _texts(key_col)).alias("_keyed")))))
        key = _row_key(key_col, F.col("_keyed"))
    return ev.select(F.col("m.schema").alias("db"), F.col("m.table").alias("coll"), op.alias("op"), key.alias("key"),
                     doc.alias("doc"), F.split_part("file", F.lit("."), F.lit(2)).cast("long").alias("pos_hi"),
                     F.col("m.position").alias("pos_lo"), F.col("ordinal").cast("long").alias("pos_seq"),
                     (F.col("m.timestamp") * 1000).alias("committed_ms"), "arrival")


def split_key_changes(events: DataFrame, old_key: str = "old_key") -> DataFrame:
    """An update whose before-image key differs from its new key (a primary
    key change) becomes delete(old key) + insert(new row) at the same
    position; the delete sorts first (seq * 2 vs seq * 2 + 1). Without this
    the old row would stay behind. Other events keep their order. One pass: the
    log is read and parsed once."""
    cols = [c for c in events.columns if c != old_key]
    base = events.select(F.inline(F.array(F.struct(*events.columns)))).withColumn("pos_seq", F.col("pos_seq") * 2 + 1)
    changed = (F.col("op") == "update") & F.col(old_key).isNotNull() & (F.col(old_key) != F.col("key"))
    same = F.struct(*cols)
    gone = F.struct(*[F.lit("delete").alias(c) if c == "op" else F.col(old_key).alias(c) if c == "key"
                      else F.lit(None).cast("string").alias(c) if c == "doc"
                      else (F.col("pos_seq") - 1).alias(c) if c == "pos_seq" else F.col(c) for c in cols])
    new = F.struct(*[F.lit("insert").alias(c) if c == "op" else F.col(c) for c in cols])
    return base.select(F.inline(F.when(changed, F.array(gone, new)).when(~changed | F.col(old_key).isNull(), F.array(same))))


# -- C4, C5, C13 ------------------------------------------------------------------------------
def filter_namespaces(events: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """C4: keep configured namespaces (a literal IN list: the namespace
    configuration is small by construction and pushes down to the scan)."""
    cond = F.lit(False)
    for db, coll in allowed:
        cond = cond | ((F.col("db") == db) & (F.col("coll") == coll))
    return events.filter(cond)


def position(cols=POS) -> Column:
    return F.struct(*[F.col(c) for c in cols])


def drop_redeliveries(events: DataFrame, pos_cols=tuple(POS)) -> DataFrame:
    """At-least-once delivery -> one event per (namespace, key, position).
    The position includes the row ordinal, so several rows of one key in one
    log message all stay."""
    return events.dropDuplicates(["db", "coll", "key", *pos_cols])


# -- C15 validity ------------------------------------------------------------------------------
def validate(events: DataFrame, columns: dict[str, str], key: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Split events into (valid, dead_letter). An event is poison when it
    has no key or a present, non-null field does not convert to the target
    column type; the dead letter keeps the position and the error text."""
    errs = [F.when(F.col("key").isNull(), F.lit("missing key"))]
    d = computed_once(events, doc_map().alias("_dm"))
    for c, t in columns.items():
        if c in ([key] if isinstance(key, str) else key):
            continue
        raw = F.col("_dm")[c]
        errs.append(F.when(raw.isNotNull() & raw.try_cast(t).isNull(), F.lit(f"{c}: cannot convert to {t}")))
    d = d.withColumn("error", F.concat_ws("; ", F.array_compact(F.array(*errs)))).drop("_dm")
    bad = (F.col("error") != "")
    return d.filter(~bad).drop("error"), d.filter(bad)


# -- C6 ------------------------------------------------------------------------------------------
def collapse(events: DataFrame) -> DataFrame:
    """The last event per (namespace, key) by position (max_by is a
    partial aggregate, so a hot key is combined map-side)."""
    last = F.max_by(F.struct(*[F.col(c) for c in ["op", "doc", *POS, "committed_ms"]]), position())
    g = events.groupBy("db", "coll", "key").agg(last.alias("e"), F.count(F.lit(1)).alias("n_events"))
    return g.select("db", "coll", "key", "e.*", F.col("n_events").cast("long").alias("n_events"))


# -- C7-C9 apply ----------------------------------------------------------------------------------
def doc_map(doc: str = "doc") -> Column:
    """The event document parsed once: top-level field -> JSON value text
    (strings unquoted; a JSON null is a present key with a null value)."""
    return F.from_json(F.col(doc), "map<string,string>")


def _typed(c: str, t: str, m: str = "_m") -> Column:
    return F.col(m)[c].try_cast(t)


def _keyed_target(target: DataFrame, ns: list[str], key: str | list[str], columns: dict[str, str]) -> tuple[DataFrame, list[Column]]:
    """The target keyed as the events are (``key``: one native column, or a list of columns whose canonical text the
    events carry; other columns as ``<name>__t``), and the key columns of the merged rows."""
    names = [key] if isinstance(key, str) else list(key)
    rest = [F.col(c).alias(c + "__t") for c in columns if c not in names]
    if isinstance(key, str):
        return target.select(*ns, F.col(key).alias("key"), *rest), [F.col("key").alias(key)]
    canonical = keys_of.key(*[keys_of.of_column(F.col(c), columns[c]) for c in names])
    tgt = target.select(*ns, canonical.alias("key"), *[F.col(c).alias(c + "__k") for c in names], *rest)
    out = [F.coalesce(F.col(c + "__k"), keys_of.typed(keys_of.part(F.col("key"), i), columns[c])).cast(columns[c]).alias(c)
           for i, c in enumerate(names)]
    return tgt, out


def column_changes(events: DataFrame, ns: list[str], key: str | list[str], columns: dict[str, str]) -> DataFrame:
    """Per key the last operation (``_last_op``) with its position (``_last``)
    and, for each column c, ``c__s``: position p, delete flag d and value v of
    the latest event that carried it (a delete carries every column)."""
    p = position()
    ev = events.select(*ns, "key", "op", p.alias("_p"), doc_map().alias("_m"))
    is_del = F.col("op") == "delete"
    aggs = [F.max_by("op", "_p").alias("_last_op"), F.max("_p").alias("_last")]
    names = [key] if isinstance(key, str) else key
    for c in columns:
        if c not in names:
            carrier = F.when(is_del | F.map_contains_key("_m", c), F.col("_p"))
            carried = F.struct(F.col("_p").alias("p"), is_del.alias("d"), _typed(c, columns[c]).alias("v"))
            aggs.append(F.max_by(carried, carrier).alias(c + "__s"))
    return ev.groupBy(*ns, "key").agg(*aggs)


def apply_upsert(target: DataFrame, events: DataFrame, key: str | list[str], columns: dict[str, str]) -> DataFrame:
    """``key``: the key column, or a list of key columns if the events carry canonical keys (of any types, one or more).

    C7 (+C9): SQL-target semantics. An upsert sets only the columns present
    in its document; a delete removes the row and resets every column, so
    after the last delete each column takes the value of the latest event
    that carried it. Key-only inserts therefore create absent rows and leave
    existing ones untouched.

    A delete is treated as an event that carries NULL for every column, so
    "latest carrier per column" is one ``max_by`` per column in ONE per-key
    aggregation (partial, one shuffle of the events); the target is merged
    with one full outer join on the key. Redelivered duplicates carry the
    same position and value, so the result is idempotent without a de-dup.
    A target with ``db`` and ``coll`` columns is merged per namespace."""
    ns = [c for c in ("db", "coll") if c in target.columns]
    cols = [c for c in columns if c not in ([key] if isinstance(key, str) else key)]
    changes = column_changes(events, ns, key, columns)
    tgt, key_out = _keyed_target(target, ns, key, columns)
    m = tgt.join(changes, [*ns, "key"], "full_outer")
    out = [*ns, *key_out]
    for c in cols:
        s = F.col(c + "__s")
        out.append(F.when(s.isNotNull(), F.when(s["d"], F.lit(None)).otherwise(s["v"]))
                   .otherwise(F.col(c + "__t")).cast(columns[c]).alias(c))
    return m.filter(F.col("_last_op").isNull() | (F.col("_last_op") != "delete")).select(*out)


def apply_replace(target: DataFrame, events: DataFrame, key: str | list[str], columns: dict[str, str]) -> DataFrame:
    """``key``: as for ``apply_upsert``.

    C8: document-target semantics: the last whole document replaces the
    row (missing fields become null); a delete removes it."""
    ns = [c for c in ("db", "coll") if c in target.columns]
    cols = [c for c in columns if c not in ([key] if isinstance(key, str) else key)]
    last = collapse(events).select(*ns, "key", F.col("op").alias("_last_op"), doc_map().alias("_m"))
    tgt, key_out = _keyed_target(target, ns, key, columns)
    m = tgt.join(last, [*ns, "key"], "full_outer")
    out = [*ns, *key_out]
    for c in cols:
        out.append(F.when(F.col("_last_op").isNull(), F.col(c + "__t")).otherwise(_typed(c, columns[c]))
                   .cast(columns[c]).alias(c))
    return m.filter(F.col("_last_op").isNull() | (F.col("_last_op") != "delete")).select(*out)


def snapshot_events(target: DataFrame, key: str, columns: dict[str, str], db: str, coll: str) -> DataFrame:
    """Snapshot rows as inserts at position minus infinity, so the tail
    applied on top absorbs the overlap."""
    return target.select(F.lit(db).alias("db"), F.lit(coll).alias("coll"), F.lit("insert").alias("op"),
                         F.col(key).cast("long").alias("key"),
                         F.to_json(F.struct(*[F.col(c) for c in columns])).alias("doc"),
                         *[F.lit(-1).cast("long").alias(c) for c in POS],
                         F.lit(None).cast("long").alias("committed_ms"))


def bootstrap(source: DataFrame, target: DataFrame, events: DataFrame, key: str, columns: dict[str, str],
              mode: str, start: tuple[int, int, int], db: str, coll: str) -> DataFrame:
    """``snapshot`` copies the source (rows at position minus
    infinity) into an empty destination and applies the tail from the start
    position captured before the copy, so the overlap is absorbed; ``tail``
    applies only the events from the start position onto the destination as
    it is."""
    tail = events.filter(position() >= F.struct(*[F.lit(v).cast("long") for v in start]))
    if mode == "snapshot":
        empty = target.filter(F.lit(False))
        return apply_upsert(empty, snapshot_events(source, key, columns, db, coll).unionByName(tail), key, columns)
    if mode == "tail":
        return apply_upsert(target, tail, key, columns)
    raise ValueError(f"unknown bootstrap mode {mode}")


def after_position(events: DataFrame, hi: int, lo: int, seq: int) -> DataFrame:
    """C12 batch resume: events strictly after the last applied position."""
    return events.filter(position() > F.struct(F.lit(hi).cast("long"), F.lit(lo).cast("long"), F.lit(seq).cast("long")))


# -- C14, C16, C20 ----------------------------------------------------------------------------------
def run_counters(valid: DataFrame, dead: DataFrame, run_cols: list[str], paused: bool = False) -> DataFrame:
    """Per run inserts/updates/deletes/errors, last event time,
    last error and final status (paused; failed if any error; else tailing)."""
    v = valid.groupBy(*run_cols).agg(
        F.count_if(F.col("op") == "insert").cast("long").alias("inserts"),
        F.count_if(F.col("op") == "update").cast("long").alias("updates"),
        F.count_if(F.col("op") == "delete").cast("long").alias("deletes"),
        F.max("committed_ms").alias("last_event_ms"))
    d = dead.groupBy(*run_cols).agg(F.count(F.lit(1)).cast("long").alias("errors"),
                                    F.max_by("error", position()).alias("last_error"))
    j = v.join(d, run_cols, "full_outer")
    errors = F.coalesce("errors", F.lit(0)).cast("long")
    status = F.lit("paused") if paused else F.when(errors > 0, F.lit("failed")).otherwise(F.lit("tailing"))
    return j.select(*run_cols, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("inserts", "updates", "deletes")],
                    errors.alias("errors"), "last_event_ms", "last_error", status.alias("status"))
