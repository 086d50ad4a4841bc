"""Inputs derived from the TESTDATA tables.

Every recipe is a pure function of table keys, so the DuckDB oracle in
``tidewater.plans.fixture_sql`` repeats it row for row, and every input
grows with the tables it is derived from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.tables import computed_once, fan_out_small, read_table

# -- fixed vocabularies used to dress the catalog fixture (F2) --------------
# Native PG type names (pg_type.typname) cycled through the column catalog.
PG_NATIVE_TYPES = [
    "int2", "int4", "int8", "float4", "float8", "numeric", "money", "bool", "text", "varchar",
    "char", "bpchar", "name", "uuid", "json", "jsonb", "bytea", "date", "timestamp",
    "timestamptz", "time", "timetz", "_int4", "_text", "inet", "tsvector", "interval",
]
# Native MySQL DATA_TYPE names cycled through the column catalog.
MYSQL_NATIVE_TYPES = [
    "tinyint", "smallint", "mediumint", "int", "integer", "bigint", "float", "double", "real",
    "decimal", "numeric", "char", "varchar", "text", "tinytext", "mediumtext", "longtext",
    "binary", "varbinary", "blob", "tinyblob", "mediumblob", "longblob", "bit", "date",
    "datetime", "timestamp", "time", "year", "json", "enum", "set", "geometry",
]
PG_SCHEMAS = ["public", "sales", "public", "inventory", "public", "sales", "pg_catalog", "public",
              "information_schema", "public"]
MYSQL_SCHEMAS = ["shop", "shop", "mysql", "shop", "sys", "shop", "performance_schema", "shop",
                 "information_schema", "shop"]
COLUMN_WORDS = ["name", "amount", "created_at", "status", "note", "payload", "flag", "qty",
                "price", "label", "sku"]


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _q(c) -> F.Column:
    """JSON string literal of a plain text column (fixture values carry no quotes)."""
    return F.concat(F.lit('"'), _s(c), F.lit('"'))


def epoch_ms(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_millis(col.cast("timestamp"))


# -- F1 documents ------------------------------------------------------------
def f1_documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one JSON document per customer, with missing keys, present nulls,
    mixed types, nested objects, arrays and an extended-JSON ObjectId."""
    c = fan_out_small(read_table(spark, sf_dir, "customer"))
    k = F.col("c_custkey")
    age = (F.lit(18) + k % 60).cast("string")
    parts = [
        F.concat(F.lit('"_id":'), _s(k)),
        F.concat(F.lit('"name":'), _q("c_name")),
        F.concat(F.lit('"address":{"nation":'), _s("c_nationkey"), F.lit(',"segment":'),
                 _q("c_mktsegment"), F.lit(',"geo":{"region":'), _s(F.col("c_nationkey") % 5),
                 F.lit(',"zone":"z'), _s(k % 7), F.lit('"}}')),
        F.when(k % 20 == 0, F.concat(F.lit('"age":"'), age, F.lit('"')))
         .otherwise(F.concat(F.lit('"age":'), age)),
        F.when(k % 10 != 0, F.concat(F.lit('"score":'), F.format_string("%.2f", F.col("c_acctbal")))),
        F.when(k % 5 < 2, F.lit('"note":null'))
         .otherwise(F.concat(F.lit('"note":"'), F.lower("c_mktsegment"), F.lit(' buyer"'))),
        F.when(k % 3 == 0, F.concat(F.lit('"tags":["'), F.lower("c_mktsegment"), F.lit('","n'),
                                    _s("c_nationkey"), F.lit('"]'))),
        F.concat(F.lit('"active":'), F.when(F.col("c_acctbal") > 0, F.lit("true")).otherwise(F.lit("false"))),
        F.concat(F.lit('"ref":{"$oid":"'), F.lpad(F.lower(F.hex(k)), 24, "0"), F.lit('"}')),
        F.when(k % 8 == 0, F.lit('"legacy":null')),
        F.concat(F.lit('"big":'), _s(k * 2000003)),
    ]
    coll = F.when(k % 97 == 0, F.lit("system.profile")).otherwise(F.lower("c_mktsegment"))
    database = F.when(k % 89 == 0, F.lit("admin")).otherwise(F.lit("crm"))
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    named = c.select("*", database.alias("database"), coll.alias("coll"), k.alias("doc_id"))
    return computed_once(named, text.alias("doc_text")).select("database", "coll", "doc_id", "doc_text")


def f1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 parsed: (database, coll, doc_id, doc VARIANT)."""
    t = f1_documents_text(spark, sf_dir)
    return t.select("database", "coll", "doc_id", F.parse_json("doc_text").alias("doc"))


# -- F2 column catalog -------------------------------------------------------
def f2_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a column catalog (one row per table column) derived from ``part``:
    table ``t_<partkey>`` with 2-6 columns, a PK (composite for some),
    an FK to the previous table for some, identity/serial keys, and native
    type names for PG and MySQL."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    pk = F.col("p_partkey")
    j = F.col("ordinal")
    n_pg, n_my, n_w = len(PG_NATIVE_TYPES), len(MYSQL_NATIVE_TYPES), len(COLUMN_WORDS)
    pg_types = F.array(*[F.lit(x) for x in PG_NATIVE_TYPES])
    my_types = F.array(*[F.lit(x) for x in MYSQL_NATIVE_TYPES])
    words = F.array(*[F.lit(x) for x in COLUMN_WORDS])
    pg_schemas = F.array(*[F.lit(x) for x in PG_SCHEMAS])
    my_schemas = F.array(*[F.lit(x) for x in MYSQL_SCHEMAS])
    is_fk = (j == 2) & (pk % 4 == 1) & (pk > 0)
    is_pk = (j == 1) | ((j == 2) & (pk % 6 == 0))
    key_pg = F.when(pk % 9 == 0, F.lit("uuid")).when(pk % 2 == 0, F.lit("int4")).otherwise(F.lit("int8"))
    key_my = F.when(pk % 9 == 0, F.lit("varchar")).when(pk % 2 == 0, F.lit("int")).otherwise(F.lit("bigint"))
    pg_type = (F.when(j == 1, key_pg).when(is_fk, key_pg)
               .otherwise(F.element_at(pg_types, ((pk * 7 + j) % n_pg + 1).cast("int"))))
    my_type = (F.when(j == 1, key_my).when(is_fk, key_my)
               .otherwise(F.element_at(my_types, ((pk * 5 + j) % n_my + 1).cast("int"))))
    col_name = (F.when(j == 1, F.lit("id")).when(is_fk, F.lit("parent_id"))
                .otherwise(F.concat(F.element_at(words, ((pk + j) % n_w + 1).cast("int")), F.lit("_"),
                                    _s(j))))
    serial = (j == 1) & (pk % 9 != 0) & (pk % 3 == 1)
    identity = (j == 1) & (pk % 9 != 0) & (pk % 3 == 2)
    nullable = F.when(is_pk, F.lit("NO")).when((pk + j) % 3 == 0, F.lit("NO")).otherwise(F.lit("YES"))
    my_column_type = (F.when((my_type == "tinyint") & ((pk + j) % 2 == 0), F.lit("tinyint(1)"))
                      .when(my_type == "varchar", F.lit("varchar(255)"))
                      .when(my_type == "decimal", F.lit("decimal(10,2)"))
                      .otherwise(my_type))
    return (p.select(pk, F.explode(F.sequence(F.lit(1), (F.lit(2) + F.col("p_size") % 5).cast("int")))
                     .alias("ordinal"))
            .select(
                F.element_at(pg_schemas, (pk % 10 + 1).cast("int")).alias("pg_schema"),
                F.element_at(my_schemas, (pk % 10 + 1).cast("int")).alias("my_schema"),
                F.concat(F.lit("t_"), _s(pk)).alias("table_name"),
                pk.alias("table_key"),
                j.alias("ordinal"),
                col_name.alias("column_name"),
                pg_type.alias("pg_type"),
                my_type.alias("my_type"),
                my_column_type.alias("my_column_type"),
                nullable.alias("is_nullable"),
                is_pk.alias("is_pk"),
                F.when(is_fk, F.concat(F.lit("t_"), _s(pk - 1))).alias("fk_table"),
                F.when(is_fk, F.lit("id")).alias("fk_column"),
                F.when(serial, F.concat(F.lit("nextval('t_"), _s(pk), F.lit("_id_seq'::regclass)")))
                 .alias("column_default"),
                F.when(identity, F.lit("YES")).otherwise(F.lit("NO")).alias("is_identity"),
                F.when(serial | identity, F.lit("auto_increment")).otherwise(F.lit("")).alias("my_extra"),
            ))


# -- F3 change log -----------------------------------------------------------
def f3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalised change events derived from ``orders``.

    Per order key k: insert (step 0) for every key; update (step 1) when
    k % 3 = 0 (partial doc for even k, full doc otherwise; a poison price
    when k % 26 = 13); delete (step 2) when k % 7 = 0; re-insert (step 3)
    when k % 14 = 0. Step-0 events of k % 11 = 0 are delivered twice.
    Position = (hi = step, lo = k, seq = delivery ordinal)."""
    o = fan_out_small(read_table(spark, sf_dir, "orders"))
    k = F.col("o_orderkey")
    price = F.format_string("%.2f", F.col("o_totalprice"))
    price_up = F.format_string("%.2f", F.col("o_totalprice") + F.lit(1.0))
    full = lambda status, pr: F.concat(
        F.lit('{"o_orderkey":'), _s(k), F.lit(',"o_custkey":'), _s("o_custkey"),
        F.lit(',"o_orderstatus":'), status, F.lit(',"o_totalprice":'), pr,
        F.lit(',"o_orderpriority":'), _q("o_orderpriority"), F.lit("}"))
    update_doc = (F.when(k % 26 == 13, F.concat(F.lit('{"o_orderkey":'), _s(k),
                                                F.lit(',"o_orderstatus":"U","o_totalprice":"n/a"}')))
                  .when(k % 2 == 0, F.concat(F.lit('{"o_orderkey":'), _s(k),
                                             F.lit(',"o_orderstatus":"U","o_totalprice":'), price_up,
                                             F.lit("}")))
                  .otherwise(full(F.lit('"U"'), price_up)))
    reinsert_doc = F.concat(F.lit('{"o_orderkey":'), _s(k), F.lit(',"o_orderstatus":"R"}'))
    def step(n, op, doc, on):
        return F.struct(F.lit(n).alias("step"), F.lit(op).alias("op"), doc.alias("doc"), on.alias("on"))
    steps = F.array(
        step(0, "insert", full(_q("o_orderstatus"), price), F.lit(True)),
        step(1, "update", update_doc, k % 3 == 0),
        step(2, "delete", F.lit(None).cast("string"), k % 7 == 0),
        step(3, "insert", reinsert_doc, k % 14 == 0),
    )
    ev = (o.select(k.alias("key"), epoch_ms("o_orderdate").alias("base_ms"),
                   F.when(k % 4 == 3, F.lit("archive")).otherwise(F.lit("orders")).alias("coll"),
                   F.explode(steps).alias("e"))
          .filter(F.col("e.on")))
    dup = F.when((F.col("e.step") == 0) & (F.col("key") % 11 == 0), F.array(F.lit(0), F.lit(1))) \
           .otherwise(F.array(F.lit(0)))
    return ev.select(
        F.lit("shop").alias("db"), "coll", F.col("e.op").alias("op"), "key", F.col("e.doc").alias("doc"),
        F.col("e.step").cast("long").alias("pos_hi"), F.col("key").alias("pos_lo"),
        F.lit(0).cast("long").alias("pos_seq"),
        (F.col("base_ms") + F.col("e.step") * F.lit(3600000)).alias("committed_ms"),
        F.explode(dup).alias("delivery"),
    )


# -- F4 counters / F5 op log (from events) ----------------------------------
EVENT_TO_OP = {"purchase": "insert", "click": "query", "signup": "update", "error": "delete",
               "view": "getmore"}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def f4_counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one server-status sample per event for connection ``user_id``:
    cumulative op counters per type (insert/query/update/delete/getmore,
    command = all), network bytes and cache pages. Each connection's
    counters restart (a server restart) from day 15 + user_id % 24 hours."""
    e = _events(spark, sf_dir)
    reset_ms = F.lit(1705276800000) + (F.col("user_id") % 24) * F.lit(3600000)  # 2024-01-15
    ts_ms = epoch_ms("ts")
    base = e.select(
        F.col("user_id").alias("connection_id"), "event_id", "ts", ts_ms.alias("ts_ms"),
        (ts_ms >= reset_ms).cast("int").alias("epoch"),
        *[(F.col("event_type") == t).cast("long").alias(f"d_{op}") for t, op in EVENT_TO_OP.items()],
        F.lit(1).cast("long").alias("d_command"),
        F.round(F.col("value") * 100).cast("long").alias("d_bytes"),
        (F.col("event_type") == "error").cast("long").alias("d_pages_read"),
    )
    # running sums per (connection, restart epoch), bucketed by day so a hot
    # connection is not one task
    from tidewater.functions.windows import day_bucket, split_cumsum
    keys, order, b = ["connection_id", "epoch"], ["ts_ms", "event_id"], day_bucket(F.col("ts_ms"))
    ops = list(EVENT_TO_OP.values()) + ["command"]
    d = split_cumsum(base, keys, order, b, {f"c_{c}": F.col(f"d_{c}") for c in ops + ["bytes", "pages_read"]})
    return d.select(
        "connection_id", "event_id", "ts", "ts_ms",
        *[F.col(f"c_{op}").alias(op) for op in ops],
        F.col("c_bytes").alias("bytes_in"),
        (F.col("c_bytes") * 3).alias("bytes_out"),
        F.col("c_pages_read").alias("pages_read"),
        F.col("c_command").alias("pages_requested"),
        (F.col("d_bytes") * 1000).alias("cache_used_bytes"),
        F.when(F.col("connection_id") % 9 == 0, F.lit(0)).otherwise(F.lit(50000000)).cast("long")
         .alias("cache_max_bytes"),
        ((F.col("connection_id") * 7 + F.col("event_id")) % 200).cast("long").alias("connections_current"),
        F.lit(800).cast("long").alias("connections_max"),
        (F.lit(512) + F.col("connection_id") % 100).cast("long").alias("mem_resident_mb"),
        (F.lit(2048) + F.col("event_id") % 1000).cast("long").alias("mem_virtual_mb"),
    )


def f4_replica_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 replica status: replica set = user_id % 10 (connection ``rs<n>``),
    member = user, one status per (set, hour). Member of user id < 10 is the
    primary; others secondary, arbiter (user % 5 = 0) or down (user % 7 = 0).
    health = 0 for members that are down and for user % 25 = 0.
    optime = the member's latest event in that hour."""
    e = _events(spark, sf_dir)
    u = F.col("user_id")
    m = F.col("member_id")
    state = (F.when(m < 10, F.lit(1)).when(m % 7 == 0, F.lit(8)).when(m % 5 == 0, F.lit(7))
             .otherwise(F.lit(2)))
    health = F.when((state == 8) | (m % 25 == 0), F.lit(0)).otherwise(F.lit(1))
    return (e.groupBy((u % 10).alias("set_id"), u.alias("member_id"),
                      F.date_trunc("hour", "ts").alias("sample_ts"))
            .agg(F.max("ts").alias("optime"))
            .select("set_id", "member_id", "sample_ts", state.alias("state"), health.alias("health"), "optime"))


def member_lags() -> Column:
    """known lags in seconds of a sample's replica members (null entries:
    unknown); null for a server without a replica set (connection % 3 > 0)."""
    known = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 45).cast("double"))
    return F.when(F.col("connection_id") % 3 == 0, F.array(known, F.lit(None).cast("double")))


def f5_oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one profiled operation per event. db = 'db<user % 10>' except
    user % 10 = 0 -> 'admin'; ns = db.event_type (null when event_id % 13 = 0);
    millis = value; op from event type; command JSON whose filter comes from
    ``props`` (key ``filter``, or ``query`` when event_id % 4 = 0)."""
    e = _events(spark, sf_dir)
    eid, u = F.col("event_id"), F.col("user_id")
    db = F.when(u % 10 == 0, F.lit("admin")).otherwise(F.concat(F.lit("db"), _s(u % 10)))
    op = (F.when(F.col("event_type") == "purchase", F.lit("insert"))
          .when(F.col("event_type") == "signup", F.lit("update"))
          .when(F.col("event_type") == "error", F.lit("remove"))
          .when(F.col("event_type") == "view", F.lit("getmore"))
          .when(eid % 6 == 0, F.lit("command")).otherwise(F.lit("query")))
    filt = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"),
                    F.when(eid % 3 == 0, F.concat(F.lit(',"user":'), _s(u))).otherwise(F.lit("")),
                    F.when(eid % 5 == 0, F.lit(',"$comment":"probe"')).otherwise(F.lit("")),
                    F.lit("}"))
    cmd = F.concat(F.lit('{"find":'), _q("event_type"),
                   F.when(eid % 4 == 0, F.lit(',"query":')).otherwise(F.lit(',"filter":')), filt, F.lit("}"))
    return e.select(
        eid.alias("op_id"), u.alias("connection_id"), db.alias("db"),
        F.when(eid % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(db, F.lit("."), F.col("event_type"))).alias("ns"),
        op.alias("op"), F.col("value").alias("millis"), "ts", epoch_ms("ts").alias("ts_ms"),
        cmd.alias("command"),
        (F.col("event_type") != "view").alias("active"),
        F.when(eid % 3 == 0, F.lit(0)).otherwise(F.round(F.col("value") * 1000)).cast("long")
         .alias("microsecs_running"),
        F.floor(F.col("value") / 100).cast("long").alias("secs_running"),
        F.when(eid % 7 != 0, F.concat(F.lit("conn"), _s(u))).alias("desc"),
        F.when(eid % 9 != 0, F.concat(F.lit("10.0.0."), _s(u % 250), F.lit(":27017"))).alias("client"),
        (eid % 31 == 0).alias("waiting_for_lock"),
        F.when(eid % 2 == 0, F.lit("COLLSCAN")).when(eid % 5 != 0, F.lit("IXSCAN { k: 1 }")).alias("plan_summary"),
        F.when(eid % 5 != 0, F.floor(F.col("value")).cast("long")).alias("keys_examined"),
        F.floor(F.col("value") * 10).cast("long").alias("docs_examined"),
        F.when(eid % 4 != 0, u % 100).cast("long").alias("nreturned"),
    )


# -- F6 runs -------------------------------------------------------------------
RUN_KINDS = ["backup", "migration", "cdc"]


def f6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one job run per order. job = o_custkey, kind by key % 3,
    status F -> succeeded, P -> failed, O -> running (open, no end),
    started = order date + key % 86400 s, ended = started + price % 7200 s."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    start_ms = epoch_ms("o_orderdate") + (k % 86400) * 1000
    status = (F.when(F.col("o_orderstatus") == "F", F.lit("succeeded"))
              .when(F.col("o_orderstatus") == "P", F.lit("failed")).otherwise(F.lit("running")))
    dur_s = F.floor(F.col("o_totalprice")).cast("long") % 7200
    return o.select(
        k.alias("run_id"), F.col("o_custkey").alias("job_id"),
        F.element_at(F.array(*[F.lit(x) for x in RUN_KINDS]), (k % 3 + 1).cast("int")).alias("kind"),
        status.alias("status"), start_ms.alias("started_ms"),
        F.when(status == "running", F.lit(None).cast("long")).otherwise(start_ms + dur_s * 1000)
         .alias("ended_ms"),
        F.round(F.col("o_totalprice") * 1000).cast("long").alias("size_bytes"),
        F.col("o_orderpriority").alias("label"),
    )


# -- F7 SQL-engine samples (derived from F4) ----------------------------------
def f7_pg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG ``pg_stat_database``-style samples: one per F4 sample. Uptime counts
    from one minute before the connection's first sample (a grouped min
    joined back, so no whole-connection window)."""
    s = f4_counter_samples(spark, sf_dir)
    start = s.groupBy("connection_id").agg((F.min("ts_ms") - 60000).alias("start_ms"))
    cur = F.col("connections_current")
    return s.join(start, "connection_id").select(
        "connection_id", "event_id", "ts_ms",
        F.floor((F.col("ts_ms") - F.col("start_ms")) / 1000).cast("long").alias("uptime_s"),
        (F.col("insert") + F.col("query") + F.col("delete")).alias("xact"),
        F.col("bytes_in").alias("blks_hit"), F.col("pages_read").alias("blks_read"),
        cur.alias("sessions_total"), (cur % 17).alias("sessions_active"),
        (cur - cur % 17 - cur % 3).alias("sessions_idle"),
        (F.col("connection_id") % 4 == 1).alias("is_replica"),
        (F.col("event_id") % 90).cast("double").alias("replica_lag_s"))


MYSQL_STATUS_NAMES = ["Uptime", "Threads_connected", "Threads_running", "Com_commit", "Com_rollback",
                      "Questions", "Innodb_buffer_pool_read_requests", "Innodb_buffer_pool_reads"]


def f7_mysql_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MySQL ``SHOW GLOBAL STATUS`` rows (name, text value) per F4 sample."""
    p = f7_pg_stats(spark, sf_dir)
    s = f4_counter_samples(spark, sf_dir).select("connection_id", "event_id", "insert", "query", "delete",
                                                 "command", "pages_requested", "pages_read")
    w = p.join(s, ["connection_id", "event_id"]).select(
        "connection_id", "event_id",
        F.col("uptime_s").alias("Uptime"), F.col("sessions_total").alias("Threads_connected"),
        F.col("sessions_active").alias("Threads_running"),
        (F.col("insert") + F.col("query")).alias("Com_commit"), F.col("delete").alias("Com_rollback"),
        F.col("command").alias("Questions"),
        (F.col("pages_requested") * 10).alias("Innodb_buffer_pool_read_requests"),
        F.col("pages_read").alias("Innodb_buffer_pool_reads"))
    long = w.unpivot(["connection_id", "event_id"], MYSQL_STATUS_NAMES, "variable_name", "v")
    return long.select("connection_id", "event_id", "variable_name", F.col("v").cast("string").alias("value"))


# -- F6 rules -------------------------------------------------------------------
# Eight rule templates applied to every connection: (metric, condition, threshold, duration minutes).
RULE_TEMPLATES = [
    ("currentConnections", "gt", 150.0, 5),
    ("availableConnections", "lt", 700.0, 1),
    ("memResident", "gte", 600.0, 10),
    ("opsPerSecTotal", "gt", 0.0005, 2),
    ("replicationLag", "gt", 30.0, 3),
    ("wtCachePercent", "gt", 50.0, 5),
    ("networkBytesIn", "gt", 100000.0, 60),
    ("memVirtual", "lte", 2100.0, 1),
]


def f6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 rules: the eight templates for every connection (user) seen in
    ``events``; rule_id = user * 8 + template; some rules disabled."""
    users = _events(spark, sf_dir).select(F.col("user_id").alias("connection_id")).distinct()
    tpl = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(m).alias("metric"), F.lit(c).alias("condition"),
                             F.lit(t).alias("threshold"), F.lit(d).alias("duration_minutes"))
                    for j, (m, c, t, d) in enumerate(RULE_TEMPLATES)])
    r = users.select("connection_id", F.explode(tpl).alias("t"))
    return r.select(
        (F.col("connection_id") * 8 + F.col("t.j")).alias("rule_id"), "connection_id",
        (F.col("connection_id") % 3).alias("profile_id"),
        F.concat(F.col("t.metric"), F.lit("@conn-"), F.col("connection_id").cast("string")).alias("name"),
        F.col("t.metric").alias("metric"), F.col("t.condition").alias("condition"),
        F.col("t.threshold").alias("threshold"), F.col("t.duration_minutes").alias("duration_minutes"),
        ((F.col("connection_id") + F.col("t.j")) % 13 != 0).alias("enabled"))


# -- F3 raw change logs (one JSON text per delivered message) ----------------------
MONGO_EPOCH_S = 1700000000


def f3_raw_mongo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-stream messages: insert (replace for k % 5 = 0 at step 0), update
    (no fullDocument when k % 26 = 0, which the normaliser skips), delete;
    plus drop (k % 50 = 0) and invalidate (k % 60 = 1) noise. clusterTime
    (t, i) = (epoch + step, k); ``arrival`` is the delivery order."""
    e = f3_changes(spark, sf_dir)
    k, hi = F.col("key"), F.col("pos_hi")
    op_type = F.when((F.col("op") == "insert") & (hi == 0) & (k % 5 == 0), F.lit("replace")).otherwise(F.col("op"))
    has_full = (F.col("op") != "delete") & ~((F.col("op") == "update") & (k % 26 == 0))
    raw = F.concat(
        F.lit('{"operationType":"'), op_type, F.lit('","ns":{"db":"shop","coll":"'), F.col("coll"),
        F.lit('"},"documentKey":{"_id":'), _s(k), F.lit("}"),
        F.when(has_full, F.concat(F.lit(',"fullDocument":'), F.col("doc"))).otherwise(F.lit("")),
        F.lit(',"clusterTime":{"t":'), _s(hi + MONGO_EPOCH_S), F.lit(',"i":'), _s(k), F.lit("}}"))
    msgs = e.select((hi * 1000000000 + k * 2 + F.col("delivery")).alias("arrival"), raw.alias("raw"))
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    drop = o.filter(F.col("k") % 50 == 0).select(
        (F.lit(9000000000) + F.col("k") * 2).alias("arrival"),
        F.concat(F.lit('{"operationType":"drop","ns":{"db":"shop","coll":"orders"},"clusterTime":{"t":'),
                 F.lit(str(MONGO_EPOCH_S + 9)), F.lit(',"i":'), _s("k"), F.lit("}}")).alias("raw"))
    inval = o.filter(F.col("k") % 60 == 1).select(
        (F.lit(9500000000) + F.col("k") * 2).alias("arrival"),
        F.concat(F.lit('{"operationType":"invalidate","clusterTime":{"t":'), F.lit(str(MONGO_EPOCH_S + 10)),
                 F.lit(',"i":'), _s("k"), F.lit("}}")).alias("raw"))
    return msgs.unionByName(drop).unionByName(inval)


def f3_raw_pg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical-decoding rows: action I/U/D with LSN 'hi/lo' in hex, new row in
    ``columns``, the key in ``identity`` for deletes; begin/commit frames
    (k % 10 = 0) and truncate (k % 100 = 1) are noise."""
    e = f3_changes(spark, sf_dir)
    k = F.col("key")
    lsn = F.concat(F.hex("pos_hi"), F.lit("/"), F.hex(F.col("pos_lo") * 16))
    action = F.when(F.col("op") == "insert", F.lit("I")).when(F.col("op") == "update", F.lit("U")).otherwise(F.lit("D"))
    body = F.when(F.col("op") == "delete", F.concat(F.lit(',"identity":{"o_orderkey":'), _s(k), F.lit("}"))) \
            .otherwise(F.concat(F.lit(',"columns":'), F.col("doc")))
    raw = F.concat(F.lit('{"lsn":"'), lsn, F.lit('","action":"'), action, F.lit('","schema":"public","table":"'),
                   F.col("coll"), F.lit('"'), body, F.lit("}"))
    msgs = e.select((F.col("pos_hi") * 1000000000 + k * 4 + F.col("delivery") + 1).alias("arrival"), raw.alias("raw"))
    frames = e.filter((F.col("delivery") == 0) & (k % 10 == 0)).select(
        F.explode(F.array(
            F.struct((F.col("pos_hi") * 1000000000 + k * 4).alias("arrival"),
                     F.concat(F.lit('{"lsn":"'), lsn, F.lit('","action":"B"}')).alias("raw")),
            F.struct((F.col("pos_hi") * 1000000000 + k * 4 + 3).alias("arrival"),
                     F.concat(F.lit('{"lsn":"'), lsn, F.lit('","action":"C"}')).alias("raw")))).alias("f"))
    frames = frames.select("f.arrival", "f.raw")
    trunc = e.filter((F.col("delivery") == 0) & (F.col("pos_hi") == 0) & (k % 100 == 1)).select(
        (F.lit(8000000000) + k).alias("arrival"),
        F.concat(F.lit('{"lsn":"9/'), F.hex(k * 16), F.lit('","action":"T","schema":"public","table":"orders"}'))
        .alias("raw"))
    return msgs.unionByName(frames).unionByName(trunc)


def f3_raw_mysql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binlog row events: one message per (step, table, k div 4) carrying up
    to four rows; update rows carry before/after; a rotate message opens each
    step's file (the file name is not repeated on row events). Messages of a
    group that holds a redelivered key are sent twice."""
    e = f3_changes(spark, sf_dir).filter(F.col("delivery") == 0)
    k = F.col("key")
    row = (F.when(F.col("op") == "insert", F.col("doc"))
           .when(F.col("op") == "update", F.concat(F.lit('{"before":null,"after":'), F.col("doc"), F.lit("}")))
           .otherwise(F.concat(F.lit('{"o_orderkey":'), _s(k), F.lit("}"))))
    typ = F.when(F.col("op") == "insert", F.lit("write_rows")).when(F.col("op") == "update", F.lit("update_rows")) \
           .otherwise(F.lit("delete_rows"))
    g = (e.groupBy("pos_hi", "coll", typ.alias("type"), F.floor(k / 4).alias("grp"))
         .agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("r")))).alias("rows"),
              F.min("committed_ms").alias("committed_ms"),
              F.max(((F.col("pos_hi") == 0) & (k % 11 == 0)).cast("int")).alias("dup")))
    raw = F.concat(F.lit('{"type":"'), F.col("type"), F.lit('","schema":"shop","table":"'), F.col("coll"),
                   F.lit('","position":'), _s(F.col("grp") * 100 + 4),
                   F.lit(',"timestamp":'), _s(F.floor(F.col("committed_ms") / 1000)),
                   F.lit(',"rows":['), F.array_join(F.transform("rows", lambda s: s["r"]), ","), F.lit("]}"))
    base = F.col("pos_hi") * 1000000000 + F.col("grp") * 8 + (F.col("coll") == "archive").cast("int") * 4 + 1
    copies = F.when(F.col("dup") == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    msgs = g.select(base.alias("_b"), raw.alias("raw"), F.explode(copies).alias("_c")) \
            .select((F.col("_b") + F.col("_c")).alias("arrival"), "raw")
    rot = e.select("pos_hi").distinct().select(
        (F.col("pos_hi") * 1000000000).alias("arrival"),
        F.concat(F.lit('{"type":"rotate","next_file":"binlog.'), F.lpad(_s(F.col("pos_hi") + 1), 6, "0"),
                 F.lit('","position":4}')).alias("raw"))
    return msgs.unionByName(rot)
