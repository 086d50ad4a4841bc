"""Queries for change data capture on keys of any shape (C1, C2, C7, C8, C15 with object ids, text and composite keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import keys
from tidewater.operators import cdc
from tidewater.plans.fixture_sql import F3, with_ctes
from tidewater.plans.q_cdc import COLUMNS, KEY
from tidewater.plans.registry import query
from tidewater.sources import fixtures as fx
from tidewater.sources.tables import computed_once, fan_out_small, read_table

FIELDS = {c: t for c, t in COLUMNS.items() if c != KEY}


def _id_json(k):
    """An order's document id: an object id, text or a number, by its key; -k for the rest."""
    hexed = F.lpad(F.lower(F.hex(k)), 24, "0")
    return (F.when(k % 4 == 0, F.concat(F.lit('{"$oid":"'), hexed, F.lit('"}')))
            .when(k % 4 == 1, F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
            .when(k % 4 == 2, k.cast("string")).otherwise((-k).cast("string")))


def oid_messages(spark, sf_dir):
    """Change-stream messages of one collection whose ids are of several types (``"5"`` and ``5`` are different rows)."""
    e = fx.f3_changes(spark, sf_dir)
    return e.select(
        F.struct("pos_hi", "key", "delivery").alias("arrival"),
        F.concat(F.lit('{"operationType":"'), "op", F.lit('","ns":{"db":"shop","coll":"orders"},"documentKey":{"_id":'), _id_json(F.col("key")), F.lit("}"),
                 F.when(F.col("doc").isNull(), F.lit("")).otherwise(F.concat(F.lit(',"fullDocument":'), F.col("doc"))),
                 F.lit(',"clusterTime":{"t":'), F.col("pos_hi").cast("string"), F.lit(',"i":'), F.col("key").cast("string"), F.lit("}}")).alias("raw"))


ID_SQL = """CASE key % 4 WHEN 0 THEN 'objectid' WHEN 1 THEN 'string' ELSE 'number' END AS id_kind,
  CASE key % 4 WHEN 0 THEN lpad(lower(format('{:x}', key)), 24, '0') WHEN 1 THEN CAST(key AS VARCHAR) WHEN 2 THEN CAST(key AS VARCHAR) ELSE CAST(-key AS VARCHAR) END AS id"""


def _json(c, t, doc="doc"):
    kind = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}[t]
    return f"TRY_CAST(json_extract_string({doc}, '$.{c}') AS {kind})"


BAD_SQL = " OR ".join(f"(json_extract_string(doc, '$.{c}') IS NOT NULL AND {_json(c, t)} IS NULL)" for c, t in FIELDS.items())


@query("cdc_oid_keys", with_ctes(F3) + f""",
good AS (SELECT * FROM f3 WHERE NOT ({BAD_SQL})),
last AS (SELECT key, arg_max(op, pos_hi) AS op, arg_max(doc, pos_hi) AS doc FROM good GROUP BY key),
tgt AS (SELECT o_orderkey AS key, {", ".join(FIELDS)} FROM orders WHERE o_orderkey % 2 = 0)
SELECT {ID_SQL}, {", ".join(f"CASE WHEN l.op IS NULL THEN t.{c} ELSE {_json(c, t, 'l.doc')} END AS {c}" for c, t in FIELDS.items())}
FROM tgt t FULL OUTER JOIN last l USING (key) WHERE l.op IS NULL OR l.op <> 'delete'""")
def cdc_oid_keys(spark, sf_dir):
    """A collection with object ids, text and (negative) numbers as ids, replayed onto a loaded snapshot whose
    rows carry the same canonical ids. The merge is one join on the canonical text."""
    valid, _ = cdc.validate(cdc.normalise_mongo(oid_messages(spark, sf_dir), any_key=True), FIELDS, "_id")
    loaded = fan_out_small(read_table(spark, sf_dir, "orders").filter(F.col(KEY) % 2 == 0).select(KEY, *FIELDS))
    loaded = computed_once(loaded, F.parse_json(_id_json(F.col(KEY))).alias("_v"))
    loaded = loaded.select(keys.key(keys.of_variant(F.col("_v"))).alias("_id"), *FIELDS)
    out = cdc.apply_replace(loaded, valid, "_id", {"_id": "string"} | FIELDS)
    out, part = computed_once(out, keys.part(F.col("_id")).alias("_part")), F.col("_part")
    return out.select(keys.kind_of(part).alias("id_kind"), keys.value_of(part).alias("id"), *FIELDS)


SHIP_KEY = {"o_orderpriority": "string", "o_orderkey": "bigint"}
SHIP_COLUMNS = SHIP_KEY | {"o_totalprice": "double", "o_orderstatus": "string"}


def shipment_messages(spark, sf_dir):
    """Logical-decoding rows of a table keyed by a text and a number: an insert for each order, an update of the price
    (k % 3 = 0), a key change (another priority, k % 5 = 0), a delete by the key of the time (k % 7 = 0)."""
    o = fan_out_small(read_table(spark, sf_dir, "orders"))
    k, name = F.col("o_orderkey"), F.col("o_orderpriority")

    def fields(priority, *more):
        head = F.concat(F.lit('{"o_orderkey":'), k.cast("string"), F.lit(',"o_orderpriority":"'), priority, F.lit('"'))
        return F.concat(head, *[x for field, c in more for x in (F.lit(f',"{field}":'), c)], F.lit("}"))

    price = lambda x: ("o_totalprice", F.format_string("%.2f", x))
    status = ("o_orderstatus", F.concat(F.lit('"'), "o_orderstatus", F.lit('"')))
    moved = F.concat(name, F.lit(" moved"))
    step = lambda at, action, body, on: F.struct(F.lit(at).alias("step"), F.lit(action).alias("a"), body.alias("body"), on.alias("on"))
    columns, old, identity = (F.lit(f',"{field}":') for field in ("columns", "old", "identity"))
    steps = F.array(
        step(1, "I", F.concat(columns, fields(name, price(F.col("o_totalprice")), status)), F.lit(True)),
        step(2, "U", F.concat(columns, fields(name, price(F.col("o_totalprice") + 1))), k % 3 == 0),
        step(3, "U", F.concat(columns, fields(moved, price(F.col("o_totalprice") * 2), ("o_orderstatus", F.lit("null"))), old, fields(name)), k % 5 == 0),
        step(4, "D", F.concat(identity, fields(F.when(k % 5 == 0, moved).otherwise(name))), k % 7 == 0))
    e = o.select("*", F.explode(F.filter(steps, lambda s: s["on"])).alias("s"))
    raw = F.concat(F.lit('{"lsn":"'), F.hex("s.step"), F.lit("/"), F.hex(k), F.lit('","action":"'), F.col("s.a"), F.lit('","schema":"public","table":"shipments"'), F.col("s.body"), F.lit("}"))
    return e.select(F.struct("s.step", k).alias("arrival"), raw.alias("raw"))


@query("cdc_composite_key", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority || ' moved' ELSE o_orderpriority END AS o_orderpriority,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN printf('%.2f', o_totalprice * 2) WHEN o_orderkey % 3 = 0 THEN printf('%.2f', o_totalprice + 1) ELSE printf('%.2f', o_totalprice) END AS DOUBLE) AS o_totalprice,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus
FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL
SELECT o_orderkey, 'held', -1.0, 'X' FROM orders WHERE o_orderkey % 10 = 0""")
def cdc_composite_key(spark, sf_dir):
    """A key of a text and a number, with key changes, onto a target of other rows and of rows that the log
    inserts again."""
    events = cdc.split_key_changes(cdc.normalise_pg(shipment_messages(spark, sf_dir), SHIP_KEY))
    o = read_table(spark, sf_dir, "orders").select(*SHIP_COLUMNS)
    loaded = o.filter(F.col("o_orderkey") % 10 == 0).withColumns({"o_orderpriority": F.lit("held"), "o_totalprice": F.lit(-1.0), "o_orderstatus": F.lit("X")})
    loaded = loaded.unionByName(o.filter(F.col("o_orderkey") % 4 == 1))
    return cdc.apply_upsert(loaded, events, list(SHIP_KEY), SHIP_COLUMNS)
