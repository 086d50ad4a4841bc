"""Type-translating row mappers between document, PG and MySQL models.

``map_*`` functions build ONE ``select`` of Column expressions from a schema
(a list of column descriptors collected from the small schema table), so a
mapping is a narrow projection inside whole-stage codegen. A value that
cannot be converted makes its row a reject (validity split) instead of
failing a batch; coercion warnings are a per-row array that is exploded and
counted, never one Python object per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.types import CANONICAL_TO_SPARK, js_string
from tidewater.sources.tables import computed_once

MAP_VARIANT = "map<string,variant>"


@dataclass(frozen=True)
class Col:
    name: str
    type: str            # canonical type
    primary_key: bool = False
    references: str | None = None


def schema_cols(schema_df: DataFrame, order: str = "ordinal") -> list[Col]:
    """Collect one namespace's schema table (bounded by the column limit)."""
    rows = schema_df.orderBy(order).collect()
    return [Col(r["column_name"], r["type"], bool(r["primary_key"]),
                r["references"] if "references" in r.asDict() else None) for r in rows]


def dedup_names(names: list[str]) -> list[str]:
    """T14 for a single schema held on the driver (column order)."""
    seen, out = set(), []
    for n in names:
        while n in seen:
            n = n + "_"
        seen.add(n)
        out.append(n)
    return out


def _clean_py(name: str, dialect: str) -> str:
    import re
    if dialect == "pg":
        s = re.sub(r"[.$]", "_", name).strip() or "_field"
        return s[:63]
    s = re.sub(r"[^a-zA-Z0-9_]", "_", name)
    s = re.sub(r"^([0-9])", r"_\1", s)
    return s[:64]


# -- document value -> SQL value ------------------------------------------------------------------
def _is_num(st: Column) -> Column:
    return st.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | st.startswith("DECIMAL")


def _tag(st: Column, tag: str) -> Column:
    return st.rlike(r"^OBJECT<`?\$" + tag[1:] + r"`?: ")


def truthy(v: Column) -> Column:
    """JS truthiness of a JSON value: 0, NaN and '' are false, 'false' is true."""
    st = F.schema_of_variant(v)
    return (F.when(v.isNull() | (st == "VOID"), F.lit(None).cast("boolean"))
            .when(st == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(_is_num(st), F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(False)))
            .when(st == "STRING", F.length(F.try_variant_get(v, "$", "string")) > 0)
            .otherwise(F.lit(True)))


def doc_value(v: Column, raw_json: Column, ctype: str, dialect: str) -> tuple[Column, Column]:
    """(converted value, ok flag) for one document value and target canonical
    type. ``raw_json`` is the value's JSON text (original key order), used
    for objects/arrays. ``ok`` is false when a present value cannot convert."""
    st = F.schema_of_variant(v)
    present = v.isNotNull() & (st != "VOID")
    dbl = F.try_variant_get(v, "$", "double")
    s = F.try_variant_get(v, "$", "string")
    oid = F.try_variant_get(v, "$['$oid']", "string")
    if ctype in ("string", "mixed", "unknown", "null", "time", "uuid"):
        val = (F.when(~present, F.lit(None).cast("string")).when(st == "STRING", s)
               .when(_is_num(st), js_string(v)).when(st == "BOOLEAN", F.lower(s))
               .when(_tag(st, "$oid") & F.lit(dialect == "mysql"), oid)
               .otherwise(raw_json))
        return val, F.lit(True)
    if ctype in ("int", "long"):
        # whole numbers never pass through a double, which holds 53 bits
        whole = F.when(st.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, "$", "bigint")) \
                 .when(st == "STRING", s.try_cast("bigint")) \
                 .when(_tag(st, "$numberLong"), F.try_variant_get(v, "$['$numberLong']", "string").try_cast("bigint"))
        num = F.when(_is_num(st), dbl).when(st == "STRING", s.try_cast("double"))
        if dialect == "mysql":   # fractions are truncated
            val = F.when(num.isNotNull(), F.when(num < 0, F.ceil(num)).otherwise(F.floor(num)))
        else:                    # the value (or its text) must be an integer for the column
            val = F.when(num == F.floor(num), num)
        out = F.coalesce(whole, val.try_cast("bigint"))
        if ctype == "int":
            out = out.try_cast("int")
        return out, ~present | out.isNotNull()
    if ctype in ("double", "float"):
        out = F.when(_is_num(st), dbl).when(st == "STRING", s.try_cast("double"))
        return out.cast(CANONICAL_TO_SPARK[ctype]), ~present | out.isNotNull()
    if ctype == "decimal":
        txt = F.coalesce(F.try_variant_get(v, "$['$numberDecimal']", "string"), s, F.when(_is_num(st), js_string(v)))
        out = txt.try_cast("decimal(38,10)")
        return out, ~present | out.isNotNull()
    if ctype == "boolean":
        b = truthy(v)
        return (b.cast("int") if dialect == "mysql" else b), F.lit(True)
    if ctype in ("date", "timestamp"):
        d = F.try_variant_get(v, "$['$date']", "string")
        out = (F.when(_tag(st, "$date"), F.try_to_timestamp(d))
               .when(_is_num(st), F.timestamp_millis(dbl.cast("long")))
               .when(st == "STRING", F.try_to_timestamp(s)))
        if ctype == "date":
            out = out.cast("date")
        return out, ~present | out.isNotNull()
    if ctype == "binary":
        b64 = F.coalesce(F.try_variant_get(v, "$['$binary'].base64", "string"),
                         F.try_variant_get(v, "$['$binary']", "string"), s)
        out = F.try_to_binary(b64, F.lit("base64"))
        if dialect == "pg":      # what holds no bytes is stored as its JSON (see value_warning)
            bytes_ = F.when(_holds_bytes(v), F.try_to_binary(_base64_of(v), F.lit("base64")))
            return F.when(present, F.coalesce(bytes_, F.encode(raw_json, "UTF-8"))), F.lit(True)
        return out, ~present | out.isNotNull()
    if ctype == "objectid":
        return F.coalesce(oid, s), F.lit(True)
    if ctype in ("json", "jsonb", "array"):
        return F.when(present, raw_json), F.lit(True)
    raise ValueError(f"unknown canonical type {ctype}")


def _base64_of(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$['$binary'].base64", "string"), F.try_variant_get(v, "$['$binary']", "string"))


def _holds_bytes(v: Column) -> Column:
    return F.try_to_binary(_base64_of(v), F.lit("base64")).isNotNull()


def value_warning(v: Column, raw_json: Column, ctype: str, dialect: str) -> Column:
    """The warning code of one document value, or null: ``object_to_json``
    (MySQL) when an object/array lands in a text column, ``binary_coerce_failed``
    (PG) when a value for a binary column holds no bytes and its JSON is
    stored, ``json_stringify_failed`` when a present value has no JSON text
    and the column stays null."""
    st = F.schema_of_variant(v)
    present = v.isNotNull() & (st != "VOID")
    code = F.lit(None).cast("string")
    if dialect == "mysql" and ctype in ("string", "mixed", "unknown", "null"):
        code = F.when((st.startswith("OBJECT") | st.startswith("ARRAY")) & ~_tag(st, "$oid"), F.lit("object_to_json"))
    elif dialect == "pg" and ctype == "binary":
        code = F.when(present & ~_holds_bytes(v), F.lit("binary_coerce_failed"))
    elif ctype in ("json", "jsonb", "array"):
        code = F.when(present & raw_json.isNull(), F.lit("json_stringify_failed"))
    return code


def map_doc_rows(docs: DataFrame, cols: list[Col], dialect: str, doc: str = "doc",
                 text: str = "doc_text", keep: list[str] | None = None) -> DataFrame:
    """The single mapping projection: typed columns plus ``_bad`` (columns
    that failed to convert) and ``_warn`` (row warnings). Consumers that need
    both valid rows and rejects from one pass use this directly."""
    keep = keep or []
    names = dedup_names([_clean_py(c.name, dialect) for c in cols])
    # stage 1: each field's value, computed once per row; filters on what failed or warned stay above it
    stage = computed_once(docs.select(*keep, F.col(text).alias("_text"), F.col(doc).alias("_doc")), F.col("_doc").try_cast(MAP_VARIANT).alias("_m"))
    stage = computed_once(stage.select(*keep, "_text", "_m"), *[F.col("_m")[c.name].alias(f"_v{i}") for i, c in enumerate(cols)])
    vals, oks, warns = [], [], []
    for i, (c, n) in enumerate(zip(cols, names)):
        v = F.col(f"_v{i}")
        raw = F.get_json_object(F.col("_text"), "$['" + c.name.replace("'", "\\'") + "']")
        val, ok = doc_value(v, raw, c.type, dialect)
        vals.append(val.alias(n))
        oks.append(F.when(~ok, F.lit(n)))
        code = value_warning(v, raw, c.type, dialect)
        warns.append(F.when(code.isNotNull(), F.struct(F.lit(n).alias("column"), code.alias("code"))))
    return stage.select(*keep, *vals, F.array_compact(F.array(*oks)).alias("_bad"),
                        F.array_compact(F.array(*warns)).alias("_warn"))


def map_doc_to_sql(docs: DataFrame, cols: list[Col], dialect: str, doc: str = "doc",
                   text: str = "doc_text", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X1 (pg) / X2 (mysql): documents -> typed rows. Only schema columns
    survive; names are cleaned and de-duplicated. Returns (mapped, rejects,
    warnings); a reject lists the columns that failed to convert."""
    keep = keep or []
    d = map_doc_rows(docs, cols, dialect, doc, text, keep)
    mapped = d.filter(F.size("_bad") == 0).drop("_bad", "_warn")
    rejects = d.filter(F.size("_bad") > 0).select(*keep, F.array_join("_bad", ",").alias("failed_columns"))
    warnings = warning_counts(d.select(F.explode("_warn").alias("w")).select("w.*"))
    return mapped, rejects, warnings


def map_changes(changes: DataFrame, cols: list[Col], dialect: str, keep: list[str]) -> DataFrame:
    """Every normalised change event through the document mapper in one pass, with an ``outcome``: ``apply`` (typed
    columns), ``delete`` (key only, nothing to convert) or ``reject`` (``failed_columns`` names what did not convert; its
    values are null). No event is lost: outcomes add up to the events."""
    d = changes.withColumn("doc_text", F.coalesce("doc", F.lit("{}"))).withColumn("doc", F.try_parse_json("doc_text"))
    names = dedup_names([_clean_py(c.name, dialect) for c in cols])
    rows = map_doc_rows(d, cols, dialect, keep=list(dict.fromkeys([*keep, "op"])))
    bad = (F.size("_bad") > 0) & (F.col("op") != "delete")
    outcome = F.when(F.col("op") == "delete", F.lit("delete")).when(bad, F.lit("reject")).otherwise(F.lit("apply"))
    return rows.select(*keep, outcome.alias("outcome"), F.when(bad, F.array_join("_bad", ",")).alias("failed_columns"),
                       *[F.when(~bad, F.col(n)).alias(n) for n in names])


# one canonical type of each way a value is converted, and the types that share it
FAMILIES = {"string": ("mixed", "unknown", "null", "time", "uuid"), "int": (), "long": (), "float": (), "double": (), "decimal": (),
            "boolean": (), "date": (), "timestamp": (), "binary": (), "objectid": (), "json": ("jsonb", "array")}


def destination_schema(schema: DataFrame, dialect: str, ns_cols: list[str]) -> DataFrame:
    """The inferred (or overridden) schema of any number of namespaces with each column's cleaned, distinct name."""
    from tidewater.operators.ddl import clean_ident, dedup_idents
    named = schema.withColumn("clean_name", clean_ident(F.col("column_name"), dialect))
    final = dedup_idents(named.select(*ns_cols, "ordinal", "clean_name"), ns_cols)
    return named.drop("clean_name").join(final, [*ns_cols, "ordinal"])


def map_doc_fields(docs: DataFrame, schema: DataFrame, dialect: str, ns_cols: list[str], id_col: str = "doc_id",
                   doc: str = "doc", text: str = "doc_text") -> DataFrame:
    """X1/X2 for collections of unlike shape, with the schema as a table: each
    document's fields are joined with their own collection's columns
    (``destination_schema``), so nothing of the schema is on the driver and
    the number of keys is unbounded. One row per field: namespace, id,
    ``column_name`` (at the destination), ``type``, ``value`` (as text; bytes
    as base64), ``ok``, ``warning``. Keys without a column are left out."""
    base = computed_once(docs.select(*ns_cols, id_col, F.col(doc).alias("_doc"), F.col(text).alias("_text")), F.col("_doc").try_cast(MAP_VARIANT).alias("_m"),
                         F.from_json("_text", "map<string,string>").alias("_r"), F.json_object_keys("_text").alias("_keys"))
    base = base.select(*ns_cols, id_col, "_m", "_r", F.explode("_keys").alias("_key"))
    fields = base.select(*ns_cols, id_col, "_key", F.element_at("_m", F.col("_key")).alias("_v"), F.element_at("_r", F.col("_key")).alias("_raw"))
    columns = schema.select(*ns_cols, F.col("column_name").alias("_key"), F.col("final_name").alias("column_name"), "type")
    # dealt by document again: a collection's documents all have the same few keys, which lie in few tasks of the join
    f = fields.join(columns, [*ns_cols, "_key"]).repartition(*ns_cols, id_col)
    value, ok, warning = F.lit(None).cast("string"), F.lit(True), F.lit(None).cast("string")
    for kind, alike in FAMILIES.items():
        is_kind = F.col("type").isin(kind, *alike)
        val, good = doc_value(F.col("_v"), F.col("_raw"), kind, dialect)
        value = F.when(is_kind, F.base64(val) if kind == "binary" else val.cast("string")).otherwise(value)
        ok = F.when(is_kind, good).otherwise(ok)
        warning = F.when(is_kind, value_warning(F.col("_v"), F.col("_raw"), kind, dialect)).otherwise(warning)
    return f.select(*ns_cols, id_col, "column_name", "type", value.alias("value"), ok.alias("ok"), warning.alias("warning"))


def field_rows(fields: DataFrame, docs: DataFrame, ns_cols: list[str], id_col: str = "doc_id") -> DataFrame:
    """One row per document, also of one without a known field: its destination row as a map of texts (``row``)
    and the columns that did not convert (``failed_columns``, empty if the
    row can be written). Grouped by document, so a group is one document."""
    each = fields.select(*ns_cols, id_col, "column_name", "value", "ok")
    none = docs.select(*ns_cols, id_col, F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("ok"))
    entry = F.when(F.col("column_name").isNotNull(), F.struct("column_name", F.when(F.col("ok"), F.col("value")).alias("value")))
    return each.unionByName(none).groupBy(*ns_cols, id_col).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("row"),
        F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("column_name")))).alias("failed_columns"))


def namespace_table(rows: DataFrame, schema: DataFrame) -> DataFrame:
    """The wide table of one namespace at its write: ``schema`` is that
    namespace's columns alone, which the engine's column limit bounds."""
    cols = schema.orderBy("ordinal").select("final_name", "type").collect()
    cast = [(F.unbase64(F.col("row")[c.final_name]) if c.type == "binary" else F.col("row")[c.final_name].cast(CANONICAL_TO_SPARK[c.type]))
            .alias(c.final_name) for c in cols]
    return rows.filter(F.size("failed_columns") == 0).select(*cast)


def warning_counts(w: DataFrame) -> DataFrame:
    """Row warnings aggregated: one row per (code, column) with a count."""
    return w.groupBy("code", "column").agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


# -- SQL row -> document -----------------------------------------------------------------------------
def generated_id(df: DataFrame, cols: list[str], ordinal: Column | None = None) -> Column:
    """A deterministic 24-hex id for rows without a key: the hash of the
    row text, and for the k-th (k > 1) of several identical rows the hash of
    the text plus ``#k``, so re-runs give the same set of ids."""
    text = F.to_json(F.struct(*[F.col(c) for c in cols]))
    if ordinal is not None:
        text = F.when(ordinal > 1, F.concat(text, F.lit("#"), ordinal.cast("string"))).otherwise(text)
    return F.substring(F.sha2(text, 256), 1, 24)


def json_literal(x: Column) -> Column:
    """The JSON literal of one scalar (number, quoted and escaped string,
    true/false, null): the element text of a one-item JSON array."""
    js = F.to_json(F.array(x))
    return js.substr(F.lit(2), F.length(js) - 2)


MIXED = ("mixed", "unknown", "null", "time")
# fixed values: the digits a Decimal128 holds, and the text forms of a number it reads
DECIMAL128_DIGITS = 34
DECIMAL128 = r"(?i)^[+-]?(nan|inf(inity)?|(\d++(\.\d*+)?|\.\d++)(e[+-]?\d{1,4})?)$"


def is_decimal128(text: Column) -> Column:
    """The text is a number that a Decimal128 holds without rounding."""
    mantissa = F.regexp_replace(F.regexp_replace(text, "(?i)e.*$", ""), "[^0-9]", "")
    digits = F.length(F.regexp_replace(F.regexp_replace(mantissa, "^0++", ""), "0++$", ""))
    return text.rlike(DECIMAL128) & (digits <= DECIMAL128_DIGITS)


def nested(kind: str) -> bool:
    return kind.startswith(("struct", "array", "map", "variant"))


def sql_doc_warning(x: Column, kind: str, ctype: str, source: str) -> Column:
    """The warning code of one SQL value (of Spark type ``kind``) on its way
    into a document, or null: ``long_coerce_failed`` / ``decimal_coerce_failed``
    (the value is kept as text; also from MySQL, where the reference ends the
    run), ``mixed_to_subdoc`` (from MySQL: an object in a column of no one type)."""
    if ctype == "long" and kind == "string":
        return F.when(x.isNotNull() & x.try_cast("bigint").isNull(), F.lit("long_coerce_failed"))
    if ctype == "decimal":
        return F.when(x.isNotNull() & ~is_decimal128(x.cast("string")), F.lit("decimal_coerce_failed"))
    if source == "mysql" and ctype in MIXED and nested(kind):
        some = x.isNotNull()
        if kind == "variant":
            some = F.schema_of_variant(x).startswith("OBJECT") | F.schema_of_variant(x).startswith("ARRAY")
        return F.when(some, F.lit("mixed_to_subdoc"))
    return F.lit(None).cast("string")


def sql_sql_warning(x: Column, kind: str, ctype: str) -> Column:
    """``json_stringify_failed``: text in a JSON column that is no JSON; the
    destination's JSON column would refuse it, so it becomes null."""
    if ctype in ("json", "jsonb", "array") and kind == "string":
        return F.when(x.isNotNull() & F.try_parse_json(x).isNull(), F.lit("json_stringify_failed"))
    return F.lit(None).cast("string")


def row_warnings(df: DataFrame, cols: list[Col], source: str, dest: str) -> DataFrame:
    """Warnings of mapping SQL rows to documents (``dest`` "doc") or to the
    other SQL engine: (code, column, n_rows), from one pass over the rows."""
    kinds = dict(df.dtypes)
    codes = []
    for c in cols:
        x = F.col(c.name)
        code = sql_doc_warning(x, kinds[c.name], c.type, source) if dest == "doc" else sql_sql_warning(x, kinds[c.name], c.type)
        codes.append(F.when(code.isNotNull(), F.struct(F.lit(c.name).alias("column"), code.alias("code"))))
    return warning_counts(df.select(F.explode(F.array_compact(F.array(*codes))).alias("w")).select("w.*"))


def map_sql_to_doc(df: DataFrame, cols: list[Col], source: str) -> tuple[DataFrame, DataFrame]:
    """X3 (pg -> doc), X4 (mysql -> doc), X8-X11. Returns (documents with
    ``_id`` and JSON text ``doc``, warnings). Single PK -> ``_id`` (native
    type from PG, text from MySQL) removed from the body; composite PK ->
    generated ``_id`` + ``pk`` sub-document (MySQL keeps the PK columns in
    the body too); no PK -> generated ``_id``. Longs outside int32 are
    tagged ``$numberLong``; a null column stays as a null field; decimals ``$numberDecimal``; JSON text parsed;
    booleans from MySQL tinyint(1) are ``v != 0``."""
    pks = [c for c in cols if c.primary_key]
    names = [c.name for c in cols]

    kinds = dict(df.dtypes)

    def conv(c: Col) -> Column:
        x = F.col(c.name)
        if c.type == "long":
            n = x.try_cast("bigint") if kinds[c.name] == "string" else x
            long_ = F.when(n.between(-2147483648, 2147483647), json_literal(n)) \
                     .when(n.isNotNull(), F.concat(F.lit('{"$numberLong":"'), n.cast("string"), F.lit('"}')))
            return F.coalesce(long_, json_literal(x.cast("string"))) if kinds[c.name] == "string" else long_
        if c.type == "decimal":
            t = x.cast("string")
            return F.when(is_decimal128(t), F.concat(F.lit('{"$numberDecimal":"'), t, F.lit('"}'))) \
                    .when(x.isNotNull(), json_literal(t))
        if c.type in MIXED and nested(kinds[c.name]):
            return F.to_json(x)
        if c.type == "boolean":
            b = (x.cast("double") != 0) if source == "mysql" else x.cast("boolean")
            return F.when(b, F.lit("true")).when(~b, F.lit("false"))
        if c.type in ("json", "jsonb"):
            p = F.try_parse_json(x.cast("string"))
            return F.when(p.isNotNull(), F.to_json(p)).otherwise(json_literal(x.cast("string")))
        if c.type in ("timestamp", "date"):
            iso = F.date_format(x.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
            return F.when(x.isNotNull(), F.concat(F.lit('{"$date":"'), iso, F.lit('"}')))
        if c.type == "binary":
            return F.when(x.isNotNull(), F.concat(F.lit('{"$binary":"'), F.base64(x), F.lit('"}')))
        return json_literal(x)

    def kv(c: Col) -> Column:
        return F.concat(F.lit('"' + c.name + '":'), F.coalesce(conv(c), F.lit("null")))

    if len(pks) == 1:
        pk = pks[0]
        id_json = json_literal(F.col(pk.name).cast("string")) if source == "mysql" else conv(pk)
        body = [kv(c) for c in cols if c.name != pk.name]
        id_col = id_json
        extra = []
    elif len(pks) > 1:
        id_col = F.concat(F.lit('"'), generated_id(df, [c.name for c in pks]), F.lit('"'))
        extra = [F.concat(F.lit('"pk":{'), F.concat_ws(",", *[kv(c) for c in pks]), F.lit("}"))]
        body = [kv(c) for c in cols if not c.primary_key or source == "mysql"]
    else:
        from tidewater.functions.windows import dup_ordinal
        df = dup_ordinal(df, F.xxhash64(F.to_json(F.struct(*[F.col(n) for n in names]))))
        id_col = F.concat(F.lit('"'), generated_id(df, names, F.col("_dup")), F.lit('"'))
        extra, body = [], [kv(c) for c in cols]
    docs = df.select(id_col.alias("_id"),
                     F.concat(F.lit('{"_id":'), id_col, F.lit(","), F.concat_ws(",", *extra, *body), F.lit("}")).alias("doc"))
    docs = docs.withColumn("doc", F.regexp_replace("doc", ",}$", "}"))
    fk_warn = [(c.name, "fk_kept_as_reference") for c in cols if c.references]
    return docs, fk_warn


def composite_pk_violations(df: DataFrame, pk_cols: list[str]) -> DataFrame:
    """The unique index on ``pk.*``: key values held by more than one row."""
    return (df.groupBy(*pk_cols).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
            .filter(F.col("n_rows") > 1))


# -- SQL -> SQL -------------------------------------------------------------------------------------
def map_sql_to_sql(df: DataFrame, cols: list[Col], source: str, dest: str) -> DataFrame:
    """X5 (pg -> mysql): booleans -> 1/0, json/array -> text, dates kept.
    X6 (mysql -> pg): 0/1 -> boolean, json -> text, dates cut to 10 chars,
    timestamps -> ISO text. X7 (same engine): identity. Names cleaned for
    the destination everywhere."""
    names = dedup_names([_clean_py(c.name, dest) for c in cols])
    kinds = dict(df.dtypes)
    out = []
    for c, n in zip(cols, names):
        x = F.col(c.name)
        if source == dest:
            e = x
        elif c.type == "boolean":
            e = x.cast("boolean").cast("int") if dest == "mysql" else (x.cast("double") != 0)
        elif c.type in ("json", "jsonb", "array"):
            e = x.cast("string")
            if kinds[c.name] == "string":    # text that is no JSON: null and a warning
                e = F.when(sql_sql_warning(x, "string", c.type).isNull(), e)
        elif c.type == "date" and dest == "pg":
            e = F.substring(x.cast("string"), 1, 10)
        elif c.type == "timestamp" and dest == "pg":
            e = F.date_format(x.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        else:
            e = x
        out.append(e.alias(n))
    return df.select(*out)


# -- X12 -------------------------------------------------------------------------------------------------
# The nine directions and whether the source needs a database name.
DIRECTIONS = [
    ("mongodb", "postgres", "map_doc_to_pg", True), ("mongodb", "mysql", "map_doc_to_mysql", True),
    ("mongodb", "mongodb", "map_identity", True), ("postgres", "mongodb", "map_pg_to_doc", False),
    ("postgres", "mysql", "map_pg_to_mysql", False), ("postgres", "postgres", "map_identity", False),
    ("mysql", "mongodb", "map_mysql_to_doc", True), ("mysql", "postgres", "map_mysql_to_pg", True),
    ("mysql", "mysql", "map_identity", True),
]
