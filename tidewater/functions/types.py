"""Canonical type vocabulary (section 1.1) as Column expressions and map literals.

Every mapping here is a ``create_map`` literal, evaluated inside the
generated code of the projection; no Python runs per row."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL_TYPES = ["string", "int", "long", "float", "double", "decimal", "boolean", "date",
                   "timestamp", "time", "binary", "uuid", "objectid", "json", "jsonb", "array",
                   "mixed", "null", "unknown"]

# PG pg_type.typname -> canonical ('_' prefix = array; unlisted = string).
PG_TO_CANONICAL = {
    "int2": "int", "int4": "int", "int8": "long",
    "float4": "float", "float8": "double",
    "numeric": "decimal", "money": "decimal",
    "bool": "boolean",
    "text": "string", "varchar": "string", "char": "string", "bpchar": "string", "name": "string",
    "uuid": "uuid",
    "json": "json", "jsonb": "jsonb",
    "bytea": "binary",
    "date": "date",
    "timestamp": "timestamp", "timestamptz": "timestamp",
    "time": "time", "timetz": "time",
}

# MySQL DATA_TYPE -> canonical (tinyint(1) = boolean; unlisted = unknown).
MYSQL_TO_CANONICAL = {
    "tinyint": "int", "smallint": "int", "mediumint": "int", "int": "int", "integer": "int",
    "bigint": "long",
    "float": "float",
    "double": "double", "real": "double",
    "decimal": "decimal", "numeric": "decimal",
    "char": "string", "varchar": "string",
    "text": "string", "tinytext": "string", "mediumtext": "string", "longtext": "string",
    "binary": "binary", "varbinary": "binary",
    "blob": "binary", "tinyblob": "binary", "mediumblob": "binary", "longblob": "binary",
    "bit": "binary",
    "date": "date",
    "datetime": "timestamp", "timestamp": "timestamp",
    "time": "time",
    "year": "int",
    "json": "json",
    "enum": "string", "set": "string",
}

# Canonical -> PG DDL type.
CANONICAL_TO_PG = {
    "string": "TEXT", "int": "INTEGER", "long": "BIGINT", "float": "REAL",
    "double": "DOUBLE PRECISION", "decimal": "NUMERIC", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp": "TIMESTAMPTZ", "time": "TIME", "binary": "BYTEA", "uuid": "UUID",
    "objectid": "VARCHAR(24)", "json": "JSONB", "jsonb": "JSONB", "array": "JSONB",
    "mixed": "TEXT", "null": "TEXT", "unknown": "TEXT",
}

# Canonical -> MySQL DDL type.
CANONICAL_TO_MYSQL = {
    "string": "TEXT", "int": "INT", "long": "BIGINT", "float": "FLOAT", "double": "DOUBLE",
    "decimal": "DECIMAL(65,10)", "boolean": "TINYINT(1)", "date": "DATE",
    "timestamp": "DATETIME(6)", "time": "TIME", "binary": "LONGBLOB", "uuid": "VARCHAR(36)",
    "objectid": "VARCHAR(24)", "json": "JSON", "jsonb": "JSON", "array": "JSON",
    "mixed": "TEXT", "unknown": "TEXT", "null": "TEXT",
}

# Canonical -> Spark SQL type used inside the engine.
CANONICAL_TO_SPARK = {
    "string": "string", "int": "int", "long": "bigint", "float": "float", "double": "double",
    "decimal": "decimal(38,10)", "boolean": "boolean", "date": "date", "timestamp": "timestamp",
    "time": "string", "binary": "binary", "uuid": "string", "objectid": "string",
    "json": "string", "jsonb": "string", "array": "string", "mixed": "string",
    "null": "string", "unknown": "string",
}

# Extended-JSON single-key wrappers that stand for BSON types.
EXTENDED_JSON_TAGS = {"$oid": "objectid", "$date": "timestamp", "$numberLong": "long",
                      "$numberDecimal": "decimal", "$binary": "binary", "$uuid": "uuid"}


def map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def pg_to_canonical(udt: Column) -> Column:
    """PG typname -> canonical; arrays first, unlisted names -> string."""
    return (F.when(udt.startswith("_"), F.lit("array"))
            .otherwise(F.coalesce(map_literal(PG_TO_CANONICAL)[udt], F.lit("string"))))


def pg_fallback(udt: Column) -> Column:
    """True when the PG type had no direct mapping (the ``pg_type_fallback`` warning)."""
    return ~udt.startswith("_") & map_literal(PG_TO_CANONICAL)[udt].isNull()


def mysql_to_canonical(data_type: Column, column_type: Column) -> Column:
    """MySQL DATA_TYPE / COLUMN_TYPE -> canonical; tinyint(1) is boolean."""
    d = F.lower(data_type)
    return (F.when((d == "tinyint") & F.lower(column_type).startswith("tinyint(1)"), F.lit("boolean"))
            .otherwise(F.coalesce(map_literal(MYSQL_TO_CANONICAL)[d], F.lit("unknown"))))


def canonical_to_pg(t: Column) -> Column:
    return F.coalesce(map_literal(CANONICAL_TO_PG)[t], F.lit("TEXT"))


def canonical_to_mysql(t: Column) -> Column:
    return F.coalesce(map_literal(CANONICAL_TO_MYSQL)[t], F.lit("TEXT"))


def _integral_class(x: Column) -> Column:
    return (F.when(x.between(-2147483648, 2147483647), F.lit("int"))
            .when(x.between(-9.223372036854776e18, 9.223372036854776e18), F.lit("long"))
            .otherwise(F.lit("double")))


def variant_canonical_type(v: Column) -> Column:
    """Canonical type of one VARIANT value.

    Numbers follow the document model: an integral value is ``int`` (``long``
    once it leaves the int32 range), anything else ``double``. Single-key
    extended-JSON wrappers (``{"$oid": ..}`` etc.) name their BSON type; other
    objects are ``jsonb`` and arrays ``array``. A missing value (SQL NULL)
    and a JSON null are both ``null``."""
    t = F.schema_of_variant(v)
    dbl = F.try_variant_get(v, "$", "double")
    obj_tag = F.regexp_extract(t, r"^OBJECT<`?(\$[A-Za-z]+)`?: [A-Z]+>$", 1)
    return (F.when(v.isNull() | (t == "VOID"), F.lit("null"))
            .when(t == "STRING", F.lit("string"))
            .when(t == "BOOLEAN", F.lit("boolean"))
            .when(t.startswith("ARRAY"), F.lit("array"))
            .when(t.startswith("OBJECT"),
                  F.coalesce(map_literal(EXTENDED_JSON_TAGS)[obj_tag], F.lit("jsonb")))
            .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"),
                  F.when(dbl != F.floor(dbl), F.lit("double")).otherwise(_integral_class(dbl)))
            .when(t == "DATE", F.lit("date"))
            .when(t.startswith("TIMESTAMP"), F.lit("timestamp"))
            .when(t == "BINARY", F.lit("binary"))
            .otherwise(F.lit("unknown")))


def resolve_type(non_null_types: Column, widen_numeric: bool = False) -> Column:
    """T1 resolution over the distinct non-null canonical types of a field.
    0 -> null, 1 -> that type, int+long -> long (an int32 overflow),
    otherwise mixed (or double for numeric-only sets when widening)."""
    s = F.array_sort(non_null_types)
    numeric_only = F.forall(s, lambda x: x.isin("int", "long", "double"))
    res = (F.when(F.size(s) == 0, F.lit("null"))
           .when(F.size(s) == 1, s[0])
           .when(s == F.array(F.lit("int"), F.lit("long")), F.lit("long")))
    if widen_numeric:
        res = res.when(numeric_only, F.lit("double"))
    return res.otherwise(F.lit("mixed"))


def js_string(v: Column) -> Column:
    """``String(value)`` of a JSON scalar as a document engine prints it:
    integral numbers without a fraction, strings unquoted."""
    t = F.schema_of_variant(v)
    dbl = F.try_variant_get(v, "$", "double")
    is_num = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
    return (F.when(is_num & (dbl == F.floor(dbl)) & dbl.between(-9e15, 9e15), dbl.cast("long").cast("string"))
            .when(is_num, dbl.cast("string"))
            .otherwise(F.try_variant_get(v, "$", "string")))
