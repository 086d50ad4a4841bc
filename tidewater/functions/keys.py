"""Row keys of any shape as one canonical text: numbers, text, object ids, booleans, dates, whole documents, and several
of them together. Equal keys have equal texts whatever engine wrote them (5 and 5.0 are one number; 5 and "5" are not),
and texts order as the keys do: by type (null, numbers, text, documents, arrays, object ids, booleans, dates), then by
value, so a canonical key can be joined, grouped, range-partitioned and sorted like any string column.

A part is a type digit and the value; ``END`` closes each part, and the NUL characters of a text are followed by U+0001,
so no text reaches into the next part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

END = "\x00\x00"
KINDS = {"0": "null", "1": "number", "2": "string", "3": "object", "4": "array", "6": "objectid", "7": "boolean", "8": "date"}
DIGITS, COMPLEMENT = "0123456789", "9876543210"


def number(value: Column) -> Column:
    """A decimal number of up to 28 digits before and 10 after the point: sign, digits before the point, the digits;
    negative ones in complement, so that texts order as numbers. Null for longer ones."""
    plain = F.regexp_replace(value.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")  # always has a point
    below = F.startswith(plain, F.lit("-"))
    bare = F.regexp_replace(plain, "^-", "")
    whole = F.split_part(bare, F.lit("."), F.lit(1))
    rest = F.split_part(bare, F.lit("."), F.lit(2))
    up = F.concat(F.lit("1"), F.lpad(F.length(whole).cast("string"), 2, "0"), whole, rest)
    down = F.concat(F.lit("0"), F.lpad((99 - F.length(whole)).cast("string"), 2, "0"), F.translate(F.concat(whole, rest), DIGITS, COMPLEMENT), F.lit("~"))
    return F.concat(F.lit("1"), F.when(below, down).otherwise(up))


def text(value: Column) -> Column:
    return F.concat(F.lit("2"), _escaped(value))


def _escaped(value: Column) -> Column:
    return F.replace(value, F.lit("\x00"), F.lit("\x00\x01"))


def of_column(column: Column, kind: str) -> Column:
    """The part of a typed column (``kind``: its SQL type)."""
    kind = kind.lower()
    if kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "long", "integer", "decimal", "float", "double"):
        part = number(column)
    elif kind == "boolean":
        part = F.concat(F.lit("7"), column.cast("int").cast("string"))
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        part = F.concat(F.lit("8"), F.substring(number(F.unix_millis(column.cast("timestamp"))), 2, 64))
    else:
        part = text(column.cast("string"))
    return F.when(column.isNull(), F.lit("0")).otherwise(part)


def of_variant(value: Column) -> Column:
    """The part of a JSON value, extended-JSON wrappers (object ids, long and decimal numbers, dates) unwrapped."""
    inner = lambda name: F.try_variant_get(value, f"$['{name}']", "string")
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    wrapped = (F.when(inner("$oid").isNotNull(), F.concat(F.lit("6"), F.lower(inner("$oid"))))
               .when(inner("$numberLong").isNotNull(), number(inner("$numberLong")))
               .when(inner("$numberInt").isNotNull(), number(inner("$numberInt")))
               .when(inner("$numberDecimal").isNotNull(), number(inner("$numberDecimal")))
               .when(inner("$date").isNotNull(), F.concat(F.lit("8"), F.substring(number(F.coalesce(
                   F.try_variant_get(value, "$['$date']['$numberLong']", "long"), F.unix_millis(F.try_to_timestamp(inner("$date"))))), 2, 64)))
               .otherwise(F.concat(F.lit("3"), _escaped(F.to_json(value)))))
    return (F.when(value.isNull(), F.lit(None).cast("string"))
            .when(F.is_variant_null(value), F.lit("0"))
            .when(F.startswith(kind, F.lit("OBJECT")), wrapped)
            .when(F.startswith(kind, F.lit("ARRAY")), F.concat(F.lit("4"), _escaped(F.to_json(value))))
            .when(kind == "BOOLEAN", F.concat(F.lit("7"), F.when(plain == "true", "1").otherwise("0")))
            .when(kind == "STRING", text(plain))
            .otherwise(number(plain)))


def key(*parts: Column) -> Column:
    """The canonical key of one or several parts (null if a part is missing)."""
    return F.concat(*[x for p in parts for x in (p, F.lit(END))])


def part(canonical: Column, i: int = 0) -> Column:
    return F.get(F.split(canonical, END.replace("\x00", r"\x00")), F.lit(i))


def kind_of(part_: Column) -> Column:
    """The type name of a part."""
    names = F.create_map(*[F.lit(x) for item in KINDS.items() for x in item])
    return names[F.substring(part_, 1, 1)]


def value_of(part_: Column) -> Column:
    """The plain text of a part (a date: milliseconds)."""
    body = F.substring(part_, 2, 1 << 30)
    digits = F.substring(body, 4, 1 << 30)
    before = F.substring(body, 2, 2).cast("int")
    below = F.substring(body, 1, 1) == "0"
    digits = F.when(below, F.translate(F.regexp_replace(digits, "~$", ""), COMPLEMENT, DIGITS)).otherwise(digits)
    before = F.when(below, 99 - before).otherwise(before)
    rest = digits.substr(before + 1, F.lit(64))
    plain = F.concat(F.when(below, F.lit("-")).otherwise(F.lit("")), digits.substr(F.lit(1), before), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")))
    first = F.substring(part_, 1, 1)
    return (F.when(first.isin("1", "8"), plain).when(first == "0", F.lit(None))
            .when(first == "7", F.when(body == "1", F.lit("true")).otherwise(F.lit("false")))
            .otherwise(F.replace(body, F.lit("\x00\x01"), F.lit("\x00"))))


def typed(part_: Column, kind: str) -> Column:
    """The value of a part as a column of SQL type ``kind``."""
    if kind.lower() in ("timestamp", "date"):
        return F.timestamp_millis(value_of(part_).cast("long")).cast(kind)
    return value_of(part_).cast(kind)
