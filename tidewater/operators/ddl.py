"""Identifiers, declared schemas and DDL previews.

Catalog inputs are DataFrames with one row per column; every step is a
Column expression or a join on catalog keys. Per-table arrays are bounded by
the engines' column limits (1600 in PG, 4096 in MySQL), so collecting one
table's columns into a row is a proven size bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.types import (canonical_to_mysql, canonical_to_pg, mysql_to_canonical,
                                       pg_fallback, pg_to_canonical)

PG_IDENT_MAX = 63
MYSQL_IDENT_MAX = 64


def clean_ident_pg(name: Column) -> Column:
    """T12: '.' and '$' -> '_', trim (all whitespace), empty -> '_field', cut to 63."""
    s = F.regexp_replace(F.regexp_replace(name, r"[.$]", "_"), r"^\s+|\s+$", "")
    s = F.when(F.length(s) == 0, F.lit("_field")).otherwise(s)
    return F.substring(s, 1, PG_IDENT_MAX)


def clean_ident_mysql(name: Column) -> Column:
    """Anything outside [A-Za-z0-9_] -> '_', a leading digit gets '_', cut to 64."""
    s = F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_]", "_"), r"^([0-9])", "_$1")
    return F.substring(s, 1, MYSQL_IDENT_MAX)


def clean_ident(name: Column, dialect: str) -> Column:
    return clean_ident_pg(name) if dialect == "pg" else clean_ident_mysql(name)


def dedup_idents(df: DataFrame, ns_cols: list[str], ordinal: str = "ordinal", name: str = "clean_name") -> DataFrame:
    """Within each table, walk columns in ordinal order and append '_'
    to a name until it is free. Sequential by definition, so it runs as an
    ``aggregate`` over the table's ordered column array (bounded by the
    engine's column limit); tables are processed in parallel."""
    from pyspark.sql import Window
    # fast path: tables whose cleaned names are already unique keep them as is
    flagged = (df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*ns_cols, name)))
               .withColumn("_clash", F.max("_n").over(Window.partitionBy(*ns_cols)) > 1).drop("_n"))
    plain = flagged.filter(~F.col("_clash")).select(*ns_cols, F.col(ordinal), F.col(name).alias("final_name"))
    df = flagged.filter(F.col("_clash"))
    grouped = df.groupBy(*ns_cols).agg(
        F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(name).alias("n")))).alias("cols"))

    def step(acc, c):
        cands = F.transform(F.sequence(F.lit(0), F.size(grouped["cols"])),
                            lambda k: F.concat(c["n"], F.repeat(F.lit("_"), k)))
        pick = F.filter(cands, lambda x: ~F.array_contains(acc["seen"], x))[0]
        return F.struct(F.concat(acc["seen"], F.array(pick)).alias("seen"),
                        F.concat(acc["out"], F.array(F.struct(c["o"].alias("o"), pick.alias("n")))).alias("out"))

    init = F.struct(F.array().cast("array<string>").alias("seen"),
                    F.array().cast("array<struct<o:int,n:string>>").alias("out"))
    res = grouped.select(*ns_cols, F.aggregate(
        F.transform("cols", lambda c: F.struct(c["o"].cast("int").alias("o"), c["n"].alias("n"))),
        init, step)["out"].alias("out"))
    resolved = res.select(*ns_cols, F.explode("out").alias("c")).select(
        *ns_cols, F.col("c.o").alias(ordinal), F.col("c.n").alias("final_name"))
    return plain.unionByName(resolved.withColumn(ordinal, F.col(ordinal).cast(plain.schema[ordinal].dataType)))


# -- T16-T18 declared schema ---------------------------------------------------------
def declared_schema_pg(columns: DataFrame, pk: DataFrame, fk: DataFrame) -> DataFrame:
    """T16 (PG): ``columns`` (schema, table_name, ordinal, column_name, udt,
    is_nullable, column_default, is_identity), ``pk`` (schema, table_name,
    column_name), ``fk`` (schema, table_name, column_name, ref). PK is an
    EXISTS (left semi), the FK target the first match (min), identity from
    is_identity or a nextval() default."""
    keys = ["schema", "table_name", "column_name"]
    is_pk = columns.join(pk, keys, "left_semi").select(*keys).withColumn("primary_key", F.lit(True))
    ref = fk.groupBy(*keys).agg(F.min("ref").alias("references"))
    c = columns.join(is_pk, keys, "left").join(ref, keys, "left")
    return c.select(
        "schema", "table_name", "ordinal", "column_name",
        pg_to_canonical(F.col("udt")).alias("type"),
        (F.col("is_nullable") == "YES").alias("nullable"),
        F.coalesce("primary_key", F.lit(False)).alias("primary_key"),
        "references",
        ((F.col("is_identity") == "YES") | F.coalesce(F.col("column_default").rlike(r"^nextval\("), F.lit(False)))
        .alias("auto_increment"),
        pg_fallback(F.col("udt")).alias("type_fallback"),
    )


def declared_schema_mysql(columns: DataFrame, pk: DataFrame, fk: DataFrame) -> DataFrame:
    """T16 (MySQL): ``columns`` (schema, table_name, ordinal, column_name,
    data_type, column_type, is_nullable, extra)."""
    keys = ["schema", "table_name", "column_name"]
    is_pk = columns.join(pk, keys, "left_semi").select(*keys).withColumn("primary_key", F.lit(True))
    ref = fk.groupBy(*keys).agg(F.min("ref").alias("references"))
    c = columns.join(is_pk, keys, "left").join(ref, keys, "left")
    canon = mysql_to_canonical(F.col("data_type"), F.col("column_type"))
    return c.select(
        "schema", "table_name", "ordinal", "column_name", canon.alias("type"),
        (F.col("is_nullable") == "YES").alias("nullable"),
        F.coalesce("primary_key", F.lit(False)).alias("primary_key"),
        "references",
        F.lower("extra").contains("auto_increment").alias("auto_increment"),
        (canon == "unknown").alias("type_fallback"),
    )


def pk_warnings(schema: DataFrame, ns_cols=("schema", "table_name")) -> DataFrame:
    """composite_pk (info) when a table has more than one PK column."""
    return (schema.filter("primary_key").groupBy(*ns_cols)
            .agg(F.count(F.lit(1)).alias("n_pk"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))),
                                          lambda s: s["column_name"]), ", ").alias("pk_columns"))
            .filter(F.col("n_pk") > 1)
            .select(*ns_cols, F.lit("info").alias("severity"), F.lit("composite_pk").alias("code"),
                    F.col("n_pk").cast("long").alias("n_pk"), "pk_columns"))


# -- T15 DDL preview -----------------------------------------------------------------
def ddl_preview(schema: DataFrame, dialect: str, ns_cols=("schema", "table_name"),
                drop: bool = False, if_not_exists: bool = True) -> DataFrame:
    """One CREATE TABLE text per table from a translated schema
    (ordinal, column_name, type, nullable, primary_key, auto_increment).
    Names are cleaned (T12/T13) and de-duplicated (T14) first."""
    schema_col, table_col = ns_cols
    cleaned = schema.withColumn("clean_name", clean_ident(F.col("column_name"), dialect))
    names = dedup_idents(cleaned, list(ns_cols))
    cols = cleaned.join(names, [*ns_cols, "ordinal"])
    q = (lambda x: F.concat(F.lit('"'), x, F.lit('"'))) if dialect == "pg" else \
        (lambda x: F.concat(F.lit("`"), x, F.lit("`")))
    sql_type = canonical_to_pg(F.col("type")) if dialect == "pg" else canonical_to_mysql(F.col("type"))
    ident_clause = " GENERATED BY DEFAULT AS IDENTITY" if dialect == "pg" else " AUTO_INCREMENT"
    line = F.concat(
        F.lit("  "), q(F.col("final_name")), F.lit(" "), sql_type,
        F.when(F.col("nullable"), F.lit("")).otherwise(F.lit(" NOT NULL")),
        F.when(F.col("auto_increment") & F.col("type").isin("int", "long"), F.lit(ident_clause)).otherwise(F.lit("")))
    per_table = cols.groupBy(*ns_cols).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"),
                                             F.when(F.col("primary_key"), q(F.col("final_name"))).alias("pk"))))
        .alias("c"))
    table_name = clean_ident(F.col(table_col), dialect)
    qualified = F.concat(q(F.col(schema_col)), F.lit("."), q(table_name))
    pk_list = F.filter(F.transform("c", lambda s: s["pk"]), lambda x: x.isNotNull())
    body = F.concat(
        F.lit("CREATE TABLE " + ("IF NOT EXISTS " if if_not_exists else "")), qualified, F.lit(" (\n"),
        F.array_join(F.transform("c", lambda s: s["line"]), ",\n"),
        F.when(F.size(pk_list) > 0, F.concat(F.lit(",\n  PRIMARY KEY ("), F.array_join(pk_list, ", "), F.lit(")")))
         .otherwise(F.lit("")),
        F.lit("\n);" if dialect == "pg" else "\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;"))
    if drop:
        body = F.concat(F.lit("DROP TABLE IF EXISTS "), qualified,
                        F.lit(" CASCADE;\n" if dialect == "pg" else ";\n"), body)
    return per_table.select(*ns_cols, F.lit(dialect).alias("dialect"),
                            F.size("c").cast("long").alias("n_columns"), body.alias("ddl"))
