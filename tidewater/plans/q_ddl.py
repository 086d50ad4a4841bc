"""Queries for type maps, identifiers, declared schemas and DDL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.types import (CANONICAL_TO_MYSQL, CANONICAL_TO_PG, MYSQL_TO_CANONICAL,
                                       PG_TO_CANONICAL, canonical_to_mysql, canonical_to_pg,
                                       mysql_to_canonical, pg_fallback, pg_to_canonical)
from tidewater.operators import ddl
from tidewater.plans.fixture_sql import F2, with_ctes
from tidewater.plans.registry import query
from tidewater.sources import fixtures as fx
from tidewater.sources.tables import MYSQL_SYSTEM_SCHEMAS, PG_SYSTEM_SCHEMAS, read_table


def sql_case(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def _in(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


PG_CANON_SQL = (f"CASE WHEN starts_with(pg_type, '_') THEN 'array' "
                f"ELSE {sql_case('pg_type', PG_TO_CANONICAL, chr(39) + 'string' + chr(39))} END")
PG_FALLBACK_SQL = f"(NOT starts_with(pg_type, '_') AND {sql_case('pg_type', PG_TO_CANONICAL)} IS NULL)"
MY_CANON_SQL = (f"CASE WHEN lower(my_type) = 'tinyint' AND starts_with(lower(my_column_type), 'tinyint(1)') "
                f"THEN 'boolean' ELSE {sql_case('lower(my_type)', MYSQL_TO_CANONICAL, chr(39) + 'unknown' + chr(39))} END")


@query("type_map_pg", with_ctes(F2) + f"""
SELECT pg_schema, table_name, ordinal, column_name, pg_type, {PG_CANON_SQL} AS canonical,
       {PG_FALLBACK_SQL} AS type_fallback
FROM f2""")
def type_map_pg(spark, sf_dir):
    c = fx.f2_catalog(spark, sf_dir)
    return c.select("pg_schema", "table_name", "ordinal", "column_name", "pg_type",
                    pg_to_canonical(F.col("pg_type")).alias("canonical"),
                    pg_fallback(F.col("pg_type")).alias("type_fallback"))


@query("type_map_mysql", with_ctes(F2) + f"""
SELECT my_schema, table_name, ordinal, column_name, my_type, my_column_type, {MY_CANON_SQL} AS canonical
FROM f2""")
def type_map_mysql(spark, sf_dir):
    c = fx.f2_catalog(spark, sf_dir)
    return c.select("my_schema", "table_name", "ordinal", "column_name", "my_type", "my_column_type",
                    mysql_to_canonical(F.col("my_type"), F.col("my_column_type")).alias("canonical"))


@query("ddl_types", with_ctes(F2) + f"""
SELECT pg_schema, table_name, ordinal, canonical,
       coalesce({sql_case('canonical', CANONICAL_TO_PG)}, 'TEXT') AS pg_ddl_type,
       coalesce({sql_case('canonical', CANONICAL_TO_MYSQL)}, 'TEXT') AS mysql_ddl_type
FROM (SELECT *, {PG_CANON_SQL} AS canonical FROM f2)""")
def ddl_types(spark, sf_dir):
    c = fx.f2_catalog(spark, sf_dir).withColumn("canonical", pg_to_canonical(F.col("pg_type")))
    return c.select("pg_schema", "table_name", "ordinal", "canonical",
                    canonical_to_pg(F.col("canonical")).alias("pg_ddl_type"),
                    canonical_to_mysql(F.col("canonical")).alias("mysql_ddl_type"))


# ---- T12/T13 ----------------------------------------------------------------------
def _raw_idents(spark, sf_dir):
    """Field names as documents carry them, derived from ``part``: dots,
    dollars, spaces, leading digits, blank names and over-long names."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    raw = F.concat(
        F.when(k % 31 == 0, F.lit("  ")).when(k % 5 == 0, F.concat(F.col("p_size").cast("string"), F.col("p_name")))
         .when(k % 11 == 0, F.repeat(F.col("p_name"), 8)).otherwise(F.col("p_name")),
        F.when(k % 7 == 0, F.concat(F.lit(".$"), F.col("p_type"))).otherwise(F.lit("")),
        F.when(k % 31 == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.col("p_brand"))))
    return p.select(k.alias("ident_id"), raw.alias("raw_name"))


_RAW_SQL = """
raw AS (
  SELECT p_partkey AS ident_id,
         CASE WHEN p_partkey % 31 = 0 THEN '  ' WHEN p_partkey % 5 = 0 THEN CAST(p_size AS VARCHAR) || p_name
              WHEN p_partkey % 11 = 0 THEN repeat(p_name, 8) ELSE p_name END
         || CASE WHEN p_partkey % 7 = 0 THEN '.$' || p_type ELSE '' END
         || CASE WHEN p_partkey % 31 = 0 THEN '' ELSE '.' || p_brand END AS raw_name
  FROM part
)"""

PG_CLEAN_SQL = ("substring(CASE WHEN length(trim(regexp_replace({x}, '[.$]', '_', 'g'))) = 0 THEN '_field' "
                "ELSE trim(regexp_replace({x}, '[.$]', '_', 'g')) END, 1, 63)")
MY_CLEAN_SQL = ("substring(regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9_]', '_', 'g'), '^([0-9])', '_\\1'), 1, 64)")


@query("ident_clean", with_ctes(_RAW_SQL) + f"""
SELECT ident_id, raw_name, {PG_CLEAN_SQL.format(x='raw_name')} AS pg_name,
       {MY_CLEAN_SQL.format(x='raw_name')} AS mysql_name
FROM raw""")
def ident_clean(spark, sf_dir):
    r = _raw_idents(spark, sf_dir)
    return r.select("ident_id", "raw_name", ddl.clean_ident_pg(F.col("raw_name")).alias("pg_name"),
                    ddl.clean_ident_mysql(F.col("raw_name")).alias("mysql_name"))


# ---- T14 ----------------------------------------------------------------------------
def _colliding_columns(spark, sf_dir):
    c = fx.f2_catalog(spark, sf_dir)
    j = F.col("ordinal")
    raw = (F.when(j == 1, F.lit("id")).when(j % 3 == 0, F.lit("a.b")).when(j % 3 == 1, F.lit("a$b"))
           .otherwise(F.lit("a_b")))
    return c.select(F.col("pg_schema").alias("schema"), "table_name", "ordinal",
                    ddl.clean_ident_pg(raw).alias("clean_name"))


_DEDUP_SQL_BODY = """
d0 AS (
  SELECT schema, table_name, ordinal, clean_name,
         row_number() OVER (PARTITION BY schema, table_name ORDER BY ordinal) AS rn,
         count(*) OVER (PARTITION BY schema, table_name) AS n
  FROM cleaned
),
rec AS (
  SELECT schema, table_name, rn, ordinal, clean_name AS final_name, [clean_name] AS seen FROM d0 WHERE rn = 1
  UNION ALL
  SELECT d.schema, d.table_name, d.rn, d.ordinal,
         list_filter(list_transform(range(0, d.n + 1), lambda k: d.clean_name || repeat('_', k)),
                     lambda c: NOT list_contains(r.seen, c))[1],
         list_append(r.seen, list_filter(list_transform(range(0, d.n + 1), lambda k: d.clean_name || repeat('_', k)),
                     lambda c: NOT list_contains(r.seen, c))[1])
  FROM rec r JOIN d0 d ON d.schema = r.schema AND d.table_name = r.table_name AND d.rn = r.rn + 1
)"""


@query("ident_dedup", "WITH RECURSIVE " + F2.strip() + """,
cleaned AS (
  SELECT pg_schema AS schema, table_name, ordinal,
         CASE WHEN ordinal = 1 THEN 'id' WHEN ordinal % 3 = 0 THEN 'a_b' WHEN ordinal % 3 = 1 THEN 'a_b' ELSE 'a_b' END
           AS clean_name
  FROM f2
),""" + _DEDUP_SQL_BODY + """
SELECT schema, table_name, ordinal, final_name FROM rec""")
def ident_dedup(spark, sf_dir):
    return ddl.dedup_idents(_colliding_columns(spark, sf_dir), ["schema", "table_name"])


# ---- T16-T18 ------------------------------------------------------------------------
def pg_catalog_tables(spark, sf_dir):
    c = fx.f2_catalog(spark, sf_dir).filter(~F.col("pg_schema").isin(*PG_SYSTEM_SCHEMAS))
    cols = c.select(F.col("pg_schema").alias("schema"), "table_name", "ordinal", "column_name",
                    F.col("pg_type").alias("udt"), "is_nullable", "column_default", "is_identity")
    pk = c.filter("is_pk").select(F.col("pg_schema").alias("schema"), "table_name", "column_name")
    fk = c.filter(F.col("fk_table").isNotNull()).select(
        F.col("pg_schema").alias("schema"), "table_name", "column_name",
        F.concat_ws(".", "fk_table", "fk_column").alias("ref"))
    return cols, pk, fk


def mysql_catalog_tables(spark, sf_dir):
    c = fx.f2_catalog(spark, sf_dir).filter(~F.col("my_schema").isin(*MYSQL_SYSTEM_SCHEMAS))
    cols = c.select(F.col("my_schema").alias("schema"), "table_name", "ordinal", "column_name",
                    F.col("my_type").alias("data_type"), F.col("my_column_type").alias("column_type"),
                    "is_nullable", F.col("my_extra").alias("extra"))
    pk = c.filter("is_pk").select(F.col("my_schema").alias("schema"), "table_name", "column_name")
    fk = c.filter(F.col("fk_table").isNotNull()).select(
        F.col("my_schema").alias("schema"), "table_name", "column_name",
        F.concat_ws(".", "fk_table", "fk_column").alias("ref"))
    return cols, pk, fk


def declared_pg(spark, sf_dir):
    return ddl.declared_schema_pg(*pg_catalog_tables(spark, sf_dir))


def declared_mysql(spark, sf_dir):
    return ddl.declared_schema_mysql(*mysql_catalog_tables(spark, sf_dir))


DECLARED_SQL = f"""
decl_pg AS (
  SELECT pg_schema AS schema, table_name, ordinal, column_name, {PG_CANON_SQL} AS type,
         is_nullable = 'YES' AS nullable, is_pk AS primary_key,
         CASE WHEN fk_table IS NOT NULL THEN fk_table || '.' || fk_column END AS "references",
         (is_identity = 'YES' OR coalesce(regexp_matches(column_default, '^nextval\\('), false)) AS auto_increment,
         {PG_FALLBACK_SQL} AS type_fallback
  FROM f2 WHERE pg_schema NOT IN {_in(PG_SYSTEM_SCHEMAS)}
),
decl_my AS (
  SELECT my_schema AS schema, table_name, ordinal, column_name, {MY_CANON_SQL} AS type,
         is_nullable = 'YES' AS nullable, is_pk AS primary_key,
         CASE WHEN fk_table IS NOT NULL THEN fk_table || '.' || fk_column END AS "references",
         contains(lower(my_extra), 'auto_increment') AS auto_increment,
         {MY_CANON_SQL} = 'unknown' AS type_fallback
  FROM f2 WHERE my_schema NOT IN {_in(MYSQL_SYSTEM_SCHEMAS)}
)"""


@query("declared_schema", with_ctes(F2, DECLARED_SQL) + """
SELECT 'pg' AS engine, * FROM decl_pg UNION ALL SELECT 'mysql' AS engine, * FROM decl_my""")
def declared_schema(spark, sf_dir):
    return (declared_pg(spark, sf_dir).select(F.lit("pg").alias("engine"), "*")
            .unionByName(declared_mysql(spark, sf_dir).select(F.lit("mysql").alias("engine"), "*")))


@query("pk_warnings", with_ctes(F2, DECLARED_SQL) + """
SELECT schema, table_name, 'info' AS severity, 'composite_pk' AS code, CAST(count(*) AS BIGINT) AS n_pk,
       string_agg(column_name, ', ' ORDER BY ordinal) AS pk_columns
FROM decl_pg WHERE primary_key GROUP BY schema, table_name HAVING count(*) > 1""")
def pk_warnings(spark, sf_dir):
    return ddl.pk_warnings(declared_pg(spark, sf_dir))


# ---- T15 ------------------------------------------------------------------------------
def _ddl_sql(src: str, dialect: str) -> str:
    if dialect == "pg":
        clean, q1, q2 = PG_CLEAN_SQL, '"', '"'
        typ = f"coalesce({sql_case('type', CANONICAL_TO_PG)}, 'TEXT')"
        ident, tail, dname = " GENERATED BY DEFAULT AS IDENTITY", "\n);", "pg"
    else:
        clean, q1, q2 = MY_CLEAN_SQL, "`", "`"
        typ = f"coalesce({sql_case('type', CANONICAL_TO_MYSQL)}, 'TEXT')"
        ident, tail, dname = " AUTO_INCREMENT", "\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;", "mysql"
    return f"""
cleaned_{dname} AS (SELECT *, {clean.format(x='column_name')} AS clean_name FROM {src}),
d0_{dname} AS (
  SELECT *, row_number() OVER (PARTITION BY schema, table_name ORDER BY ordinal) AS rn,
         count(*) OVER (PARTITION BY schema, table_name) AS n
  FROM cleaned_{dname}
),
rec_{dname} AS (
  SELECT schema, table_name, rn, ordinal, clean_name AS final_name, [clean_name] AS seen FROM d0_{dname} WHERE rn = 1
  UNION ALL
  SELECT d.schema, d.table_name, d.rn, d.ordinal,
         list_filter(list_transform(range(0, d.n + 1), lambda k: d.clean_name || repeat('_', k)),
                     lambda c: NOT list_contains(r.seen, c))[1],
         list_append(r.seen, list_filter(list_transform(range(0, d.n + 1), lambda k: d.clean_name || repeat('_', k)),
                     lambda c: NOT list_contains(r.seen, c))[1])
  FROM rec_{dname} r JOIN d0_{dname} d ON d.schema = r.schema AND d.table_name = r.table_name AND d.rn = r.rn + 1
),
lines_{dname} AS (
  SELECT c.schema, c.table_name, c.ordinal,
         '  {q1}' || r.final_name || '{q2} ' || {typ.replace('type', 'c.type')}
           || CASE WHEN c.nullable THEN '' ELSE ' NOT NULL' END
           || CASE WHEN c.auto_increment AND c.type IN ('int', 'long') THEN '{ident}' ELSE '' END AS line,
         CASE WHEN c.primary_key THEN '{q1}' || r.final_name || '{q2}' END AS pk
  FROM cleaned_{dname} c JOIN rec_{dname} r USING (schema, table_name, ordinal)
),
ddl_{dname} AS (
  SELECT schema, table_name, '{dname}' AS dialect, CAST(count(*) AS BIGINT) AS n_columns,
         'CREATE TABLE IF NOT EXISTS {q1}' || schema || '{q2}.{q1}' || {clean.format(x='table_name')} || '{q2} (' || chr(10)
           || string_agg(line, ',' || chr(10) ORDER BY ordinal)
           || CASE WHEN count(pk) > 0 THEN ',' || chr(10) || '  PRIMARY KEY (' || string_agg(pk, ', ' ORDER BY ordinal) || ')'
                   ELSE '' END
           || {"chr(10) || ');'" if dname == "pg" else "chr(10) || ') ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;'"} AS ddl
  FROM lines_{dname} GROUP BY schema, table_name
)"""


@query("ddl_preview", "WITH RECURSIVE " + F2.strip() + "," + DECLARED_SQL + "," + _ddl_sql("decl_my", "pg") + ","
       + _ddl_sql("decl_pg", "mysql") + """
SELECT * FROM ddl_pg UNION ALL SELECT * FROM ddl_mysql""")
def ddl_preview(spark, sf_dir):
    """MySQL catalog -> PG DDL and PG catalog -> MySQL DDL (identity clauses
    only where the source flagged auto-increment on an integer key)."""
    to_pg = ddl.ddl_preview(declared_mysql(spark, sf_dir), "pg")
    to_my = ddl.ddl_preview(declared_pg(spark, sf_dir), "mysql")
    return to_pg.unionByName(to_my)
