"""Scans (S1-S8): tables, document collections, namespace lists, counts,
deterministic samples and row pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TESTDATA_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Namespaces hidden from listings (fixed values of the source engines).
MONGO_SYSTEM_DATABASES = ("admin", "local", "config")
MYSQL_SYSTEM_SCHEMAS = ("mysql", "information_schema", "performance_schema", "sys")
PG_SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S2 full table scan. Parquet keeps column pruning and filter push-down;
    timestamps without zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    casts = [F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz"
             else F.col(f.name) for f in df.schema.fields]
    return df.select(*casts)


def fan_out_small(df: DataFrame) -> DataFrame:
    """Spread a scan with few splits for the cluster's cores round-robin
    before CPU-heavy per-row work (JSON/VARIANT building): splits follow the
    file's bytes, rows its row groups, so some of few splits may have no rows.
    Large inputs already have many splits and are left alone."""
    try:
        tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < 2 * tasks:
            return df.repartition(tasks)
    except Exception:  # noqa: BLE001  (no RDD handle, e.g. a remote session)
        pass
    return df


def computed_once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with further columns, computed here and once per row: they come out of a generator of one row, so the
    optimizer can't move a filter on them, or on what is made of them, below the fan-out into the few tasks of the scan,
    nor repeat their expressions in each place that uses them."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              fetchsize: int = 1000, **options) -> DataFrame:
    """S2 live table scan through JDBC, split into parallel range reads."""
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("fetchsize", str(fetchsize)))
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower)).option("upperBound", str(upper))
                  .option("numPartitions", str(num_partitions)))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def read_documents(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """S1 full document scan: one VARIANT column ``doc`` per JSON document.
    Splittable (JSON Lines), so it parallelises by file block."""
    if fmt == "json":
        return spark.read.format("json").option("singleVariantColumn", "doc").load(path)
    return spark.read.text(path).select(F.parse_json("value").alias("doc"))


def documents_from_text(df: DataFrame, text_col: str = "doc_text") -> DataFrame:
    """S1 over a column of JSON text: parse once into VARIANT."""
    return df.withColumn("doc", F.parse_json(F.col(text_col))).drop(text_col)


def list_namespaces(namespaces: DataFrame, engine: str) -> DataFrame:
    """S3: drop system namespaces and order by name.

    ``namespaces`` has columns ``database`` and ``name`` (one row per
    collection/table, e.g. ``distinct`` of a catalog)."""
    db, name = F.col("database"), F.col("name")
    if engine == "mongo":
        keep = ~db.isin(*MONGO_SYSTEM_DATABASES) & ~name.startswith("system.")
    elif engine == "mysql":
        keep = ~db.isin(*MYSQL_SYSTEM_SCHEMAS)
    else:
        keep = ~db.isin(*PG_SYSTEM_SCHEMAS)
    return namespaces.filter(keep).select("database", "name").distinct()


def exact_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact count per namespace (one partial-aggregated pass)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n_rows"))


def sample_n(df: DataFrame, key: str | Column, n: int, seed: int = 42,
             partition_by: list[str] | None = None) -> DataFrame:
    """S6 deterministic sample of ``max(1, n)`` rows (per namespace when
    ``partition_by`` is given): smallest ``xxhash64(key, seed)`` values.

    Uses a top-k (``row_number <= n``) so each task keeps at most n rows
    per group before the shuffle merge; never materialises a whole group."""
    n = max(1, int(n))
    k = F.col(key) if isinstance(key, str) else key
    integral = isinstance(key, str) and df.schema[key].dataType.typeName() in ("long", "integer", "short")
    h = sample_rank(k, seed) if integral else F.xxhash64(k, F.lit(seed))
    if not partition_by:
        return df.withColumn("_h", h).orderBy("_h", k).limit(n).drop("_h")
    w = Window.partitionBy(*partition_by).orderBy(h, k)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def sample_rank(k: Column, seed: int = 42) -> Column:
    """Seeded pseudo-random rank of an integral key (a Lehmer-style mix that
    any SQL engine can repeat): ``(k * 1103515245 + 12345 + seed) % 2147483647``."""
    return (k * F.lit(1103515245) + F.lit(12345 + seed)) % F.lit(2147483647)


def catalog_namespaces(catalog: DataFrame, engine: str, database: str | None = None) -> DataFrame:
    """S3 over a system catalog (``database``, ``name``, ``kind``): ordinary and partitioned tables of PG
    (``relkind`` r and p), base tables of MySQL; system schemas go, ``database`` picks one; ordered by name."""
    keep = F.col("kind").isin("r", "p") if engine == "pg" else F.col("kind") == "BASE TABLE"
    if database is not None:
        keep = keep & (F.col("database") == database)
    return list_namespaces(catalog.filter(keep), engine).orderBy("database", "name")


def row_page(df: DataFrame, order_cols: list[str], limit: int, offset: int = 0) -> DataFrame:
    """S8 row page: limit clamped to 1..1000, offset >= 0, stable key order.

    Implemented as a top-(offset+limit) followed by an offset, which Spark
    runs as TakeOrderedAndProject (bounded per-task heaps, no full sort)."""
    lim = min(max(int(limit), 1), 1000)
    off = max(int(offset), 0)
    return df.orderBy(*order_cols).offset(off).limit(lim)


def fetch_rows(df: DataFrame, key: list[str] | None, limit: int, offset: int = 0, documents: bool = False) -> DataFrame:
    """S8 page with all columns, ``total`` and ``total_exact``. Without a key rows are ordered by their first column
    and then by the others, so pages neither overlap nor skip rows; equal rows are interchangeable. The total of a
    document collection is taken from its statistics in the source, so it is not marked exact."""
    page = row_page(df, key or df.columns, limit, offset)
    return page.withColumns({"total": F.lit(df.count()).cast("long"), "total_exact": F.lit(not documents)})


def approx_counts(stats: DataFrame) -> DataFrame:
    """Approximate row counts from catalog statistics: PG ``reltuples``
    (negative = never analysed -> unknown), MySQL ``table_rows`` (0 ->
    unknown); ``approx_total`` sums the known ones (unknown counts as 0, as
    the preview totals do)."""
    pg = F.when(F.col("pg_reltuples") >= 0, F.col("pg_reltuples").cast("long"))
    my = F.when(F.col("mysql_table_rows") > 0, F.col("mysql_table_rows").cast("long"))
    return stats.select("table_name", pg.alias("pg_approx"), my.alias("mysql_approx"),
                        (F.coalesce(pg, F.lit(0)) + F.coalesce(my, F.lit(0))).cast("long").alias("approx_total"))
