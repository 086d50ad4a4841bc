"""Sinks (S13-S21): exports, snapshots and restores through DataFrameWriter.

Files go to the shared folder named by ``spark.checkpoint.dir`` (or a path
the caller passes); every writer is a distributed write of partition files,
so nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def render_column(c: str, dtype: T.DataType) -> Column:
    """S15 value rendering for text sinks: timestamps as ISO text, binary as
    base64, nested values as JSON, everything else as its text."""
    x = F.col(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(x, ISO_MS).alias(c)
    if isinstance(dtype, T.DateType):
        return F.date_format(x, "yyyy-MM-dd").alias(c)
    if isinstance(dtype, T.BinaryType):
        return F.base64(x).alias(c)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(x).alias(c)
    if isinstance(dtype, T.VariantType):
        return F.to_json(x).alias(c)
    return x.cast("string").alias(c)


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, delimiter: str = ",",
               header: bool = True) -> str:
    """CSV with the columns in declared order (or the chosen
    ``columns``), values rendered as text; values are quoted when needed."""
    cols = columns or df.columns
    out = df.select(*[render_column(c, df.schema[c].dataType) for c in cols])
    out.write.mode("overwrite").option("sep", delimiter).option("header", header).csv(path)
    return path


def render_document(doc: Column) -> Column:
    """Extended-JSON wrappers rendered as plain values (ObjectId -> hex,
    dates -> ISO text, Long/Decimal -> text, Binary -> base64) for the
    top-level fields of a VARIANT document; result is JSON text."""
    m = doc.try_cast("map<string,variant>")

    def one(k, v):
        st = F.schema_of_variant(v)
        out = v
        for tag in ("$binary", "$numberDecimal", "$numberLong", "$date", "$oid"):
            inner = F.try_variant_get(v, "$['" + tag + "']", "string").cast("variant")
            out = F.when(st.rlike("^OBJECT<`?\\" + tag + "`?: "), inner).otherwise(out)
        return out
    return F.to_json(F.transform_values(m, one))


def export_json(docs: DataFrame, path: str, doc_col: str = "doc") -> str:
    """JSON Lines (one document per line, splittable; the reference's
    single JSON array is not), documents rendered by ``render_document``."""
    docs.select(render_document(F.col(doc_col)).alias("value")).write.mode("overwrite").text(path)
    return path


#: Extended-JSON wrappers of one value. A quote inside a JSON string is escaped, so ``{"$`` never stands in one.
_TEXT_VALUE = r'("[^"]*+(?<!\\)")'
WRAPPED = (r'\{\s*"\$(?:oid|date|numberLong|numberInt|numberDouble|numberDecimal)"\s*:\s*' + _TEXT_VALUE + r'\s*\}',
           r'\{\s*"\$binary"\s*:\s*\{\s*"base64"\s*:\s*' + _TEXT_VALUE + r'\s*,\s*"subType"\s*:\s*"[^"]*"\s*\}\s*\}')
DATE_MS = r'\{\s*"\$date"\s*:\s*\{\s*"\$numberLong"\s*:\s*"(-?[0-9]+)"\s*\}\s*\}'


def render_document_text(text: Column) -> Column:
    """S14 at any depth, on the text of a document: ObjectIds, dates, longs, decimals and binaries become plain strings
    wherever they stand, in arrays and nested documents too; the order of keys stays. Dates given in milliseconds
    keep the number, as text. A wrapper whose text holds a quote or ends in a backslash is of none of these kinds and
    stays. Null stays null; texts of any length are read once for each of the three patterns."""
    out = F.regexp_replace(text, F.lit(DATE_MS), F.lit('"$1"'))
    for pattern in WRAPPED:
        out = F.regexp_replace(out, F.lit(pattern), F.lit("$1"))
    return out


def export_documents(docs: DataFrame, path: str, text_col: str = "doc_text") -> str:
    """Whole documents as JSON Lines, rendered at every depth by ``render_document_text``."""
    docs.select(render_document_text(F.col(text_col)).alias("value")).write.mode("overwrite").text(path)
    return path


def csv_quoted(cell: Column) -> Column:
    """A CSV cell: quoted if it holds a comma, a quote or a line end."""
    return F.when(cell.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def document_cells(text: Column, doc: Column) -> Column:
    """Key -> cell text of a document: null empty, numbers as a document engine prints them, nested values as JSON
    text with their keys in order."""
    from tidewater.functions.types import js_string
    raw, typed = F.from_json(text, "map<string,string>"), doc.try_cast("map<string,variant>")
    def cell(k, v):
        kind = F.schema_of_variant(typed[k])
        number = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return F.when(number, js_string(typed[k])).otherwise(F.coalesce(v, F.lit("")))
    return F.transform_values(raw, cell)


def export_collections(docs: DataFrame, headers: DataFrame, base: str, ns: str = "coll") -> str:
    """Every collection as CSV under the union of its own documents' keys. ``docs`` holds ``ns``, ``doc_text`` and
    ``doc``; ``headers`` holds ``ns`` and ``columns`` (an array). The header is the file ``header`` of a collection's folder,
    its rows are the part files of ``rows``. Rows join their header, so no schema passes through the driver."""
    line = lambda cells: F.array_join(F.transform(cells, csv_quoted), ",")
    headers.select(ns, line(F.col("columns")).alias("value")).write.mode("overwrite").partitionBy(ns).text(f"{base}/header")
    cells = docs.select(ns, document_cells(F.col("doc_text"), F.col("doc")).alias("cells")).join(headers.select(ns, "columns"), ns)
    rows = cells.select(ns, line(F.transform("columns", lambda k: F.coalesce(F.col("cells")[k], F.lit("")))).alias("value"))
    rows.write.mode("overwrite").partitionBy(ns).text(f"{base}/rows")
    return base


def union_columns(kv: DataFrame, ns_cols: list[str], order: list[str]) -> DataFrame:
    """The columns of a collection = union of its documents' keys in first-seen order (keys exploded per
    document, first position kept)."""
    first = kv.groupBy(*ns_cols, "key").agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first"))
    return first.groupBy(*ns_cols).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "key"))), lambda s: s["key"]).alias("columns"))


def union_header(kv: DataFrame, ns_cols: list[str], order: list[str]) -> DataFrame:
    """The CSV header of a collection as one text, and its number of columns."""
    return union_columns(kv, ns_cols, order).select(*ns_cols, F.array_join("columns", ",").alias("header"), F.size("columns").cast("long").alias("n_columns"))


def csv_value(v: Column) -> Column:
    """S16 cell text: null -> '', object/array -> JSON, else String(value)."""
    from tidewater.functions.types import js_string
    st = F.schema_of_variant(v)
    num = st.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | st.startswith("DECIMAL")
    return (F.when(v.isNull() | (st == "VOID"), F.lit(""))
            .when(st == "STRING", F.try_variant_get(v, "$", "string"))
            .when(num, js_string(v)).when(st == "BOOLEAN", F.lower(F.try_variant_get(v, "$", "string")))
            .otherwise(F.to_json(v)))


def snapshot_write(df: DataFrame, base: str, run_id: str) -> DataFrame:
    """Write one snapshot as Parquet under ``run_id=<id>`` and return its
    catalogue row (rows written; files and bytes from the written data)."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id") \
      .option("partitionOverwriteMode", "dynamic").parquet(base)
    spark = df.sparkSession
    written = spark.read.parquet(base).filter(F.col("run_id") == run_id)
    return written.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select(F.lit(run_id).alias("run_id"), "n_rows")


def snapshot_files(spark: SparkSession, base: str, run_id: str) -> DataFrame:
    """n_rows, n_files and n_bytes of a snapshot, as its files are on the shared storage. A snapshot without rows
    has no file."""
    written = spark.read.parquet(base).filter(F.col("run_id") == run_id)
    files = written.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    per_file = files.groupBy("path").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.lit(run_id).alias("run_id"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
                        F.count(F.lit(1)).cast("long").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_bytes"))


def snapshot_restore(spark: SparkSession, base: str, run_id: str, target: str) -> DataFrame:
    """Read one snapshot (partition pruning on ``run_id``) and replace the
    target with it; returns the restored target."""
    snap = spark.read.parquet(base).filter(F.col("run_id") == run_id).drop("run_id")
    snap.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
