"""A writer whose unit is a batch of rows: a batch lands whole or not at all.

A Python data source (``spark.write.format("tidewater_batches")``). Rows come sorted by namespace and batch; a task holds
one batch at a time, writes it if none of its rows is bad and keeps its counts if one is. Each task writes files of
its own; the driver's commit names the files of the tasks that ended in one manifest per run. What no manifest names (a
failed task's files, a lost executor's, an aborted run's) has not landed, so a task that runs again writes nothing
twice. A run that is written again under its id replaces its earlier manifest; other runs stay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewater.functions.windows import row_ordinal

FORMAT = "tidewater_batches"
BATCH, ERROR = "_batch", "_error"
# COPY batches of the relational writer and chunks of the other one: fixed values
BATCH_ROWS = {"pg": 1000, "mysql": 500}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of the shared folder (a URI or a plain path) and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


@dataclass
class TaskFiles(WriterCommitMessage):
    """The files one task wrote: rows that landed and counts of its batches."""
    rows: list[str] = field(default_factory=list)
    counts: list[str] = field(default_factory=list)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.run, self.ns = options["path"].rstrip("/"), options["run"], json.loads(options["namespaces"])
        self.kept = [f.name for f in schema.fields if f.name != ERROR]

    def write(self, batches: Iterator[pa.RecordBatch]) -> TaskFiles:
        fs, root = _open(self.path)
        name, done = uuid.uuid4().hex, TaskFiles()
        fs.create_dir(f"{root}/rows", recursive=True)
        fs.create_dir(f"{root}/counts", recursive=True)
        keys = [*self.ns, BATCH]
        out, tallies, held, current = None, [], [], None

        def end() -> None:
            """Write or drop the batch held."""
            nonlocal out
            whole = pa.Table.from_batches(held)
            bad = whole[ERROR].drop_null()
            if not len(bad):
                if out is None:
                    out = pq.ParquetWriter(fs.open_output_stream(f"{root}/rows/{name}.parquet"), whole.select(self.kept).schema)
                    done.rows.append(f"rows/{name}.parquet")
                out.write_table(whole.select(self.kept))
            tallies.append([*current, whole.num_rows, len(bad), pc.min(bad).as_py() if len(bad) else None])
            held.clear()

        for b in batches:
            at = 0
            for stop in [*_changes(b, keys), b.num_rows]:
                if stop == at:
                    continue
                key = [b.column(k)[at].as_py() for k in keys]
                if current is not None and key != current and held:
                    end()
                current = key
                held.append(b.slice(at, stop - at))
                at = stop
        if held:
            end()
        if out is not None:
            out.close()
        if tallies:
            names = [*keys, "rows", "bad_rows", "error"]
            kinds = {k: b.schema.field(k).type for k in keys} | {"rows": pa.int64(), "bad_rows": pa.int64(), "error": pa.string()}
            columns = [pa.array([t[i] for t in tallies], kinds[n]) for i, n in enumerate(names)]
            with fs.open_output_stream(f"{root}/counts/{name}.parquet") as sink:
                pq.write_table(pa.table(columns, names=names), sink)
            done.counts.append(f"counts/{name}.parquet")
        return done

    def commit(self, messages: list[TaskFiles | None]) -> None:
        """One manifest names what landed; it is moved into place whole."""
        fs, root = _open(self.path)
        told = [m for m in messages if m is not None]
        fs.create_dir(f"{root}/runs", recursive=True)
        fresh = f"{root}/runs/{self.run}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(fresh) as sink:
            sink.write(json.dumps({"rows": [p for m in told for p in m.rows], "counts": [p for m in told for p in m.counts]}).encode())
        fs.move(fresh, f"{root}/runs/{self.run}.json")

    def abort(self, messages: list[TaskFiles | None]) -> None:
        """Nothing landed: the files that tasks did write go."""
        fs, root = _open(self.path)
        for m in messages:
            for p in [*m.rows, *m.counts] if m is not None else []:
                fs.delete_file(f"{root}/{p}")


def _changes(b: pa.RecordBatch, keys: list[str]) -> list[int]:
    """The rows of a record batch at which a key differs from the row before (nulls are equal)."""
    if b.num_rows < 2:
        return []
    differs = None
    for k in keys:
        x, y = b.column(k).slice(1), b.column(k).slice(0, b.num_rows - 1)
        d = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.not_equal(pc.is_null(x), pc.is_null(y)))
        differs = d if differs is None else pc.or_(differs, d)
    return [i + 1 for i in pc.indices_nonzero(differs).to_pylist()]


class Batches(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options, schema)


def write_batches(rows: DataFrame, error: Column, path: str, run: str, ns_cols: list[str], batch: Column) -> None:
    """Write ``rows`` in the batches that ``batch`` numbers within a namespace; ``error`` is null for a good row.
    (Namespace, batch) is the shuffle key: a batch is in one task, and a namespace that holds most rows is spread by its
    batches. A batch must be of bounded size (``chunks``). Working columns (``_...``) stay behind."""
    spark = rows.sparkSession
    spark.dataSource.register(Batches)
    dealt = rows.select(*[c for c in rows.columns if not c.startswith("_")], batch.cast("long").alias(BATCH), error.cast("string").alias(ERROR))
    dealt = dealt.repartition(*ns_cols, BATCH).sortWithinPartitions(*ns_cols, BATCH)
    dealt.write.format(FORMAT).mode("append").option("run", run).option("namespaces", json.dumps(ns_cols)).save(path)


def chunks(rows: DataFrame, ns_cols: list[str], key: str, size: int) -> DataFrame:
    """``_batch``: rows in key order cut into consecutive chunks of ``size`` per namespace, the last one smaller."""
    return row_ordinal(rows, ns_cols, key, "_at").withColumn(BATCH, F.floor((F.col("_at") - 1) / size).cast("long")).drop("_at")


def _files(path: str, kind: str, run: str | None) -> list[str]:
    """The files of a kind that the manifests name (one entry per task, not per row or batch)."""
    path = path.rstrip("/")
    fs, root = _open(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/runs", allow_not_found=True))
    names = sorted(i.path for i in found if i.base_name.endswith(".json") and (run is None or i.base_name == f"{run}.json"))
    out = []
    for n in names:
        with fs.open_input_stream(n) as source:
            out += [f"{path}/{p}" for p in json.loads(source.read())[kind]]
    return out


def landed(spark: SparkSession, path: str, schema: StructType, run: str | None = None) -> DataFrame:
    """The rows that landed (of one run, or of all), with their ``_batch``."""
    kept = StructType([f for f in schema.fields if not f.name.startswith("_")] + [StructField(BATCH, LongType())])
    files = _files(path, "rows", run)
    return spark.read.schema(kept).parquet(*files) if files else spark.createDataFrame([], kept)


def outcomes(spark: SparkSession, path: str, ns: StructType, run: str | None = None) -> DataFrame:
    """One row per batch: namespace, ``_batch``, rows, bad_rows and the smallest error text (null if it landed)."""
    kept = StructType([*ns.fields, StructField(BATCH, LongType()), StructField("rows", LongType()),
                       StructField("bad_rows", LongType()), StructField("error", StringType())])
    files = _files(path, "counts", run)
    return spark.read.schema(kept).parquet(*files) if files else spark.createDataFrame([], kept)
