"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidewater.session import checkpoint_dir

#: A chunk ends before a blank that follows no white space, and between a letter or number and one of a few ASCII signs.
#: Every pre-token pattern in use starts a new match there, so chunks can be encoded on their own.
SIGN = r"([\pL\pN])([.,;:!?%$&*#])"
#: A text with this is a single chunk: white space of any engine before a blank, or the byte that marks chunks' ends.
#: When lower-casing, also the one letter whose lower case ends with a combining mark, which a sign after it would join.
MARKED_LOWER = r"\x{0130}"
UNSPLIT = r"[\s\v\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |\x00"

#: Entries of a young generation of a memo; with ``LONG``, bounds the memory of a Python worker.
MEMO_ENTRIES = 500_000
#: Keys of this length or more are not remembered.
LONG = 100
#: Bytes of text that are encoded together.
SLICE_BYTES = 12 << 20


class Memo(dict):
    """Remembers what ``make`` gives for a key, in two generations: keys not asked for while a generation fills go."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) >= LONG:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ChunkEncoder:
    """Encodes texts to ids (32 bits) chunk by chunk. ``encode``: the ids of a chunk as bytes. Arrow splits a column into
    chunks and codes equal ones, so each distinct chunk of a run of texts is looked up once."""

    def __init__(self, encode: Callable[[str], bytes], fold: bool = False):
        """``fold``: the encoder drops white space and lower-cases, so A-Z is lower-cased before, but in texts with
        combining marks, where that could change which characters are composed."""
        self.memo, self.fold = Memo(encode), fold

    def text(self, text: str) -> np.ndarray:
        return self.column(pa.array([text]))[0]

    def slices(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """from, to, ids, ends for runs of rows, see ``column``."""
        column = column.fill_null("")
        size = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES)))
            yield at, to, *self.column(column.slice(at, to - at))
            at = to

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (none null), and where each text's ids begin, with the end of the last."""
        if self.fold:
            column = pc.if_else(pc.match_substring_regex(column, r"\pM"), column, pc.ascii_lower(column))
        unsplit = pc.match_substring_regex(column, f"{UNSPLIT}|{MARKED_LOWER}" if self.fold else UNSPLIT)
        marked = pc.replace_substring(pc.replace_substring_regex(column, SIGN, r"\1\x00\2".replace(r"\x00", "\0")), " ", "\0" if self.fold else "\0 ")
        parts = pc.split_pattern(pc.if_else(unsplit, "", marked), "\0")
        begin = parts.offsets.to_numpy().astype(np.int64)
        first = begin[:-1] - begin[0]
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        blobs = list(map(self.memo.__getitem__, coded.dictionary.to_pylist()))
        alone = np.flatnonzero(unsplit.to_numpy(zero_copy_only=False))
        codes[first[alone]] = len(blobs) + np.arange(len(alone))
        blobs += [self.memo[column[i].as_py()] for i in alone.tolist()]
        length = np.array(list(map(len, blobs)), np.int64) // 4
        values = np.frombuffer(b"".join(blobs), "<u4")
        starts = np.cumsum(length) - length
        n = length[codes]
        ends = np.cumsum(n)
        ids = values[np.repeat((starts[codes] - (ends - n)).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)]
        return ids, np.append((ends - n)[first], ends[-1])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet to the cluster's shared folder and read back: later steps read the table
    instead of running the steps before it again, also after an executor is lost."""
    spark = df.sparkSession
    path = checkpoint_dir(spark, f"llm-{name}")
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m", rows: int = 64) -> Iterator[None]:
    """Jobs started in here pass Python batches of about ``size`` at most and read Parquet ``rows`` rows at a time: for
    rows of long texts or arrays, of which the usual thousands would fill an executor's memory."""
    held = {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.parquet.columnarReaderBatchSize": str(rows)}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``saved`` wrote and nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of steps that nothing refers to any more; it acts when the driver
    collects its garbage, which a driver with much memory seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Apply ``make()``'s function to each Arrow batch; ``make`` runs once in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts one by one; null counts as empty."""
    column = batch.column(name)
    for i in range(len(column)):
        yield column[i].as_py() or ""


def utf8_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    column = batch.column(name)
    column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    for i in range(len(column)):
        yield column[i].as_py() or b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds), vectorised."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
