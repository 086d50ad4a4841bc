"""Token ids by the tokenizers library, and Parquet token files.

Texts are encoded chunk by chunk, and the ids of chunks seen before are looked up: pre-tokens never reach over a chunk's
end, so the ids are those of the whole text (tests hold them against the library's own).

``write_tokens`` writes ids as Parquet list columns: dictionary encoding for the ids, delta encoding (format version 2)
for the integer columns beside them, row groups and pages of a set size, column and offset indexes. A reader of
``doc_id`` or ``n_tokens`` reads no ids, and a filter on ``doc_id`` (files and pages ascend by it) reads few pages.
``read_spans`` reads the files back and adds each document's place in the id stream.

Defined results: a null or empty text has the end id only; rows with the same doc_id are written side by side, by
text; a null doc_id comes first; an empty table gives an empty file set; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import ChunkEncoder, read_table, small_batches
from tidewater.session import checkpoint_dir

#: Bytes of a row group, bytes of a page and rows of a page in token files.
ROW_GROUP, PAGE, PAGE_ROWS = 8 << 20, 256 << 10, 5000
#: Text passed to Python at a time, and rows read at a time: few, since a row may be a very long text.
BATCH, ROWS = "4m", 1024
TOKENS = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"


def encoder(name: str, held: dict[str, ChunkEncoder] = {}) -> ChunkEncoder:  # noqa: B006
    """The encoder for a tokenizer file (a path, or a name among the public ones); one for each Python process."""
    if name not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))
        encode, normal = tokenizer.encode, tokenizer.normalizer
        held[name] = ChunkEncoder(lambda chunk: array("I", encode(chunk, add_special_tokens=False).ids).tobytes(), fold=normal is not None and normal.normalize_str("A\n a") == "a a" and not encode(" ").ids)
    return held[name]


def with_end(ids: np.ndarray, begin: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds of texts with the end id after each."""
    return np.insert(ids, begin[1:], np.uint32(end_id)), begin + np.arange(len(begin))


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2, n_files: int | None = None) -> None:
    """Encode ``doc_id, text`` and write token files in ascending doc_id order to ``out``."""
    def run(batches):
        encode = encoder("word_bpe_49k.json" if path is None else path)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, ids, begin in encode.slices(batch.column("text")):
                ids, begin = with_end(ids, begin, end_id)
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(start + begin[:-1]), pa.array(np.diff(begin)), lists], names=[f.split()[0] for f in TOKENS.split(", ")])
                start += int(begin[-1])

    rows = docs.select("doc_id", "text")
    ranged = rows.repartitionByRange(n_files, "doc_id") if n_files else rows.repartitionByRange("doc_id")
    with small_batches(docs.sparkSession, BATCH, ROWS):
        (ranged.sortWithinPartitions("doc_id", "text").mapInArrow(run, TOKENS).write
         .option("compression", "snappy").option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE)
         .option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#tokens.list.element", "true")
         .parquet(out))


def read_spans(spark: SparkSession, files: str) -> DataFrame:
    """From token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = spark.read.schema(TOKENS).parquet(files)

    def run(batches):
        for batch in batches:
            ids = batch.column("tokens")
            values, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "start_in_part", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    spans = rows.mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (spans.join(totals.select("part", before.alias("before")), "part")
            .select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = checkpoint_dir(spark, "llm-tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), files)
    return read_spans(spark, files)
