"""The corpus pipeline: quality rules, line de-dup, near-duplicate removal, secret masking, packing.

Each stage works on all documents that the stage before kept and returns the columns of ``documents`` (n_chars follows
the text); the last returns the pieces of the packed sequences. Stages are written to the shared folder and reread.
``ORACLE_SQL`` is None: the rows hold token digests, which SQL can't compute; tests hold each stage against a
brute-force version on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import lines, minhash, pack, quality, secrets
from tidewater.llm.common import read_table, saved


def counted(docs: DataFrame) -> DataFrame:
    """n_chars, if there, is the length of the text again."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail."""
    return counted(quality.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that an earlier line is similar to; those that have no word left are copies and go."""
    return counted(lines.clean(docs, drop_emptied=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8 or more)."""
    return minhash.keep_one(docs, size=5, percent=80)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked."""
    return counted(secrets.mask(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack.pack(docs)


STAGES = [("quality", quality_rules), ("lines", line_dedup), ("near", near_dedup), ("secrets", secret_masking), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
