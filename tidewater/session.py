"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that hold from local[8] up to a large cluster: AQE re-plans joins
# and coalesces shuffle partitions at run time, and splits skewed partitions.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tidewater", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``. Only a local master
    may leave it unset (tests): it gets a fresh scratch folder. On a cluster a
    folder of the driver's host can't be shared, so that is an error."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (no SparkContext handle, e.g. a remote session)
        sc = None
    if not current and sc is not None:
        current = sc.getCheckpointDir()
    if not current and sc is not None and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="tidewater-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def checkpoint_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for written tables,
    stream checkpoints and snapshot versions)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    base = base.rstrip("/")
    leaf = "/".join(parts) if parts else "work"
    return f"{base}/{leaf}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Cut lineage at a stage boundary: a reliable ``checkpoint()`` into the
    shared folder named by ``spark.checkpoint.dir`` (survives executor loss;
    never a local checkpoint). Used where a result feeds several joins of a
    long pipeline, so upstream stages are not recomputed per branch."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
