"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Shuffle files go when the execution that made them ends, not at some later collection.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Source texts vary from bytes to megabytes, so Arrow batches are bounded by
    # size and not only by row count.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Falls back to a fresh temporary folder only in local mode, where the single
    machine is the whole cluster.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    folder = folder or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sedimenta-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over enough tasks for work that far exceeds their size in bytes.

    A row that names an archive or a file is tiny, but handling it is not. The
    explicit number keeps AQE from merging such rows into a few tasks by size. The keys
    are hashed, for a plain repartition by the keys of a distinct() before it is dropped
    from the plan as already met, and its number of tasks with it.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, F.xxhash64(*keys))


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes in this block free their shuffle files as soon as they end.

    What is written is read from storage afterwards, so nobody needs those files again.
    """
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage and survives the loss of executors. Parquet, unlike a raw
    checkpoint, lets later readers prune columns and nested fields. The shuffle files
    of the steps before do not pile up.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
