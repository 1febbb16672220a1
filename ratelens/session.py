"""Session helpers: where intermediate results may be written, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of
    its own; on a cluster an unset folder is an error, since a path on one
    machine would not survive the loss of that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="ratelens-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and forget how it was computed.

    Used between rounds of the bounded iterations, so that round *r* neither
    replans nor recomputes rounds ``1..r-1`` and a lost executor only costs a
    re-read.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spill(df: DataFrame, name: str = "spill") -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it from there.

    For frame-sized results that several later steps read: each of them then
    scans only its own columns instead of repeating the shuffle behind ``df``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the configured number of partitions.

    Spark merges the partitions of its own shuffles until they have enough
    compressed bytes. Folding a plan costs far more time per byte than a scan, and
    small rows in maps or sorts far more memory, so these are not to be merged.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
