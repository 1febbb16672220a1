"""Sinks: reports and the measurement store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens import schemas
from ratelens.policy import COUNTERS
from ratelens.sources.manifest import latest_records

# The report's columns and their order.
REPORT_FIELDS = (
    "case_id", "source", "error", "analysis_cost", "quality_false_pass", "false_size_block",
    "bitrate_regret_absolute_bps", "bitrate_regret_normalized", *COUNTERS,
)


def write_report(records: DataFrame, summary: DataFrame, out: str) -> None:
    """NDJSON and CSV of all records plus a JSON summary, as folders of part files below ``out``."""
    records.write.mode("overwrite").json(f"{out}/results.ndjson")
    missing = [F.lit(None).cast("string").alias(c) for c in REPORT_FIELDS if c not in records.columns]
    records.select("*", *missing).select(*REPORT_FIELDS).write.mode("overwrite").csv(
        f"{out}/results.csv", header=True
    )
    summary.write.mode("overwrite").json(f"{out}/summary.json")


def _current(receipts: DataFrame) -> DataFrame:
    return receipts.filter(
        (F.col("schema_version") == schemas.RECEIPT_SCHEMA_VERSION)
        & (F.col("scheme_version") == schemas.RECEIPT_SCHEME_VERSION)
    )


def lookup_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Stored receipts of the current versions, one per fingerprint."""
    return latest_records(_current(spark.read.parquet(path)), "fingerprint", "created_at")


def upsert_receipts(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Add ``new`` to the table at ``path``; a lookup takes the latest row per fingerprint.

    An upsert only appends files, in one commit: its cost is that of ``new``, a
    crash leaves the table as it was, and rows of other versions stay.
    """
    new.write.mode("append").parquet(path)
    return lookup_receipts(spark, path)


def compact_receipts(spark: SparkSession, path: str, target: str) -> None:
    """Write the table at ``path`` to the new folder ``target`` with one row per fingerprint and version.

    Readers move to ``target`` once it is written; ``path`` is not touched.
    """
    rows = spark.read.parquet(path)
    key = F.struct("fingerprint", "schema_version", "scheme_version")
    latest_records(rows.withColumn("_key", key), "_key", "created_at").drop("_key").write.parquet(target)
