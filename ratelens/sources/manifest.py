"""Evaluation manifests and resumable records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelens import schemas


def load_manifest(spark: SparkSession, path: str, *, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cases, rejects) of all manifest files at ``path``.

    With ``lines``, each line of a file is a manifest of its own: opening a file
    costs far more than reading a manifest, where there are many.
    Rejected: wrong schema version, empty or path-unsafe id, an id seen before in
    its manifest, and anything but exactly one of command / measurement.
    """
    docs = (
        spark.read.schema(schemas.MANIFEST)
        .option("multiLine", not lines)
        .json(path)
        .withColumn("manifest", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"))
        .withColumn("_doc", F.monotonically_increasing_id() if lines else F.lit(0))
    )
    cases = docs.select("manifest", "_doc", "schema_version", F.posexplode("cases").alias("pos", "_c")).select(
        "manifest", "_doc", "schema_version", "pos", F.trim("_c.id").alias("case_id"), "_c.source", "_c.command",
        "_c.measurement", "_c.metadata",
    )
    cases = cases.withColumn("_first", F.min("pos").over(Window.partitionBy("manifest", "_doc", "case_id")))
    has_command = F.coalesce(F.size("command"), F.lit(0)) > 0
    has_measurement = F.col("measurement").isNotNull()
    cases = cases.withColumn(
        "reason",
        F.when(F.coalesce(F.col("schema_version"), F.lit(0)) != schemas.MANIFEST_VERSION, "unsupported schema version")
        .when(F.coalesce(F.col("case_id"), F.lit("")) == "", "id is missing")
        .when(F.col("case_id").rlike(r"[/\\]"), "id is not path-safe")
        .when(F.col("pos") > F.col("_first"), "id is not unique")
        .when(F.coalesce(F.trim("source"), F.lit("")) == "", "source is missing")
        .when(F.exists(F.coalesce("command", F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) == ""), "command is not a string list")
        .when(has_command == has_measurement, "needs exactly one of command or measurement"),
    ).drop("_first", "_doc")
    folder = F.regexp_replace("manifest", "/[^/]*$", "")
    cases = cases.withColumn(
        "source", F.when(F.startswith(F.col("source"), F.lit("/")), F.col("source")).otherwise(F.concat_ws("/", folder, "source"))
    )
    return cases.filter(F.col("reason").isNull()).drop("reason"), cases.filter(F.col("reason").isNotNull())


def latest_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key: a map-side combined max_by, so hot keys shrink before the shuffle."""
    row = F.struct(*[F.col(c) for c in records.columns])
    return records.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.col(order)).alias("_r")).select("_r.*")


def pending_cases(cases: DataFrame, records: DataFrame, key: str, order: str, error: str = "error") -> DataFrame:
    """Cases whose latest record is missing or failed."""
    done = latest_records(records, key, order).filter(F.col(error).isNull()).select(key)
    return cases.join(done, key, "left_anti")
