"""File inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.policy import VIDEO_EXTENSIONS


def scan_catalog(
    spark: SparkSession, root: str, extensions=VIDEO_EXTENSIONS, *, recursive: bool = True
) -> DataFrame:
    """Files below ``root`` with one of ``extensions``, ordered by lower-cased relative path.

    The content column is never selected, so only file status is read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("ignoreMissingFiles", "true")
        .load(root)
    )
    path = F.regexp_replace("path", "^file:/+", "/")
    base = root.replace("file:", "").rstrip("/") + "/"
    name = F.element_at(F.split(path, "/"), -1)
    rel = F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(name)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    return (
        files.select(
            path.alias("path"),
            rel.alias("rel_path"),
            F.regexp_replace(rel, "/?[^/]+$", "").alias("dir"),
            F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "").alias("stem"),
            ext.alias("ext"),
            F.col("length").alias("bytes"),
            F.col("modificationTime").alias("mtime"),
        )
        .filter(F.col("ext").isin(*extensions))
        .orderBy(F.lower("rel_path"), "rel_path")
    )
