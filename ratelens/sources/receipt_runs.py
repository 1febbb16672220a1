"""Receipts in sorted runs, so that a lookup of few fingerprints reads few files.

Every append writes one run: files of consecutive fingerprint ranges, and after them
an index with each file's range and a Bloom filter of its fingerprints. A run
counts once its index is written. When ``FANOUT`` runs of a level have come
together, they are merged into one of the next level, so a store has few runs and
each receipt is rewritten a logarithmic number of times. One writer at a time; readers
never see half a run. Replaced runs stay on disk until :func:`drop_replaced`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens import schemas
from ratelens.sources.manifest import latest_records

FANOUT = 4
#: Fingerprints per file, or so.
ROWS_PER_FILE = 1_000_000
#: Hashes and bits per fingerprint of a file's filter. Bits come in blocks of 32768, Spark's bitmap size.
HASHES = 3
BITS_PER_KEY = 10
BLOCK = 32_768
KEY = "fingerprint"


def _index(spark: SparkSession, root: str) -> DataFrame | None:
    """Index rows of the runs that no later run replaces; null for an empty store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/index")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(f"{root}/index")
    gone = rows.select(F.explode("replaces").alias("run")).distinct()
    return rows.join(gone, "run", "left_anti")


def _runs(index: DataFrame | None) -> list[tuple[int, int]]:
    """(run, level): a few per level, and as many levels as the logarithm of the appends."""
    return [] if index is None else [tuple(r) for r in index.select("run", "level").distinct().orderBy("run").collect()]


def _bit(key: Column, salt: Column, width: Column) -> Column:
    """1-based place of a fingerprint in a filter of ``width`` bits."""
    return F.pmod(F.xxhash64(key, salt), width) + 1


def _write_run(spark: SparkSession, root: str, rows: DataFrame, run: int, level: int, replaces: list[int], per_file: int) -> None:
    files = max(1, -(-rows.count() // per_file))
    data = f"{root}/data/run={run}"
    rows.repartitionByRange(files, KEY).sortWithinPartitions(KEY).write.mode("overwrite").parquet(data)
    keys = spark.read.schema(rows.schema).parquet(data).select(KEY, F.col("_metadata.file_name").alias("file"))
    ranges = keys.groupBy("file").agg(F.min(KEY).alias("low"), F.max(KEY).alias("high"), F.count("*").alias("rows"))
    ranges = ranges.withColumn("width", F.ceil(F.col("rows") * BITS_PER_KEY / BLOCK) * BLOCK)
    salted = keys.join(ranges.select("file", "width"), "file").withColumn("salt", F.explode(F.sequence(F.lit(1), F.lit(HASHES))))
    place = salted.select("file", _bit(F.col(KEY), F.col("salt"), F.col("width")).alias("b"))
    filters = place.groupBy("file", F.bitmap_bucket_number("b").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    index = ranges.join(filters, "file").select(
        F.lit(level).alias("level"), F.array(*[F.lit(r) for r in replaces]).cast("array<int>").alias("replaces"), "file", "low", "high", "rows", "width", "block", "bits"
    )
    index.write.mode("overwrite").parquet(f"{root}/index/run={run}")


def _kept(spark: SparkSession, root: str, runs: list[int]) -> DataFrame:
    """All receipts of the runs, one per fingerprint and version."""
    rows = spark.read.parquet(*[f"{root}/data/run={r}" for r in runs])
    key = F.struct(KEY, "schema_version", "scheme_version")
    return latest_records(rows.withColumn("_key", key), "_key", "created_at").drop("_key")


def append_run(spark: SparkSession, root: str, new: DataFrame, *, fanout: int = FANOUT, per_file: int = ROWS_PER_FILE) -> None:
    """Add receipts (``fingerprint, created_at, schema_version, scheme_version`` and more) as a run; merge full levels.

    Rows without a fingerprint are left out. An append of no rows adds nothing.
    Runs of one store have the same columns.
    """
    rows = new.where(F.col(KEY).isNotNull())
    if rows.isEmpty():
        return
    runs = _runs(_index(spark, root))
    at = max((r for r, _ in runs), default=-1) + 1
    _write_run(spark, root, rows, at, 0, [], per_file)
    runs.append((at, 0))
    level = 0
    while len(full := [r for r, own in runs if own == level]) >= fanout:
        at += 1
        _write_run(spark, root, _kept(spark, root, full), at, level + 1, full, per_file)
        runs = [r for r in runs if r[0] not in full] + [(at, level + 1)]
        level += 1


def receipt_files(spark: SparkSession, root: str, wanted: DataFrame) -> list[str]:
    """Paths of the files that may hold a receipt of one of ``wanted`` (``fingerprint``).

    Ranges and filters are joined by the fingerprints' first character and by the
    filters' blocks; only file names reach the driver.
    """
    index = _index(spark, root)
    if index is None:
        return []
    keys = wanted.select(KEY).where(F.col(KEY).isNotNull()).distinct()
    files = index.select("run", "file", "low", "high", "width").distinct()
    files = files.withColumn("first", F.explode(F.sequence(F.ascii("low"), F.ascii("high"))))
    near = keys.withColumn("first", F.ascii(KEY)).join(files, "first").where(F.col(KEY).between(F.col("low"), F.col("high")))
    asked = near.withColumn("salt", F.explode(F.sequence(F.lit(1), F.lit(HASHES)))).withColumn("b", _bit(F.col(KEY), F.col("salt"), F.col("width")))
    asked = asked.select(KEY, "run", "file", F.bitmap_bucket_number("b").alias("block"), F.bitmap_bit_position("b").cast("int").alias("at"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = asked.join(index.select("run", "file", "block", "bits"), ["run", "file", "block"])
    found = found.where((byte.bitwiseAND(F.pow(F.lit(2), F.col("at") % 8).cast("int"))) > 0)
    held = found.groupBy(KEY, "run", "file").count().where(F.col("count") == HASHES)
    return [f"{root}/data/run={r['run']}/{r['file']}" for r in held.select("run", "file").distinct().orderBy("run", "file").collect()]


def lookup_fingerprints(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame | None:
    """Receipts of the current versions for the fingerprints in ``wanted``, the latest per fingerprint; null for an empty store.

    Only the files that may hold them are read.
    """
    index = _index(spark, root)
    if index is None:
        return None
    schema = spark.read.parquet(f"{root}/data").drop("run").schema
    files = receipt_files(spark, root, wanted)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    current = rows.where(
        (F.col("schema_version") == schemas.RECEIPT_SCHEMA_VERSION) & (F.col("scheme_version") == schemas.RECEIPT_SCHEME_VERSION)
    )
    return latest_records(current.join(wanted.select(KEY).distinct(), KEY, "left_semi"), KEY, "created_at")


def drop_replaced(spark: SparkSession, root: str) -> list[int]:
    """Delete the data and the index of the runs that others replace, when no reader uses them any more."""
    rows = spark.read.parquet(f"{root}/index")
    gone = sorted(r["run"] for r in rows.select(F.explode("replaces").alias("run")).distinct().join(rows.select("run").distinct(), "run").collect())
    path = spark._jvm.org.apache.hadoop.fs.Path
    for run in gone:
        for part in ("data", "index"):  # a run without data is still replaced as long as its index is there
            folder = path(f"{root}/{part}/run={run}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone
