"""Tool logs: frame metadata, phase timings, encoder progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens import schemas
from ratelens.functions.text import number

# Keys of the frame log and the columns they become.
FRAME_KEYS = {
    "si": "lavfi.siti.si",
    "ti": "lavfi.siti.ti",
    "scd_score": "lavfi.scd.score",
    "scd_time": "lavfi.scd.time",
    "luma": "lavfi.signalstats.YAVG",
}
FRAME_START = r"(?m)(?=^frame:\s*[0-9]+\b)"


def _raw(block: Column, key: str) -> Column:
    """Text of the last ``key=value`` line of a block; NULL when there is none."""
    pattern = r"(?m)^" + key.replace(".", r"\.") + r"=(.+)$"
    return F.try_element_at(F.regexp_extract_all(block, F.lit(pattern), F.lit(1)), F.lit(-1))


def _any_bad(block: Column) -> Column:
    """Whether some value of the block is not a finite number (every line counts)."""
    bad = F.lit(False)
    for key in FRAME_KEYS.values():
        pattern = r"(?m)^" + key.replace(".", r"\.") + r"=(.+)$"
        values = F.regexp_extract_all(block, F.lit(pattern), F.lit(1))
        bad = bad | F.exists(values, lambda v: number(v).isNull())
    return bad


def _any_value(block: Column) -> Column:
    keys = "|".join(k.replace(".", r"\.") for k in FRAME_KEYS.values())
    return block.rlike(rf"(?m)^({keys})=.+$")


def parse_frame_log(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(frame rows, rejected logs). One log per row of ``df``.

    A log is split at its ``frame:`` lines, so each array element already holds
    one frame: no line numbering, no window, no shuffle.
    """
    keep = [c for c in df.columns if c != text_col]
    logs = df.withColumn("_blocks", F.split(F.col(text_col), FRAME_START))
    is_frame = lambda b: b.rlike(r"^frame:\s*[0-9]+\b")
    logs = logs.withColumn(
        "reason",
        F.when(F.exists("_blocks", lambda b: ~is_frame(b) & _any_value(b)), "values before the first frame")
        .when(~F.exists("_blocks", is_frame), "no frames")
        .when(F.exists("_blocks", _any_bad), "malformed or non-finite value"),
    )
    good = logs.filter(F.col("reason").isNull()).select(
        *keep, F.posexplode(F.filter("_blocks", is_frame)).alias("_i", "_block")
    )
    frames = good.select(
        *keep,
        F.col("_i").cast("long").alias("frame_idx"),
        F.regexp_extract("_block", r"^frame:\s*([0-9]+)", 1).cast("long").alias("frame_no"),
        *[number(_raw(F.col("_block"), key)).alias(name) for name, key in FRAME_KEYS.items()],
    )
    return frames, logs.filter(F.col("reason").isNotNull()).select(*df.columns, "reason")


def phase_log_summary(df: DataFrame, line_col: str, order_col: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(phases, counters): seconds and count per phase; cache hits and the five counters per log."""
    line = F.trim(F.col(line_col))
    payload = F.from_json(F.regexp_extract(line, r"^\[smart phase\] (.*)$", 1), schemas.PHASE)
    seconds = F.when(F.col("_p.seconds").isNull(), F.lit(0.0)).otherwise(number("_p.seconds"))
    is_phase = F.startswith(F.col("_line"), F.lit("[smart phase] "))
    lines = df.select(*by, F.col(order_col).alias("_o"), line.alias("_line"), payload.alias("_p"))
    lines = lines.withColumn("_ok", is_phase & F.col("_p").isNotNull() & seconds.isNotNull()).withColumn(
        "_phase", F.when(F.col("_ok"), F.coalesce("_p.phase", F.lit("unknown")))
    )
    phases = (
        lines.filter("_ok")
        .groupBy(*by, F.col("_phase").alias("phase"))
        .agg(F.sum(seconds).alias("seconds"), F.count(F.lit(1)).alias("n"))
    )

    def times(*names: str) -> Column:
        return F.count_if(F.col("_phase").isin(*names))

    def prefix(text: str) -> Column:
        return F.startswith(F.col("_line"), F.lit(text))

    header = F.when(prefix("scout_windows="), F.expr("try_cast(trim(substr(_line, 15)) AS BIGINT)"))
    counters = lines.groupBy(*by).agg(
        F.greatest(
            F.lit(0).cast("long"),
            F.coalesce(F.max_by(header, F.when(header.isNotNull(), F.col("_o"))), times("content complexity scout")),
        ).alias("scout_windows"),
        times("candidate encode", "candidate pass 2", "loopback score").alias("quality_encodes"),
        times("VMAF scoring", "loopback score").alias("vmaf_measurements"),
        F.count_if(prefix("holdout=")).alias("holdout_measurements"),
        times("representative size calibration").alias("size_calibration_encodes"),
        F.count_if(prefix("[smart timing] reference cache hit:")).alias("reference_cache_hits"),
        F.count_if(prefix("[smart timing] measurement cache hit:")).alias("measurement_cache_hits"),
    )
    return phases, counters.withColumn(
        "total_cache_hits", F.col("reference_cache_hits") + F.col("measurement_cache_hits")
    )


def parse_progress(df: DataFrame, line_col: str, duration_col: str) -> DataFrame:
    """Encoder progress lines; other lines are dropped. Works on batch and streaming input."""
    line = F.col(line_col)
    clock = F.regexp_extract(line, r"time=(\d+:\d+:\d+(?:\.\d+)?)", 1)
    part = F.split(clock, ":")
    elapsed = F.when(
        clock != "",
        part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("double"),
    )
    length = F.col(duration_col)
    percent = F.when((length > 0) & elapsed.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), elapsed / length * 100.0)))
    frame = F.nullif(F.regexp_extract(line, r"frame=\s*(\d+)", 1), F.lit(""))
    return df.filter(line.contains("time=") | line.contains("speed=")).select(
        *[c for c in df.columns if c != line_col],
        F.lit("running").alias("state"),
        elapsed.alias("elapsed_sec"),
        percent.alias("percent"),
        F.regexp_extract(line, r"speed=\s*([0-9.]+x)", 1).alias("speed"),
        frame.cast("long").alias("frame"),
    )
