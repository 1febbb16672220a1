"""Per-frame scores from scorer output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens import schemas
from ratelens.functions.text import number, whole_number
from ratelens.operators.frames import check_contiguous


def parse_score_json(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """(frame scores, rejected documents). Scores must lie in 0..100, frame numbers must increase."""
    keep = [c for c in df.columns if c != json_col]
    # Parsed behind generators, so that the filters below do not parse again.
    docs = df.select("*", F.explode(F.array(F.from_json(json_col, schemas.SCORES))).alias("_d"))
    frames = F.transform(
        "_d.frames",
        lambda f, i: F.struct(F.coalesce(f.frameNum, i.cast("long")).alias("frame_no"), f.metrics.vmaf.alias("score")),
    )
    docs = docs.select("*", F.explode(F.array(frames)).alias("_f"))
    bad_score = F.exists("_f", lambda f: f.score.isNull() | F.isnan(f.score) | (f.score < 0) | (f.score > 100))
    numbers = F.transform("_f", lambda f: f.frame_no)
    later = F.slice(numbers, F.lit(2), F.greatest(F.size("_f") - 1, F.lit(0)))
    unordered = F.exists(
        F.zip_with(numbers, later, lambda a, b: F.coalesce(b <= a, F.lit(False))), lambda x: x
    )
    docs = docs.withColumn(
        "reason",
        F.when(F.coalesce(F.size("_f"), F.lit(0)) <= 0, "no per-frame scores")
        .when(bad_score, "invalid per-frame score")
        .when(unordered, "frame numbers not strictly increasing"),
    )
    frames = docs.filter(F.col("reason").isNull()).select(
        *keep, F.col("_d.pooled_metrics.vmaf.mean").alias("pooled_mean"), F.inline("_f")
    )
    return frames, docs.filter(F.col("reason").isNotNull()).select(*df.columns, "reason")


def read_score_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frame scores, rejected files) of headed CSV files; one file is one clip.

    Frame numbers must be exactly 0..n-1. Header names are matched without case
    (``frame``/``framenum``, ``vmaf``/``vmaf_score``); files may differ in column
    order, so each line is addressed by its own file's header.
    """
    lines = (
        spark.read.text(path)
        .select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("clip_id"), "value")
        .filter(F.trim("value") != "")
    )
    cells = F.transform(F.split("value", ","), lambda c: F.lower(F.trim(c)))
    is_header = F.exists(cells, lambda c: c.isin("frame", "framenum"))
    heads = lines.filter(is_header).groupBy("clip_id").agg(F.min_by(cells, F.lit(0)).alias("_h"))

    def at(*names: str):
        place = F.lit(0)
        for name in reversed(names):
            found = F.array_position("_h", name)
            place = F.when(found > 0, found).otherwise(place)
        place = place.cast("int")
        return F.when(place > 0, F.get(F.split("value", ","), place - 1))

    rows = lines.filter(~is_header).join(heads, "clip_id", "left")
    rows = rows.select(
        "clip_id",
        F.when(number(at("framenum", "frame")).isNotNull(), whole_number(at("framenum", "frame"))).alias("frame_no"),
        number(at("vmaf", "vmaf_score")).alias("score"),
    )
    bad = F.col("frame_no").isNull() | F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 100)
    state = check_contiguous(rows.withColumn("_bad", F.coalesce(bad, F.lit(True))), ["clip_id"], "frame_no", bad="_bad")
    reason = F.when(F.col("bad_rows") > 0, "missing column or invalid score").when(
        ~F.col("contiguous"), "frame coverage is not contiguous"
    )
    verdict = state.select("clip_id", reason.alias("reason"))
    good = rows.join(verdict.filter(F.col("reason").isNull()).select("clip_id"), "clip_id", "left_semi")
    return good, verdict.filter(F.col("reason").isNotNull())
