"""Media metadata from probe JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens import schemas
from ratelens.functions.media import bit_depth, fps_from_rational
from ratelens.functions.text import number, whole_number


def _rounded(value: Column) -> Column:
    return F.bround(value, 0).cast("long")


def media_from_probe(
    df: DataFrame, json_col: str, *, bytes_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(media, rejects). Rejected: unreadable JSON, no video stream, no positive duration."""
    keep = [c for c in df.columns if c != json_col]
    # Parsed behind a generator: filters on the result are not pushed below it,
    # so each document is parsed once however many columns are read from it.
    doc = df.select("*", F.explode(F.array(F.from_json(json_col, schemas.PROBE))).alias("_d"))
    streams = F.coalesce("_d.streams", F.array())
    parts = F.struct(
        F.get(F.filter(streams, lambda s: s.codec_type == "video"), F.lit(0)).alias("_v"),
        F.filter(streams, lambda s: s.codec_type == "audio").alias("_a"),
        F.filter(streams, lambda s: (s.codec_type == "subtitle") & s.codec_name.isNotNull() & (s.codec_name != "")).alias("_s"),
    )
    doc = doc.select("*", F.inline(F.array(parts)))
    doc = doc.withColumn(
        "duration",
        F.coalesce(
            F.nullif(number("_d.format.duration"), F.lit(0.0)), F.nullif(number("_v.duration"), F.lit(0.0)), F.lit(0.0)
        ),
    )
    doc = doc.withColumn(
        "reason",
        F.when(F.col("_d").isNull() | (F.col("_d.streams").isNull() & F.col("_d.format").isNull()), "unreadable probe JSON")
        .when(F.col("_v").isNull(), "no video stream")
        .when(F.col("duration") <= 0, "no positive duration"),
    )
    stated = whole_number("_d.format.bit_rate")
    zero = F.lit(0).cast("long")
    size = F.col(bytes_col) if bytes_col else zero
    from_size = F.greatest(
        F.lit(1).cast("long"), _rounded(size * 8 / F.nullif(F.col("duration"), F.lit(0.0)))
    )
    doc = doc.withColumn("format_bitrate_bps", F.when(stated > 0, stated).otherwise(from_size))
    doc = doc.withColumn(
        "audio_bitrate_bps", F.aggregate("_a", zero, lambda total, s: total + whole_number(s.bit_rate))
    )
    own = whole_number("_v.bit_rate")
    rest = F.col("format_bitrate_bps") - F.col("audio_bitrate_bps")
    guess = F.greatest(F.lit(300_000).cast("long"), _rounded(F.col("format_bitrate_bps") * 0.85))
    raw_depth = whole_number("_v.bits_per_raw_sample").cast("int")
    media = doc.filter(F.col("reason").isNull()).select(
        *keep,
        "duration",
        "format_bitrate_bps",
        F.when(own > 0, own).when(rest > 0, rest).otherwise(guess).alias("video_bitrate_bps"),
        "audio_bitrate_bps",
        F.expr("try_cast(_v.width AS INT)").alias("width"),
        F.expr("try_cast(_v.height AS INT)").alias("height"),
        fps_from_rational("_v.avg_frame_rate", "_v.r_frame_rate").alias("fps"),
        F.coalesce(F.nullif(F.col("_v.codec_name"), F.lit("")), F.lit("unknown")).alias("video_codec"),
        F.get("_a", F.lit(0))["codec_name"].alias("audio_codec"),
        F.size("_a").alias("audio_stream_count"),
        F.nullif(F.col("_v.pix_fmt"), F.lit("")).alias("pix_fmt"),
        F.when(raw_depth > 0, raw_depth).otherwise(bit_depth("_v.pix_fmt")).alias("bit_depth"),
        F.nullif(F.col("_v.color_transfer"), F.lit("")).alias("color_transfer"),
        F.transform("_s", lambda s: s.codec_name).alias("subtitle_codecs"),
    )
    rejects = doc.filter(F.col("reason").isNotNull()).select(*df.columns, "reason")
    return media, rejects
