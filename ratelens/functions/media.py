"""Expressions over media metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelens import policy
from ratelens.functions.text import col, number


def _one_rate(raw: Column) -> Column:
    parts = F.split(raw, "/", 2)
    divisor = number(F.get(parts, F.lit(1)))
    ratio = number(F.get(parts, F.lit(0))) / F.when(divisor != 0, divisor)
    usable = raw.isNotNull() & (raw != "") & ~raw.isin("0/0", "N/A")
    return F.when(usable, F.when(raw.contains("/"), ratio).otherwise(number(raw)))


def fps_from_rational(average: Column | str, nominal: Column | str) -> Column:
    """First usable frame rate of the two ("30000/1001", "25"); NULL if neither is."""
    return F.coalesce(_one_rate(col(average)), _one_rate(col(nominal)))


def bit_depth(pix_fmt: Column | str) -> Column:
    name = F.lower(F.trim(col(pix_fmt)))
    suffix = F.nullif(F.regexp_extract(name, r"([0-9]{1,2})(?:le|be)?$", 1), F.lit("")).cast("int")
    return (
        F.when(name.isin(*policy.EIGHT_BIT_PIXEL_FORMATS), 8)
        .when(name.isin(*policy.TEN_BIT_PIXEL_FORMATS), 10)
        .when(suffix.isin(*policy.SUFFIX_BIT_DEPTHS), suffix)
    )


def quality_model(
    width: Column | str, height: Column | str, fps: Column | str, context: Column | str
) -> Column:
    """Name of the scoring model: 4K geometry seen at high fidelity, and/or high frame rate."""
    width, height = col(width), col(height)
    large = (
        width.isNotNull()
        & height.isNotNull()
        & (F.least(width, height) >= 2160)
        & (F.greatest(width, height) >= 3840)
        & (col(context) == "high_fidelity")
    )
    fast = F.coalesce(col(fps) >= policy.HFR_MIN_FPS, F.lit(False))
    models = policy.QUALITY_MODELS
    return (
        F.when(large & fast, models[True, True])
        .when(large, models[True, False])
        .when(fast, models[False, True])
        .otherwise(models[False, False])
    )


def unmeasurable_reason(color_transfer: Column | str) -> Column:
    """NULL when the source can be measured, else why not."""
    transfer = col(color_transfer)
    return F.when(
        F.lower(transfer).isin(*policy.HDR_TRANSFERS), F.concat(F.lit("HDR transfer "), transfer)
    )


def measurable(color_transfer: Column | str) -> Column:
    return unmeasurable_reason(color_transfer).isNull()


def offending_subtitles(codecs: Column | str) -> Column:
    """Distinct bitmap subtitle codecs, in first-seen order."""
    return F.array_distinct(F.filter(col(codecs), lambda c: c.isin(*policy.BITMAP_SUBTITLE_CODECS)))


def bitmap_subtitle_violation(codecs: Column | str, container: Column | str, copy: Column | str) -> Column:
    """Comma-separated codecs an MP4 output cannot carry; NULL when nothing is wrong."""
    bad = offending_subtitles(codecs)
    return F.when(col(copy) & (col(container) == "mp4") & (F.size(bad) > 0), F.concat_ws(", ", bad))


def speed_factor(text: Column | str) -> Column:
    value = number(F.regexp_extract(col(text), r"^\s*([0-9]+(?:\.[0-9]+)?)x\s*$", 1))
    return F.when(value > 0, value)


def _join_path(folder: Column, name: Column) -> Column:
    return F.when(F.coalesce(folder, F.lit("")) == "", name).otherwise(F.concat_ws("/", folder, name))


def output_path(
    output_root: Column | str, relative_dir: Column | str, stem: Column | str, codec: Column | str,
    container: Column | str,
) -> Column:
    """``root/relative dir/stem_codec.container``."""
    name = F.concat(col(stem), F.lit("_"), col(codec), F.lit("."), col(container))
    return _join_path(col(output_root), _join_path(col(relative_dir), name))


def sidecar_output_name(source_stem: Column | str, subtitle_name: Column | str, output_stem: Column | str) -> Column:
    """``movie.en.srt`` next to ``movie.mkv`` becomes ``<output stem>.en.srt``."""
    stem, name = col(source_stem), col(subtitle_name)
    tail = F.substr(name, F.length(stem) + 1)
    extension = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    own = F.startswith(name, stem) & (tail != "")
    return F.concat(col(output_stem), F.when(own, tail).otherwise(extension))
