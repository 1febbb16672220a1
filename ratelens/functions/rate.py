"""Bitrate and byte arithmetic. ``bround`` is half-even, as the rules require."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratelens import policy
from ratelens.functions.text import col, number
from ratelens.policy import Profile


def _by_codec(codec: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(codec == name, F.lit(value)).otherwise(out)
    return out


def _rounded(value: Column) -> Column:
    return F.bround(value, 0).cast("long")


def bitrate_bps(text: Column | str) -> Column:
    """Strict form: ``128k``, ``2m`` or plain bits; NULL unless positive."""
    raw = F.lower(F.trim(col(text)))
    scale = F.when(raw.endswith("k"), 1_000).when(raw.endswith("m"), 1_000_000).otherwise(1)
    value = number(F.regexp_replace(raw, "[km]$", ""))
    return F.when(value > 0, _rounded(value * scale))


def bitrate_bps_lenient(text: Column | str) -> Column:
    """Lenient form: also ``g``, truncates, zero allowed; NULL when unreadable."""
    raw = F.lower(F.trim(col(text)))
    pattern = r"^([0-9]+(?:\.[0-9]+)?)([kmg]?)$"
    unit = F.regexp_extract(raw, pattern, 2)
    scale = F.when(unit == "k", 1_000).when(unit == "m", 1_000_000).when(unit == "g", 1_000_000_000).otherwise(1)
    return (number(F.regexp_extract(raw, pattern, 1)) * scale).cast("long")


def target_bitrate(
    source_bps: Column | str, codec: Column | str, min_kbps: Column | str, max_kbps: Column | str,
    ratio: Column | str | None = None,
) -> Column:
    default = _by_codec(col(codec), policy.DEFAULT_TARGET_RATIO)
    share = default if ratio is None else F.coalesce(col(ratio), default)
    low, high = _rounded(col(min_kbps) * 1000), _rounded(col(max_kbps) * 1000)
    wanted = F.greatest(_rounded(col(source_bps) * share), low)
    capped = F.when(col(max_kbps) > 0, F.least(wanted, high)).otherwise(wanted)
    return F.greatest(capped, F.lit(policy.MIN_TARGET_BPS).cast("long"))


def max_output_ratio(codec: Column | str, configured: Column | str) -> Column:
    """Size limit as a share of the source; NULL when the configured one is outside (0, 1]."""
    value = F.coalesce(col(configured), _by_codec(col(codec), policy.DEFAULT_MAX_OUTPUT_RATIO))
    return F.when((value > 0) & (value <= 1), value)


def bitrate_budget(
    source_bytes: Column | str, duration: Column | str, ratio: Column | str, audio_mode: Column | str,
    audio_bps: Column | str, audio_text: Column | str, audio_streams: Column | str, min_kbps: Column | str,
    max_kbps: Column | str,
) -> Column:
    """Struct of byte limit, audio rate and the allowed video bitrate range."""
    limit = F.greatest(F.lit(1).cast("long"), F.floor(col(source_bytes) * col(ratio)).cast("long"))
    total = F.floor(limit * 8 * policy.CONTAINER_FACTOR / col(duration)).cast("long")
    copied = F.greatest(F.lit(0).cast("long"), col(audio_bps).cast("long"))
    streams = F.greatest(F.lit(0).cast("long"), F.coalesce(col(audio_streams), F.lit(0)).cast("long"))
    audio = F.when(col(audio_mode) == "copy", copied).otherwise(bitrate_bps(audio_text) * streams)
    cap = (col(max_kbps) * 1000).cast("long")
    video = total - audio
    return F.struct(
        limit.alias("max_output_bytes"),
        audio.alias("audio_bitrate_bps"),
        F.greatest(F.lit(1).cast("long"), (col(min_kbps) * 1000).cast("long")).alias("min_video_bps"),
        F.when(cap > 0, F.least(video, cap)).otherwise(video).alias("max_video_bps"),
    )


def predicted_bytes(video_bps: Column | str, audio_bps: Column | str, duration: Column | str) -> Column:
    media = (col(video_bps) + col(audio_bps)) * col(duration) / 8.0
    return F.ceil(media / policy.CONTAINER_FACTOR).cast("long")


def floor_candidate(value: Column | str) -> Column:
    step = F.lit(policy.BITRATE_STEP)
    return F.greatest(step.cast("long"), (F.floor(col(value) / step) * step).cast("long"))


def ceil_candidate(value: Column | str) -> Column:
    step = F.lit(policy.BITRATE_STEP)
    return F.greatest(step.cast("long"), (F.ceil(col(value) / step) * step).cast("long"))


def search_tolerance(ceiling: Column | str, profile: Profile = policy.BALANCE) -> Column:
    return F.greatest(
        F.lit(profile.min_tolerance_bps).cast("long"), _rounded(col(ceiling) * profile.tolerance_ratio)
    )


def whole_clip(duration: Column | str, profile: Profile = policy.BALANCE) -> Column:
    return col(duration) <= profile.whole_video_max_sec


def search_window_count(duration: Column | str, profile: Profile = policy.BALANCE) -> Column:
    seconds = col(duration)
    under_10, under_60, upto_180, over = profile.counts_by_length
    by_length = (
        F.when(seconds < 600, under_10).when(seconds < 3600, under_60).when(seconds <= 10800, upto_180).otherwise(over)
    )
    low, high = profile.search_windows
    wanted = F.greatest(F.lit(low), F.least(F.lit(high), by_length))
    capacity = F.greatest(F.lit(1), F.floor(seconds / profile.sample_duration_sec).cast("int"))
    return F.greatest(F.lit(1), F.least(wanted, capacity))


def holdout_window_count(duration: Column | str, profile: Profile = policy.BALANCE) -> Column:
    short, long = profile.holdouts
    return F.when(col(duration) > 10800, long).otherwise(short)


def retry_bitrate(
    selected_bps: Column | str, allowed_bytes: Column | str, actual_bytes: Column | str, max_kbps: Column | str
) -> Column:
    """Corrected bitrate after an output missed its size limit; NULL without a usable size."""
    actual = F.when(col(actual_bytes) > 0, col(actual_bytes))
    share = F.when(col(selected_bps) > 0, col(selected_bps)) * col(allowed_bytes) / actual * policy.CONTAINER_FACTOR
    kbps = F.floor(F.greatest(F.lit(1000).cast("long"), share.cast("long")) / 1000).cast("long")
    cap = col(max_kbps).cast("long")
    bps = F.greatest(F.lit(1).cast("long"), F.when(cap > 0, F.least(cap, kbps)).otherwise(kbps)) * 1000
    return F.when(share.isNotNull(), bps)


def retry_shot_budget(
    budget_bytes: Column | str, allowed_bytes: Column | str, actual_bytes: Column | str, audio_bps: Column | str,
    duration: Column | str,
) -> Column:
    """The same for a per-shot byte budget: audio is taken out of both sizes first."""
    audio = F.ceil(col(audio_bps) * col(duration) / 8).cast("long")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    video = F.greatest(one, col(actual_bytes) - audio)
    room = F.greatest(zero, col(allowed_bytes) - audio)
    corrected = F.greatest(one, (col(budget_bytes) * room / video * policy.CONTAINER_FACTOR).cast("long"))
    bps = F.greatest(F.lit(1000).cast("long"), (corrected * 8 / col(duration)).cast("long"))
    return F.struct(corrected.alias("budget_bytes"), bps.alias("bitrate_bps"))
