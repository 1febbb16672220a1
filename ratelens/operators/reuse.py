"""Reusing and validating stored measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.policy import WINDOW_EPSILON
from ratelens.schemas import RECEIPT_SCHEMA_VERSION, RECEIPT_SCHEME_VERSION


def reuse_measurements(wanted: DataFrame, store: DataFrame, key: str = "fingerprint", forced: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with their stored columns, misses). Rows with ``forced`` set are always misses."""
    open_, again = wanted, None
    if forced is not None:
        again = wanted.filter(F.coalesce(F.col(forced), F.lit(False)))
        open_ = wanted.filter(~F.coalesce(F.col(forced), F.lit(False)))
    hits = open_.join(store, key)
    misses = open_.join(store.select(key), key, "left_anti")
    if again is not None:
        misses = misses.unionByName(again.select(*misses.columns))
    return hits, misses


def early_reject(trials: DataFrame, target: Column, hardest: DataFrame, by: Sequence[str] = ("source_id", "bitrate_bps"), order: str = "window_id") -> DataFrame:
    """Marks each window ``needed`` or not: measured hardest first, nothing after the first failure is needed.

    ``hardest``: ``(*by, hardest_window)``. The first failure is one min per
    candidate, so no running window is involved.
    """
    by = list(by)
    rows = trials.join(hardest.select(*by, "hardest_window"), by, "left")
    place = F.struct((~F.coalesce(F.col("window_id") == F.col("hardest_window"), F.lit(False))).alias("later"), F.col(order).alias("o"))
    rows = rows.withColumn("_place", place)
    first = rows.filter(F.col("gate") < target).groupBy(*by).agg(F.min("_place").alias("_first"))
    return rows.join(first, by, "left").withColumn(
        "needed", F.col("_first").isNull() | (F.col("_place") <= F.col("_first"))
    ).drop("_place", "_first", "hardest_window")


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def _overlap(a: Column, b: Column) -> Column:
    return (a.start_sec < b.start_sec + b.duration_sec - WINDOW_EPSILON) & (b.start_sec < a.start_sec + a.duration_sec - WINDOW_EPSILON)


def _pools_overlap(left: Column, right: Column) -> Column:
    return F.exists(left, lambda a: F.exists(right, lambda b: _overlap(a, b)))


def validate_receipts(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects with ``reason``) of sampled-search receipts; one receipt per row, checked in place.

    Columns: ``schema_version``, ``fingerprint``, ``search_windows``,
    ``holdout_windows``, ``reserve_windows`` (arrays of start_sec, duration_sec)
    and ``candidates`` (array of bitrate_bps, observed_bps, segment_gate,
    min_gate, encoded_bytes, durations_sec, predicted_bytes, predicted_ratio).
    """
    windows = F.concat("search_windows", "holdout_windows", "reserve_windows")
    bad_window = F.exists(windows, lambda w: ~_finite(w.start_sec) | (w.start_sec < 0) | ~_finite(w.duration_sec) | (w.duration_sec <= 0))
    pools_meet = (
        _pools_overlap(F.col("search_windows"), F.col("holdout_windows"))
        | _pools_overlap(F.col("search_windows"), F.col("reserve_windows"))
        | _pools_overlap(F.col("holdout_windows"), F.col("reserve_windows"))
    )

    def any_candidate(test) -> Column:
        return F.coalesce(F.exists("candidates", test), F.lit(False))

    def bad_score(v: Column) -> Column:
        return ~_finite(v) | (v < 0) | (v > 100)

    inconsistent = any_candidate(
        lambda c: (F.size(c.segment_gate) > 0) & (F.abs(c.min_gate - F.array_min(c.segment_gate)) > 1e-9)
    )
    reason = (
        F.when(F.coalesce(F.col("schema_version"), F.lit(0)) != RECEIPT_SCHEMA_VERSION, "unsupported schema version")
        .when(~F.coalesce(F.col("fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False)), "invalid fingerprint")
        .when(bad_window, "invalid sample window")
        .when(any_candidate(lambda c: ~(c.bitrate_bps > 0) | (c.observed_bps < 0)), "invalid bitrate")
        .when(any_candidate(lambda c: bad_score(c.min_gate) | F.exists(c.segment_gate, bad_score)), "score out of range")
        .when(any_candidate(lambda c: F.size(c.encoded_bytes) != F.size(c.durations_sec)), "sample lists differ in length")
        .when(any_candidate(lambda c: F.exists(c.encoded_bytes, lambda b: b < 0)), "invalid encoded size")
        .when(any_candidate(lambda c: F.exists(c.durations_sec, lambda d: ~_finite(d) | (d <= 0))), "invalid encoded duration")
        .when(any_candidate(lambda c: F.coalesce(c.predicted_bytes < 0, F.lit(False)) | F.coalesce(c.predicted_ratio < 0, F.lit(False))), "invalid prediction")
        .when(any_candidate(lambda c: F.size(c.segment_gate) != F.size("search_windows")), "candidate does not cover every window")
        .when(inconsistent, "score summary is inconsistent")
        .when(pools_meet, "sample pools overlap")
    )
    rows = receipts.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def validate_shot_receipts(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for per-shot receipts: ``schema_version, scheme_version, fps, frames, shots``.

    ``shots``: array of start_frame, end_frame, windows (array of start_frame,
    end_frame), holdout (same struct or NULL), candidates (array of bitrate_bps,
    bytes, measured_frames, mean_vmaf, worst_1s_vmaf). Shots must cover 0..frames.
    """
    starts = F.transform("shots", lambda s: s.start_frame)
    ends = F.transform("shots", lambda s: s.end_frame)
    expected = F.concat(F.array(F.lit(0).cast("long")), F.slice(ends, F.lit(1), F.greatest(F.size("shots") - 1, F.lit(0))))
    gapless = (starts == expected) & (F.element_at(ends, -1) == F.col("frames")) & ~F.exists("shots", lambda s: s.end_frame <= s.start_frame)

    def occupied(s: Column) -> Column:
        held = F.when(s.holdout.isNotNull(), F.array(s.holdout)).otherwise(F.slice(s.windows, 1, 0))
        return F.array_sort(F.concat(s.windows, held))

    def bad_windows(s: Column) -> Column:
        w = occupied(s)
        outside = F.exists(w, lambda x: (x.start_frame < s.start_frame) | (x.end_frame > s.end_frame) | (x.end_frame <= x.start_frame))
        meets = F.exists(
            F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.coalesce(a.end_frame > b.start_frame, F.lit(False))), lambda x: x
        )
        return (F.size(s.windows) == 0) | outside | meets

    def bad_candidate(s: Column) -> Column:
        def off(v: Column) -> Column:
            return ~_finite(v) | (v < 0) | (v > 100)

        return F.exists(
            s.candidates,
            lambda c: (c.bitrate_bps <= 0) | (c.bytes < 0) | (c.measured_frames <= 0)
            | (c.measured_frames > s.end_frame - s.start_frame) | off(c.mean_vmaf) | off(c.worst_1s_vmaf),
        )

    version_ok = (F.col("schema_version") == RECEIPT_SCHEMA_VERSION) & (F.col("scheme_version") == RECEIPT_SCHEME_VERSION)
    reason = (
        F.when(~F.coalesce(version_ok, F.lit(False)), "unsupported schema version")
        .when(~F.coalesce(_finite(F.col("fps")) & (F.col("fps") > 0) & (F.col("frames") > 0), F.lit(False)), "invalid timeline")
        .when(~F.coalesce((F.size("shots") > 0) & gapless, F.lit(False)), "shots do not cover the source")
        .when(F.exists("shots", bad_windows), "invalid sample window")
        .when(F.exists("shots", bad_candidate), "invalid candidate")
    )
    rows = receipts.withColumn("reason", reason)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")
