"""From window trials to candidates; packets and chapters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def observed_bps():
    """Bitrate a trial really produced."""
    return F.ceil(F.col("encoded_bytes") * 8.0 / F.col("duration_sec")).cast("long")


def candidate_summary(
    trials: DataFrame, by: Sequence[str] = ("source_id", "bitrate_bps"), *, source: str = "source_id",
    arrays: bool = False,
) -> DataFrame:
    """One row per candidate: gate = worst window, window count, and whether all windows are covered.

    With ``arrays`` the per-window values come along in window order; a plan has
    at most a few dozen windows, which bounds them.
    """
    by = list(by)
    out = [
        F.min("gate").alias("gate"),
        F.count_distinct("window_id").alias("windows"),
        F.sum("encoded_bytes").alias("encoded_bytes"),
        F.sum("duration_sec").alias("measured_sec"),
        F.max(observed_bps()).alias("max_observed_bps"),
    ]
    if arrays:
        entry = F.struct("window_id", "gate", "encoded_bytes", "duration_sec", observed_bps().alias("observed_bps"))
        out.append(F.array_sort(F.collect_list(entry)).alias("per_window"))
    planned = trials.groupBy(source).agg(F.count_distinct("window_id").alias("_planned"))
    return (
        trials.groupBy(*by)
        .agg(*out)
        .join(planned, source)
        .withColumn("complete", F.col("windows") == F.col("_planned"))
        .drop("_planned")
    )


def hardest_window(trials: DataFrame, by: Sequence[str] = ("source_id", "bitrate_bps"), order: str = "window_id") -> DataFrame:
    """Window with the lowest gate; the first one on ties."""
    return trials.groupBy(*by).agg(
        F.min_by("window_id", F.struct("gate", order)).alias("hardest_window"), F.min("gate").alias("gate")
    )


def stream_bytes(packets: DataFrame, streams: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total packet size of the first video stream of each file."""
    by = list(by)
    first = (
        streams.filter(F.col("codec_type") == "video").groupBy(*by).agg(F.min("stream_index").alias("stream_index"))
    )
    totals = packets.groupBy(*by, "stream_index").agg(F.sum("size").cast("long").alias("video_bytes"))
    return first.join(totals, [*by, "stream_index"], "left").select(
        *by, "stream_index", F.coalesce("video_bytes", F.lit(0).cast("long")).alias("video_bytes")
    )


def _stream_ends(packets: DataFrame, by: list[str]) -> DataFrame:
    timed = packets.filter(F.col("pts_sec").isNotNull())
    entry = F.struct("pts_sec", F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"))
    return timed.groupBy(*by, "kind", "ordinal").agg(
        F.min_by(entry, "packet_no").alias("first"), F.max_by(entry, "packet_no").alias("last")
    )


def reconcile_streams(
    source_streams: DataFrame, output_streams: DataFrame, source_packets: DataFrame, output_packets: DataFrame,
    by: Sequence[str], *, start: str = "start_sec", kinds: Sequence[str] = ("audio", "subtitle"),
) -> DataFrame:
    """Per file and stream kind: do counts agree, and do audio streams cover the same time span?

    Streams: ``(*by, kind, ordinal[, start_sec])`` where ``start_sec`` (on the
    source side) is the origin of the source's time axis. Packets:
    ``(*by, kind, ordinal, packet_no, pts_sec, duration_sec)``.
    """
    by = list(by)
    left = source_streams.filter(F.col("kind").isin(*kinds)).select(*by, "kind", "ordinal", F.col(start).alias("_start"), F.lit(True).alias("_s"))
    right = output_streams.filter(F.col("kind").isin(*kinds)).select(*by, "kind", "ordinal", F.lit(True).alias("_o"))
    keys = [*by, "kind", "ordinal"]
    both = left.join(right, keys, "full_outer")
    a = _stream_ends(source_packets, by).select(*keys, F.col("first").alias("_sf"), F.col("last").alias("_sl"))
    b = _stream_ends(output_packets, by).select(*keys, F.col("first").alias("_of"), F.col("last").alias("_ol"))
    both = both.join(a, keys, "left").join(b, keys, "left")
    tolerance = F.greatest("_sl.duration_sec", "_ol.duration_sec", "_of.duration_sec") + 0.002
    first_off = F.abs(F.col("_of.pts_sec") - (F.col("_sf.pts_sec") - F.col("_start")))
    source_end = F.col("_sl.pts_sec") + F.col("_sl.duration_sec") - F.col("_start")
    last_off = F.abs(F.col("_ol.pts_sec") + F.col("_ol.duration_sec") - source_end)
    moved = F.when(F.col("_sf").isNull(), False).when(F.col("_of").isNull(), True).otherwise(
        (first_off > tolerance) | (last_off > tolerance)
    )
    paired = F.col("_s").isNotNull() & F.col("_o").isNotNull()
    return both.groupBy(*by, "kind").agg(
        F.count("_s").alias("source_streams"),
        F.count("_o").alias("output_streams"),
        F.count_if(paired & (F.col("kind") == "audio") & moved).alias("moved_streams"),
    ).withColumn("ok", (F.col("source_streams") == F.col("output_streams")) & (F.col("moved_streams") == 0))


def reconcile_chapters(source: DataFrame, output: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per file: chapters agree in number, coordinates (2 ms) and title.

    ``source`` carries ``start_sec`` (time origin); both have ``ordinal``,
    ``chapter_start``, ``chapter_end`` and ``title``.
    """
    keys = [*by, "ordinal"]
    a = source.select(
        *keys, (F.col("chapter_start") - F.col("start_sec")).alias("_as"), (F.col("chapter_end") - F.col("start_sec")).alias("_ae"),
        F.col("title").alias("_at"), F.lit(True).alias("_s"),
    )
    b = output.select(
        *keys, F.col("chapter_start").alias("_bs"), F.col("chapter_end").alias("_be"), F.col("title").alias("_bt"),
        F.lit(True).alias("_o"),
    )
    both = a.join(b, keys, "full_outer")
    same = (
        F.col("_s").isNotNull()
        & F.col("_o").isNotNull()
        & (F.abs(F.col("_as") - F.col("_bs")) <= 0.002)
        & (F.abs(F.col("_ae") - F.col("_be")) <= 0.002)
        & F.col("_at").eqNullSafe(F.col("_bt"))
    )
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chapters"), F.count_if(~F.coalesce(same, F.lit(False))).alias("different")
    ).withColumn("ok", F.col("different") == 0)


def shot_candidate_summary(trials: DataFrame, shots: DataFrame) -> DataFrame:
    """Frame-weighted mean, worst second and predicted bytes of each (title, shot, bitrate).

    ``trials``: one row per sampled window with ``frames``, ``mean``,
    ``worst_1s``, ``bytes``. A shot measured whole needs no size margin.
    """
    keys = ["title_id", "shot_idx"]
    measured = trials.groupBy(*keys, "bitrate_bps").agg(
        (F.sum(F.col("mean") * F.col("frames")) / F.sum("frames")).alias("mean_vmaf"),
        F.min("worst_1s").alias("worst_1s_vmaf"),
        F.sum("bytes").alias("_bytes"),
        F.sum("frames").cast("long").alias("measured_frames"),
    )
    length = F.col("end_frame") - F.col("start_frame")
    rows = measured.join(shots.select(*keys, length.alias("shot_frames")), keys)
    whole = F.col("measured_frames") == F.col("shot_frames")
    margin = F.when(whole, F.lit(1.0)).otherwise(F.lit(1.10))
    return rows.select(
        *keys, "bitrate_bps", "mean_vmaf", "worst_1s_vmaf",
        F.ceil(F.col("_bytes") / F.col("measured_frames") * F.col("shot_frames") * margin).cast("long").alias("bytes"),
        "measured_frames", whole.alias("holdout_verified"),
    )
