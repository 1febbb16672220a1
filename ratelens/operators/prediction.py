"""Full-length size from sampled windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.rate import predicted_bytes
from ratelens.operators.candidates import observed_bps

# Fixed values.
LOW_RATIO, HIGH_RATIO = 0.0001, 4.0
MAX_SLOPE = 0.75
FITTED = "risk_distribution_clipped_theil_sen"
MEDIAN = "robust_median_window_ratio"


def _clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def _median(values: Column) -> Column:
    """Median of an array; the middle two are averaged."""
    ordered = F.array_sort(values)
    n = F.size(values)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return (lower + upper) / 2.0


def _deviation(values: Column) -> Column:
    """Population standard deviation of an array, added up in its order.

    An aggregate's last bits depend on how its rows were dealt out; this one's do not.
    """

    def mean(column: Column) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(values), F.lit(0))

    off = F.transform(F.array(mean(values)), lambda m: mean(F.transform(values, lambda v: (v - m) * (v - m))))
    return F.sqrt(F.get(off, F.lit(0)))


def predict_size(
    trials: DataFrame,
    sources: DataFrame,
    risks: DataFrame | None = None,
    *,
    source: str = "source_id",
    bitrate: str = "bitrate_bps",
    total: str = "total_sec",
) -> DataFrame:
    """Mean and upper bitrate and predicted bytes of each (source, bitrate).

    ``trials``: one row per measured window. ``sources``: length, audio bitrate
    and bytes. ``risks``: the scored scout windows ``(source, window_id, risk)``;
    with them the window ratios are fitted against risk (Theil-Sen) and averaged
    over the timeline, else their median is used. A source has at most 128 scout
    windows and a candidate at most a few dozen measured ones, which bounds the
    arrays; the slopes are built inside the row, so no pair is ever shuffled.
    """
    rows = trials.select(source, bitrate, "window_id", observed_bps().alias("_obs"))
    ratio = _clip(F.col("_obs") / F.col(bitrate), LOW_RATIO, HIGH_RATIO)
    if risks is not None:
        rows = rows.join(risks.select(source, "window_id", F.col("risk").alias("_x")), [source, "window_id"], "left")
    else:
        rows = rows.withColumn("_x", F.lit(None).cast("double"))
    entry = F.struct("window_id", F.coalesce("_x", F.lit(0.5)).alias("x"), ratio.alias("y"))
    rows = rows.groupBy(source, bitrate).agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    if risks is not None:
        line = risks.groupBy(source).agg(F.array_sort(F.collect_list("risk")).alias("_line"))
        rows = rows.join(line.withColumn("_sd", _deviation(F.col("_line"))), source, "left")
    else:
        rows = rows.withColumn("_line", F.lit(None).cast("array<double>")).withColumn("_sd", F.lit(0.0))
    rows = rows.join(
        sources.select(source, F.col(total).alias("_len"), F.col("audio_bitrate_bps").alias("_audio"), F.col("source_bytes").alias("_bytes")), source
    )
    points = F.col("_p")
    fit = F.coalesce(F.size("_line") > 0, F.lit(False))
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    slopes = F.flatten(
        F.transform(
            points,
            lambda a, i: F.transform(
                F.filter(F.slice(points, i + 2, F.size(points)), lambda b: F.abs(b.x - a.x) > 1e-9),
                lambda b: (b.y - a.y) / (b.x - a.x),
            ),
        )
    )
    rows = rows.withColumn("_fit", fit).withColumn("_slopes", F.when(F.col("_fit"), slopes))
    slope = F.when(F.size("_slopes") > 0, _clip(_median(F.col("_slopes")), -MAX_SLOPE, MAX_SLOPE)).otherwise(F.lit(0.0))
    # With a single distinct risk there is nothing to fit and the plain median stands.
    rows = rows.withColumn("_slope", F.when(F.array_min(xs) < F.array_max(xs), slope).otherwise(F.lit(0.0)))
    rows = rows.withColumn(
        "_icept", F.when(F.col("_fit"), _median(F.transform(points, lambda p: p.y - F.col("_slope") * p.x))).otherwise(_median(ys))
    )

    def at(x: Column) -> Column:
        return _clip(F.col("_icept") + F.col("_slope") * x, LOW_RATIO, HIGH_RATIO)

    along = F.aggregate("_line", F.lit(0.0), lambda s, r: s + at(r)) / F.size("_line")
    rows = rows.withColumn("_central", F.when(F.col("_fit"), along).otherwise(F.col("_icept")))
    off = F.transform(points, lambda p: F.abs(p.y - F.when(F.col("_fit"), at(p.x)).otherwise(F.col("_central"))))
    spread = F.when(F.col("_fit"), F.coalesce("_sd", F.lit(0.0))).otherwise(F.lit(0.0))
    rows = rows.withColumn(
        "uncertainty", _clip(0.03 + 0.14 / F.sqrt(F.size(points)) + 1.5 * _median(off) + 0.20 * spread, 0.05, 0.30)
    )
    one = F.lit(1).cast("long")
    rows = rows.withColumn("mean_video_bps", F.greatest(one, F.bround(F.col(bitrate) * F.col("_central"), 0).cast("long")))
    rows = rows.withColumn(
        "upper_video_bps",
        F.greatest(F.col("mean_video_bps"), F.bround(F.col("mean_video_bps") * (1.0 + F.col("uncertainty")), 0).cast("long")),
    )
    size = predicted_bytes("upper_video_bps", F.greatest(F.lit(0), F.col("_audio")), "_len")
    rows = rows.withColumn("predicted_bytes", size)
    return rows.select(
        source, bitrate, F.size("_p").alias("windows"), "mean_video_bps", "upper_video_bps", "predicted_bytes",
        (F.col("predicted_bytes") / F.when(F.col("_bytes") > 0, F.col("_bytes"))).alias("predicted_ratio"), "uncertainty",
        F.when(F.col("_fit"), FITTED).otherwise(MEDIAN).alias("method"),
    )


def refresh_predictions(
    candidates: DataFrame,
    sources: DataFrame,
    trials: DataFrame | None = None,
    *,
    source: str = "source_id",
    bitrate: str = "bitrate_bps",
    total: str = "total_sec",
) -> DataFrame:
    """Re-price stored candidates under new audio and size settings, without measuring again.

    Candidates with a stored upper bitrate are re-priced from it; the others are
    predicted from their windows in ``trials``.
    """
    info = sources.select(source, F.col(total).alias("_len"), F.col("audio_bitrate_bps").alias("_audio"), F.col("source_bytes").alias("_src"))
    rows = candidates
    if trials is not None:
        missing = candidates.filter(F.col("upper_video_bps").isNull()).select(source, bitrate)
        fresh = predict_size(trials.join(missing, [source, bitrate], "left_semi"), sources, source=source, bitrate=bitrate, total=total)
        fresh = fresh.select(source, bitrate, F.col("mean_video_bps").alias("_mean"), F.col("upper_video_bps").alias("_upper"))
        rows = rows.join(fresh, [source, bitrate], "left")
        rows = rows.withColumn("mean_video_bps", F.coalesce("mean_video_bps", "_mean")).withColumn(
            "upper_video_bps", F.coalesce("upper_video_bps", "_upper")
        ).drop("_mean", "_upper")
    rows = rows.join(info, source)
    size = predicted_bytes("upper_video_bps", "_audio", "_len")
    kept = [c for c in rows.columns if c not in ("_len", "_audio", "_src", "predicted_bytes", "predicted_ratio")]
    old = F.col("predicted_bytes") if "predicted_bytes" in rows.columns else F.lit(None).cast("long")
    rows = rows.withColumn("_new", F.coalesce(size, old))
    return rows.select(
        *kept, F.col("_new").alias("predicted_bytes"), (F.col("_new") / F.when(F.col("_src") > 0, F.col("_src"))).alias("predicted_ratio")
    )
