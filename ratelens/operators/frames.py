"""Frame-level pooling. One clip may hold a large share of all frames, so every
ordered step runs on (clip, chunk) and only aggregates meet per clip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens import policy
from ratelens.plans.ordered import CHUNK, FRAMES_PER_CHUNK, frame_chunk, frame_chunks, ordered
from ratelens.session import cut


#: Ranks that the sketch of a group may be off by: one in so many of its rows.
SKETCH_ACCURACY = 10_000


def _bracket(value: Column, share: float) -> Column:
    """Two values between which the element at that share of the ranks lies, from one mergeable sketch.

    They are asked for four errors of the sketch to either side.
    """
    off = 4 / SKETCH_ACCURACY
    return F.percentile_approx(value, [max(0.0, share - off), min(1.0, share + off)], SKETCH_ACCURACY)


def _wanted(name: str, count: Column, bracket: Column, share: float) -> Column:
    return F.struct(
        F.lit(name).alias("name"), bracket[0].alias("low"), bracket[1].alias("high"),
        F.greatest(F.lit(1), F.ceil(count * F.lit(share))).cast("long").alias("k"),
    )


def _counted_values(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, name, k, v, c): how often each value occurs; ``rows`` have by, name, k, low, high and v.

    Values below the bracket are one row with a null value, those above it none, so
    a group comes down to the few distinct values of the bracket before the shuffle.
    """
    value = F.when(F.col("v") >= F.col("low"), F.col("v"))
    return rows.filter(F.col("v") <= F.col("high")).groupBy(*by, "name", "k", value.alias("v")).agg(F.count(F.lit(1)).alias("c"))


def _at_rank(counts: DataFrame, by: list[str], names: Sequence[str]) -> DataFrame:
    """One column per name: the value at which the counts reach rank ``k``."""
    upto = Window.partitionBy(*by, "name").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    exact = counts.withColumn("_upto", F.sum("c").over(upto)).filter(
        F.col("v").isNotNull() & (F.col("k") <= F.col("_upto")) & (F.col("k") > F.col("_upto") - F.col("c"))
    )
    return exact.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names])


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Element at rank ceil(n*share) of ``value`` per group, one column per entry of ``shares``.

    Exact, in two passes. A quantile sketch per group, which merges map-side, gives
    a narrow range that holds the rank, whatever the values look like. The second
    pass counts what lies below it and how often each value in it occurs: a group
    of any size comes down to about a thousandth of its rows. NULL values are not
    counted.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    sketches = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[_bracket(F.col("v"), p).alias(f"_b{i}") for i, p in enumerate(shares.values())]
    )
    wanted = [_wanted(name, F.col("_n"), F.col(f"_b{i}"), p) for i, (name, p) in enumerate(shares.items())]
    ranges = sketches.select(*by, F.array(*wanted).alias("_w"))
    asked = rows.join(ranges, by).select(*by, "v", F.inline("_w"))
    return _at_rank(_counted_values(asked, by), by, list(shares))


def rolling_means(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    value: str,
    size: Column,
    *,
    frames_per_chunk: int = FRAMES_PER_CHUNK,
) -> DataFrame:
    """Mean of every full window of ``size`` consecutive rows, keyed by its last position.

    ``pos`` is a dense 0-based position and ``size`` may differ per group, which
    a window frame cannot express. Each row enters the running sum at its
    position and leaves it ``size`` later. Groups are cut into chunks: a row is
    also sent to the following chunk when a window there still reaches back to
    it, so chunks are independent.
    """
    by = list(by)
    rows = df.select(*by, F.col(pos).cast("long").alias("_p"), F.col(value).alias("_v"), size.cast("long").alias("_s"))
    keys = [*by, CHUNK]
    own = frame_chunk(F.col("_p"), frames_per_chunk)
    last = frame_chunk(F.col("_p") + F.col("_s") - 1, frames_per_chunk)
    rows = rows.select("*", F.explode(F.sequence(own, last)).alias(CHUNK)).withColumn("_own", F.col(CHUNK) == own)
    events = rows.select(
        *keys,
        "_s",
        F.inline(
            F.array(
                F.struct(F.col("_p").alias("_at"), F.lit(1).alias("_in"), F.col("_v").alias("_d"), F.col("_own").alias("_real")),
                F.struct(
                    (F.col("_p") + F.col("_s")).alias("_at"), F.lit(0).alias("_in"), (-F.col("_v")).alias("_d"),
                    F.lit(False).alias("_real"),
                ),
            )
        ),
    )
    run = Window.partitionBy(*keys).orderBy("_at", "_in").rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.withColumn("_sum", F.sum("_d").over(run))
        .filter(F.col("_real") & (F.col("_at") >= F.col("_s") - 1))
        .select(*by, F.col("_at").alias("last_pos"), F.col("_s").alias("size"), (F.col("_sum") / F.col("_s")).alias("mean"))
    )


def worst_consecutive(
    df: DataFrame, by: Sequence[str], pos: str, value: str, size: Column, *, frames_per_chunk: int = FRAMES_PER_CHUNK
) -> DataFrame:
    """Lowest mean over full windows; a group shorter than its window counts as one window."""
    by = list(by)
    rolled = rolling_means(df, by, pos, value, size, frames_per_chunk=frames_per_chunk)
    lowest = rolled.groupBy(*by).agg(F.min("mean").alias("_low"))
    whole = df.groupBy(*by).agg(F.avg(value).alias("_all"))
    return whole.join(lowest, by, "left").select(*by, F.coalesce("_low", "_all").alias("worst"))


def _cadence(steps: DataFrame, by: list[str]) -> DataFrame:
    """Upper median of ``_g`` from its histogram ``(by, _g, _c, _s)``, with row count and score sum.

    The histogram is small: k different steps need a span of k*k/2 frames.
    """
    counted = F.when(F.col("_g").isNotNull(), F.col("_c")).otherwise(0)
    upto = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_g")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    ranked = steps.withColumn("_upto", F.sum(counted).over(upto)).withColumn(
        "_rank", F.floor(F.sum(counted).over(whole) / 2) + 1
    )
    hit = F.min(F.when((F.col("_upto") >= F.col("_rank")) & F.col("_g").isNotNull(), F.col("_g")))
    return ranked.groupBy(*by).agg(
        F.coalesce(hit, F.lit(1)).cast("long").alias("cadence"), F.sum("_c").alias("frames"), F.sum("_s").alias("_sum")
    )


def upper_median_step(df: DataFrame, by: Sequence[str], order: str, *, frames_per_chunk: int = FRAMES_PER_CHUNK) -> DataFrame:
    """Upper median of the gaps between consecutive ``order`` values; 1 for a single row."""
    by = list(by)
    rows = frame_chunks(df.select(*by, order), order, frames_per_chunk=frames_per_chunk)
    gaps = ordered(rows, by, [order], before={"_before": order})
    steps = gaps.groupBy(*by, (F.col(order) - F.col("_before")).alias("_g")).agg(
        F.count(F.lit(1)).alias("_c"), F.lit(0.0).alias("_s")
    )
    return _cadence(steps, by).select(*by, "cadence")


def pool_scores(
    frame_scores: DataFrame,
    by: Sequence[str],
    *,
    frame: str = "frame_no",
    score: str = "score",
    fps: str = "fps",
    default_fps: float = 30.0,
    frames_per_chunk: int = FRAMES_PER_CHUNK,
) -> DataFrame:
    """Mean, p10, worst second and gate = min(mean, worst second + 4) of each clip.

    The window is one second of *measured* frames: ceil(fps / cadence) rows.
    """
    by = list(by)
    rate = F.when(F.col(fps) > 0, F.col(fps).cast("double")).otherwise(F.lit(default_fps))
    rows = frame_scores.select(*by, frame, score, rate.alias("_rate"))
    rows = frame_chunks(rows, frame, frames_per_chunk=frames_per_chunk)
    rows = ordered(
        rows, by, [frame], running={"_pos": ("sum", F.lit(1).cast("long"))}, before={"_before": frame}
    )
    # One aggregate of the steps yields row count, mean and cadence together.
    steps = rows.groupBy(*by, (F.col(frame) - F.col("_before")).alias("_g")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(score).alias("_s")
    )
    clips = _cadence(steps, by)
    size = F.greatest(F.lit(1), F.ceil(F.col("_rate") / F.greatest(F.lit(1), F.col("cadence"))))
    rolled = rolling_means(
        rows.join(clips.select(*by, "cadence"), by), by, "_pos", score, size, frames_per_chunk=frames_per_chunk
    )
    worst = rolled.groupBy(*by).agg(F.min("mean").alias("_low"))
    p10 = nearest_rank(frame_scores, by, score, {"p10": 0.10})
    out = clips.withColumn("mean", F.col("_sum") / F.col("frames")).join(p10, by).join(worst, by, "left")
    out = out.withColumn("worst_1s", F.coalesce("_low", "mean"))
    gate = F.least("mean", F.col("worst_1s") + policy.TEMPORAL_DROP_TOLERANCE)
    return out.select(*by, "frames", "mean", "p10", "worst_1s", gate.alias("gate"))


def scout_metrics(frame_metrics: DataFrame, by: Sequence[str], *, frame: str = "frame_idx") -> tuple[DataFrame, DataFrame]:
    """(metrics, rejects) per scout clip: p90 of SI and TI, cut count, top scene score, mean luma.

    ``frame`` is the 0-based index within the clip. TI of the first frame and of
    cut frames is left out. A clip with a missing value, or with a cut that has
    no time, is rejected whole. The cut times themselves stay rows: see
    :func:`cut_times`.
    """
    by = list(by)
    incomplete = (
        F.col("si").isNull()
        | F.col("ti").isNull()
        | F.col("scd_score").isNull()
        | ((F.col("scd_score") >= policy.SCENE_CHANGE_THRESHOLD) & F.col("scd_time").isNull())
    )
    # A frame carries a scene time exactly when it is a cut frame.
    still = F.when(F.col("scd_time").isNull() & (F.col(frame) > 0), F.col("ti"))
    clips = frame_metrics.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(incomplete).alias("_bad"),
        F.max("scd_score").alias("max_scene_score"),
        F.avg(F.coalesce("luma", F.lit(policy.NEUTRAL_LUMA))).alias("luma_mean"),
        F.count("si").alias("_si"), _bracket(F.col("si"), 0.90).alias("_bsi"),
        F.count(still).alias("_ti"), _bracket(still, 0.90).alias("_bti"),
    )
    clips = cut(clips)  # one row per clip, used four times
    good = clips.filter("_bad = 0 AND _ti > 0")
    # The second and last pass over the frames: values in both ranges, and cut times, counted together.
    none = F.lit(None)
    wanted = F.array(
        F.struct(_wanted("si_p90", F.col("_si"), F.col("_bsi"), 0.90).alias("w"), F.col("si").cast("double").alias("v")),
        F.struct(_wanted("ti_p90", F.col("_ti"), F.col("_bti"), 0.90).alias("w"), still.cast("double").alias("v")),
        F.struct(
            F.struct(
                F.lit("cut").alias("name"), F.col("scd_time").cast("double").alias("low"), F.col("scd_time").cast("double").alias("high"), none.cast("long").alias("k")
            ).alias("w"),
            F.col("scd_time").cast("double").alias("v"),
        ),
    )
    asked = frame_metrics.join(good.select(*by, "_si", "_bsi", "_ti", "_bti"), by).select(*by, F.inline(wanted)).select(*by, "w.*", "v")
    counts = cut(_counted_values(asked, by))
    ranks = _at_rank(counts.filter("name <> 'cut'"), by, ["si_p90", "ti_p90"])
    cuts = counts.filter("name = 'cut'").groupBy(*by).agg(F.count(F.lit(1)).alias("cut_count"))
    metrics = (
        good.join(ranks, by)
        .join(cuts, by, "left")
        .select(
            *by, "frames", "si_p90", "ti_p90", F.coalesce("cut_count", F.lit(0)).cast("long").alias("cut_count"),
            "max_scene_score", "luma_mean",
        )
    )
    enough = clips.filter("_bad = 0 AND _ti = 0").select(*by, F.lit("not enough valid frame metrics").alias("reason"))
    broken = clips.filter(F.col("_bad") > 0).select(*by, F.lit("missing frame metric").alias("reason"))
    return metrics, broken.unionByName(enough)


def cut_times(frame_metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Distinct scene-cut times, one row each."""
    return (
        frame_metrics.filter(F.col("scd_time").isNotNull())
        .groupBy(*by, F.col("scd_time").alias("cut_sec"))
        .agg(F.max("scd_score").alias("score"))
    )


def risk_inputs(metrics: DataFrame) -> DataFrame:
    """Dark, flat and noise shares in [0, 1] from scout metrics."""
    detail = F.least(F.lit(1.0), F.col("si_p90") / 100.0)
    motion = F.least(F.lit(1.0), F.col("ti_p90") / 50.0)
    dark = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (64.0 - F.col("luma_mean")) / 64.0))
    return metrics.select(
        "*",
        dark.alias("dark"),
        F.greatest(F.lit(0.0), 1.0 - detail).alias("flat_or_gradient"),
        (detail * F.greatest(F.lit(0.0), 1.0 - motion)).alias("high_frequency_or_noise"),
    )


def merge_overlapping_segments(
    df: DataFrame, by: Sequence[str], segment_start: str, frame: str, score: str, expected: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(merged frames, coverage). Of frames scored twice the earliest segment's score stays.

    ``expected`` has the group keys and ``expected_frames``.
    """
    by = list(by)
    at = F.col(segment_start) + F.col(frame)
    merged = df.groupBy(*by, at.cast("long").alias("frame_no")).agg(F.min_by(score, segment_start).alias("score"))
    state = merged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"), F.min("frame_no").alias("_lo"), F.max("frame_no").alias("_hi")
    )
    complete = (F.col("_lo") == 0) & (F.col("_hi") == F.col("frames") - 1)
    if expected is not None:
        state = state.join(expected, by, "left")
        complete = complete & F.coalesce(F.col("frames") == F.col("expected_frames"), F.lit(False))
    return merged, state.select(*by, "frames", complete.alias("complete"))


def check_contiguous(
    df: DataFrame, by: Sequence[str], idx: str, *, expected: DataFrame | None = None, bad: str | None = None
) -> DataFrame:
    """Whether the index values of each group, whole numbers, are exactly 0..n-1 (and n as expected).

    Values are marked as bits, 64 to a row, so that a map of them stays small.
    """
    by = list(by)
    bad_rows = F.count_if(F.col(bad)) if bad else F.lit(0).cast("long")
    at = F.col(idx).cast("long")
    bit = F.expr(f"shiftleft(1L, CAST(CAST(`{idx}` AS BIGINT) & 63 AS INT))")
    once = df.groupBy(*by, F.shiftright(at, 6).alias("_block")).agg(
        F.count(F.lit(1)).alias("_c"), bad_rows.alias("_bad"), F.bit_or(bit).alias("_bits"), F.min(at).alias("_lo"), F.max(at).alias("_hi")
    )
    state = once.groupBy(*by).agg(
        F.sum("_c").alias("frames"),
        F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0)).alias("_distinct"),
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.sum("_bad").alias("bad_rows"),
    )
    ok = (F.col("_distinct") == F.col("frames")) & (F.col("_lo") == 0) & (F.col("_hi") == F.col("frames") - 1)
    if expected is not None:
        state = state.join(expected, by, "left")
        ok = ok & F.coalesce(F.col("frames") == F.col("expected_frames"), F.lit(False))
    return state.select(*by, "frames", F.coalesce(ok, F.lit(False)).alias("contiguous"), "bad_rows")


def check_cadence(
    timestamps: DataFrame,
    by: Sequence[str],
    *,
    order: str = "frame_no",
    time: str = "t_sec",
    fps: str = "fps",
    average_fps: str | None = None,
    frames_per_chunk: int = FRAMES_PER_CHUNK,
) -> DataFrame:
    """Constant-frame-rate verdicts per clip.

    ``on_grid``: every time lies on t0 + i/fps within the container's rounding
    and times strictly increase. ``even_steps``: the spread of the steps stays
    within 2 % of their mean (or 2 ms) and nominal and average rate agree.
    """
    by = list(by)
    extra = [F.col(average_fps).alias("_avg")] if average_fps else [F.lit(None).cast("double").alias("_avg")]
    rows = timestamps.select(*by, order, F.col(time).alias("_t"), F.col(fps).cast("double").alias("_f"), *extra)
    rows = frame_chunks(rows, order, frames_per_chunk=frames_per_chunk)
    rows = ordered(rows, by, [order], running={"_i": ("sum", F.lit(1).cast("long"))}, before={"_before": "_t"})
    drift = F.col("_t") - F.col("_i") / F.col("_f")
    step = F.col("_t") - F.col("_before")
    finite = F.col("_t").isNotNull() & ~F.isnan("_t") & (F.abs("_t") < float("inf"))
    clips = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.min_by("_t", order).alias("_t0"),
        F.max(drift).alias("_hi"),
        F.min(drift).alias("_lo"),
        F.min(step).alias("min_step"),
        F.max(step).alias("max_step"),
        F.max("_f").alias("_f"),
        F.max("_avg").alias("_avg"),
        F.bool_and(finite).alias("_finite"),
        F.max("_t").alias("_tmax"),
        F.min("_t").alias("_tmin"),
    )
    tolerance = F.greatest(F.lit(0.0011), 0.01 / F.col("_f"))
    increasing = F.coalesce(F.col("min_step") > 0, F.lit(True))
    off_grid = F.greatest(F.col("_hi") - F.col("_t0"), F.col("_t0") - F.col("_lo"))
    # The steps of a clip add up to last - first, so their mean needs no extra pass.
    mean_step = (F.col("_tmax") - F.col("_tmin")) / (F.col("frames") - 1)
    spread = (F.col("max_step") - F.col("min_step")) <= F.greatest(F.lit(0.002), mean_step * 0.02)
    gap = F.abs(F.col("_f") - F.col("_avg"))
    rates_agree = F.coalesce(~((gap > 0.05) & (gap / F.greatest("_f", "_avg") > 0.01)), F.lit(True))
    usable = F.col("_finite") & (F.col("_f") > 0)
    on_grid = usable & increasing & (off_grid <= tolerance)
    even = usable & (F.col("frames") >= 2) & F.when(F.col("frames") >= 3, increasing & spread).otherwise(True) & rates_agree
    return clips.select(
        *by,
        "frames",
        F.coalesce(on_grid, F.lit(False)).alias("on_grid"),
        F.coalesce(even, F.lit(False)).alias("even_steps"),
        F.when(~F.coalesce(usable, F.lit(False)), "missing or invalid timestamps")
        .when(~increasing, "timestamps do not increase")
        .when(~F.coalesce(on_grid, F.lit(False)), "variable frame rate")
        .when(~rates_agree, "nominal and average rate differ")
        .alias("reason"),
    )
