"""Holdouts, reserves and the final gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens import policy
from ratelens.functions.rate import predicted_bytes
from ratelens.operators.frames import rolling_means
from ratelens.operators.intervals import largest_gap
from ratelens.plans.ordered import FRAMES_PER_CHUNK, frame_chunks, ordered, value_chunk
from ratelens.session import cut, spill


def verify_holdouts(selection: DataFrame, holdout_trials: DataFrame, *, source: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(per holdout, per source): does each held-out window pass at the selected bitrate?

    ``selection``: ``selected_bps, target``.
    """
    rows = selection.select(source, F.col("selected_bps").alias("bitrate_bps"), "target").join(
        holdout_trials.select(source, "bitrate_bps", "window_id", "gate"), [source, "bitrate_bps"]
    )
    rows = rows.withColumn("passed", F.col("gate") >= F.col("target"))
    verdict = rows.groupBy(source).agg(
        F.bool_and("passed").alias("verified"), F.min("gate").alias("holdout_min_gate"), F.count_if(~F.col("passed")).alias("failed_holdouts")
    )
    return rows.select(source, "bitrate_bps", "window_id", "gate", "passed"), verdict


def fold_shot_holdouts(selected: DataFrame, holdouts: DataFrame, *, keys: Sequence[str] = ("title_id", "shot_idx", "cand_id")) -> DataFrame:
    """Take the held-out window of each selected shot candidate into its figures.

    ``selected``: ``mean_vmaf, worst_1s_vmaf, bytes, measured_frames,
    shot_frames, holdout_verified``. ``holdouts``: ``mean, worst_1s, frames, bytes``.
    """
    h = holdouts.select(
        *keys, F.col("mean").alias("_mean"), F.col("worst_1s").alias("_worst"), F.col("frames").alias("_n"), F.col("bytes").alias("_bytes")
    )
    rows = selected.join(h, list(keys), "left")
    use = F.col("_n").isNotNull() & ~F.col("holdout_verified")
    mean = (F.col("mean_vmaf") * F.col("measured_frames") + F.col("_mean") * F.col("_n")) / (F.col("measured_frames") + F.col("_n"))
    size = F.ceil(F.col("_bytes") / F.col("_n") * F.col("shot_frames") * 1.10).cast("long")
    return rows.select(
        *keys,
        F.when(use, mean).otherwise(F.col("mean_vmaf")).alias("mean_vmaf"),
        F.when(use, F.least("worst_1s_vmaf", "_worst")).otherwise(F.col("worst_1s_vmaf")).alias("worst_1s_vmaf"),
        F.when(use, F.greatest("bytes", size)).otherwise(F.col("bytes")).alias("bytes"),
        F.when(use, F.col("measured_frames") + F.col("_n")).otherwise(F.col("measured_frames")).cast("long").alias("measured_frames"),
        (F.col("holdout_verified") | use).alias("holdout_verified"),
        use.alias("changed"),
    )


def promote_failed(
    windows: DataFrame,
    failed: DataFrame,
    scouts: DataFrame,
    totals: DataFrame,
    *,
    sample_sec: float = policy.BALANCE.sample_duration_sec,
    refinement_round: int = 1,
    refinement_limit: int | None = None,
    source: str = "source_id",
    total: str = "total_sec",
    rows_per_chunk: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(windows, status) after failed holdouts joined the search pool.

    ``windows``: ``pool, window_id, start_sec, duration_sec, reasons, scout_id``.
    ``failed``: ``(source, window_id)``. A failed blind holdout is replaced from
    the widest unobserved gap; a source left without holdouts takes its first
    reserve. Sources that run out get status ``failed`` with a reason, as do all
    in a round beyond ``refinement_limit``, whose windows stay as they are. Only
    sources with a failed holdout are returned.
    """
    touched = failed.select(source).distinct()
    if refinement_limit is not None and refinement_round > refinement_limit:
        over = F.lit("holdouts still fail after the last refinement round")
        return windows.join(touched, source, "left_semi"), touched.select(
            source, F.lit("failed").alias("status"), over.alias("reason")
        )
    rows = windows.join(touched, source, "left_semi").join(failed.select(source, "window_id", F.lit(True).alias("_f")), [source, "window_id"], "left")
    lost = (F.col("pool") == "holdout") & F.col("_f").isNotNull()
    rows = cut(rows.withColumn("_lost", lost).drop("_f"))  # read by every step below

    def tagged(reason: str) -> Column:
        return F.array_distinct(F.concat("reasons", F.array(F.lit(reason))))

    kept = rows.filter(~F.col("_lost")).drop("_lost")
    promoted = rows.filter("_lost").select(
        source, F.concat(F.lit("search:promoted:"), "window_id").alias("window_id"), F.lit("search").alias("pool"), "start_sec",
        "duration_sec", tagged("failed_holdout_promoted").alias("reasons"), "scout_id",
    )
    blind_lost = rows.filter(F.col("_lost") & F.array_contains("reasons", "unscouted_validation")).select(source).distinct()
    occupied = rows.select(source, "start_sec", "duration_sec").unionByName(scouts.select(source, "start_sec", "duration_sec"))
    gaps = largest_gap(
        occupied.join(blind_lost, source, "left_semi"), [source], totals.join(blind_lost, source, "left_semi"), min_length=sample_sec,
        total=total, rows_per_chunk=rows_per_chunk,
    )
    gaps = cut(gaps)
    fresh = gaps.filter(F.col("gap_sec").isNotNull()).select(
        source, F.lit(f"holdout:unscouted:{refinement_round}").alias("window_id"), F.lit("holdout").alias("pool"), "start_sec", "duration_sec",
        F.array(F.lit("unscouted_validation"), F.lit("fresh_gap_holdout")).alias("reasons"), F.lit(None).cast("string").alias("scout_id"),
    )
    no_gap = gaps.filter(F.col("gap_sec").isNull()).select(source)
    held = kept.filter("pool = 'holdout'").select(source).unionByName(fresh.select(source)).distinct()
    empty = touched.join(held, source, "left_anti").join(no_gap, source, "left_anti")
    first = kept.filter("pool = 'reserve'").join(empty, source, "left_semi").groupBy(source).agg(
        F.min_by(F.struct("window_id", "start_sec", "duration_sec", "reasons", "scout_id"), F.struct("start_sec", "window_id")).alias("_r")
    ).select(source, "_r.*")
    searched = kept.filter("pool = 'search'").select(source, "scout_id").unionByName(promoted.select(source, "scout_id"))
    usable = first.join(searched.filter("scout_id IS NOT NULL"), [source, "scout_id"], "left_anti")
    replaced = usable.select(
        source, F.concat(F.lit("holdout:fresh:"), "window_id").alias("window_id"), F.lit("holdout").alias("pool"), "start_sec", "duration_sec",
        tagged("fresh_reserve_holdout").alias("reasons"), "scout_id",
    )
    left_reserves = kept.join(first.select(source, "window_id"), [source, "window_id"], "left_anti")
    out = left_reserves.unionByName(promoted).unionByName(fresh).unionByName(replaced)
    spent = empty.join(replaced.select(source), source, "left_anti").withColumn("reason", F.lit("reserve windows exhausted"))
    gone = no_gap.withColumn("reason", F.lit("unscouted validation space exhausted")).unionByName(spent)
    status = touched.join(gone, source, "left").select(
        source, F.when(F.col("reason").isNull(), "refine").otherwise("failed").alias("status"), "reason"
    )
    return out, status


def calibration_windows(
    reserves: DataFrame, risk: DataFrame, blocked: DataFrame, *, source: str = "source_id", total: str = "total_sec",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Two reserves nearest the source's median risk, then nearest mid-timeline, for sources near the size limit.

    ``reserves``: ``window_id, scout_id, start_sec, duration_sec``. ``risk``:
    ``window_id, difficulty`` of the scouts. ``blocked`` per source:
    ``mean_video_bps, audio_bitrate_bps, predicted_bytes, max_output_bytes`` and
    the length. Near the limit: the central estimate fits, the upper one does not.
    """
    central = predicted_bytes("mean_video_bps", "audio_bitrate_bps", total)
    near = blocked.filter((central <= F.col("max_output_bytes")) & (F.col("max_output_bytes") < F.col("predicted_bytes")))
    counts = risk.groupBy(source, F.col("difficulty").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = risk.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    counts = value_chunk(counts, [source], "_v", rows_per_chunk=rows_per_chunk)
    below = ordered(counts, [source], ["_v"], running={"_below": ("sum", F.col("_c"))}).join(sizes, source)
    middle = F.floor(F.col("_n") / 2)
    median = below.filter((F.col("_below") <= middle) & (middle < F.col("_below") + F.col("_c"))).select(source, F.col("_v").alias("_median"))
    rows = reserves.join(near.select(source, F.col(total).alias("_len")), source).join(median, source, "left")
    known = risk.select(source, F.col("window_id").cast("string").alias("scout_id"), F.col("difficulty").alias("_risk"))
    rows = rows.join(known, [source, "scout_id"], "left")
    center = F.col("start_sec") + F.col("duration_sec") / 2.0
    off_risk = F.when(F.col("_median").isNull(), F.lit(0.0)).otherwise(F.abs(F.coalesce("_risk", F.lit(0.5)) - F.col("_median")))
    order = Window.partitionBy(source).orderBy(off_risk, F.abs(center - F.col("_len") / 2.0), "start_sec", "window_id")
    return rows.withColumn("pick", F.row_number().over(order)).filter("pick <= 2").select(source, "pick", "window_id", "start_sec", "duration_sec")


def near_threshold_expand(
    selection: DataFrame, reserves: DataFrame, *, source: str = "source_id", band: float = policy.BALANCE.confidence_band
) -> DataFrame:
    """For selections that passed by less than ``band``: the reserve to promote (most reasons, then earliest)."""
    close = selection.filter((F.col("status") == "found") & (F.col("gate") - F.col("target") < band)).select(source, F.col("gate").alias("selected_gate"))
    entry = F.struct("window_id", "start_sec", "duration_sec", "reasons", "scout_id")
    best = reserves.groupBy(source).agg(F.min_by(entry, F.struct((-F.size("reasons")).alias("n"), "start_sec", "window_id")).alias("_r"))
    return close.join(best, source).select(
        source,
        F.concat(F.lit("search:adaptive:"), "_r.window_id").alias("window_id"),
        F.col("_r.start_sec"),
        F.col("_r.duration_sec"),
        F.array_distinct(F.concat("_r.reasons", F.array(F.lit("adaptive_near_threshold")))).alias("reasons"),
        F.col("_r.scout_id"),
        "selected_gate",
    )


def final_gate(
    frame_scores: DataFrame,
    shots: DataFrame,
    target: float,
    *,
    clip: str = "clip_id",
    frames_per_chunk: int = FRAMES_PER_CHUNK,
) -> DataFrame:
    """Per shot: mean, worst second inside it, worst second across its end, and whether it failed.

    ``frame_scores``: contiguous ``frame_no``, ``score``, ``fps``. ``shots``:
    ``shot_idx`` 0..n-1 with half-open frames. If the whole clip misses the
    target but no shot fails its floors, the shot with the largest
    frame-weighted deficit fails. Adds the clip's mean and worst second as
    ``clip_mean`` and ``clip_worst_1s``, and ``covered``: do the scores cover
    exactly the frames of the shots? A clip that is not covered is not to pass.
    """
    shots = cut(shots)  # small, and read by every step
    second = F.greatest(F.lit(1), F.ceil("fps"))
    clips = frame_scores.groupBy(clip).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("score").alias("clip_mean"), F.max(second).cast("long").alias("_sec"),
        F.min("frame_no").alias("_first"), F.max("frame_no").alias("_top"), F.count_distinct("frame_no").alias("_frames"),
    )
    clips = clips.withColumn("_size", F.least("_n", "_sec"))
    starts = shots.select(clip, F.col("start_frame").alias("frame_no"), "shot_idx", F.col("start_frame").alias("_start"))
    rows = frame_scores.select(clip, "frame_no", "score", second.alias("_second")).join(starts, [clip, "frame_no"], "left")
    rows = frame_chunks(rows, "frame_no", frames_per_chunk=frames_per_chunk)
    rows = ordered(
        rows, [clip], ["frame_no"], running={"_shot": ("max", F.col("shot_idx")), "_from": ("max", F.col("_start"))}
    )
    rows = rows.select(
        clip, "frame_no", "score", "_second", F.coalesce("shot_idx", "_shot").alias("shot_idx"),
        (F.col("frame_no") - F.coalesce("_start", "_from")).alias("_pos"),
    )
    rows = spill(rows, "gate-frames")  # one ordered pass over the frames, read four times below
    clips = cut(clips)
    keys = [clip, "shot_idx"]
    inside = rolling_means(rows, keys, "_pos", "score", F.col("_second"), frames_per_chunk=frames_per_chunk)
    per_shot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.avg("score").alias("mean_vmaf"))
    per_shot = per_shot.join(inside.groupBy(*keys).agg(F.min("mean").alias("_low")), keys, "left")
    per_shot = per_shot.withColumn("worst_1s_vmaf", F.coalesce("_low", "mean_vmaf")).drop("_low")

    # Windows crossing a cut: for each cut only the (size - 1) window starts that reach over it.
    sized = rows.select(clip, "frame_no", "score").join(clips.select(clip, "_size"), clip)
    across = rolling_means(sized, [clip], "frame_no", "score", F.col("_size"), frames_per_chunk=frames_per_chunk)
    across = across.select(clip, (F.col("last_pos") - F.col("size") + 1).alias("_w"), F.col("mean").alias("_m"))
    cuts = shots.filter("shot_idx > 0").join(clips.select(clip, "_n", "_size"), clip)
    low = F.greatest(F.lit(0).cast("long"), F.col("start_frame") - F.col("_size") + 1)
    high = F.least(F.col("start_frame"), F.col("_n") - F.col("_size") + 1) - 1
    cuts = cuts.filter(high >= low).select(clip, (F.col("shot_idx") - 1).alias("shot_idx"), F.explode(F.sequence(low, high)).alias("_w"))
    boundary = cuts.join(across, [clip, "_w"]).groupBy(*keys).agg(F.min("_m").alias("_edge"))
    whole = across.groupBy(clip).agg(F.min("_m").alias("clip_worst_1s"))
    last = shots.groupBy(clip).agg(F.max("shot_idx").alias("_last"), F.max("end_frame").alias("_end"))
    covered = (F.col("_first") == 0) & (F.col("_n") == F.col("_frames")) & (F.col("_n") == F.col("_end")) & (F.col("_top") == F.col("_n") - 1)
    out = per_shot.join(last, clip).join(boundary, keys, "left").join(clips.join(whole, clip, "left"), clip)
    out = out.withColumn("boundary_worst_1s", F.when(F.col("shot_idx") < F.col("_last"), F.coalesce("_edge", F.lit(100.0))))
    mean_floor, worst_floor = max(0.0, target - policy.SHOT_MEAN_FLOOR_DROP), max(0.0, target - policy.SHOT_WORST_FLOOR_DROP)
    own = (F.col("mean_vmaf") < mean_floor) | (F.col("worst_1s_vmaf") < worst_floor)
    broken = F.coalesce(F.col("boundary_worst_1s") < worst_floor, F.lit(False))
    out = out.withColumn("_own", own | broken)
    after = out.filter(broken).select(clip, (F.col("shot_idx") + 1).alias("shot_idx"), F.lit(True).alias("_after"))
    out = out.join(after, keys, "left").withColumn("_failed", F.col("_own") | F.col("_after").isNotNull())
    state = out.groupBy(clip).agg(
        F.bool_or("_failed").alias("_any"),
        F.max_by("shot_idx", F.struct(((target - F.col("mean_vmaf")) * F.col("frames")).alias("d"), (-F.col("shot_idx")).alias("i"))).alias("_worst_shot"),
    )
    pick = (F.col("clip_mean") < target) & ~F.col("_any") & (F.col("shot_idx") == F.col("_worst_shot"))
    return out.join(state, clip).select(
        *keys, "frames", "mean_vmaf", "worst_1s_vmaf", "boundary_worst_1s", (F.col("_failed") | pick).alias("failed"), "clip_mean",
        F.coalesce("clip_worst_1s", "clip_mean").alias("clip_worst_1s"), covered.alias("covered"),
    )
