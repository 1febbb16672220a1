"""Choosing a bitrate per source from measured candidates.

Candidates: ``source_id, bitrate_bps, gate`` and, where sizes matter,
``predicted_bytes, predicted_ratio``. Selections are single aggregations with
conditional min_by / max_by, so a source with many candidates shrinks map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens import policy
from ratelens.functions.rate import ceil_candidate, floor_candidate
from ratelens.plans.ordered import ordered, value_chunk

PREDICTED_MARGIN = 0.8  # fixed value: points by which a predicted rate must pass for a lower one to be tried
FOUND, UNSATISFIED = "found", "constraint_unsatisfied"
SIZE_BLOCKED, QUALITY_UNREACHABLE, MEDIA_BUDGET = "size_blocked", "quality_unreachable", "media_budget_too_small"


def select_candidate(candidates: DataFrame, limits: DataFrame, *, source: str = "source_id") -> DataFrame:
    """Lowest acceptable bitrate of each source, or why there is none.

    ``limits`` per source: ``target``, ``margin``, ``min_video_bps``,
    ``max_kbps_bps`` (configured cap, 0 = none), ``max_output_bytes`` and
    ``max_video_bps`` (what the byte budget leaves). A candidate that also meets
    ``target + margin`` is preferred; the margin never decides pass or fail.
    """
    rows = limits.join(candidates, source, "left")
    rate, gate, size = F.col("bitrate_bps"), F.col("gate"), F.col("predicted_bytes")
    eligible = (rate >= F.col("min_video_bps")) & ((F.col("max_kbps_bps") == 0) | (rate <= F.col("max_kbps_bps")))
    passing = eligible & (gate >= F.col("target"))
    fitting = eligible & size.isNotNull() & (size <= F.col("max_output_bytes"))
    preferred = passing & fitting & (gate >= F.col("target") + F.col("margin"))
    entry = F.struct("bitrate_bps", "gate", "predicted_bytes", "predicted_ratio")

    def lowest(test: Column) -> Column:
        return F.min_by(entry, F.when(test, rate))

    best_fit = F.max_by(entry, F.when(fitting, F.struct(gate.alias("g"), (-rate).alias("r"))))
    out = rows.groupBy(source).agg(
        F.coalesce(lowest(preferred), lowest(passing & fitting)).alias("_chosen"),
        lowest(passing).alias("_required"),
        best_fit.alias("_fit"),
        F.max(F.col("max_output_bytes")).alias("max_output_bytes"),
        F.max(F.col("max_video_bps") < F.col("min_video_bps")).alias("_tight"),
    )
    tight, found = F.col("_tight"), F.col("_chosen").isNotNull()
    blocked = F.coalesce(F.col("_required.predicted_bytes") > F.col("max_output_bytes"), F.lit(False))
    shown = F.coalesce("_chosen", "_required", "_fit")
    out = out.withColumn("_s", F.when(~tight, shown)).withColumn("_ok", ~tight & found)
    unmet = ~tight & ~found
    return out.select(
        source,
        F.when(F.col("_ok"), FOUND).otherwise(UNSATISFIED).alias("status"),
        F.when(tight, MEDIA_BUDGET).when(F.col("_ok"), F.lit(None)).when(blocked, SIZE_BLOCKED).otherwise(QUALITY_UNREACHABLE).alias("failure_kind"),
        F.coalesce("_s.bitrate_bps", F.lit(0)).cast("long").alias("selected_bps"),
        F.col("_s.gate").alias("gate"),
        F.col("_s.predicted_bytes").alias("predicted_bytes"),
        F.col("_s.predicted_ratio").alias("predicted_ratio"),
        F.when(unmet, F.col("_required.predicted_ratio")).alias("required_ratio"),
        F.when(unmet, F.col("_required.bitrate_bps")).alias("required_bps"),
        F.when(~tight, F.col("_fit.bitrate_bps")).alias("best_fit_bps"),
        F.when(~tight, F.col("_fit.gate")).alias("best_fit_gate"),
        "max_output_bytes",
    )


def _with_next(candidates: DataFrame, by: Sequence[str], rows_per_chunk: int | None) -> DataFrame:
    rows = value_chunk(candidates, by, "bitrate_bps", rows_per_chunk=rows_per_chunk)
    return ordered(rows, by, ["bitrate_bps"], after={"next_bps": "bitrate_bps", "next_gate": "gate"})


def threshold_bitrate(
    candidates: DataFrame, target: Column, by: Sequence[str] = ("source_id",), *, rows_per_chunk: int | None = None
) -> DataFrame:
    """Bitrate where the target is crossed: interpolated in the first failing-to-passing bracket, else lowest passing."""
    rows = _with_next(candidates.withColumn("_target", target), by, rows_per_chunk)
    goal = F.col("_target")
    bracket = (F.col("gate") < goal) & (goal <= F.col("next_gate"))
    delta = F.col("next_gate") - F.col("gate")
    share = (goal - F.col("gate")) / F.when(delta > 1e-9, delta)
    between = F.bround(F.col("bitrate_bps") + share * (F.col("next_bps") - F.col("bitrate_bps")), 0).cast("long")
    crossing = F.coalesce(between, F.col("next_bps"))
    return rows.groupBy(*by).agg(
        F.coalesce(
            F.min_by(crossing, F.when(bracket, F.col("bitrate_bps"))), F.min(F.when(F.col("gate") >= goal, F.col("bitrate_bps")))
        ).alias("threshold_bps")
    )


def search_bounds(candidates: DataFrame, limits: DataFrame, *, source: str = "source_id") -> DataFrame:
    """(lower, seed, ceiling) for the exact search: highest failing, lowest passing, and the cap.

    ``limits``: ``target``, ``min_video_bps``, ``max_video_bps``, ``ceiling_bps``.
    """
    rows = limits.join(candidates.select(source, "bitrate_bps", "gate"), source, "left")
    ends = rows.groupBy(source, "min_video_bps", "max_video_bps", "ceiling_bps").agg(
        F.max(F.when(F.col("gate") < F.col("target"), F.col("bitrate_bps"))).alias("_fail"),
        F.min(F.when(F.col("gate") >= F.col("target"), F.col("bitrate_bps"))).alias("_pass"),
    )
    any_pass = F.col("_pass").isNotNull()
    return ends.select(
        source,
        F.when(any_pass, F.greatest("min_video_bps", F.coalesce("_fail", "min_video_bps"))).otherwise(F.col("min_video_bps")).alias("lower_bps"),
        F.coalesce("_pass", "max_video_bps").alias("seed_bps"),
        F.when(any_pass, F.greatest("_pass", "ceiling_bps")).otherwise(F.col("ceiling_bps")).alias("upper_bps"),
    )


def propose_next(measured: DataFrame, limits: DataFrame, *, source: str = "source_id", max_trials: int = policy.MAX_TRIALS) -> DataFrame:
    """The next bitrate to measure for each source, NULL when its search is over.

    Order: budget, floor (if the budget passes) or ceiling (if it fails), then
    bisection between the highest failing and the lowest passing bitrate.
    ``limits``: ``target``, ``min_video_bps``, ``max_video_bps``, ``ceiling_bps``,
    ``tolerance_bps``, and where one is known ``predicted_bps``. A predicted rate
    comes first. If it passes, the search is over, after one more rate a third of
    the way down where it passes by ``PREDICTED_MARGIN``; if it fails, the order
    above follows.
    """
    predicted = F.col("predicted_bps").cast("long") if "predicted_bps" in limits.columns else F.lit(None).cast("long")
    lowest = ceil_candidate("min_video_bps")
    bounds = limits.select(
        source,
        "target",
        F.when(
            predicted.isNotNull(),
            F.least(floor_candidate(F.greatest(lowest, predicted)), floor_candidate(F.greatest("ceiling_bps", "max_video_bps"))),
        ).alias("_predicted"),
        floor_candidate("max_video_bps").alias("_budget"),
        ceil_candidate("min_video_bps").alias("_floor"),
        floor_candidate(F.greatest("ceiling_bps", "max_video_bps")).alias("_ceiling"),
        F.greatest(F.lit(1000), F.col("tolerance_bps")).alias("_stop"),
    )
    rows = bounds.join(measured.select(source, "bitrate_bps", "gate"), source, "left")
    rate, passes = F.col("bitrate_bps"), F.col("gate") >= F.col("target")

    def at(column: str) -> Column:
        return F.bool_or(F.when(rate == F.col(column), passes))

    low_pass = F.min(F.when(passes, rate))
    state = rows.groupBy(source, "_budget", "_floor", "_ceiling", "_stop", "_predicted").agg(
        F.count("bitrate_bps").alias("trials"),
        at("_predicted").alias("_at_predicted"),
        F.bool_or(F.when(rate == F.col("_predicted"), F.col("gate") >= F.col("target") + PREDICTED_MARGIN)).alias("_well"),
        at("_budget").alias("_at_budget"),
        at("_floor").alias("_at_floor"),
        at("_ceiling").alias("_at_ceiling"),
        low_pass.alias("_high"),
    )
    # The highest failing rate below the lowest passing one needs the latter first.
    tops = rows.join(state.select(source, "_high"), source).groupBy(source).agg(
        F.max(F.when(~passes & (rate < F.col("_high")), rate)).alias("_low")
    )
    state = state.join(tops, source)
    start = F.when(F.col("_at_budget"), F.col("_floor")).otherwise(F.col("_budget"))
    low = F.greatest(start, F.coalesce("_low", start))
    middle = floor_candidate(F.floor((low + F.col("_high")) / 2))
    wide = (F.col("_high") - low) > F.col("_stop")
    third = F.floor((F.col("_predicted") - F.col("_floor")) / 3)
    nearby = floor_candidate(F.greatest("_floor", F.col("_predicted") - F.greatest("_stop", third)))
    step = (
        F.when(F.col("_predicted").isNotNull() & F.col("_at_predicted").isNull(), F.col("_predicted"))
        .when(F.col("_at_predicted") & F.col("_well"), nearby)
        .when(F.col("_at_predicted"), F.lit(None))
        .when(F.col("_at_budget").isNull(), F.col("_budget"))
        .when(F.col("_at_budget") & F.col("_at_floor").isNull(), F.col("_floor"))
        .when(F.col("_at_budget") & F.col("_at_floor"), F.lit(None))
        .when(~F.col("_at_budget") & F.col("_at_ceiling").isNull(), F.col("_ceiling"))
        .when(~F.col("_at_budget") & ~F.col("_at_ceiling"), F.lit(None))
        .when(wide, middle)
    )
    wanted = state.select(source, "trials", F.when(F.col("trials") < max_trials, step).alias("next_bps"))
    known = measured.select(source, F.col("bitrate_bps").alias("next_bps"), F.lit(True).alias("_known")).distinct()
    return wanted.join(known, [source, "next_bps"], "left").select(
        source, "trials", F.when(F.col("_known").isNull(), F.col("next_bps")).alias("next_bps")
    )


def propose_next_for_shots(
    measured: DataFrame, limits: DataFrame, by: Sequence[str] = ("title_id", "shot_idx"), *, max_trials: int = 5,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Per shot: half, base and double rate first; then bisect the bracket, double, or halve.

    ``limits`` per shot: ``target``, ``base_bps``, ``min_video_bps``, ``ceiling_bps``.
    """
    by = list(by)

    def step(value: Column) -> Column:
        return F.greatest(F.lit(1000), (F.floor(F.least(F.col("ceiling_bps"), value) / 1000) * 1000)).cast("long")

    base = F.col("base_bps")
    first = F.array_distinct(
        F.array_sort(F.array(step(F.greatest("min_video_bps", F.floor(base / 2))), step(base), step(F.least(F.col("ceiling_bps"), base * 2))))
    )
    bounds = limits.withColumn("_first", first)
    starts = bounds.select(*by, F.posexplode("_first").alias("_i", "bitrate_bps"))
    tried = measured.select(*by, "bitrate_bps").distinct()
    todo = starts.join(tried, [*by, "bitrate_bps"], "left_anti").groupBy(*by).agg(F.min("bitrate_bps").alias("_start"))
    rows = bounds.select(*by, "target", "min_video_bps", "ceiling_bps").join(measured, by)
    rows = value_chunk(rows, by, "bitrate_bps", rows_per_chunk=rows_per_chunk)
    rows = ordered(rows, by, ["bitrate_bps"], after={"_nb": "bitrate_bps", "_ng": "gate"})
    bracket = (F.col("gate") < F.col("target")) & (F.col("target") <= F.col("_ng"))
    state = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"),
        F.min_by(F.floor((F.col("bitrate_bps") + F.col("_nb")) / 2000) * 1000, F.when(bracket, F.col("bitrate_bps"))).alias("_mid"),
        (F.max("gate") < F.max("target")).alias("_short"),
        F.least(F.max("ceiling_bps"), F.max("bitrate_bps") * 2).alias("_double"),
        F.greatest(F.max("min_video_bps"), F.floor(F.min("bitrate_bps") / 2000) * 1000).alias("_half"),
    )
    state = bounds.select(*by).join(state, by, "left").join(todo, by, "left")
    later = F.coalesce("_mid", F.when(F.col("_short"), F.col("_double")).otherwise(F.col("_half")))
    wanted = state.select(
        *by, F.coalesce("trials", F.lit(0)).alias("trials"), F.coalesce("_start", later).cast("long").alias("next_bps")
    )
    known = tried.select(*by, F.col("bitrate_bps").alias("next_bps"), F.lit(True).alias("_known"))
    wanted = wanted.join(known, [*by, "next_bps"], "left")
    open_ = F.col("_known").isNull() & (F.col("trials") < max_trials)
    return wanted.select(*by, "trials", F.when(open_, F.col("next_bps")).alias("next_bps"))


def nonmonotone_points(
    candidates: DataFrame, tolerance: float = 0.5, by: Sequence[str] = ("source_id",), *, rows_per_chunk: int | None = None
) -> DataFrame:
    """Neighbouring bitrates where the higher one scores lower by more than ``tolerance``."""
    rows = _with_next(candidates, by, rows_per_chunk)
    return rows.filter(F.col("next_gate") < F.col("gate") - tolerance).select(
        *by, F.col("bitrate_bps").alias("lower_bps"), F.col("gate").alias("lower_gate"), F.col("next_bps").alias("higher_bps"),
        F.col("next_gate").alias("higher_gate"),
    )


def remeasure_points(candidates: DataFrame, target: Column, tolerance: float = 0.5, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """For groups with a non-monotone pair: the measured bitrate whose score is nearest the target."""
    nearest = candidates.groupBy(*by).agg(
        F.min_by("bitrate_bps", F.struct(F.abs(F.col("gate") - target).alias("d"), "bitrate_bps")).alias("bitrate_bps")
    )
    return nearest.join(nonmonotone_points(candidates, tolerance, by).select(*by).distinct(), list(by), "left_semi")


def oracle_grid(limits: DataFrame, points: int = 8, *, source: str = "source_id") -> DataFrame:
    """Up to eight evenly spaced bitrates between ``min_video_bps`` and ``ceiling_bps`` of each source."""
    k = min(points, policy.MAX_TRIALS)
    if k <= 0:
        return limits.select(source, F.lit(0).cast("long").alias("bitrate_bps")).limit(0)
    low, high = F.col("min_video_bps"), F.col("ceiling_bps")
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)), lambda i: _round_bps(low + i * (high - low) / max(k - 1, 1))
    )
    return limits.select(source, F.explode(F.array_distinct(raw)).alias("bitrate_bps"))


def _round_bps(value: Column) -> Column:
    step = F.lit(policy.BITRATE_STEP)
    return F.greatest(step.cast("long"), (F.bround(value / step, 0) * step).cast("long"))


def oracle_bracket(points: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """Lowest passing and highest failing bitrate below it, monotonicity, and the bisection point.

    ``points``: ``bitrate_bps, gate, passed``.
    """
    by = list(by)
    rate, ok = F.col("bitrate_bps"), F.col("passed")
    ends = points.groupBy(*by).agg(
        F.min(F.when(ok, rate)).alias("upper_bps"), F.max(F.when(~ok, rate)).alias("_top_fail"), F.count(F.lit(1)).alias("points")
    )
    # The highest failing rate below the lowest passing one is a second, small aggregate.
    below = points.filter(~ok).join(ends.select(*by, "upper_bps"), by).filter(rate < F.col("upper_bps"))
    lower = below.groupBy(*by).agg(F.max("bitrate_bps").alias("_below"))
    out = ends.join(lower, by, "left")
    out = out.withColumn("lower_bps", F.when(F.col("upper_bps").isNull(), F.col("_top_fail")).otherwise(F.col("_below")))
    middle = _round_bps(F.floor((F.col("lower_bps") + F.col("upper_bps")) / 2))
    wide = (F.col("upper_bps") - F.col("lower_bps")) > 20_000
    fresh = (middle != F.col("lower_bps")) & (middle != F.col("upper_bps"))
    return out.select(
        *by, "points", "lower_bps", "upper_bps",
        F.coalesce(F.col("_top_fail") > F.col("upper_bps"), F.lit(False)).alias("monotonicity_violated"),
        F.when(wide & fresh, middle).alias("bisect_bps"),
    )


def baseline_pick(points: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """The smallest measured output that passed; never an interpolated one."""
    best = F.min_by(F.struct("bitrate_bps", "gate", "bytes"), F.when(F.col("passed"), F.struct("bytes", "bitrate_bps")))
    return points.groupBy(*by).agg(best.alias("_b")).select(
        *by, F.when(F.col("_b").isNotNull(), "measured").otherwise("no_passing_measured_point").alias("status"), "_b.*"
    )


def decision_options(selection: DataFrame, *, source: str = "source_id") -> DataFrame:
    """Legal next actions of each unsatisfied selection, one row per action.

    ``suggested_value`` is a ratio or a score; a suggested audio mode is in ``suggested_mode``.
    """
    kind, ratio = F.col("failure_kind"), F.col("required_ratio")

    def option(name: str, value: Column, analysis: bool, mode: str | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("action_code"), value.cast("double").alias("suggested_value"),
            F.lit(mode).cast("string").alias("suggested_mode"), F.lit(analysis).alias("requires_analysis"),
        )

    none = F.lit(None)
    actions = F.array(
        # The limit must admit the required ratio itself, so the next double above it is offered.
        F.when((kind == SIZE_BLOCKED) & (ratio <= 1.0), option("relax_size", _next_up(ratio), False)),
        F.when(F.col("best_fit_gate").isNotNull(), option("relax_quality", F.col("best_fit_gate"), False)),
        F.when(kind == MEDIA_BUDGET, option("change_media_budget", none, True, "aac")),
        F.when(kind == QUALITY_UNREACHABLE, option("reanalyze", none, True)),
        option("skip", none, False),
    )
    rows = selection.filter(F.col("status") == UNSATISFIED)
    return rows.select(source, F.explode(F.filter(actions, lambda a: a.isNotNull())).alias("_a")).select(source, "_a.*")


def _next_up(value: Column) -> Column:
    """Next representable double towards 1 for 0 < value <= 1: value + half a unit in the last place, rounded up."""
    exponent = F.floor(F.log2(value))
    ulp = F.pow(F.lit(2.0), exponent - 52)
    # log2 may round up to an integer just below a power of two; one step down is still exact there.
    safe = F.when(F.pow(F.lit(2.0), exponent) > value, ulp / 2).otherwise(ulp)
    return F.when(value >= 1.0, F.lit(1.0)).otherwise(value + safe)


def resolve_policy(
    candidates: DataFrame, limits: DataFrame, *, source: str = "source_id"
) -> DataFrame:
    """Apply each source's policy to an unsatisfied selection, then say why it is skipped, if it is.

    ``limits`` as for :func:`select_candidate`, with ``source_bytes``,
    ``size_policy`` (relax_size / relax_quality / ask) and ``quality_policy``
    (skip / ask). A relaxed source is selected again under its relaxed limit.
    """
    first = select_candidate(candidates, limits.drop("source_bytes", "size_policy", "quality_policy"), source=source)
    rows = first.join(limits.select(source, "source_bytes", "size_policy", "quality_policy"), source)
    blocked = (F.col("status") == UNSATISFIED) & (F.col("failure_kind") == SIZE_BLOCKED)
    by_size = blocked & (F.col("size_policy") == "relax_size") & (F.col("required_ratio") <= 1.0)
    by_quality = blocked & (F.col("size_policy") == "relax_quality") & F.col("best_fit_gate").isNotNull()
    relax = rows.filter(by_size | by_quality).select(
        source,
        F.when(by_size, F.greatest(F.lit(1), F.floor(F.col("source_bytes") * _next_up(F.col("required_ratio"))))).alias("_bytes"),
        F.when(by_quality, F.col("best_fit_gate")).alias("_target"),
    )
    relaxed = limits.join(relax, source).select(
        source, F.coalesce("_target", "target").alias("target"), "margin", "min_video_bps", "max_kbps_bps",
        F.coalesce("_bytes", "max_output_bytes").cast("long").alias("max_output_bytes"),
        # A larger size limit only widens the video budget.
        F.when(F.col("_bytes").isNotNull(), F.greatest("max_video_bps", "min_video_bps")).otherwise(F.col("max_video_bps")).alias("max_video_bps"),
    )
    again = select_candidate(candidates.join(relaxed.select(source), source, "left_semi"), relaxed, source=source)
    kept = first.join(relaxed.select(source), source, "left_anti").withColumn("relaxed", F.lit(False))
    both = kept.unionByName(again.withColumn("relaxed", F.lit(True))).join(limits.select(source, "quality_policy"), source)
    unmet = F.col("status") == UNSATISFIED
    origin = F.when(
        unmet & (F.col("failure_kind") == SIZE_BLOCKED) & (F.col("required_ratio") > 1.0), "smart_predicted_oversize"
    ).when(unmet & (F.col("failure_kind") == QUALITY_UNREACHABLE) & (F.col("quality_policy") == "skip"), "smart_analysis")
    return both.withColumn("skip_origin", origin).drop("quality_policy")


def size_gate(results: DataFrame, ratio: Column) -> DataFrame:
    """Is the produced file within ``floor(source * ratio)``? Adds the limit and the verdict."""
    allowed = F.floor(F.col("source_bytes") * ratio).cast("long")
    return results.withColumn("allowed_bytes", allowed).withColumn(
        "verdict", F.when(F.col("output_bytes") > F.col("allowed_bytes"), "needs_decision").otherwise("publishable")
    )
