"""Choosing which windows of a source to measure.

Scout grids and even windows are generated per row. The plan itself is a greedy
choice per source, folded over arrays of many sources at a time. A source is
planned only when its observations are exactly the windows of its scout grid, of
which there are at most 128, so what a fold holds is bounded by that check, not
by hope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ratelens import policy
from ratelens.functions import rate
from ratelens.functions.identity import unit_hash
from ratelens.operators import greedy
from ratelens.operators.greedy import BLIND, WHOLE
from ratelens.operators.ranking import adaptive_window_count, content_stats
from ratelens.policy import Profile
from ratelens.session import cut, spill, spread

MAX_SCOUTS = 128  # fixed value: the largest scout grid a profile may ask for


def _half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("int")


def blind_window(total: Column, seed: Column, profile: Profile) -> Column:
    """The validation interval nobody looks at while planning."""
    length = F.least(F.lit(profile.sample_duration_sec), total)
    start = (total - length) * (0.25 + 0.5 * unit_hash(seed, F.lit("validation")))
    return F.struct(start.alias("start_sec"), length.alias("duration_sec"))


def _scouts(total: Column, profile: Profile) -> Column:
    """The number of scout windows of a grid."""
    pools = profile.search_windows[1] + profile.holdout_target[1] + profile.reserves
    wanted = F.greatest(F.lit(pools * 2), rate.search_window_count(total, profile) * profile.scout_multiplier)
    return F.greatest(F.lit(1), F.least(F.lit(profile.scout_max_windows), wanted))


def scout_grid(
    sources: DataFrame, profile: Profile = policy.BALANCE, *, source: str = "source_id", total: str = "duration_sec",
    seed: str | None = None,
) -> DataFrame:
    """Scout windows left and right of the blind interval, jittered inside equal cells; and that interval.

    Sources short enough to be analysed whole, or without a positive length, get no rows.
    """
    seed_col = F.col(seed or source)
    rows = sources.filter((F.col(total) > profile.whole_video_max_sec)).select(
        F.col(source), F.col(total).cast("double").alias("_len"), seed_col.cast("string").alias("_seed")
    )
    rows = rows.withColumn("_blind", blind_window(F.col("_len"), F.col("_seed"), profile))
    b0, bd = F.col("_blind.start_sec"), F.col("_blind.duration_sec")
    rows = rows.filter(bd < F.col("_len")).withColumn("_n", _scouts(F.col("_len"), profile))
    rows = rows.withColumn("_d", F.least(F.lit(profile.scout_duration_sec), b0, F.col("_len") - b0 - bd))
    share = _half_even(F.col("_n") * b0 / (F.col("_len") - bd))
    left = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.least(F.col("_n") - 1, share))).otherwise(1)
    rows = rows.withColumn("_left", left).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i"))
    on_left = F.col("_i") < F.col("_left")
    low = F.when(on_left, F.lit(0.0)).otherwise(b0 + bd)
    high = F.when(on_left, b0).otherwise(F.col("_len"))
    place = F.when(on_left, F.col("_i")).otherwise(F.col("_i") - F.col("_left"))
    count = F.when(on_left, F.col("_left")).otherwise(F.col("_n") - F.col("_left"))
    cell = (high - low) / count
    jitter = unit_hash("_seed", F.concat(F.lit("scout:"), F.col("_i")))
    start = F.when(cell >= F.col("_d"), low + place * cell + (cell - F.col("_d")) * jitter).otherwise(
        low + (high - low - F.col("_d")) * place / F.greatest(F.lit(1), count - 1)
    )
    scouts = rows.select(
        source,
        F.concat(F.lit("scout-"), F.lpad((F.col("_i") + 1).cast("string"), 3, "0")).alias("window_id"),
        F.lit("scout").alias("pool"),
        start.alias("start_sec"),
        F.col("_d").alias("duration_sec"),
        F.array().cast("array<string>").alias("reasons"),
    )
    blind = rows.filter("_i = 0").select(
        source, F.lit(BLIND).alias("window_id"), F.lit("holdout").alias("pool"), b0.alias("start_sec"), bd.alias("duration_sec"),
        F.array(F.lit("unscouted_validation")).alias("reasons"),
    )
    return scouts.unionByName(blind)


def even_windows(
    sources: DataFrame, profile: Profile = policy.BALANCE, *, source: str = "source_id", total: str = "duration_sec"
) -> DataFrame:
    """Evenly spaced windows; the whole clip when it is short."""
    length = F.col(total).cast("double")
    rows = sources.filter(length > 0).select(F.col(source), length.alias("_len"))
    rows = rows.withColumn("_whole", rate.whole_clip("_len", profile))
    rows = rows.withColumn("_n", F.when(F.col("_whole"), 1).otherwise(rate.search_window_count("_len", profile)))
    rows = rows.withColumn("_d", F.when(F.col("_whole"), F.col("_len")).otherwise(
        F.least(F.lit(profile.sample_duration_sec), F.col("_len") / F.col("_n"))
    ))
    last = F.greatest(F.lit(0.0), F.col("_len") - F.col("_d"))
    spread = F.transform(
        F.sequence(F.lit(1), F.col("_n")),
        lambda i: F.greatest(F.lit(0.0), F.least(last, F.col("_len") * (i / (F.col("_n") + 1)) - F.col("_d") / 2.0)),
    )
    packed = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1), lambda i: last * i / F.greatest(F.col("_n") - 1, F.lit(1))
    )
    rows = rows.withColumn("_even", spread)
    tight = F.exists(
        F.zip_with(
            F.slice("_even", F.lit(2), F.greatest(F.col("_n") - 1, F.lit(0))), F.slice("_even", F.lit(1), F.greatest(F.col("_n") - 1, F.lit(0))),
            lambda b, a: b < a + F.col("_d"),
        ),
        lambda x: x,
    )
    starts = F.when(F.col("_n") == 1, F.array(last / 2.0)).when(tight, packed).otherwise(F.col("_even"))
    return rows.select(source, "_d", F.posexplode(starts).alias("window_no", "start_sec")).select(
        source, "window_no", "start_sec", F.col("_d").alias("duration_sec")
    )


def shot_strata(shots: DataFrame, profile: Profile = policy.BALANCE, *, fps: str = "fps") -> DataFrame:
    """One centred window per equal stratum of each shot, the last one held out; short shots whole.

    Half-open frames. Adds ``stratum``, ``pool``, ``window_start`` and ``window_end``.
    """
    frames = F.col("end_frame") - F.col("start_frame")
    count = profile.shot_search_windows + 1
    length = F.greatest(F.lit(1).cast("long"), F.ceil(F.col(fps) * profile.shot_window_sec).cast("long"))
    rows = shots.withColumn("_f", frames.cast("long")).withColumn("_l", length)
    whole = F.col("_f") <= F.col("_l") * count
    rows = rows.withColumn("_whole", whole).select(
        "*", F.explode(F.when(F.col("_whole"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(count - 1)))).alias("stratum")
    )
    left = F.col("start_frame") + F.floor(F.col("_f") * F.col("stratum") / count)
    right = F.col("start_frame") + F.floor(F.col("_f") * (F.col("stratum") + 1) / count)
    start = left + F.floor((right - left - F.col("_l")) / 2)
    return rows.withColumn("window_start", F.when(F.col("_whole"), F.col("start_frame")).otherwise(start).cast("long")).withColumn(
        "window_end", F.when(F.col("_whole"), F.col("end_frame")).otherwise(F.col("window_start") + F.col("_l")).cast("long")
    ).withColumn("pool", F.when(~F.col("_whole") & (F.col("stratum") == count - 1), "holdout").otherwise("search")).drop("_f", "_l", "_whole")


# --- greedy plan: the folds are in greedy.py -------------------------------------


def _observed(risk: DataFrame, lengths: DataFrame, profile: Profile, source: str) -> DataFrame:
    """Observations with the window that each would become, beside the columns of ``lengths``: ``source``, ``_len`` and others.

    Joins by source are merges here: a compressed file of many sources looks small enough to broadcast.
    """
    length = F.least(F.lit(profile.sample_duration_sec), F.col("_len"))
    center = F.col("start_sec") + F.col("duration_sec") / 2.0
    at = F.least(F.greatest(F.lit(0.0), center - length / 2.0), F.greatest(F.lit(0.0), F.col("_len") - length))
    return risk.join(lengths.hint("merge"), source).withColumns(
        {"_d": length, "id": F.col("window_id").cast("string"), "center": center, "at": at}
    )


def _schema(rows: DataFrame, source: str, others: str) -> StructType:
    return StructType([StructField(source, rows.schema[source].dataType), *StructType.fromDDL(others).fields])


def _fold(rows: DataFrame, columns: list[str], source: str, fold, schema: StructType) -> DataFrame:
    """``fold`` over the rows of each source, which :func:`ratelens.operators.greedy.whole_sources` finds by their number."""
    # The window keeps a source's rows together, however the joins before it are carried out.
    counted = rows.select(source, *columns).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(source)))
    return counted.sortWithinPartitions(source).mapInArrow(fold, schema)


def _planable(risk: DataFrame, long: DataFrame, source: str) -> DataFrame:
    """``long`` with ``_ok``: observations must be the scout grid's windows, each once; NULL if there are neither.

    ``long`` has the size of each row's grid, ``_grid``. A source is one row of
    counts and of bits that its windows' numbers set, however many observations it has.
    """
    number = F.substring(F.col("window_id").cast("string"), 7, 10).try_cast("int")
    named = F.concat(F.lit("scout-"), F.lpad(number.cast("string"), 3, "0")) == F.col("window_id").cast("string")
    numbers = risk.select(source, F.when(named & number.between(1, MAX_SCOUTS), number).alias("_no"))
    seen = numbers.groupBy(source).agg(
        F.count(F.lit(1)).alias("_rows"), F.count("_no").alias("_named"), F.max("_no").alias("_last"),
        *[F.bit_or(F.expr(f"CASE WHEN (_no - 1) DIV 64 = {i} THEN shiftleft(1L, CAST((_no - 1) % 64 AS INT)) ELSE 0L END")).alias(f"_bits{i}")
          for i in range(MAX_SCOUTS // 64)],
    )
    same = Window.partitionBy(source)
    rows = long.withColumns({"_most": F.max("_grid").over(same), "_all": F.sum("_grid").over(same)}).join(seen.hint("merge"), source, "left")
    different = sum((F.bit_count(f"_bits{i}") for i in range(1, MAX_SCOUTS // 64)), F.bit_count("_bits0"))
    ok = (F.col("_all") <= MAX_SCOUTS) & (F.least("_rows", "_named", "_last", different) == F.col("_most")) & (
        F.greatest("_rows", "_named", "_last", different) == F.col("_most")
    )
    known = F.col("_all").isNotNull() | F.col("_rows").isNotNull()
    return rows.select(*long.columns, F.when(known, F.coalesce(ok, F.lit(False))).alias("_ok"))


def greedy_diverse_pick(
    risk: DataFrame,
    chosen: DataFrame | Column,
    sources: DataFrame,
    count: int,
    profile: Profile = policy.BALANCE,
    *,
    capacity_reserve: int = 0,
    source: str = "source_id",
    total: str = "duration_sec",
    reason: str = "holdout_difficulty_and_diversity",
    dealt: bool = False,
) -> DataFrame:
    """Up to ``count`` further windows per source beside ``chosen`` ``(source, scout_id, start_sec)``.

    ``chosen`` may be a column of ``risk`` instead, so that ``risk`` is read once: an array of
    ``(scout_id, start_sec)``, the same for all rows of a source. Whether the
    observations match a scout grid is :func:`sample_plan`'s test, not this
    one's. A source's observations are folded in one task. ``dealt``: ``risk``
    lies in enough partitions by source already (see :func:`ratelens.session.spread`).
    """
    if isinstance(chosen, DataFrame):
        held = chosen.groupBy(source).agg(F.collect_list(F.struct("scout_id", "start_sec")).alias("_base"))
        risk = risk.join(held.hint("merge"), source, "left")
    else:
        risk = risk.withColumn("_base", chosen)
    risk = risk.withColumn("_base", F.col("_base").cast("array<struct<scout_id: string, start_sec: double>>"))
    obs = _observed(risk, sources.select(source, F.col(total).cast("double").alias("_len")), profile, source)
    picks = _schema(risk, source, "pick_no int, scout_id string, start_sec double, duration_sec double")
    return _fold(
        obs if dealt else spread(obs, source), ["_len", "_d", "id", "start_sec", "center", "at", "difficulty", "_base"], source,
        greedy.diverse_picks(count, capacity_reserve, source, picks.names), picks,
    )


def sample_plan(
    risk: DataFrame,
    sources: DataFrame,
    profile: Profile = policy.BALANCE,
    *,
    source: str = "source_id",
    total: str = "duration_sec",
    dealt: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(windows, rejects): the measured windows of every source by pool.

    ``risk`` is the output of ``score_risk``. Pools are ``search``, ``holdout``
    (with the blind interval) and ``reserve``. Short sources, and sources without
    room for independent windows, are analysed whole. Sources whose observations
    do not match their scout grid, or that cannot be filled, are rejected.
    ``dealt``: ``risk`` lies in enough partitions by source already.
    """
    short = sources.filter((F.col(total) > 0) & (F.col(total) <= profile.whole_video_max_sec)).select(
        source, F.col(total).cast("double").alias("_len"), F.array(F.lit("whole_video")).alias("_why")
    )
    length = F.col(total).cast("double")
    blind = blind_window(length, F.col(source).cast("string"), profile)
    long = sources.filter(F.col(total) > profile.whole_video_max_sec).select(
        source, length.alias("_len"), blind["start_sec"].alias("_b0"),
        F.when(blind["duration_sec"] < length, _scouts(length, profile)).alias("_grid"),
    )
    # Small beside the observations: one row per source, read by both joins below and by the rejects.
    checked = cut(_planable(risk, long, source))
    good = checked.filter("_ok").select(source, "_len", "_b0")
    seen = risk.join(good.select(source).hint("merge"), source, "left_semi")
    obs = _observed(content_stats(seen, [source], each=True), good, profile, source)
    wanted = F.lit(profile.holdout_target[0]) + _half_even((profile.holdout_target[1] - profile.holdout_target[0]) * F.col("uncertainty"))
    holdouts = F.greatest(
        F.lit(1), F.least(F.lit(profile.holdout_target[1]), F.greatest(rate.holdout_window_count("_len", profile), wanted))
    )
    obs = obs.withColumns({
        "_rh": holdouts - 1, "_adaptive": adaptive_window_count("_len", "uncertainty", "heterogeneity", profile),
        "scene": F.col("max_scene_score"), "cuts": F.col("cut_count") if "cut_count" in risk.columns else F.lit(0),
    })
    columns = ["_len", "_d", "_b0", "_rh", "_adaptive", "id", "start_sec", "center", "at", "difficulty", "si_rank", "ti_rank", "transition", "scene", "cuts"]
    plan = _schema(
        risk, source,
        "pool string, window_id string, start_sec double, duration_sec double, reasons array<string>, scout_id string, reason string",
    )
    # The windows of every source, read for windows and for rejects: plan once.
    rows = spill(_fold(obs if dealt else spread(obs, source), columns, source, greedy.sample_plans(profile, source, plan.names), plan), "plans")
    whole = short.select(
        source, F.lit("search").alias("pool"), F.lit(WHOLE).alias("window_id"), F.lit(0.0).alias("start_sec"),
        F.col("_len").alias("duration_sec"), F.col("_why").alias("reasons"), F.lit(None).cast("string").alias("scout_id"),
    )
    rejects = rows.filter(F.col("reason").isNotNull()).select(source, "reason").unionByName(
        checked.filter("NOT _ok").select(source).distinct().withColumn("reason", F.lit("observations do not match the scout grid"))
    )
    return rows.filter(F.col("reason").isNull()).drop("reason").unionByName(whole), rejects
