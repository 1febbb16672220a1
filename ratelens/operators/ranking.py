"""Ranks, risk scores and content statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens import policy
from ratelens.plans.ordered import ordered, value_chunk
from ratelens.policy import Profile
from ratelens.session import cut, spill, spread


#: A value is common if it holds more than one in this many rows, so a column has fewer common values than this.
COMMON = 1_000
#: A group of more rows than this is not ranked by one task.
GROUP_ROWS = 1 << 16


def midranks(
    df: DataFrame, by: Sequence[str], ranks: dict[str, str], *, rows_per_chunk: int | None = None, bounded: bool = False
) -> DataFrame:
    """Tie-averaged rank within the group, scaled to [0, 1], for each ``output -> column``; 0.5 for a single row.

    Groups of at most ``GROUP_ROWS`` rows (``rows_per_chunk``, if given) are
    ranked by windows: one shuffle, and a sort that spills per column. Larger
    ones, of any size, are ranked on counts of their distinct values. ``bounded``
    says that there are none of those, so nothing is counted. Null values tie
    with each other below all others; null keys are a group.
    """
    by = list(by)
    if bounded:
        return _window_ranks(df, by, ranks)
    # One key per GROUP_ROWS rows at most, and usually none.
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    sizes = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    large = cut(sizes.where(F.col("_n") > (rows_per_chunk or GROUP_ROWS)).select("_k"))
    if large.isEmpty():
        return _window_ranks(spread(df, *by) if by else df, by, ranks)
    keyed = df.withColumn("_k", key)
    small = keyed.join(F.broadcast(large), "_k", "left_anti").drop("_k")
    rest = keyed.join(F.broadcast(large), "_k", "left_semi").drop("_k")
    return _window_ranks(spread(small, *by) if by else small, by, ranks).unionByName(_counted_ranks(rest, by, ranks, rows_per_chunk))


def _window_ranks(df: DataFrame, by: list[str], ranks: dict[str, str]) -> DataFrame:
    group = Window.partitionBy(*by)
    df, size = df.withColumn("_size", F.count(F.lit(1)).over(group)), F.col("_size")
    for name, column in ranks.items():
        line = group.orderBy(column)
        ties = F.count(F.lit(1)).over(line.rangeBetween(Window.currentRow, Window.currentRow))
        middle = F.rank().over(line) - 1 + (ties - 1) / 2.0
        df = df.withColumn(name, F.when(size == 1, F.lit(0.5)).otherwise(middle / F.nullif(size - 1, F.lit(0))))
    return df.drop("_size")


def _counted_ranks(df: DataFrame, by: list[str], ranks: dict[str, str], rows_per_chunk: int | None) -> DataFrame:
    """Groups of any size: ties collapse to counts before the shuffle, all columns of one type in one pass.

    The ranks are joined back: those of common (group, value)s are few and
    broadcast, and their rows are dealt out evenly.
    """
    # Nulls inside structs are equal, in groups, orders and joins.
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    kinds: dict[str, list[str]] = {}
    for name, column in ranks.items():
        kinds.setdefault(df.select(column).dtypes[0][1], []).append(name)
    out = df.withColumn("_k", key)
    # Where a row of a common value goes does not matter, as long as they do not all go to one task.
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    deal = F.pmod(F.xxhash64(*plain) + F.spark_partition_id(), F.lit(COMMON)).cast("int")
    for names in kinds.values():
        ranked = _value_ranks(df.withColumn("_k", key), {name: ranks[name] for name in names}, rows_per_chunk)
        for number, name in enumerate(names):
            own = ranked.where(F.col("_i") == number).select("_k", "_v", "_rank", "_common")
            common = own.where("_common").select("_k", "_v", F.col("_rank").alias("_r0"))
            rare = own.where("NOT _common").select("_k", "_v", F.lit(-1).alias("_deal"), F.col("_rank").alias("_r1"))
            out = out.withColumn("_v", F.struct(F.col(ranks[name]).alias("v"))).join(F.broadcast(common), ["_k", "_v"], "left")
            out = out.withColumn("_deal", F.when(F.col("_r0").isNull(), F.lit(-1)).otherwise(deal))
            out = out.join(rare, ["_k", "_v", "_deal"], "left").withColumn(name, F.coalesce("_r0", "_r1"))
            out = out.drop("_v", "_deal", "_r0", "_r1")
    return out.select(*df.columns, *ranks)


def _value_ranks(df: DataFrame, ranks: dict[str, str], rows_per_chunk: int | None) -> DataFrame:
    """(_k, _i, _v, _rank, _common), written out: the rank of each distinct value of column number ``_i``."""
    value = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.struct(F.col(c).alias("v")).alias("v")) for i, c in enumerate(ranks.values())]))
    each = df.select("_k", value.alias("_x")).select("_k", F.col("_x.i").alias("_i"), F.col("_x.v").alias("_v"))
    counts = value_chunk(each.groupBy("_k", "_i", "_v").agg(F.count(F.lit(1)).alias("_c")), ["_k", "_i"], "_v", rows_per_chunk=rows_per_chunk)
    sizes = counts.groupBy("_k", "_i").agg(F.sum("_c").alias("_n"))
    total = counts.where("_i = 0").agg(F.sum("_c").alias("total"))
    rows = ordered(counts, ["_k", "_i"], ["_v"], running={"_below": ("sum", F.col("_c"))}).join(sizes, ["_k", "_i"])
    middle = F.col("_below") + (F.col("_c") - 1) / 2.0
    rank = F.when(F.col("_n") == 1, F.lit(0.5)).otherwise(middle / F.nullif(F.col("_n") - 1, F.lit(0)))
    common = F.col("_c") * COMMON > total.scalar()
    return spill(rows.select("_k", "_i", "_v", rank.alias("_rank"), common.alias("_common")), "ranks")


def midrank(
    df: DataFrame, by: Sequence[str], value: str, *, out: str = "midrank", rows_per_chunk: int | None = None
) -> DataFrame:
    return midranks(df, by, {out: value}, rows_per_chunk=rows_per_chunk)


def _component(raw: Column, scale: float, rank: Column) -> Column:
    return 0.55 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw / scale)) + 0.45 * rank


def _unit(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def score_risk(
    observations: DataFrame, by: Sequence[str], *, rows_per_chunk: int | None = None, bounded: bool = False
) -> DataFrame:
    """Adds the risk components and ``difficulty`` (their weighted sum) to scout observations.

    Missing dark / flat / noise / text columns count as 0. ``bounded``: no source has more than ``GROUP_ROWS`` of them.
    """
    rows = observations
    for name in ("dark", "flat_or_gradient", "high_frequency_or_noise", "text_edge_like"):
        rows = rows.withColumn(name, _unit(F.col(name)) if name in rows.columns else F.lit(0.0))
    ranked = {"si_rank": "si_p90", "ti_rank": "ti_p90", "transition_rank": "max_scene_score"}
    rows = midranks(rows, by, ranked, rows_per_chunk=rows_per_chunk, bounded=bounded)
    rows = (
        rows.withColumn("spatial_detail", _component(F.col("si_p90"), 100.0, F.col("si_rank")))
        .withColumn("motion", _component(F.col("ti_p90"), 50.0, F.col("ti_rank")))
        .withColumn("transition", _component(F.col("max_scene_score"), 100.0, F.col("transition_rank")))
    )
    total = F.lit(0.0)
    for name, weight in policy.RISK_WEIGHTS.items():
        total = total + weight * F.col(name)
    return rows.withColumn("difficulty", total)


def content_stats(risk: DataFrame, by: Sequence[str], *, cut_count: str = "cut_count", each: bool = False) -> DataFrame:
    """Heterogeneity and uncertainty of each source, from its scored observations; ``each``: beside every observation."""
    by = list(by)
    named = list(policy.RISK_WEIGHTS)
    everything = [*named, "text_edge_like"]
    cuts = F.sum(cut_count) if cut_count in risk.columns else F.lit(0)
    totals = {
        "_n": F.count(F.lit(1)), "_cuts": cuts, "_absolute": F.avg("difficulty"),
        **{f"_sd_{c}": F.stddev_pop(c) for c in everything}, **{f"_mx_{c}": F.max(c) for c in named},
    }
    if each:
        group = Window.partitionBy(*by)
        stats = risk.select("*", *[(t if c == "_cuts" and cut_count not in risk.columns else t.over(group)).alias(c) for c, t in totals.items()])
    else:
        stats = risk.groupBy(*by).agg(*[t.alias(c) for c, t in totals.items()])
    dispersion = sum((F.col(f"_sd_{c}") for c in everything), F.lit(0.0)) / len(everything)
    high = sum((F.when(F.col(f"_mx_{c}") >= 0.65, 1.0).otherwise(0.0) for c in named), F.lit(0.0)) / len(named)
    spread = F.least(F.lit(1.0), 2.2 * dispersion + 0.12 * F.col("_cuts") / F.col("_n") + 0.25 * high)
    stats = stats.withColumn("heterogeneity", spread)
    unsure = 0.55 * F.col("heterogeneity") + 0.30 * F.col("_absolute") + 0.15 / F.sqrt("_n")
    return stats.select(
        *(risk.columns if each else by), F.col("_n").alias("observations"), "heterogeneity", F.least(F.lit(1.0), unsure).alias("uncertainty")
    )


def adaptive_window_count(
    duration: Column | str, uncertainty: Column | str, heterogeneity: Column | str, profile: Profile = policy.BALANCE
) -> Column:
    low, high = profile.search_windows
    seconds = F.col(duration) if isinstance(duration, str) else duration
    unsure = F.col(uncertainty) if isinstance(uncertainty, str) else uncertainty
    mixed = F.col(heterogeneity) if isinstance(heterogeneity, str) else heterogeneity
    length = F.least(F.lit(1.0), F.log1p(seconds / 600.0) / F.log1p(F.lit(18.0)))
    extra = F.bround((high - low) * (0.30 * length + 0.45 * unsure + 0.25 * mixed), 0).cast("int")
    return F.least(F.lit(high), F.lit(low) + F.greatest(F.lit(0), extra))


def coverage_top1(
    risk: DataFrame, by: Sequence[str], bins: Column, duration: Column, *, window: str = "window_id"
) -> DataFrame:
    """Hardest observation of each equal timeline bin.

    Ties: nearest to the bin's middle, then start, then id. A min_by, so each
    bin shrinks to one row per task before anything is shuffled.
    """
    by = list(by)
    rows = risk.withColumn("_bins", bins.cast("double")).withColumn("_len", duration.cast("double"))
    rows = rows.withColumn("_center", F.col("start_sec") + F.col("duration_sec") / 2.0)
    slot = F.least(F.floor(F.col("_center") * F.col("_bins") / F.col("_len")).cast("int"), F.col("_bins").cast("int") - 1)
    rows = rows.withColumn("bin", slot).filter((F.col("_center") >= 0) & (F.col("_center") <= F.col("_len")))
    middle = F.when(
        F.col("_bins") > 1,
        (F.col("_len") * F.col("bin") / F.col("_bins") + F.col("_len") * (F.col("bin") + 1) / F.col("_bins")) / 2.0,
    ).otherwise(F.col("_len") * 0.25)
    order = F.struct((-F.col("difficulty")).alias("d"), F.abs(F.col("_center") - middle).alias("m"), "start_sec", window)
    return (
        rows.groupBy(*by, "bin")
        .agg(F.min_by(F.struct(window, "start_sec", "difficulty"), order).alias("_r"))
        .select(*by, "bin", "_r.*")
    )
