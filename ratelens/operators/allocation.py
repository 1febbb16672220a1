"""Splitting a title's byte budget over its shots.

Per-shot frontiers are merged pairwise in a tree: neighbours are summed and
pruned, so a title of n shots needs ceil(log2 n) rounds and its shots are spread
over all tasks. Before that, a price of quality is found for all titles at once by
aggregation (a Lagrangian multiplier), which gives each title a lower bound and a
solution. A state's *regret* is what it costs, at that price, above the best its
shots could do. Regrets add up, and a state whose regret exceeds the distance of
solution and bound is in no better solution, so the merged frontiers stay small.
Large neighbours meet in pieces, and frontiers are cut by ranges of size, so no
task holds a title. Every round is written out. Choices are kept as back pointers
and resolved by walking the written rounds down again, so no row ever carries the
choices of a whole title.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens import policy
from ratelens.plans.ordered import ordered, value_chunk
from ratelens.session import cut, spill

#: Means this close below a target reach it: sums of doubles differ by their order.
MEAN_SLACK = 1e-9
#: Prices tried per pass, and passes, each between two neighbouring prices of the one before.
PRICES = 16
PRICE_PASSES = 2
#: States of one shot range that meet those of its neighbour in one key.
STATES_PER_PIECE = 1024

def pareto(
    candidates: DataFrame,
    by: Sequence[str],
    target: Column,
    *,
    cost: str = "bytes",
    gain: str = "mean_vmaf",
    worst: str | None = "worst_1s_vmaf",
    tie: str = "cand_id",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Candidates above the local floors whose gain beats everything cheaper.

    Of several candidates with one cost only the best can be on the frontier, so
    they are reduced to it map-side before anything is ordered.
    """
    by = list(by)
    zero = F.lit(0.0)
    ok = F.col(gain) >= F.greatest(zero, target - policy.SHOT_MEAN_FLOOR_DROP)
    if worst is not None:
        ok = ok & (F.col(worst) >= F.greatest(zero, target - policy.SHOT_WORST_FLOOR_DROP))
    keys = [*by, cost]
    entry = F.struct(*[F.col(c) for c in candidates.columns if c not in keys])
    rank = F.struct((-F.col(gain)).alias("g"), F.col(tie).alias("t"))
    rows = candidates.filter(ok).groupBy(*keys).agg(F.min_by(entry, rank).alias("_e")).select(*keys, "_e.*")
    rows = value_chunk(rows, by, cost, rows_per_chunk=rows_per_chunk)
    rows = ordered(rows, by, [cost], running={"_best": ("max", F.col(gain))})
    kept = rows.filter(F.col("_best").isNull() | (F.col(gain) > F.col("_best")))
    return kept.select(*candidates.columns)


def _frontier(states: DataFrame, limit: int) -> DataFrame:
    """Prune each (title, slot) to its frontier, and bin that to ``limit`` states or so.

    Of several states with one size only the best can be on the frontier, so they
    are reduced to it map-side before anything is ordered. Along the frontier
    quality rises with bytes; the first state of a quality bin is therefore its
    cheapest.
    """
    keys = ["title_id", "slot"]
    entry = F.struct(*[F.col(c) for c in states.columns if c not in (*keys, "size")])
    rank = F.struct((-F.col("quality")).alias("q"), F.coalesce("left_id", F.lit(-1)).alias("l"), F.coalesce("right_id", F.lit(-1)).alias("r"))
    best_of_size = F.min_by(entry, rank).alias("_e")
    spread = F.max("approximate").alias("_a")
    states = states.groupBy(*keys, "size").agg(best_of_size, spread).select(*keys, "size", "_e.*", "_a").drop("approximate").withColumnRenamed("_a", "approximate")
    by_size = Window.partitionBy(*keys).orderBy("size", F.desc("quality"), "left_id", "right_id")
    whole = Window.partitionBy(*keys)
    best = F.max("quality").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    front = states.withColumn("_best", best).filter(F.col("_best").isNull() | (F.col("quality") > F.col("_best")))
    front = front.select(
        "*",
        F.count(F.lit(1)).over(whole).alias("_n"),
        F.min("quality").over(whole).alias("_lo"),
        F.max("quality").over(whole).alias("_hi"),
        F.max(F.col("approximate")).over(whole).alias("_approx"),
    )
    place = F.floor((F.col("quality") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * (limit - 2))
    front = front.withColumn("_bin", F.least(F.lit(limit - 2), F.coalesce(place, F.lit(0))))
    front = front.withColumn("_prev", F.lag("_bin").over(by_size))
    first_of_bin = F.col("_prev").isNull() | (F.col("_bin") != F.col("_prev"))
    kept = front.filter((F.col("_n") <= limit) | first_of_bin | (F.col("quality") == F.col("_hi")))
    return kept.select(
        *keys, F.row_number().over(by_size).alias("state_id"), "size", "quality", "left_id", "right_id",
        (F.col("_approx") | (F.col("_n") > limit)).alias("approximate"), "budget", "slots",
    )


def _merge(level: DataFrame, limit: int) -> DataFrame:
    """Sum neighbouring slots. The last slot of an odd level passes through."""
    lone = (F.col("slot") % 2 == 0) & (F.col("slot") == F.col("slots") - 1)
    parent = F.floor(F.col("slot") / 2).cast("long")
    half = F.ceil(F.col("slots") / 2).cast("long")
    paired = level.filter(~lone).withColumn("_p", parent)
    left = paired.filter("slot % 2 = 0")
    right = paired.filter("slot % 2 = 1").select(
        "title_id", "_p", F.col("size").alias("_size"), F.col("quality").alias("_quality"), F.col("state_id").alias("_id"),
        F.col("approximate").alias("_approx"),
    )
    sums = left.join(right, ["title_id", "_p"]).select(
        "title_id", F.col("_p").alias("slot"), (F.col("size") + F.col("_size")).alias("size"),
        (F.col("quality") + F.col("_quality")).alias("quality"), F.col("state_id").alias("left_id"), F.col("_id").alias("right_id"),
        (F.col("approximate") | F.col("_approx")).alias("approximate"), "budget", half.alias("slots"),
    )
    sums = sums.filter(F.col("budget").isNull() | (F.col("size") <= F.col("budget")))
    alone = level.filter(lone).select(
        "title_id", parent.alias("slot"), "size", "quality", F.col("state_id").alias("left_id"), F.lit(None).cast("int").alias("right_id"),
        "approximate", "budget", half.alias("slots"),
    )
    return _frontier(sums.unionByName(alone), limit)


def _thinned(leaves: DataFrame, limit: int) -> DataFrame:
    """Bin the frontier of shots with more than ``limit`` candidates by aggregation.

    One shot may have any number of candidates; no window sees them all. Each
    quality bin keeps its cheapest state, and the best state is kept as well.
    """
    keys = ["title_id", "slot"]
    stats = leaves.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("quality").alias("_lo"), F.max("quality").alias("_hi")
    ).filter(F.col("_n") > limit)
    rows = leaves.join(stats, keys, "left")
    big = F.col("_n").isNotNull()
    small = rows.filter(~big).select(*leaves.columns)
    place = F.floor((F.col("quality") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * (limit - 2))
    bins = F.when(F.col("quality") == F.col("_hi"), F.lit(limit)).otherwise(F.coalesce(place, F.lit(0)))
    entry = F.struct(*[F.col(c) for c in leaves.columns if c not in keys])
    kept = rows.filter(big).groupBy(*keys, bins.alias("_bin")).agg(F.min_by(entry, F.struct("size", (-F.col("quality")).alias("q"))).alias("_e"))
    kept = kept.select(*keys, "_e.*").withColumn("approximate", F.lit(True))
    return small.unionByName(kept)


def _slots(shots: DataFrame, rows_per_chunk: int | None) -> DataFrame:
    """Dense 0-based slot of every (title, shot) and the title's shot count and frames."""
    once = shots.groupBy("title_id", "shot_idx").agg(F.max("frames").cast("long").alias("frames"))
    sizes = once.groupBy("title_id").agg(F.count(F.lit(1)).alias("slots"), F.sum("frames").alias("total_frames"))
    rows = value_chunk(once, ["title_id"], "shot_idx", rows_per_chunk=rows_per_chunk)
    rows = ordered(rows, ["title_id"], ["shot_idx"], running={"slot": ("sum", F.lit(1).cast("long"))})
    return rows.select("title_id", "shot_idx", "frames", "slot").join(sizes, "title_id")


def _binned_levels(candidates: DataFrame, titles: DataFrame, limit: int, rows_per_chunk: int | None, deepest: int) -> list[DataFrame]:
    """All merge levels, leaves first; the last one has one slot per title.

    ``candidates`` carry slot, slots, frames; ``titles`` target and budget;
    ``deepest`` is the largest shot count of a title.
    """
    if limit < 3:
        raise ValueError("state_limit must be at least 3")
    rows = candidates.join(titles.select("title_id", "target", "budget"), "title_id")
    front = pareto(rows, ["title_id", "slot"], F.col("target"), rows_per_chunk=rows_per_chunk)
    leaves = front.filter(F.col("budget").isNull() | (F.col("bytes") <= F.col("budget"))).select(
        "title_id", "slot", F.col("bytes").cast("long").alias("size"), (F.col("mean_vmaf") * F.col("frames")).alias("quality"),
        F.col("cand_id").cast("int").alias("left_id"), F.lit(None).cast("int").alias("right_id"),
        F.lit(False).alias("approximate"), F.col("budget").cast("long").alias("budget"), F.col("slots").cast("long").alias("slots"),
    )
    levels = [cut(_frontier(_thinned(leaves, limit), limit))]
    while deepest > 1:
        levels.append(cut(_merge(levels[-1], limit)))
        deepest = (deepest + 1) // 2
    return levels


def _prices(leaves: DataFrame, goals: DataFrame, maximize: bool) -> DataFrame:
    """(title_id, price, slack, known_size, known_quality, most_quality): bounds of every title that has a solution.

    ``leaves``: title_id, slot, size, quality; ``goals``: title_id, slots, goal, budget.
    At a price p every shot has a cheapest candidate by size - p * quality; their
    sums are c(p), b(p), q(p), all aggregations. Any p bounds the optimum: no
    selection with quality of ``goal`` has less than c(p) + p * goal bytes, and none
    within ``budget`` has more quality than (budget - c(p)) / p. Quality and bytes
    rise with the price, so each pass tries prices between the last one that falls
    short and the first one that does not. ``slack`` is the largest regret of a
    selection that is not worse than the best one seen.
    """
    shot = leaves.groupBy("title_id", "slot").agg(
        F.min("size").alias("b0"), F.max_by("quality", F.struct((-F.col("size")).alias("s"), "quality")).alias("q0"),
        F.max_by("size", F.struct("quality", (-F.col("size")).alias("s"))).alias("b1"), F.max("quality").alias("q1"),
    )
    whole = shot.groupBy("title_id").agg(F.count("*").alias("present"), *[F.sum(c).alias(c) for c in ("b0", "q0", "b1", "q1")])
    open_ = goals.join(whole, "title_id").where("present = slots AND (budget IS NULL OR b0 <= budget)")
    if maximize:
        # More bytes than the best selection has are of no use.
        open_ = open_.withColumn("budget", F.least("budget", "b1"))
        reached, known = F.col("b") <= F.col("budget"), [F.col("b0"), F.col("q0")]
    else:
        open_ = open_.where(F.col("q1") >= F.col("goal"))
        reached = F.col("q") >= F.col("goal") * (1 + MEAN_SLACK)
        cheap = F.col("q0") >= F.col("goal") * (1 + MEAN_SLACK)
        known = [F.when(cheap, F.col("b0")).otherwise(F.col("b1")), F.when(cheap, F.col("q0")).otherwise(F.col("q1"))]
    slope = F.coalesce((F.col("b1") - F.col("b0")) / F.nullif(F.col("q1") - F.col("q0"), F.lit(0.0)), F.lit(0.0))
    spread = F.transform(F.sequence(F.lit(0), F.lit(PRICES)), lambda i: slope * F.pow(F.lit(4.0), i - PRICES // 2))
    now = spill(open_.select(
        "title_id", "goal", "budget", F.col("q1").alias("most_quality"), F.array_union(F.array(F.lit(0.0)), spread).alias("prices"),
        known[0].cast("long").alias("known_size"), known[1].alias("known_quality"),
        F.lit(0.0).alias("price"), F.col("b0").cast("double").alias("cost"),
        (F.col("q1") if maximize else F.col("b0").cast("double")).alias("bound"),
    ))
    for _ in range(PRICE_PASSES):
        tried = leaves.join(now.select("title_id", F.explode("prices").alias("p")), "title_id")
        entry = F.struct((F.col("size") - F.col("p") * F.col("quality")).alias("c"), (-F.col("quality")).alias("nq"), F.col("size").alias("b"))
        picked = tried.groupBy("title_id", "slot", "p").agg(F.min(entry).alias("m"))
        sums = picked.groupBy("title_id", "p").agg(F.sum("m.c").alias("c"), F.sum("m.b").alias("b"), (-F.sum("m.nq")).alias("q"))
        rows = sums.join(now.select("title_id", "goal", "budget"), "title_id").withColumn("ok", reached)
        value = (F.col("budget") - F.col("c")) / F.nullif(F.col("p"), F.lit(0.0)) if maximize else F.col("c") + F.col("p") * F.col("goal")
        found = F.struct(value.alias("v"), F.col("p").alias("price"), F.col("c").alias("cost"))
        found = F.when(value.isNotNull(), found)
        best = F.struct(F.col("b").alias("b"), F.col("q").alias("q"))
        seen = rows.groupBy("title_id").agg(
            (F.min(found) if maximize else F.max(found)).alias("dual"),
            (F.max_by(best, F.when(F.col("ok"), F.col("q"))) if maximize else F.min_by(best, F.when(F.col("ok"), F.col("b")))).alias("best"),
            F.max(F.when(F.col("ok") == F.lit(maximize), F.col("p"))).alias("low"),
            F.min(F.when(F.col("ok") != F.lit(maximize), F.col("p"))).alias("high"),
        )
        both = now.join(seen, "title_id")
        better = F.col("dual.v") < F.col("bound") if maximize else F.col("dual.v") > F.col("bound")
        nearer = F.col("best.q") > F.col("known_quality") if maximize else F.col("best.b") < F.col("known_size")
        low, high = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.col("low") * 4, F.lit(0.0))
        between = F.transform(
            F.sequence(F.lit(0), F.lit(PRICES)),
            lambda i: F.when(low > 0, low * F.pow(high / F.nullif(low, F.lit(0.0)), i / PRICES)).otherwise(high * i / PRICES),
        )
        now = spill(both.select(
            "title_id", "goal", "budget", "most_quality", F.array_distinct(between).alias("prices"),
            *[F.when(nearer, F.col(f"best.{c}")).otherwise(F.col(n)).alias(n) for c, n in (("b", "known_size"), ("q", "known_quality"))],
            *[F.when(better, F.col(f"dual.{c}")).otherwise(F.col(n)).alias(n) for c, n in (("price", "price"), ("cost", "cost"), ("v", "bound"))],
        ))
    if maximize:
        slack = F.col("budget") - F.col("price") * F.col("known_quality") - F.col("cost")
        most = F.least("bound", "most_quality")
    else:
        slack = F.least("known_size", "budget") - F.col("price") * F.col("goal") - F.col("cost")
        most = F.col("most_quality")
    # What sums of doubles may be off by, in bytes.
    slack = slack + 1e-6 * (1 + F.abs("cost") + F.col("price") * F.col("known_quality"))
    return now.select("title_id", "price", slack.alias("slack"), "known_size", "known_quality", most.alias("most_quality"))


def _skyline(states: DataFrame, rows_per_chunk: int | None) -> DataFrame:
    """States of each (title, slot) that have more quality than all smaller ones; of one size, the best.

    Sizes are distinct afterwards and serve as the states' ids.
    """
    keys = ["title_id", "slot", "size"]
    entry = F.struct(*[F.col(c) for c in states.columns if c not in keys])
    rank = F.struct((-F.col("quality")).alias("q"), "left_id", "right_id")
    rows = states.groupBy(*keys).agg(F.min_by(entry, rank).alias("_e")).select(*keys, "_e.*")
    rows = value_chunk(rows, keys[:2], "size", rows_per_chunk=rows_per_chunk)
    rows = ordered(rows, keys[:2], ["size"], running={"_best": ("max", F.col("quality"))})
    kept = rows.filter(F.col("_best").isNull() | (F.col("quality") > F.col("_best")))
    return spill(kept.select(*states.columns, F.col("size").alias("state_id")))


def _neighbours(level: DataFrame, pieces_of: int) -> DataFrame:
    """Sums of neighbouring slots' states that may still be in an optimum.

    Both sides are dealt into pieces of ``pieces_of`` states or so, and every piece
    of one side meets every piece of the other under a key of its own. The last
    slot of an odd level passes through.
    """
    lone = (F.col("slot") % 2 == 0) & (F.col("slot") == F.col("slots") - 1)
    parent, half = F.floor(F.col("slot") / 2).cast("long"), F.ceil(F.col("slots") / 2).cast("long")
    paired = level.filter(~lone).withColumn("_p", parent)
    pieces = paired.groupBy("title_id", "_p", (F.col("slot") % 2).alias("side")).agg(F.ceil(F.count("*") / pieces_of).cast("int").alias("n"))
    pieces = pieces.groupBy("title_id", "_p").agg(
        F.max(F.when(F.col("side") == 0, F.col("n"))).alias("_l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("_r")
    ).where("_l IS NOT NULL AND _r IS NOT NULL")
    dealt = paired.join(pieces, ["title_id", "_p"])
    piece = F.pmod(F.xxhash64("size"), F.when(F.col("slot") % 2 == 0, F.col("_l")).otherwise(F.col("_r"))).cast("int")
    dealt = dealt.withColumn("_own", piece)
    left = dealt.filter("slot % 2 = 0").withColumn("_j", F.explode(F.expr("sequence(0, _r - 1)"))).withColumnRenamed("_own", "_i")
    right = dealt.filter("slot % 2 = 1").withColumn("_i", F.explode(F.expr("sequence(0, _l - 1)"))).select(
        "title_id", "_p", "_i", F.col("_own").alias("_j"), F.col("size").alias("_size"), F.col("quality").alias("_quality"), F.col("regret").alias("_regret")
    )
    sums = left.join(right, ["title_id", "_p", "_i", "_j"]).where("regret + _regret <= slack").select(
        "title_id", F.col("_p").alias("slot"), (F.col("size") + F.col("_size")).alias("size"), (F.col("quality") + F.col("_quality")).alias("quality"),
        (F.col("regret") + F.col("_regret")).alias("regret"), F.col("size").alias("left_id"), F.col("_size").alias("right_id"), "slack", half.alias("slots"),
    )
    alone = level.filter(lone).select(
        "title_id", parent.alias("slot"), "size", "quality", "regret", F.col("size").alias("left_id"), F.lit(None).cast("long").alias("right_id"),
        "slack", half.alias("slots"),
    )
    return sums.unionByName(alone)


def _leaves(rows: DataFrame, target: Column, rows_per_chunk: int | None) -> DataFrame:
    front = pareto(rows, ["title_id", "slot"], target, rows_per_chunk=rows_per_chunk)
    return spill(front.select(
        "title_id", "slot", F.col("bytes").cast("long").alias("size"), (F.col("mean_vmaf") * F.col("frames")).alias("quality"),
        F.col("cand_id").cast("long").alias("left_id"), F.lit(None).cast("long").alias("right_id"), F.col("slots").cast("long").alias("slots"),
    ))


def _exact_levels(leaves: DataFrame, bounds: DataFrame, deepest: int, rows_per_chunk: int | None) -> list[DataFrame]:
    """All merge levels, leaves first, of the titles in ``bounds``."""
    priced = leaves.join(bounds.select("title_id", "price", "slack"), "title_id").withColumn("_c", F.col("size") - F.col("price") * F.col("quality"))
    least = priced.groupBy("title_id", "slot").agg(F.min("_c").alias("_least"))
    states = priced.join(least, ["title_id", "slot"]).withColumn("regret", F.col("_c") - F.col("_least")).where("regret <= slack")
    columns = ["title_id", "slot", "size", "quality", "regret", "left_id", "right_id", "slack", "slots"]
    # What is left of a frontier still is one.
    levels = [spill(states.select(*columns, F.col("size").alias("state_id")))]
    while deepest > 1:
        levels.append(_skyline(_neighbours(levels[-1], STATES_PER_PIECE), rows_per_chunk))
        deepest = (deepest + 1) // 2
    return levels


def _best_root(root: DataFrame, titles: DataFrame, frames: DataFrame, maximize: bool) -> DataFrame:
    """(title_id, state_id, size, mean_vmaf, approximate) of the titles with a solution."""
    rows = root.filter("slots = 1").join(titles.select("title_id", "target", "budget"), "title_id").join(frames, "title_id")
    mean = F.col("quality") / F.col("total_frames")
    entry = F.struct("state_id", "size", mean.alias("mean_vmaf"), F.lit(False).alias("approximate"))
    rows = rows.where("budget IS NULL OR size <= budget")
    if maximize:
        best = F.max_by(entry, F.struct("quality", (-F.col("size")).alias("s")))
    else:
        best = F.min_by(entry, F.when(mean >= F.col("target") - MEAN_SLACK, F.col("size")))
    return rows.groupBy("title_id").agg(best.alias("_b")).filter("_b IS NOT NULL").select("title_id", "_b.*")


def _goals(titles: DataFrame, slots: DataFrame) -> DataFrame:
    sizes = slots.select("title_id", "slots", "total_frames").distinct()
    goal = (F.col("target") - MEAN_SLACK) * F.col("total_frames")
    return titles.join(sizes, "title_id").select("title_id", "slots", goal.alias("goal"), F.col("budget").cast("long").alias("budget"))


def _choose(root: DataFrame, titles: DataFrame, frames: DataFrame, maximize_quality: bool) -> DataFrame:
    rows = root.filter("slots = 1").join(titles.select("title_id", "target"), "title_id").join(frames, "title_id")
    mean = F.col("quality") / F.col("total_frames")
    entry = F.struct("state_id", "size", mean.alias("mean_vmaf"), "approximate")
    if maximize_quality:
        best = F.max_by(entry, F.struct(F.col("quality"), (-F.col("size")).alias("s")))
    else:
        best = F.min_by(entry, F.when(mean >= F.col("target"), F.struct("size", (-F.col("quality")).alias("q"))))
    return rows.groupBy("title_id").agg(best.alias("_b")).filter("_b IS NOT NULL").select("title_id", "_b.*")


def allocate_budget(
    candidates: DataFrame,
    titles: DataFrame,
    *,
    state_limit: int | None = None,
    maximize_quality: bool = False,
    rows_per_chunk: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(allocations, picks): one candidate per shot with the fewest bytes that reach the title's target.

    ``candidates``: ``title_id, shot_idx, cand_id, frames, mean_vmaf,
    worst_1s_vmaf, bytes``. ``titles``: ``title_id, target, budget`` (NULL = no
    limit). Titles without a feasible combination have no row. With
    ``maximize_quality`` the best quality within the budget is chosen instead.
    A mean within ``MEAN_SLACK`` of the target reaches it. Of equal sizes the better
    quality is chosen, of equal qualities the smaller size.
    Results are exact unless a ``state_limit`` is given (``policy.STATE_LIMITS``
    has the profiles' values). ``approximate`` then tells that some frontier was
    longer and was binned; the result is feasible but maybe not the smallest.
    """
    slots = cut(_slots(candidates, rows_per_chunk))
    rows = candidates.drop("frames").join(slots.select("title_id", "shot_idx", "slot", "slots", "frames"), ["title_id", "shot_idx"])
    frames = slots.select("title_id", "total_frames").distinct()
    if state_limit is None:
        rows = rows.join(titles.select("title_id", "target"), "title_id")
        leaves = _leaves(rows, F.col("target"), rows_per_chunk)
        bounds = cut(_prices(leaves, _goals(titles, slots), maximize_quality))
        levels = _exact_levels(leaves, bounds, _depth(slots), rows_per_chunk)
        chosen = cut(_best_root(levels[-1], titles, frames, maximize_quality))
    else:
        levels = _binned_levels(rows, titles, state_limit, rows_per_chunk, _depth(slots))
        chosen = cut(_choose(levels[-1], titles, frames, maximize_quality))
    out = chosen.select(
        "title_id", F.col("size").alias("video_bytes"), "mean_vmaf", "approximate"
    )
    picks = _trace(levels, chosen, slots)
    return out, picks.withColumn("cand_id", F.col("cand_id").cast(candidates.schema["cand_id"].dataType))


def _depth(slots: DataFrame) -> int:
    return slots.agg(F.max("slots")).first()[0] or 1


def _trace(levels: list[DataFrame], chosen: DataFrame, slots: DataFrame) -> DataFrame:
    at = chosen.select("title_id", F.lit(0).cast("long").alias("slot"), "state_id")
    for level in reversed(levels[1:]):
        hit = at.join(level.select("title_id", "slot", "state_id", "left_id", "right_id"), ["title_id", "slot", "state_id"])
        children = F.array(
            F.struct((F.col("slot") * 2).alias("slot"), F.col("left_id").alias("state_id")),
            F.struct((F.col("slot") * 2 + 1).alias("slot"), F.col("right_id").alias("state_id")),
        )
        at = hit.select("title_id", F.inline(children)).filter(F.col("state_id").isNotNull())
    leaves = levels[0].select("title_id", "slot", "state_id", F.col("left_id").alias("cand_id"))
    picked = at.join(leaves, ["title_id", "slot", "state_id"])
    return picked.join(slots.select("title_id", "slot", "shot_idx"), ["title_id", "slot"]).select("title_id", "shot_idx", "cand_id")


def _highest_step(passes, guess: Column) -> Column:
    """The highest whole number around ``guess`` for which ``passes`` holds; null if none."""
    near = F.floor(guess).cast("int")
    return F.array_max(F.filter(F.array(*[near + d for d in (-2, -1, 0, 1)]), lambda k: (k >= 0) & passes(k)))


def _step_of_mean(mean: Column, target: Column, top: Column) -> Column:
    """The highest step that a mean reaches: ``top`` is the title's own target, k below it the target k / 10."""
    grid = _highest_step(lambda k: mean >= k / 10 - MEAN_SLACK, mean * 10)
    return F.when(mean >= target - MEAN_SLACK, top).otherwise(F.least(grid, top - 1))


def relax_target(candidates: DataFrame, titles: DataFrame, *, rows_per_chunk: int | None = None) -> DataFrame:
    """(title_id, failure_kind, required_ratio, relaxed_target) of the titles that do not fit.

    ``titles``: ``title_id, target, budget, audio_bytes, max_output_bytes,
    source_bytes``. ``required_ratio`` says how large the output would be,
    ``relaxed_target`` is the highest target on a 0.1 grid below the title's own
    that fits the budget; both are null if no combination reaches the target.
    Titles that fit have no row, nor have titles without candidates.

    A target asks for a mean and sets floors. Each candidate has a highest step of
    the grid whose floors it meets, its *cap*, and a selection reaches the lower one
    of its least cap and its mean's step. So every distinct cap of a title is one
    problem, the best mean of candidates with that cap or more within the budget,
    and all of them are bounded at once (see ``_prices``). Only caps that may beat
    the best selection already seen are merged, all in one tree; no target is
    searched for. A title has as many caps as steps below its target at most.
    """
    slots = cut(_slots(candidates, rows_per_chunk))
    depth = _depth(slots)
    rows = cut(candidates.drop("frames").join(slots.select("title_id", "shot_idx", "slot", "slots", "frames"), ["title_id", "shot_idx"]))
    frames = cut(slots.select("title_id", "total_frames").distinct())
    known = cut(titles.join(frames, "title_id").withColumn("top", F.ceil(F.col("target") * 10).cast("int")))

    free = known.select("title_id", "target", F.lit(None).cast("long").alias("budget"))
    leaves = _leaves(rows.join(free.select("title_id", "target"), "title_id"), F.col("target"), rows_per_chunk)
    levels = _exact_levels(leaves, cut(_prices(leaves, _goals(free, slots), False)), depth, rows_per_chunk)
    required = cut(_best_root(levels[-1], free, frames, False).select("title_id", F.col("size").alias("_need")))
    open_ = cut(known.join(required, "title_id", "left").where("_need IS NULL OR _need > budget"))

    blocked = open_.where("_need IS NOT NULL").select("title_id", "target", "top", "budget", "total_frames")
    ranked = rows.join(blocked, "title_id").where("mean_vmaf >= 0 AND worst_1s_vmaf >= 0")
    drops = (policy.SHOT_MEAN_FLOOR_DROP, policy.SHOT_WORST_FLOOR_DROP)

    def meets(target: Column) -> Column:
        return (F.col("mean_vmaf") >= target - drops[0]) & (F.col("worst_1s_vmaf") >= target - drops[1])

    guess = F.least((F.col("mean_vmaf") + drops[0]) * 10, (F.col("worst_1s_vmaf") + drops[1]) * 10, F.col("top").cast("double"))
    cap = F.when(meets(F.col("target")), F.col("top")).otherwise(F.least(_highest_step(lambda k: meets(k / 10), guess), F.col("top") - 1))
    ranked = cut(ranked.withColumn("cap", cap).where("cap IS NOT NULL"))
    # No selection has a higher cap than the least of its shots' highest caps.
    most = ranked.groupBy("title_id", "slot").agg(F.max("cap").alias("m")).groupBy("title_id").agg(F.min("m").alias("most"))
    caps = ranked.select("title_id", F.col("cap").alias("step")).distinct().join(most, "title_id").where("step <= most")
    key = F.struct("title_id", "step").alias("title_id")
    part = ranked.join(caps.select("title_id", "step"), "title_id").where("cap >= step")
    part = part.select(key, *[F.col(c) for c in rows.columns if c != "title_id"])
    leaves = _leaves(part, F.lit(float("-inf")), rows_per_chunk)
    sizes = slots.select("title_id", "slots").distinct()
    asked = cut(caps.join(blocked, "title_id").join(sizes, "title_id").select(
        key, "slots", "target", "top", "total_frames", F.lit(0.0).alias("goal"), F.col("budget").cast("long").alias("budget")
    ))
    bounds = _prices(leaves, asked.select("title_id", "slots", "goal", "budget"), True).join(asked.drop("slots", "goal"), "title_id")

    def reached(quality: Column) -> Column:
        step = _step_of_mean(quality / F.col("total_frames"), F.col("target"), F.col("top"))
        return F.least(step, F.col("title_id.step"))

    bounds = bounds.withColumn("seen", reached(F.col("known_quality"))).withColumn("able", reached(F.col("most_quality") * (1 + MEAN_SLACK)))
    bounds = cut(bounds.withColumn("seen", F.coalesce("seen", F.lit(-1))))
    seen = cut(bounds.groupBy(F.col("title_id.title_id").alias("title_id")).agg(F.max("seen").alias("seen")))
    doubtful = cut(bounds.drop("seen").withColumn("_t", F.col("title_id.title_id")).join(seen.withColumnRenamed("title_id", "_t"), "_t").where("able > seen").drop("_t", "seen"))
    root = _exact_levels(leaves, doubtful, depth, rows_per_chunk)[-1].filter("slots = 1")
    root = root.join(doubtful.select("title_id", "target", "top", "total_frames", "budget"), "title_id").where("size <= budget")
    merged = root.select(F.col("title_id.title_id").alias("title_id"), reached(F.col("quality")).alias("seen"))
    steps = seen.unionByName(merged).groupBy("title_id").agg(F.max("seen").alias("step"))
    found = steps.select("title_id", F.when(F.col("step") >= 0, F.col("step") / 10).alias("relaxed_target"))
    out = open_.join(found, "title_id", "left")
    full = F.ceil((F.col("_need") + F.col("audio_bytes")) / policy.CONTAINER_FACTOR) / F.col("source_bytes")
    ratio = F.when(F.col("_need").isNotNull(), F.greatest(F.col("max_output_bytes") / F.col("source_bytes"), full))
    kind = F.when(F.col("_need").isNotNull(), "size_blocked").when(F.col("budget") <= 0, "media_budget_too_small").otherwise("quality_unreachable")
    return out.select("title_id", kind.alias("failure_kind"), ratio.alias("required_ratio"), "relaxed_target")
