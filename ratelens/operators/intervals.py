"""Intervals on a source's timeline: shots, overlaps, gaps, alignment, capacity.

A source may hold a large share of all intervals. Ordered steps run per
(source, chunk of the timeline); overlap joins meet per (source, node of a dyadic
timeline).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ratelens.plans.ordered import CHUNK, FRAMES_PER_CHUNK, frame_chunks, ordered, value_chunk
from ratelens.policy import SCENE_CHANGE_THRESHOLD, WINDOW_EPSILON
from ratelens.session import cut


def shots_from_cuts(
    frames: DataFrame,
    by: Sequence[str],
    *,
    frame: str = "frame_no",
    score: str = "scd_score",
    threshold: float = SCENE_CHANGE_THRESHOLD,
    frames_per_chunk: int = FRAMES_PER_CHUNK,
) -> DataFrame:
    """Shots ``[start_frame, end_frame)`` per clip; a cut frame other than 0 opens a new one.

    Only the cut frames are ordered: each shot ends where the next one starts.
    """
    by = list(by)
    ends = frames.groupBy(*by).agg((F.max(frame) + 1).alias("_end"))
    starts = frames.filter((F.col(frame) > 0) & (F.col(score) >= threshold)).select(*by, F.col(frame).alias("start_frame"))
    starts = starts.unionByName(ends.select(*by, F.lit(0).cast("long").alias("start_frame")))
    starts = frame_chunks(starts, "start_frame", frames_per_chunk=frames_per_chunk)
    shots = ordered(starts, by, ["start_frame"], after={"_next": "start_frame"})
    return shots.join(ends, by).select(*by, "start_frame", F.coalesce("_next", "_end").alias("end_frame"))


#: Powers of two that an interval's node may be long: about a microsecond to ten thousand years, in seconds.
LEVELS = (-20, 38)


def _node(at: Column, level: Column) -> Column:
    """Which stretch of 2^level seconds a time lies in."""
    return F.floor(at / F.pow(F.lit(2.0), level)).cast("long")


def _starts_within(points: DataFrame, spans: DataFrame, by: list[str], point: str, span: str, duration: str) -> DataFrame:
    """Pairs in which ``point`` of the one side may lie in the interval (``span``, ``duration``) of the other, each pair once.

    An interval lies in three or four nodes of its own level at most, that of its
    length; a point lies in one node of every level that intervals have.
    """
    low, high = LEVELS
    level = F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.log2(duration)))).cast("int")
    spans = spans.filter(F.col(duration) > 0).withColumn("_level", level)
    levels = [r["_level"] for r in spans.select("_level").distinct().collect()]  # as many as LEVELS has at most
    end = F.col(span) + F.col(duration)
    spans = spans.withColumn("_node", F.explode(F.sequence(_node(F.col(span), F.col("_level")), _node(end, F.col("_level")))))
    points = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    points = points.withColumn("_node", _node(F.col(point), F.col("_level")))
    return points.join(spans, [*by, "_level", "_node"]).drop("_level", "_node")


def interval_overlaps(
    a: DataFrame,
    b: DataFrame,
    by: Sequence[str],
    *,
    start: str = "start_sec",
    duration: str = "duration_sec",
    epsilon: float = WINDOW_EPSILON,
) -> DataFrame:
    """Overlapping pairs of two interval sets, columns prefixed ``a_`` and ``b_``.

    Two intervals overlap only if one of them starts in the other, so pairs are
    found as starts in intervals, first those of ``a``, then the later ones of
    ``b``. Both meet by equality per (key, level, node) of a dyadic timeline (see
    :func:`_starts_within`): an interval of any length makes a few rows, however
    dense or long the others are, and most starts in an interval's nodes lie in the
    interval itself. Intervals with a null, or without length, hold no start.
    """
    by = list(by)

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*by, *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in by])

    left, right = side(a, "a"), side(b, "b")
    sa, sb = F.col(f"a_{start}"), F.col(f"b_{start}")
    meets = (sa < sb + F.col(f"b_{duration}") - epsilon) & (sb < sa + F.col(f"a_{duration}") - epsilon)
    inside_b = _starts_within(left, right, by, f"a_{start}", f"b_{start}", f"b_{duration}").filter(meets & (sb <= sa))
    inside_a = _starts_within(right, left, by, f"b_{start}", f"a_{start}", f"a_{duration}").filter(meets & (sb > sa))
    columns = [*by, *[c for c in left.columns if c not in by], *[c for c in right.columns if c not in by]]
    return inside_b.select(*columns).unionByName(inside_a.select(*columns))


def has_self_overlap(
    intervals: DataFrame,
    by: Sequence[str],
    *,
    start: str = "start_sec",
    duration: str = "duration_sec",
    tie: str = "window_id",
    epsilon: float = WINDOW_EPSILON,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Per group: does any interval start before an earlier one has ended? No pairs are built."""
    by = list(by)
    rows = value_chunk(intervals, by, [start, tie], rows_per_chunk=rows_per_chunk)
    end = F.col(start) + F.col(duration)
    rows = ordered(rows, by, [start, tie], running={"_before": ("max", end)})
    return rows.groupBy(*by).agg(
        F.coalesce(F.bool_or(F.col(start) < F.col("_before") - epsilon), F.lit(False)).alias("overlapping")
    )


def largest_gap(
    intervals: DataFrame,
    by: Sequence[str],
    totals: DataFrame,
    *,
    min_length: float,
    start: str = "start_sec",
    duration: str = "duration_sec",
    total: str = "total_sec",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Window of ``min_length`` centred in the widest free gap of each source; NULL if none is wide enough.

    The earliest gap wins a tie. ``totals`` has the keys and the source length.
    """
    by = list(by)
    # The end of the source closes the last gap like one more interval.
    tail = totals.select(*by, F.col(total).cast("double").alias("_s"), F.lit(0.0).alias("_d"), F.lit(1).alias("_tail"))
    rows = intervals.select(*by, F.col(start).alias("_s"), F.col(duration).alias("_d"), F.lit(0).alias("_tail")).unionByName(tail)
    rows = value_chunk(rows, by, ["_s", "_tail", "_d"], rows_per_chunk=rows_per_chunk)
    end = F.when(F.col("_tail") == 0, F.col("_s") + F.col("_d"))
    rows = ordered(rows, by, ["_s", "_tail", "_d"], running={"_before": ("max", end)})
    low = F.greatest(F.lit(0.0), F.coalesce("_before", F.lit(0.0)))
    # Intervals beyond the end of the source may sort after the tail; only gaps inside count for it.
    gap = F.col("_s") - low
    wide = F.when(gap >= min_length, F.struct(gap.alias("gap"), (-low).alias("_neg"), low.alias("low"), F.col("_s").alias("high")))
    best = rows.groupBy(*by).agg(F.max(wide).alias("_w"))
    return best.select(
        *by,
        F.col("_w.gap").alias("gap_sec"),
        ((F.col("_w.low") + F.col("_w.high") - min_length) / 2.0).alias("start_sec"),
        F.when(F.col("_w").isNotNull(), F.lit(float(min_length))).alias("duration_sec"),
    )


def align_to_cuts(
    windows: DataFrame,
    cuts: DataFrame,
    by: Sequence[str],
    *,
    window: str = "window_id",
    total: str = "total_sec",
    cut_time: str = "cut_sec",
    epsilon: float = WINDOW_EPSILON,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Move each window into the nearest shot that can hold it.

    ``windows``: keys, ``window``, ``start_sec``, ``duration_sec``, ``total_sec``
    and ``reasons``. A window no cut crosses stays. A blind holdout (reason
    ``unscouted_validation``) is left alone, unflagged. A ``transition_risk``
    window is only flagged. Where no shot is long enough the window stays, flagged.
    Returns the windows with ``new_start`` and ``crosses_scene_cut``.

    Nearest means the smallest move of the window's centre. Candidates are found
    from both sides: the closest viable shot that ends after the window starts
    and the closest one that starts before it ends, by one ordered pass over
    shots and windows together instead of a join of all windows with all shots.
    """
    by = list(by)
    lengths = windows.groupBy(*by).agg(F.max(total).alias("_total"))
    inside = (
        cuts.select(*by, F.col(cut_time).cast("double").alias("_c"))
        .distinct()
        .join(lengths, by)
        .filter((F.col("_c") > epsilon) & (F.col("_c") < F.col("_total") - epsilon))
    )
    inside = cut(inside)  # used three times below
    seen = windows.filter(~F.array_contains("reasons", "unscouted_validation"))
    crossed = _crossed(seen, inside, by, window, epsilon)
    edges = inside.select(*by, "_c").unionByName(lengths.select(*by, F.lit(0.0).alias("_c")))
    edges = value_chunk(edges, by, "_c", rows_per_chunk=rows_per_chunk)
    shots = (
        ordered(edges, by, ["_c"], after={"_r": "_c"})
        .join(lengths, by)
        .select(*by, F.col("_c").alias("_l"), F.coalesce("_r", "_total").alias("_r"))
    )
    rows = cut(windows.join(crossed, [*by, window], "left").withColumn("_x", F.coalesce("_x", F.lit(False))))
    moving = rows.filter(F.col("_x") & ~F.array_contains("reasons", "transition_risk")).select(
        *by, window, "start_sec", "duration_sec"
    )
    placed = _nearest_shot(moving, shots, by, window, epsilon, rows_per_chunk)
    out = rows.join(placed, [*by, window], "left")
    transition = F.array_contains("reasons", "transition_risk")
    return out.withColumn("new_start", F.when(transition, F.col("start_sec")).otherwise(F.coalesce("_to", "start_sec"))).withColumn(
        "crosses_scene_cut", F.col("_x") & (transition | F.col("_to").isNull())
    ).drop("_x", "_to")


def _crossed(windows: DataFrame, cuts: DataFrame, by: list[str], window: str, epsilon: float) -> DataFrame:
    end = F.col("start_sec") + F.col("duration_sec")
    w = windows.select(*by, window, "start_sec", "duration_sec")
    pairs = _starts_within(cuts.select(*by, "_c"), w, by, "_c", "start_sec", "duration_sec")
    hit = pairs.filter((F.col("start_sec") + epsilon < F.col("_c")) & (F.col("_c") < end - epsilon))
    return hit.groupBy(*by, window).agg(F.lit(True).alias("_x"))


def _nearest_shot(moving: DataFrame, shots: DataFrame, by: list[str], window: str, epsilon: float, rows_per_chunk: int | None) -> DataFrame:
    """Start of each window after the smallest move into a shot at least as long as it.

    The windows of a plan share one duration (the profile's), so "long enough" is
    decided per (group, duration) and the nearest shot on either side is a
    running maximum or minimum over start order.
    """
    durations = moving.select(*by, "duration_sec").distinct()
    viable = durations.join(shots, by).filter(F.col("_r") - F.col("_l") + epsilon >= F.col("duration_sec"))
    keys = [*by, "duration_sec"]
    # A shot holds window starts in [l, r - d]; it lies left or right of a window that crosses its edge.
    spots = viable.select(*keys, F.col("_l").alias("_lo"), (F.col("_r") - F.col("duration_sec")).alias("_hi"))
    lefts = spots.select(*keys, F.col("_hi").alias("_at"), F.lit(0).alias("_q"), F.col("_hi").alias("_left"), F.lit(None).cast("double").alias("_right"), F.lit(None).cast("string").alias("_w"))
    rights = spots.select(*keys, F.col("_lo").alias("_at"), F.lit(2).alias("_q"), F.lit(None).cast("double").alias("_left"), F.col("_lo").alias("_right"), F.lit(None).cast("string").alias("_w"))
    asks = moving.select(*keys, F.col("start_sec").alias("_at"), F.lit(1).alias("_q"), F.lit(None).cast("double").alias("_left"), F.lit(None).cast("double").alias("_right"), F.col(window).cast("string").alias("_w"))
    order = ["_at", "_q", F.coalesce("_w", F.lit(""))]
    line = value_chunk(lefts.unionByName(rights).unionByName(asks), keys, order, rows_per_chunk=rows_per_chunk)
    line = ordered(line, keys, order, running={"_before": ("max", F.col("_left"))})
    back = [F.desc("_at"), F.desc("_q"), F.desc(F.coalesce("_w", F.lit("")))]
    line = ordered(line, keys, back, running={"_after": ("min", F.col("_right"))}, descending=True)
    asked = line.filter(F.col("_q") == 1)
    moved_left, moved_right = F.col("_at") - F.col("_before"), F.col("_after") - F.col("_at")
    target = (
        F.when(F.col("_after").isNull(), F.col("_before"))
        .when(F.col("_before").isNull(), F.col("_after"))
        .when(moved_left <= moved_right, F.col("_before"))
        .otherwise(F.col("_after"))
    )
    named = asked.select(*by, F.col("_w"), target.alias("_to")).filter(F.col("_to").isNotNull())
    kinds = dict(moving.dtypes)
    return named.select(*by, F.col("_w").cast(kinds[window]).alias(window), "_to")


def guard_alignment(
    aligned: DataFrame,
    by: Sequence[str],
    *,
    window: str = "window_id",
    order: Sequence[str] = ("start_sec",),
    total: str = "total_sec",
    bins: str = "coverage_bins",
    epsilon: float = WINDOW_EPSILON,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Take a move back (and flag it) when it leaves its coverage bin or hits another window.

    A moved window must not hit any peer's original place, nor the new place of
    a peer that comes before it in ``order`` and keeps its move. Blind holdouts
    (reason ``unscouted_validation``) are left alone. A run of moved windows that
    overlap each other, a handful, is settled in one row.
    """
    by = list(by)
    number = F.regexp_extract(F.concat_ws(",", "reasons"), r"coverage_bin_([0-9]+)", 1)
    index = F.expr("try_cast(_n AS INT)") - 1
    center = F.col("new_start") + F.col("duration_sec") / 2.0
    rows = aligned.withColumn("_n", number)
    off_bin = F.coalesce(
        (center < index * F.col(total) / F.col(bins)) | (center >= (index + 1) * F.col(total) / F.col(bins)), F.lit(False)
    )
    blind = F.array_contains("reasons", "unscouted_validation")
    rows = cut(rows.withColumn("_off", off_bin & ~blind))
    keep = [*by, F.col(window).alias("id"), F.struct(*order, window).alias("rank")]
    peers = rows.select(*keep, "start_sec", "duration_sec")
    moved = rows.filter(~F.col("_off") & (F.col("new_start") != F.col("start_sec"))).select(
        *keep, F.col("new_start").alias("start_sec"), "duration_sec"
    )

    def meet(other: DataFrame) -> DataFrame:
        return interval_overlaps(moved, other, by, epsilon=epsilon)

    undone = cut(meet(peers).filter("a_id <> b_id").select(*by, F.col("a_id").alias("id")).distinct())
    # Moved windows that meet each other lie in one run of overlaps. Each run is settled front to back.
    end = F.col("start_sec") + F.col("duration_sec")
    line = value_chunk(moved.join(undone, [*by, "id"], "left_anti"), by, ["start_sec", "id"], rows_per_chunk=rows_per_chunk)
    line = ordered(line, by, ["start_sec", "id"], running={"_reach": ("max", end)})
    opens = F.coalesce(F.col("start_sec") >= F.col("_reach") - epsilon, F.lit(True)).cast("long")
    line = ordered(line.withColumn("_opens", opens), by, ["start_sec", "id"], running={"_runs": ("sum", F.col("_opens"))})
    entry = F.struct("rank", F.col("start_sec").alias("s"), end.alias("e"), "id")
    kinds = dict(line.dtypes)
    state = F.struct(
        F.array().cast("array<struct<s:double,e:double>>").alias("kept"), F.array().cast(f"array<{kinds['id']}>").alias("lost")
    )

    def settle(done: Column, x: Column) -> Column:
        hit = F.exists(done["kept"], lambda k: (x["s"] < k["e"] - epsilon) & (k["s"] < x["e"] - epsilon))
        own = F.struct(x["s"].cast("double").alias("s"), x["e"].cast("double").alias("e"))
        return F.struct(
            F.when(hit, done["kept"]).otherwise(F.concat(done["kept"], F.array(own))).alias("kept"),
            F.when(hit, F.concat(done["lost"], F.array(x["id"]))).otherwise(done["lost"]).alias("lost"),
        )

    runs = line.groupBy(*by, (F.col("_runs") + F.col("_opens")).alias("_run")).agg(F.collect_list(entry).alias("_all"))
    lost = F.aggregate(F.array_sort("_all"), state, settle, lambda done: done["lost"])
    undone = undone.unionByName(runs.filter(F.size("_all") > 1).select(*by, F.explode(lost).alias("id")))
    stopped = undone.select(*by, F.col("id").alias(window), F.lit(True).alias("_hit"))
    out = rows.join(stopped, [*by, window], "left")
    back = F.col("_off") | F.col("_hit").isNotNull()
    return out.select(
        *[c for c in aligned.columns if c not in ("new_start", "crosses_scene_cut")],
        F.when(back, F.col("start_sec")).otherwise(F.col("new_start")).alias("new_start"),
        (F.col("crosses_scene_cut") | back).alias("crosses_scene_cut"),
    )


def max_disjoint_count(
    intervals: DataFrame,
    by: Sequence[str],
    *,
    protected: DataFrame | None = None,
    window: str = "window_id",
    start: str = "start_sec",
    duration: str = "duration_sec",
    epsilon: float = WINDOW_EPSILON,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Largest number of pairwise disjoint intervals per group (earliest end first).

    ``protected`` intervals, and those overlapping one, are left out. Rows meet in
    one order, by their ends: what is protected until then is a running maximum,
    and each chunk of that order becomes a few steps (:func:`_steps`), which are
    put one after the other. No pairs are built, no group is gathered. Rows with a
    null in ``by``, their start or their duration do not count.
    """
    by = list(by)
    end = F.col(start) + F.col(duration)
    known = [F.col(c).isNotNull() for c in (*by, start, duration)]

    def side(df: DataFrame, held: bool, at: Column) -> DataFrame:
        # A protected interval comes after those that end where it starts.
        df = df.filter(reduce(and_, known))
        return df.select(
            *by, at.cast("double").alias("_at"), F.lit(held).alias("_held"), end.cast("double").alias("_e"), F.col(start).cast("double").alias("_s")
        )

    rows = intervals.filter(F.col(duration) > epsilon)
    if protected is not None:
        rows = rows.select(*by, window, start, duration).join(protected.select(*by, window), [*by, window], "left_anti")
    line = side(rows, False, end - epsilon)
    order = ["_at", "_held", "_e", "_s"]
    if protected is None:
        line = value_chunk(line, by, order, rows_per_chunk=rows_per_chunk)
    else:
        line = value_chunk(line.unionByName(side(protected, True, F.col(start))), by, order, rows_per_chunk=rows_per_chunk)
        line = ordered(line, by, order, running={"_until": ("max", F.when(F.col("_held"), F.col("_e")))})
        line = line.filter(~F.col("_held") & ~F.coalesce(F.col("_s") < F.col("_until") - epsilon, F.lit(False)))
    line = line.select(*by, CHUNK, "_s", "_e")
    schema = StructType([*line.schema.fields[:-2], *StructType.fromDDL("_steps array<struct<s:double,n:long,last:double>>").fields])
    steps = line.groupBy(*by, CHUNK).applyInArrow(_steps(epsilon), schema)
    chunks = steps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(CHUNK, "_steps"))).alias("_chunks"))

    def after(so_far: Column, chunk: Column) -> Column:
        first = F.get(F.filter(chunk["_steps"], lambda step: step["s"] >= so_far["last"] - epsilon), 0)
        return F.struct(F.coalesce(first["last"], so_far["last"]).alias("last"), (so_far["n"] + F.coalesce(first["n"], F.lit(0))).alias("n"))

    none = F.struct(F.lit(float("-inf")).alias("last"), F.lit(0).cast("long").alias("n"))
    return chunks.select(*by, F.aggregate("_chunks", none, after)["n"].alias("capacity"))


def _steps(epsilon: float):
    """A chunk of a group's intervals -> [(s, n, last)]: how many more the chunk adds, and the last one's end.

    After an interval that ends at e, the greedy choice is the smallest end among
    starts at e or later: an interval that contains no other one. These have their
    starts and ends in the same order, so that each finds its next by a search.
    The first step with ``s`` at e or later holds. An e from earlier chunks is not
    beyond the first end here, so that only intervals across that make steps, and
    those whose choices end alike make one.
    """

    def run(table: pa.Table) -> pa.Table:
        s, e = (table.column(c).to_numpy() for c in ("_s", "_e"))
        order = np.lexsort((s, e))
        s, e = s[order], e[order]
        bare = np.append(True, s[1:] > np.maximum.accumulate(s)[:-1])
        s, e = s[bare], e[bare]
        following = np.maximum(np.searchsorted(s, e - epsilon), np.arange(1, len(s) + 1)).tolist()
        n, last = [1] * len(s), e.tolist()
        for k in range(len(s) - 1, -1, -1):
            if following[k] < len(s):
                n[k], last[k] = n[following[k]] + 1, last[following[k]]
        most = min(len(s), int(np.searchsorted(s, e[0] - epsilon)) + 1)
        steps = [
            {"s": float(s[k]), "n": n[k], "last": last[k]}
            for k in range(most)
            if k + 1 == most or (n[k], last[k]) != (n[k + 1], last[k + 1])
        ]
        kind = pa.list_(pa.struct([("s", pa.float64()), ("n", pa.int64()), ("last", pa.float64())]))
        return table.slice(0, 1).drop_columns(["_s", "_e"]).append_column("_steps", pa.array([steps], kind))

    return run


def plan_matches_scout(expected: DataFrame, actual: DataFrame, by: Sequence[str], window: str = "window_id") -> DataFrame:
    """Per source: are the expected and the actual window ids the same set?"""
    by = list(by)
    here, not_here = F.lit(True), F.lit(False)
    e = expected.select(*by, window, here.alias("_e"), not_here.alias("_a"))
    a = actual.select(*by, window, not_here.alias("_e"), here.alias("_a"))
    both = e.unionByName(a).groupBy(*by, window).agg(F.bool_or("_e").alias("_e"), F.bool_or("_a").alias("_a"))
    return both.groupBy(*by).agg(
        F.count_if(~F.col("_a")).alias("missing"), F.count_if(~F.col("_e")).alias("unexpected")
    ).withColumn("matches", (F.col("missing") == 0) & (F.col("unexpected") == 0))
