"""Ranks, risk, intervals and sampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratelens import policy
from ratelens.functions.identity import unit_hash
from ratelens.operators import intervals, ranking, sampling
from ratelens.queries.registry import query
from ratelens.session import spread


def _midrank_sql(value, name):
    return (
        f"(rank() OVER (PARTITION BY source_id ORDER BY {value}) - 1 + (count(*) OVER (PARTITION BY source_id, {value}) - 1) / 2.0::DOUBLE)"
        f" / nullif(count(*) OVER (PARTITION BY source_id) - 1, 0) AS {name}"
    )


_RISK_SQL = f"""
    ranks AS (SELECT *, {_midrank_sql('si_p90', 'sr0')}, {_midrank_sql('ti_p90', 'tr0')}, {_midrank_sql('max_scene_score', 'cr0')} FROM observations),
    comps AS (SELECT *, 0.55::DOUBLE * least(1, greatest(0, si_p90 / 100)) + 0.45::DOUBLE * coalesce(sr0, 0.5) AS spatial_detail,
      0.55::DOUBLE * least(1, greatest(0, ti_p90 / 50)) + 0.45::DOUBLE * coalesce(tr0, 0.5) AS motion,
      0.55::DOUBLE * least(1, greatest(0, max_scene_score / 100)) + 0.45::DOUBLE * coalesce(cr0, 0.5) AS transition FROM ranks),
    risk AS (SELECT *, 0.27::DOUBLE * spatial_detail + 0.30::DOUBLE * motion + 0.17::DOUBLE * transition AS difficulty FROM comps)
"""
_STATS_SQL = """
    stats AS (SELECT source_id, n AS observations, het AS heterogeneity, least(1, 0.55::DOUBLE * het + 0.30::DOUBLE * ab + 0.15::DOUBLE / sqrt(n))::DOUBLE AS uncertainty
      FROM (SELECT source_id, count(*)::BIGINT AS n, avg(difficulty) AS ab,
        least(1, 2.2::DOUBLE * (stddev_pop(spatial_detail) + stddev_pop(motion) + stddev_pop(transition)) / 7
          + 0.25::DOUBLE * ((max(spatial_detail) >= 0.65)::INT + (max(motion) >= 0.65)::INT + (max(transition) >= 0.65)::INT) / 6)::DOUBLE AS het
        FROM risk GROUP BY source_id) x)
"""


@query(
    "w01_midrank",
    f"SELECT source_id, window_id, round(coalesce(r, 0.5), 9) AS midrank FROM (SELECT source_id, window_id, {_midrank_sql('max_scene_score', 'r')} FROM observations) x",
    uses="observations",
)
def midrank(t):
    out = ranking.midrank(t.observations, ["source_id"], "max_scene_score")
    return out.select("source_id", "window_id", F.round("midrank", 9).alias("midrank"))


@query(
    "w02_score_risk",
    f"""WITH {_RISK_SQL} SELECT source_id, window_id, round(spatial_detail + 1.7e-9, 7) AS spatial_detail, round(motion + 1.7e-9, 7) AS motion, round(transition + 1.7e-9, 7) AS transition,
        round(difficulty + 1.7e-9, 7) AS difficulty FROM risk""",
    uses="observations",
)
def risk(t):
    # The offset keeps values that end exactly on a rounding boundary off it, in both engines.
    out = ranking.score_risk(t.observations, ["source_id"])
    return out.select(
        "source_id", "window_id", *[F.round(F.col(c) + 1.7e-9, 7).alias(c) for c in ("spatial_detail", "motion", "transition", "difficulty")]
    )


@query(
    "w03_content_stats",
    f"WITH {_RISK_SQL}, {_STATS_SQL} SELECT source_id, observations, round(heterogeneity, 7) AS heterogeneity, round(uncertainty, 7) AS uncertainty FROM stats",
    uses="observations",
)
def stats(t):
    out = ranking.content_stats(ranking.score_risk(t.observations, ["source_id"]), ["source_id"])
    return out.select(
        "source_id", "observations", F.round("heterogeneity", 7).alias("heterogeneity"), F.round("uncertainty", 7).alias("uncertainty")
    )


@query(
    "w04_adaptive_window_count",
    f"""WITH {_RISK_SQL}, {_STATS_SQL} SELECT source_id, least(6, 3 + greatest(0, CAST(round_even(3 * (0.30::DOUBLE * least(1, ln(1 + source_id * 90 / 600::DOUBLE) / ln(19::DOUBLE))
        + 0.45::DOUBLE * uncertainty + 0.25::DOUBLE * heterogeneity), 0) AS INTEGER)))::INTEGER AS windows FROM stats""",
    uses="observations",
)
def adaptive(t):
    out = ranking.content_stats(ranking.score_risk(t.observations, ["source_id"]), ["source_id"])
    count = ranking.adaptive_window_count(F.col("source_id") * 90.0, "uncertainty", "heterogeneity")
    return out.select("source_id", count.alias("windows"))


def _unit_sql(label):
    return f"('0x' || substr(sha256(concat('smart-strata-v1:', source_id, ':', {label})), 1, 16))::UBIGINT::DOUBLE / pow(2, 64)"


_GRID_SQL = f"""
    b AS (SELECT source_id, duration_sec AS len, least(5, duration_sec) AS bd, (duration_sec - 5) * (0.25::DOUBLE + 0.5::DOUBLE * {_unit_sql("'validation'")}) AS b0,
        least(32, greatest(20, 4 * greatest(1, least(greatest(3, least(6, CASE WHEN duration_sec < 600 THEN 4 WHEN duration_sec < 3600 THEN 5 ELSE 6 END)), CAST(floor(duration_sec / 5) AS INTEGER)))))::INTEGER AS n
      FROM sources WHERE duration_sec > 20),
    c AS (SELECT *, least(2, b0, len - b0 - bd) AS d, greatest(1, least(n - 1, CAST(round_even(n * b0 / (len - bd), 0) AS INTEGER))) AS l FROM b),
    e AS (SELECT *, unnest(range(n)) AS i FROM c),
    f AS (SELECT *, i < l AS lft, CASE WHEN i < l THEN 0 ELSE b0 + bd END AS lo, CASE WHEN i < l THEN b0 ELSE len END AS hi, CASE WHEN i < l THEN i ELSE i - l END AS p,
        CASE WHEN i < l THEN l ELSE n - l END AS k FROM e),
    g AS (SELECT source_id, printf('scout-%03d', i + 1) AS window_id, 'scout' AS pool,
        CASE WHEN (hi - lo) / k >= d THEN lo + p * ((hi - lo) / k) + ((hi - lo) / k - d) * {_unit_sql("concat('scout:', i)")} ELSE lo + (hi - lo - d) * p / greatest(1, k - 1) END AS start_sec, d AS duration_sec FROM f
      UNION ALL SELECT source_id, 'holdout:unscouted', 'holdout', b0, bd FROM c)
"""


@query(
    "w05_scout_grid",
    f"""
    WITH {_GRID_SQL}
    SELECT source_id, window_id, pool, round(start_sec, 5) AS start_sec, round(duration_sec, 5)::DOUBLE AS duration_sec FROM g
    """,
    uses="sources",
)
def grid(t):
    out = sampling.scout_grid(t.sources)
    return out.select(
        "source_id", "window_id", "pool", F.round("start_sec", 5).alias("start_sec"), F.round("duration_sec", 5).alias("duration_sec")
    )


@query(
    "w06_even_windows",
    """
    WITH n AS (SELECT source_id, duration_sec AS len, CASE WHEN duration_sec <= 20 THEN 1 ELSE greatest(1, least(greatest(3, least(6, CASE WHEN duration_sec < 600 THEN 4 WHEN duration_sec < 3600 THEN 5 ELSE 6 END)),
        greatest(1, CAST(floor(duration_sec / 5) AS INTEGER)))) END AS n FROM sources),
    d AS (SELECT *, CASE WHEN len <= 20 THEN len ELSE least(5, len / n) END AS d FROM n),
    e AS (SELECT *, unnest(range(n)) AS i FROM d),
    f AS (SELECT *, greatest(0, least(greatest(0, len - d), len * ((i + 1) / (n + 1)::DOUBLE) - d / 2)) AS s FROM e),
    g AS (SELECT *, bool_or(s < prev + d) OVER (PARTITION BY source_id) AS tight FROM (SELECT *, lag(s) OVER (PARTITION BY source_id ORDER BY i) AS prev FROM f) x)
    SELECT source_id, i::INTEGER AS window_no, round(CASE WHEN n = 1 THEN (len - d) / 2 WHEN tight THEN (len - d) * i / greatest(n - 1, 1) ELSE s END, 6)::DOUBLE AS start_sec, round(d, 6)::DOUBLE AS duration_sec FROM g
    """,
    uses="sources",
)
def even(t):
    out = sampling.even_windows(t.sources)
    return out.select(
        "source_id", "window_no", F.round("start_sec", 6).alias("start_sec"), F.round("duration_sec", 6).alias("duration_sec")
    )


@query(
    "w06_shot_strata",
    """
    WITH s AS (SELECT source_id, (source_id % 1000)::BIGINT AS a, (source_id % 1000 + duration_sec)::BIGINT AS b, (10 + source_id % 51)::BIGINT AS fps FROM sources),
    l AS (SELECT *, b - a AS f, greatest(1, CAST(ceil(fps * 2.0) AS BIGINT)) AS l FROM s),
    e AS (SELECT *, f <= 3 * l AS whole, unnest(CASE WHEN f <= 3 * l THEN [0] ELSE [0, 1, 2] END) AS i FROM l)
    SELECT source_id, i::INTEGER AS stratum, CASE WHEN NOT whole AND i = 2 THEN 'holdout' ELSE 'search' END AS pool,
      CASE WHEN whole THEN a ELSE a + f * i // 3 + (f * (i + 1) // 3 - f * i // 3 - l) // 2 END::BIGINT AS window_start,
      CASE WHEN whole THEN b ELSE a + f * i // 3 + (f * (i + 1) // 3 - f * i // 3 - l) // 2 + l END::BIGINT AS window_end FROM e
    """,
    uses="sources",
)
def strata(t):
    shots = t.sources.selectExpr(
        "source_id", "source_id % 1000 AS start_frame", "CAST(source_id % 1000 + duration_sec AS BIGINT) AS end_frame", "10 + source_id % 51 AS fps"
    )
    return sampling.shot_strata(shots).select("source_id", "stratum", "pool", "window_start", "window_end")


@query(
    "w07_shots_from_cuts",
    """
    WITH i AS (SELECT *, sum(CASE WHEN frame_no > 0 AND scd_score >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame_no) AS shot FROM frame_metrics)
    SELECT clip_id, min(frame_no) AS start_frame, max(frame_no) + 1 AS end_frame FROM i GROUP BY clip_id, shot
    """,
    uses="frame_metrics",
)
def shots(t):
    return intervals.shots_from_cuts(t.frame_metrics, ["clip_id"])


@query(
    "w08_interval_overlaps",
    """
    SELECT a.source_id, a.window_id AS search_id, b.window_id AS holdout_id FROM intervals a JOIN intervals b ON a.source_id = b.source_id
      AND a.pool = 'search' AND b.pool = 'holdout' AND a.start_sec < b.start_sec + b.duration_sec - 1e-9 AND b.start_sec < a.start_sec + a.duration_sec - 1e-9
    """,
    uses="intervals",
)
def overlaps(t):
    i = t.intervals
    out = intervals.interval_overlaps(i.filter("pool = 'search'"), i.filter("pool = 'holdout'"), ["source_id"])
    return out.select("source_id", F.col("a_window_id").alias("search_id"), F.col("b_window_id").alias("holdout_id"))


@query(
    "w08_self_overlap",
    """
    SELECT source_id, coalesce(bool_or(start_sec < prev - 1e-9), false) AS overlapping FROM (SELECT *,
      max(start_sec + d) OVER (PARTITION BY source_id ORDER BY start_sec, window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM (SELECT *, duration_sec / 40 AS d FROM intervals) y) x GROUP BY source_id
    """,
    uses="intervals",
)
def self_overlap(t):
    return intervals.has_self_overlap(t.intervals.withColumn("duration_sec", F.col("duration_sec") / 40), ["source_id"])


@query(
    "w09_largest_gap",
    """
    WITH p AS (SELECT source_id, start_sec AS s, duration_sec / 10 AS d FROM intervals),
    e AS (SELECT * FROM p UNION ALL SELECT source_id, max(s) + 30, 0 FROM p GROUP BY source_id),
    g AS (SELECT source_id, s, greatest(0, coalesce(max(s + d) OVER (PARTITION BY source_id ORDER BY s, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lo FROM e),
    b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY s - lo DESC, lo) AS rn FROM g)
    SELECT source_id, CASE WHEN s - lo >= 150 THEN round(s - lo, 6) END AS gap_sec, CASE WHEN s - lo >= 150 THEN round((lo + s - 150) / 2, 6) END AS start_sec,
      CASE WHEN s - lo >= 150 THEN 150.0::DOUBLE END AS duration_sec FROM b WHERE rn = 1
    """,
    uses="intervals",
)
def gap(t):
    rows = t.intervals.withColumn("duration_sec", F.col("duration_sec") / 10)
    totals = rows.groupBy("source_id").agg((F.max("start_sec") + 30).alias("total_sec"))
    out = intervals.largest_gap(rows, ["source_id"], totals, min_length=150.0)
    return out.select("source_id", F.round("gap_sec", 6).alias("gap_sec"), F.round("start_sec", 6).alias("start_sec"), "duration_sec")


def _windows_and_cuts(t):
    f = t.frame_scores
    ends = f.groupBy("clip_id").agg(((F.max("frame_no") + 2) * 8.0).alias("total_sec"))
    reasons = (
        F.when(F.col("frame_no") % 9 == 0, F.array(F.lit("transition_risk")))
        .when(F.col("frame_no") % 7 == 3, F.array(F.lit("unscouted_validation")))
        .when(F.col("frame_no") % 5 == 0, F.array(F.lit("hardship"), F.lit("coverage_bin_1")))
        .otherwise(F.array(F.lit("hardship")))
    )
    windows = f.select(
        "clip_id", F.col("frame_no").alias("window_id"), (F.col("frame_no") * 8.0).alias("start_sec"), F.lit(5.0).alias("duration_sec"), reasons.alias("reasons")
    ).join(ends, "clip_id")
    cuts = f.filter("score < 90").select("clip_id", (F.col("frame_no") * 8.0 + 2.25 + F.col("frame_no") % 2 / 2).alias("cut_sec"))
    return windows, cuts


# Cuts fall early in even windows and later in odd ones, so that some windows move right and some left.
_ALIGN_SQL = """
    e AS (SELECT clip_id, (max(frame_no) + 2) * 8.0::DOUBLE AS total FROM frame_scores GROUP BY clip_id),
    w AS (SELECT clip_id, frame_no AS window_id, frame_no * 8.0::DOUBLE AS s, 5.0::DOUBLE AS d, frame_no % 9 = 0 AS tr, frame_no % 9 > 0 AND frame_no % 7 = 3 AS blind,
      frame_no % 9 > 0 AND frame_no % 7 <> 3 AND frame_no % 5 = 0 AS binned FROM frame_scores),
    c AS (SELECT f.clip_id, frame_no * 8.0::DOUBLE + 2.25 + frame_no % 2 / 2 AS c FROM frame_scores f JOIN e ON e.clip_id = f.clip_id WHERE score < 90),
    b AS (SELECT clip_id, c FROM c UNION ALL SELECT clip_id, 0 FROM e UNION ALL SELECT clip_id, total FROM e),
    sh AS (SELECT clip_id, c AS l, lead(c) OVER (PARTITION BY clip_id ORDER BY c) AS r FROM b),
    x AS (SELECT w.*, NOT blind AND EXISTS (SELECT 1 FROM c WHERE c.clip_id = w.clip_id AND w.s + 1e-9 < c.c AND c.c < w.s + w.d - 1e-9) AS crosses FROM w),
    p AS (SELECT x.clip_id, window_id, least(greatest(s, l), r - d) AS t, row_number() OVER (PARTITION BY x.clip_id, window_id ORDER BY abs(least(greatest(s, l), r - d) - s), least(greatest(s, l), r - d)) AS rn
      FROM x JOIN sh ON sh.clip_id = x.clip_id AND r - l + 1e-9 >= d WHERE crosses AND NOT tr),
    al AS (SELECT x.*, total, coalesce(p.t, s) AS t, crosses AND (tr OR p.t IS NULL) AS flagged
      FROM x JOIN e ON e.clip_id = x.clip_id LEFT JOIN p ON p.clip_id = x.clip_id AND p.window_id = x.window_id AND rn = 1)
"""


@query(
    "w10_align_to_cuts",
    f"WITH {_ALIGN_SQL} SELECT clip_id, window_id, round(t, 6) AS new_start, flagged AS crosses_scene_cut FROM al",
    uses="frame_scores",
)
def align(t):
    windows, cuts = _windows_and_cuts(t)
    out = intervals.align_to_cuts(windows, cuts, ["clip_id"])
    return out.select("clip_id", "window_id", F.round("new_start", 6).alias("new_start"), "crosses_scene_cut")


@query(
    "w10_guard_alignment",
    f"""
    WITH RECURSIVE {_ALIGN_SQL},
    g AS (SELECT *, row_number() OVER o AS rn, t <> s AS moved, binned AND (t + d / 2 < 0 OR t + d / 2 >= total / 2) AS off,
        coalesce(t < lag(s) OVER o + d - 1e-9, false) OR coalesce(lead(s) OVER o < t + d - 1e-9, false) AS hits FROM al WINDOW o AS (PARTITION BY clip_id ORDER BY s)),
    k(clip_id, window_id, rn, back, reach) AS (
      SELECT clip_id, window_id, rn, off OR (moved AND hits), CASE WHEN moved AND NOT off AND NOT hits THEN t + d ELSE -1 END FROM g WHERE rn = 1
      UNION ALL
      SELECT g.clip_id, g.window_id, g.rn, off OR (moved AND (hits OR t < reach - 1e-9)),
        CASE WHEN moved AND NOT off AND NOT hits AND t >= reach - 1e-9 THEN t + d ELSE reach END FROM k JOIN g ON g.clip_id = k.clip_id AND g.rn = k.rn + 1)
    SELECT g.clip_id, g.window_id, CASE WHEN back THEN s ELSE t END AS new_start, flagged OR back AS crosses_scene_cut
    FROM g JOIN k ON k.clip_id = g.clip_id AND k.rn = g.rn
    """,
    uses="frame_scores",
)
def guard(t):
    windows, cuts = _windows_and_cuts(t)
    out = intervals.align_to_cuts(windows, cuts, ["clip_id"]).withColumn("coverage_bins", F.lit(2))
    out = intervals.guard_alignment(out, ["clip_id"])
    return out.select("clip_id", "window_id", "new_start", "crosses_scene_cut")


@query(
    "w11_coverage_top1",
    f"""WITH {_RISK_SQL}, len AS (SELECT source_id, max(start_sec) + 2 AS total FROM observations GROUP BY source_id),
      k AS (SELECT r.source_id, window_id, start_sec, difficulty, start_sec + 1 AS c, total, least(7, CAST(floor((start_sec + 1) * 8 / total) AS INTEGER)) AS bin
        FROM risk r JOIN len ON len.source_id = r.source_id)
      SELECT source_id, bin::INTEGER AS bin, window_id, start_sec, round(difficulty, 5) AS difficulty FROM (SELECT *, row_number() OVER (PARTITION BY source_id, bin
        ORDER BY round(difficulty, 9) DESC, abs(c - total * (bin + 0.5) / 8), start_sec, window_id) AS rn FROM k) x WHERE rn = 1""",
    uses="observations",
)
def coverage(t):
    o = t.observations
    lengths = o.groupBy("source_id").agg((F.max("start_sec") + 2).alias("total_sec"))
    rows = ranking.score_risk(o, ["source_id"]).join(lengths, "source_id").withColumn("difficulty", F.round("difficulty", 9))
    out = ranking.coverage_top1(rows, ["source_id"], F.lit(8), F.col("total_sec"))
    return out.withColumn("difficulty", F.round("difficulty", 5))


@query(
    "w12_max_disjoint_count",
    """
    WITH RECURSIVE v AS (SELECT source_id, pool, start_sec AS s, start_sec + duration_sec / 20 AS e FROM intervals),
    i AS (SELECT source_id, s, e FROM v WHERE pool <> 'reserve' AND e - s > 1e-9 AND NOT EXISTS (SELECT 1 FROM v r WHERE r.source_id = v.source_id
      AND r.pool = 'reserve' AND v.s < r.e - 1e-9 AND r.s < v.e - 1e-9)),
    g(source_id, e, n) AS (SELECT source_id, min(e), 1::BIGINT FROM i GROUP BY source_id
      UNION ALL SELECT g.source_id, min(i.e), min(g.n) + 1 FROM g JOIN i ON i.source_id = g.source_id AND i.s >= g.e - 1e-9 GROUP BY g.source_id)
    SELECT source_id, max(n)::BIGINT AS capacity FROM g GROUP BY source_id
    """,
    uses="intervals",
)
def capacity(t):
    rows = t.intervals.withColumn("duration_sec", F.col("duration_sec") / 20)
    return intervals.max_disjoint_count(rows, ["source_id"], protected=rows.filter("pool = 'reserve'"))


def _scouted(t):
    """Scout observations for every source: its grid, with metrics drawn from seeded hashes.

    Sources are dealt out before they get their scouts, which then never move.
    """
    grid = sampling.scout_grid(spread(t.sources, "source_id")).filter("pool = 'scout'")

    def draw(name):
        return unit_hash("source_id", F.concat(F.lit(f"{name}:"), "window_id"))

    rows = grid.select(
        "source_id", "window_id", "start_sec", "duration_sec",
        F.floor(draw("si") * 130).cast("double").alias("si_p90"), F.floor(draw("ti") * 70).cast("double").alias("ti_p90"),
        F.floor(draw("scene") * 16).cast("double").alias("max_scene_score"), draw("dark").alias("dark"),
    )
    rows = rows.withColumn("cut_count", F.when(F.col("max_scene_score") >= 10, 1).otherwise(0))
    return ranking.score_risk(rows, ["source_id"], bounded=True)


def _drawn_sql(name):
    return _unit_sql(f"concat('{name}:', window_id)")


# _scouted in SQL: the grid's scouts with drawn metrics, their risk, and the window that each would become.
_SCOUTED_SQL = f"""
    {_GRID_SQL},
    observed AS (SELECT source_id, window_id, start_sec, duration_sec, floor({_drawn_sql('si')} * 130)::DOUBLE AS si_p90,
        floor({_drawn_sql('ti')} * 70)::DOUBLE AS ti_p90, floor({_drawn_sql('scene')} * 16)::DOUBLE AS max_scene_score, {_drawn_sql('dark')} AS dark
      FROM g WHERE pool = 'scout'),
    {_RISK_SQL.replace('FROM observations', 'FROM observed').replace(
        '0.17::DOUBLE * transition AS difficulty', '0.17::DOUBLE * transition + 0.08::DOUBLE * dark AS difficulty').strip()},
    spots AS (SELECT r.source_id, window_id AS id, r.start_sec, difficulty, len, r.start_sec + r.duration_sec / 2 AS center, least(5.0, len)::DOUBLE AS d,
        least(greatest(0, r.start_sec + r.duration_sec / 2 - least(5.0, len)::DOUBLE / 2), greatest(0, len - least(5.0, len)::DOUBLE)) AS spot
      FROM risk r JOIN b ON r.source_id = b.source_id)
"""


def _near_sql(a, b):
    return f"abs({a} - {b}) < d - {policy.WINDOW_EPSILON!r}::DOUBLE"


@query(
    "w13_greedy_diverse_pick",
    # With two picks and no reserve, only the first must leave room, for one window.
    f"""
    WITH {_SCOUTED_SQL},
    held AS (SELECT source_id, id AS h_id, start_sec AS h_at FROM spots QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY difficulty DESC, id DESC) = 1),
    gaps AS (SELECT s.*, h_at, abs(center - (h_at + d / 2)) AS gap, greatest(len / 3, 1)::DOUBLE AS spacing FROM spots s JOIN held h ON s.source_id = h.source_id AND id <> h_id),
    line AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY 0.7::DOUBLE * difficulty + 0.3::DOUBLE * least(1, gap / spacing) DESC, difficulty DESC, start_sec, id DESC) AS r,
      {_near_sql('spot', 'h_at')} AS hit FROM gaps),
    free AS (SELECT source_id, id, spot FROM line WHERE NOT hit),
    roomy AS (SELECT l.* FROM line l WHERE NOT hit AND EXISTS (SELECT 1 FROM free f WHERE f.source_id = l.source_id AND f.id <> l.id AND NOT ({_near_sql('f.spot', 'l.spot')}))),
    one AS (SELECT *, 0 AS pick_no FROM roomy QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY r) = 1),
    two AS (SELECT l.*, 1 AS pick_no FROM line l JOIN one o ON l.source_id = o.source_id WHERE l.r > o.r AND NOT l.hit AND NOT ({_near_sql('l.spot', 'o.spot').replace('< d', '< l.d')})
      QUALIFY row_number() OVER (PARTITION BY l.source_id ORDER BY 0.7::DOUBLE * l.difficulty
        + 0.3::DOUBLE * least(1, least(l.gap, abs(l.center - (o.spot + l.d / 2))) / l.spacing) DESC, l.difficulty DESC, l.start_sec, l.id DESC) = 1)
    SELECT source_id, pick_no::INTEGER AS pick_no, id AS scout_id, round(spot, 5) AS start_sec, round(d, 5) AS duration_sec FROM (SELECT * FROM one UNION ALL SELECT * FROM two) x
    """,
    uses="sources",
)
def diverse(t):
    risk = _scouted(t)
    hardest = F.max_by(F.struct(F.col("window_id").alias("scout_id"), "start_sec"), F.struct("difficulty", "window_id"))
    chosen = F.array(hardest.over(Window.partitionBy("source_id")))
    return sampling.greedy_diverse_pick(risk, chosen, t.sources, 2, dealt=True).withColumns(
        {c: F.round(c, 5) for c in ("start_sec", "duration_sec")}
    )


@query("w14_sample_plan")
def plan(t):
    windows, _ = sampling.sample_plan(_scouted(t), t.sources, dealt=True)
    return windows.select(
        "source_id", "pool", "window_id", "start_sec", "duration_sec", F.concat_ws(",", "reasons").alias("reasons")
    )


@query(
    "w15_plan_matches_scout",
    """
    WITH x AS (SELECT source_id, window_id AS e FROM observations WHERE window_id % 7 > 0 OR source_id % 3 > 0),
    y AS (SELECT source_id, window_id AS a FROM observations WHERE window_id % 11 > 0 OR source_id % 4 > 0)
    SELECT source_id, count(*) FILTER (WHERE a IS NULL)::BIGINT AS missing, count(*) FILTER (WHERE e IS NULL)::BIGINT AS unexpected,
      count(*) FILTER (WHERE a IS NULL OR e IS NULL) = 0 AS matches
    FROM (SELECT coalesce(x.source_id, y.source_id) AS source_id, e, a FROM x FULL JOIN y ON x.source_id = y.source_id AND e = a) z GROUP BY source_id
    """,
    uses="observations",
)
def matches(t):
    o = t.observations.select("source_id", "window_id")
    return intervals.plan_matches_scout(
        o.filter("window_id % 7 > 0 OR source_id % 3 > 0"), o.filter("window_id % 11 > 0 OR source_id % 4 > 0"), ["source_id"]
    )
