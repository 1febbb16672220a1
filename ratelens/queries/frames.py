"""Frame- and window-level aggregation."""

from pyspark.sql import functions as F

from ratelens.bindings import table
from ratelens.operators import candidates, frames
from ratelens.queries.registry import query

# Rolling minimum with a per-clip window, and the nearest rank, as the oracle states them.
_WORST = """
    n AS (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM frame_scores),
    s AS (SELECT *, least(n, fps) AS s FROM n),
    r AS (SELECT clip_id, avg(score) OVER (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN s - 1 PRECEDING AND CURRENT ROW) AS m, frame_no, s FROM s),
    worst AS (SELECT clip_id, min(m) AS worst FROM r WHERE frame_no >= s - 1 GROUP BY clip_id)
"""


@query(
    "a01_nearest_rank",
    """
    SELECT clip_id, max(score) FILTER (WHERE k = greatest(1, CAST(ceil(n * 0.9::DOUBLE) AS BIGINT))) AS p90,
      max(score) FILTER (WHERE k = greatest(1, CAST(ceil(n * 0.1::DOUBLE) AS BIGINT))) AS p10
    FROM (SELECT clip_id, score, row_number() OVER (PARTITION BY clip_id ORDER BY score) AS k, count(*) OVER (PARTITION BY clip_id) AS n
      FROM frame_scores) x GROUP BY clip_id
    """,
    uses="frame_scores",
)
def ranks(t):
    return frames.nearest_rank(t.frame_scores, ["clip_id"], "score", {"p90": 0.90, "p10": 0.10})


def _scout(t):
    # The binding has no cut times: a cut frame's time is its number at 12 frames per second.
    m = t.frame_metrics
    time = F.when(F.col("scd_score") >= 10, F.col("frame_no") / 12)
    return m.select("*", time.alias("scd_time"), F.col("frame_no").alias("frame_idx"))


_SCOUT_SQL = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY si) AS ks, count(*) OVER (PARTITION BY clip_id) AS n FROM frame_metrics),
    still AS (SELECT clip_id, ti, row_number() OVER (PARTITION BY clip_id ORDER BY ti) AS kt, count(*) OVER (PARTITION BY clip_id) AS nt
      FROM frame_metrics WHERE scd_score < 10 AND frame_no > 0),
    scout AS (SELECT * FROM (SELECT clip_id, count(*)::BIGINT AS frames, max(si) FILTER (WHERE ks = ceil(n * 0.9::DOUBLE)) AS si_p90,
        count(*) FILTER (WHERE scd_score >= 10)::BIGINT AS cut_count, max(scd_score) AS max_scene_score, avg(luma) AS luma_mean
      FROM ranked GROUP BY clip_id) a JOIN (SELECT clip_id, max(ti) FILTER (WHERE kt = ceil(nt * 0.9::DOUBLE)) AS ti_p90 FROM still GROUP BY clip_id) b USING (clip_id))
"""


@query(
    "a02_scout_metrics",
    f"WITH {_SCOUT_SQL} SELECT clip_id, frames, round(si_p90, 6) AS si_p90, round(ti_p90, 6) AS ti_p90, cut_count, max_scene_score, round(luma_mean, 6) AS luma_mean FROM scout",
    uses="frame_metrics",
)
def scout(t):
    metrics, _ = frames.scout_metrics(_scout(t), ["clip_id"])
    return metrics.select(
        "clip_id", "frames", F.round("si_p90", 6).alias("si_p90"), F.round("ti_p90", 6).alias("ti_p90"), "cut_count",
        "max_scene_score", F.round("luma_mean", 6).alias("luma_mean"),
    )


@query(
    "a02_cut_times",
    "SELECT clip_id, round(frame_no / 12, 6) AS cut_sec, scd_score AS score FROM frame_metrics WHERE scd_score >= 10",
    uses="frame_metrics",
)
def cuts(t):
    return frames.cut_times(_scout(t), ["clip_id"]).withColumn("cut_sec", F.round("cut_sec", 6))


@query(
    "a03_risk_inputs",
    f"""WITH {_SCOUT_SQL} SELECT clip_id, round(greatest(0, least(1, (64 - luma_mean) / 64)), 6)::DOUBLE AS dark,
      round(greatest(0, 1 - least(1, si_p90 / 100)), 6)::DOUBLE AS flat_or_gradient,
      round(least(1, si_p90 / 100) * greatest(0, 1 - least(1, ti_p90 / 50)), 6)::DOUBLE AS high_frequency_or_noise FROM scout""",
    uses="frame_metrics",
)
def risk_inputs(t):
    # Scaled down, so that the shares are not all clamped on the test values.
    metrics, _ = frames.scout_metrics(_scout(t), ["clip_id"])
    return frames.risk_inputs(metrics).select(
        "clip_id", F.round("dark", 6).alias("dark"), F.round("flat_or_gradient", 6).alias("flat_or_gradient"),
        F.round("high_frequency_or_noise", 6).alias("high_frequency_or_noise"),
    )


@query(
    "a04_worst_consecutive",
    f"WITH {_WORST} SELECT clip_id, round(worst, 6) AS worst FROM worst",
    uses="frame_scores",
)
def worst(t):
    out = frames.worst_consecutive(t.frame_scores, ["clip_id"], "frame_no", "score", F.col("fps"))
    return out.select("clip_id", F.round("worst", 6).alias("worst"))


@query(
    "a05_pool_scores",
    f"""WITH {_WORST}, p AS (SELECT clip_id, score, row_number() OVER (PARTITION BY clip_id ORDER BY score) AS k,
          count(*) OVER (PARTITION BY clip_id) AS n FROM frame_scores),
        g AS (SELECT clip_id, count(*)::BIGINT AS frames, avg(score) AS mean, max(score) FILTER (WHERE k = ceil(n * 0.1::DOUBLE)) AS p10 FROM p GROUP BY clip_id)
        SELECT clip_id, frames, round(mean, 9) AS mean, p10, round(worst, 9) AS worst_1s, round(least(mean, worst + 4), 9) AS gate FROM g JOIN worst USING (clip_id)""",
    uses="frame_scores",
)
def pooled(t):
    out = frames.pool_scores(t.frame_scores, ["clip_id"])
    return out.select(
        "clip_id", "frames", F.round("mean", 9).alias("mean"), "p10", F.round("worst_1s", 9).alias("worst_1s"),
        F.round("gate", 9).alias("gate"),
    )


_SEGMENTS = """
    SELECT clip_id, frame_no - frame_no % 25 AS segment_start, frame_no % 25 AS frame, score FROM frame_scores
    UNION ALL
    SELECT clip_id, frame_no - frame_no % 25 - 25 AS segment_start, 25 + frame_no % 25 AS frame, score / 2 FROM frame_scores
      WHERE frame_no >= 25 AND frame_no % 25 < 5
"""


def _segments(t):
    f = t.frame_scores
    own = f.select("clip_id", F.expr("frame_no - frame_no % 25").alias("segment_start"), F.expr("frame_no % 25").alias("frame"), "score")
    tail = f.filter("frame_no >= 25 AND frame_no % 25 < 5").select(
        "clip_id", F.expr("frame_no - frame_no % 25 - 25").alias("segment_start"), F.expr("25 + frame_no % 25").alias("frame"), F.col("score") / 2
    )
    return own.union(tail)


@query(
    "a06_merge_overlapping_segments",
    f"""WITH seg AS ({_SEGMENTS}) SELECT clip_id, frame_no, round(score, 6) AS score FROM (
        SELECT clip_id, segment_start + frame AS frame_no, score, row_number() OVER (PARTITION BY clip_id, segment_start + frame ORDER BY segment_start) AS rn FROM seg) x WHERE rn = 1""",
    uses="frame_scores",
)
def segments(t):
    merged, _ = frames.merge_overlapping_segments(_segments(t), ["clip_id"], "segment_start", "frame", "score")
    return merged.withColumn("score", F.round("score", 6))


@query(
    "a06_segment_coverage",
    """SELECT clip_id, count(*)::BIGINT AS frames, clip_id % 5 > 0 AS complete FROM frame_scores GROUP BY clip_id""",
    uses="frame_scores",
)
def coverage(t):
    expected = t.frame_scores.groupBy("clip_id").agg(
        (F.count(F.lit(1)) + (F.col("clip_id") % 5 == 0).cast("int")).alias("expected_frames")
    )
    return frames.merge_overlapping_segments(_segments(t), ["clip_id"], "segment_start", "frame", "score", expected)[1]


# A third of the clips drift late in the timeline, a third jumps back once.
_TIMES = (
    "frame_no / 10 + CASE WHEN clip_id % 3 = 0 AND frame_no > 40 THEN 0.07 WHEN clip_id % 3 = 1 AND frame_no = 30 THEN -0.35 ELSE 0 END"
)


@query(
    "a07_check_cadence",
    f"""
    WITH x AS (SELECT clip_id, frame_no, (frame_no / 10)::DOUBLE + CASE WHEN clip_id % 3 = 0 AND frame_no > 40 THEN 0.07::DOUBLE WHEN clip_id % 3 = 1 AND frame_no = 30 THEN -0.35::DOUBLE ELSE 0::DOUBLE END AS t FROM frame_scores),
    d AS (SELECT *, t - lag(t) OVER (PARTITION BY clip_id ORDER BY frame_no) AS step, first_value(t) OVER (PARTITION BY clip_id ORDER BY frame_no) AS t0 FROM x),
    g AS (SELECT clip_id, count(*)::BIGINT AS frames, min(step) > 0 AS inc, max(abs(t - (t0 + frame_no / 10))) <= 0.0011 AS grid,
      max(step) - min(step) <= greatest(0.002, avg(step) * 0.02) AS even FROM d GROUP BY clip_id)
    SELECT clip_id, frames, inc AND grid AS on_grid, inc AND even AS even_steps,
      CASE WHEN NOT inc THEN 'timestamps do not increase' WHEN NOT grid THEN 'variable frame rate' END AS reason FROM g
    """,
    uses="frame_scores",
)
def cadence(t):
    rows = t.frame_scores.select("clip_id", "frame_no", F.expr(_TIMES).alias("t_sec"), F.lit(10.0).alias("fps"))
    return frames.check_cadence(rows, ["clip_id"])


@query(
    "a08_check_contiguous",
    """
    SELECT clip_id, count(*)::BIGINT AS frames, min(i) = 0 AND max(i) = count(*) - 1 AND count(DISTINCT i) = count(*) AS contiguous
    FROM (SELECT clip_id, CASE WHEN clip_id % 4 = 0 AND frame_no = 7 THEN 8 WHEN clip_id % 4 = 1 THEN frame_no + 1 ELSE frame_no END AS i FROM frame_scores) x GROUP BY clip_id
    """,
    uses="frame_scores",
)
def contiguous(t):
    rows = t.frame_scores.select(
        "clip_id",
        F.expr("CASE WHEN clip_id % 4 = 0 AND frame_no = 7 THEN 8 WHEN clip_id % 4 = 1 THEN frame_no + 1 ELSE frame_no END").alias("i"),
    )
    return frames.check_contiguous(rows, ["clip_id"], "i").drop("bad_rows")


@query(
    "a09_candidate_summary",
    """
    SELECT source_id, bitrate_bps, gate, windows, encoded_bytes, measured_sec, max_observed_bps, windows = planned AS complete FROM
      (SELECT source_id, bitrate_bps, min(gate) AS gate, count(DISTINCT window_id)::BIGINT AS windows, sum(encoded_bytes)::BIGINT AS encoded_bytes,
        sum(duration_sec) AS measured_sec, max(CAST(ceil(encoded_bytes * 8 / duration_sec) AS BIGINT)) AS max_observed_bps FROM trials GROUP BY source_id, bitrate_bps) a
      JOIN (SELECT source_id, count(DISTINCT window_id) AS planned FROM trials GROUP BY source_id) b USING (source_id)
    """,
    uses="trials",
)
def summary(t):
    return candidates.candidate_summary(t.trials)


@query(
    "a10_hardest_window",
    """
    SELECT source_id, bitrate_bps, arg_min(window_id, gate * 1000 + window_id / 1000) AS hardest_window, min(gate) AS gate FROM (SELECT * REPLACE (round(gate, 2) AS gate) FROM trials) x
    GROUP BY source_id, bitrate_bps
    """,
    uses="trials",
)
def hardest(t):
    return candidates.hardest_window(t.trials.withColumn("gate", F.round("gate", 2)))


@query(
    "a11_stream_bytes",
    """
    WITH v AS (SELECT l_suppkey AS source_id, min(l_linenumber) AS stream_index FROM lineitem WHERE (l_linenumber + l_suppkey) % 3 = 0 GROUP BY 1)
    SELECT source_id, stream_index, sum(CAST(l_quantity AS BIGINT))::BIGINT AS video_bytes FROM v JOIN lineitem ON l_suppkey = source_id AND l_linenumber = stream_index GROUP BY 1, 2
    """,
)
def packets(t):
    rows = table(t.spark, t.sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("stream_index"), F.col("l_quantity").cast("long").alias("size")
    )
    kind = F.when((F.col("stream_index") + F.col("source_id")) % 3 == 0, "video").otherwise("audio")
    streams = rows.select("source_id", "stream_index", kind.alias("codec_type")).distinct()
    return candidates.stream_bytes(rows, streams, ["source_id"])


@query(
    "a12_reconcile_streams",
    """
    WITH p AS (SELECT user_id AS file_id, event_id % 2 AS ordinal, event_id, 5 + event_id * 0.02::DOUBLE AS pts FROM events),
    o AS (SELECT *, pts - 5 + CASE WHEN file_id % 7 = 3 AND ordinal = 1 THEN 0.2 ELSE 0 END AS opts FROM p WHERE file_id % 5 <> 2 OR ordinal = 0),
    s AS (SELECT file_id, ordinal, min(pts) - 5 AS a, max(pts) + 0.02 - 5 AS b FROM p GROUP BY 1, 2),
    q AS (SELECT file_id, ordinal, min(opts) AS a, max(opts) + 0.02 AS b FROM o GROUP BY 1, 2)
    SELECT file_id, 'audio' AS kind, count(s.ordinal)::BIGINT AS source_streams, count(q.ordinal)::BIGINT AS output_streams,
      count(*) FILTER (WHERE q.ordinal IS NOT NULL AND (abs(s.a - q.a) > 0.022 OR abs(s.b - q.b) > 0.022))::BIGINT AS moved_streams,
      count(s.ordinal) = count(q.ordinal) AND count(*) FILTER (WHERE q.ordinal IS NOT NULL AND (abs(s.a - q.a) > 0.022 OR abs(s.b - q.b) > 0.022)) = 0 AS ok
    FROM s LEFT JOIN q USING (file_id, ordinal) GROUP BY file_id
    """,
)
def streams(t):
    base = table(t.spark, t.sf_dir, "events").select(
        F.col("user_id").alias("file_id"), F.lit("audio").alias("kind"), (F.col("event_id") % 2).alias("ordinal"),
        F.col("event_id").alias("packet_no"), (5 + F.col("event_id") * 0.02).alias("pts_sec"), F.lit(0.02).alias("duration_sec"),
    )
    late = F.when((F.col("file_id") % 7 == 3) & (F.col("ordinal") == 1), 0.2).otherwise(0.0)
    out = base.filter("file_id % 5 <> 2 OR ordinal = 0").withColumn("pts_sec", F.col("pts_sec") - 5 + late)
    cols = ["file_id", "kind", "ordinal"]
    return candidates.reconcile_streams(
        base.select(*cols, F.lit(5.0).alias("start_sec")).distinct(), out.select(*cols).distinct(), base, out, ["file_id"]
    )


@query(
    "a12_reconcile_chapters",
    """
    SELECT user_id AS file_id, count(*)::BIGINT AS chapters, count(*) FILTER (WHERE event_id % 11 = 0 OR event_id % 13 = 0)::BIGINT AS different,
      count(*) FILTER (WHERE event_id % 11 = 0 OR event_id % 13 = 0) = 0 AS ok FROM events GROUP BY user_id
    """,
)
def chapters(t):
    base = table(t.spark, t.sf_dir, "events").select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("ordinal"), F.lit(2.0).alias("start_sec"),
        (2.0 + F.col("event_id")).alias("chapter_start"), (3.0 + F.col("event_id")).alias("chapter_end"), F.col("event_type").alias("title"),
    )
    out = base.select(
        "file_id", "ordinal", (F.col("chapter_start") - 2 + F.when(F.col("ordinal") % 11 == 0, 0.01).otherwise(0.001)).alias("chapter_start"),
        (F.col("chapter_end") - 2).alias("chapter_end"), F.when(F.col("ordinal") % 13 != 0, F.col("title")).alias("title"),
    )
    return candidates.reconcile_chapters(base, out, ["file_id"])


@query(
    "a13_shot_candidate_summary",
    """
    WITH m AS (SELECT title_id, shot_idx, bitrate_bps, sum(mean * frames) / sum(frames) AS mean_vmaf, min(worst) AS worst_1s_vmaf, sum(bytes) AS b, sum(frames)::BIGINT AS f
      FROM (SELECT l_suppkey AS title_id, l_linenumber AS shot_idx, CAST(floor(l_quantity / 10) AS BIGINT) AS bitrate_bps, (30 + l_partkey % 5)::BIGINT AS frames,
        80 + l_tax * 100 AS mean, 70 + l_tax * 100 AS worst, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM lineitem) x GROUP BY 1, 2, 3)
    SELECT title_id, shot_idx, bitrate_bps, round(mean_vmaf, 6) AS mean_vmaf, worst_1s_vmaf,
      CAST(ceil(b::DOUBLE / f * n * CASE WHEN f = n THEN 1.0::DOUBLE ELSE 1.10::DOUBLE END) AS BIGINT) AS bytes, f AS measured_frames, f = n AS holdout_verified
    FROM (SELECT *, CASE WHEN title_id % 2 = 0 THEN 900 ELSE 32 END AS n FROM m) y
    """,
)
def shot_summary(t):
    rows = table(t.spark, t.sf_dir, "lineitem").selectExpr(
        "l_suppkey AS title_id", "l_linenumber AS shot_idx", "CAST(floor(l_quantity / 10) AS BIGINT) AS bitrate_bps",
        "30 + l_partkey % 5 AS frames", "80 + l_tax * 100 AS mean", "70 + l_tax * 100 AS worst_1s",
        "CAST(floor(l_extendedprice) AS BIGINT) AS bytes",
    )
    shots = rows.select("title_id", "shot_idx").distinct().selectExpr(
        "title_id", "shot_idx", "100 AS start_frame", "100 + CASE WHEN title_id % 2 = 0 THEN 900 ELSE 32 END AS end_frame"
    )
    out = candidates.shot_candidate_summary(rows, shots)
    return out.withColumn("mean_vmaf", F.round("mean_vmaf", 6))
