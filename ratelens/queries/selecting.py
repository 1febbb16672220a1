"""Q01-Q20: rate-quality selection, prediction, allocation and verification."""

from pyspark.sql import functions as F

from ratelens.bindings import table
from ratelens.operators import allocation, candidates, prediction, selection, verification
from ratelens.operators.intervals import shots_from_cuts
from ratelens.plans.ordered import position, value_chunk
from ratelens.queries.registry import query

# --- inputs shared by several queries --------------------------------------------

_INFO_SQL = """
    info AS (SELECT source_id, 600.0::DOUBLE + source_id AS total_sec, (64000 * (1 + source_id % 3))::BIGINT AS audio_bitrate_bps,
      (200000000 + 1000000 * source_id)::BIGINT AS source_bytes FROM (SELECT DISTINCT source_id FROM trials) d)
"""


def _info(t):
    return t.trials.select("source_id").distinct().selectExpr(
        "source_id", "600.0D + source_id AS total_sec", "64000 * (1 + source_id % 3) AS audio_bitrate_bps",
        "200000000 + 1000000 * source_id AS source_bytes",
    )


# A candidate's size: its worst window's bitrate over the whole length.
_CANDS_SQL = _INFO_SQL + """,
    cands AS (SELECT t.source_id, bitrate_bps, gate, CAST(ceil((obs + audio_bitrate_bps) * total_sec / 8 / 0.98::DOUBLE) AS BIGINT) AS predicted_bytes,
        CAST(ceil((obs + audio_bitrate_bps) * total_sec / 8 / 0.98::DOUBLE) AS BIGINT) / source_bytes AS predicted_ratio
      FROM (SELECT source_id, bitrate_bps, min(gate) AS gate, max(CAST(ceil(encoded_bytes * 8 / duration_sec) AS BIGINT)) AS obs FROM trials GROUP BY 1, 2) t
      JOIN info ON info.source_id = t.source_id),
    lim AS (SELECT source_id, 75 + source_id % 40 AS target, 0.4::DOUBLE AS margin, (250000 * (1 + source_id % 4))::BIGINT AS min_video_bps,
        (source_id % 5) * 4000000 AS cap, CAST(floor(source_bytes * (1 + source_id % 9) / 10::DOUBLE) AS BIGINT) AS max_output_bytes,
        (CASE WHEN source_id % 11 = 0 THEN 200000 ELSE 3000000 END)::BIGINT AS max_video_bps, source_bytes FROM info)
"""


def _cands(t):
    c = candidates.candidate_summary(t.trials).join(_info(t), "source_id")
    size = F.ceil((F.col("max_observed_bps") + F.col("audio_bitrate_bps")) * F.col("total_sec") / 8 / 0.98).cast("long")
    return c.select("source_id", "bitrate_bps", "gate", size.alias("predicted_bytes"), (size / F.col("source_bytes")).alias("predicted_ratio"))


def _limits(t):
    return _info(t).selectExpr(
        "source_id", "75 + source_id % 40 AS target", "0.4D AS margin", "250000 * (1 + source_id % 4) AS min_video_bps",
        "source_id % 5 * 4000000 AS max_kbps_bps", "CAST(floor(source_bytes * (1 + source_id % 9) / 10.0D) AS BIGINT) AS max_output_bytes",
        "CAST(CASE WHEN source_id % 11 = 0 THEN 200000 ELSE 3000000 END AS BIGINT) AS max_video_bps", "source_bytes",
    )


def _select_sql(n: str = "") -> str:
    """The selection over the limits ``lim{n}``, as CTEs up to ``sl{n}``."""
    return f"""
    el{n} AS (SELECT l.source_id, bitrate_bps, gate, predicted_bytes, predicted_ratio, gate >= target AS pass, predicted_bytes <= max_output_bytes AS fit, gate >= target + margin AS pref
      FROM lim{n} l JOIN cands c ON c.source_id = l.source_id AND bitrate_bps >= min_video_bps AND (cap = 0 OR bitrate_bps <= cap)),
    ag{n} AS (SELECT source_id, coalesce(min(bitrate_bps) FILTER (WHERE pass AND fit AND pref), min(bitrate_bps) FILTER (WHERE pass AND fit)) AS ch,
      min(bitrate_bps) FILTER (WHERE pass) AS req, max(gate) FILTER (WHERE fit) AS bg FROM el{n} GROUP BY 1),
    bf{n} AS (SELECT el{n}.source_id, min(bitrate_bps) AS bf FROM el{n} JOIN ag{n} ON ag{n}.source_id = el{n}.source_id AND fit AND gate = bg GROUP BY 1),
    pk{n} AS (SELECT l.*, max_video_bps < min_video_bps AS tight, ch, req, bf, bg, r.predicted_bytes AS rb, r.predicted_ratio AS rr, coalesce(ch, req, bf) AS sel
      FROM lim{n} l LEFT JOIN ag{n} ON ag{n}.source_id = l.source_id LEFT JOIN bf{n} ON bf{n}.source_id = l.source_id LEFT JOIN cands r ON r.source_id = l.source_id AND r.bitrate_bps = req),
    sl{n} AS (SELECT pk{n}.source_id, CASE WHEN NOT tight AND ch IS NOT NULL THEN 'found' ELSE 'constraint_unsatisfied' END AS status,
      CASE WHEN tight THEN 'media_budget_too_small' WHEN ch IS NOT NULL THEN NULL WHEN rb > pk{n}.max_output_bytes THEN 'size_blocked' ELSE 'quality_unreachable' END AS failure_kind,
      CASE WHEN tight THEN 0 ELSE coalesce(sel, 0) END::BIGINT AS selected_bps, CASE WHEN NOT tight THEN s.gate END AS gate,
      CASE WHEN NOT tight THEN s.predicted_bytes END AS predicted_bytes, CASE WHEN NOT tight AND ch IS NULL THEN rr END AS required_ratio,
      CASE WHEN NOT tight AND ch IS NULL THEN req END AS required_bps, CASE WHEN NOT tight THEN bf END AS best_fit_bps, CASE WHEN NOT tight THEN bg END AS best_fit_gate
      FROM pk{n} LEFT JOIN cands s ON s.source_id = pk{n}.source_id AND s.bitrate_bps = sel)
"""


_SELECT_SQL = _select_sql()



@query(
    "q01_predict_size",
    f"""
    WITH {_INFO_SQL}, x AS (SELECT t.source_id, bitrate_bps, window_id, least(4, greatest(0.0001, CAST(ceil(encoded_bytes * 8 / duration_sec) AS BIGINT) / bitrate_bps))::DOUBLE AS y, risk AS x
        FROM trials t JOIN rk ON rk.source_id = t.source_id AND rk.w = t.window_id),
    pr AS (SELECT a.source_id, a.bitrate_bps, median((b.y - a.y) / (b.x - a.x)) AS m FROM x a JOIN x b ON a.source_id = b.source_id AND a.bitrate_bps = b.bitrate_bps AND a.window_id < b.window_id
        AND abs(b.x - a.x) > 1e-9 GROUP BY 1, 2),
    sl AS (SELECT x.*, (CASE WHEN m IS NULL THEN 0 ELSE least(0.75, greatest(-0.75, m)) END)::DOUBLE AS s FROM x LEFT JOIN pr ON pr.source_id = x.source_id AND pr.bitrate_bps = x.bitrate_bps),
    ic AS (SELECT source_id, bitrate_bps, count(*)::INTEGER AS windows, max(s) AS s, median(y - s * x) AS i FROM sl GROUP BY 1, 2),
    tl AS (SELECT ic.source_id, ic.bitrate_bps, avg(least(4, greatest(0.0001, i + s * risk))) AS c, stddev_pop(risk) AS sd FROM ic JOIN rk ON rk.source_id = ic.source_id GROUP BY 1, 2),
    md AS (SELECT x.source_id, x.bitrate_bps, median(abs(y - least(4, greatest(0.0001, i + s * x)))) AS mad FROM x JOIN ic ON ic.source_id = x.source_id AND ic.bitrate_bps = x.bitrate_bps GROUP BY 1, 2),
    un AS (SELECT ic.source_id, ic.bitrate_bps, windows, greatest(1, CAST(round_even(ic.bitrate_bps * c, 0) AS BIGINT)) AS mean_bps,
        least(0.30, greatest(0.05, 0.03 + 0.14 / sqrt(windows) + 1.5 * mad + 0.20 * sd))::DOUBLE AS u FROM ic JOIN tl ON tl.source_id = ic.source_id AND tl.bitrate_bps = ic.bitrate_bps
        JOIN md ON md.source_id = ic.source_id AND md.bitrate_bps = ic.bitrate_bps),
    up AS (SELECT *, greatest(mean_bps, CAST(round_even(mean_bps * (1 + u), 0) AS BIGINT)) AS upper_bps FROM un)
    SELECT source_id, bitrate_bps, windows, CAST(floor((mean_bps + 37) / 100) AS BIGINT) AS mean_video_100bps, CAST(floor((upper_bps + 37) / 100) AS BIGINT) AS upper_video_100bps,
      round(u, 9) AS uncertainty, 'risk_distribution_clipped_theil_sen' AS method FROM up
    """.replace("WITH ", "WITH rk AS (SELECT l_suppkey AS source_id, l_linenumber AS w, round(10 * max(l_discount) + count(*) % 7 / 50 + l_linenumber * 0.0137131::DOUBLE, 9) AS risk FROM lineitem GROUP BY 1, 2), ", 1),
    uses="trials",
)
def predict(t):
    # Sums over the timeline differ in the last bits between engines, so rates are shown in hundreds, cut where no exact value lies.
    out = prediction.predict_size(t.trials, _info(t), _risks(t))
    return out.select(
        "source_id", "bitrate_bps", "windows", F.floor((F.col("mean_video_bps") + 37) / 100).alias("mean_video_100bps"),
        F.floor((F.col("upper_video_bps") + 37) / 100).alias("upper_video_100bps"), F.round("uncertainty", 9).alias("uncertainty"), "method",
    )


def _risks(t):
    return table(t.spark, t.sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("window_id")).agg(
        F.round(10 * F.max("l_discount") + F.count(F.lit(1)) % 7 / 50 + F.col("window_id") * 0.0137131, 9).alias("risk")
    )


@query(
    "q01_predict_size_median",
    f"""
    WITH {_INFO_SQL}, x AS (SELECT source_id, bitrate_bps, least(4, greatest(0.0001, CAST(ceil(encoded_bytes * 8 / duration_sec) AS BIGINT) / bitrate_bps))::DOUBLE AS y FROM trials),
    c AS (SELECT source_id, bitrate_bps, median(y) AS c, count(*)::INTEGER AS windows FROM x GROUP BY 1, 2),
    m AS (SELECT x.source_id, x.bitrate_bps, median(abs(y - c)) AS mad FROM x JOIN c ON c.source_id = x.source_id AND c.bitrate_bps = x.bitrate_bps GROUP BY 1, 2),
    u AS (SELECT c.*, greatest(1, CAST(round_even(c.bitrate_bps * c, 0) AS BIGINT)) AS mean_bps, least(0.30, greatest(0.05, 0.03 + 0.14 / sqrt(windows) + 1.5 * mad))::DOUBLE AS u
      FROM c JOIN m ON m.source_id = c.source_id AND m.bitrate_bps = c.bitrate_bps),
    up AS (SELECT *, greatest(mean_bps, CAST(round_even(mean_bps * (1 + u), 0) AS BIGINT)) AS upper_bps FROM u)
    SELECT up.source_id, bitrate_bps, windows, mean_bps AS mean_video_bps, upper_bps AS upper_video_bps, CAST(ceil((upper_bps + audio_bitrate_bps) * total_sec / 8 / 0.98::DOUBLE) AS BIGINT) AS predicted_bytes,
      round(u, 9) AS uncertainty, 'robust_median_window_ratio' AS method FROM up JOIN info ON info.source_id = up.source_id
    """,
    uses="trials",
)
def predict_median(t):
    out = prediction.predict_size(t.trials, _info(t))
    return out.drop("predicted_ratio").withColumn("uncertainty", F.round("uncertainty", 9))


@query(
    "q02_refresh_predictions",
    f"""
    WITH {_INFO_SQL}, x AS (SELECT source_id, bitrate_bps, max(CAST(ceil(encoded_bytes * 8 / duration_sec) AS BIGINT)) AS upper FROM trials GROUP BY 1, 2)
    SELECT x.source_id, bitrate_bps, CAST(ceil((upper + audio_bitrate_bps) * total_sec / 8 / 0.98::DOUBLE) AS BIGINT) AS predicted_bytes,
      round(CAST(ceil((upper + audio_bitrate_bps) * total_sec / 8 / 0.98::DOUBLE) AS BIGINT) / source_bytes, 9) AS predicted_ratio FROM x JOIN info ON info.source_id = x.source_id
    """,
    uses="trials",
)
def refresh(t):
    stored = candidates.candidate_summary(t.trials).select("source_id", "bitrate_bps", F.col("max_observed_bps").alias("upper_video_bps"))
    out = prediction.refresh_predictions(stored, _info(t))
    return out.select("source_id", "bitrate_bps", "predicted_bytes", F.round("predicted_ratio", 9).alias("predicted_ratio"))


@query(
    "q03_select_candidate",
    f"WITH {_CANDS_SQL}, {_SELECT_SQL} SELECT source_id, status, failure_kind, selected_bps, gate, predicted_bytes, round(required_ratio, 9) AS required_ratio, required_bps, best_fit_bps, best_fit_gate FROM sl",
    uses="trials",
)
def select(t):
    out = selection.select_candidate(_cands(t), _limits(t))
    return out.drop("predicted_ratio", "max_output_bytes").withColumn("required_ratio", F.round("required_ratio", 9))


@query(
    "q04_threshold_bitrate",
    """
    WITH c AS (SELECT source_id, bitrate_bps AS b, min(gate) AS g, lead(bitrate_bps) OVER w AS nb, lead(min(gate)) OVER w AS ng FROM trials GROUP BY 1, 2 WINDOW w AS (PARTITION BY source_id ORDER BY bitrate_bps))
    SELECT source_id, coalesce(arg_min(CASE WHEN ng - g <= 1e-9 THEN nb ELSE CAST(round_even(b + (80 - g) / (ng - g) * (nb - b), 0) AS BIGINT) END, b) FILTER (WHERE g < 80 AND ng >= 80),
      min(b) FILTER (WHERE g >= 80)) AS threshold_bps FROM c GROUP BY source_id
    """,
    uses="trials",
)
def threshold(t):
    return selection.threshold_bitrate(candidates.candidate_summary(t.trials), F.lit(80.0))


@query(
    "q05_search_bounds",
    f"""
    WITH {_CANDS_SQL}, e AS (SELECT l.source_id, min_video_bps, max_video_bps, max(bitrate_bps) FILTER (WHERE gate < target) AS f, min(bitrate_bps) FILTER (WHERE gate >= target) AS p
      FROM lim l JOIN cands c ON c.source_id = l.source_id GROUP BY 1, 2, 3)
    SELECT source_id, CASE WHEN p IS NULL THEN min_video_bps ELSE greatest(min_video_bps, coalesce(f, min_video_bps)) END AS lower_bps, coalesce(p, max_video_bps) AS seed_bps,
      CASE WHEN p IS NULL THEN 9000000 ELSE greatest(p, 9000000) END::BIGINT AS upper_bps FROM e
    """,
    uses="trials",
)
def bounds(t):
    limits = _limits(t).withColumn("ceiling_bps", F.lit(9_000_000).cast("long"))
    return selection.search_bounds(_cands(t), limits)


# A partly measured table: which of a source's candidates have been tried, the budget and the limits more often.
_MEASURED = (
    "(CAST(bitrate_bps / 250000 AS BIGINT) * 7 + source_id * 13) % 17 < 1 "
    "OR bitrate_bps IN (250000, 3000000, 12500000) AND (CAST(bitrate_bps / 250000 AS BIGINT) + source_id) % 3 > 0"
)


@query(
    "q06_propose_next",
    f"""
    WITH {_CANDS_SQL},
    m AS (SELECT * FROM cands WHERE {_MEASURED}),
    b AS (SELECT source_id, target, greatest(1000, max_video_bps // 1000 * 1000) AS bud, greatest(1000, CAST(ceil(min_video_bps / 1000) * 1000 AS BIGINT)) AS flo, greatest(12500000, max_video_bps) // 1000 * 1000 AS cei FROM lim),
    s AS (SELECT b.source_id, bud, flo, cei, count(bitrate_bps)::BIGINT AS trials, bool_or(gate >= target) FILTER (WHERE bitrate_bps = bud) AS ab, bool_or(gate >= target) FILTER (WHERE bitrate_bps = flo) AS af,
      bool_or(gate >= target) FILTER (WHERE bitrate_bps = cei) AS ac, min(bitrate_bps) FILTER (WHERE gate >= target) AS hi FROM b LEFT JOIN m ON m.source_id = b.source_id GROUP BY 1, 2, 3, 4),
    l AS (SELECT s.*, (SELECT max(bitrate_bps) FROM m JOIN b ON b.source_id = m.source_id WHERE m.source_id = s.source_id AND gate < target AND bitrate_bps < hi) AS lo FROM s),
    k AS (SELECT *, greatest(CASE WHEN ab THEN flo ELSE bud END, coalesce(lo, CASE WHEN ab THEN flo ELSE bud END)) AS low FROM l),
    n AS (SELECT *, CASE WHEN ab IS NULL THEN bud WHEN ab AND af IS NULL THEN flo WHEN ab AND af THEN NULL WHEN NOT ab AND ac IS NULL THEN cei WHEN NOT ab AND NOT ac THEN NULL
      WHEN hi - low > 50000 THEN greatest(1000, ((low + hi) // 2) // 1000 * 1000) END AS nx FROM k)
    SELECT source_id, trials, CASE WHEN trials < 8 AND NOT EXISTS (SELECT 1 FROM m WHERE m.source_id = n.source_id AND m.bitrate_bps = nx) THEN nx END::BIGINT AS next_bps FROM n
    """,
    uses="trials",
)
def propose(t):
    limits = _limits(t).select(
        "source_id", "target", "min_video_bps", "max_video_bps", F.lit(12_500_000).cast("long").alias("ceiling_bps"), F.lit(50_000).alias("tolerance_bps")
    )
    some = _cands(t).filter(_MEASURED)
    return selection.propose_next(some, limits)


@query(
    "q06_propose_next_for_shots",
    """
    WITH m AS (SELECT title_id, shot_idx, (cand_id * 750000 + 750000)::BIGINT AS b, mean_vmaf AS g, 86 + title_id % 6 AS target FROM shot_candidates),
    l AS (SELECT *, lead(b) OVER w AS nb, lead(g) OVER w AS ng FROM m WINDOW w AS (PARTITION BY title_id, shot_idx ORDER BY b)),
    a AS (SELECT title_id, shot_idx, count(*)::BIGINT AS trials, arg_min((b + nb) // 2000 * 1000, b) FILTER (WHERE g < target AND ng >= target) AS mid,
        max(g) < max(target) AS short, least(6000000, max(b) * 2) AS dbl, greatest(250000, min(b) // 2000 * 1000) AS half FROM l GROUP BY 1, 2),
    st AS (SELECT a.title_id, a.shot_idx, min(s.b) AS b FROM a CROSS JOIN (VALUES (750000), (1500000), (3000000)) s(b)
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.title_id = a.title_id AND m.shot_idx = a.shot_idx AND m.b = s.b) GROUP BY 1, 2),
    n AS (SELECT a.*, coalesce(st.b, mid, CASE WHEN short THEN dbl ELSE half END) AS nx FROM a LEFT JOIN st ON st.title_id = a.title_id AND st.shot_idx = a.shot_idx)
    SELECT title_id, shot_idx, trials, CASE WHEN trials < 7 AND NOT EXISTS (SELECT 1 FROM m WHERE m.title_id = n.title_id AND m.shot_idx = n.shot_idx AND m.b = nx) THEN nx END::BIGINT AS next_bps FROM n
    """,
    uses="shot_candidates",
)
def propose_shots(t):
    m = t.shot_candidates.select("title_id", "shot_idx", (F.col("cand_id") * 750_000 + 750_000).cast("long").alias("bitrate_bps"), F.col("mean_vmaf").alias("gate"))
    limits = m.select("title_id", "shot_idx").distinct().selectExpr(
        "title_id", "shot_idx", "CAST(86 + title_id % 6 AS DOUBLE) AS target", "CAST(1500000 AS BIGINT) AS base_bps", "CAST(250000 AS BIGINT) AS min_video_bps",
        "CAST(6000000 AS BIGINT) AS ceiling_bps",
    )
    return selection.propose_next_for_shots(m, limits, max_trials=7)


@query(
    "q07_nonmonotone_points",
    """
    SELECT source_id, b AS lower_bps, g AS lower_gate, nb AS higher_bps, ng AS higher_gate FROM (SELECT source_id, bitrate_bps AS b, min(gate) AS g, lead(bitrate_bps) OVER w AS nb, lead(min(gate)) OVER w AS ng
      FROM trials GROUP BY 1, 2 WINDOW w AS (PARTITION BY source_id ORDER BY bitrate_bps)) c WHERE ng < g - 0.5
    """,
    uses="trials",
)
def nonmonotone(t):
    return selection.nonmonotone_points(candidates.candidate_summary(t.trials))


@query(
    "q07_remeasure_points",
    """
    WITH c AS (SELECT source_id, bitrate_bps AS b, min(gate) AS g, lead(min(gate)) OVER (PARTITION BY source_id ORDER BY bitrate_bps) AS ng FROM trials GROUP BY 1, 2)
    SELECT source_id, b AS bitrate_bps FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY abs(g - 80), b) AS rn, bool_or(ng < g - 0.5) OVER (PARTITION BY source_id) AS odd FROM c) x WHERE rn = 1 AND odd
    """,
    uses="trials",
)
def remeasure(t):
    return selection.remeasure_points(candidates.candidate_summary(t.trials), F.lit(80.0))


@query(
    "q08_oracle_grid",
    """
    SELECT DISTINCT source_id, greatest(1000, CAST(round_even((lo + i * (hi - lo) / 7::DOUBLE) / 1000, 0) * 1000 AS BIGINT))::BIGINT AS bitrate_bps
    FROM (SELECT source_id, 250000::BIGINT AS lo, source_bytes // 60 AS hi, unnest(range(8)) AS i FROM sources) x
    """,
    uses="sources",
)
def grid(t):
    limits = t.sources.select("source_id", F.lit(250_000).cast("long").alias("min_video_bps"), F.expr("source_bytes div 60").alias("ceiling_bps"))
    return selection.oracle_grid(limits)


@query(
    "q08_oracle_bracket",
    """
    WITH p AS (SELECT source_id, bitrate_bps AS b, min(gate) >= 72 + source_id % 25 AS ok FROM trials GROUP BY 1, 2),
    e AS (SELECT source_id, count(*)::BIGINT AS points, min(b) FILTER (WHERE ok) AS up, max(b) FILTER (WHERE NOT ok) AS tf FROM p GROUP BY 1),
    f AS (SELECT e.*, CASE WHEN up IS NULL THEN tf ELSE (SELECT max(b) FROM p WHERE p.source_id = e.source_id AND NOT ok AND b < up) END AS lo FROM e)
    SELECT source_id, points, lo AS lower_bps, up AS upper_bps, coalesce(tf > up, false) AS monotonicity_violated,
      CASE WHEN up - lo > 20000 THEN CAST(round_even(((lo + up) // 2) / 1000, 0) * 1000 AS BIGINT) END AS bisect_bps FROM f
    """,
    uses="trials",
)
def bracket(t):
    points = candidates.candidate_summary(t.trials).withColumn("passed", F.col("gate") >= 72 + F.col("source_id") % 25)
    return selection.oracle_bracket(points)


@query(
    "q09_baseline_pick",
    """
    WITH p AS (SELECT source_id, bitrate_bps, min(gate) AS gate, sum(encoded_bytes)::BIGINT AS bytes FROM trials GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY bytes, bitrate_bps) AS rn FROM p WHERE gate >= 72 + source_id % 25)
    SELECT s.source_id, CASE WHEN rn IS NULL THEN 'no_passing_measured_point' ELSE 'measured' END AS status, bitrate_bps, gate, bytes FROM (SELECT DISTINCT source_id FROM p) s LEFT JOIN r ON r.source_id = s.source_id AND rn = 1
    """,
    uses="trials",
)
def baseline(t):
    points = candidates.candidate_summary(t.trials).withColumn("passed", F.col("gate") >= 72 + F.col("source_id") % 25)
    return selection.baseline_pick(points.withColumnRenamed("encoded_bytes", "bytes"))


@query(
    "q10_pareto",
    """
    SELECT title_id, shot_idx, cand_id, bytes, round(mean_vmaf, 6) AS mean_vmaf FROM (SELECT *, max(mean_vmaf) OVER (PARTITION BY title_id, shot_idx ORDER BY bytes, mean_vmaf DESC, cand_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM shot_candidates WHERE mean_vmaf >= 86 AND worst_1s_vmaf >= 82) x WHERE best IS NULL OR mean_vmaf > best
    """,
    uses="shot_candidates",
)
def pareto(t):
    out = allocation.pareto(t.shot_candidates, ["title_id", "shot_idx"], F.lit(90.0))
    return out.select("title_id", "shot_idx", "cand_id", "bytes", F.round("mean_vmaf", 6).alias("mean_vmaf"))


# Cheapest size per reachable quality, shot after shot: r has the k-th shot's candidates above the floors.
_SHOTS = 7
_STEP = """
    s{k} AS (SELECT title_id, bytes, q FROM (SELECT *, max(q) OVER (PARTITION BY title_id ORDER BY bytes, q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
      FROM (SELECT s.title_id, s.bytes + r.bytes AS bytes, s.q + r.q AS q FROM s{p} s JOIN r ON r.title_id = s.title_id AND r.k = {k} JOIN bud ON bud.title_id = s.title_id AND s.bytes + r.bytes <= budget
        UNION ALL SELECT s.* FROM s{p} s JOIN n ON n.title_id = s.title_id AND n.n < {k}) u) v WHERE best IS NULL OR q > best)"""
_PATHS_SQL = """
    sc AS (SELECT *, mean_vmaf * frames AS q, dense_rank() OVER (PARTITION BY title_id ORDER BY shot_idx) AS k FROM shot_candidates),
    n AS (SELECT title_id, count(*) AS n, sum(f) AS total FROM (SELECT title_id, shot_idx, max(frames) AS f FROM sc GROUP BY 1, 2) x GROUP BY 1),
    bud AS (SELECT title_id, CAST(floor(sum(m) * (1 + title_id % 5 / 10::DOUBLE)) AS BIGINT) AS budget FROM (SELECT title_id, shot_idx, max(bytes) / 3 AS m FROM shot_candidates GROUP BY 1, 2) x GROUP BY title_id),
    r AS (SELECT * FROM sc WHERE mean_vmaf >= 86 AND worst_1s_vmaf >= 82),
    s0 AS (SELECT title_id, 0::BIGINT AS bytes, 0::DOUBLE AS q FROM n),""" + ",".join(
    _STEP.format(k=k, p=k - 1) for k in range(1, _SHOTS + 1)
) + f""",
    best AS (SELECT s.title_id, min(bytes)::BIGINT AS bytes, max(n)::BIGINT AS shots FROM s{_SHOTS} s JOIN n ON n.title_id = s.title_id WHERE q / total >= 90 GROUP BY 1)
"""


def _titles(t, target=90.0):
    per_shot = t.shot_candidates.groupBy("title_id", "shot_idx").agg((F.max("bytes") / 3).alias("m"))
    budget = F.floor(F.sum("m") * (1 + F.col("title_id") % 5 / 10.0)).cast("long")
    return per_shot.groupBy("title_id").agg(budget.alias("budget")).withColumn("target", F.lit(target))


@query(
    "q11_allocate_budget",
    f"WITH {_PATHS_SQL} SELECT title_id, bytes AS video_bytes, false AS approximate FROM best",
    uses="shot_candidates",
)
def allocate(t):
    out, _ = allocation.allocate_budget(t.shot_candidates, _titles(t))
    return out.select("title_id", "video_bytes", "approximate")


@query(
    "q11_allocation_picks",
    f"WITH {_PATHS_SQL} SELECT title_id, bytes AS picked_bytes, shots, true AS reaches_target FROM best",
    uses="shot_candidates",
)
def picks(t):
    sc = t.shot_candidates
    _, chosen = allocation.allocate_budget(sc, _titles(t))
    rows = chosen.join(sc, ["title_id", "shot_idx", "cand_id"])
    out = rows.groupBy("title_id").agg(
        F.sum("bytes").alias("picked_bytes"), F.count(F.lit(1)).alias("shots"), (F.sum(F.col("mean_vmaf") * F.col("frames")) / F.sum("frames")).alias("m")
    )
    return out.select("title_id", "picked_bytes", "shots", (F.col("m") >= 90 - 1e-9).alias("reaches_target"))


# Every distinct cap (highest grid step whose floors a candidate meets; 900 is the target itself) is solved on its own.
_CAPS_SQL = """
    sc AS (SELECT *, mean_vmaf * frames AS q, dense_rank() OVER (PARTITION BY title_id ORDER BY shot_idx) AS k,
      list_max(list_filter(range(0, 901), lambda x: mean_vmaf >= greatest(0, x / 10::DOUBLE - 4) AND worst_1s_vmaf >= greatest(0, x / 10::DOUBLE - 8))) AS cap FROM shot_candidates),
    n AS (SELECT title_id, count(*) AS n, sum(f) AS total FROM (SELECT title_id, shot_idx, max(frames) AS f FROM sc GROUP BY 1, 2) x GROUP BY 1),
    bud AS (SELECT title_id, CAST(b * (4 + title_id % 20) / 100 AS BIGINT) AS budget FROM (
      SELECT title_id, CAST(floor(sum(m) * (1 + title_id % 5 / 10::DOUBLE)) AS BIGINT) AS b FROM (SELECT title_id, shot_idx, max(bytes) / 3 AS m FROM shot_candidates GROUP BY 1, 2) x GROUP BY title_id)),
    caps AS (SELECT DISTINCT title_id, cap AS step FROM sc WHERE cap IS NOT NULL),
    r AS (SELECT sc.title_id, step, k, bytes, q FROM sc JOIN caps ON caps.title_id = sc.title_id AND cap >= step),
    s0 AS (SELECT title_id, step, 0::BIGINT AS bytes, 0::DOUBLE AS q FROM caps),""" + ",".join(
    """
    s{k} AS (SELECT title_id, step, bytes, q FROM (SELECT *, max(q) OVER (PARTITION BY title_id, step ORDER BY bytes, q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
      FROM (SELECT s.title_id, s.step, s.bytes + r.bytes AS bytes, s.q + r.q AS q FROM s{p} s JOIN r ON r.title_id = s.title_id AND r.step = s.step AND r.k = {k}
          JOIN bud ON bud.title_id = s.title_id AND (s.step = 900 OR s.bytes + r.bytes <= budget)
        UNION ALL SELECT s.* FROM s{p} s JOIN n ON n.title_id = s.title_id AND n.n < {k}) u) v WHERE best IS NULL OR q > best)""".format(k=k, p=k - 1)
    for k in range(1, _SHOTS + 1)
) + f""",
    ends AS (SELECT title_id, step, bytes, q / total AS mean FROM s{_SHOTS} JOIN n USING (title_id)),
    need AS (SELECT title_id, min(bytes) AS need FROM ends WHERE step = 900 AND mean >= 90 - 1e-9 GROUP BY 1),
    fit AS (SELECT title_id, max(least(step, 900, list_max(list_filter(range(0, 901), lambda x: mean >= x / 10::DOUBLE - 1e-9)))) AS step FROM ends JOIN bud USING (title_id) WHERE bytes <= budget GROUP BY 1)
"""


@query(
    "q12_relax_target",
    f"""
    WITH {_CAPS_SQL}
    SELECT title_id, CASE WHEN need IS NOT NULL THEN 'size_blocked' WHEN budget <= 0 THEN 'media_budget_too_small' ELSE 'quality_unreachable' END AS failure_kind,
      CASE WHEN need IS NOT NULL THEN round(greatest(1000 / 1000000::DOUBLE, ceil((need + 1000) / 0.98::DOUBLE) / 1000000::DOUBLE), 9) END AS required_ratio,
      CASE WHEN need IS NOT NULL AND step >= 0 THEN step / 10::DOUBLE END AS relaxed_target
    FROM bud LEFT JOIN need USING (title_id) LEFT JOIN fit USING (title_id) WHERE need IS NULL OR need > budget
    """,
    uses="shot_candidates",
)
def relax(t):
    # The SQL's cast of a double rounds, ties to even; Spark's would cut.
    titles = _titles(t).selectExpr(
        "title_id", "target", "CAST(bround(budget * (4 + title_id % 20) / 100, 0) AS BIGINT) AS budget", "CAST(1000 AS BIGINT) AS audio_bytes", "CAST(1000 AS BIGINT) AS max_output_bytes", "CAST(1000000 AS BIGINT) AS source_bytes"
    )
    out = allocation.relax_target(t.shot_candidates, titles)
    return out.withColumn("required_ratio", F.round("required_ratio", 9))


_HELD_SQL = """
    sel AS (SELECT source_id, min(bitrate_bps) FILTER (WHERE gate >= 78) AS b FROM (SELECT source_id, bitrate_bps, min(gate) AS gate FROM trials WHERE window_id <= 4 GROUP BY 1, 2) x GROUP BY 1),
    h AS (SELECT t.source_id, t.bitrate_bps, window_id, gate, gate >= 78.5 AS passed FROM trials t JOIN sel ON sel.source_id = t.source_id AND b = bitrate_bps WHERE window_id > 4)
"""


def _held(t):
    search = candidates.candidate_summary(t.trials.filter("window_id <= 4"))
    sel = search.groupBy("source_id").agg(F.min(F.when(F.col("gate") >= 78, F.col("bitrate_bps"))).alias("selected_bps")).withColumn("target", F.lit(78.5))
    return verification.verify_holdouts(sel, t.trials.filter("window_id > 4"))


@query("q13_verify_holdouts", f"WITH {_HELD_SQL} SELECT * FROM h", uses="trials")
def holdouts(t):
    return _held(t)[0]


@query(
    "q13_holdout_verdict",
    f"WITH {_HELD_SQL} SELECT source_id, bool_and(passed) AS verified, min(gate) AS holdout_min_gate, count(*) FILTER (WHERE NOT passed)::BIGINT AS failed_holdouts FROM h GROUP BY 1",
    uses="trials",
)
def verdict(t):
    return _held(t)[1]


@query(
    "q13_fold_shot_holdouts",
    """
    SELECT title_id, shot_idx, cand_id, round(CASE WHEN u THEN (mean_vmaf * 48 + (mean_vmaf - 2) * 24) / 72 ELSE mean_vmaf END, 6) AS mean_vmaf,
      round(CASE WHEN u THEN least(worst_1s_vmaf, mean_vmaf - 9) ELSE worst_1s_vmaf END, 6) AS worst_1s_vmaf,
      CASE WHEN u THEN greatest(bytes, CAST(ceil((bytes // 3) / 24::DOUBLE * frames * 1.10::DOUBLE) AS BIGINT)) ELSE bytes END AS bytes,
      CASE WHEN u THEN 72 ELSE 48 END::BIGINT AS measured_frames, u OR cand_id = 1 AS holdout_verified, u AS changed
    FROM (SELECT *, cand_id <> 1 AND shot_idx % 2 = 0 AS u FROM shot_candidates) x
    """,
    uses="shot_candidates",
)
def fold(t):
    sc = t.shot_candidates
    selected = sc.select(
        "title_id", "shot_idx", "cand_id", "mean_vmaf", "worst_1s_vmaf", "bytes", F.lit(48).alias("measured_frames"), F.col("frames").alias("shot_frames"),
        (F.col("cand_id") == 1).alias("holdout_verified"),
    )
    held = sc.filter("shot_idx % 2 = 0").select(
        "title_id", "shot_idx", "cand_id", (F.col("mean_vmaf") - 2).alias("mean"), (F.col("mean_vmaf") - 9).alias("worst_1s"), F.lit(24).alias("frames"),
        F.expr("bytes div 3").alias("bytes"),
    )
    out = verification.fold_shot_holdouts(selected, held)
    return out.withColumn("mean_vmaf", F.round("mean_vmaf", 6)).withColumn("worst_1s_vmaf", F.round("worst_1s_vmaf", 6))


def _pooled_windows(t):
    """Each user's events as windows on one timeline: pool by position, every eighth one blind."""
    events = table(t.spark, t.sf_dir, "events")
    rows = position(value_chunk(events, ["user_id"], "event_id"), ["user_id"], ["event_id"], out="n")
    pool = F.element_at(F.array(*map(F.lit, ("search", "holdout", "reserve", "scout"))), (F.col("n") % 4 + 1).cast("int"))
    blind = (pool == "holdout") & (F.col("user_id") % 2 == 0)
    return rows.select(
        F.col("user_id").alias("source_id"), pool.alias("pool"), F.col("event_id").cast("string").alias("window_id"), (F.col("n") * 6.5).alias("start_sec"),
        F.lit(5.0).alias("duration_sec"), F.when(blind, F.array(F.lit("unscouted_validation"))).otherwise(F.array(F.lit("hardship"))).alias("reasons"),
        F.when(~blind, F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("scout_id"), "value",
    )


def _promotion(t):
    rows = _pooled_windows(t)
    totals = rows.groupBy("source_id").agg((F.max("start_sec") + F.when(F.col("source_id") % 4 == 0, 6.0).otherwise(30.0)).alias("total_sec"))
    failed = rows.filter("pool = 'holdout' AND (value > 40 OR source_id % 3 = 0)").select("source_id", "window_id")
    windows = rows.filter("pool <> 'scout'").drop("value")
    return verification.promote_failed(windows, failed, rows.filter("pool = 'scout'"), totals, sample_sec=7.0)


_PROMO_SQL = """
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
    w AS (SELECT user_id AS source_id, event_id, n, value, n % 4 AS p, n * 6.5::DOUBLE AS s FROM n),
    f AS (SELECT source_id, event_id FROM w WHERE p = 1 AND (value > 40 OR source_id % 3 = 0)),
    st AS (SELECT source_id, count(*) FILTER (WHERE p = 1) AS holds, count(*) FILTER (WHERE p = 1 AND event_id IN (SELECT event_id FROM f)) AS lost, count(*) FILTER (WHERE p = 2) AS reserves, max(s) AS mx FROM w GROUP BY 1),
    k AS (SELECT *, source_id % 2 = 0 AS blind, CASE WHEN source_id % 4 = 0 THEN NULL ELSE (mx + 5 + mx + 30 - 7) / 2 END AS gap_at FROM st WHERE lost > 0)
"""


@query(
    "q14_promote_failed",
    f"""WITH {_PROMO_SQL}
    SELECT w.source_id, CASE WHEN p = 1 AND w.event_id IN (SELECT event_id FROM f) THEN concat('search:promoted:', w.event_id) WHEN fr.event_id IS NOT NULL THEN concat('holdout:fresh:', w.event_id) ELSE w.event_id::VARCHAR END AS window_id,
      CASE WHEN p = 1 AND w.event_id IN (SELECT event_id FROM f) THEN 'search' WHEN fr.event_id IS NOT NULL THEN 'holdout' ELSE ['search', 'holdout', 'reserve'][p + 1] END AS pool, s AS start_sec
    FROM w JOIN k ON k.source_id = w.source_id LEFT JOIN (SELECT w.source_id, min(event_id) AS event_id FROM w JOIN k ON k.source_id = w.source_id WHERE p = 2 AND NOT blind AND lost = holds GROUP BY 1) fr ON fr.event_id = w.event_id
    WHERE p < 3
    UNION ALL SELECT source_id, 'holdout:unscouted:1', 'holdout', gap_at FROM k WHERE blind AND gap_at IS NOT NULL""",
)
def promote(t):
    return _promotion(t)[0].select("source_id", "window_id", "pool", "start_sec")


@query(
    "q14_promotion_status",
    f"""WITH {_PROMO_SQL} SELECT source_id, CASE WHEN (blind AND gap_at IS NULL) OR (NOT blind AND lost = holds AND reserves = 0) THEN 'failed' ELSE 'refine' END AS status,
      CASE WHEN blind AND gap_at IS NULL THEN 'unscouted validation space exhausted' WHEN NOT blind AND lost = holds AND reserves = 0 THEN 'reserve windows exhausted' END AS reason FROM k""",
)
def promotion_status(t):
    return _promotion(t)[1]


@query(
    "q15_calibration_windows",
    """
    WITH r AS (SELECT l_suppkey AS source_id, l_partkey AS id, round(max(l_discount) + max(l_extendedprice) / 1e6, 6) AS risk FROM lineitem GROUP BY 1, 2),
    m AS (SELECT source_id, risk AS med FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY risk) AS rn, count(*) OVER (PARTITION BY source_id) AS n FROM r) x WHERE rn = n // 2 + 1),
    c AS (SELECT r.source_id, r.id, id * 2.0::DOUBLE AS s, abs(risk - med) AS d, abs(id * 2 + 2.5 - 2000) AS e FROM r JOIN m ON m.source_id = r.source_id WHERE r.source_id % 3 = 0)
    SELECT source_id, pick::INTEGER AS pick, window_id, start_sec, 5.0::DOUBLE AS duration_sec FROM (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY d, e, s, concat('reserve:', id)) AS pick, concat('reserve:', id) AS window_id, s AS start_sec FROM c) x WHERE pick <= 2
    """,
)
def calibration(t):
    risk = table(t.spark, t.sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("window_id")).agg(
        F.round(F.max("l_discount") + F.max("l_extendedprice") / 1e6, 6).alias("difficulty")
    )
    reserves = risk.select(
        "source_id", F.concat(F.lit("reserve:"), "window_id").alias("window_id"), F.col("window_id").cast("string").alias("scout_id"),
        (F.col("window_id") * 2.0).alias("start_sec"), F.lit(5.0).alias("duration_sec"),
    )
    # Only every third source is near its limit: there the central estimate fits and the upper one does not.
    central = 1_000_000 * 4000.0 / 8 / 0.98
    blocked = risk.select("source_id").distinct().select(
        "source_id", F.lit(1_000_000).alias("mean_video_bps"), F.lit(0).alias("audio_bitrate_bps"), F.lit(4000.0).alias("total_sec"),
        F.lit(int(central * 1.2)).alias("predicted_bytes"), F.when(F.col("source_id") % 3 == 0, int(central * 1.1)).otherwise(int(central * 1.3)).alias("max_output_bytes"),
    )
    return verification.calibration_windows(reserves, risk, blocked)


@query(
    "q16_near_threshold_expand",
    """
    WITH s AS (SELECT source_id, min(gate) FILTER (WHERE gate >= 78) AS gate FROM (SELECT source_id, bitrate_bps, min(gate) AS gate FROM trials GROUP BY 1, 2) x GROUP BY 1),
    r AS (SELECT source_id, pool, window_id, start_sec, 1 + window_id % 3 AS n FROM intervals WHERE pool = 'reserve'),
    b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, start_sec, window_id) AS rn FROM r)
    SELECT s.source_id, concat('search:adaptive:', window_id) AS window_id, start_sec, gate AS selected_gate, (n + 1)::INTEGER AS reason_count FROM s JOIN b ON b.source_id = s.source_id AND rn = 1 WHERE gate - 78 < 0.7
    """,
    uses="trials intervals",
)
def expand(t):
    sel = candidates.candidate_summary(t.trials).groupBy("source_id").agg(F.min(F.when(F.col("gate") >= 78, F.col("gate"))).alias("gate"))
    sel = sel.withColumn("target", F.lit(78.0)).withColumn("status", F.when(F.col("gate").isNotNull(), "found").otherwise("constraint_unsatisfied"))
    reasons = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (1 + F.col("window_id") % 3).cast("int"))
    reserves = t.intervals.filter("pool = 'reserve'").select(
        "source_id", "window_id", "start_sec", "duration_sec", reasons.alias("reasons"), F.col("window_id").cast("string").alias("scout_id")
    )
    out = verification.near_threshold_expand(sel, reserves)
    return out.select("source_id", "window_id", "start_sec", "selected_gate", F.size("reasons").alias("reason_count"))


@query(
    "q17_final_gate",
    """
    WITH i AS (SELECT f.clip_id, f.frame_no, score, fps, sum(CASE WHEN f.frame_no > 0 AND scd_score >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY f.clip_id ORDER BY f.frame_no) AS shot
      FROM frame_scores f JOIN frame_metrics m ON m.clip_id = f.clip_id AND m.frame_no = f.frame_no),
    c AS (SELECT clip_id, count(*) AS n, avg(score) AS clip_mean, least(count(*), max(fps)) AS len, max(fps) AS fps FROM i GROUP BY 1),
    p AS (SELECT i.*, row_number() OVER (PARTITION BY i.clip_id, shot ORDER BY frame_no) - 1 AS pos, count(*) OVER (PARTITION BY i.clip_id, shot) AS k FROM i),
    q AS (SELECT *, least(k, fps) AS sz FROM p),
    r AS (SELECT clip_id, shot, k, pos, sz, score, avg(score) OVER (PARTITION BY clip_id, shot ORDER BY pos ROWS BETWEEN sz - 1 PRECEDING AND CURRENT ROW) AS m FROM q),
    sh AS (SELECT clip_id, shot, max(k)::BIGINT AS frames, avg(score) AS mean, min(m) FILTER (WHERE pos >= sz - 1) AS worst FROM r GROUP BY 1, 2),
    st AS (SELECT clip_id, shot, min(frame_no) AS s FROM i GROUP BY 1, 2),
    rl AS (SELECT i.clip_id, frame_no - len + 1 AS w, avg(score) OVER (PARTITION BY i.clip_id ORDER BY frame_no ROWS BETWEEN len - 1 PRECEDING AND CURRENT ROW) AS m, frame_no, len FROM i JOIN c ON c.clip_id = i.clip_id),
    bd AS (SELECT st.clip_id, shot - 1 AS shot, min(m) AS edge FROM st JOIN rl ON rl.clip_id = st.clip_id AND frame_no >= len - 1 AND w < s AND s < w + len WHERE shot > 0 GROUP BY 1, 2),
    a AS (SELECT sh.*, clip_mean, CASE WHEN sh.shot < mx THEN coalesce(edge, 100) END AS edge FROM sh JOIN c ON c.clip_id = sh.clip_id JOIN (SELECT clip_id, max(shot) AS mx FROM sh GROUP BY 1) x ON x.clip_id = sh.clip_id
      LEFT JOIN bd ON bd.clip_id = sh.clip_id AND bd.shot = sh.shot),
    fl AS (SELECT *, mean < 76 OR worst < 72 OR coalesce(edge < 72, false) OR coalesce(lag(edge < 72) OVER (PARTITION BY clip_id ORDER BY shot), false) AS f FROM a),
    an AS (SELECT *, bool_or(f) OVER (PARTITION BY clip_id) AS anyf, row_number() OVER (PARTITION BY clip_id ORDER BY (80 - mean) * frames DESC, shot) AS rn FROM fl),
    cw AS (SELECT clip_id, min(m) AS low FROM rl WHERE frame_no >= len - 1 GROUP BY 1)
    SELECT an.clip_id, shot::BIGINT AS shot_idx, frames, round(mean, 8) AS mean_vmaf, round(worst, 8) AS worst_1s_vmaf, round(edge, 8) AS boundary_worst_1s, f OR (clip_mean < 80 AND NOT anyf AND rn = 1) AS failed, round(clip_mean, 8) AS clip_mean, round(low, 8) AS clip_worst_1s, true AS covered FROM an JOIN cw ON cw.clip_id = an.clip_id
    """,
    uses="frame_scores frame_metrics",
)
def gate(t):
    shots = shots_from_cuts(t.frame_metrics, ["clip_id"])
    shots = position(value_chunk(shots, ["clip_id"], "start_frame"), ["clip_id"], ["start_frame"], out="shot_idx")
    out = verification.final_gate(t.frame_scores, shots, 80.0)
    rounded = ("mean_vmaf", "worst_1s_vmaf", "boundary_worst_1s", "clip_mean", "clip_worst_1s")
    return out.select(*[F.round(c, 8).alias(c) if c in rounded else F.col(c) for c in out.columns])


@query(
    "q18_decision_options",
    f"""WITH {_CANDS_SQL}, {_SELECT_SQL}, o AS (
      SELECT source_id, 'relax_size' AS action_code, required_ratio AS suggested_value, NULL AS suggested_mode, false AS requires_analysis FROM sl WHERE failure_kind = 'size_blocked' AND required_ratio <= 1
      UNION ALL SELECT source_id, 'relax_quality', best_fit_gate, NULL, false FROM sl WHERE status <> 'found' AND best_fit_gate IS NOT NULL
      UNION ALL SELECT source_id, 'change_media_budget', NULL, 'aac', true FROM sl WHERE failure_kind = 'media_budget_too_small'
      UNION ALL SELECT source_id, 'reanalyze', NULL, NULL, true FROM sl WHERE failure_kind = 'quality_unreachable'
      UNION ALL SELECT source_id, 'skip', NULL, NULL, false FROM sl WHERE status <> 'found')
    SELECT source_id, action_code, round(suggested_value, 9) AS suggested_value, suggested_mode::VARCHAR AS suggested_mode, requires_analysis FROM o""",
    uses="trials",
)
def options(t):
    out = selection.decision_options(selection.select_candidate(_cands(t), _limits(t)))
    return out.withColumn("suggested_value", F.round("suggested_value", 9))


@query(
    "q19_resolve_policy",
    f"""WITH {_CANDS_SQL}, {_SELECT_SQL},
    pol AS (SELECT sl.*, lim.* EXCLUDE (source_id), failure_kind = 'size_blocked' AND lim.source_id % 3 = 0 AND required_ratio <= 1 AS by_size,
      failure_kind = 'size_blocked' AND lim.source_id % 3 = 1 AND best_fit_gate IS NOT NULL AS by_quality FROM sl JOIN lim ON lim.source_id = sl.source_id),
    lim2 AS (SELECT source_id, (CASE WHEN by_quality THEN best_fit_gate ELSE target END) AS target, margin, min_video_bps, cap,
      CASE WHEN by_size THEN greatest(1, CAST(floor(source_bytes * nextafter(required_ratio, 1.0::DOUBLE)) AS BIGINT)) ELSE max_output_bytes END AS max_output_bytes,
      CASE WHEN by_size THEN greatest(max_video_bps, min_video_bps) ELSE max_video_bps END AS max_video_bps FROM pol WHERE by_size OR by_quality),
    {_select_sql("2")},
    al AS (SELECT *, true AS relaxed FROM sl2 UNION ALL SELECT *, false FROM sl WHERE source_id NOT IN (SELECT source_id FROM lim2))
    SELECT source_id, status, failure_kind, selected_bps, gate, predicted_bytes, round(required_ratio, 9) AS required_ratio, required_bps, best_fit_bps, best_fit_gate, relaxed,
      CASE WHEN failure_kind = 'size_blocked' AND required_ratio > 1 THEN 'smart_predicted_oversize' WHEN failure_kind = 'quality_unreachable' AND source_id % 2 = 0 THEN 'smart_analysis' END AS skip_origin FROM al""",
    uses="trials",
)
def policy(t):
    limits = _limits(t).selectExpr(
        "*", "CASE source_id % 3 WHEN 0 THEN 'relax_size' WHEN 1 THEN 'relax_quality' ELSE 'ask' END AS size_policy",
        "CASE WHEN source_id % 2 = 0 THEN 'skip' ELSE 'ask' END AS quality_policy",
    )
    out = selection.resolve_policy(_cands(t), limits)
    return out.drop("predicted_ratio", "max_output_bytes").withColumn("required_ratio", F.round("required_ratio", 9))


@query(
    "q20_size_gate",
    """
    SELECT item_id, output_bytes, CAST(floor(source_bytes * 0.7::DOUBLE) AS BIGINT) AS allowed_bytes,
      CASE WHEN output_bytes > CAST(floor(source_bytes * 0.7::DOUBLE) AS BIGINT) THEN 'needs_decision' ELSE 'publishable' END AS verdict FROM results
    """,
    uses="results",
)
def size_gate(t):
    return selection.size_gate(t.results, F.lit(0.7)).select("item_id", "output_bytes", "allowed_bytes", "verdict")
