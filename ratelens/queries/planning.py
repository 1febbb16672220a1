"""Reuse, validation and batch planning."""

from pyspark.sql import functions as F

from ratelens.bindings import table
from ratelens.functions import identity, media
from ratelens.operators import planning, reuse
from ratelens.queries.registry import query

_STORE_SQL = """
    w AS (SELECT source_id, bitrate_bps, window_id, sha256(concat('{"bitrate":"', bitrate_bps, '","duration":5.0,"preset":"', source_id % 3, '","source":', source_id, ',"start":', window_id * 10, '}')) AS fingerprint,
      (source_id + window_id) % 17 = 0 AS forced FROM trials),
    st AS (SELECT fingerprint, source_id * 10 + window_id + bitrate_bps AS stored FROM (SELECT DISTINCT fingerprint, source_id, bitrate_bps, window_id FROM w) x WHERE (source_id * 7 + window_id) % 5 > 1)
"""


def _wanted(t):
    rows = t.trials
    key = identity.measurement_key(
        "source_id", F.col("window_id") * 10, F.lit(5.0),
        {"bitrate": F.col("bitrate_bps").cast("string"), "preset": (F.col("source_id") % 3).cast("string")},
    )
    rows = rows.select("source_id", "bitrate_bps", "window_id", key.alias("fingerprint"), ((F.col("source_id") + F.col("window_id")) % 17 == 0).alias("forced"))
    store = rows.filter("(source_id * 7 + window_id) % 5 > 1").select(
        "fingerprint", (F.col("source_id") * 10 + F.col("window_id") + F.col("bitrate_bps")).alias("stored")
    ).distinct()
    return reuse.reuse_measurements(rows, store, forced="forced")


@query(
    "j01_reuse_hits",
    f"WITH {_STORE_SQL} SELECT source_id, bitrate_bps, window_id, w.fingerprint, stored FROM w JOIN st ON st.fingerprint = w.fingerprint WHERE NOT forced",
    uses="trials",
)
def hits(t):
    return _wanted(t)[0].drop("forced")


@query(
    "j01_reuse_misses",
    f"WITH {_STORE_SQL} SELECT source_id, bitrate_bps, window_id, w.fingerprint FROM w WHERE forced OR fingerprint NOT IN (SELECT fingerprint FROM st)",
    uses="trials",
)
def misses(t):
    return _wanted(t)[1].drop("forced")


@query(
    "j02_early_reject",
    """
    WITH h AS (SELECT source_id, bitrate_bps, window_id, gate, row_number() OVER (PARTITION BY source_id, bitrate_bps ORDER BY gate DESC, window_id) AS r FROM trials),
    o AS (SELECT *, row_number() OVER (PARTITION BY source_id, bitrate_bps ORDER BY r > 1, window_id) AS p FROM h),
    f AS (SELECT *, min(CASE WHEN gate < 80 THEN p END) OVER (PARTITION BY source_id, bitrate_bps) AS first FROM o)
    SELECT source_id, bitrate_bps, window_id, first IS NULL OR p <= first AS needed FROM f
    """,
    uses="trials",
)
def early(t):
    # The presumed hardest window comes from an earlier candidate; here the easiest stands in, so that order matters.
    guess = t.trials.groupBy("source_id", "bitrate_bps").agg(
        F.min_by("window_id", F.struct((-F.col("gate")).alias("g"), "window_id")).alias("hardest_window")
    )
    return reuse.early_reject(t.trials, F.lit(80.0), guess).select("source_id", "bitrate_bps", "window_id", "needed")


def _receipts(t):
    """One receipt per order; the order key decides which rule it breaks."""
    return table(t.spark, t.sf_dir, "orders").selectExpr(
        "o_orderkey AS receipt_id",
        "CASE WHEN o_orderkey % 13 = 1 THEN 7 ELSE 1 END AS schema_version",
        "CASE WHEN o_orderkey % 13 = 2 THEN 'zz' ELSE sha2(CAST(o_orderkey AS STRING), 256) END AS fingerprint",
        "array(named_struct('start_sec', CASE WHEN o_orderkey % 13 = 3 THEN -1D ELSE 0D END, 'duration_sec', 5D), named_struct('start_sec', 20D, 'duration_sec', 5D)) AS search_windows",
        "array(named_struct('start_sec', CASE WHEN o_orderkey % 13 = 4 THEN 22D ELSE 30D END, 'duration_sec', 5D)) AS holdout_windows",
        "array(named_struct('start_sec', 40D, 'duration_sec', 5D)) AS reserve_windows",
        "array(named_struct('bitrate_bps', CASE WHEN o_orderkey % 13 = 5 THEN 0 ELSE o_custkey + 1 END, 'observed_bps', 10, "
        "'segment_gate', CASE WHEN o_orderkey % 13 = 6 THEN array(90D) ELSE array(90D, CASE WHEN o_orderkey % 13 = 7 THEN 101D ELSE 80D END) END, "
        "'min_gate', CASE o_orderkey % 13 WHEN 8 THEN 81D WHEN 6 THEN 90D WHEN 7 THEN 90D ELSE 80D END, "
        "'encoded_bytes', CASE WHEN o_orderkey % 13 = 9 THEN array(1) ELSE array(1, CASE WHEN o_orderkey % 13 = 10 THEN -2 ELSE 2 END) END, "
        "'durations_sec', array(5D, CASE WHEN o_orderkey % 13 = 11 THEN 0D ELSE 5D END), 'predicted_bytes', CASE WHEN o_orderkey % 13 = 12 THEN -1 END, 'predicted_ratio', 0.5D)) AS candidates",
    )


_RULES = (
    "CASE o_orderkey % 13 WHEN 1 THEN 'unsupported schema version' WHEN 2 THEN 'invalid fingerprint' WHEN 3 THEN 'invalid sample window' WHEN 4 THEN 'sample pools overlap' "
    "WHEN 5 THEN 'invalid bitrate' WHEN 6 THEN 'candidate does not cover every window' WHEN 7 THEN 'score out of range' WHEN 8 THEN 'score summary is inconsistent' "
    "WHEN 9 THEN 'sample lists differ in length' WHEN 10 THEN 'invalid encoded size' WHEN 11 THEN 'invalid encoded duration' WHEN 12 THEN 'invalid prediction' END"
)


@query("j03_validate_receipts", f"SELECT o_orderkey AS receipt_id, {_RULES} AS reason FROM orders")
def receipts(t):
    good, bad = reuse.validate_receipts(_receipts(t))
    return good.select("receipt_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("receipt_id", "reason"))


@query(
    "j03_validate_shot_receipts",
    """
    SELECT o_orderkey AS receipt_id, CASE o_orderkey % 7 WHEN 1 THEN 'unsupported schema version' WHEN 2 THEN 'invalid timeline' WHEN 3 THEN 'shots do not cover the source'
      WHEN 4 THEN 'invalid sample window' WHEN 5 THEN 'invalid candidate' END AS reason FROM orders
    """,
)
def shot_receipts(t):
    rows = table(t.spark, t.sf_dir, "orders").selectExpr(
        "o_orderkey AS receipt_id", "1 AS schema_version", "CASE WHEN o_orderkey % 7 = 1 THEN 2 ELSE 1 END AS scheme_version",
        "CASE WHEN o_orderkey % 7 = 2 THEN 0D ELSE 25D END AS fps", "CAST(200 + o_orderkey % 50 AS BIGINT) AS frames",
        "array(named_struct('start_frame', 0L, 'end_frame', 100L, 'windows', array(named_struct('start_frame', 10L, 'end_frame', 40L)), "
        "'holdout', CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 7 = 4 THEN named_struct('start_frame', CASE WHEN o_orderkey % 7 = 4 THEN 30L ELSE 40L END, 'end_frame', 70L) END, "
        "'candidates', array(named_struct('bitrate_bps', 1000L, 'bytes', 5L, 'measured_frames', 30L, 'mean_vmaf', CASE WHEN o_orderkey % 7 = 5 THEN double('nan') ELSE 90D END, 'worst_1s_vmaf', 80D))), "
        "named_struct('start_frame', CASE WHEN o_orderkey % 7 = 3 THEN 101L ELSE 100L END, 'end_frame', CAST(200 + o_orderkey % 50 AS BIGINT), "
        "'windows', array(named_struct('start_frame', 110L, 'end_frame', 150L)), 'holdout', CAST(NULL AS STRUCT<start_frame: BIGINT, end_frame: BIGINT>), "
        "'candidates', array(named_struct('bitrate_bps', 1000L, 'bytes', 5L, 'measured_frames', 30L, 'mean_vmaf', 90D, 'worst_1s_vmaf', 80D)))) AS shots",
    )
    good, bad = reuse.validate_shot_receipts(rows)
    return good.select("receipt_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("receipt_id", "reason"))


@query(
    "j04_match_sidecars",
    "SELECT v.id AS video_id, s.id AS subtitle_id, v.dir, stem, name FROM videos v JOIN subtitles s ON s.dir = v.dir AND starts_with(s.name, concat(v.stem, '.'))",
    uses="videos subtitles",
)
def sidecars(t):
    return planning.match_sidecars(t.videos, t.subtitles)


_PATHS = "concat('/Media/', upper(p_brand), '/', CASE WHEN p_partkey % 2 = 0 THEN 'Clip' ELSE 'clip' END, p_size, '.MKV')"


@query(
    "j05_dedupe_sources",
    f"SELECT p_partkey, path FROM (SELECT p_partkey, {_PATHS} AS path, row_number() OVER (PARTITION BY lower({_PATHS}) ORDER BY p_partkey) AS rn FROM part) x WHERE rn = 1",
)
def dedupe(t):
    rows = table(t.spark, t.sf_dir, "part").select("p_partkey", F.expr(_PATHS).alias("path"))
    return planning.dedupe_sources(rows, "path", "p_partkey")


def _outputs(t):
    return table(t.spark, t.sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat('/in/', p_partkey, '.mov') AS source_path", "concat('/out/', p_brand, '/', CASE WHEN p_partkey % 2 = 0 THEN 'P' ELSE 'p' END, p_size, p_partkey % 4, '_hevc.mkv') AS output",
        "CASE WHEN p_partkey % 3 = 0 THEN 'no video stream' END AS skip_reason",
    )


_OUT_SQL = "o AS (SELECT p_partkey AS id, concat('/in/', p_partkey, '.mov') AS source_path, concat('/out/', p_brand, '/', CASE WHEN p_partkey % 2 = 0 THEN 'P' ELSE 'p' END, p_size, p_partkey % 4, '_hevc.mkv') AS output, p_partkey % 3 = 0 AS skipped FROM part)"


@query(
    "j06_disambiguate_outputs",
    f"""WITH {_OUT_SQL} SELECT id, source_path, CASE WHEN count(*) OVER (PARTITION BY lower(output)) > 1 THEN concat(output[:-5], '-', substr(sha1(source_path), 1, 8), '.mkv') ELSE output END AS output FROM o""",
)
def disambiguate(t):
    return planning.disambiguate_outputs(_outputs(t)).drop("skip_reason")


@query(
    "j06_output_collisions",
    f"WITH {_OUT_SQL} SELECT lower(output) AS output_key, count(DISTINCT source_path)::BIGINT AS sources, min(source_path) AS first_source FROM o WHERE NOT skipped GROUP BY 1 HAVING count(DISTINCT source_path) > 1",
)
def collisions(t):
    return planning.output_collisions(_outputs(t))


@query(
    "j07_plan_batch",
    """
    WITH r AS (SELECT source_id, source_bytes, codec, CASE WHEN source_id % 11 = 0 THEN 'no video stream' WHEN source_id % 5 = 0 AND source_id % 2 = 0 THEN 'MP4 cannot carry bitmap subtitles: xsub' END AS skip_reason FROM sources)
    SELECT source_id, CASE WHEN skip_reason IS NULL THEN greatest(50000, greatest(300000, CAST(round_even(source_bytes // 30 * CASE codec WHEN 'hevc' THEN 0.76::DOUBLE ELSE 0.64::DOUBLE END, 0) AS BIGINT))) ELSE 0 END::BIGINT AS target_bps, skip_reason,
      CASE WHEN skip_reason IS NULL AND source_id % 4 = 1 THEN 'will copy 2 external subtitle file(s)' END AS warning FROM r
    """,
    uses="sources",
)
def plan(t):
    rows = t.sources.select(
        "source_id", "codec", F.concat(F.lit("/in/"), "source_id", F.lit(".mov")).alias("source_path"),
        media.output_path(F.lit("/out"), F.lit(""), F.col("source_id").cast("string"), "codec", F.lit("mp4")).alias("output"),
        F.expr("source_bytes div 30").alias("video_bitrate_bps"),
        F.when(F.col("source_id") % 5 == 0, F.array(F.lit("xsub"))).otherwise(F.array(F.lit("subrip"))).alias("subtitle_codecs"),
        F.when(F.col("source_id") % 11 == 0, "no video stream").alias("probe_error"),
        F.when(F.col("source_id") % 2 == 0, "mp4").otherwise("mkv").alias("container"),
    )
    found = t.sources.filter("source_id % 4 = 1").select(F.col("source_id").alias("video_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    out = planning.plan_batch(rows, {"mode": "fixed_bitrate", "min_kbps": 300}, sidecars=found)
    return out.select("source_id", "target_bps", "skip_reason", "warning")


@query(
    "j08_skip_groups",
    """
    SELECT policy, count(*)::BIGINT AS items, sum(source_bytes)::BIGINT AS source_bytes FROM (SELECT *, ['copy', 'ask', 'ignore'][item_id % 3 + 1] AS policy FROM results) x
    WHERE outcome = 'skipped' AND item_id % 5 IN (1, 2, 3) AND item_id % 7 > 0 GROUP BY 1
    """,
    uses="results",
)
def skips(t):
    rows = t.results.selectExpr(
        "*", "outcome = 'skipped' AS skipped", "outcome = 'needs_decision' AS needs_decision", "element_at(array('copy', 'ask', 'ignore'), CAST(item_id % 3 + 1 AS INT)) AS policy",
        "element_at(array('planning', 'smart_analysis', 'smart_analysis_decision', 'smart_predicted_oversize', 'size_miss_discard'), CAST(item_id % 5 + 1 AS INT)) AS skip_origin",
        "CAST(NULL AS STRING) AS skip_reason", "CASE WHEN item_id % 7 = 0 THEN 'copied' END AS skipped_output_outcome",
    )
    return planning.skip_groups(rows)


@query(
    "j09_split_leakage",
    "SELECT group_id, count(DISTINCT split)::BIGINT AS splits, count(*)::BIGINT AS cases FROM measurements GROUP BY 1 HAVING count(DISTINCT split) > 1",
    uses="measurements",
)
def leakage(t):
    return planning.split_leakage(t.measurements, "group_id", "split")[0]


@query(
    "j09_split_counts",
    "SELECT split, count(*)::BIGINT AS cases, count(DISTINCT group_id)::BIGINT AS groups FROM measurements GROUP BY 1",
    uses="measurements",
)
def splits(t):
    return planning.split_leakage(t.measurements, "group_id", "split")[1]
