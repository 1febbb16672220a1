"""Scalar expressions, each over a whole table."""

from pyspark.sql import functions as F

from ratelens.bindings import table
from ratelens.functions import identity, media, rate
from ratelens.queries.registry import query


@query(
    "x01_fps_from_rational",
    """
    SELECT source_id,
      round(coalesce(
        CASE WHEN avg_rate NOT IN ('0/0', 'N/A') THEN CASE WHEN contains(avg_rate, '/')
          THEN try_cast(split_part(avg_rate, '/', 1) AS DOUBLE) / nullif(try_cast(split_part(avg_rate, '/', 2) AS DOUBLE), 0)
          ELSE try_cast(avg_rate AS DOUBLE) END END,
        CASE WHEN contains(r_rate, '/')
          THEN try_cast(split_part(r_rate, '/', 1) AS DOUBLE) / nullif(try_cast(split_part(r_rate, '/', 2) AS DOUBLE), 0)
          ELSE try_cast(r_rate AS DOUBLE) END), 6) AS fps
    FROM (SELECT o_orderkey AS source_id,
            CASE o_orderkey % 4 WHEN 0 THEN '0/0' WHEN 1 THEN 'N/A' WHEN 2 THEN concat(o_custkey, '/', o_orderkey % 3)
              ELSE '30000/1001' END AS avg_rate,
            CASE WHEN o_orderkey % 5 = 0 THEN '25' ELSE concat(24 + o_orderkey % 7, '/1') END AS r_rate FROM orders) t
    """,
)
def fps(t):
    rows = table(t.spark, t.sf_dir, "orders").selectExpr(
        "o_orderkey AS source_id",
        "CASE o_orderkey % 4 WHEN 0 THEN '0/0' WHEN 1 THEN 'N/A' WHEN 2 THEN concat(o_custkey, '/', o_orderkey % 3) "
        "ELSE '30000/1001' END AS avg_rate",
        "CASE WHEN o_orderkey % 5 = 0 THEN '25' ELSE concat(24 + o_orderkey % 7, '/1') END AS r_rate",
    )
    return rows.select("source_id", F.round(media.fps_from_rational("avg_rate", "r_rate"), 6).alias("fps"))


_RATE_TEXT = (
    "CASE p_size % 6 WHEN 0 THEN concat(p_size, 'k') WHEN 1 THEN concat(' ', p_retailprice, 'K ') "
    "WHEN 2 THEN concat(p_size % 5, '.5m') WHEN 3 THEN concat(p_size, 'g') WHEN 4 THEN '-3k' ELSE cast(p_size AS VARCHAR(9)) END"
)


@query(
    "x02_bitrate_bps",
    f"""
    WITH t AS (SELECT p_partkey, lower(trim({_RATE_TEXT})) AS raw FROM part),
    u AS (SELECT *, try_cast(regexp_replace(raw, '[km]$', '') AS DOUBLE) AS v,
      CASE WHEN raw LIKE '%k' THEN 1000 WHEN raw LIKE '%m' THEN 1000000 ELSE 1 END AS scale FROM t)
    SELECT p_partkey, CASE WHEN v > 0 THEN CAST(round_even(v * scale, 0) AS BIGINT) END AS strict_bps,
      CASE WHEN regexp_full_match(raw, '[0-9]+([.][0-9]+)?[kmg]?')
        THEN CAST(trunc(CAST(regexp_replace(raw, '[kmg]$', '') AS DOUBLE) * CASE WHEN raw LIKE '%k' THEN 1000 WHEN raw LIKE '%m' THEN 1000000
          WHEN raw LIKE '%g' THEN 1000000000 ELSE 1 END) AS BIGINT) END AS lenient_bps FROM u
    """,
)
def bitrate_text(t):
    rows = table(t.spark, t.sf_dir, "part").select("p_partkey", F.expr(_RATE_TEXT).alias("raw"))
    return rows.select(
        "p_partkey",
        rate.bitrate_bps("raw").alias("strict_bps"),
        rate.bitrate_bps_lenient("raw").alias("lenient_bps"),
    )


_PIX = (
    "CASE p_size % 7 WHEN 0 THEN 'yuv420p' WHEN 1 THEN 'YUV420P10LE' WHEN 2 THEN 'p010le' WHEN 3 THEN concat('gray', p_size, 'le') "
    "WHEN 4 THEN 'rgb24' WHEN 5 THEN 'yuv444p12' ELSE 'pal8' END"
)


@query(
    "x03_bit_depth",
    f"""
    WITH t AS (SELECT p_partkey, lower({_PIX}) AS n FROM part),
    u AS (SELECT *, try_cast(regexp_extract(n, '([0-9]{{1,2}})(?:le|be)?$', 1) AS INTEGER) AS suffix FROM t)
    SELECT p_partkey, CASE
      WHEN n IN ('yuv420p','yuv422p','yuv444p','yuvj420p','yuvj422p','yuvj444p','nv12','nv21','rgb24','bgr24') THEN 8
      WHEN n IN ('p010','p010le','p010be','p210','p210le','p210be') THEN 10
      WHEN suffix IN (9,10,12,14,16) THEN suffix END AS bit_depth FROM u
    """,
)
def depth(t):
    rows = table(t.spark, t.sf_dir, "part").select("p_partkey", F.expr(_PIX).alias("pix_fmt"))
    return rows.select("p_partkey", media.bit_depth("pix_fmt").alias("bit_depth"))


@query(
    "x04_target_bitrate",
    """
    SELECT source_id, greatest(50000::BIGINT, CASE WHEN max_kbps > 0 THEN least(w, max_kbps * 1000) ELSE w END)::BIGINT AS target_bps
    FROM (SELECT source_id, max_kbps, greatest(CAST(round_even(source_bytes / 40 * CASE codec WHEN 'hevc' THEN 0.76::DOUBLE ELSE 0.64::DOUBLE END, 0) AS BIGINT),
            250000) AS w
          FROM (SELECT *, (source_id % 4) * 1000 AS max_kbps FROM sources) s) x
    """,
    uses="sources",
)
def target(t):
    rows = t.sources.withColumn("max_kbps", F.expr("(source_id % 4) * 1000")).withColumn(
        "source_bps", F.col("source_bytes") / 40
    )
    return rows.select(
        "source_id", rate.target_bitrate("source_bps", "codec", F.lit(250), "max_kbps").alias("target_bps")
    )


@query(
    "x05_max_output_ratio",
    """
    SELECT source_id, CASE WHEN r > 0 AND r <= 1 THEN r END AS max_output_ratio
    FROM (SELECT source_id, coalesce(CASE source_id % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 0::DOUBLE END,
            CASE codec WHEN 'hevc' THEN 0.70::DOUBLE ELSE 0.50::DOUBLE END) AS r FROM sources) t
    """,
    uses="sources",
)
def ratio(t):
    configured = (
        F.when(F.col("source_id") % 4 == 0, 0.5).when(F.col("source_id") % 4 == 1, 1.5).when(F.col("source_id") % 4 == 2, 0.0)
    )
    return t.sources.select("source_id", rate.max_output_ratio("codec", configured).alias("max_output_ratio"))


_BUDGET_SQL = """
    budgets AS (SELECT source_id, duration_sec, source_bytes, max_output_bytes, audio AS audio_bitrate_bps, 250000::BIGINT AS min_video_bps,
      CASE WHEN cap > 0 THEN least(total - audio, cap) ELSE total - audio END AS max_video_bps
     FROM (SELECT *, CAST(floor(max_output_bytes * 8 * 0.98::DOUBLE / duration_sec) AS BIGINT) AS total,
             CASE WHEN source_id % 2 = 0 THEN greatest(0, audio_bitrate_bps)::BIGINT ELSE 128000 * (source_id % 3)::BIGINT END AS audio,
             (source_id % 3) * 4000 * 1000 AS cap
           FROM (SELECT *, greatest(1, CAST(floor(source_bytes * CASE codec WHEN 'hevc' THEN 0.70::DOUBLE ELSE 0.50::DOUBLE END) AS BIGINT)) AS max_output_bytes
                 FROM sources) a) b)
"""


def budgets(t):
    """Byte and bitrate budget of every source in the ``sources`` binding."""
    rows = t.sources.withColumn("mode", F.when(F.col("source_id") % 2 == 0, "copy").otherwise("aac"))
    budget = rate.bitrate_budget(
        "source_bytes",
        "duration_sec",
        rate.max_output_ratio("codec", F.lit(None)),
        "mode",
        "audio_bitrate_bps",
        F.lit("128k"),
        F.col("source_id") % 3,
        F.lit(250),
        (F.col("source_id") % 3) * 4000,
    )
    return rows.withColumn("_b", budget).select("source_id", "duration_sec", "source_bytes", "_b.*")


@query(
    "x06_bitrate_budget",
    f"WITH {_BUDGET_SQL} SELECT source_id, max_output_bytes, audio_bitrate_bps, min_video_bps, max_video_bps FROM budgets",
    uses="sources",
)
def budget(t):
    return budgets(t).drop("duration_sec", "source_bytes")


@query(
    "x07_predicted_bytes",
    """
    SELECT source_id, CAST(ceil((source_bytes // 100 + audio_bitrate_bps) * duration_sec / 8.0::DOUBLE / 0.98::DOUBLE) AS BIGINT) AS predicted_bytes
    FROM sources
    """,
    uses="sources",
)
def predicted(t):
    video = F.expr("source_bytes div 100")
    return t.sources.select(
        "source_id", rate.predicted_bytes(video, "audio_bitrate_bps", "duration_sec").alias("predicted_bytes")
    )


@query(
    "x08_candidate_rounding",
    """
    SELECT source_id, greatest(1000, (b // 1000) * 1000)::BIGINT AS floor_bps,
      greatest(1000, CAST(ceil(b / 1000.0) * 1000 AS BIGINT))::BIGINT AS ceil_bps,
      greatest(50000, CAST(round_even(b * 0.03::DOUBLE, 0) AS BIGINT))::BIGINT AS tolerance_bps
    FROM (SELECT source_id, source_bytes // 50 AS b FROM sources) t
    """,
    uses="sources",
)
def rounding(t):
    rows = t.sources.select("source_id", F.expr("source_bytes div 50").alias("b"))
    return rows.select(
        "source_id",
        rate.floor_candidate("b").alias("floor_bps"),
        rate.ceil_candidate("b").alias("ceil_bps"),
        rate.search_tolerance("b").alias("tolerance_bps"),
    )


@query(
    "x09_quality_model",
    """
    SELECT p_partkey, CASE WHEN large AND fast THEN 'vmaf_v1.0.16_hfr_1d5h_2160' WHEN large THEN 'vmaf_v1.0.16_1d5h_2160'
      WHEN fast THEN 'vmaf_v1.0.16_hfr_3d0h' ELSE 'vmaf_v1.0.16_3d0h' END AS model
    FROM (SELECT p_partkey, least(w, h) >= 2160 AND greatest(w, h) >= 3840 AND ctx = 'high_fidelity' AS large, fps >= 50 AS fast
      FROM (SELECT p_partkey, 80 * p_size AS w, 2160 + 4 * (p_size - 20) AS h, 20 + p_size AS fps,
              CASE WHEN p_partkey % 2 = 0 THEN 'high_fidelity' ELSE 'standard_display' END AS ctx FROM part) a) b
    """,
)
def model(t):
    rows = table(t.spark, t.sf_dir, "part").selectExpr(
        "p_partkey", "80 * p_size AS w", "2160 + 4 * (p_size - 20) AS h", "20 + p_size AS fps",
        "CASE WHEN p_partkey % 2 = 0 THEN 'high_fidelity' ELSE 'standard_display' END AS ctx",
    )
    return rows.select("p_partkey", media.quality_model("w", "h", "fps", "ctx").alias("model"))


_TRANSFER = (
    "CASE c_nationkey % 5 WHEN 0 THEN 'SMPTE2084' WHEN 1 THEN 'arib-std-b67' WHEN 2 THEN 'bt709' WHEN 3 THEN 'bt2020-10' END"
)


@query(
    "x10_measurable",
    f"""
    SELECT c_custkey, coalesce(lower(x) NOT IN ('smpte2084', 'arib-std-b67'), true) AS measurable,
      CASE WHEN lower(x) IN ('smpte2084', 'arib-std-b67') THEN concat('HDR transfer ', x) END AS reason
    FROM (SELECT c_custkey, {_TRANSFER} AS x FROM customer) t
    """,
)
def hdr(t):
    rows = table(t.spark, t.sf_dir, "customer").select("c_custkey", F.expr(_TRANSFER).alias("x"))
    return rows.select(
        "c_custkey", media.measurable("x").alias("measurable"), media.unmeasurable_reason("x").alias("reason")
    )


_CODECS = (
    "concat(CASE p_size % 3 WHEN 0 THEN 'xsub' WHEN 1 THEN 'subrip' ELSE 'dvbsub' END, ',', "
    "CASE p_size % 4 WHEN 0 THEN 'xsub' WHEN 1 THEN 'ass' ELSE 'hdmv_pgs_subtitle' END)"
)


@query(
    "x11_bitmap_subtitle_violation",
    f"""
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 AND bad <> '' THEN bad END AS violation
    FROM (SELECT p_partkey, CASE WHEN a = b OR NOT okb THEN CASE WHEN oka THEN a ELSE '' END
            WHEN NOT oka THEN b ELSE concat(a, ', ', b) END AS bad
      FROM (SELECT p_partkey, a, b, a IN ('xsub', 'dvbsub') AS oka, b IN ('xsub', 'hdmv_pgs_subtitle') AS okb
        FROM (SELECT p_partkey, split_part({_CODECS}, ',', 1) AS a, split_part({_CODECS}, ',', 2) AS b FROM part) x) y) z
    """,
)
def subtitles(t):
    rows = table(t.spark, t.sf_dir, "part").select("p_partkey", F.split(F.expr(_CODECS), ",").alias("codecs"))
    container = F.when(F.col("p_partkey") % 2 == 0, "mp4").otherwise("mkv")
    copy = F.col("p_partkey") % 3 > 0
    return rows.select("p_partkey", media.bitmap_subtitle_violation("codecs", container, copy).alias("violation"))


@query(
    "x12_unit_hash",
    """
    SELECT source_id, ('0x' || substr(sha256(concat('smart-strata-v1:', source_id, ':validation')), 1, 16))::UBIGINT::DOUBLE / pow(2, 64) AS u
    FROM sources
    """,
    uses="sources",
)
def unit(t):
    return t.sources.select("source_id", identity.unit_hash("source_id", F.lit("validation")).alias("u"))


@query(
    "x13_fingerprint",
    """
    SELECT source_id, sha256(concat('{"codec":"', codec, '","preset":null,"source_bytes":', source_bytes, '}')) AS measurement_key,
      sha256(concat('{"measurement":"', sha256(concat('{"codec":"', codec, '","preset":null,"source_bytes":', source_bytes, '}')),
        '","min_kbps":', source_id % 500, '}')) AS policy_key
    FROM sources
    """,
    uses="sources",
)
def keys(t):
    measured = identity.fingerprint(
        {"source_bytes": "source_bytes", "codec": "codec", "preset": F.lit(None).cast("string")}
    )
    return t.sources.withColumn("measurement_key", measured).select(
        "source_id", "measurement_key",
        identity.policy_key("measurement_key", {"min_kbps": F.col("source_id") % 500}).alias("policy_key"),
    )


_SPEED = "CASE p_size % 5 WHEN 0 THEN concat(p_size, 'x') WHEN 1 THEN ' 1.25x ' WHEN 2 THEN '0x' WHEN 3 THEN concat(p_size, 'fps') END"


@query(
    "x14_speed_factor",
    f"""
    SELECT p_partkey, CASE WHEN v > 0 THEN v END AS speed
    FROM (SELECT p_partkey, try_cast(regexp_extract({_SPEED}, '^\\s*([0-9]+(?:\\.[0-9]+)?)x\\s*$', 1) AS DOUBLE) AS v FROM part) t
    """,
)
def speed(t):
    rows = table(t.spark, t.sf_dir, "part").select("p_partkey", F.expr(_SPEED).alias("s"))
    return rows.select("p_partkey", media.speed_factor("s").alias("speed"))


@query(
    "x15_window_counts",
    """
    SELECT source_id, duration_sec <= 20 AS whole_clip,
      greatest(1, least(greatest(3, least(6, CASE WHEN duration_sec < 600 THEN 4 WHEN duration_sec < 3600 THEN 5 ELSE 6 END)),
        greatest(1, CAST(floor(duration_sec / 5) AS INTEGER))))::INTEGER AS search_windows,
      2::INTEGER AS holdout_windows
    FROM sources
    """,
    uses="sources",
)
def window_counts(t):
    return t.sources.select(
        "source_id",
        rate.whole_clip("duration_sec").alias("whole_clip"),
        rate.search_window_count("duration_sec").alias("search_windows"),
        rate.holdout_window_count("duration_sec").alias("holdout_windows"),
    )


@query(
    "x16_retry_bitrate",
    """
    SELECT item_id,
      CASE WHEN output_bytes > 0 THEN greatest(1, CASE WHEN cap > 0 THEN least(cap, kbps) ELSE kbps END) * 1000 END::BIGINT AS retry_bps,
      shot AS shot_budget_bytes, greatest(1000, CAST(trunc(shot * 8 / 60.0::DOUBLE) AS BIGINT))::BIGINT AS shot_bps
    FROM (SELECT *, (greatest(1000, CAST(trunc(1500000 * allowed / output_bytes::DOUBLE * 0.98::DOUBLE) AS BIGINT)) // 1000)::BIGINT AS kbps,
            greatest(1, CAST(trunc(source_bytes * greatest(0, allowed - 960000)::BIGINT / greatest(1, output_bytes - 960000)::DOUBLE * 0.98::DOUBLE) AS BIGINT)) AS shot
          FROM (SELECT *, CAST(floor(source_bytes * 0.5::DOUBLE) AS BIGINT) AS allowed, (item_id % 3 * 900)::BIGINT AS cap FROM results) a) b
    """,
    uses="results",
)
def retry(t):
    rows = t.results.withColumn("allowed", F.floor(F.col("source_bytes") * 0.5)).withColumn(
        "cap", (F.col("item_id") % 3 * 900).cast("long")
    )
    shot = rate.retry_shot_budget("source_bytes", "allowed", "output_bytes", F.lit(128_000), F.lit(60.0))
    return rows.withColumn("shot", shot).select(
        "item_id",
        rate.retry_bitrate(F.lit(1_500_000), "allowed", "output_bytes", "cap").alias("retry_bps"),
        F.col("shot.budget_bytes").alias("shot_budget_bytes"),
        F.col("shot.bitrate_bps").alias("shot_bps"),
    )


@query(
    "x17_output_paths",
    """
    SELECT id, concat('/out/', dir, '/', stem, '_hevc.mkv') AS output, concat(stem, '_hevc.en.srt') AS own_sidecar,
      concat(stem, '_hevc.srt') AS other_sidecar FROM videos
    """,
    uses="videos",
)
def paths(t):
    out = F.concat("stem", F.lit("_hevc"))
    return t.videos.select(
        "id",
        media.output_path(F.lit("/out"), "dir", "stem", F.lit("hevc"), F.lit("mkv")).alias("output"),
        media.sidecar_output_name("stem", F.concat("stem", F.lit(".en.srt")), out).alias("own_sidecar"),
        media.sidecar_output_name("stem", F.lit("zz.srt"), out).alias("other_sidecar"),
    )
