"""Literal cases of the scalar expressions."""

import hashlib
import json

from pyspark.sql import functions as F

from ratelens.functions import identity, media, rate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_frame_rates(spark):
    rows = spark.createDataFrame(
        [("30000/1001", "25/1"), ("0/0", "25/1"), ("N/A", "24"), ("5/0", None), ("abc", "12.5")], "a string, r string"
    )
    got = [r.x for r in rows.select(media.fps_from_rational("a", "r").alias("x")).collect()]
    assert got[0] == 30000 / 1001 and got[1:] == [25.0, 24.0, None, 12.5]


def test_bitrate_text(spark):
    texts = ["128k", " 2M ", "1500", "0", "-1k", "x", "1.5k", "0.0005k", "nan", "1e3"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in rows.select(rate.bitrate_bps("t").alias("x")).collect()]
    assert got == [128_000, 2_000_000, 1500, None, None, None, 1500, 0, None, 1000]
    lenient = [r.x for r in rows.select(rate.bitrate_bps_lenient("t").alias("x")).collect()]
    assert lenient == [128_000, 2_000_000, 1500, 0, None, None, 1500, 0, None, None]


def test_half_even_target(spark):
    assert one(spark, rate.target_bitrate(F.lit(200_001), F.lit("hevc"), F.lit(0), F.lit(0), F.lit(0.5))) == 100_000
    assert one(spark, rate.target_bitrate(F.lit(1000), F.lit("av1"), F.lit(1), F.lit(0))) == 50_000
    assert one(spark, rate.target_bitrate(F.lit(9_000_000), F.lit("av1"), F.lit(1), F.lit(3000))) == 3_000_000


def test_budget(spark):
    b = rate.bitrate_budget(
        F.lit(100_000_000), F.lit(100.0), F.lit(0.5), F.lit("aac"), F.lit(0), F.lit("128k"), F.lit(2), F.lit(250), F.lit(3000)
    )
    got = one(spark, b)
    assert (got.max_output_bytes, got.audio_bitrate_bps, got.min_video_bps, got.max_video_bps) == (50_000_000, 256_000, 250_000, 3_000_000)


def test_unit_hash_equals_python(spark):
    rows = spark.range(50).select("id", identity.unit_hash(F.col("id"), F.lit("scout:3")).alias("u")).collect()
    for r in rows:
        digest = hashlib.sha256(f"smart-strata-v1:{r.id}:scout:3".encode()).digest()
        assert r.u == int.from_bytes(digest[:8], "big") / 2**64


def test_fingerprint_is_order_free_and_keeps_nulls(spark):
    a = identity.fingerprint({"b": F.lit(1), "a": F.lit(None).cast("string")})
    text = json.dumps({"a": None, "b": 1}, separators=(",", ":"))
    assert one(spark, a) == hashlib.sha256(text.encode()).hexdigest()


def test_bit_depth_and_subtitles(spark):
    rows = spark.createDataFrame([("yuv420p10le",), ("nv12",), ("P010LE",), ("gray16be",), ("pal8",), (None,)], "p string")
    assert [r.x for r in rows.select(media.bit_depth("p").alias("x")).collect()] == [10, 8, 10, 16, None, None]
    codecs = F.array(*map(F.lit, ("subrip", "xsub", "dvbsub", "xsub")))
    assert one(spark, media.bitmap_subtitle_violation(codecs, F.lit("mp4"), F.lit(True))) == "xsub, dvbsub"
    assert one(spark, media.bitmap_subtitle_violation(codecs, F.lit("mkv"), F.lit(True))) is None


def test_window_counts(spark):
    rows = spark.createDataFrame([(540.0,), (600.0,), (3600.0,), (10800.0,), (12.0,)], "d double")
    assert [r.x for r in rows.select(rate.search_window_count("d").alias("x")).collect()] == [4, 5, 6, 6, 2]


def test_retry(spark):
    assert one(spark, rate.retry_bitrate(F.lit(2_000_000), F.lit(900), F.lit(1000), F.lit(0))) == 1_764_000
    assert one(spark, rate.retry_bitrate(F.lit(2_000_000), F.lit(900), F.lit(1000), F.lit(1000))) == 1_000_000
    assert one(spark, rate.retry_bitrate(F.lit(2_000_000), F.lit(900), F.lit(0), F.lit(0))) is None


def test_sidecar_names(spark):
    name = media.sidecar_output_name(F.lit("movie"), F.lit("movie.en.srt"), F.lit("out"))
    assert one(spark, name) == "out.en.srt"
    assert one(spark, media.sidecar_output_name(F.lit("film"), F.lit("movie.srt"), F.lit("out"))) == "out.srt"
