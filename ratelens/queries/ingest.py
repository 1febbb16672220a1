"""Readers, parsers and sinks, fed with files and texts that Spark derives from the tables."""

from pyspark.sql import functions as F

from ratelens.bindings import table
from ratelens.functions import identity
from ratelens.plans.ordered import position, value_chunk
from ratelens.queries.registry import query
from ratelens.session import scratch_path, spread
from ratelens.sources import catalog, logs, manifest, probe, receipt_runs, scores, store


@query(
    "s01_scan_catalog",
    """
    SELECT concat('size=', p_size) AS dir, '.txt' AS ext, 1::BIGINT AS files, sum(strlen(p_name) + 1)::BIGINT AS bytes FROM part GROUP BY p_size
    """,
)
def scan(t):
    root = scratch_path(t.spark, "catalog")
    names = table(t.spark, t.sf_dir, "part").select(F.col("p_size").alias("size"), "p_name")
    names.repartition("size").write.partitionBy("size").text(root)
    found = catalog.scan_catalog(t.spark, root, (".txt",))
    return found.groupBy("dir", "ext").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


@query(
    "s02_media_from_probe",
    """
    SELECT source_id, CAST(20 + source_id % 14000 AS DOUBLE) AS duration, fb AS format_bitrate_bps,
      CASE WHEN fb - 128000 > 0 THEN fb - 128000 ELSE greatest(300000, CAST(round_even(fb * 0.85::DOUBLE, 0) AS BIGINT)) END AS video_bitrate_bps,
      128000::BIGINT AS audio_bitrate_bps,
      round(CASE WHEN source_id % 3 = 0 THEN 25 ELSE 30000 / 1001 END, 6)::DOUBLE AS fps, 'h264' AS video_codec, 'aac' AS audio_codec,
      1::INTEGER AS audio_stream_count, 10::INTEGER AS bit_depth, CASE WHEN source_id % 5 = 0 THEN 'xsub' ELSE 'subrip' END AS subtitles
    FROM (SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 4 = 0 OR o_custkey = 0
            THEN greatest(1, CAST(round_even(o_orderkey * 8000 / (20 + o_orderkey % 14000)::DOUBLE, 0) AS BIGINT)) ELSE o_custkey * 1000 END AS fb FROM orders) x
    """,
)
def media(t):
    rows = t.probe_json.withColumn("bytes", F.col("source_id") * 1000)
    good, _ = probe.media_from_probe(rows, "probe", bytes_col="bytes")
    return good.select(
        "source_id", "duration", "format_bitrate_bps", "video_bitrate_bps", "audio_bitrate_bps",
        F.round("fps", 6).alias("fps"), "video_codec", "audio_codec", "audio_stream_count", "bit_depth",
        F.concat_ws(",", "subtitle_codecs").alias("subtitles"),
    )


def _frame_logs(t):
    events = table(t.spark, t.sf_dir, "events")
    text = F.expr(
        "concat('frame:0    pts:0\\nlavfi.siti.si=', value, '\\nlavfi.siti.ti=', CASE WHEN event_id % 17 = 0 THEN 'nan' ELSE '1.5' END,"
        " '\\nlavfi.scd.score=0.0\\nframe:1    pts:1\\nlavfi.siti.si=2.0\\nlavfi.siti.ti=', value,"
        " '\\nlavfi.scd.score=12.0\\nlavfi.scd.time=0.083\\nother=1\\n')"
    )
    return events.select("event_id", text.alias("log"))


@query(
    "s03_parse_frame_log",
    """
    SELECT event_id, f::BIGINT AS frame_no, CASE f WHEN 0 THEN value ELSE 2.0 END AS si, CASE f WHEN 0 THEN 1.5 ELSE value END AS ti,
      CASE f WHEN 0 THEN 0.0 ELSE 12.0 END::DOUBLE AS scd_score, CASE f WHEN 1 THEN 0.083::DOUBLE END AS scd_time
    FROM events, (SELECT unnest([0, 1]) AS f) x WHERE event_id % 17 <> 0
    """,
)
def frame_log(t):
    frames, _ = logs.parse_frame_log(_frame_logs(t), "log")
    return frames.select("event_id", "frame_no", "si", "ti", "scd_score", "scd_time")


@query(
    "s03_frame_log_rejects",
    "SELECT event_id, 'malformed or non-finite value' AS reason FROM events WHERE event_id % 17 = 0",
)
def frame_log_rejects(t):
    return logs.parse_frame_log(_frame_logs(t), "log")[1].select("event_id", "reason")


def _score_docs(t):
    events = table(t.spark, t.sf_dir, "events")
    text = F.expr(
        "concat('{\"pooled_metrics\":{\"vmaf\":{\"mean\":80.5}},\"frames\":[{\"frameNum\":0,\"metrics\":{\"vmaf\":', least(value, 100D),"
        " '}},{\"frameNum\":', event_id % 3, ',\"metrics\":{\"vmaf\":', value / 4, '}}]}')"
    )
    return events.select("event_id", text.alias("doc"))


@query(
    "s04_parse_score_json",
    """
    SELECT event_id, CASE f WHEN 0 THEN 0 ELSE event_id % 3 END::BIGINT AS frame_no,
      round(CASE f WHEN 0 THEN least(value, 100) ELSE value / 4 END, 6) AS score
    FROM events, (SELECT unnest([0, 1]) AS f) x WHERE event_id % 3 > 0 AND value / 4 <= 100
    """,
)
def score_json(t):
    frames, _ = scores.parse_score_json(_score_docs(t), "doc")
    return frames.select("event_id", "frame_no", F.round("score", 6).alias("score"))


@query(
    "s04_score_json_rejects",
    """
    SELECT event_id, CASE WHEN value / 4 > 100 THEN 'invalid per-frame score' ELSE 'frame numbers not strictly increasing' END AS reason
    FROM events WHERE event_id % 3 = 0 OR value / 4 > 100
    """,
)
def score_json_rejects(t):
    return scores.parse_score_json(_score_docs(t), "doc")[1].select("event_id", "reason")


@query(
    "s04_read_score_csv",
    """
    SELECT clip, frame_no, score FROM (
      SELECT user_id % 20 AS clip, CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS BIGINT) AS frame_no,
        greatest(0, 100 - value / 5)::DOUBLE AS score, value FROM events) x
    WHERE clip <> 7
    """,
)
def score_csv(t):
    root = scratch_path(t.spark, "scores")
    events = table(t.spark, t.sf_dir, "events").withColumn("clip", F.col("user_id") % 20)
    rows = position(value_chunk(events, ["clip"], "event_id"), ["clip"], ["event_id"], out="frame_no")
    # Clip 7 starts at frame 1, so its coverage is broken and it must be rejected.
    rows = rows.select(
        "clip",
        (F.col("frame_no") + (F.col("clip") == 7).cast("int")).alias("Frame"),
        F.greatest(F.lit(0.0), 100 - F.col("value") / 5).alias("vmaf"),
    )
    rows.repartition("clip").sortWithinPartitions("clip", "Frame").write.partitionBy("clip").csv(root, header=True)
    good, _ = scores.read_score_csv(t.spark, f"{root}/*/*.csv")
    clip = F.regexp_extract("clip_id", "clip=([0-9]+)", 1).cast("long")
    return good.select(clip.alias("clip"), "frame_no", "score")


_PHASE_LINES = (
    "CASE event_id % 10 WHEN 0 THEN 'noise' WHEN 1 THEN '[smart timing] reference cache hit: a' "
    "WHEN 2 THEN ' [smart timing] measurement cache hit: b' WHEN 3 THEN concat('scout_windows=', event_id % 40) "
    "WHEN 4 THEN 'holdout=h1 bitrate=1 VMAF=2' WHEN 5 THEN '[smart phase] {broken' "
    "WHEN 6 THEN '[smart phase] {\"phase\": \"loopback score\", \"seconds\": 2.5}' "
    "WHEN 7 THEN '[smart phase] {\"phase\": \"candidate encode\", \"seconds\": 1}' "
    "WHEN 8 THEN '[smart phase] {\"phase\": \"VMAF scoring\"}' "
    "ELSE '[smart phase] {\"phase\": \"representative size calibration\", \"seconds\": 0.25}' END"
)


@query(
    "s05_phase_seconds",
    "SELECT event_type AS phase, round(sum(value), 3) AS seconds, count(*)::BIGINT AS n FROM events GROUP BY 1",
)
def phase_seconds(t):
    phases, _ = logs.phase_log_summary(t.phase_lines, "line", "line_no")
    return phases.select("phase", F.round("seconds", 3).alias("seconds"), "n")


@query(
    "s05_phase_counters",
    """
    SELECT user_id AS log_id, coalesce(arg_max(CASE WHEN m = 3 THEN event_id % 40 END, event_id) FILTER (WHERE m = 3), 0)::BIGINT AS scout_windows,
      count(*) FILTER (WHERE m IN (6, 7))::BIGINT AS quality_encodes, count(*) FILTER (WHERE m IN (6, 8))::BIGINT AS vmaf_measurements,
      count(*) FILTER (WHERE m = 4)::BIGINT AS holdout_measurements, count(*) FILTER (WHERE m = 9)::BIGINT AS size_calibration_encodes,
      count(*) FILTER (WHERE m = 1)::BIGINT AS reference_cache_hits, count(*) FILTER (WHERE m = 2)::BIGINT AS measurement_cache_hits,
      count(*) FILTER (WHERE m IN (1, 2))::BIGINT AS total_cache_hits
    FROM (SELECT *, event_id % 10 AS m FROM events) e GROUP BY user_id
    """,
)
def phase_counters(t):
    lines = table(t.spark, t.sf_dir, "events").select(
        F.col("user_id").alias("log_id"), "event_id", F.expr(_PHASE_LINES).alias("line")
    )
    return logs.phase_log_summary(lines, "line", "event_id", ["log_id"])[1]


_PROGRESS_LINE = (
    "CASE event_id % 4 WHEN 0 THEN 'Stream mapping:' WHEN 1 THEN concat('frame=  ', event_id % 9000, ' fps=25 time=00:0', event_id % 6, ':1', event_id % 10, '.50 speed=1.5x') "
    "WHEN 2 THEN 'time=N/A speed= 2x' ELSE concat('time=0', event_id % 3, ':00:01') END"
)


_PROGRESS_SQL = """
    SELECT event_id, 'running' AS state, elapsed AS elapsed_sec, CASE WHEN elapsed IS NOT NULL THEN round(least(100, greatest(0, elapsed / (100 + event_id % 50) * 100)), 6)::DOUBLE END AS percent,
      CASE m WHEN 1 THEN '1.5x' WHEN 2 THEN '2x' ELSE '' END AS speed, CASE m WHEN 1 THEN event_id % 9000 END AS frame
    FROM (SELECT event_id, event_id % 4 AS m, CASE event_id % 4 WHEN 1 THEN (event_id % 6) * 60 + 10 + event_id % 10 + 0.5
        WHEN 3 THEN (event_id % 3) * 3600 + 1 END::DOUBLE AS elapsed FROM events) x WHERE m > 0
    """


def _progress_lines(t):
    return table(t.spark, t.sf_dir, "events").select(
        "event_id", (100 + F.col("event_id") % 50).alias("duration"), F.expr(_PROGRESS_LINE).alias("line")
    )


def _parsed(lines):
    return logs.parse_progress(lines, "line", "duration").select(
        "event_id", "state", "elapsed_sec", F.round("percent", 6).alias("percent"), "speed", "frame"
    )


@query("s06_parse_progress", _PROGRESS_SQL)
def progress(t):
    return _parsed(_progress_lines(t))


@query("s06_parse_progress_stream", _PROGRESS_SQL)
def progress_stream(t):
    """The same lines as they come in, a file per micro-batch."""
    path, out = scratch_path(t.spark, "progress-lines"), scratch_path(t.spark, "progress")
    lines = _progress_lines(t)
    lines.repartition(4).write.parquet(path)
    stream = t.spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = (
        _parsed(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(t.spark, "progress-mark"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return t.spark.read.parquet(out)


def _manifest(t):
    """Manifests of 200 cases each, with one broken case of every kind among them."""
    root = scratch_path(t.spark, "manifests")
    m = t.measurements
    # The position inside its manifest decides how a case is broken.
    key = F.col("case_id")
    measurement = F.struct(
        "analysis_wall_seconds", "final_encode_wall_seconds", "smart_passed", "ground_truth_passed", "smart_size_blocked",
        "full_encode_output_bytes", "max_output_bytes",
    )
    case = F.struct(
        F.when(key % 20 == 3, F.concat(F.lit("a/"), key)).otherwise(F.concat(F.lit("c"), key)).alias("id"),
        F.when(key % 20 == 5, F.lit("")).otherwise(F.concat(F.lit("/media/"), key, F.lit(".mkv"))).alias("source"),
        F.when((key % 20 == 7) | (key % 2 == 0), F.array(F.lit("run"), key.cast("string"))).alias("command"),
        F.when((key % 20 == 7) | (key % 2 == 1), measurement).alias("measurement"),
    )
    # 200 consecutive keys per manifest: the collected list is bounded.
    docs = m.groupBy(F.floor(key / 200).alias("manifest")).agg(
        F.to_json(F.struct(F.lit(1).alias("schema_version"), F.array_sort(F.collect_list(case)).alias("cases"))).alias("value")
    )
    # A line for each: there are more manifests the more orders, but no more files.
    spread(docs, "manifest").select("value").write.text(root)
    return manifest.load_manifest(t.spark, root, lines=True)


@query(
    "s07_manifest_cases",
    """
    SELECT concat('c', case_id) AS case_id, concat('/media/', case_id, '.mkv') AS source, case_id % 2 = 0 AS has_command, CASE WHEN case_id % 2 = 1 THEN smart_passed END AS smart_passed
    FROM measurements WHERE case_id % 20 NOT IN (3, 5, 7)
    """,
    uses="measurements",
)
def manifest_cases(t):
    good, _ = _manifest(t)
    return good.select("case_id", "source", F.col("command").isNotNull().alias("has_command"), F.col("measurement.smart_passed").alias("smart_passed"))


@query(
    "s07_manifest_rejects",
    """
    SELECT concat(CASE WHEN case_id % 20 = 3 THEN 'a/' ELSE 'c' END, case_id) AS case_id, CASE case_id % 20 WHEN 3 THEN 'id is not path-safe'
      WHEN 5 THEN 'source is missing' ELSE 'needs exactly one of command or measurement' END AS reason
    FROM measurements WHERE case_id % 20 IN (3, 5, 7)
    """,
    uses="measurements",
)
def manifest_rejects(t):
    return _manifest(t)[1].select("case_id", "reason")


@query(
    "s08_latest_records",
    """
    SELECT group_id, case_id, error FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY case_id DESC) AS rn FROM measurements) x WHERE rn = 1
    """,
    uses="measurements",
)
def latest(t):
    return manifest.latest_records(t.measurements.select("group_id", "case_id", "error"), "group_id", "case_id")


@query(
    "s08_pending_cases",
    """
    SELECT c_custkey AS group_id FROM customer WHERE c_custkey NOT IN (
      SELECT group_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY case_id DESC) AS rn FROM measurements) x WHERE rn = 1 AND error IS NULL)
    """,
    uses="measurements",
)
def pending(t):
    cases = table(t.spark, t.sf_dir, "customer").select(F.col("c_custkey").alias("group_id"))
    return manifest.pending_cases(cases, t.measurements, "group_id", "case_id")


@query(
    "s09_write_report",
    """
    SELECT case_id, error, round(analysis_wall_seconds / final_encode_wall_seconds, 9) AS analysis_cost, count(*) OVER ()::BIGINT AS json_rows FROM measurements
    """,
    uses="measurements",
)
def report(t):
    out = scratch_path(t.spark, "report")
    rows = t.measurements.select(
        "case_id", "error", (F.col("analysis_wall_seconds") / F.col("final_encode_wall_seconds")).alias("analysis_cost")
    )
    store.write_report(rows, rows.agg(F.count(F.lit(1)).alias("case_count")), out)
    total = t.spark.read.schema("case_count bigint").json(f"{out}/summary.json")
    back = t.spark.read.schema(
        ", ".join(f"{c} {'bigint' if c == 'case_id' else 'double' if c == 'analysis_cost' else 'string'}" for c in store.REPORT_FIELDS)
    ).csv(f"{out}/results.csv", header=True)
    return back.select(
        "case_id", "error", F.round("analysis_cost", 9).alias("analysis_cost"),
        total.select(F.max("case_count")).scalar().alias("json_rows"),
    )


@query(
    "s10_receipt_store",
    """
    SELECT fingerprint, max(case_id) AS created_at, arg_max(selected_bps, case_id) AS selected_bps
    FROM (SELECT sha256(concat('{"group":', group_id, '}')) AS fingerprint, * FROM measurements) x WHERE case_id % 10 > 0 GROUP BY fingerprint
    """,
    uses="measurements",
)
def receipts(t):
    path = scratch_path(t.spark, "receipts")
    rows = t.measurements.select(
        identity.fingerprint({"group": "group_id"}).alias("fingerprint"),
        F.col("case_id").alias("created_at"),
        "selected_bps",
        F.when(F.col("created_at") % 10 > 0, 1).otherwise(0).alias("schema_version"),
        F.lit(1).alias("scheme_version"),
    )
    store.upsert_receipts(t.spark, path, rows.filter("created_at % 2 = 0"))
    store.upsert_receipts(t.spark, path, rows.filter("created_at % 2 = 1"))
    compacted = scratch_path(t.spark, "receipts")
    store.compact_receipts(t.spark, path, compacted)
    current = store.lookup_receipts(t.spark, compacted)
    return current.select("fingerprint", "created_at", "selected_bps")


@query(
    "s10_receipt_lookup",
    """
    WITH r AS (SELECT sha256(concat('{"group":', group_id, '}')) AS fingerprint, case_id AS created_at, selected_bps, error FROM measurements)
    SELECT fingerprint, max(created_at) AS created_at, arg_max(selected_bps, created_at) AS selected_bps FROM r
    WHERE created_at % 10 > 0 AND fingerprint IN (SELECT fingerprint FROM r WHERE error IS NOT NULL) GROUP BY fingerprint
    """,
    uses="measurements",
)
def receipt_lookup(t):
    """Stored receipts of the groups that had a failed case; receipts came in five appends."""
    root = scratch_path(t.spark, "receipt-runs")
    rows = t.measurements.select(
        identity.fingerprint({"group": "group_id"}).alias("fingerprint"), F.col("case_id").alias("created_at"), "selected_bps", "error",
        F.when(F.col("created_at") % 10 > 0, 1).otherwise(0).alias("schema_version"), F.lit(1).alias("scheme_version"),
    )
    for k in range(5):
        receipt_runs.append_run(t.spark, root, rows.where(F.pmod("created_at", F.lit(5)) == k).drop("error"), per_file=20_000)
    found = receipt_runs.lookup_fingerprints(t.spark, root, rows.where("error IS NOT NULL"))
    return found.select("fingerprint", "created_at", "selected_bps")
