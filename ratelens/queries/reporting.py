"""Reports, and item state from progress events."""

from pyspark.sql import functions as F

from ratelens.operators import reports
from ratelens.queries.registry import query
from ratelens.session import scratch_path
from ratelens.streaming import live


@query(
    "r01_space_savings",
    """
    SELECT count(*)::BIGINT AS total_files, count(*) FILTER (WHERE outcome = 'success')::BIGINT AS success_files, count(*) FILTER (WHERE outcome = 'failed')::BIGINT AS failed_files,
      count(*) FILTER (WHERE outcome = 'skipped')::BIGINT AS skipped_files, count(*) FILTER (WHERE outcome = 'needs_decision')::BIGINT AS needs_decision_files, 0::BIGINT AS cancelled_files,
      sum(source_bytes) FILTER (WHERE outcome = 'success')::BIGINT AS original_bytes, sum(output_bytes) FILTER (WHERE outcome = 'success')::BIGINT AS compressed_bytes,
      sum(source_bytes - output_bytes) FILTER (WHERE outcome = 'success')::BIGINT AS saved_bytes,
      round(sum(source_bytes - output_bytes) FILTER (WHERE outcome = 'success')::DOUBLE / sum(source_bytes) FILTER (WHERE outcome = 'success')::DOUBLE, 9) AS saved_ratio FROM results
    """,
    uses="results",
)
def savings(t):
    return reports.space_savings(t.results).withColumn("saved_ratio", F.round("saved_ratio", 9))


_ITEMS_SQL = """
    items AS (SELECT item_id, ['awaiting_start', 'queued', 'waiting_analysis', 'analyzing', 'encoding', 'validating', 'done', 'failed', 'needs_decision', 'skipped', 'cancelled'][item_id % 11 + 1] AS status,
      (60 + item_id % 600)::DOUBLE AS duration_sec, (1 + item_id % 2)::INTEGER AS passes, (item_id % 130)::DOUBLE AS progress, concat(1 + item_id % 4, '.5x') AS speed, source_bytes, output_bytes, item_id % 6 AS shard FROM results)
"""


def _items(t):
    status = (
        "element_at(array('awaiting_start', 'queued', 'waiting_analysis', 'analyzing', 'encoding', 'validating', 'done', 'failed', 'needs_decision', 'skipped', 'cancelled'), CAST(item_id % 11 + 1 AS INT))"
    )
    return t.results.selectExpr(
        "item_id", f"{status} AS status", "CAST(60 + item_id % 600 AS DOUBLE) AS duration_sec", "CAST(1 + item_id % 2 AS INT) AS passes", "CAST(item_id % 130 AS DOUBLE) AS progress",
        "concat(1 + item_id % 4, '.5x') AS speed", "source_bytes", "output_bytes", "item_id % 6 AS shard",
    )


@query(
    "r02_queue_metrics",
    f"""
    WITH {_ITEMS_SQL}, w AS (SELECT *, duration_sec * passes AS w, CASE WHEN status IN ('done', 'failed', 'skipped', 'cancelled') THEN 1 WHEN status = 'needs_decision' THEN 0.99::DOUBLE ELSE least(100, progress) / 100 END AS p FROM items)
    SELECT shard, count(*)::BIGINT AS total_items, count(*) FILTER (WHERE status IN ('awaiting_start', 'queued', 'waiting_analysis'))::BIGINT AS queued_items, count(*) FILTER (WHERE status IN ('analyzing', 'encoding', 'validating'))::BIGINT AS running_items,
      count(*) FILTER (WHERE status = 'done')::BIGINT AS done_items, count(*) FILTER (WHERE status IN ('done', 'skipped'))::BIGINT AS completed_items, sum(duration_sec) AS total_duration_sec,
      round(100 * sum(w * p) / sum(w), 7) AS queue_percent, sum(source_bytes - output_bytes) FILTER (WHERE status = 'done')::BIGINT AS actual_saved_bytes,
      round((sum(w) - sum(w * p)) / sum(1.5 + item_id % 4) FILTER (WHERE status IN ('analyzing', 'encoding', 'validating'))::DOUBLE, 5) AS eta_sec FROM w GROUP BY shard
    """,
    uses="results",
)
def queue(t):
    out = reports.queue_metrics(_items(t), ["shard"])
    return out.select(
        "shard", "total_items", "queued_items", "running_items", "done_items", "completed_items", "total_duration_sec", F.round("queue_percent", 7).alias("queue_percent"),
        "actual_saved_bytes", F.round("eta_sec", 5).alias("eta_sec"),
    )


def _with_options(t):
    return _items(t).selectExpr(
        "*", "CASE WHEN item_id % 5 = 0 THEN 'fixed_bitrate' ELSE 'smart' END AS mode", "CASE WHEN item_id % 3 = 0 THEN 0 ELSE 100000 + item_id END AS target_bps",
        "CASE WHEN item_id % 2 = 0 THEN 'copy' ELSE 'aac' END AS audio_mode", "96000 AS audio_bitrate_bps", "'128k' AS audio_bitrate", "CASE WHEN item_id % 4 = 0 THEN 'av1' ELSE 'hevc' END AS codec",
        "CAST(NULL AS DOUBLE) AS max_output_ratio", "CASE WHEN item_id % 13 = 0 THEN 'no video stream' END AS skip_reason",
    )


@query(
    "r03_estimated_savings",
    f"""
    WITH {_ITEMS_SQL}, e AS (SELECT *, CASE WHEN item_id % 3 > 0 THEN CAST(floor(duration_sec * (100000 + item_id + CASE WHEN item_id % 2 = 0 THEN 96000 ELSE 128000 END) / 8) AS BIGINT)
        WHEN item_id % 5 > 0 THEN CAST(floor(source_bytes * CASE WHEN item_id % 4 = 0 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END) AS BIGINT) END AS size, item_id % 3 = 0 AND item_id % 5 > 0 AS fl
      FROM items WHERE status NOT IN ('skipped', 'failed', 'cancelled', 'needs_decision') AND item_id % 13 > 0)
    SELECT shard, sum(source_bytes - size)::BIGINT AS estimated_saved_bytes, bool_or(fl) AS is_floor FROM e GROUP BY shard
    """,
    uses="results",
)
def estimate(t):
    return reports.estimated_savings(_with_options(t), ["shard"])


_CASE_SQL = """
    m AS (SELECT *, analysis_wall_seconds / final_encode_wall_seconds AS analysis_cost, CASE WHEN smart_passed THEN NOT ground_truth_passed END AS quality_false_pass,
      CASE WHEN smart_size_blocked THEN full_encode_output_bytes <= max_output_bytes END AS false_size_block, selected_bps - oracle_bps AS regret, (selected_bps - oracle_bps) / oracle_bps AS regret_n,
      group_id % 40 AS scout_windows, group_id % 9 AS quality_encodes FROM measurements)
"""


def _records(t):
    good, _ = reports.case_metrics(t.measurements)
    return good.withColumn("scout_windows", F.col("group_id") % 40).withColumn("quality_encodes", F.col("group_id") % 9)


@query(
    "r04_case_metrics",
    f"""WITH {_CASE_SQL} SELECT case_id, round(analysis_cost, 9) AS analysis_cost, quality_false_pass, false_size_block, regret::BIGINT AS bitrate_regret_absolute_bps, round(regret_n, 9) AS bitrate_regret_normalized FROM m""",
    uses="measurements",
)
def cases(t):
    return _records(t).select(
        "case_id", F.round("analysis_cost", 9).alias("analysis_cost"), "quality_false_pass", "false_size_block", "bitrate_regret_absolute_bps",
        F.round("bitrate_regret_normalized", 9).alias("bitrate_regret_normalized"),
    )


@query(
    "r04_case_errors",
    """
    SELECT case_id, CASE case_id % 20 WHEN 1 THEN 'analysis_wall_seconds: missing, negative or not finite' WHEN 2 THEN 'final_encode_wall_seconds: not above 0'
      WHEN 3 THEN 'smart_passed: missing' ELSE 'oracle_bps: not above 0' END AS reason FROM measurements WHERE case_id % 20 IN (1, 2, 3, 4)
    """,
    uses="measurements",
)
def case_errors(t):
    key = F.col("case_id") % 20
    broken = (
        t.measurements.withColumn("analysis_wall_seconds", F.when(key == 1, -1.0).otherwise(F.col("analysis_wall_seconds")))
        .withColumn("final_encode_wall_seconds", F.when(key == 2, 0.0).otherwise(F.col("final_encode_wall_seconds")))
        .withColumn("smart_passed", F.when(key != 3, F.col("smart_passed")))
        .withColumn("oracle_bps", F.when(key == 4, F.lit(0)).otherwise(F.col("oracle_bps")))
    )
    return reports.case_metrics(broken)[1].select("case_id", "reason")


def _summary_sql(source):
    return f"""SELECT {{keys}} count(*)::BIGINT AS case_count, count(*) FILTER (WHERE error IS NULL)::BIGINT AS successful_case_count, count(error)::BIGINT AS failed_case_count,
      round(avg(analysis_cost) FILTER (WHERE error IS NULL), 7) AS mean_analysis_cost, count(analysis_cost) FILTER (WHERE error IS NULL)::BIGINT AS analysis_cost_denominator,
      count(*) FILTER (WHERE error IS NULL AND quality_false_pass)::BIGINT AS quality_false_pass_count, count(quality_false_pass) FILTER (WHERE error IS NULL)::BIGINT AS quality_false_pass_denominator,
      round(avg(quality_false_pass::INT) FILTER (WHERE error IS NULL), 7) AS quality_false_pass_rate, count(*) FILTER (WHERE error IS NULL AND false_size_block)::BIGINT AS false_size_block_count,
      round(avg(false_size_block::INT) FILTER (WHERE error IS NULL), 7) AS false_size_block_rate, round(avg(regret) FILTER (WHERE error IS NULL), 4) AS mean_bitrate_regret_bps,
      round(avg(regret_n) FILTER (WHERE error IS NULL), 7) AS mean_bitrate_regret_normalized, sum(scout_windows)::BIGINT AS scout_windows, sum(quality_encodes)::BIGINT AS quality_encodes FROM {source}"""


def _summary_columns(df, *keys):
    return df.select(
        *keys, "case_count", "successful_case_count", "failed_case_count", F.round("mean_analysis_cost", 7).alias("mean_analysis_cost"), "analysis_cost_denominator",
        "quality_false_pass_count", "quality_false_pass_denominator", F.round("quality_false_pass_rate", 7).alias("quality_false_pass_rate"), "false_size_block_count",
        F.round("false_size_block_rate", 7).alias("false_size_block_rate"), F.round("mean_bitrate_regret_bps", 4).alias("mean_bitrate_regret_bps"),
        F.round("mean_bitrate_regret_normalized", 7).alias("mean_bitrate_regret_normalized"), "scout_windows", "quality_encodes",
    )


@query("r05_evaluation_summary", f"WITH {_CASE_SQL} {_summary_sql('m').format(keys='')}", uses="measurements")
def summary(t):
    return _summary_columns(reports.evaluation_summary(_records(t)))


@query(
    "r06_evaluation_by_family",
    f"""WITH {_CASE_SQL} {_summary_sql('m').format(keys="'family' AS scope, family,")} GROUP BY family
      UNION ALL {_summary_sql('m').format(keys="'all' AS scope, NULL AS family,")}
      UNION ALL {_summary_sql('m JOIN (SELECT DISTINCT family AS f FROM m) x ON m.family <> f').format(keys="'without' AS scope, f AS family,")} GROUP BY f""",
    uses="measurements",
)
def by_family(t):
    return _summary_columns(reports.evaluation_by_family(_records(t)), "scope", "family")


@query(
    "r07_compare_methods",
    """
    WITH r AS (SELECT item_id AS source_id, 'v1' AS method, output_bytes AS bytes, (60 + item_id % 300)::DOUBLE AS wall_seconds, source_bytes // 2 AS predicted_bytes FROM results
      UNION ALL SELECT item_id, 'v2', output_bytes - output_bytes // (5 + item_id % 7), (90 + item_id % 200)::DOUBLE, output_bytes FROM results WHERE item_id % 4 > 0)
    SELECT r.source_id, r.method, round(r.bytes / b.bytes - 1, 9) AS bytes_change, round(r.wall_seconds / b.wall_seconds, 9) AS wall_ratio, round(r.bytes / r.predicted_bytes - 1, 9) AS prediction_error
    FROM r JOIN r b ON b.source_id = r.source_id AND b.method = 'v1'
    """,
    uses="results",
)
def compare(t):
    v1 = t.results.selectExpr("item_id AS source_id", "'v1' AS method", "output_bytes AS bytes", "CAST(60 + item_id % 300 AS DOUBLE) AS wall_seconds", "source_bytes div 2 AS predicted_bytes")
    v2 = t.results.filter("item_id % 4 > 0").selectExpr(
        "item_id AS source_id", "'v2' AS method", "output_bytes - output_bytes div (5 + item_id % 7) AS bytes", "CAST(90 + item_id % 200 AS DOUBLE) AS wall_seconds", "output_bytes AS predicted_bytes"
    )
    out = reports.compare_methods(v1.unionByName(v2), "v1")
    return out.select("source_id", "method", *[F.round(c, 9).alias(c) for c in ("bytes_change", "wall_ratio", "prediction_error")])


_STATE_SQL = """
    SELECT item_id, arg_max(CASE state WHEN 'running_pass' THEN 'encoding' ELSE state END, seq) AS status, arg_max(least(100, percent), seq) AS progress, arg_max(speed, seq) AS speed, max(seq) AS last_seq FROM progress GROUP BY item_id
"""


@query("t01_item_state_batch", _STATE_SQL, uses="progress")
def item_state(t):
    return live.item_state(t.progress)


def _streamed(t, name):
    """The progress table as a stream of several files, one file per micro-batch."""
    path = scratch_path(t.spark, name)
    t.progress.repartition(4).write.parquet(path)
    return t.spark.readStream.schema(t.progress.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("t01_item_state_stream", _STATE_SQL, uses="progress")
def item_state_stream(t):
    path = scratch_path(t.spark, "item-state")

    def upsert(batch, _batch_id):
        live.upsert_state(batch.sparkSession, path, batch, buckets=4)

    query_ = (
        live.item_state(_streamed(t, "events")).writeStream.outputMode("update").foreachBatch(upsert)
        .option("checkpointLocation", scratch_path(t.spark, "stream-state")).trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return t.spark.read.parquet(path).drop("bucket")


# Runs of an item end twelve hours after their last event; events of the first three days that come last are too late.
_RUNS_SQL = """
    WITH e AS (SELECT item_id, seq, ts, CASE state WHEN 'running_pass' THEN 'encoding' ELSE state END AS status, least(100, percent) AS progress, speed
      FROM progress WHERE seq % 7 > 0 OR ts >= TIMESTAMP '2024-01-04'),
    g AS (SELECT *, sum(first) OVER (PARTITION BY item_id ORDER BY ts, seq) AS run FROM (
      SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY item_id ORDER BY ts, seq) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS first FROM e) x),
    r AS (SELECT item_id, min(ts) AS run_start, max(ts) + INTERVAL 12 HOUR AS run_end, arg_max(status, seq) AS status, arg_max(progress, seq) AS progress,
      arg_max(speed, seq) AS speed, max(seq) AS last_seq FROM g GROUP BY item_id, run)
    SELECT item_id, epoch_us(run_start) AS start_us, epoch_us(run_end) AS end_us, status, progress, speed, last_seq FROM r
    WHERE run_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM e)
"""


@query("t01_item_runs_stream", _RUNS_SQL, uses="progress")
def item_runs_stream(t):
    path, late = scratch_path(t.spark, "run-events"), (F.col("seq") % 7 == 0) & (F.col("ts") < "2024-01-04")
    days = [("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2025-01-01")]
    for start, end in days:
        t.progress.where(~late & (F.col("ts") >= start) & (F.col("ts") < end)).coalesce(1).write.mode("append").parquet(path)
    t.progress.where(late).coalesce(1).write.mode("append").parquet(path)
    events = t.spark.readStream.schema(t.progress.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(t.spark, "runs")
    run = (
        live.item_runs(events, idle="12 hours", late="1 hour").writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(t.spark, "runs-state")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    rows = t.spark.read.parquet(out)
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(run_{0} AS TIMESTAMP_NTZ)) AS {0}_us"
    return rows.selectExpr("item_id", micros.format("start"), micros.format("end"), "status", "progress", "speed", "last_seq")


@query(
    "t02_live_queue_metrics",
    f"""
    WITH s AS ({_STATE_SQL}),
    i AS (SELECT DISTINCT item_id, (60 + item_id % 600)::DOUBLE AS duration_sec FROM progress),
    w AS (SELECT i.item_id, duration_sec, CASE WHEN status = 'failed' THEN duration_sec ELSE duration_sec * progress / 100 END AS p, status FROM i JOIN s ON s.item_id = i.item_id)
    SELECT count(*)::BIGINT AS total_items, count(*) FILTER (WHERE status IN ('analyzing', 'encoding', 'validating'))::BIGINT AS running_items, count(*) FILTER (WHERE status = 'waiting_analysis')::BIGINT AS queued_items,
      count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed_items, round(100 * sum(p) / sum(duration_sec), 6) AS queue_percent,
      round((sum(duration_sec) - sum(p)) / (1.5 * count(*) FILTER (WHERE status IN ('analyzing', 'encoding', 'validating')))::DOUBLE, 4) AS eta_sec FROM w
    """,
    uses="progress",
)
def live_metrics(t):
    items = t.progress.select("item_id").distinct().selectExpr(
        "item_id", "CAST(60 + item_id % 600 AS DOUBLE) AS duration_sec", "1 AS passes", "100000 AS source_bytes", "CAST(NULL AS BIGINT) AS output_bytes", "'smart' AS mode", "0 AS target_bps",
        "'copy' AS audio_mode", "0 AS audio_bitrate_bps", "'128k' AS audio_bitrate", "'hevc' AS codec", "CAST(NULL AS DOUBLE) AS max_output_ratio", "CAST(NULL AS STRING) AS skip_reason",
    )
    facts, out, mark = (scratch_path(t.spark, n) for n in ("live-facts", "live-metrics", "live-checkpoint"))
    run = live.start_live_metrics(_streamed(t, "live-events"), items, facts, out, mark, buckets=4, availableNow=True)
    run.awaitTermination()
    metrics = t.spark.read.parquet(f"{out}/metrics")
    last = metrics.select(F.max("batch_id")).scalar()
    return metrics.filter(F.col("batch_id") == last).select(
        "total_items", "running_items", "queued_items", "failed_items", F.round("queue_percent", 6).alias("queue_percent"), F.round("eta_sec", 4).alias("eta_sec")
    )
