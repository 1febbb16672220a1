"""Item state from progress events, on batch and streaming input alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ratelens.operators.reports import estimated_savings, live_report, live_sums, queue_metrics

# Which event states mean which item status. Other states change nothing.
STATUS_BY_STATE = {
    "waiting_analysis": "waiting_analysis",
    "analyzing": "analyzing",
    "candidate_finished": "analyzing",
    "scouting": "analyzing",
    "scout_finished": "analyzing",
    "sample_plan_ready": "analyzing",
    "boundary_alignment": "analyzing",
    "searching": "analyzing",
    "holdout_verification": "analyzing",
    "refining": "analyzing",
    "analysis_finished": "queued",
    "starting_file": "encoding",
    "running_pass": "encoding",
    "validating": "validating",
    "needs_decision": "needs_decision",
    "failed": "failed",
}
_PLAIN_FIELDS = (
    "candidate_index", "candidate_limit", "measurement_budget", "current_pass_index", "elapsed_sec",
)


def _status(state: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, status in STATUS_BY_STATE.items():
        out = F.when(state == name, status).otherwise(out)
    return out


def _clamped(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value.cast("double"))))


def _fields(columns: list[str]) -> dict[str, Column]:
    """Output field -> its value in one event; NULL when the event does not carry it."""
    def has(name: str) -> bool:
        return name in columns

    out = {"status": _status(F.col("state"))}
    progress = F.lit(None).cast("double")
    if has("percent"):
        progress = F.when(~F.col("state").isin("finished_file", "failed_file"), _clamped(F.col("percent")))
    if has("file_progress"):
        progress = F.coalesce(progress, _clamped(F.col("file_progress")))
    out["progress"] = progress
    if has("pass_percent"):
        out["pass_percent"] = _clamped(F.col("pass_percent"))
    if has("speed"):
        out["speed"] = F.nullif(F.col("speed"), F.lit(""))
    for name in ("total_passes", "target_video_bitrate_bps"):
        if has(name):
            out[name] = F.when(F.col(name) > 0, F.col(name))
    if has("message"):
        failed = F.col("state").isin("failed_file", "cancelled_file")
        out["error_summary"] = F.when(failed, F.nullif(F.trim("message"), F.lit("")))
    out |= {name: F.col(name) for name in _PLAIN_FIELDS if has(name)}
    return out


def item_state(events: DataFrame, *, item: str = "item_id", order: str = "seq") -> DataFrame:
    """Latest known value of every field per item: a later event wins for the fields it carries.

    One max_by per field, so it combines map-side, keeps one row of state per
    item, and is the same on batch and streaming input. Arrival order across
    micro-batches does not matter, only ``order``.
    """
    fields = _fields(events.columns)
    latest = [F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(name) for name, value in fields.items()]
    return events.groupBy(item).agg(*latest, F.max(order).alias("last_seq"))


def item_runs(
    events: DataFrame, *, item: str = "item_id", order: str = "seq", time: str = "ts", idle: str = "30 minutes", late: str = "10 minutes"
) -> DataFrame:
    """(item, run_start, run_end, fields, last_seq): state of every run of an item.

    A run is a stretch of an item's events with less than ``idle`` between one and
    the next in event time; ``run_end`` is ``idle`` after its last event. A later
    event wins for the fields it carries, as in :func:`item_state`, but only
    within its run: an item that starts again after a pause starts anew.

    On a stream (append mode) a run is given out once, when the watermark, the
    latest event time less ``late``, has passed its end, and then leaves the state.
    Events behind the watermark come too late and change nothing. A batch gives
    all runs, also those still open. Events without an item or a time have no run.
    """
    known = events.where(F.col(item).isNotNull() & F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        known = known.withWatermark(time, late)
    fields = _fields([c for c in events.columns if c != time])
    latest = [F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(name) for name, value in fields.items()]
    run = F.session_window(time, idle).alias("_run")
    return known.groupBy(item, run).agg(*latest, F.max(order).alias("last_seq")).select(
        item, F.col("_run.start").alias("run_start"), F.col("_run.end").alias("run_end"), *fields, "last_seq"
    )


def item_changes(events: DataFrame, *, item: str = "item_id", order: str = "seq") -> DataFrame:
    """(item, fields, last_seq, and each again as ``old_...``): every item that a micro-batch changes, as it is and as it was.

    ``old_last_seq`` is null for an item seen for the first time. The state keeps,
    per item, each field's latest value and its ``order``, so arrival order does
    not matter and nothing but the batch's own items is read. ``events`` is a
    stream; rows without an item are left out.
    """
    fields = _fields(events.columns)
    names = list(fields)
    rows = events.where(F.col(item).isNotNull()).select(item, F.col(order).cast("long").alias("last_seq"), *[v.alias(n) for n, v in fields.items()])
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    state = StructType([
        StructField("last_seq", LongType()), *[StructField(n, kinds[n]) for n in names], *[StructField(f"{n}_seq", LongType()) for n in names]
    ])
    kept = ["last_seq", *names]
    out = StructType([StructField(item, kinds[item]), *[StructField(n, kinds[n]) for n in kept], *[StructField(f"old_{n}", kinds[n]) for n in kept]])

    def change(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        before = dict(zip(state.names, group.get)) if group.exists else dict.fromkeys(state.names)
        now = dict(before)
        for batch in batches:
            for name in kept:
                own = batch[[name, "last_seq"]].dropna() if name != "last_seq" else batch[["last_seq"]].dropna()
                if len(own):
                    at = own["last_seq"].idxmax()
                    value, seq, mark = own[name][at], int(own["last_seq"][at]), f"{name}_seq" if name != "last_seq" else "last_seq"
                    if now[mark] is None or seq > now[mark]:
                        now[name] = value.item() if hasattr(value, "item") else value
                        now[mark] = seq
        group.update(tuple(now[n] for n in state.names))
        values = [key[0], *[now[n] for n in kept], *[before[n] for n in kept]]
        yield pd.DataFrame({n: pd.Series([v], dtype=object) for n, v in zip(out.names, values)})

    # Rows of one item and order are alike only by their batch, so the state update does not depend on how Arrow cuts them.
    return rows.groupBy(item).applyInPandasWithState(change, out, state, "update", GroupStateTimeout.NoTimeout)


def _live(items: DataFrame, changed: DataFrame, item: str, prefix: str) -> DataFrame:
    """Facts of ``changed`` items with the status, progress and speed of one side of their change."""
    seen = changed.select(item, *[F.col(f"{prefix}{c}").alias(f"_{c}") for c in ("status", "progress", "speed") if f"{prefix}{c}" in changed.columns])
    return _with_state(items.join(seen, item), [c[1:] for c in seen.columns if c != item], items.columns)


def _with_state(rows: DataFrame, live: list[str], own: list[str]) -> DataFrame:
    """A field the items carry too is overridden by its event value, if there is one; without a status an item waits."""
    for name in live:
        rows = rows.withColumn(name, F.coalesce(f"_{name}", name) if name in own else F.col(f"_{name}"))
    for name, kind in (("progress", "double"), ("speed", "string"), ("status", "string")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.withColumn("status", F.coalesce("status", F.lit("queued"))).drop(*[f"_{c}" for c in live])


def start_live_metrics(
    events: DataFrame, items: DataFrame, facts_path: str, metrics_path: str, checkpoint: str, *, item: str = "item_id",
    order: str = "seq", buckets: int = 64, **trigger: object,
) -> StreamingQuery:
    """Keep queue metrics up to date while progress events arrive.

    ``items`` holds what does not change (durations, sizes, options), one row per
    item; it is written once to ``facts_path``, by buckets. Each micro-batch reads
    the buckets of the items it changes, takes these items out of the sums as they
    were and puts them in as they are, and appends one row of metrics under its
    batch id. ``metrics_path`` has the sums as well; a batch starts from those of
    the batch before it, so a replay after a failure gives the same row. Where the
    two paths exist, a query goes on from them.
    """
    spark = events.sparkSession
    bucket = F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int")
    sums_path, report_path = f"{metrics_path}/sums", f"{metrics_path}/metrics"
    if not _exists(spark, f"{sums_path}/_SUCCESS"):
        items.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(facts_path)
        waiting = _with_state(spark.read.parquet(facts_path).drop("bucket"), [], items.columns)
        _write_batch(live_sums(waiting, F.lit(1)), -1, sums_path)
    facts = spark.read.schema(StructType([*items.schema.fields, *StructType.fromDDL("bucket int").fields])).parquet(facts_path)

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        changed = batch.withColumn("bucket", bucket).persist()
        touched = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # at most `buckets` numbers
        own = facts.where(F.col("bucket").isin(touched)).drop("bucket")
        before = session.read.parquet(sums_path).where(F.col("batch_id") == batch_id - 1).drop("batch_id")
        after = before.unionByName(live_sums(_live(own, changed, item, ""), F.lit(1)))
        after = after.unionByName(live_sums(_live(own, changed, item, "old_"), F.lit(-1)))
        after = after.agg(*[F.sum(c).cast("decimal(38,9)").alias(c) for c in after.columns])
        _write_batch(after, batch_id, sums_path)
        changed.unpersist()
        now = session.read.parquet(sums_path).where(F.col("batch_id") == batch_id).drop("batch_id")
        _write_batch(live_report(now), batch_id, report_path)

    writer = item_changes(events, item=item, order=order).writeStream.outputMode("update").foreachBatch(apply)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def _write_batch(row: DataFrame, batch_id: int, path: str) -> None:
    """One row of a batch, in place of what an earlier attempt of it left."""
    rows = row.withColumn("batch_id", F.lit(batch_id)).coalesce(1)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def upsert_state(spark: SparkSession, path: str, changed: DataFrame, *, item: str = "item_id", buckets: int = 64) -> None:
    """Replace changed items in the table at ``path``; only their buckets are rewritten."""
    rows = changed.withColumn("bucket", F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int"))
    if _exists(spark, path):
        touched = F.broadcast(rows.select("bucket").distinct())  # at most `buckets` values
        # A changed row carries the item's whole state, so it replaces the stored one.
        old = spark.read.parquet(path).join(touched, "bucket", "left_semi").join(rows.select(item), item, "left_anti")
        rows = old.unionByName(rows, allowMissingColumns=True)
    (
        rows.repartition("bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )


def live_queue_metrics(state: DataFrame, items: DataFrame, *, item: str = "item_id") -> DataFrame:
    """Queue metrics and estimated savings from item state and item facts. Items without events wait in the queue."""
    live = [c for c in ("status", "progress", "speed") if c in state.columns]
    known = state.select(item, *[F.col(c).alias(f"_{c}") for c in live])
    rows = _with_state(items.join(known, item, "left"), live, items.columns)
    one = F.lit(1).alias("_one")
    metrics = queue_metrics(rows.withColumn("_one", one), ["_one"])
    savings = estimated_savings(rows.withColumn("_one", one), ["_one"])
    return metrics.join(savings, "_one").drop("_one")
