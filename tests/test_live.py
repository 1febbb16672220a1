"""Streams: runs of items that expire, changes with their before, and metrics by signed changes."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ratelens.streaming import live

EVENTS = "item_id int, seq long, ts timestamp, state string, percent double, speed string"
START = dt.datetime(2024, 5, 1)


def at(minute):
    return START + dt.timedelta(minutes=minute)


def stream(spark, path, batches, schema=EVENTS):
    """One file, and so one micro-batch, per list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, mode, folder, apply):
    query = df.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start()
    query.awaitTermination()


def test_runs_expire_and_late_events_change_nothing(spark, tmp_path):
    batches = [
        [(1, 1, at(0), "analyzing", 10.0, "1x"), (1, 2, at(20), "running_pass", 40.0, None), (2, 3, at(5), "failed", None, None)],
        [(1, 4, at(49), "validating", 90.0, None), (3, 5, at(200), "analyzing", 1.0, None)],  # watermark passes 1 and 2
        [(9, 6, at(210), "analyzing", 1.0, None)],
        [(1, 7, at(30), "failed", 99.0, None), (1, 8, at(220), "running_pass", 5.0, "2x")],  # the first is too late, the second a new run
        [(4, 9, at(600), "analyzing", 1.0, None), (None, 10, at(600), "failed", None, None), (5, 11, None, "failed", None, None)],
    ]
    got = []
    events = stream(spark, str(tmp_path / "events"), batches)
    run(live.item_runs(events), "append", tmp_path, lambda df, _: got.extend(df.collect()))
    found = sorted((r.item_id, r.run_start, r.run_end, r.status, r.progress, r.speed, r.last_seq) for r in got)
    assert found == [
        (1, at(0), at(79), "validating", 90.0, "1x", 4), (1, at(220), at(250), "encoding", 5.0, "2x", 8),
        (2, at(5), at(35), "failed", None, None, 3), (3, at(200), at(230), "analyzing", 1.0, None, 5), (9, at(210), at(240), "analyzing", 1.0, None, 6),
    ]
    late = [(1, 7)]
    kept = [r for rows in batches for r in rows if (r[0], r[1]) not in late]
    batch = live.item_runs(spark.createDataFrame(kept, EVENTS)).where(F.col("item_id") != 4).collect()
    assert sorted(tuple(r) for r in batch) == sorted(tuple(r) for r in got)


def random_events(seed, n=300):
    dice = random.Random(seed)
    states = [*live.STATUS_BY_STATE, "odd_state", "finished_file"]
    rows = [
        (dice.randrange(20), seq, at(seq), dice.choice(states), dice.choice([None, dice.uniform(-5, 120)]), dice.choice(["1x", "", None, "0.5x"]))
        for seq in range(n)
    ]
    dice.shuffle(rows)
    return rows


def test_changes_carry_what_was(spark, tmp_path):
    rows = random_events(1)
    batches = [rows[k::4] for k in range(4)]
    held, order = {}, []

    def apply(df, _):
        for r in df.collect():
            new = r.asDict()
            old = {k[4:]: new.pop(k) for k in list(new) if k.startswith("old_")}
            assert old == {k: v for k, v in held.get(new["item_id"], dict.fromkeys(new)).items() if k != "item_id"}
            held[new["item_id"]] = new
            order.append(new["item_id"])

    run(live.item_changes(stream(spark, str(tmp_path / "events"), batches)), "update", tmp_path, apply)
    want = {r.item_id: r.asDict() for r in live.item_state(spark.createDataFrame(rows, EVENTS)).collect()}
    assert {i: {k: v[k] for k in want[i]} for i, v in held.items()} == want
    assert len(order) <= 4 * 20


def test_metrics_by_signed_changes(spark, tmp_path):
    rows = random_events(2)
    items = spark.range(25).selectExpr(
        "CAST(id AS INT) AS item_id", "CAST(60 + id AS DOUBLE) AS duration_sec", "1 AS passes", "100000 AS source_bytes", "CAST(NULL AS BIGINT) AS output_bytes",
        "'smart' AS mode", "0 AS target_bps", "'copy' AS audio_mode", "0 AS audio_bitrate_bps", "'128k' AS audio_bitrate", "'hevc' AS codec",
        "CAST(NULL AS DOUBLE) AS max_output_ratio", "CAST(NULL AS STRING) AS skip_reason",
    )
    folder = str(tmp_path)

    def go(events):
        live.start_live_metrics(events, items, f"{folder}/facts", f"{folder}/out", f"{folder}/mark", buckets=4, availableNow=True).awaitTermination()

    for upto in (2, 4):  # the second start goes on from the first
        parts = [rows[k::4] for k in range(4)][upto - 2 : upto]
        go(stream(spark, f"{folder}/events", parts))
        seen = [r for k in range(upto) for r in rows[k::4]]
        want = live.live_queue_metrics(live.item_state(spark.createDataFrame(seen, EVENTS)), items).first().asDict()
        out = spark.read.parquet(f"{folder}/out/metrics")
        last = out.orderBy(F.desc("batch_id")).first().asDict()
        assert out.count() == upto
        assert set(want) == set(last) - {"batch_id"}
        for name, value in want.items():
            assert last[name] == value or abs(last[name] - value) < 1e-6, (name, value, last[name])
