"""Literal cases of frame pooling, and hot groups cut into small chunks."""

import math
import random

from pyspark.sql import functions as F

from ratelens.operators import frames, intervals
from ratelens.plans.ordered import frame_chunks, ordered, value_chunk
from ratelens.sources import logs, scores

CUTS = {5: 17.25, 11: 10.0, 19: 31.5}


def _measured(n):
    """(si, ti, scene score, cut time or None) of n frames, made from their numbers."""
    return [((7 * i) % 23 + 0.5, (5 * i) % 19 + 0.25, CUTS.get(i, (i % 4) / 2), round(i / 24, 6) if i in CUTS else None) for i in range(n)]


def _log(n):
    lines = []
    for i, (si, ti, score, cut) in enumerate(_measured(n)):
        lines += [f"frame:{i}    pts:{i}       pts_time:{i / 24:.6f}", f"lavfi.siti.si={si}", f"lavfi.siti.ti={ti}", f"lavfi.scd.score={score}"]
        lines += [f"lavfi.scd.time={cut}"] if cut is not None else []
    return "\n".join(lines) + "\n"


def _at(values, share):
    """Element at rank ceil(n * share)."""
    return sorted(values)[max(1, math.ceil(len(values) * share)) - 1]


def _clips(spark, clips):
    rows = [(c, i, float(s), float(fps)) for c, (values, fps) in clips.items() for i, s in enumerate(values)]
    return spark.createDataFrame(rows, "clip_id string, frame_no long, score double, fps double")


def _worst(values, size):
    n = min(size, len(values))
    return min(sum(values[i : i + n]) / n for i in range(len(values) - n + 1))


def test_worst_second_by_definition(spark):
    clips = {"dip": ([90 + (i * 7) % 9 - 25 * (40 <= i < 52) for i in range(100)], 24), "short": ([71, 64, 88], 24), "steady": ([83] * 60, 50)}
    got = {r.clip_id: r.worst for r in frames.worst_consecutive(_clips(spark, clips), ["clip_id"], "frame_no", "score", F.col("fps")).collect()}
    for name, (values, fps) in clips.items():
        assert abs(got[name] - _worst(values, fps)) < 1e-9


def test_pooling_by_definition(spark):
    clips = {"tail": ([92 - i % 3 for i in range(100)] + [70 + i % 2 for i in range(40)], 25), "one": ([91] * 99 + [55], 25), "wave": ([80 + (i * i) % 17 for i in range(211)], 30)}
    got = {r.clip_id: r for r in frames.pool_scores(_clips(spark, clips), ["clip_id"]).collect()}
    for name, (values, fps) in clips.items():
        mean, worst = sum(values) / len(values), _worst(values, fps)
        assert got[name].p10 == _at(values, 0.1) and abs(got[name].mean - mean) < 1e-9 and abs(got[name].worst_1s - worst) < 1e-9
        assert abs(got[name].gate - min(mean, worst + 4)) < 1e-9


def test_nearest_rank_of_wide_hot_groups(spark):
    rng = random.Random(5)
    groups = {
        "wide": [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-12, 300) for _ in range(30_000)],
        "ties": [float(rng.randrange(7)) for _ in range(20_000)],
        "steps": [float(i // 3) for i in range(9_999)],
        **{f"few{n}": [rng.random() for _ in range(n)] for n in (1, 2, 3, 9, 10, 11, 101)},
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("few3", None), ("none", None)]
    df = spark.createDataFrame(rows, "clip string, v double").repartition(7)
    shares = {"lowest": 0.0, "p10": 0.1, "half": 0.5, "p90": 0.9, "p999": 0.999, "top": 1.0}
    got = {r.clip: r for r in frames.nearest_rank(df, ["clip"], "v", shares).collect()}
    assert set(got) == set(groups)
    for name, values in groups.items():
        assert {n: got[name][n] for n in shares} == {n: _at(values, p) for n, p in shares.items()}, name


def test_subsampled_frames_use_fewer_rows_per_second(spark):
    rows = [("a", 5 * i, 100.0 if i % 6 else 40.0, 30.0) for i in range(60)]
    df = spark.createDataFrame(rows, "clip_id string, frame_no long, score double, fps double")
    got = frames.pool_scores(df, ["clip_id"]).first()
    assert abs(got.worst_1s - 90.0) < 1e-9  # six rows per second, one of them at 40


def test_chunked_pooling_equals_plain(spark):
    rng = random.Random(3)
    clips = {"hot": ([rng.uniform(20, 100) for _ in range(500)], 24), "cold": ([rng.uniform(20, 100) for _ in range(30)], 24)}
    df = _clips(spark, clips).repartition(7)
    for size in (1 << 16, 40, 7):
        got = {r.clip_id: r for r in frames.pool_scores(df, ["clip_id"], frames_per_chunk=size).collect()}
        for name, (values, fps) in clips.items():
            worst = min(sum(values[i : i + fps]) / fps for i in range(len(values) - fps + 1))
            assert abs(got[name].worst_1s - worst) < 1e-9
            assert got[name].p10 == sorted(values)[math.ceil(len(values) * 0.1) - 1]
            assert got[name].frames == len(values)


def test_scout_metrics_from_log(spark):
    df = spark.createDataFrame([("ok", _log(23)), ("nan", "frame:0\nlavfi.siti.si=nan\nlavfi.siti.ti=1\nlavfi.scd.score=0\n")], "clip string, log string")
    rows, rejects = logs.parse_frame_log(df, "log")
    assert [r.clip for r in rejects.collect()] == ["nan"]
    got, bad = frames.scout_metrics(rows, ["clip"])
    r = got.first()
    measured = _measured(23)
    still = [ti for i, (_, ti, _, cut) in enumerate(measured) if i > 0 and cut is None]
    want = (23, _at([m[0] for m in measured], 0.9), _at(still, 0.9), len(CUTS), max(CUTS.values()))
    assert (r.frames, r.si_p90, r.ti_p90, r.cut_count, r.max_scene_score) == want
    assert sorted(c.cut_sec for c in frames.cut_times(rows, ["clip"]).collect()) == [m[3] for m in measured if m[3] is not None]
    assert bad.count() == 0


def test_scout_metrics_fail_closed(spark):
    texts = ["frame:0\nlavfi.siti.si=1\nlavfi.siti.ti=1\n", "frame:0\nlavfi.siti.si=1\nlavfi.siti.ti=1\nlavfi.scd.score=10\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "clip int, log string")
    rows, rejects = logs.parse_frame_log(df, "log")
    good, bad = frames.scout_metrics(rows, ["clip"])
    assert rejects.count() == 0 and good.count() == 0 and bad.count() == 2
    lost = spark.createDataFrame([(1, "lavfi.siti.si=1\nframe:0\n"), (2, "nothing")], "clip int, log string")
    assert {r.clip: r.reason for r in logs.parse_frame_log(lost, "log")[1].collect()} == {
        1: "values before the first frame", 2: "no frames"
    }


def test_cadence(spark):
    grid = [("cfr", i, i / 25) for i in range(50)]
    vfr = [("vfr", i, i / 25 + (0.1 if i > 30 else 0)) for i in range(50)]
    back = [("back", i, (i if i != 20 else 18) / 25) for i in range(50)]
    df = spark.createDataFrame(grid + vfr + back, "clip_id string, frame_no long, t_sec double").withColumn("fps", F.lit(25.0))
    for size in (1 << 16, 9):
        got = {r.clip_id: r for r in frames.check_cadence(df, ["clip_id"], frames_per_chunk=size).collect()}
        assert got["cfr"].on_grid and got["cfr"].even_steps and got["cfr"].reason is None
        assert not got["vfr"].on_grid and not got["vfr"].even_steps
        assert got["back"].reason == "timestamps do not increase"


def test_shots_with_and_without_chunks(spark):
    cuts = {3, 17, 18, 40}
    rows = [("a", i, 12.0 if i in cuts | {0} else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "clip_id string, frame_no long, scd_score double")
    for size in (1 << 16, 8):
        got = sorted((r.start_frame, r.end_frame) for r in intervals.shots_from_cuts(df, ["clip_id"], frames_per_chunk=size).collect())
        assert got == [(0, 3), (3, 17), (17, 18), (18, 40), (40, 60)]


def test_ordered_results_do_not_depend_on_chunks(spark):
    rng = random.Random(5)
    rows = [("hot", rng.randrange(1000), i, rng.random()) for i in range(300)] + [("cold", i, i, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, x long, id long, v double").repartition(5)
    plain = ordered(df, ["k"], ["x", "id"], running={"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, before={"b": "id"}, after={"a": "id"})
    cut = value_chunk(df, ["k"], "x", rows_per_chunk=20)
    assert "_chunk" in cut.columns
    chunked = ordered(cut, ["k"], ["x", "id"], running={"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, before={"b": "id"}, after={"a": "id"})
    cols = ["k", "x", "id", "s", "m", "b", "a"]
    assert sorted(map(str, plain.select(cols).collect())) == sorted(map(str, chunked.select(cols).collect()))
    down = ordered(cut, ["k"], [F.desc("x"), F.desc("id")], running={"s": ("sum", F.col("x"))}, descending=True)
    total = {"hot": sum(r[1] for r in rows if r[0] == "hot"), "cold": 10}
    for a, b in zip(sorted(plain.collect(), key=lambda r: (r.k, r.id)), sorted(down.collect(), key=lambda r: (r.k, r.id))):
        assert a.s + a.x + b.s == total[a.k]
    assert {r._chunk for r in frame_chunks(df, "x", frames_per_chunk=100).select("_chunk").distinct().collect()} == set(range(10))


def test_chunks_split_by_rows_whatever_the_values(spark):
    piled = [("a", 0, 0), ("a", 100_000, 1)] + [("a", 500 + i % 50, 2 + i) for i in range(900)]
    single = [("b", 7, i) for i in range(900)]
    df = spark.createDataFrame(piled + single, "k string, x long, id long")
    cut = value_chunk(df, ["k"], ["x", "id"], rows_per_chunk=100)
    sizes = [r["count"] for r in cut.groupBy("_chunk").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 400
    got = {(r.k, r.id): r.n for r in ordered(cut, ["k"], ["x", "id"], running={"n": ("sum", F.lit(1))}).collect()}
    for k in "ab":
        line = sorted((r[1], r[2]) for r in piled + single if r[0] == k)
        assert [got[k, i] for _, i in line] == list(range(len(line)))


def test_chunking_runs_no_job_that_only_looks_at_sizes(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(50)], "k string, x long, id long")
    tracker, seen = spark.sparkContext.statusTracker(), []

    def jobs(build):
        group = f"counted-{len(seen)}"
        seen.append(group)
        spark.sparkContext.setJobGroup(group, group)
        out = build()
        found = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("other", "other")
        return out, found

    _, none = jobs(lambda: frame_chunks(df, "x"))
    assert none == 0
    # The range sample and the write; then what the chunks carry over, written as well.
    cut, wrote = jobs(lambda: value_chunk(df, ["k"], ["x", "id"]))
    _, carried = jobs(lambda: ordered(cut, ["k"], ["x", "id"], running={"n": ("sum", F.lit(1))}))
    assert wrote <= 3 and carried <= 4


def test_score_documents(spark):
    docs = {
        "ok": '{"frames":[{"frameNum":0,"metrics":{"vmaf":1}},{"frameNum":5,"metrics":{"vmaf":100}}]}',
        "low": '{"frames":[{"frameNum":0,"metrics":{"vmaf":-1}}]}',
        "order": '{"frames":[{"frameNum":1,"metrics":{"vmaf":1}},{"frameNum":1,"metrics":{"vmaf":2}}]}',
        "none": '{"frames":[]}',
        "junk": "not json",
    }
    df = spark.createDataFrame(list(docs.items()), "id string, doc string")
    good, bad = scores.parse_score_json(df, "doc")
    assert [(r.id, r.frame_no, r.score) for r in good.orderBy("frame_no").collect()] == [("ok", 0, 1.0), ("ok", 5, 100.0)]
    assert {r.id for r in bad.collect()} == {"low", "order", "none", "junk"}
