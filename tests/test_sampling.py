"""Intervals, ranks and sampling plans against brute force and invariants."""

import random

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ratelens.operators import greedy, intervals, ranking, sampling
from ratelens.policy import PROFILES
from ratelens.queries import all_queries

EPS = 1e-9


def test_scout_grid_is_stratified(spark):
    sources = spark.createDataFrame([(1, 7200.0), (2, 15.0), (3, 45.0)], "source_id long, duration_sec double")
    rows = sampling.scout_grid(sources).collect()
    by = {s: sorted((r for r in rows if r.source_id == s), key=lambda r: r.start_sec) for s in (1, 2, 3)}
    assert by[2] == []
    assert len([r for r in by[1] if r.pool == "scout"]) == 24
    for a, b in zip(by[1], by[1][1:]):
        assert a.start_sec + a.duration_sec <= b.start_sec + EPS
    assert by[3][0].start_sec >= 0 and by[3][-1].start_sec + by[3][-1].duration_sec <= 45 + EPS


def test_shot_strata_literals(spark):
    shots = spark.createDataFrame([(0, 40, 940), (1, 0, 40)], "shot_idx int, start_frame long, end_frame long").withColumn("fps", F.lit(30.0))
    rows = sampling.shot_strata(shots).collect()
    long = sorted((r for r in rows if r.shot_idx == 0), key=lambda r: r.stratum)
    assert [r.pool for r in long] == ["search", "search", "holdout"]
    assert all(r.window_end <= long[2].window_start for r in long[:2])
    short = [r for r in rows if r.shot_idx == 1]
    assert [(r.pool, r.window_start, r.window_end) for r in short] == [("search", 0, 40)]


def test_largest_gap_literals(spark):
    rows = [(1, 0.0, 15.0), (1, 30.0, 20.0), (1, 60.0, 5.0), (2, 0.0, 6.0), (2, 8.0, 2.0)]
    occupied = spark.createDataFrame(rows, "source_id int, start_sec double, duration_sec double")
    totals = spark.createDataFrame([(1, 100.0), (2, 10.0)], "source_id int, total_sec double")
    for size in (1_000_000, 2):
        got = {r.source_id: r for r in intervals.largest_gap(occupied, ["source_id"], totals, min_length=5.0, rows_per_chunk=size).collect()}
        assert (got[1].start_sec, got[1].duration_sec) == (80.0, 5.0)
        assert got[2].start_sec is None


def test_midrank_ties_and_hot_groups(spark):
    rng = random.Random(1)
    rows = [("hot", i, float(rng.randrange(12)), rng.random()) for i in range(120)] + [("one", 0, 3.0, 1.0), ("two", 0, 5.0, 1.0), ("two", 1, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, id int, v double, w double").repartition(4)
    want = {}
    for k in ("hot", "one", "two"):
        values = [r[2] for r in rows if r[0] == k]
        for r in rows:
            if r[0] == k:
                below, same = sum(v < r[2] for v in values), sum(v == r[2] for v in values)
                want[k, r[1]] = 0.5 if len(values) == 1 else (below + (same - 1) / 2) / (len(values) - 1)
    for size in (1_000_000, 10):
        got = {(r.k, r.id): r.midrank for r in ranking.midrank(df, ["k"], "v", rows_per_chunk=size).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def _greedy(items):
    n, last = 0, float("-inf")
    for end, start in sorted((s + d, s) for s, d in items):
        if start >= last - EPS:
            n, last = n + 1, end
    return n


def test_max_disjoint_count(spark):
    rng = random.Random(2)
    items = {k: [(rng.uniform(0, 300), rng.uniform(0.5, 20)) for _ in range(n)] for k, n in (("a", 90), ("b", 1), ("c", 40))}
    items["d"] = [(float(i), 1.0) for i in range(50)]
    rows = [(k, i, s, d) for k, v in items.items() for i, (s, d) in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, window_id int, start_sec double, duration_sec double")
    want = {k: _greedy(v) for k, v in items.items()}
    for size in (1_000_000, 16):
        out = intervals.max_disjoint_count(df, ["k"], rows_per_chunk=size)
        assert {r.k: r.capacity for r in out.collect()} == want


def test_self_overlap(spark):
    rows = [("a", 1, 0.0, 5.0), ("a", 2, 5.0, 5.0), ("b", 1, 0.0, 50.0), ("b", 2, 60.0, 1.0), ("b", 3, 40.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, window_id int, start_sec double, duration_sec double")
    for size in (1_000_000, 1):
        got = {r.k: r.overlapping for r in intervals.has_self_overlap(df, ["k"], rows_per_chunk=size).collect()}
        assert got == {"a": False, "b": True}


def test_alignment_and_guard_against_one_by_one(spark):
    rng = random.Random(11)
    rows, cuts, want = [], [], {}
    for clip in range(12):
        total, at, plan = 200.0, 0.0, []
        while at < 180:
            at += rng.uniform(5.0, 9.0)
            plan.append(round(at, 3))
            at += 5.0
        plan = [s for s in plan if s + 5 <= total]
        times = sorted({round(rng.uniform(1, 199), 3) for _ in range(rng.choice((5, 25, 60)))})
        edges = [0.0, *times, total]
        done = []
        for i, s in enumerate(plan):
            reasons = ["transition_risk"] if i % 7 == 3 else ["hardship"]
            rows.append((clip, i, s, 5.0, total, reasons))
            crossed = any(s + EPS < c < s + 5 - EPS for c in times)
            new, flag = s, False
            if crossed and "transition_risk" in reasons:
                flag = True
            elif crossed:
                spots = [min(max(s, a), b - 5) for a, b in zip(edges, edges[1:]) if b - a + EPS >= 5]
                if spots:
                    new = min(spots, key=lambda p: (abs(p - s), p))
                else:
                    flag = True
            others = plan[:i] + plan[i + 1 :] + done
            if any(abs(new - o) < 5 - EPS for o in others):
                new, flag = s, True
            done.append(new)
            want[clip, i] = (round(new, 6), flag)
        cuts += [(clip, c) for c in times]
    windows = spark.createDataFrame(rows, "clip_id int, window_id int, start_sec double, duration_sec double, total_sec double, reasons array<string>")
    marks = spark.createDataFrame(cuts, "clip_id int, cut_sec double")
    for size in (1_000_000, 10):
        moved = intervals.align_to_cuts(windows, marks, ["clip_id"], rows_per_chunk=size).withColumn("coverage_bins", F.lit(1))
        got = intervals.guard_alignment(moved, ["clip_id"]).collect()
        assert {(r.clip_id, r.window_id): (round(r.new_start, 6), r.crosses_scene_cut) for r in got} == want


def _scored(spark, sources, seed):
    grid = sampling.scout_grid(sources).filter("pool = 'scout'")
    n = F.regexp_extract("window_id", "([0-9]+)", 1).try_cast("int") + seed
    rows = grid.select("source_id", "window_id", "start_sec", "duration_sec", (n * 17 % 130).cast("double").alias("si_p90"),
                       (n * 13 % 70).cast("double").alias("ti_p90"), (n * 7 % 16).cast("double").alias("max_scene_score"))
    return ranking.score_risk(rows.withColumn("cut_count", (F.col("max_scene_score") >= 10).cast("int")), ["source_id"])


def test_plans_keep_their_promises(spark):
    lengths = [20.5, 40.0, 60.0, 120.0, 700.0, 4000.0, 11000.0, 12.0]
    rows = [(i * 10 + s, d) for i, d in enumerate(lengths) for s in range(3)]
    sources = spark.createDataFrame(rows, "source_id long, duration_sec double").cache()
    profile = PROFILES["balance"]
    risk = _scored(spark, sources, 5).cache()
    windows, rejects = sampling.sample_plan(risk, sources, profile)
    plans = {}
    for r in windows.collect():
        plans.setdefault(r.source_id, []).append(r)
    assert set(plans) | {r.source_id for r in rejects.collect()} == {s for s, _ in rows}
    assert len(plans) >= 20
    for source, length in rows:
        plan = sorted(plans.get(source, []), key=lambda r: r.start_sec)
        for a, b in zip(plan, plan[1:]):
            assert a.start_sec + a.duration_sec <= b.start_sec + EPS
        assert all(r.start_sec >= 0 and r.start_sec + r.duration_sec <= length + EPS for r in plan)
        pools = {p: [r for r in plan if r.pool == p] for p in ("search", "holdout", "reserve")}
        if any("whole_video" in r.reasons for r in plan):
            assert len(plan) == 1
            continue
        assert any("unscouted_validation" in r.reasons for r in pools["holdout"])
        assert 1 <= len(pools["search"]) <= profile.search_windows[1]
        assert 1 <= len(pools["holdout"]) <= profile.holdout_target[1] and len(pools["reserve"]) <= profile.reserves
        slots = max(1, len(pools["search"]) // 2)
        for b in range(slots):
            inside = [r for r in pools["search"] if f"coverage_bin_{b + 1}" in r.reasons]
            assert all(b * length / slots <= r.start_sec + r.duration_sec / 2 < (b + 1) * length / slots for r in inside)
        if length >= 700:
            assert {"highest_si", "highest_ti", "global_hardest"} <= {x for r in pools["search"] for x in r.reasons}
    short = [r for s, d in rows if d == 12.0 for r in plans[s]]
    assert all(r.reasons == ["whole_video"] for r in short)


def test_plan_needs_matching_observations(spark):
    sources = spark.createDataFrame([(1, 900.0), (2, 900.0)], "source_id long, duration_sec double")
    risk = _scored(spark, sources, 0).filter("source_id = 2 OR window_id <> 'scout-004'")
    windows, rejects = sampling.sample_plan(risk, sources)
    assert {r.source_id for r in windows.collect()} == {2}
    assert [(r.source_id, r.reason) for r in rejects.collect()] == [(1, "observations do not match the scout grid")]


def test_diverse_pick_against_one_by_one(spark):
    sources = spark.createDataFrame([(i, 60.0 + 170 * i) for i in range(1, 8)], "source_id long, duration_sec double").cache()
    risk = _scored(spark, sources, 3).cache()
    chosen = risk.filter("window_id IN ('scout-002', 'scout-009')").select("source_id", F.col("window_id").alias("scout_id"), "start_sec")
    got = {}
    for r in sampling.greedy_diverse_pick(risk, chosen, sources, 3, capacity_reserve=2).collect():
        got.setdefault(r.source_id, []).append((r.pick_no, r.scout_id))
    held = {}
    for r in chosen.collect():
        held.setdefault(r.source_id, []).append((r.scout_id, r.start_sec))
    seen = {}
    for r in risk.collect():
        seen.setdefault(r.source_id, []).append(r)
    for s in sources.collect():
        total, base = s.duration_sec, held[s.source_id]
        spot = {r.window_id: min(max(0, r.start_sec + r.duration_sec / 2 - 2.5), total - 5) for r in seen[s.source_id]}
        center = {r.window_id: r.start_sec + r.duration_sec / 2 for r in seen[s.source_id]}
        taken, gone, picks = list(base), {i for i, _ in base}, []

        def free(windows):
            n, last = 0, float("-inf")
            for name, at in sorted(spot.items(), key=lambda x: (x[1], x[0])):
                clash = any(name == w or abs(at - p) < 5 - EPS for w, p in windows)
                if not clash and at - last >= 5 - EPS:
                    n, last = n + 1, at
            return n

        while len(picks) < 3:
            left = [r for r in seen[s.source_id] if r.window_id not in gone]
            if not left:
                break

            def score(r):
                gap = min(abs(center[r.window_id] - (p + 2.5)) for _, p in taken)
                return (0.7 * r.difficulty + 0.3 * min(1.0, gap / max(total / (3 + len(base)), 1.0)), r.difficulty, -r.start_sec, r.window_id)

            best = max(left, key=score).window_id
            gone.add(best)
            if any(abs(spot[best] - p) < 5 - EPS for _, p in taken) or free([*taken, (best, spot[best])]) < 3 - len(picks) - 1 + 2:
                continue
            picks.append(best)
            taken.append((best, spot[best]))
        assert [w for _, w in sorted(got.get(s.source_id, []))] == picks


def _counted(spark, risk):
    """``risk`` whose difficulty counts how often it is worked out."""
    times = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(value):
        times.add(1)
        return value

    return risk.withColumn("difficulty", seen.asNondeterministic()("difficulty")), times


def test_plan_scores_observations_once(spark):
    sources = spark.createDataFrame([(i, 60.0 + 170 * i) for i in range(1, 8)], "source_id long, duration_sec double").cache()
    risk = _scored(spark, sources, 3).cache()
    counted, times = _counted(spark, risk)
    windows, rejects = sampling.sample_plan(counted, sources)
    want, _ = sampling.sample_plan(risk, sources)
    assert sorted(map(str, windows.collect())) == sorted(map(str, want.collect())) and rejects.count() == 0
    assert times.value == risk.count()


def test_plan_of_sources_listed_twice(spark):
    sources = spark.createDataFrame([(1, 900.0), (2, 900.0), (2, 900.0), (3, 900.0), (3, 2000.0), (None, 900.0)], "source_id long, duration_sec double")
    once = sources.filter("source_id IS NOT NULL").groupBy("source_id").agg(F.min("duration_sec").alias("duration_sec"))
    risk = _scored(spark, once, 1).cache()
    windows, rejects = sampling.sample_plan(risk, sources)
    alone, _ = sampling.sample_plan(risk, once)
    rows = {s: sorted((r.pool, r.window_id, r.start_sec) for r in alone.collect() if r.source_id == s) for s in (1, 2)}
    got = windows.collect()
    assert [sorted((r.pool, r.window_id, r.start_sec) for r in got if r.source_id == s) for s in (1, 2)] == [rows[1], rows[2]]
    # One plan for either length; the grid has 20 windows for both.
    assert sum(r.window_id == sampling.BLIND for r in got if r.source_id == 3) == 2
    assert [(r.source_id, r.reason) for r in rejects.collect()] == [(None, "observations do not match the scout grid")]


def test_whole_sources_across_batches(monkeypatch):
    sizes = [3, 1, 4, 20, 2, 2, 7, 1]
    rows = [(i, n) for i, n in enumerate(sizes) for _ in range(n)]
    for limit in (1, 5, 1000):
        monkeypatch.setattr(greedy, "ROWS", limit)
        for step in (1, 3, 8, 100):
            batches = [pa.RecordBatch.from_pydict({"k": [k for k, _ in rows[i : i + step]], "_n": [n for _, n in rows[i : i + step]]}) for i in range(0, len(rows), step)]
            got = []
            for table, starts in greedy.whole_sources(iter(batches)):
                keys = table.column("k").to_pylist()
                assert [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] == starts.tolist()
                got += keys
            assert got == [k for k, _ in rows]


def test_diverse_pick_beside_a_column(spark, tmp_path):
    sources = spark.createDataFrame([(i, 60.0 + 170 * i) for i in range(1, 8)], "source_id long, duration_sec double").cache()
    risk = _scored(spark, sources, 3).cache()
    hardest = F.max_by(F.struct(F.col("window_id").alias("scout_id"), "start_sec"), F.struct("difficulty", "window_id"))
    chosen = risk.groupBy("source_id").agg(hardest.alias("w")).select("source_id", "w.*")
    want = sampling.greedy_diverse_pick(risk, chosen, sources, 3)
    counted, times = _counted(spark, risk)
    got = sampling.greedy_diverse_pick(counted, F.array(hardest.over(Window.partitionBy("source_id"))), sources, 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert times.value == risk.count()
    # The query makes its scouts once, and they do not move after that.
    orders = spark.createDataFrame([(i, 1, "F", 10.0) for i in range(1, 60)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    picks = all_queries()["w13_greedy_diverse_pick"](spark, str(tmp_path))
    assert picks.count() == 118
    plan = picks._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Generate ") == 1
