"""Operators give the same answer however small the chunks of a large group are."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ratelens.operators import intervals, ranking, selection, verification


def test_final_gate_is_chunk_independent(spark):
    rng = random.Random(9)
    edges = [0, 7, 60, 61, 130, 200]
    scores = [(1, i, rng.uniform(60, 100), 12.0) for i in range(200)]
    frames = spark.createDataFrame(scores, "clip_id int, frame_no long, score double, fps double")
    shots = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "clip_id int, shot_idx long, start_frame long, end_frame long")
    values = [s[2] for s in scores]

    def worst(part):
        n = min(len(part), 12)
        return min(sum(part[i : i + n]) / n for i in range(len(part) - n + 1))

    for size in (1 << 16, 25):
        got = sorted(verification.final_gate(frames, shots, 80.0, frames_per_chunk=size).collect(), key=lambda r: r.shot_idx)
        for r, a, b in zip(got, edges, edges[1:]):
            assert abs(r.mean_vmaf - sum(values[a:b]) / (b - a)) < 1e-9 and abs(r.worst_1s_vmaf - worst(values[a:b])) < 1e-9
            if b < 200:
                crossing = [sum(values[s : s + 12]) / 12 for s in range(max(0, b - 11), min(b, 189))]
                assert abs(r.boundary_worst_1s - min(crossing)) < 1e-9


OVERLAP = "k int, window_id int, start_sec double, duration_sec double"


def _overlaps(spark, a, b):
    found = intervals.interval_overlaps(spark.createDataFrame(a, OVERLAP), spark.createDataFrame(b, OVERLAP), ["k"])
    return sorted((r.k, r.a_window_id, r.b_window_id) for r in found.collect())


def _all_pairs(a, b):
    return sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[2] + y[3] - 1e-9 and y[2] < x[2] + x[3] - 1e-9)


def test_overlaps_of_any_length(spark):
    rng = random.Random(6)

    def some(n):
        lengths = [lambda: 2.0 ** rng.uniform(-25, 20), lambda: rng.uniform(0.1, 80), lambda: float(rng.randrange(5)), lambda: 2.0 ** rng.randrange(-3, 9)]
        return [(rng.randrange(2), i, float(rng.randrange(-40, 400)) + rng.choice((0, rng.random())), rng.choice(lengths)()) for i in range(n)]

    a, b = some(150), some(150)
    a += [(0, 900, 1e9, 1e-10), (0, 901, -5.0, -1.0), (0, 902, 3.0, 1e9)]
    b += [(0, 900, 1e9, 1e-10), (0, 903, 3.0, 1e9), (0, 904, 3.0, 0.0), (None, 905, 3.0, 5.0)]
    assert _overlaps(spark, a, b) == _all_pairs(a, b)
    assert _overlaps(spark, a, a) == _all_pairs(a, a)
    assert _overlaps(spark, a, []) == _overlaps(spark, [], b) == []


def test_a_year_beside_short_intervals(spark):
    year = 365 * 86_400.0
    short = spark.range(200_000).selectExpr("1 AS k", "CAST(id AS INT) AS window_id", "id * 200.0D AS start_sec", "0.5D AS duration_sec")
    long = spark.createDataFrame([(1, -1, 0.25, year), (1, -2, year + 0.25, 60.0)], OVERLAP)
    pairs = intervals.interval_overlaps(short, long, ["k"])
    inside = sum(1 for i in range(200_000) if i * 200.0 < year + 0.25 - 1e-9 and 0.25 < i * 200 + 0.5)
    assert pairs.where("b_window_id = -1").count() == inside
    assert pairs.where("b_window_id = -2").count() == sum(1 for i in range(200_000) if year + 0.25 - 0.5 < i * 200.0 < year + 60.25)


def test_thresholds_of_a_hot_source(spark):
    rng = random.Random(8)
    rows = [(1, 1000 * i, 60 + i / 10 + rng.uniform(-3, 3)) for i in range(1, 301)]
    df = spark.createDataFrame(rows, "source_id int, bitrate_bps long, gate double")
    whole = selection.threshold_bitrate(df, F.lit(80.0)).first().threshold_bps
    assert selection.threshold_bitrate(df, F.lit(80.0), rows_per_chunk=20).first().threshold_bps == whole
    pairs = selection.nonmonotone_points(df, 0.5).count()
    assert pairs == sum(b[2] < a[2] - 0.5 for a, b in zip(rows, rows[1:]))
    assert selection.nonmonotone_points(df, 0.5, rows_per_chunk=20).count() == pairs


def test_ranks_of_nulls_do_not_depend_on_chunks(spark):
    rng = random.Random(12)
    values = [None, None, float("nan"), 0.0, -0.0, *[float(rng.randrange(6)) for _ in range(20)]]
    rows = [(k, i, rng.choice(values), rng.choice(values)) for k in ("a", "b", None) for i in range(40)] + [("one", 0, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, id int, v double, w double").repartition(4)
    n = F.count(F.lit(1)).over(Window.partitionBy("k"))
    want = df
    for name, column in (("rv", "v"), ("rw", "w")):
        line = Window.partitionBy("k").orderBy(column)
        ties = F.count(F.lit(1)).over(line.rangeBetween(Window.currentRow, Window.currentRow))
        middle = F.rank().over(line) - 1 + (ties - 1) / 2.0
        want = want.withColumn(name, F.when(n == 1, F.lit(0.5)).otherwise(middle / F.nullif(n - 1, F.lit(0))))
    want = {(r.k, r.id): (r.rv, r.rw) for r in want.collect()}
    for size in (None, 3):
        got = {(r.k, r.id): (r.rv, r.rw) for r in ranking.midranks(df, ["k"], {"rv": "v", "rw": "w"}, rows_per_chunk=size).collect()}
        assert got == want
    seen = df.select("k", "id", F.col("v").alias("si_p90"), F.col("w").alias("ti_p90"), F.lit(1.0).alias("max_scene_score"))
    for size in (None, 3):
        assert ranking.score_risk(seen, ["k"], rows_per_chunk=size).where("difficulty IS NULL").count() == 0


def test_common_values_are_ranked_like_others_and_dealt_out(spark):
    """Two thirds of the rows share one value or none; columns of two types; the rank by counting."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        x = 0.0 if i % 3 == 0 else None if i % 3 == 1 else round(rng.random(), 2)
        rows.append((i % 2 if i % 7 else None, i, x, rng.randrange(4), x and -x))
    rows.append((9, -1, 1.0, 1, None))
    df = spark.createDataFrame(rows, "source_id long, id long, a double, b long, c double").repartition(5)
    names = {"a_rank": "a", "b_rank": "b", "c_rank": "c"}
    out = ranking.midranks(df, ["source_id"], names, rows_per_chunk=200)
    assert out.columns == [*df.columns, *names]
    got = out.collect()
    assert sorted(r.id for r in got) == sorted(r[1] for r in rows)
    low = float("-inf")
    for name, k in (("a_rank", 2), ("b_rank", 3), ("c_rank", 4)):
        groups = {}
        for r in rows:
            groups.setdefault(r[0], []).append(low if r[k] is None else r[k])
        for r in got:
            own, v = groups[r.source_id], low if r[names[name]] is None else r[names[name]]
            want = 0.5 if len(own) == 1 else (sum(x < v for x in own) + (own.count(v) - 1) / 2) / (len(own) - 1)
            assert abs(r[name] - want) < 1e-12
    # Every common value is broadcast: nothing but rare values meets by value.
    ranks = ranking._value_ranks(df.withColumn("_k", F.struct("source_id")), {"b_rank": "b"}, None)
    assert ranks.where("_common").count() == ranks.count() - 1
    assert ranking.midranks(df.where("false"), ["source_id"], names).count() == 0
    assert ranking.midranks(df.limit(10), [], {"r": "b"}).count() == 10
