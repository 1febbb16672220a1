"""Exact top windows against all scores."""

import math
import random

import pytest

from ratelens.llm import nearest_windows
from ratelens.llm.nearest_windows import top_windows

INF, NAN = float("inf"), float("nan")


def brute(rows, queries, k, scale=256):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    every = {i: ints(v) for i, v in rows if i is not None and ints(v) is not None}
    out = []
    for q in sorted({q for q in queries if q in every}):
        scored = [(-sum(a * b for a, b in zip(every[q], v)), i) for i, v in every.items() if i != q and len(v) == len(every[q])]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def result(df):
    return sorted((r.query_id, r.rank, r.window_id, r.score) for r in df.collect())


@pytest.mark.parametrize("bits,k", [(1, 5), (4, 3), (8, 5)])
def test_equals_all_scores(spark, monkeypatch, bits, k):
    monkeypatch.setattr(nearest_windows, "QUERIES_PER_PASS", 9)
    rng = random.Random(bits)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(400, [0.5] * 3), (401, [-0.5] * 3), (402, []), (403, [0.1, None]), (404, [NAN] * 12), (405, [INF] * 12), (406, None)]
    rows += [(-7, [1e3] * 12), (-14, [-1e3] * 12), (None, [0.1] * 12)]
    df = spark.createDataFrame(rows, "window_id long, features array<double>").repartition(5)
    queries = [i for i, _ in rows if i is not None and i % 7 == 0]
    assert result(top_windows(df, df.where("window_id % 7 = 0"), k=k, bits=bits)) == brute(rows, queries, k)


def test_few_rows_and_odd_input(spark):
    rows = [(0, [0.5]), (1, [0.25]), (1, [0.25])]
    df = spark.createDataFrame([(*r, 1, 1.5) for r in rows], "window_id long, features array<float>, rank int, score double")
    assert result(top_windows(df, df)) == [(0, 1, 1, 128 * 64), (1, 1, 0, 128 * 64)]
    assert top_windows(df, df.where("false")).count() == 0
    assert top_windows(df.where("false"), df).count() == 0
    assert top_windows(df.where("window_id = 0"), df.where("window_id = 0")).count() == 0


def test_large_components_are_not_clamped(spark):
    rows = [(0, [1.0, 0.0]), (1, [300_000.0, 1.0]), (2, [299_999.0, 0.0]), (3, [-2e6, 5.0])]
    df = spark.createDataFrame(rows, "window_id long, features array<double>")
    queries = df.where("window_id IN (0, 3)")
    assert result(top_windows(df, queries)) == brute(rows, [0, 3], 5)
    assert result(top_windows(df, queries))[:2] == [(0, 1, 1, 256 * 76_800_000), (0, 2, 2, 256 * 76_799_744)]


def test_scores_beyond_a_long_are_refused(spark):
    rows = [(0, [2.0**22, 1.0]), (1, [2.0**22 - 1, -3.0])]
    df = spark.createDataFrame(rows, "window_id long, features array<double>")
    assert result(top_windows(df, df)) == brute(rows, [0, 1], 5)
    wide = spark.createDataFrame([(0, [2.0**24, 1.0])], "window_id long, features array<double>")
    with pytest.raises(ValueError, match="too large"):
        top_windows(wide, wide)


def test_equal_vectors_are_one_candidate(spark, monkeypatch):
    """Thousands of equal vectors and queries bound one row per query class and class."""
    written = {}
    spill = nearest_windows.spill

    def counted(df, name):
        out = spill(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(nearest_windows, "spill", counted)
    rows = [(i, [0.25, -0.5, 0.75]) for i in range(3_000)] + [(5_000 + i, [0.25, -0.5, 0.7 - i / 10]) for i in range(4)]
    df = spark.createDataFrame(rows, "window_id long, features array<double>").repartition(5)
    queries = [i for i, _ in rows if i % 50 == 0]
    assert result(top_windows(df, df.where("window_id % 50 = 0"))) == brute(rows, queries, 5)
    assert written["window-bounds"] <= 10 and written["window-able"] <= 10


def test_candidates_are_let_go(spark, monkeypatch):
    monkeypatch.setattr(nearest_windows, "HELD_ROWS", 50)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "window_id long, features array<double>").repartition(3)
    assert result(top_windows(df, df.where("window_id % 9 = 0"))) == brute(rows, range(0, 400, 9), 5)
