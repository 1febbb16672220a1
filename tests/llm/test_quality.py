"""Quality: held-out accuracy, shrinkage, and the joined odds by hand."""

import math
import random

import pytest

from ratelens.llm.quality import BINS, clip_quality, log_bins


def corpus(seed, n):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        root = rng.choice("abcd")
        good = int(rng.random() < {"a": 0.95, "b": 0.7, "c": 0.4, "d": 0.7}[root])
        words = [rng.choice("the frame rate of a clip was measured here".split()) + str(rng.randrange(90)) for _ in range(60)]
        if not good:
            words = rng.choice([[w + "###" for w in words], words[:2] * 30, [w.upper() for w in words]])
        rows.append((i, " ".join(words), root, rng.choice(["x", "y"])))
        marks.append((i, good))
    return rows, marks


SCHEMA = "item_id long, log string, root string, dir string"


@pytest.fixture(scope="module")
def scored(spark):
    rows, marks = corpus(1, 600)
    df = spark.createDataFrame(rows, SCHEMA)
    m = spark.createDataFrame(marks, "item_id long, good int").where("item_id % 5 != 0")
    return dict(marks), clip_quality(df, m).collect()


def test_held_out_accuracy(scored):
    marks, rows = scored
    held = [r for r in rows if r.item_id % 5 == 0]
    assert len(rows) == 600 and sum(r.kept == bool(marks[r.item_id]) for r in held) >= 0.97 * len(held)


def test_rates_shrink_and_odds_add_up(scored):
    _, rows = scored
    rates = {r.root_rate for r in rows}
    assert len(rates) == 4 and 0.3 < min(rates) < max(rates) < 0.99
    for r in rows[:50]:
        odds = math.log(r.folder_rate / (1 - r.folder_rate)) + r.evidence
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds))) and r.kept == (r.score >= 0.5)


def test_sparse_roots_stay_near_the_prior(spark):
    rows = [(i, "a log line", f"r{i % 3}" if i < 90 else "new", "d") for i in range(93)]
    marks = [(i, int(i % 3 > 0 or i % 10 == 0)) for i in range(91)]
    got = clip_quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "item_id long, good int")).collect()
    rate = {r.item_id: r.root_rate for r in got}
    prior = sum(g for _, g in marks) / len(marks)
    assert abs(rate[92] - prior) < abs(rate[0] - prior)
    assert prior < rate[92] < 1 or rate[92] == pytest.approx(prior, abs=0.1)


def test_odd_input(spark):
    rows = [(1, None, None, None), (2, "", "a", None), (2, "", "a", None), (None, "x", "a", "b")]
    df = spark.createDataFrame([(*r, 0.1, "z") for r in rows], SCHEMA + ", score double, good string")
    none = spark.createDataFrame([(9, 1), (None, 1), (1, None)], "item_id long, good int")
    got = clip_quality(df, none).collect()
    assert len(got) == 4 and all(r.score == pytest.approx(0.5) for r in got)
    some = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "item_id long, good int")
    assert len(clip_quality(df, some).collect()) == 4
    assert clip_quality(df.where("false"), some).count() == 0
    assert len(log_bins(df.select("item_id", "log")).columns) == 1 + len(BINS)
