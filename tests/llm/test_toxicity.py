"""Toxicity: held-out accuracy, and the scorer against a plain sum of weights."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from ratelens.llm import toxicity
from ratelens.llm.toxicity import fit_toxicity, score_toxicity

RUDE = ["numbskull", "dimwit", "blockhead", "halfwits", "halfwittery"]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts, marks = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(RUDE))
        texts.append((i, " ".join(own)))
        marks.append((i, toxic))
    return texts, marks


@pytest.fixture(scope="module")
def fitted(spark):
    texts, marks = corpus(1, 900)
    t = spark.createDataFrame(texts, "item_id long, text string")
    m = spark.createDataFrame(marks, "item_id long, toxic int")
    model = fit_toxicity(t, m.where("item_id % 5 != 0")).cache()
    return t, dict(marks), model


def test_held_out_accuracy(fitted):
    t, marks, model = fitted
    rows = score_toxicity(t.where("item_id % 5 = 0"), model).collect()
    right = [(r.score >= 0.5) == marks[r.item_id] for r in rows]
    assert len(rows) == 180 and sum(right) >= 176
    assert 0 < model.count() < 5000


def test_score_is_the_sum_over_distinct_features(fitted):
    t, _, model = fitted
    weights = {r.slot: r.weight for r in model.collect()}
    for r, text in zip(sorted(score_toxicity(t, model).collect())[:50], sorted(t.collect())[:50]):
        slots = {0}
        for found, _ in toxicity._features(pa.array([text.text])):
            slots |= set(found.tolist())
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(weights.get(s, 0.0) for s in slots))))


def test_features_stay_inside_a_text():
    column = pa.array(["a b", None, "c", "d e f"])
    kinds = [np.diff(bounds).tolist() for _, bounds in toxicity._features(column)]
    assert kinds == [[2, 0, 1, 3], [2, 0, 1, 3], [1, 0, 0, 2], [0, 0, 0, 1]]
    for found, bounds in toxicity._features(column):
        assert len(found) == bounds[-1]


def test_odd_input(spark, fitted):
    _, _, model = fitted
    rows = [(1, None, 7), (2, "", 8), (2, "", 8), (None, "dimwit dimwit halfwits " * 9, 9), (5, "w1 " * 50_000, 1)]
    df = spark.createDataFrame(rows, "item_id long, text string, score int")
    got = {(r.item_id, r.extra): r.score for r in score_toxicity(df.withColumnRenamed("score", "extra"), model, carry=("extra",)).collect()}
    assert got[1, 7] == got[2, 8] < 0.5 < got[None, 9] and len(got) == 4
    assert score_toxicity(df, model).count() == 5 and score_toxicity(df.where("false"), model).count() == 0
    empty = fit_toxicity(df, spark.createDataFrame([(1, None), (None, 1)], "item_id long, toxic int"))
    assert empty.count() == 0
    assert {r.score for r in score_toxicity(df, empty).collect()} == {0.5}


def test_sample_is_bounded_and_repeatable(spark):
    texts, marks = corpus(2, 300)
    t = spark.createDataFrame(texts, "item_id long, text string")
    m = spark.createDataFrame(marks, "item_id long, toxic int")
    one = fit_toxicity(t, m, sample=100).orderBy("slot").collect()
    assert one == fit_toxicity(t.repartition(7), m.repartition(2), sample=100).orderBy("slot").collect()
