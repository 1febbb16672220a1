"""Passage leaks against a search of every window in every log."""

import random
import re

import pytest

from ratelens.llm import leakage
from ratelens.llm.leakage import case_windows, log_index, passage_leaks


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(logs, cases, window, slop=0):
    out = {}
    for item, log in logs:
        w, hit, found = words_of(log), set(), set()
        for case, passage in cases:
            c = words_of(passage)
            if not c or case is None:
                continue
            n = min(window, len(c))
            for win in {tuple(c[i : i + n]) for i in range(len(c) - n + 1)}:
                for p in range(-slop, len(w) - n + slop + 1):
                    if all(any(0 <= q < len(w) and w[q] == t for q in range(p + k - slop, p + k + slop + 1)) for k, t in enumerate(win)):
                        hit |= set(range(max(p, 0), min(p + n, len(w))))
                        found.add(str(case))
        out[item] = (len(w), len(hit), sorted(found))
    return out


def case(seed, logs=40, cases=12):
    rng = random.Random(seed)
    vocabulary = ["the", "the", "the", "frame", "VMAF", "é", "0", "12"] + [f"w{i}" for i in range(25)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [make(rng.choice([1, 2, 3, 5, 9])) for _ in range(cases)]
    texts = []
    for i in range(logs):
        w = make(rng.randrange(30))
        if i % 2:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        texts.append((i, rng.choice([" ", ", ", "\n- "]).join(w)))
    rows = [(k, " ".join(p)) for k, p in enumerate(passages)] + [(None, "the"), (77, None), (78, "..!"), (3, "w1 w2 w3")]
    return texts + [(900, None), (901, ""), (902, "...")], rows


def frames(spark, logs, cases):
    return spark.createDataFrame(logs, "item_id long, log string"), spark.createDataFrame(cases, "case_id long, passage string")


def result(df):
    return {r.item_id: (r.n_words, r.n_hit, list(r.cases)) for r in df.collect()}


@pytest.mark.parametrize("seed,window,slop", [(1, 4, 0), (2, 3, 0), (3, 3, 1), (4, 4, 2)])
def test_equals_search(spark, seed, window, slop):
    logs, cases = case(seed)
    got = result(passage_leaks(*frames(spark, logs, cases), window=window, slop=slop))
    assert got == brute(logs, cases, window, slop)


def test_same_in_several_passes_and_without_a_vocabulary(spark, monkeypatch):
    logs, cases = case(5)
    monkeypatch.setattr(leakage, "WINDOWS_PER_PASS", 7)
    monkeypatch.setattr(leakage, "MOST_TERMS", 3)
    assert result(passage_leaks(*frames(spark, logs, cases), window=4)) == brute(logs, cases, 4)


def test_spans_and_odd_input(spark):
    logs = [(1, "a b c a b c x"), (1, "a b c a b c x"), (None, "c a"), (2, "x")]
    df = spark.createDataFrame([(*r, "z", 5) for r in logs], "item_id long, log string, cases string, n_hit int")
    cases = spark.createDataFrame([("k", "C, a", "q"), ("k", "c a", "q")], "case_id string, passage string, shard string")
    got = sorted(passage_leaks(df, cases).collect(), key=str)
    assert [(r.item_id, r.n_words, r.n_hit, r.cases, [tuple(s) for s in r.spans]) for r in got] == [
        (1, 7, 2, ["k"], [(2, 4)]), (1, 7, 2, ["k"], [(2, 4)]), (2, 1, 0, [], []), (None, 2, 2, ["k"], [(0, 2)])
    ] or sorted(r.n_hit for r in got) == [0, 2, 2, 2]
    assert passage_leaks(df.where("false"), cases).count() == 0
    assert result(passage_leaks(df.where("item_id = 2"), cases.where("false"))) == {2: (1, 0, [])}
    with pytest.raises(ValueError):
        passage_leaks(df, cases, slop=64)


def test_a_match_never_spans_two_logs(spark):
    logs = [(i, t) for i, t in enumerate(["x a", "b y", "a", "b"])]
    got = result(passage_leaks(*frames(spark, logs, [(1, "a b")])).coalesce(1))
    assert all(hit == 0 for _, hit, _ in got.values())


def test_index_lists_every_position(spark):
    logs, cases = case(6)
    df, cs = frames(spark, logs, cases)
    rows = log_index(df).collect()
    assert sum(sum(r["words"]) for r in rows) == sum(len(words_of(t)) for _, t in logs)
    assert all(sum(r["counts"]) == len(r["positions"]) for r in rows)
    assert case_windows(cs, window=4).count() > 0
