"""Near-copies against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest

from ratelens.llm import near_logs
from ratelens.llm.graph import components
from ratelens.llm.near_logs import near_copies


def words_of(log):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), log or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def brute(rows, n, percent=80):
    sets = {}
    for item, log in rows:
        w = words_of(log)
        sets[item] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df):
    return {r.item_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def mutated(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"frame:{i}" for i in range(400)] + ["vmaf", "SI", "ti", "é", "ß"]


@pytest.mark.parametrize("n", [2, 5])
def test_equals_all_pairs(spark, n):
    rng = random.Random(5)
    rows, item = [], 100
    for _ in range(12):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([3, 8, 40, 120]))]
        for share in (0, 0, 0.01, 0.03, 0.05, 0.08, 0.3):
            rows.append((item, " ".join(mutated(rng, base, share)).upper() if item % 3 else "\t".join(mutated(rng, base, share))))
            item += 1
    rows += [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "two words"), (7, "two  words")]
    df = spark.createDataFrame(rows, "item_id long, log string")
    assert result(near_copies(df, words=n)) == brute(rows, n)


def test_a_large_group_of_near_copies_in_small_blocks(spark, monkeypatch):
    """A chain through a group: neighbours are linked, its ends are not alike."""
    monkeypatch.setattr(near_logs, "BLOCK", 16)
    rng = random.Random(6)
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    rows = []
    for item in range(150):
        rows.append((item, " ".join(mutated(rng, base, rng.choice([0.02, 0.05, 0.1])))))
    got = result(near_copies(spark.createDataFrame(rows, "item_id long, log string"), words=2))
    assert got == brute(rows, 2)
    assert len({c for _, c, _ in got.values()}) > 3


def test_defined_results_of_odd_input(spark):
    rows = [(None, "same log text", "x"), (3, "same log text", "y"), (3, "same log text", "y"), (9, "same log text", None)]
    df = spark.createDataFrame(rows, "item_id long, log string, component_id string").withColumnsRenamed({})
    got = sorted(near_copies(df).collect(), key=str)
    assert sorted((str(r.item_id), str(r.component_id), r.kept) for r in got) == [
        ("3", "3", True), ("3", "3", True), ("9", "3", False), ("None", "None", True)
    ]
    assert near_copies(df.where("false")).count() == 0


def test_sketches_estimate_what_they_fold():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, (2, 50), dtype=np.uint64)
    samples = np.stack([near_logs._samples(np.concatenate([common, o])) for o in own])
    a, b = near_logs._sketches(samples).view(np.uint64)
    bits = int(np.bitwise_count(a ^ b).sum())
    lost = int((samples[0] != samples[1]).sum())
    assert bits % 2 == 0 and bits <= 2 * lost
    assert bits <= near_logs.differing_bits(0.9) < near_logs.differing_bits(0.8)


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(250)]
    edges += [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    up = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in up and b in up and a != b and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    assert got == up
