"""Mixes: highest quotients one by one, and the promises of the contract."""

import random
import re

import pytest

from ratelens.llm.mixing import family_quotas, family_targets, mix_families


def highest_quotients(votes, house):
    seats = [0] * len(votes)
    for _ in range(house):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


def targets_of(spark, votes):
    rows = [(f"f{i}", i, float(v)) for i, v in enumerate(votes)]
    return spark.createDataFrame(rows, "family string, place long, target double")


@pytest.mark.parametrize("votes,blocks,shards", [
    ([5, 3, 1], 17, 1), ([1, 1, 1, 1], 6, 3), ([1000, 1, 1, 1, 1], 200, 4), ([7, 0, 2.5], 1, 2), ([3] * 40, 25, 2),
    ([2 ** i for i in range(12)], 300, 5), ([1], 9, 2), ([0, 0], 5, 1),
])
def test_quotas_are_highest_quotients_at_every_shard(spark, votes, blocks, shards):
    rows = family_quotas(targets_of(spark, votes), blocks, shards).collect()
    for s in range(shards):
        got = [sum(r.blocks for r in rows if r.place == i and r.shard <= s) for i in range(len(votes))]
        live = [v for v in votes if v > 0]
        want = iter(highest_quotients(live, blocks * (s + 1) // shards) if live else ())
        assert got == [next(want) if v > 0 else 0 for v in votes]


def water_level(sizes, weights):
    total, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 3 * sizes[i]}
        for i in over or open_:
            out[i] = 3 * sizes[i] if over else share[i]
        open_ -= over or set(open_)
    return out


def test_targets_stop_at_three_times_the_size(spark):
    rng = random.Random(3)
    for _ in range(3):
        families = [f"s{rng.randrange(10**6):06d}" for _ in range(9)] + [None]
        sizes = [rng.choice([0, 1, 5, 300, 10_000]) for _ in families]
        df = spark.createDataFrame(list(zip(range(10), families, sizes)), "item_id long, family string, size long")
        got = {r.family: r for r in family_targets(df).collect()}
        order = sorted(families[:-1]) + [None]
        by = dict(zip(families, sizes))
        want = water_level([by[f] for f in order], [1 + i % 3 for i in range(10)])
        for i, f in enumerate(order):
            assert got[f].place == i and got[f].weight == 1 + i % 3
            assert got[f].target == pytest.approx(want[i])


def logs_of(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        family = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "é", "zz", None])
        text = rng.choice(["\n", " ", "\t "]).join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(40)))
        rows.append((i, family, text if rng.random() < 0.95 else None))
    return rows


def test_contract(spark):
    rows = logs_of(1)
    df = spark.createDataFrame(rows, "item_id long, family string, log string")
    got = {r.item_id: r for r in mix_families(df).collect()}
    again = {r.item_id: r for r in mix_families(df.repartition(3), shards=5).collect()}
    assert got == again and len(got) == len(rows)
    taken, sizes, target = {}, {}, {}
    for i, family, text in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert got[i].size == size and 0 <= got[i].taken <= 3 * size
        sizes[family] = sizes.get(family, 0) + size
        taken[family] = taken.get(family, 0) + got[i].taken
        target[family] = got[i].target
    for f in sizes:
        assert abs(taken[f] - target[f]) <= 2 and all(got[i].family_size == sizes[f] for i, g, _ in rows if g == f)
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), abs=3)


def test_odd_input(spark):
    schema = "item_id long, family string, log string, size string, place int, target int"
    rows = [(1, "f", "a b", "x", 0, 0), (1, "f", "a b", "x", 0, 0), (None, None, "c", "x", 0, 0), (3, "g", None, "x", 0, 0)]
    got = sorted((str(r.item_id), r.size, r.taken, r.target) for r in mix_families(spark.createDataFrame(rows, schema)).collect())
    assert [g[:2] for g in got] == [("1", 2), ("1", 2), ("3", 0), ("None", 1)]
    assert sum(g[2] for g in got) == 5
    assert mix_families(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in mix_families(spark.createDataFrame(rows[3:], schema)).collect()] == [0]
