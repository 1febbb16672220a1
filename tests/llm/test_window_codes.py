"""Product-quantisation codes of windows' feature vectors."""

import hashlib

import numpy as np
import pytest

from ratelens.llm import window_codes as wc
from ratelens.llm.window_codes import CoverTree, squared, window_codes

SCHEMA = "window_id long, features array<double>, pool string, features_2 int"


def plain(rows):
    """Contract in plain loops over whole numbers: {(id, vector, pool): [(code, error, pool_error, digest)]}."""
    kept = [
        (w, tuple(int(np.floor(1024 * x)) for x in v), p)
        for w, v, p in rows
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for n in sorted({len(v) for _, v, _ in kept}):
        own = [r for r in kept if len(r[1]) == n]
        cuts = [slice(p * n // 4, (p + 1) * n // 4) for p in range(4)]
        ids = sorted({w for w, _, _ in own}, key=lambda w: (w is None, w or 0))[:256]
        first = [min(v for w, v, _ in own if w == i) for i in ids]
        books = [[list(v[c]) for v in first] for c in cuts]

        def nearest(x, book):
            return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

        for _ in range(4):
            for c, book in zip(cuts, books):
                parts = [[] for _ in book]
                for _, v, _ in own:
                    parts[nearest(v[c], book)[1]].append(v[c])
                for i, part in enumerate(parts):
                    if part:
                        book[i] = [sum(column) // len(part) for column in zip(*part)]
        digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for w, v, p in own:
            near = [nearest(v[c], book) for c, book in zip(cuts, books)]
            out.append([w, p, "".join(f"{i:02x}" for _, i in near), sum(d for d, _ in near), digest])
    total = {}
    for _, p, _, error, _ in out:
        total[p] = total.get(p, 0) + error
    return sorted(((w, p, code, error, total[p], digest) for w, p, code, error, digest in out), key=repr)


def run(spark, rows, partitions=3):
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(partitions)
    return sorted((tuple(r) for r in window_codes(table).collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_loops(spark, seed, monkeypatch):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(12, 8))
    rows = [(int(i), (centres[dice.integers(12)] + dice.normal(size=8) * 0.02).tolist(), f"p{i % 3}") for i in range(700)]
    rows += [(5_000 + i, rows[3][1], None) for i in range(300)]  # one vector, many times
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.25, 0.0, 1.0], "a"), (1, [0.5, -0.25, 0.0, 1.0], "a"), (1, [0.1, 0.2, 0.3, 0.4], None),
        (None, [0.9, 0.9, 0.9, 0.9], None), (2, None, "a"), (3, [nan, 0.0, 0.0, 0.0], "a"), (4, [inf, 0.0, 0.0, 0.0], "b"),
        (5, [None, 0.0, 0.0, 0.0], "b"), (6, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], "b"), (7, [], "b"), (8, [0.3], "c"),
        (9, [1e5, -1e5, 3.0, 4.0], "c"),
    ]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_too_large(spark):
    with pytest.raises(ValueError, match="too large"):
        run(spark, [(1, [1e9, 0.0, 0.0, 0.0], "a")])


def test_lengths_do_not_depend_on_chunks(spark, monkeypatch):
    dice = np.random.default_rng(7)
    rows = [(i, dice.normal(size=4 + i % 3).tolist(), "a") for i in range(300)]
    whole = run(spark, rows, 1)
    assert whole == run(spark, rows, 7) == plain(rows)


@pytest.mark.parametrize("scale", [50, 1 << 20])
def test_cover_tree(scale):
    dice = np.random.default_rng(scale)
    points = (dice.normal(size=(900, 5)) * 3 + dice.integers(0, 4, size=(900, 1)) * 40) * scale
    points = points.astype(np.int64)
    points[100:200] = points[0]
    tree = CoverTree.load(CoverTree.grow(points).dump())
    assert sorted(tree.order.tolist()) == list(range(900)) and (tree.points == points[tree.order]).all()
    for i in range(len(tree.start)):
        covered = tree.points[tree.start[i] : tree.end[i]]
        away = squared(covered, tree.points[tree.centre[i]][None])[:, 0]
        assert np.isclose(np.sqrt(away.max()), tree.radius[i])
        kids = range(tree.child[i], tree.stop[i])
        assert sum(tree.end[k] - tree.start[k] for k in kids) in (0, len(covered))
        assert all(tree.radius[k] <= tree.radius[i] / 2 for k in kids)
    book = points[dice.integers(0, 900, 40)] + dice.integers(-3, 4, size=(40, 5))
    book[7] = book[3]
    start, end, entry = tree.assign(book)
    got = np.empty(900, int)
    for a, b, e in zip(start, end, entry):
        got[a:b] = e
    want = [min((((p - b) ** 2).sum(), i) for i, b in enumerate(book))[1] for p in tree.points.astype(object)]
    assert got.tolist() == want
    assert (end - start).max() > 50  # whole subtrees were assigned
    assert wc.ROWS_PER_TREE >= 900
