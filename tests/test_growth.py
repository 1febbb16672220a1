"""Plans that must not grow faster than their input: what is joined, written or merged."""

import os
import random

from ratelens.operators import frames, intervals, planning, ranking
from ratelens.queries import ingest
from ratelens.queries import ranking as ranking_queries
from ratelens.queries.registry import Inputs
from ratelens.session import shared_dir
from ratelens.sources import manifest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_groups_are_ranked_without_counts_and_joins(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, 1.0, 2.0, float("nan"), rng.random()])) for k in range(20) for i in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "k int, id int, v double").repartition(4)
    out = ranking.midranks(df, ["k"], {"r": "v"})
    assert "Join" not in _plan(out)
    counted = ranking._counted_ranks(df, ["k"], {"r": "v"}, None)
    assert sorted(map(tuple, out.select("k", "id", "r").collect())) == sorted(map(tuple, counted.select("k", "id", "r").collect()))
    # Groups of 20 and more go the other way, and come out the same.
    mixed = ranking.midranks(df, ["k"], {"r": "v"}, rows_per_chunk=20)
    assert sorted(map(tuple, mixed.select("k", "id", "r").collect())) == sorted(map(tuple, out.select("k", "id", "r").collect()))


def test_scouts_never_move(spark):
    before = set(os.listdir(shared_dir(spark)))
    risk = ranking_queries._scouted(Inputs(spark, "/root/testdata/sf0.001"))
    assert _plan(risk).count("Exchange") == 1  # the sources
    assert risk.count() > 0 and set(os.listdir(shared_dir(spark))) == before


def test_window_sets_are_compared_in_one_pass(spark):
    e = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 5)], "source_id int, window_id int")
    a = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (2, 5), (3, 1)], "source_id int, window_id int")
    out = intervals.plan_matches_scout(e, a, ["source_id"])
    assert "Join" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1, False), (2, 0, 0, True), (3, 0, 1, False)]


def test_a_stem_with_many_pairs_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(planning, "PAIRS", 50, raising=False)
    videos = spark.createDataFrame([(i, "d", "a") for i in range(60)] + [(99, "e", "b.c")], "id int, dir string, stem string")
    subtitles = spark.createDataFrame([(i, "d", "a.srt") for i in range(40)] + [(77, "e", "b.c.srt")], "id int, dir string, name string")
    out = planning.match_sidecars(videos, subtitles)
    got = [(r.video_id, r.subtitle_id) for r in out.collect()]
    assert sorted(got) == sorted([(v, s) for v in range(60) for s in range(40)] + [(99, 77)])
    largest = max(len(part) for part in out.rdd.glom().collect())
    assert largest < len(got) / 2


def test_capacity_writes_its_rows_once(spark):
    """One chain of thousands of intervals: neither its rounds nor its overlaps with protected ones are written."""
    rng = random.Random(5)
    rows = [(1, i, rng.random() * 9_000, rng.choice([0.5, rng.random() * 4])) for i in range(6_000)]
    rows += [(k, i, rng.random() * 60, rng.random() * 9) for k in range(2, 40) for i in range(rng.randrange(1, 30))]
    held = [(1, -i, rng.random() * 9_000, rng.random()) for i in range(1, 900)] + [(k, 0, rng.random() * 60, 3.0) for k in range(2, 30)]
    schema = "k int, window_id int, start_sec double, duration_sec double"
    want = {}
    for k in {r[0] for r in rows}:
        ids, last = {h[1] for h in held if h[0] == k}, None
        kept = [(s, s + d) for g, i, s, d in rows if g == k and i not in ids]
        kept = [(s, e) for s, e in kept if not any(s < hs + hd - 1e-9 and hs < e - 1e-9 for g, _, hs, hd in held if g == k)]
        for s, e in sorted(kept, key=lambda x: x[1]):
            if last is None or s >= last - 1e-9:
                want[k], last = want.get(k, 0) + 1, e
    df, protected = spark.createDataFrame(rows, schema).repartition(4), spark.createDataFrame(held, schema)

    def written():
        return [d for _, found, _ in os.walk(shared_dir(spark)) for d in found if d.startswith(("chunks-", "rdd-"))]

    for size in (None, 7, 500):
        before = len(written())
        out = intervals.max_disjoint_count(df, ["k"], protected=protected, rows_per_chunk=size)
        assert {r.k: r.capacity for r in out.collect()} == want
        assert len(written()) - before <= 2  # the chunks, and one row for each


def test_manifests_are_read_once_from_few_files(spark):
    before = set(os.listdir(shared_dir(spark)))
    t = Inputs(spark, "/root/testdata/sf0.01")
    good, rejects = ingest._manifest(t)
    assert _plan(good).count("FileScan json") == 1
    assert good.count() + rejects.count() == t.measurements.count()
    (root,) = (os.path.join(shared_dir(spark), d) for d in set(os.listdir(shared_dir(spark))) - before)
    files = [os.path.join(folder, f) for folder, _, found in os.walk(root) for f in found if f.endswith(".txt")]
    manifests = t.measurements.selectExpr("floor(case_id / 200)").distinct().count()
    assert len(files) <= 8 < manifests == sum(len(open(f).readlines()) for f in files)


def test_ids_seen_before_in_their_manifest(spark, tmp_path):
    case = '{"id": "%s", "source": "s.mkv", "command": ["run"]}'
    docs = ['{"schema_version": 1, "cases": [%s]}' % ", ".join(case % i for i in ids) for ids in (["x", "y", " x ", "x"], ["x"])]
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(doc)
    (tmp_path / "all.txt").write_text("\n".join([*docs, "{broken"]))
    for path, lines in ((f"{tmp_path}/*.json", False), (f"{tmp_path}/all.txt", True)):
        good, rejects = manifest.load_manifest(spark, path, lines=lines)
        names = ["all.txt"] * 3 if lines else ["0.json", "0.json", "1.json"]
        assert sorted((r.manifest, r.pos, r.source) for r in good.collect()) == sorted(
            (f"{tmp_path}/{name}", pos, f"{tmp_path}/s.mkv") for name, pos in zip(names, (0, 1, 0))
        )
        assert sorted((r.pos, r.reason) for r in rejects.collect()) == [(2, "id is not unique"), (3, "id is not unique")]


def test_frame_numbers_are_counted_in_blocks(spark):
    rng = random.Random(4)
    cases = {
        "whole": list(range(1_000)), "none": [None], "one": [0], "late": list(range(1, 200)), "twice": [*range(130), 64],
        "gap": [i for i in range(300) if i != 127], "null": [*range(64), None], "below": [-1, *range(63)],
        "moved": [*range(63), -1], "far": [0, 1, 1 << 40], "swapped": [*range(64, 128), *range(64)], "short of one": [*range(63), 64],
    }
    cases |= {f"r{k}": [rng.randrange(-2, 70) for _ in range(rng.randrange(1, 70))] for k in range(40)}
    rows = [(k, i) for k, found in cases.items() for i in found]
    df = spark.createDataFrame(rows, "k string, i long").repartition(3)
    out = frames.check_contiguous(df, ["k"], "i")
    want = {k: (len(v), None not in v and sorted(v) == list(range(len(v)))) for k, v in cases.items()}
    assert {r.k: (r.frames, r.contiguous) for r in out.collect()} == want
    assert "bit_or" in _plan(out)
