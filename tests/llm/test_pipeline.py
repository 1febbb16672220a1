"""The pipeline, stage by stage, against plain Python."""

import random
import re

import pytest
from test_leakage import brute as leaks_of
from test_near_logs import brute as copies_of

import corpus_pipeline
from ratelens.llm.credentials import base_spans
from ratelens.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RUDE = ["numbskull", "dimwit", "blockhead"]


def documents():
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(600)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    cases = [" ".join(prose(15)) for _ in range(6)]
    texts, toxic = [], []
    for i in range(260):
        words = prose(rng.randrange(20, 90))
        rude = rng.random() < 0.25
        for _ in range(4 * rude):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        if i % 9 == 0:
            words[5:5] = rng.choice(cases).split()
        if i % 11 == 0:
            words.insert(3, 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"')
        texts.append(" ".join(words))
        toxic.append(int(rude))
    for i in range(40):  # copies, exact or with one word changed
        words = texts[i * 5].split()
        if i % 2 and len(words) > 70:
            words[7] = "changed"
        texts.append(" ".join(words))
        toxic.append(toxic[i * 5])
    rows = [(i, t, "en", rng.choice(["a", "b", "c"]), len(t)) for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0), (None, texts[1], "en", "b", 9), (None, cases[0], "en", "c", 9)]
    rows.append(rows[2])
    return rows, list(enumerate(toxic)), cases


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rows, marks, cases = documents()
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(cases)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, dict(marks), cases


def stage(spark, name, given, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, given[0])
    assert out.schema.names == docs.schema.names or name == "mixing"
    return sorted(map(tuple, out.collect()), key=str)


def test_toxic_documents_go(spark, given):
    _, rows, marks, _ = given
    kept = {r[0] for r in stage(spark, "toxicity", given, rows)}
    wrong = [i for i in marks if (i in kept) == bool(marks[i])]
    assert len(wrong) <= 0.1 * len(marks) and {900, 901, None} <= kept
    assert all(i in kept for i in marks if not marks[i])


def test_one_of_each_group_stays(spark, given):
    rows = given[1]
    got = stage(spark, "near-dedup", given, rows)
    want = copies_of([(r[0], r[1]) for r in rows if r[0] is not None], 5)
    assert sorted(r[0] for r in got if r[0] is not None and r[0] != 1) == sorted(i for i, w in want.items() if w[2] and i != 1)
    assert [r[1] for r in got].count(rows[1][1]) == 1  # document 1, or its copy without an id
    assert len([r for r in got if r[0] == 2]) == 1


def test_leaked_documents_go(spark, given):
    _, rows, _, cases = given
    got = {(r[0], r[1]) for r in stage(spark, "decontamination", given, rows)}
    hits = leaks_of([((r[0], r[1]), r[1]) for r in rows], list(enumerate(cases)), 10)
    assert got == {key for key, (_, hit, _) in hits.items() if not hit}
    assert (None, cases[0]) not in got


def test_secrets_are_masked_and_the_rest_stays(spark, given):
    rows = given[1]
    got = {r[:2] for r in stage(spark, "secrets", given, rows)}
    done = stage(spark, "secrets", given, rows)
    assert len(done) == len(rows)
    for r in rows:
        if r[1] and base_spans(r[1]):
            assert (r[0], re.sub(r'token = "[0-9a-f]{40}', "[assign]", r[1])) in got
        else:
            assert (r[0], r[1]) in got
    assert all(r[4] == (len(r[1]) if r[1] is not None else None) for r in done)


def test_run_is_the_stages_in_turn(spark, given):
    rows = given[1]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, name, given, rows)
    mixed = stage(spark, "mixing", given, rows)
    ran = sorted(map(tuple, corpus_pipeline.run(spark, given[0]).collect()), key=str)
    assert ran == mixed and len(ran) == len(rows)
    assert sum(r[-1] for r in ran) == pytest.approx(sum(r[2] for r in ran), abs=4)


def test_extra_columns_of_any_name_come_through(spark, given):
    extra = ["item_id", "score", "scored", "kept", "size", "family", "log", "spans", "redacted", "document", "rows", "part", "n_hit"]
    rows = [r for r in given[1] if r[0] is not None]
    docs = spark.createDataFrame([(*r, *(f"{n}-{r[0]}" for n in extra)) for r in rows], SCHEMA + "".join(f", `{n}` string" for n in extra))
    for name, fn in corpus_pipeline.STAGES[:-1]:
        docs = fn(spark, docs, given[0])
        got = docs.collect()
        assert docs.columns == [*(f.split()[0] for f in SCHEMA.split(", ")), *extra]
        assert got and all(r[n] == f"{n}-{r.doc_id}" for r in got for n in extra)
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, given[0]).collect()) == len(got)


def test_empty_tables(spark, given, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{given[0]}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_under_one_id_are_judged_each(spark, given):
    """Clean texts stay whatever other text has their id; only equal rows are one."""
    _, rows, _, cases = given
    clean = [r[1] for r in rows[20:260] if r[1] and not any(c in r[1] for c in cases)][:4]
    twice = [(1, clean[0], "en", "a", 1), (1, clean[1], "en", "a", 1), (1, clean[1], "en", "a", 1), (2, clean[2], "en", "a", 1), (2, None, "en", "a", 1)]
    once = sorted({(r[0], r[1]) for r in twice}, key=str)
    assert sorted({(r[0], r[1]) for r in stage(spark, "near-dedup", given, twice)}, key=str) == once
    assert len(stage(spark, "near-dedup", given, twice)) == 4
    leaky = [*twice, (1, cases[0], "en", "a", 1), (3, clean[3], "en", "a", 1), (3, f"x {cases[1]} y", "en", "a", 1)]
    kept = [(r[0], r[1]) for r in stage(spark, "decontamination", given, leaky)]
    assert sorted(kept, key=str) == sorted([*[(r[0], r[1]) for r in twice], (3, clean[3])], key=str)
    # A copy elsewhere still is found, and the plain id is the one that stays.
    copies = [(7, clean[0], "en", "a", 1), (7, clean[1], "en", "a", 1), (9, clean[0], "en", "a", 1), (9, clean[1], "en", "a", 1)]
    left = [r[1] for r in stage(spark, "near-dedup", given, copies)]
    assert sorted(left) == sorted([clean[0], clean[1]])


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "secrets", "mixing"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
