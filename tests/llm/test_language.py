"""Languages: parsing against a search for longest matches, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ratelens.llm import language
from ratelens.llm.language import Languages, subtitle_language

SYLLABLES = {"en": "the ing tion er an ou".split(), "de": "sch ung ein ü ß ge".split(), "fr": "eau é tion oi que en".split()}


def make(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def plain(text):
    """Lower-case letters, one space for each run of anything else."""
    out = []
    for c in text:
        if c.isalpha():
            out.append(c.lower() if len(c.lower()) == 1 else c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


def phrases(text, taught):
    text, count, at = plain(text), 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in taught and text[at:end] in taught:
            end += 1
        count, at = count + 1, end
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    samples = {lang: make(rng, lang, 150) for lang in SYLLABLES}
    known = Languages(samples)
    texts = [make(rng, lang, rng.randrange(1, 60)) + rng.choice(["", "?!", " 12 "]) for lang in SYLLABLES for _ in range(8)]
    texts += ["Ж Ω", "", None, "42", "the", "É"]
    letters, got = known.phrases(pa.array(texts))
    for i, text in enumerate(texts):
        assert letters[i] == sum(c.isalpha() for c in text or "")
        if text and letters[i]:
            assert got[i].tolist() == [phrases(text, plain(samples[n])) for n in known.names]


def test_lanes_add_at_most_one_phrase_each(monkeypatch):
    rng = random.Random(3)
    known = Languages({lang: make(rng, lang, 100) for lang in SYLLABLES})
    column = pa.array([make(rng, lang, 700) for lang in SYLLABLES])
    _, whole = (known.phrases(column), monkeypatch.setattr(language, "LANE", 64))[0]
    letters, cut = known.phrases(column)
    assert np.all(cut >= whole) and np.all(cut <= whole + letters[:, None] // 30)
    assert cut.argmin(axis=1).tolist() == whole.argmin(axis=1).tolist()


@pytest.fixture(scope="module")
def subtitles(spark):
    rng = random.Random(4)
    rows = [(i, make(rng, lang, rng.randrange(8, 90)), lang) for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    return spark.createDataFrame(rows, "subtitle_id long, subtitle string, lang string").cache()


def test_held_out_accuracy(subtitles):
    found = subtitle_language(subtitles.where("subtitle_id % 5 = 0"), subtitles.where("subtitle_id % 5 != 0"), carry=("lang",))
    rows = found.collect()
    assert len(rows) == 60 and sum(r.lang == r.lang_pred for r in rows) >= 59
    assert all(0 < r.score <= 1 for r in rows)
    again = subtitle_language(subtitles.repartition(5), subtitles.where("subtitle_id % 5 != 0").repartition(3), carry=("lang",))
    assert {r.subtitle_id: r for r in rows} == {r.subtitle_id: r for r in again.collect() if r.subtitle_id % 5 == 0}


def test_odd_input(spark, subtitles):
    rows = [(1, None), (2, ""), (2, ""), (3, "12 ... "), (None, "schung"), (4, "the " * 30_000), (5, "퟿ Ж")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "subtitle_id long, subtitle string, lang_pred string, score double")
    got = subtitle_language(df, subtitles).collect()
    assert sorted((str(r.subtitle_id), r.lang_pred) for r in got if r.subtitle_id != 5) == [
        ("1", "und"), ("2", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("None", "de")
    ]
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert subtitle_language(df.where("false"), subtitles).count() == 0
    untaught = subtitle_language(df, df.withColumn("lang", df.lang_pred).where("false")).collect()
    assert {r.lang_pred for r in untaught} == {"und"} and len(untaught) == 7


def scripts(rng):
    """Per language, 300 letters of one block: no two languages share an order of letters, some share the letters."""
    han, hangul = range(0x4E00, 0x4E00 + 300), range(0xAC00, 0xAC00 + 300)
    kana, cyrillic, greek = range(0x30A1, 0x30F0), range(0x430, 0x450), range(0x3B1, 0x3C2)
    blocks = {"zh": han, "ja": [*kana, *han[:60]], "ko": hangul, "ru": cyrillic, "bg": cyrillic, "el": greek, "zh-x": han}
    return {
        name: ["".join(chr(rng.choice(block)) for _ in range(rng.randrange(2, 4))) for _ in range(150)]
        for name, block in blocks.items()
    }


def test_many_scripts_are_told_apart():
    rng = random.Random(5)
    words = scripts(rng) | {lang: [make(rng, lang, 1) for _ in range(150)] for lang in SYLLABLES}
    def text(lang, n):
        return " ".join(rng.choice(words[lang]) for _ in range(n))
    samples = {lang: text(lang, 1500) for lang in words}
    texts = [(lang, text(lang, 25)) for lang in words for _ in range(6)] + [(None, "\u0e01\u0e02 \u4e01\u30a2 the \u0416")]
    known = Languages(samples)
    _, got = known.phrases(pa.array([t for _, t in texts]))
    for i, (lang, one) in enumerate(texts):
        assert got[i].tolist() == [phrases(one, plain(samples[n])) for n in known.names]
        assert lang is None or known.names[got[i].argmin()] == lang
