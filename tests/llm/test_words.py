"""Word hashes against a regular expression."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratelens.llm import words

PATTERNS = [(words.SPACED, r"[^\x20\x09-\x0D]+"), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]
SEEN = {}


def check(texts, kind, pattern):
    hashes, bounds = words.hash_words(pa.array(texts, pa.string()), kind)
    for i, text in enumerate(texts):
        want = re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        got = hashes[bounds[i] : bounds[i + 1]].tolist()
        assert len(got) == len(want)
        for word, value in zip(want, got):
            assert SEEN.setdefault(word, value) == value
    assert len(set(SEEN.values())) == len(SEEN)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"]), max_size=40)), max_size=8))
def test_any_texts(texts):
    for kind, pattern in PATTERNS:
        check(texts, kind, pattern)


@pytest.mark.parametrize("kind,pattern", PATTERNS)
def test_texts_and_words_longer_than_a_piece(kind, pattern):
    n = words.PIECE
    check(["a" * (3 * n) + " b " + "c " * n, None, "", "a" * (3 * n), "x" * (n - 1) + " yy", "é" * n], kind, pattern)


def test_combinations_and_leads():
    hashes, bounds = words.hash_words(pa.array(["a b c d", "b c"]), words.SPACED)
    pairs = words.combine(hashes, (0, 1))
    assert pairs[1] == pairs[4] and len(set(pairs.tolist())) == 4
    assert len(words.combine(hashes[:1], (0, 1))) == 0
    lead, _ = words.hash_words(pa.array(["abcdefg abcdexx abcdx"]), words.ALNUM, lead=5)
    assert lead[0] == lead[1] != lead[2]


def test_slices_cover_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 50, None, "", "y" * 500, "z"])], names=["t"])
    parts = list(words.slices(batch, "t", 100))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and len(parts) > 1
    assert not list(words.slices(batch.slice(0, 0), "t", 100))
    assert np.all(words.buffers(batch.column("t").slice(3))[1] == [0, 500, 501])
