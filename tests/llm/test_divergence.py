"""Words of roots against those of their language."""

import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from ratelens.llm import divergence
from ratelens.llm.divergence import digests, root_divergence

SCHEMA = "subtitle string, language string, root string, n int, term string, value string"
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, top):
    rows = [(t or "", lang or "", root or "") for t, lang, root in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, counts = Counter(), defaultdict(Counter)
        for text, of, root in rows:
            if of == lang:
                words = LETTERS.findall(lowered(text))
                docs.update(set(words))
                counts[root].update(words)
        kept = [t for t, n in docs.items() if n >= least]
        whole = sum(counts.values(), Counter())

        def rates(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {r: rates(c) for r, c in counts.items()}, rates(whole)
        for root in counts:
            pairs = [(sum(abs(p[root][t] - p[o][t]) for t in kept), o) for o in counts if o != root]
            terms = [(p[root][t] - q[t], t) for t in kept if counts[root][t] and p[root][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, root, part, i, v, k + 1) for k, (v, i) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def run(spark, rows, **kw):
    table = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA).repartition(3)
    found = root_divergence(table, **kw)
    assert found.columns == ["language", "root", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def corpus(seed, n=240):
    dice = random.Random(seed)
    words = ["".join(dice.choice("abcdé") for _ in range(dice.randint(1, 3))) for _ in range(60)]
    rows = []
    for _ in range(n):
        lang, root = dice.choice(["en", "fr", None]), dice.choice(["a", "b", "c", None])
        text = " ".join(dice.choice(words[: 20 if root == "a" else 60]).title() for _ in range(dice.randint(0, 30)))
        rows.append((text, lang, root))
    return rows + rows[:40]


@pytest.mark.parametrize("bits", [63, 3])
def test_equals_plain_counting(spark, bits):
    """With three bits nearly every digest is shared by several terms and must be split."""
    rows = corpus(1)
    assert run(spark, rows, least=12, top=7, bits=bits) == plain(rows, 12, 7)


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), ("123 ...", "en", "b"), ("Straße straße STRASSE", "en", "c"), ("x", "lone", "a")]
    rows += [("same words here", "ties", r) for r in "abcd"]
    rows += [("ß" * 40_000 + " a " * 5_000, "long", "a"), ("a", "long", "b")]
    for least in (1, 2, 30):
        assert run(spark, rows, least=least) == plain(rows, least, 50)
    assert run(spark, []) == []


def test_one_root_holds_most(spark):
    rows = [("one two three", "en", "hot")] * 3_000 + [("one two two", "en", f"r{i % 7}") for i in range(70)]
    assert run(spark, rows) == plain(rows, 30, 50)


def test_digests_are_narrow():
    letters = pa.array(list("abcdefghijklmnopqrstuvwxyz") * 2)
    assert digests(letters, 3).max() < 8 and digests(letters).min() >= 0
    assert len(set(digests(letters).tolist())) == 26


GROWTH = """
import resource
import numpy as np, pyarrow as pa
from ratelens.llm import divergence

dice = np.random.default_rng(1)
letters = dice.integers(97, 123, (1_500_000, 6), np.uint8)
letters[:, 5] = 32
texts = pa.LargeStringArray.from_buffers(7_500, pa.py_buffer(np.arange(0, 9_000_001, 1_200)), pa.py_buffer(letters))
names = pa.array([str(i % 20) for i in range(7_500)])
batch = pa.record_batch([texts, names, names], ["subtitle", "language", "root"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(sum(out.column("n").drop_null().to_pylist()) for out in divergence._counted(63, False)(iter([batch, batch])))
assert n == 3_000_000, n
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_counting_takes_little_memory():
    """Two batches of 9 MB, nearly all of whose cells differ: a task holds compact cells of small slices."""
    done = subprocess.run([sys.executable, "-c", GROWTH], capture_output=True, text=True, check=True, timeout=120)
    assert int(done.stdout) < 1_000


def test_rows_are_handed_over_in_pieces():
    """A slice of many cells leaves in small batches, each language's digest with its subtitles and term once."""
    words = " ".join(a + b + c + d for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for c in "abcdefghijklmnop" for d in "abcdefghijklmnop")
    batch = pa.record_batch(
        [pa.array([words, words, "aaaa"]), pa.array(["en", "en", "fr"]), pa.array(["a", "b", "c"])], ["subtitle", "language", "root"]
    )
    found = list(divergence._counted(63, False)(iter([batch])))
    assert max(out.num_rows for out in found) <= divergence.OUT_ROWS
    rows = [r for out in found for r in out.to_pylist()]
    assert sum(r["n"] or 0 for r in rows) == 2 * 65_536 + 1
    assert Counter((r["language"], r["of_language"]) for r in rows if r["term"]) == {("en", 2): 65_536, ("fr", 1): 1}
    assert all((r["term"] is None) == (r["of_language"] is None) for r in rows)
