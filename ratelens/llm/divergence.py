"""Which roots use other words than the rest of their language: an audit of sidecar subtitles.

Terms are counted as fixed-width digests; only those are shuffled with the counts.
Some rows also name the term, every term of a task at least once, from which the
smallest and the largest term of every digest that may be kept are taken. Where
they differ, two terms share the digest, and its counts are taken anew by the term
itself. Text comes back by a join, and only for the terms that are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.words import buffers, hash_words, slices
from ratelens.session import spill

#: Subtitles of a language that a term must occur in to be kept.
LEAST = 30
#: Terms reported per root.
TOP = 50
#: Added to each count of a kept term.
PRIOR = 5
DIGEST_BITS = 63
#: Bytes of text, and rows of counts, that a task works on at once, and rows that it hands over at once.
SLICE = 2 << 20
HELD_ROWS = 1 << 20
OUT_ROWS = 1 << 16
#: Kept terms per array when roots are compared.
BLOCK = 256

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_COUNTS = pa.schema([
    ("language", pa.large_string()), ("root", pa.large_string()), ("digest", pa.int64()), ("n", pa.int64()),
    ("docs", pa.int64()), ("term", pa.large_string()), ("of_language", pa.int64()),
])


def terms_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(terms, bounds): text ``i`` has the terms ``terms[bounds[i]:bounds[i + 1]]``, ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lowered."""
    data, offsets = buffers(column)
    letter = _LETTER[data]
    first = letter.copy()
    is_start = np.zeros(len(data) + 1, bool)
    is_start[offsets[:-1]] = True
    first[1:] &= ~letter[:-1] | is_start[1:-1]
    begins = np.flatnonzero(first)
    # Without what lies between them, terms follow each other directly.
    kept = np.cumsum(letter)
    ends = np.append(kept[begins] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    text = _LOWER[data[letter]]
    plain = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(text))
    return plain.dictionary_encode(), np.searchsorted(begins, offsets)


def digests(terms: pa.Array, bits: int = DIGEST_BITS) -> np.ndarray:
    """One number of ``bits`` bits for each of the terms, which are not empty."""
    return (hash_words(terms, np.ones(256, bool))[0] >> np.uint64(64 - bits)).astype(np.int64)


def _slice_cells(part: pa.RecordBatch, groups: dict[tuple, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(group, term, n, docs, terms) of a slice of subtitles; new groups are added to ``groups``."""
    terms, bounds = terms_of(part.column("subtitle"))
    labels = zip(part.column("language").to_pylist(), part.column("root").to_pylist())
    group = np.array([groups.setdefault(label, len(groups)) for label in labels], np.int64)
    size = max(1, len(terms.dictionary))
    of_text, n = np.unique(np.repeat(np.arange(len(group)) * size, np.diff(bounds)) + terms.indices.to_numpy(), return_counts=True)
    cells, order, starts = _grouped(group[of_text // size] * size + of_text % size)
    n, docs = np.add.reduceat(n[order], starts), np.diff(starts, append=len(order))
    return (cells // size).astype(np.int32), (cells % size).astype(np.int32), n, docs.astype(np.int32), terms.dictionary


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct, order, starts): the keys in order, and where each distinct one, none negative, starts there."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], order, starts


def _merged(held: list[tuple], groups: dict[tuple, int], bits: int, with_terms: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the slices' cells, ``OUT_ROWS`` at a time; every group has a row without a digest."""
    of_slices = pa.concat_arrays([terms for *_, terms in held]).dictionary_encode()
    terms, place = of_slices.dictionary, of_slices.indices.to_numpy()
    own = digests(terms, bits)
    # Without the terms themselves, those that share a digest go by the first of them.
    first = key = np.arange(len(terms))
    if not with_terms:
        _, first, key = np.unique(own, return_index=True, return_inverse=True)
    size = max(1, len(first))
    shifts = np.cumsum([0, *(len(terms) for *_, terms in held)])
    group, n, docs = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3))
    code = key[place[np.concatenate([h[1] + shift for h, shift in zip(held, shifts)])]]
    cells, order, starts = _grouped(group * np.int64(size) + code)
    n, docs = (np.add.reduceat(x[order], starts, dtype=np.int64) for x in (n, docs))
    group, code = cells // size, cells % size
    of_language, unnamed = np.zeros(len(cells), np.int64), np.full(len(cells), not with_terms)
    if not with_terms:
        languages = {language: i for i, language in enumerate(dict.fromkeys(language for language, _ in groups))}
        number = np.array([languages[language] for language, _ in groups], np.int64)
        _, order, starts = _grouped(number[group] * size + code)
        of_language[order[starts]] = np.add.reduceat(docs[order], starts)
        unnamed[order[starts]] = False
    names = [pa.array([g[i] for g in groups], pa.large_string()) for i in (0, 1)]
    for at in range(0, len(cells), OUT_ROWS):
        some = slice(at, at + OUT_ROWS)
        yield pa.record_batch(
            [*[name.take(pa.array(group[some])) for name in names], pa.array(own[first[code[some]]]), pa.array(n[some]), pa.array(docs[some]),
             terms.take(pa.array(first[code[some]], mask=unnamed[some])), pa.array(of_language[some], mask=unnamed[some] | with_terms)],
            schema=_COUNTS,
        )
    yield pa.record_batch([*names, *[pa.nulls(len(groups), t) for t in _COUNTS.types[2:]]], schema=_COUNTS)
    more = np.setdiff1d(np.arange(len(terms)), first)
    if len(more):
        empty = [pa.nulls(len(more), t) for t in _COUNTS.types]
        yield pa.record_batch([*empty[:2], pa.array(own[more]), *empty[3:5], terms.take(pa.array(more)), empty[6]], schema=_COUNTS)


def _counted(bits: int, with_terms: bool):
    """Subtitles -> rows of counts, with a language and a root.

    Unless ``with_terms``, the first row of a language's digest also has its
    subtitles in all roots and the term; further terms of a digest have own rows.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, groups, rows = [], {}, 0
        for batch in batches:
            for part in slices(batch, "subtitle", SLICE):
                held.append(_slice_cells(part, groups))
                rows += len(held[-1][0])
                if rows >= HELD_ROWS:
                    yield from _merged(held, groups, bits, with_terms)
                    held, groups, rows = [], {}, 0
        if held:
            yield from _merged(held, groups, bits, with_terms)

    return over


def _rate(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (n + PRIOR) / (total + PRIOR * terms)), in whole numbers."""
    return F.expr(
        f"1 + (CAST({n} + {PRIOR} AS DECIMAL(20, 0)) * 1000000000BD) DIV CAST({total} + {PRIOR} * {terms} AS DECIMAL(20, 0))"
    )


def _term_counts(texts: DataFrame, least: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, counts, names): groups; counts by (language, root, digest, split); smallest and largest term per digest.

    ``split`` is empty, or, where terms share a digest, the term itself.
    """
    kind = "language string, root string, digest long, n long, docs long, term string, of_language long"
    parts = spill(texts.mapInArrow(_counted(bits, False), kind), "term-parts")
    groups = spill(parts.where("digest IS NULL AND language IS NOT NULL").select("language", "root").distinct(), "term-groups")
    counts = parts.where("n IS NOT NULL").drop("term", "of_language")
    # Most terms are rare: what is shuffled by root is only of digests that may be kept.
    candidates = parts.where("of_language IS NOT NULL").groupBy("language", "digest").agg(F.sum("of_language").alias("docs"))
    candidates = candidates.where(F.col("docs") >= least)
    candidates = spill(candidates.select("language", "digest"), "term-candidates")
    counts = counts.join(candidates, ["language", "digest"], "left_semi")
    named = parts.where("term IS NOT NULL").select("digest", "term")
    named = named.join(candidates.select("digest").distinct(), "digest", "left_semi")
    names = spill(named.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "term-names")
    shared = names.where("low != high").select("digest")
    counts = counts.withColumn("split", F.lit(""))
    if not shared.isEmpty():
        again = texts.mapInArrow(_counted(bits, True), kind).where("n IS NOT NULL")
        again = again.drop("of_language").withColumnRenamed("term", "split")
        again = again.join(shared, "digest", "left_semi")
        counts = counts.join(shared, "digest", "left_anti").unionByName(again)
    summed = counts.groupBy("language", "root", "digest", "split").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return groups, spill(summed, "term-counts"), names


def _pairs(groups: DataFrame, kept: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(language, root, item, value): sum of the rates' differences for every two roots of a language.

    Rates lie in arrays of ``BLOCK`` terms or so, so that two roots meet once per
    block and not once per term.
    """
    blocks = max(1, -(-vocabulary.count() // BLOCK))
    key = ["language", "digest", "split"]
    grid = groups.join(vocabulary.select(*key, F.pmod(F.xxhash64("digest", "split"), F.lit(blocks)).alias("block")), "language")
    filled = grid.join(kept.select(*key, "root", "n"), [*key, "root"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rates = filled.select("language", "root", "block", F.struct("digest", "split", _rate("n", "total", "terms").alias("p")).alias("e"))
    arrays = rates.groupBy("language", "block", "root").agg(F.sort_array(F.collect_list("e")).alias("e"))
    arrays = spill(arrays.select("language", "block", "root", F.col("e.p").alias("p")), "term-rates")
    other = arrays.select("language", "block", F.col("root").alias("item"), F.col("p").alias("q"))
    apart = F.aggregate(F.zip_with("p", "q", lambda p, q: F.abs(p - q)), F.lit(0).cast("long"), lambda s, x: s + x)
    summed = (
        arrays.join(other, ["language", "block"]).where("root < item").groupBy("language", "root", "item").agg(F.sum(apart).alias("value"))
    )
    summed = spill(summed, "root-pairs")
    bare = groups.where("terms = 0")
    zero = bare.select("language", "root").join(bare.select("language", F.col("root").alias("item")), "language").where("root != item")
    return (
        summed.unionByName(summed.select("language", F.col("item").alias("root"), F.col("root").alias("item"), "value"))
        .unionByName(zero.withColumn("value", F.lit(0).cast("long")))
    )


def root_divergence(
    subtitles: DataFrame,
    subtitle: str = "subtitle",
    language: str = "language",
    root: str = "root",
    *,
    least: int = LEAST,
    top: int = TOP,
    bits: int = DIGEST_BITS,
) -> DataFrame:
    """(language, root, part, item, value, rank): how the roots of each language differ in their words.

    A language keeps the terms (runs of letters, A-Z lowered) that at least
    ``least`` of its subtitles hold. A term's rate in a root, or in the language,
    is 1 + floor(10^9 * (count + 5) / (all counts of kept terms + 5 * kept terms)).
    Rows of part ``pair`` name every other root of the language, with the rates'
    absolute differences summed over all kept terms (0 where none is kept), ranked
    from the most different. Rows of part ``term`` name the ``top`` kept terms that
    a root uses at a higher rate than its language, with the difference. Ranks
    start at 1; ties go by the item's UTF-8 bytes. All arithmetic is exact.

    Null texts, languages and roots count as empty. Repeated rows count each. A
    root without terms still is one of its language. An empty table gives an
    empty result; other columns are not read. ``bits`` is the width of the
    digests; it changes how many of them are shared, never the result.
    """
    texts = subtitles.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
        for c, n in ((language, "language"), (root, "root"), (subtitle, "subtitle"))
    ])
    groups, counts, names = _term_counts(texts, least, bits)
    key = ["language", "digest", "split"]
    vocabulary = counts.groupBy(*key).agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_language"))
    vocabulary = spill(vocabulary.where(F.col("docs") >= least).drop("docs"), "vocabulary")
    kept = spill(counts.drop("docs").join(vocabulary, key), "kept-terms")
    totals = vocabulary.groupBy("language").agg(F.count("*").alias("terms"), F.sum("of_language").alias("language_total"))
    sizes = kept.groupBy("language", "root").agg(F.sum("n").alias("total"))
    groups = groups.join(sizes, ["language", "root"], "left").join(totals, "language", "left")
    groups = spill(groups.na.fill(0, ["total", "terms", "language_total"]), "root-totals")

    pairs = _pairs(groups, kept, vocabulary)
    by_value = Window.partitionBy("language", "root").orderBy(F.desc("value"))
    ranked = by_value.orderBy(F.desc("value"), "item")
    more = (_rate("n", "total", "terms") - _rate("of_language", "language_total", "terms")).alias("value")
    rates = kept.join(groups, ["language", "root"]).select("language", "root", "digest", "split", more).where("value > 0")
    # Ties with the last reported term stay until their text is known.
    best = rates.withColumn("r", F.rank().over(by_value)).where(F.col("r") <= top)
    item = F.when(F.col("split") == "", F.col("low")).otherwise(F.col("split"))
    terms = best.join(names, "digest").select("language", "root", item.alias("item"), "value")
    place = F.row_number().over(ranked).alias("rank")
    out = ["language", "root", "part", "item", "value", "rank"]
    pairs = pairs.select("*", F.lit("pair").alias("part"), place).select(*out)
    terms = terms.select("*", F.lit("term").alias("part"), place).where(F.col("rank") <= top).select(*out)
    return pairs.unionByName(terms).withColumnsRenamed({"language": language, "root": root})
