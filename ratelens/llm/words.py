"""Word hashes of whole Arrow text columns, shared by the word-based operators.

Texts stay in Arrow's byte buffer: words are found and hashed with array
operations over pieces of about a megabyte, so a batch of any size, or a single
text of any length, needs the same working memory. A word's hash depends on its
bytes alone, so every executor and every run sees the same value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_FOLDED = _BYTE[_LOWER]
_POW = _powers(_P, PIECE)
_INV = _powers(pow(_P, -1, 1 << 64), PIECE)

#: Bytes of words that are runs without ASCII white space: ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words that are runs of letters and digits: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after folding A-Z.
ALNUM = np.ones(256, dtype=bool)
ALNUM[:0x80] = False
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True


def mix(x: np.ndarray) -> np.ndarray:
    return _mix(x)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null becomes empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, is_start: np.ndarray, kind: np.ndarray):
    """Cut positions at most ``PIECE`` apart that split no word, and longer only for a longer word."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            low = at + 1
            back = np.flatnonzero(~kind[data[low : end + 1]] | is_start[low : end + 1])
            if len(back):
                end = low + int(back[-1])
            else:
                end = _word_end(data, is_start, kind, end)
        yield at, end
        at = end


def _word_end(data: np.ndarray, is_start: np.ndarray, kind: np.ndarray, at: int) -> int:
    while at < len(data):
        ahead = np.flatnonzero(~kind[data[at : at + PIECE]] | is_start[at : at + PIECE])
        if len(ahead):
            return at + int(ahead[0])
        at += PIECE
    return len(data)


def _long_word(values: np.ndarray) -> np.ndarray:
    """Hash of one word longer than a piece, by Horner steps over pieces."""
    total = 0
    for at in range(0, len(values), PIECE):
        part = values[at : at + PIECE]
        total = (total + int((part * _POW[: len(part)]).sum(dtype=np.uint64)) * pow(_P, at, 1 << 64)) & _MASK
    return np.array([total], np.uint64)


def hash_words(column: pa.Array, kind: np.ndarray, lead: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text ``i`` has the words ``hashes[bounds[i]:bounds[i + 1]]``, in order, A-Z folded.

    With ``lead``, only the first ``lead`` bytes of each word are hashed.
    """
    data, offsets = buffers(column)
    is_start = np.zeros(len(data) + 1, dtype=bool)
    is_start[offsets[:-1]] = True
    hashes, starts = [], []
    for at, end in _pieces(data, is_start[:-1], kind):
        part = data[at:end]
        word = kind[part]
        first = is_start[at:end]
        begin = word.copy()
        begin[1:] &= ~word[:-1] | first[1:]
        begins = np.flatnonzero(begin)
        if not len(begins):
            continue
        last = word.copy()
        last[:-1] &= ~word[1:] | first[1:]
        ends = np.flatnonzero(last)
        if lead:
            ends = np.minimum(ends, begins + lead - 1)
        values = _BYTE_FOLDED[part]
        if len(part) > PIECE:
            h = np.concatenate([_long_word(values[b : e + 1]) for b, e in zip(begins, ends)])
        else:
            sums = np.cumsum(values * _POW[: len(part)], dtype=np.uint64)
            h = sums[ends]
            h[begins > 0] -= sums[begins[begins > 0] - 1]
            h = h * _INV[begins]
        hashes.append(_mix(h))
        starts.append(begins + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def combine(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``i + offset`` for every ``i`` at which all of them exist in ``hashes``."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, offset in enumerate(offsets):
        total += hashes[offset : offset + n] * np.uint64(pow(_P, k + 1, 1 << 64) & _MASK | 1)
    return _mix(total)


def slices(batch: pa.RecordBatch, column: str | int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` whose texts in ``column`` have ``most`` bytes together, or one text."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def per_batch(run: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]) -> Callable:
    """``run`` as a ``mapInArrow`` function."""

    def over(batches):
        for batch in batches:
            out = run(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return over
