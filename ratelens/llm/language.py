"""Language of sidecar subtitles by cross-parsing against labelled subtitles.

Per language a suffix automaton of labelled text recognises every string that
occurs in it. A subtitle is parsed greedily into phrases, each the longest match
from where the last one ended, or one character that the language lacks; text of the automaton's own language has long
matches and so few phrases. The language with the fewest phrases per character
wins.

The automata come from a bounded sample, some ten thousand characters per
language. Its text goes to the tasks, and each Python worker builds the automata
once. Whole texts are parsed, cut into lanes of a fixed length that advance
together, one character per step and all lanes at once; a cut costs one phrase at
most, the same for every language.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ratelens.llm.words import slices
from ratelens.session import spill

UNKNOWN = "und"
#: Characters of labelled text that a language's automaton is built from, at most.
SAMPLE_CHARS = 24_000
#: Characters that one labelled subtitle gives, so that a sample has many of them.
EACH_CHARS = 400
#: Letters whose moves are in dense tables, the most frequent ones; moves by others are in sorted lists. All are told apart.
DENSE = 62
LANE = 1024
_SLICE = 2 << 20
#: Symbols of a space, and of letters that no sample has.
_SPACE, _NEW = 0, 1


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if unicodedata.category(char)[0] == "L":
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_cache: dict = {}


def _folded(text: np.ndarray) -> np.ndarray:
    if "fold" not in _cache:
        _cache["fold"] = _fold_table()
    return _cache["fold"][text]


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the bounds of each; null is empty."""
    texts = [t or "" for t in column.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


class _Moves:
    """Transitions state * width + symbol -> next state * width, 0 for none."""

    def __init__(self, moves: list[dict[int, int]], width: int, symbols: int):
        self.width, self.symbols = width, symbols
        self.table = np.zeros(len(moves) * width, np.int32)
        rare = []
        for state, own in enumerate(moves):
            for symbol, to in own.items():
                if symbol < width:
                    self.table[state * width + symbol] = to * width
                else:
                    rare.append((state * width * symbols + symbol, to * width))
        self.keys, self.to = np.array(sorted(rare), np.int64).reshape(-1, 2).T.copy()

    def __call__(self, state: np.ndarray, symbol: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """``rare`` has the places of symbols beyond the dense ones."""
        if not len(rare):
            return self.table[state + symbol]
        to = self.table[state + np.minimum(symbol, self.width - 1)]
        to[rare] = 0
        if len(self.keys):
            key = state[rare].astype(np.int64) * self.symbols + symbol[rare]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[rare] = np.where(self.keys[place] == key, self.to[place], 0)
        return to


def _automaton(text: np.ndarray, width: int, symbols: int) -> _Moves:
    """Transitions of the suffix automaton of ``text``, those by the first ``width`` of ``symbols`` in a table."""
    links, sizes, moves, last = [-1], [0], [{}], 0
    for symbol in text.tolist():
        state = len(links)
        sizes.append(sizes[last] + 1)
        moves.append({})
        links.append(0)
        p = last
        while p != -1 and symbol not in moves[p]:
            moves[p][symbol] = state
            p = links[p]
        if p != -1:
            q = moves[p][symbol]
            if sizes[p] + 1 == sizes[q]:
                links[state] = q
            else:
                clone = len(links)
                sizes.append(sizes[p] + 1)
                moves.append(dict(moves[q]))
                links.append(links[q])
                while p != -1 and moves[p].get(symbol) == q:
                    moves[p][symbol] = clone
                    p = links[p]
                links[q] = links[state] = clone
        last = state
    return _Moves(moves, width, symbols)


class Languages:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        texts = [np.frombuffer(samples[n].encode("utf-32-le", "surrogatepass"), np.uint32) for n in self.names]
        folded = [_folded(t) for t in texts]
        letters, counts = np.unique(np.concatenate([*folded, np.zeros(0, np.uint32)]), return_counts=True)
        letters, counts = letters[letters > 0], counts[letters > 0]
        letters = letters[np.lexsort((letters, -counts))]
        self.symbols = np.full(0x110000, _NEW, np.int32)
        self.symbols[0] = _SPACE
        self.symbols[letters] = np.arange(len(letters)) + 2
        self.width = min(len(letters), DENSE) + 2
        self.tables = [_automaton(self._squeezed(f), self.width, len(letters) + 2) for f in folded]

    def _squeezed(self, folded: np.ndarray) -> np.ndarray:
        """Symbols of letters, one space for each run of anything else."""
        keep = folded > 0
        keep[1:] |= folded[:-1] > 0
        return self.symbols[folded[keep]]

    def phrases(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(letters of each text, phrases of each text in each language)."""
        codes, bounds = _codes(column)
        folded = _folded(codes)
        letter = folded > 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[bounds[:-1][bounds[:-1] < len(codes)]] = letter[bounds[:-1][bounds[:-1] < len(codes)]]
        place = np.concatenate([[0], np.cumsum(keep)])[bounds]
        symbols = self.symbols[folded[keep]]
        letters = np.diff(np.concatenate([[0], np.cumsum(letter)])[bounds])
        sizes = np.diff(place)
        lanes = -(-sizes // LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        number = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = place[:-1][text] + number * LANE
        length = np.minimum(LANE, place[1:][text] - start)
        order = np.argsort(-length, kind="stable")
        start, length, text = start[order], length[order], text[order]
        # Symbols step by step: the lanes that are that long, longest first.
        active = np.searchsorted(-length, -np.arange(1, LANE + 1), side="right")
        totals = np.zeros((len(sizes), len(self.names)), np.int64)
        states = [np.zeros(len(start), np.int32) for _ in self.names]
        counts = [np.zeros(len(start), np.int32) for _ in self.names]
        padded = np.concatenate([symbols, np.zeros(1, np.int32)])
        for step in range(int(length.max(initial=0))):
            n = int(active[step])
            symbol = padded[start[:n] + step]
            rare = np.flatnonzero(symbol >= self.width)
            root = np.zeros(n, np.int32)
            for state, count, table in zip(states, counts, self.tables):
                to = table(state[:n], symbol, rare)
                over = to == 0
                count[:n] += over | (state[:n] == 0)  # a phrase starts here
                np.copyto(to, table(root, symbol, rare), where=over)
                state[:n] = to
        for k, count in enumerate(counts):
            totals[:, k] = np.bincount(text, count, len(sizes))
        return letters, totals


def _languages(samples) -> Languages:
    if _cache.get("key") != samples.value:
        _cache["key"], _cache["languages"] = samples.value, Languages(samples.value)
    return _cache["languages"]


def _predict(samples):
    def over(batches):
        known = _languages(samples)
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, _SLICE):
                letters, phrases = known.phrases(part.column(part.num_columns - 1))
                names = np.array([*known.names, UNKNOWN], object)
                if known.names:
                    best = phrases.argmin(axis=1)
                    ease = 1 / np.maximum(phrases, 1)
                    score = ease[np.arange(len(best)), best] / ease.sum(axis=1)
                else:
                    best, score = np.zeros(part.num_rows, int), np.zeros(part.num_rows)
                none = letters == 0
                best, score = np.where(none, len(known.names), best), np.where(none, 0.0, score)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names[best], pa.string()), pa.array(score, pa.float64())],
                    names=[*part.schema.names[:-1], "lang_pred", "score"],
                )

    return over


def language_samples(subtitles: DataFrame, text: str = "subtitle", lang: str = "lang", seed: str = "lang") -> dict:
    """Up to ``SAMPLE_CHARS`` characters of labelled text per language, the same in every run.

    Each task first keeps what can still be in the sample, so only a bounded
    number of short pieces per language is ordered.
    """
    count = SAMPLE_CHARS // EACH_CHARS
    spark = subtitles.sparkSession
    spread = F.greatest(F.lit(1), F.length(F.col(text)) - EACH_CHARS)
    piece = F.substring(F.col(text), F.pmod(F.xxhash64(F.col(text)), spread).cast("int") + 1, F.lit(EACH_CHARS))
    pieces = subtitles.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.md5(F.concat(F.lit(seed), F.col(text))).alias("dice"), piece.alias("piece")
    )
    sizes = spill(pieces.groupBy("lang").agg(F.approx_count_distinct("dice").alias("n")), "languages")
    # A cut on the hash leaves about ten times the sample of each language, however much there is.
    level = F.least(F.lit(1.0), 10.0 * count / F.col("n"))
    near = pieces.join(sizes, "lang").where(F.conv(F.substring("dice", 1, 8), 16, 10).cast("double") <= level * 2.0**32)
    order = Window.partitionBy("lang").orderBy("dice", "piece")
    rows = near.dropDuplicates(["lang", "dice"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= count)
    found: dict[str, list[str]] = {}
    for row in rows.select("lang", "piece").orderBy("lang", "r").collect():  # the bounded sample
        found.setdefault(row["lang"], []).append(row["piece"])
    return {name: " ".join(parts) for name, parts in found.items()}


def subtitle_language(
    subtitles: DataFrame, labelled: DataFrame, item: str = "subtitle_id", text: str = "subtitle", lang: str = "lang",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(item, carried columns, lang_pred, score): language of each whole sidecar subtitle.

    ``labelled`` has subtitles whose language is known (a name such as
    ``clip.en.srt`` tells it); rows with a null language or no letter teach
    nothing. ``lang_pred`` is one of their languages, the first by code point on
    ties, or ``und`` for a null text, a text without a letter, or without any
    labelled row. ``score`` is the winner's share of the inverse phrase counts, 0
    for ``und``. One row per row of ``subtitles``, repeated ones too. ``carry``
    names columns to hand through; others are not read.

    Every letter of the samples is told apart, whatever the script; letters that
    no sample has are a phrase each. Memory per worker: about 0.4 KB per sampled
    character and language.
    """
    samples = subtitles.sparkSession.sparkContext.broadcast(language_samples(labelled, text, lang))
    kept = subtitles.select(item, *carry, F.col(text).alias("subtitle"))
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return kept.mapInArrow(_predict(samples), StructType([*kept.schema.fields[:-1], *new]))
