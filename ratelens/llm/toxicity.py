"""Toxicity of texts: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The project keeps no records of people's language, so this operator is general:
any table of texts with a 0/1 mark for some of them. It scores, for example,
messages that users attach to queue items before those are exported for training.

A model is fitted in one task on a bounded sample of marked texts: every
coordinate has its own learning rate, and the L1 term keeps the weight of a slot
at exactly zero until its gradients agree. What is left, some thousand weights,
goes to all tasks, which score whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ratelens.llm.words import ALNUM, combine, hash_words, slices
from ratelens.session import spill

#: Marked texts that a model is fitted on, at most about; which ones depends on the id's hash alone.
SAMPLE = 20_000
SLOT_BITS = 20
EPOCHS = 10
ALPHA, BETA, L1, L2 = 3.0, 1.0, 6.0, 0.0
#: Bytes of a word's leading part, a feature that inflected and compound words share.
LEAD = 5
_SLICE = 4 << 20


def _slots(hashes: np.ndarray, kind: int) -> np.ndarray:
    return ((hashes ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, bounds) for each kind of feature: words, their leads, word pairs, pairs that skip a word."""
    hashes, bounds = hash_words(column, ALNUM)
    yield _slots(hashes, 0), bounds
    yield _slots(hash_words(column, ALNUM, LEAD)[0], 1), bounds
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for kind, step in ((2, 1), (3, 2)):
        pairs = combine(hashes, (0, step))
        inside = owner[: len(pairs)] == owner[step:]
        yield _slots(pairs[inside], kind), np.concatenate([[0], np.cumsum(inside)])[np.minimum(bounds, len(pairs))]


class _Ftrl:
    def __init__(self):
        self.z = np.zeros(1 << SLOT_BITS)
        self.n = np.zeros(1 << SLOT_BITS)

    def weights(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, slots: np.ndarray, mark: int) -> None:
        w = self.weights(slots)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - mark
        rate = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / ALPHA
        self.z[slots] += g - rate * w
        self.n[slots] += g * g


def _fit(batches):
    """(mark, text) rows, all in one task -> (slot, weight)."""
    texts = []
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            own = [[] for _ in range(part.num_rows)]
            for slots, bounds in _features(part.column("text")):
                for i in range(part.num_rows):
                    own[i].append(slots[bounds[i] : bounds[i + 1]])
            for mark, kinds in zip(part.column("mark").to_pylist(), own):
                # Slot 0 is every text's: its weight is the intercept.
                texts.append((mark, np.unique(np.concatenate([np.zeros(1, np.int32), *kinds]))))
    model, order = _Ftrl(), np.random.default_rng(7)
    for _ in range(EPOCHS if texts else 0):
        for i in order.permutation(len(texts)):
            model.learn(texts[i][1], texts[i][0])
    weights = model.weights(slice(None))
    slots = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(weights[slots])], names=["slot", "weight"])


def fit_toxicity(
    texts: DataFrame, marks: DataFrame, item: str = "item_id", text: str = "text", mark: str = "toxic",
    sample: int = SAMPLE,
) -> DataFrame:
    """(slot, weight): the model's non-zero weights, 2^20 at most.

    Fitted on about ``sample`` of the marked texts at most, chosen by a hash of
    their ids. Marks that are null or belong to no text are left out; of several
    marks of one item the largest counts. Without any mark the model is empty.
    """
    known = spill(
        marks.where(F.col(item).isNotNull() & F.col(mark).isNotNull()).groupBy(item).agg(
            F.max(F.col(mark).cast("int")).alias("mark")
        ),
        "marks",
    )
    share = sample / max(1, known.count())
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.col(item).cast("string")), F.lit(1_000_000)) < int(share * 1_000_000))
    # The sample's ids have a bounded size whatever the tables hold.
    rows = texts.select(item, F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(known), item)
    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.col(item).cast("string")), item, "text")
    return ordered.select("mark", "text").mapInArrow(_fit, "slot int, weight double")


def _score(weights):
    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        table = weights.value
        texts, slots = [np.arange(part.num_rows)], [np.zeros(part.num_rows, np.int64)]
        for found, bounds in _features(part.column(part.num_columns - 1)):
            at = np.flatnonzero(table[found])
            texts.append(np.searchsorted(bounds, at, side="right") - 1)
            slots.append(found[at].astype(np.int64))
        once = np.unique(np.concatenate(texts) << SLOT_BITS | np.concatenate(slots))
        total = np.bincount(once >> SLOT_BITS, table[once & (1 << SLOT_BITS) - 1], part.num_rows)
        score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return pa.RecordBatch.from_arrays(
            [*part.columns[:-1], pa.array(score, pa.float64())], names=[*part.schema.names[:-1], "score"]
        )

    def over(batches):
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, _SLICE):
                yield one(part)

    return over


def score_toxicity(
    texts: DataFrame, model: DataFrame, item: str = "item_id", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """(item, carried columns, score): probability that each whole text is toxic.

    One row per row of ``texts``, repeated ones too. Null and empty texts get the
    model's base rate, and 0.5 from an empty model. ``carry`` names columns to
    hand through; others are not read.
    """
    weights = np.zeros(1 << SLOT_BITS)
    rows = model.toPandas()  # 2^20 rows at most
    weights[rows["slot"].to_numpy(int)] = rows["weight"].to_numpy(float)
    kept = texts.select(item, *carry, F.col(text).alias("scored"))
    schema = StructType([*kept.schema.fields[:-1], StructField("score", DoubleType())])
    return kept.mapInArrow(_score(texts.sparkSession.sparkContext.broadcast(weights)), schema)
