"""Passages of evaluation cases inside development logs, by a positional inverted index.

The index is one row per shard, a run of whole logs. A shard row lists its logs
with their first word numbers and, per term, the sorted positions at which the
term stands. It is written once, read by column, and never shuffled. Case
passages are cut into windows; in each shard a window starts from the shortest of
its terms' lists, whose positions, less the term's offset, are the possible
starts. These are intersected with the other lists, rarest first, each shifted
by its own offset.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.words import ALNUM, hash_words, per_batch, slices
from ratelens.session import spill

#: Terms up to which the index holds only terms that cases use (16 MB at the tasks); beyond it holds every term.
MOST_TERMS = 2_000_000
#: Windows that meet the index in one pass (about 20 MB at the tasks); more take more passes over it.
WINDOWS_PER_PASS = 250_000
#: Text bytes of a shard; one log may be longer.
SHARD_BYTES = 4 << 20
MAX_SLOP = 63
#: Empty places between the logs of a shard, too many for a match to reach across.
GAP = 2 * MAX_SLOP + 2
_CANDIDATES = 2_000_000

_INDEX = (
    "shard long, items array<long>, starts array<int>, words array<int>, "
    "terms array<long>, counts array<int>, positions array<int>"
)


def _flat(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _shards(vocabulary):
    """Batches of (id, text) -> shard rows."""

    def over(batches):
        known = vocabulary.value if vocabulary is not None else None
        if known is not None:
            maybe = np.zeros(1 << 16, bool)
            maybe[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        number = TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in slices(whole, "text", SHARD_BYTES)):
            hashes, bounds = hash_words(batch.column("text"), ALNUM)
            words = np.diff(bounds)
            starts = bounds[:-1] + GAP * np.arange(len(words))
            place = np.arange(len(hashes)) + GAP * np.repeat(np.arange(len(words)), words)
            if known is not None:
                at = np.flatnonzero(maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
                spot = np.minimum(np.searchsorted(known, hashes[at]), max(len(known) - 1, 0))
                at = at[known[spot] == hashes[at]] if len(known) else at[:0]
                hashes, place = hashes[at], place[at]
            order = np.argsort(hashes, kind="stable")
            terms, counts = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id")),
                    _flat(starts, pa.int32()), _flat(words, pa.int32()),
                    _flat(terms.view(np.int64), pa.int64()), _flat(counts, pa.int32()),
                    _flat(place[order], pa.int32()),
                ],
                names=["shard", "items", "starts", "words", "terms", "counts", "positions"],
            )
            number += 1

    return over


def _windows(window: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = hash_words(batch.column("text"), ALNUM)
        cases, rows = [], []
        for case, begin, end in zip(batch.column("case_id").to_pylist(), bounds[:-1], bounds[1:]):
            own = hashes[begin:end].view(np.int64)
            parts = {tuple(own[i : i + window].tolist()) for i in range(max(1, len(own) - window + 1))}
            rows += [list(p) for p in sorted(parts) if p]
            cases += [case] * len([p for p in parts if p])
        return pa.RecordBatch.from_arrays(
            [pa.array(cases, pa.string()), pa.array(rows, pa.list_(pa.int64()))], names=["case_id", "terms"]
        )

    return per_batch(run)


def case_windows(cases: DataFrame, case: str = "case_id", text: str = "passage", window: int = 10) -> DataFrame:
    """(case_id, terms): distinct runs of ``window`` words of each case, or its whole sequence if shorter."""
    return (
        cases.where(F.col(case).isNotNull())
        .select(F.col(case).cast("string").alias("case_id"), F.col(text).alias("text"))
        .mapInArrow(_windows(window), "case_id string, terms array<long>")
        .distinct()
    )


def log_index(
    logs: DataFrame, item: str = "item_id", text: str = "log", windows: DataFrame | None = None
) -> DataFrame:
    """The positional index of ``logs``, stored in the shared folder.

    With ``windows``, whose distinct terms are counted first, postings of terms
    that no window uses are left out while those terms number ``MOST_TERMS`` at
    most. Searches give the same result either way.
    """
    spark = logs.sparkSession
    vocabulary = None
    if windows is not None:
        terms = windows.select(F.explode("terms").alias("t")).distinct().limit(MOST_TERMS + 1).toPandas()["t"]
        if len(terms) <= MOST_TERMS:
            vocabulary = spark.sparkContext.broadcast(np.sort(terms.to_numpy(np.int64).view(np.uint64)))
    rows = logs.select(F.col(item).cast("long").alias("id"), F.col(text).alias("text"))
    return spill(rows.mapInArrow(_shards(vocabulary), _INDEX), "log-index")


class _Shard:
    """The lists of one shard row."""

    def __init__(self, row: dict):
        self.terms = row["terms"].view(np.uint64)
        self.counts = row["counts"].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        self.positions = row["positions"].astype(np.int64)
        self.starts, self.words, self.items = row["starts"].astype(np.int64), row["words"], row["items"]
        self.width = 1 << 33
        owner = np.repeat(np.arange(len(self.terms)), self.counts)
        self.keys = owner * self.width + self.positions

    def holds(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Does ``term`` stand within ``slop`` words of ``place``?"""
        key = term * self.width + place
        spot = np.searchsorted(self.keys, key - slop)
        return (spot < len(self.keys)) & (self.keys[np.minimum(spot, len(self.keys) - 1)] <= key + slop)

    def matches(self, windows: np.ndarray, slop: int):
        """(window row, start) of every match; ``windows`` is a matrix of term hashes."""
        width = windows.shape[1]
        spot = np.minimum(np.searchsorted(self.terms, windows), max(len(self.terms) - 1, 0))
        usable = np.flatnonzero((self.terms[spot] == windows).all(axis=1)) if len(self.terms) else []
        if not len(usable):
            return
        local = spot[usable]
        order = np.argsort(self.counts[local], axis=1, kind="stable")
        rows = np.arange(len(usable))
        sizes = self.counts[local[rows, order[:, 0]]]
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(rows):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _CANDIDATES)))
            part = rows[begin:end]
            begin = end
            own = np.repeat(part, sizes[part])
            inside = np.arange(len(own)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
            start = self.positions[self.first[local[own, order[own, 0]]] + inside] - order[own, 0]
            if slop:
                start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
                own, start = np.unique(np.stack([np.repeat(own, 2 * slop + 1), start]), axis=1)
            for k in range(1, width):
                offset = order[own, k]
                good = self.holds(local[own, offset], start + offset, slop)
                own, start = own[good], start[good]
            yield usable[own], start


_HITS = "shard long, log_no int, begins array<int>, ends array<int>, cases array<string>"


def _search(sought, slop: int):
    """Shard rows -> hit spans and cases of each log that has any."""

    def one(row: dict) -> list[tuple]:
        shard = _Shard(row)
        found_log, found_begin, found_end, found_case = [], [], [], []
        for width, (matrix, cases) in sought.value.items():
            for rows, start in shard.matches(matrix, slop):
                log = np.searchsorted(shard.starts, start + slop, side="right") - 1
                begin = np.maximum(start - shard.starts[log], 0)
                found_log.append(log)
                found_begin.append(begin)
                found_end.append(np.minimum(start - shard.starts[log] + width, shard.words[log]))
                found_case.append(cases[rows])
        if not sum(map(len, found_log)):
            return []
        log, begin = np.concatenate(found_log), np.concatenate(found_begin)
        end, case = np.concatenate(found_end), np.concatenate(found_case)
        order = np.lexsort((begin, log))
        log, begin, end, case = log[order], begin[order], end[order], case[order]
        out = []
        for at in np.split(np.arange(len(log)), np.flatnonzero(np.diff(log)) + 1):
            spans = []
            for b, e in zip(begin[at].tolist(), end[at].tolist()):
                if spans and b <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([b, e])
            out.append((int(log[at[0]]), [s[0] for s in spans], [s[1] for s in spans], sorted(set(case[at]))))
        return out

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, number in enumerate(batch.column("shard").to_pylist()):
            row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in _LISTS}
            rows += [(number, *found) for found in one(row)]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["shard", "log_no", "begins", "ends", "cases"]
        )

    return per_batch(run)


_LISTS = ("items", "starts", "words", "terms", "counts", "positions")


def _passes(windows: DataFrame):
    """The windows in bounded parts: {number of words: (matrix of terms, case of each row)}."""
    parts = -(-windows.count() // WINDOWS_PER_PASS)
    part = F.pmod(F.xxhash64("case_id", "terms"), F.lit(max(1, parts)))
    for k in range(parts):
        rows = windows.where(part == k).toPandas()
        width = rows["terms"].map(len)
        yield {
            int(n): (np.array(own["terms"].tolist(), np.int64).view(np.uint64), own["case_id"].to_numpy(object))
            for n, own in rows.groupby(width)
        }


def passage_leaks(
    logs: DataFrame,
    cases: DataFrame,
    item: str = "item_id",
    text: str = "log",
    case: str = "case_id",
    passage: str = "passage",
    window: int = 10,
    slop: int = 0,
) -> DataFrame:
    """(item, n_words, n_hit, cases, spans): where passages of evaluation cases stand in development logs.

    Words are runs of ASCII letters and digits and of all other non-ASCII
    characters, A-Z in lower case, over whole texts. A case's windows are its
    runs of ``window`` words, or its whole sequence if shorter. With ``slop`` 0 a
    window matches as an exact phrase; with ``slop`` s (63 at most) each of its
    words may stand up to s words from its place, and the span of the match is
    where the window would stand. ``n_hit`` counts log words inside any match,
    ``spans`` are the merged matches as [begin, end) word numbers, ``cases`` the
    distinct matching cases, sorted as strings.

    One row per row of ``logs``, repeated ones too. Null and wordless texts have
    no words and no match, empty tables give no rows or no matches, and a case
    with a null id takes no part. Other columns are not read. Words are compared
    by 64-bit hashes: two given terms agree by accident with chance 2^-64.
    """
    if not 0 <= slop <= MAX_SLOP:
        raise ValueError(f"slop is 0 to {MAX_SLOP}")
    spark = logs.sparkSession
    windows = spill(case_windows(cases, case, passage, window), "case-windows")
    index = log_index(logs, item, text, windows)
    hits = [
        index.select("shard", *_LISTS).mapInArrow(_search(spark.sparkContext.broadcast(sought), slop), _HITS)
        for sought in _passes(windows)
    ]
    lists = index.select("shard", F.posexplode(F.arrays_zip("items", "words")).alias("log_no", "l")).select(
        "shard", "log_no", F.col("l.items").alias(item), F.col("l.words").cast("long").alias("n_words")
    )
    if not hits:
        hits = [spark.createDataFrame([], _HITS)]
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    if len(hits) > 1:
        found = found.groupBy("shard", "log_no").agg(
            F.flatten(F.collect_list("begins")).alias("begins"),
            F.flatten(F.collect_list("ends")).alias("ends"),
            F.flatten(F.collect_list("cases")).alias("cases"),
        )
    spans = F.aggregate(
        F.array_sort(F.arrays_zip("begins", "ends")),
        F.expr("CAST(array() AS array<struct<begins:int,ends:int>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["ends"] >= s["begins"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["begins"].alias("begins"),
                    F.greatest(F.element_at(done, -1)["ends"], s["ends"]).alias("ends"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["begins"].alias("begins"), s["ends"].alias("ends"))))),
    ) if len(hits) > 1 else F.arrays_zip("begins", "ends")
    found = spill(
        found.select("shard", "log_no", spans.alias("spans"), F.array_sort(F.array_distinct("cases")).alias("cases")),
        "log-hits",
    )
    none = F.expr("CAST(array() AS array<struct<begins:int,ends:int>>)")
    return (
        lists.join(found, ["shard", "log_no"], "left")
        .withColumn("spans", F.coalesce("spans", none))
        .select(
            item, "n_words",
            F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["begins"]).alias("n_hit"),
            F.coalesce("cases", F.expr("CAST(array() AS array<string>)")).alias("cases"),
            "spans",
        )
    )
