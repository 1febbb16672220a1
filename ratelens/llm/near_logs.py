"""Near-copies among tool logs: MinHash bands for candidates, odd sketches, exact sets for links.

A log's MinHash samples serve twice. Runs of them are band keys, so similar logs
meet in buckets. All of them together are folded into an odd sketch: a bitmap of
parities in which two logs differ at the more bits the less they have in common,
so one XOR and a population count estimate a high similarity before any set is
read. Links are confirmed on the full shingle sets.

No pair list of a group is ever made. Logs with equal sets are one class from the
start. In a bucket all members are first compared with its smallest one, which
joins most of a group of near-copies with one comparison each. What is still
apart but shares a bucket is compared by sketch within the bucket; only a
spanning forest of what may be similar comes out. Its trees are pools, and in a
pool, cut into blocks, full sets are compared across the parts that are still
apart. Again only the links of a spanning forest come out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelens.llm.graph import components
from ratelens.llm.words import SPACED, combine, hash_words, mix, per_batch, slices
from ratelens.session import spill

BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
BLOCK = 512
_SLICE = 4 << 20
_SEEDS = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
_FACTOR = (_SEEDS[:SAMPLES] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_SHIFT = (_SEEDS[SAMPLES:] >> np.uint64(32)).astype(np.uint32)[:, None]


def _sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    hashes, bounds = hash_words(column, SPACED)
    out = []
    for begin, end in zip(bounds[:-1], bounds[1:]):
        text = hashes[begin:end]
        if len(text) >= words:
            text = combine(text, tuple(range(words)))
        elif len(text):
            text = combine(text, tuple(range(len(text))))
        out.append(np.unique(text))
    return out


def _samples(shingles: np.ndarray) -> np.ndarray:
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(folded), 1024):
        np.minimum(least, (_FACTOR * folded[None, at : at + 1024] + _SHIFT).min(axis=1), out=least)
    return least


def _bands(samples: np.ndarray) -> np.ndarray:
    parts = samples.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for k in range(ROWS):
        keys = mix(keys + parts[:, :, k] + np.uint64(k + 1))
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each (sample number, sample) flips one bit."""
    n = len(samples)
    bit = mix(samples.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
    bit = (bit % np.uint64(SKETCH_BITS)).astype(np.int64) + SKETCH_BITS * np.arange(n)[:, None]
    parity = (np.bincount(bit.ravel(), minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64).reshape(n, SKETCH_WORDS)


def differing_bits(similarity: float, sigmas: float = 5.0) -> int:
    """Most bits in which the sketches of two logs of that similarity differ.

    Five standard deviations beyond the expectation, over both the choice of
    samples and the folding: fewer than one in a million such pairs exceed it.
    """
    lost = SAMPLES * (1 - similarity) + sigmas * math.sqrt(SAMPLES * similarity * (1 - similarity))
    even = (1 - 2 / SKETCH_BITS) ** (2 * lost)
    expected = SKETCH_BITS / 2 * (1 - even)
    return math.ceil(expected + 2 * math.sqrt(SKETCH_BITS / 4 * (1 - even * even)))


def _list(values: np.ndarray) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1] or 1, dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def _sliced(one):
    """``one`` over parts of a few megabytes of text of each batch."""

    def over(batches):
        for batch in batches:
            yield from map(one, slices(batch, "text", _SLICE))

    return over


def _features(words: int):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        samples = np.empty((n, SAMPLES), np.uint32)
        sizes = np.empty(n, np.int64)
        digest = np.empty((n, 2), np.uint64)
        for i, shingles in enumerate(_sets(batch.column("text"), words)):
            samples[i] = _samples(shingles)
            sizes[i] = len(shingles)
            digest[i] = shingles.sum(dtype=np.uint64), mix(shingles ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)
        digest = digest.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("id"), pa.array(sizes), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                _list(_bands(samples)), _list(_sketches(samples)),
            ],
            names=["id", "n", "d1", "d2", "bands", "sketch"],
        )

    return _sliced(one)


def _packed_sets(words: int):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [s.tobytes() for s in _sets(batch.column("text"), words)]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], names=["id", "shingles"])

    return _sliced(one)


def _similar(common: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (left + right - common)


def _confirm(percent: int):
    """Rows (a, b, sets of both) -> the (a, b) that are links."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        pairs = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
        for i, (left, right) in enumerate(pairs):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            both = np.sort(np.concatenate([x, y]))
            keep[i] = _similar(np.count_nonzero(both[1:] == both[:-1]), len(x), len(y), percent)
        return batch.select(["a", "b"]).filter(pa.array(keep))

    return per_batch(run)


class _Forest:
    """Union-find over small integers; ``tie`` keeps the pairs that join two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            over = up[up]
            if np.array_equal(over, up):
                return up
            up[:] = over

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def tie(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        roots = self.roots()
        apart = roots[left] != roots[right]
        made = []
        for x, y in zip(left[apart].tolist(), right[apart].tolist()):
            rx, ry = self.find(x), self.find(y)
            if rx != ry:
                self.up[max(rx, ry)] = min(rx, ry)
                made.append((x, y))
        return made


def _maybe_similar(most_bits: int):
    """Rows of buckets in bucket order -> forest of pairs of different parts whose sketches are close."""

    def close(table: pa.Table) -> pa.RecordBatch:
        bucket = np.stack([table.column(c).to_numpy() for c in ("bucket", "p", "q")], axis=1)
        ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)
        names, node = np.unique(np.concatenate([ids, part]), return_inverse=True)
        node, root = node[: len(ids)], node[len(ids) :]
        forest, made = _Forest(len(names)), []
        forest.tie(node, root)
        lag, rows = 1, np.arange(len(ids))
        while True:
            rows = rows[rows + lag < len(ids)]
            rows = rows[(bucket[rows] == bucket[rows + lag]).all(axis=1)]
            if not len(rows):
                break
            other = rows[part[rows] != part[rows + lag]]
            bits = np.bitwise_count(sketch[other] ^ sketch[other + lag]).sum(axis=1)
            other = other[bits <= most_bits]
            made += forest.tie(node[other], node[other + lag])
            lag += 1
        made = names[np.array(made, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

    def over(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 20_000:
                continue
            key = np.stack([held.column(c).to_numpy() for c in ("bucket", "p", "q")], axis=1)
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            if len(change):
                yield close(held.slice(0, int(change[-1]) + 1))
                held = held.slice(int(change[-1]) + 1)
        if held is not None and held.num_rows:
            yield close(held)

    return over


def _pool_links(percent: int):
    """One block pair of a pool -> forest of links between its parts."""

    def run(table: pa.Table) -> pa.Table:
        ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
        side = table.column("side").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        names, node = np.unique(np.concatenate([ids, part]), return_inverse=True)
        node, root = node[: len(ids)], node[len(ids) :]
        forest, made = _Forest(len(names)), []
        forest.tie(node, root)
        right = np.flatnonzero(side == 1)
        starts = np.concatenate([[0], np.cumsum(sizes[right])])[:-1]
        body = np.concatenate([codes[bounds[i] : bounds[i + 1]] for i in right]) if len(right) else codes[:0]
        mark = np.zeros(len(codes) + 1, np.int32)
        for i in np.flatnonzero(side == 0) if len(right) else []:
            own = codes[bounds[i] : bounds[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[body], starts)
            mark[own] = 0
            hit = right[_similar(common, sizes[i], sizes[right], percent)]
            hit = hit[part[hit] != part[i]]
            made += forest.tie(np.full(len(hit), node[i]), node[hit])
        made = names[np.array(made, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(made[:, 0]), "b": pa.array(made[:, 1])})

    return run


def _block_pairs(rows: DataFrame, group: str, columns: list[str], alone: bool = False) -> DataFrame:
    """Rows of groups that hold several parts, dealt to (group, p, q) so that all pairs across parts meet.

    Only rows outside a group's largest part need partners: they are cut into
    blocks p (side 0), all rows of the group into blocks q (side 1). A group that
    is one block has side 1 only, unless ``alone`` asks for both.
    """
    sizes = rows.groupBy(group, "part").agg(F.count("*").alias("s"))
    plan = (
        sizes.groupBy(group)
        .agg(F.sum("s").alias("all"), F.max(F.struct("s", "part")).alias("largest"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select(
            group, F.col("largest.part").alias("major"), F.ceil(F.col("all") / BLOCK).cast("int").alias("nq"),
            F.ceil((F.col("all") - F.col("largest.s")) / BLOCK).cast("int").alias("np"),
        )
    )
    spread = rows.join(plan, group)
    own = F.xxhash64("id")
    right = spread.withColumn("q", F.pmod(own, F.col("nq")).cast("int")).withColumn(
        "p", F.explode(F.sequence(F.lit(0), F.col("np") - 1))
    )
    left = spread.where("part != major" if alone else "part != major AND np * nq > 1").withColumn(
        "p", F.pmod(own, F.col("np")).cast("int")
    ).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    return left.select(group, "p", "q", *columns, F.lit(0).alias("side")).unionByName(
        right.select(group, "p", "q", *columns, F.lit(1).alias("side"))
    )


def _parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with column ``part``: the component of ``id`` under ``links``, or itself."""
    found = components(links, "a", "b").select(F.col("node").alias("id"), "component")
    return nodes.join(found, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")


def near_copies(
    logs: DataFrame, item: str = "item_id", text: str = "log", words: int = 5, percent: int = 80
) -> DataFrame:
    """(item, n_shingles, component_id, kept): which tool logs are near-copies of which.

    A log's words are its runs without white space, A-Z in lower case; its set
    holds its distinct runs of ``words`` words, or its whole word sequence if it
    is shorter. Two logs are linked when ``percent`` of their union or more is
    common to both; ``component_id`` is the smallest item reachable over links
    and ``kept`` marks that item. Null and wordless logs have 0 shingles and no
    link. Rows with a null item come back unlinked with a null component, kept.
    Repeated rows come back repeated. Other columns of ``logs`` are not read.

    ``item`` is an integer column. Chances: two logs at exactly 80 % escape all
    bands with probability 1.3e-7, or the sketch with less than 1e-6; above 80 %
    both fall steeply, and any other path between them serves as well.
    """
    spark = logs.sparkSession
    given = logs.select(F.col(item).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, n long, d1 long, d2 long, bands array<long>, sketch array<long>"
    features = spill(given.mapInArrow(_features(words), schema), "near-features")

    # Classes of equal sets; only their smallest item goes on.
    known = features.where("id IS NOT NULL AND n > 0")
    classes = known.groupBy("d1", "d2", "n").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    # Written out, so that the join below can split the rows of a class that a third of all logs belong to.
    copies = spill(classes.where("rows > 1").drop("rows"), "near-copies")
    members = spill(
        features.select("id", "n", "d1", "d2")
        .join(copies, ["d1", "d2", "n"], "left")
        .select("id", "n", F.when(F.expr("n > 0 AND id IS NOT NULL"), F.coalesce("first", "id")).otherwise(F.col("id")).alias("first")),
        "near-members",
    )
    single = known.select("id", "bands", "sketch").join(
        classes.select(F.col("first").alias("id")), "id", "left_semi"
    ).dropDuplicates(["id"])

    banded = single.select("id", F.explode("bands").alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("m")).where("m > 1")
    buckets = spill(banded.join(leaders, "bucket"), "near-buckets")
    touched = buckets.select("id").distinct()
    sketches = spill(single.select("id", "sketch").join(touched, "id", "left_semi"), "near-sketches")
    sets = spill(
        given.join(touched, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(
            _packed_sets(words), "id long, shingles binary"
        ),
        "near-sets",
    )

    # Every member against the smallest of its bucket.
    most = differing_bits(percent / 100)
    bits = F.aggregate(
        F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    star = (
        buckets.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
        .join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        .join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        .where(bits <= most)
        .select("a", "b")
        .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
        .mapInArrow(_confirm(percent), "a long, b long")
    )
    links = spill(star, "near-links")
    parted = spill(_parts(sketches, links), "near-parts")

    # Buckets that still hold several parts: sketches of all but the largest part against all.
    rows = buckets.select("id", "bucket").join(parted, "id")
    paired = _block_pairs(rows, "bucket", ["id", "part", "sketch"]).drop("side")
    maybe = spill(
        paired.repartition("bucket", "p", "q")
        .sortWithinPartitions("bucket", "p", "q", "id")
        .mapInArrow(_maybe_similar(most), "a long, b long"),
        "near-maybe",
    )

    # Pools of what may be similar: full sets of the smaller parts against all.
    pools = components(
        maybe.unionByName(
            parted.where("id != part").select(F.col("id").alias("a"), F.col("part").alias("b"))
        ),
        "a", "b",
    ).select(F.col("node").alias("id"), F.col("component").alias("pool"))
    pooled = spill(pools.join(parted.select("id", "part"), "id"), "near-pools")
    more = (
        _block_pairs(pooled, "pool", ["id", "part"], alone=True)
        .join(sets, "id")
        .repartition("pool", "p", "q")  # a pool's block pairs must not follow the pool into one task
        .groupBy("pool", "p", "q")
        .applyInArrow(_pool_links(percent), "a long, b long")
    )
    links = links.unionByName(spill(more, "near-more"))

    found = components(links, "a", "b").select(F.col("node").alias("first"), "component")
    return members.join(found, "first", "left").select(
        F.col("id").alias(item),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "first").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "first"), F.lit(True)).alias("kept"),
    )
