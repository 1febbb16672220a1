"""Short codes for windows' feature vectors: product quantisation, learned over cover trees.

Vectors are cut into parts, and each part position has a codebook that Lloyd's
rounds improve. Every chunk of vectors is kept, per part, as a cover tree: a
node's children lie within half its radius and apart by more than that. The
points lie in tree order, so a node's sum is a difference of two cumulative sums.
If the two codebook entries nearest to a node's centre differ in distance by more
than twice the node's radius, the whole subtree goes to the nearest one; only
ambiguous nodes are opened, and only ambiguous leaves compare their points. The
trees are built and written once; each round reads them and leaves one row per
task, entry and component.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ratelens.session import spill

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors per tree, and components of all vectors that a task holds for the trees it builds.
ROWS_PER_TREE = 2048
HELD_COMPONENTS = 1 << 20
#: A node of so few points is a leaf.
LEAF = 16


class CoverTree:
    """Cover tree over the rows of an integer matrix.

    ``points`` are in tree order (``order`` has their row numbers), so that node
    ``i`` covers ``points[start[i]:end[i]]``; its centre is ``points[centre[i]]``,
    no covered point is farther from it than ``radius[i]``, and its children are
    the nodes ``child[i]`` to ``stop[i] - 1``. Node 0 is the root.
    """

    FIELDS = ("order", "points", "start", "end", "centre", "radius", "child", "stop")

    def __init__(self, **fields: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, fields[name])

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        m = len(points)
        order = np.arange(m)
        start, end, centre, radius, child, stop = [0], [m], [0], [], [], []
        node = 0
        while node < len(start):
            at, to, c = start[node], end[node], centre[node]
            members = order[at:to].copy()
            away = squared(points[members], points[c : c + 1])[:, 0]
            most = away.max()
            radius.append(most)
            child.append(len(start))
            if to - at > leaf and most > 0:
                rest, mid = members, c
                while len(rest):
                    near = 4 * squared(points[rest], points[mid : mid + 1])[:, 0] <= most
                    own = rest[near]
                    order[at : at + len(own)] = own
                    start.append(at)
                    end.append(at + len(own))
                    centre.append(mid)
                    at += len(own)
                    rest = rest[~near]
                    mid = int(rest[0]) if len(rest) else 0
            stop.append(len(start))
            node += 1
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        return cls(
            order=order, points=points[order], start=np.array(start), end=np.array(end), centre=place[centre],
            radius=np.sqrt(np.array(radius, np.float64)), child=np.array(child), stop=np.array(stop),
        )

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data), allow_pickle=False) as kept:
            return cls(**{name: kept[name] for name in cls.FIELDS})

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, entry): ranges of ``points`` with the nearest entry of ``book``; ties to the lower index.

        A whole subtree is one range, a point that was compared by itself another.
        """
        active, ranges = np.zeros(1, np.int64), []
        while len(active):
            away = squared(self.points[self.centre[active]], book)
            nearest = away.argmin(axis=1)
            reach = self.radius[active]
            if len(book) > 1:
                first, second = np.sqrt(np.partition(away, 1, axis=1)[:, :2].astype(np.float64)).T
                # The margin is above what square roots of doubles may lose.
                sure = (second - first - 2 * reach > 1e-9 * (second + reach)) | (reach == 0)
            else:
                sure = np.ones(len(active), bool)
            ranges.append((self.start[active[sure]], self.end[active[sure]], nearest[sure]))
            open_ = active[~sure]
            leaf = self.child[open_] == self.stop[open_]
            points = _runs(self.start[open_[leaf]], self.end[open_[leaf]])
            if len(points):
                ranges.append((points, points + 1, squared(self.points[points], book).argmin(axis=1)))
            active = _runs(self.child[open_[~leaf]], self.stop[open_[~leaf]])
        return tuple(np.concatenate(column) for column in zip(*ranges))


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, each to each."""
    most = max(np.abs(points).max(initial=0), np.abs(others).max(initial=0))
    if 4 * int(most) ** 2 * max(1, points.shape[1]) < 1 << 52:  # whole doubles all the way
        a, b = points.astype(np.float64), others.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(points), len(others)), np.int64)
    for j, other in enumerate(others):
        out[:, j] = ((points - other) ** 2).sum(axis=1)
    return out


def _runs(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one after another."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _cuts(n: int) -> list[slice]:
    return [slice(p * n // PARTS, (p + 1) * n // PARTS) for p in range(PARTS)]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors -> rows of (n, windows, pools, trees), each a chunk of one length."""
    held: dict[int, list[pa.RecordBatch]] = {}
    size = 0

    def flush(n: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held.pop(n)).combine_chunks()
        for at in range(0, rows.num_rows, ROWS_PER_TREE):
            part = rows.slice(at, ROWS_PER_TREE).combine_chunks()
            flat = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            matrix = flat.astype(np.int64).reshape(part.num_rows, n)
            trees = [CoverTree.grow(matrix[:, cut]).dump() for cut in _cuts(n)]
            one = pa.array([0, part.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(one, part.column(c).combine_chunks()) for c in ("w", "p")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), *lists, pa.array([trees], pa.list_(pa.binary()))],
                names=["n", "windows", "pools", "trees"],
            )

    for batch in batches:
        lengths = batch.column("v").value_lengths().to_numpy()
        for n in np.unique(lengths):
            own = batch.take(pa.array(np.flatnonzero(lengths == n)))
            held.setdefault(int(n), []).append(own)
            size += own.num_rows * max(1, int(n))
            if sum(b.num_rows for b in held[int(n)]) >= ROWS_PER_TREE or size >= HELD_COMPONENTS:
                for full in [int(n)] if size < HELD_COMPONENTS else list(held):
                    size -= sum(b.num_rows for b in held[full]) * max(1, full)
                    yield from flush(full)
    for n in list(held):
        yield from flush(n)


def _partial_sums(books):
    """Trees -> per task and entry: (n, part, entry, rows, sums)."""

    def over(batches):
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for n, trees in zip(batch.column("n").to_pylist(), batch.column("trees").to_pylist()):
                for part, (data, book) in enumerate(zip(trees, books.value[n])):
                    tree = CoverTree.load(data)
                    count, sums = total.setdefault(
                        (n, part), (np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64))
                    )
                    start, end, entry = tree.assign(book)
                    before = np.concatenate([np.zeros((1, book.shape[1]), np.int64), tree.points.cumsum(axis=0)])
                    np.add.at(count, entry, end - start)
                    np.add.at(sums, entry, before[end] - before[start])
        for (n, part), (count, sums) in total.items():
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({
                "n": pa.array(np.full(len(used), n, np.int32)), "part": pa.array(np.full(len(used), part, np.int32)),
                "entry": pa.array(used.astype(np.int32)), "rows": pa.array(count[used]),
                "sums": pa.array(list(sums[used]), pa.list_(pa.int64())),
            })

    return over


def _coded(books, digests: dict[int, str]):
    """Trees -> (w, p, code, error, codebooks)."""

    def over(batches):
        for batch in batches:
            rows = zip(batch.column("n").to_pylist(), batch.column("trees").to_pylist())
            for i, (n, trees) in enumerate(rows):
                windows = batch.column("windows")[i].values
                codes = np.zeros((len(windows), PARTS), np.uint8)
                error = np.zeros(len(windows), np.int64)
                for part, (data, book) in enumerate(zip(trees, books.value[n])):
                    tree = CoverTree.load(data)
                    start, end, entry = tree.assign(book)
                    of = np.empty(len(windows), np.int64)
                    of[_runs(start, end)] = np.repeat(entry, end - start)
                    codes[tree.order, part] = of
                    error[tree.order] += ((tree.points - book[of]) ** 2).sum(axis=1)
                text = [row.tobytes().hex() for row in codes]
                yield pa.RecordBatch.from_arrays(
                    [windows, batch.column("pools")[i].values, pa.array(text, pa.string()), pa.array(error),
                     pa.array([digests[n]] * len(text), pa.string())],
                    names=["w", "p", "code", "error", "codebooks"],
                )

    return over


def _first_books(vectors: DataFrame) -> dict[int, list[np.ndarray]]:
    """Per vector length, the parts of the ``ENTRIES`` vectors with the smallest ids."""
    once = vectors.groupBy(F.size("v").alias("n"), "w").agg(F.min("v").alias("v"))
    order = Window.partitionBy("n").orderBy(F.col("w").asc_nulls_last())
    rows = once.withColumn("r", F.row_number().over(order)).where(f"r <= {ENTRIES}").orderBy("n", "r")
    found: dict[int, list] = {}
    for row in rows.select("n", "v").collect():
        found.setdefault(row["n"], []).append(row["v"])
    whole = {n: np.array(v, np.int64).reshape(len(v), n) for n, v in found.items()}
    return {n: [m[:, cut].copy() for cut in _cuts(n)] for n, m in whole.items()}


def _digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for part in book for x in part.ravel().tolist()).encode()).hexdigest()


def window_codes(
    windows: DataFrame, window: str = "window_id", vector: str = "features", pool: str = "pool"
) -> DataFrame:
    """(window, pool, code, error, pool_error, codebooks_sha256): every window's vector as ``PARTS`` codebook indexes.

    Components count as floor(``SCALE`` * component). Vectors are cut into
    ``PARTS`` consecutive parts, equal ones where the length allows. Each part
    position's codebook starts as the parts of the ``ENTRIES`` smallest window
    ids (of one id's vectors the least one); each of ``ROUNDS`` rounds takes every
    part to its nearest entry (squared distance, ties to the lower index) and
    replaces each entry in use by the floored mean of its parts. ``code`` has two
    hex digits per part, ``error`` is the sum of the final squared distances,
    ``pool_error`` its sum over the windows of the same pool, nulls together, and
    ``codebooks_sha256`` the hash of all final entries in decimal, comma-joined.

    One row per row of ``windows``, repeated ones too, but for vectors that are
    null or hold a null or non-finite component, which take no part. A null id
    comes after all others. Vectors of each length have codebooks of their own,
    of ``ENTRIES`` x length numbers, which are what the driver holds. Components
    so large that a squared distance may not fit a long are refused. An empty
    table gives an empty result. Other columns are not read.
    """
    x = F.col(vector).cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = windows.where(x.isNotNull() & usable).select(F.col(window).alias("w"), F.col(pool).alias("p"), x.alias("x"))
    most, longest = kept.agg(
        F.max(F.aggregate("x", F.lit(0.0), lambda m, c: F.greatest(m, F.abs(c)))), F.max(F.size("x"))
    ).first()
    if most is not None and (2 * (SCALE * most + 1)) ** 2 * max(1, longest) >= 2.0**62:
        raise ValueError(f"components of up to {most} are too large: squared distances must fit a long")
    rows = kept.select("w", "p", F.transform("x", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long")).alias("v"))
    vectors = spill(rows, "code-vectors")
    books = _first_books(vectors)
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    schema = StructType([
        StructField("n", IntegerType()), StructField("windows", ArrayType(kinds["w"])),
        StructField("pools", ArrayType(kinds["p"])), StructField("trees", ArrayType(BinaryType())),
    ])
    trees = spill(vectors.mapInArrow(_trees, schema), "code-trees")
    context = windows.sparkSession.sparkContext
    for _ in range(ROUNDS):
        sums = trees.mapInArrow(
            _partial_sums(context.broadcast(books)), "n int, part int, entry int, rows long, sums array<long>"
        ).select("n", "part", "entry", "rows", F.posexplode("sums").alias("place", "value"))
        means = sums.groupBy("n", "part", "entry", "place").agg(F.sum("value").alias("s"), F.sum("rows").alias("c"))
        new = {n: [part.copy() for part in book] for n, book in books.items()}
        for n, part, entry, place, total, count in means.collect():
            new[n][part][entry, place] = total // count
        books = new
    out = StructType([
        StructField("w", kinds["w"]), StructField("p", kinds["p"]), StructField("code", StringType()),
        StructField("error", LongType()), StructField("codebooks", StringType()),
    ])
    digests = {n: _digest(book) for n, book in books.items()}
    coded = spill(trees.mapInArrow(_coded(context.broadcast(books), digests), out), "codes")
    pools = coded.groupBy(F.col("p").alias("q")).agg(F.sum("error").alias("pool_error"))
    return coded.join(pools, F.col("p").eqNullSafe(F.col("q"))).select(
        F.col("w").alias(window), F.col("p").alias(pool), "code", "error", "pool_error",
        F.col("codebooks").alias("codebooks_sha256"),
    )
