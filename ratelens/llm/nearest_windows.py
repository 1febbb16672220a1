"""Exact highest inner products among windows' feature vectors, by a vector-approximation file.

Equal vectors are one class, with the smallest of its ids. Every class is also kept
as one small cell number per component. A pass over these cells bounds each (query, class) score from above and below. Scores that
cannot reach a query's k-th best lower bound are dropped; of the rest, exact
vectors are read in the order of their bounds: first the k most promising, whose
k-th exact score then says which others must still be read for the result to be
certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelens.llm.words import per_batch
from ratelens.session import spill

#: Queries that meet the cells in one pass; more take more passes.
QUERIES_PER_PASS = 4096
#: Candidates that a task holds before it lets those go that are still possible.
HELD_ROWS = 1 << 20
_ROWS = 512


def integer_vectors(windows: DataFrame, window: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * component) of usable vectors; rows of one id count once (the least vector)."""
    x = F.col(vector).cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = windows.where(F.col(window).isNotNull() & x.isNotNull() & usable).select(F.col(window).cast("long").alias("id"), x.alias("x"))
    largest, longest = kept.agg(
        F.max(F.aggregate("x", F.lit(0.0), lambda m, c: F.greatest(m, F.abs(c)))), F.max(F.size("x"))
    ).first()
    if largest is not None and (scale * largest + 1) ** 2 * max(1, longest) >= 2.0**62:
        raise ValueError(f"components of up to {largest} are too large: scores of {longest} components must fit a long")
    scaled = F.transform("x", lambda c: F.floor(c * F.lit(scale)).cast("long"))
    return kept.select("id", scaled.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _classes(vectors: DataFrame, most: int) -> DataFrame:
    """(id, v, ids): equal vectors as one, under their smallest id, with their ``most`` smallest ids."""
    order = Window.partitionBy("v").orderBy("id")
    first = vectors.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    ids = F.sort_array(F.collect_list("id")).alias("ids")
    return first.groupBy("v").agg(ids).select(F.col("ids")[0].alias("id"), "v", "ids")


def _by_length(column: pa.Array):
    """(length, row numbers, matrix) for each vector length of a list column."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield int(n), rows, flat[offsets[rows][:, None] + np.arange(n)].astype(np.float64)


def _ranges(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts = [
        (np.full(n, n), np.arange(n), m.min(axis=0), m.max(axis=0)) for n, _, m in _by_length(batch.column("v")) if n
    ]
    cols = [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["length", "place", "low", "high"])


def _cells(grid: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Vectors -> cell numbers, one byte per component."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [b""] * batch.num_rows
        for n, rows, m in _by_length(batch.column("v")):
            if n:
                low, width = grid[n]
                for i, cell in zip(rows, ((m - low) // width).astype(np.uint8)):
                    out[i] = cell.tobytes()
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "cells"])

    return per_batch(run)


def _slack(largest: float) -> float:
    """What double arithmetic may lose on whole numbers of that size: nothing below 2^53."""
    return 0.0 if largest < 2.0**52 else largest * 1e-12


def _bounds(sought, grid: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Cells of windows -> (query, id, low, high) that may be among the query's k best of this task."""

    def over(batches):
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        least: dict[int, np.ndarray] = {}
        rows_held = 0

        def flush():
            for n, parts in held.items():
                query, found, lower, upper = (np.concatenate(column) for column in zip(*parts))
                keep = upper >= least[n].min(axis=1)[query]
                columns = (sought.value[n][0][query], found, np.floor(lower), np.ceil(upper))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[keep].astype(np.int64)) for c in columns], names=["query", "id", "low", "high"]
                )
            held.clear()

        for batch in batches:
            cells, ids = batch.column("cells").to_pylist(), batch.column("id").to_numpy()
            lengths = np.array([len(c) for c in cells])
            for n in set(lengths.tolist()) & set(sought.value):
                q_ids, q = sought.value[n]
                best = least.setdefault(n, np.full((len(q_ids), k), -np.inf))
                own = np.flatnonzero(lengths == n)
                for at in range(0, len(own), _ROWS):
                    rows = own[at : at + _ROWS]
                    low = high = np.zeros((len(rows), n))
                    slack = 0.0
                    if n:
                        start, width = grid[n]
                        cell = np.frombuffer(b"".join(cells[i] for i in rows), np.uint8).reshape(-1, n)
                        low = start + cell * width
                        high = low + width - 1
                        slack = _slack(np.abs(q).max(initial=0) * max(np.abs(low).max(), np.abs(high).max()) * n)
                    up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
                    upper, lower = high @ up + low @ down + slack, low @ up + high @ down - slack
                    best = np.partition(np.concatenate([best, lower.T], axis=1), -k, axis=1)[:, -k:]
                    least[n] = best
                    i, j = np.nonzero(upper >= best.min(axis=1))
                    held.setdefault(n, []).append((j, ids[rows][i], lower[i, j], upper[i, j]))
                    rows_held += len(i)
                    if rows_held >= HELD_ROWS:
                        yield from flush()
                        rows_held = 0
        yield from flush()

    return over


def _passes(queries: DataFrame):
    """The queries in bounded parts: {length: (ids, matrix)}."""
    parts = -(-queries.count() // QUERIES_PER_PASS)
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, parts)))
    for p in range(parts):
        rows = queries.where(part == p).toPandas()
        length = rows["v"].map(len)
        yield {
            int(n): (own["id"].to_numpy(np.int64), np.array(own["v"].tolist(), np.float64).reshape(len(own), int(n)))
            for n, own in rows.groupby(length)
        }


def top_windows(
    windows: DataFrame,
    queries: DataFrame,
    window: str = "window_id",
    vector: str = "features",
    k: int = 5,
    scale: int = 256,
    bits: int = 6,
) -> DataFrame:
    """(query_id, rank, window, score): the ``k`` windows with the highest integer inner product per query.

    Components count as floor(scale * component), without a bound but that a score
    must fit a long; tables where it may not are refused. A query's own id is no
    candidate; ties go to the smaller id; a query with fewer candidates gets them
    all. Vectors that are null or hold a null or non-finite component, and rows
    with a null id, take no part; vectors of another length than the query's are
    not its candidates; rows of one id count once, with the least vector. Empty
    tables give an empty result. Other columns are not read.

    ``bits`` (8 at most) sets the cells per component. It changes how many exact
    vectors are read, never the result.
    """
    spark = windows.sparkSession
    # A class holds one query's own id at most, so k + 1 of its ids, and k + 1 classes, are enough.
    vectors = spill(_classes(integer_vectors(windows, window, vector, scale), k + 1), "window-vectors")
    asked = spill(integer_vectors(queries, window, vector, scale), "query-vectors")
    alike = asked.groupBy("v").agg(F.min("id").alias("id"))
    wanted = spill(alike, "query-classes")
    # One row per vector length and component.
    seen = (
        vectors.mapInArrow(per_batch(_ranges), "length long, place long, low long, high long")
        .groupBy("length", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .orderBy("length", "place").toPandas()
    )
    grid = {
        int(n): (g["low"].to_numpy(float), np.ceil((g["high"] - g["low"] + 1).to_numpy(float) / (1 << bits)))
        for n, g in seen.groupby("length")
    }
    cells = spill(vectors.mapInArrow(_cells(grid), "id long, cells binary"), "window-cells")

    result = None
    for sought in _passes(wanted):
        bounded = cells.mapInArrow(
            _bounds(spark.sparkContext.broadcast(sought), grid, k + 1), "query long, id long, low long, high long"
        )
        best = _best(spill(bounded, "window-bounds"), vectors, wanted, k + 1)
        result = best if result is None else result.unionByName(best)
    if result is None:
        return spark.createDataFrame([], f"query_id long, rank int, {window} long, score long")
    members = asked.join(wanted.withColumnRenamed("id", "query"), "v").select("query", F.col("id").alias("query_id"))
    found = result.join(vectors.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("id"))
    # Of one query's vector, k + 1 classes with k + 1 ids each.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.join(members, "query").where("id != query_id").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(window), "score")


def _best(bounded: DataFrame, vectors: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    by_low = Window.partitionBy("query").orderBy(F.desc("low"), "id")
    by_high = Window.partitionBy("query").orderBy(F.desc("high"), "id")
    kth = bounded.withColumn("r", F.row_number().over(by_low)).where(f"r = {k}").select("query", F.col("low").alias("floor"))
    able = bounded.join(kth, "query", "left").where("floor IS NULL OR high >= floor")
    able = spill(able.withColumn("r", F.row_number().over(by_high)).select("query", "id", "high", "r"), "window-able")

    first = spill(_exact(able.where(f"r <= {k}"), vectors, wanted), "window-first")
    certain = first.groupBy("query").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(f"n = {k}")
    rest = able.where(f"r > {k}").join(certain.select("query", "kth"), "query").where("high >= kth")
    scored = first.unionByName(_exact(rest, vectors, wanted))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query", "id", "score")


def _exact(pairs: DataFrame, vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    score = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    return (
        pairs.select("query", "id")
        .join(wanted.select(F.col("id").alias("query"), F.col("v").alias("w")), "query")
        .join(vectors, "id")
        .select("query", "id", score.alias("score"))
    )
