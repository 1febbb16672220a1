"""Ordered computations inside a group whose size is not bounded.

A plain ``Window.partitionBy(key).orderBy(x)`` sends every row of a key to one
task. One clip, source or title may hold a third of all rows, so, at every size:

1. rows get a *chunk*: a range of the order columns. Frame numbers are dense, so
   ``frame div 65536`` is enough (:func:`frame_chunks`). Other rows are dealt by
   ranges of (key, order), which splits by rows, whatever the key or its values
   (:func:`value_chunk`);
2. the window runs on ``(key, chunk)``;
3. what the earlier chunks contribute is joined in: one small row per chunk
   (:func:`ordered`).

No job looks at sizes. Ranges come from a sample, so :func:`value_chunk` writes
the chunked rows once, and the window and the carry both read that copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.session import cut, spill

FRAMES_PER_CHUNK = 1 << 16

CHUNK = "_chunk"


def frame_chunk(position: Column, frames_per_chunk: int = FRAMES_PER_CHUNK) -> Column:
    return F.floor(position / F.lit(frames_per_chunk)).cast("long")


def frame_chunks(
    df: DataFrame, frame: str, *, frames_per_chunk: int = FRAMES_PER_CHUNK, out: str = CHUNK
) -> DataFrame:
    """Add ``out``: the range of frame numbers that each row lies in."""
    return df.withColumn(out, frame_chunk(F.col(frame), frames_per_chunk))


def value_chunk(
    df: DataFrame,
    by: Sequence[str],
    order: Column | str | Sequence[Column | str],
    *,
    rows_per_chunk: int | None = None,
    out: str = CHUNK,
) -> DataFrame:
    """``df``, written out, with ``out``: the range of (``by``, ``order``) that each row lies in.

    Give all order columns, so that even rows of one key and one value can be
    split. There are as many ranges as Spark makes shuffle partitions, or, with
    ``rows_per_chunk``, as many as it takes (that counts the rows first).
    """
    order = [order] if isinstance(order, str | Column) else list(order)
    keys = [*by, *order]
    if rows_per_chunk is None:
        ranged = df.repartitionByRange(*keys)
    else:
        ranged = df.repartitionByRange(max(1, -(-df.count() // rows_per_chunk)), *keys)
    return spill(ranged.withColumn(out, F.spark_partition_id().cast("long")), "chunks")


def _fold(kind: str, column: Column) -> Column:
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](column)


def _merge(kind: str, left: Column, right: Column | None) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0)) + (F.coalesce(right, F.lit(0)) if right is not None else F.lit(0))
    if right is None:
        return left
    return F.greatest(left, right) if kind == "max" else F.least(left, right)


def ordered(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    *,
    running: dict[str, tuple[str, Column]] | None = None,
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
    chunk: str = CHUNK,
    descending: bool = False,
) -> DataFrame:
    """Add ordered results within ``by``.

    ``running``: output -> (sum/max/min, expression) over all rows before this
    one. ``before`` / ``after``: output -> column of the previous / next row
    (needs ``order`` to be column names). With ``descending``, ``order`` runs
    against the chunk order. The carry of the chunks is materialised, so that
    the plan does not double with every ordered step.
    """
    by, order = list(by), list(order)
    running, before, after = running or {}, before or {}, after or {}
    chunked = chunk in df.columns
    last = F.struct(*[F.col(c).alias(n) for n, c in before.items()]) if before else None
    first = F.struct(*[F.col(c).alias(n) for n, c in after.items()]) if after else None
    out, keys = df, by
    if chunked:
        keys = [*by, chunk]
        carry = _carry(df, by, order, running, last, first, chunk, descending)
        out = df.join(carry, keys, "left")
    inner = Window.partitionBy(*keys).orderBy(*order)
    frame = inner.rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, expr) in running.items():
        out = out.withColumn(f"_w_{name}", _fold(kind, expr).over(frame))
    if before:
        out = out.withColumn("_w_last", F.lag(last).over(inner))
    if after:
        out = out.withColumn("_w_first", F.lead(first).over(inner))

    def with_carry(name: str) -> Column:
        return F.coalesce(f"_w_{name}", f"_c_{name}") if chunked else F.col(f"_w_{name}")

    results = {
        n: _merge(kind, F.col(f"_w_{n}"), F.col(f"_c_{n}") if chunked else None) for n, (kind, _) in running.items()
    }
    results |= {n: with_carry("last")[n] for n in before}
    results |= {n: with_carry("first")[n] for n in after}
    kept = [c for c in df.columns if c not in results]
    return out.select(*kept, *[value.alias(n) for n, value in results.items()])


def _carry(df, by, order, running, last, first, chunk, descending) -> DataFrame:
    """What the chunks before (and after) each chunk contribute; only keys with several chunks."""
    totals = [_fold(kind, expr).alias(f"_t_{name}") for name, (kind, expr) in running.items()]
    if last is not None:
        totals.append(F.max_by(last, F.struct(*order)).alias("_last"))
    if first is not None:
        totals.append(F.min_by(first, F.struct(*order)).alias("_first"))
    chunks = df.groupBy(*by, chunk).agg(*totals)
    whole = Window.partitionBy(*by)
    line = whole.orderBy(F.desc(chunk) if descending else F.asc(chunk))
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    carried = [
        _fold(kind, F.col(f"_t_{name}")).over(earlier).alias(f"_c_{name}") for name, (kind, _) in running.items()
    ]
    if last is not None:
        carried.append(F.lag("_last").over(line).alias("_c_last"))
    if first is not None:
        carried.append(F.lead("_first").over(line).alias("_c_first"))
    rows = chunks.select(*by, chunk, F.count(F.lit(1)).over(whole).alias("_chunks"), *carried)
    return cut(rows.filter(F.col("_chunks") > 1).drop("_chunks"))


def position(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], *, out: str = "pos", chunk: str = CHUNK
) -> DataFrame:
    """0-based rank of each row along ``order`` (a distributed row_number)."""
    return ordered(df, by, order, running={out: ("sum", F.lit(1).cast("long"))}, chunk=chunk)
