"""Running totals over a whole table in one total order, whatever its size or skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.session import spill


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` with, per entry of ``totals``, the sum of that long over all rows before the row in ``order``.

    Rows are dealt to tasks by ranges of ``order`` (by rows, so no key can be
    hot), each task sums its own range, and one row per task carries over. The
    ranges come from a sample, so they are written out once and read from there.
    Rows that tie in ``order`` follow each other in any order.
    """
    named = {f"_v{i}": value for i, value in enumerate(totals.values())}
    rows = spill(
        df.withColumns(named).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task: as many as the shuffle has partitions.
    carry = rows.groupBy("_part").agg(*[F.sum(v).alias(v) for v in named])
    carry = carry.select(
        "_part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_c{i}") for i, v in enumerate(named)]
    )
    within = rows.withColumns(
        {name: F.coalesce(F.sum(v).over(before), F.lit(0)) for name, v in zip(totals, named)}
    ).join(F.broadcast(carry), "_part")
    return within.withColumns({name: F.col(name) + F.col(f"_c{i}") for i, name in enumerate(totals)}).drop(
        "_part", *named, *[f"_c{i}" for i in range(len(named))]
    )
