"""Mixing families of clips to target weights by Sainte-Laguë apportionment.

The mix is made of equal blocks of words. Each block goes to the family with the
highest quotient target / (2 * blocks so far + 1), which gives whole quotas, for
any number of output shards at once, since a longer mix only ever adds blocks.
Each family lays its logs on a tape in a seeded order; the tape is cut into blocks
and the quota takes them in tape order, around the end as often as needed.

Everything is DataFrame work. Orders over families and over logs are running
totals by row ranges, so neither a hot family nor many families meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.plans.ranges import running_totals
from ratelens.session import spill

#: Words of a log's size.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Blocks that a whole mix is cut into, about; a family's share is exact to one block.
BLOCKS = 1 << 20


def log_sizes(logs: DataFrame, item: str = "item_id", family: str = "family", text: str = "log") -> DataFrame:
    """(item, family, size): words of each whole log; null has none."""
    return logs.select(
        F.col(item).alias("item_id"),
        F.col(family).alias("family"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def family_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(family, family_size, place, weight, target), one row per family.

    ``place`` numbers the families by code point from 0, null last, and deals out
    ``weights`` in turn. Families share all words by weight; none gets more than
    ``MOST_REPEATS`` times its own, and what it can't take is shared by weight
    among the others. Without any word all targets are 0.
    """
    families = sizes.groupBy("family").agg(F.sum("size").alias("family_size"))
    placed = running_totals(families, [F.col("family").asc_nulls_last()], {"place": F.lit(1).cast("long")})
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = spill(placed.withColumn("weight", cycle.cast("long")), "families")
    total, weight = placed.agg(F.sum("family_size"), F.sum("weight")).first()
    most = MOST_REPEATS * F.col("family_size")
    # Families reach their limit in the order of limit / weight; the first that doesn't fixes the level.
    filling = running_totals(
        placed, [(most / F.col("weight")).asc(), F.col("place").asc()], {"capped": most, "gone": F.col("weight")}
    )
    level = (F.lit(total or 0).cast("double") - F.col("capped")) / (F.lit(weight or 1).cast("double") - F.col("gone"))
    level = filling.where(most >= level * F.col("weight")).agg(F.min_by(level, "gone")).first()[0]
    return placed.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(float(level or 0))))


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def family_quotas(targets: DataFrame, blocks: int, shards: int = 1) -> DataFrame:
    """(shard, family, place, blocks): whole blocks of each family in each of ``shards`` shards of the mix.

    Shard s holds blocks [s * blocks / shards, (s + 1) * blocks / shards) of the
    mix. Highest quotients win, ties go to the smaller ``place``. All quotas are
    found without ranking every block: at two multipliers of the exact shares the
    rounded quotas are certain to total too few and too many, and only the few
    quotients between them (about three per family) are ranked.
    """
    live = targets.where("target > 0")
    n, total = live.agg(F.count("*"), F.sum("target")).first()
    if not n or blocks < 1:
        return targets.select(F.lit(0).alias("shard"), "family", "place", F.lit(0).cast("long").alias("blocks"))
    house = F.floor(F.lit(blocks) * (F.col("shard") + 1) / shards).cast("long")
    rows = live.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("house", house)
    share = F.col("house") * F.col("target") / F.lit(total)
    few = F.greatest(F.lit(0), _rounded(share * (F.col("house") - n) / F.col("house")) - 1)
    many = _rounded(share * (F.col("house") + n) / F.col("house")) + 1
    rows = spill(
        rows.where("house > 0").select(
            "shard", "house", "family", "place", "target",
            F.when(F.col("house") > n, few).otherwise(F.lit(0)).cast("long").alias("sure"), many.alias("most"),
        ),
        "quotas",
    )
    open_ = rows.withColumn("s", F.explode(F.sequence("sure", "most"))).withColumn(
        "quotient", F.col("target") / (2 * F.col("s") + 1)
    )
    ranked = running_totals(
        open_, [F.col("shard").asc(), F.col("quotient").desc(), F.col("place").asc()], {"rank": F.lit(1).cast("long")}
    )
    by_shard = rows.groupBy("shard").agg(
        F.sum("sure").alias("given"), F.sum(F.col("most") - F.col("sure") + 1).alias("open")
    )
    by_shard = by_shard.withColumn(
        "before",
        F.coalesce(F.sum("open").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    won = (
        ranked.join(F.broadcast(by_shard), "shard")  # one row per shard of the mix
        .where(F.col("rank") - F.col("before") < F.col("house") - F.col("given"))
        .groupBy("shard", "place").agg(F.count("*").alias("won"))
    )
    seats = rows.join(won, ["shard", "place"], "left").withColumn("seats", F.col("sure") + F.coalesce("won", F.lit(0)))
    last = F.lag("seats", 1, 0).over(Window.partitionBy("place").orderBy("shard"))
    return seats.select("shard", "family", "place", (F.col("seats") - last).alias("blocks"))


def mix_families(
    logs: DataFrame,
    item: str = "item_id",
    family: str = "family",
    text: str = "log",
    weights: tuple[int, ...] = WEIGHTS,
    shards: int = 8,
    blocks: int = BLOCKS,
    seed: str = "mix",
) -> DataFrame:
    """(item, family, size, family_size, target, taken): how many words the mix takes of each log, repeats counted.

    One row per row of ``logs``, repeated ones too. Null and wordless logs have
    size 0 and give nothing; a null family is a family of its own; rows with a
    null item take part. A family's ``taken`` differs from its target by less than
    two blocks (a block is 1 / ``blocks`` of all words, one word at least), and no
    log gives more than three times its size. The seeded order depends on seed,
    item and size alone, so reruns agree. An empty table gives an empty result.
    Other columns are not read.
    """
    sizes = spill(log_sizes(logs, item, family, text), "sizes")
    targets = spill(family_targets(sizes, weights), "targets")
    total = targets.agg(F.sum("family_size")).first()[0] or 0
    block = max(1, -(-total // blocks))
    quotas = family_quotas(targets, (total + block // 2) // block, shards).groupBy("place").agg(
        F.sum("blocks").alias("quota")
    )
    plan = running_totals(targets, [F.col("place").asc()], {"tape": F.col("family_size")}).join(quotas, "place", "left")
    plan = plan.select(
        "family", "family_size", "target", "tape",
        F.least(F.coalesce("quota", F.lit(0)) * block, MOST_REPEATS * F.col("family_size")).alias("words"),
    )
    dice = F.md5(F.concat_ws(":", F.lit(seed), F.col("item_id").cast("string"), F.col("size").cast("string")))
    laid = running_totals(
        sizes.withColumn("dice", dice),
        [F.col("family").asc_nulls_last(), F.col("dice").asc(), F.col("item_id").asc()],
        {"start": F.col("size")},
    )
    rows = laid.join(plan.withColumnRenamed("family", "f"), F.col("family").eqNullSafe(F.col("f")))
    whole = F.expr("CASE WHEN family_size > 0 THEN words DIV family_size ELSE 0 END")
    over = F.col("words") - whole * F.col("family_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), over - (F.col("start") - F.col("tape"))))
    return rows.select(
        F.col("item_id").alias(item), F.col("family").alias(family), "size", "family_size", "target",
        (whole * F.col("size") + part).cast("long").alias("taken"),
    )
