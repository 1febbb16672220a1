"""Quality of clips' logs: classifier evidence joined with shrunken rates of their root and folder.

Hierarchical empirical Bayes. How often logs of a root, and of a folder in it, were
marked good is itself uncertain where marks are few, so a root's rate is drawn
towards the rate of all roots, and a folder's towards its root's, by strengths
that the spread between roots and folders itself suggests. The log's own evidence
is a naive Bayes ratio over a few binned properties of the whole text. Everything
is grouped aggregation over all marked logs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.session import spill

# Upper bin edges of each property.
BINS = {
    "symbols": (0.005, 0.03, 0.08, 0.2),
    "repeats": (0.15, 0.3, 0.5, 0.75),
    "capitals": (0.004, 0.03, 0.08, 0.3),
    "digits": (0.01, 0.05, 0.2),
    "word_length": (4.0, 5.5, 6.5, 8.0),
    "lines": (0.0, 0.3, 0.6),
}
#: Pseudo-count of every bin.
SMOOTH = 1.0


def _properties(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, lines = F.split(F.trim(text), r"\s+"), F.split(text, "\n")
    return {
        "symbols": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()-]")) / size,
        "repeats": 1 - F.size(F.array_distinct(words)) / F.size(words),
        "capitals": F.regexp_count(text, F.lit(r"\p{Lu}")) / size,
        "digits": F.regexp_count(text, F.lit(r"\p{N}")) / size,
        "word_length": size / F.size(words),
        "lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
    }


def _bin(value: Column, edges: tuple[float, ...]) -> Column:
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(value <= edges[k], F.lit(k)).otherwise(out)
    return out


def log_bins(logs: DataFrame, text: str = "log") -> DataFrame:
    """``logs`` with one ``bin_*`` column per property in place of the text."""
    found = _properties(F.col(text))
    kept = [c for c in logs.columns if c != text]
    return logs.select(*kept, *[_bin(found[p], edges).alias(f"bin_{p}") for p, edges in BINS.items()])


def bin_evidence(marked: DataFrame) -> dict[str, list[float]]:
    """Log ratio, good to bad, of every bin of every property over all marked logs."""
    counts = marked.select(
        "good", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"bin_{p}").alias("b")) for p in BINS])).alias("x")
    ).groupBy("x.p", "x.b").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("h"))
    found = {(r["p"], r["b"]): (r["g"], r["h"]) for r in counts.collect()}  # one row per bin
    out = {}
    for p, edges in BINS.items():
        own = [found.get((p, b), (0, 0)) for b in range(len(edges) + 1)]
        good, bad = sum(g for g, _ in own), sum(h for _, h in own)
        n = len(own) * SMOOTH
        out[p] = [math.log((g + SMOOTH) / (good + n) / ((h + SMOOTH) / (bad + n))) for g, h in own]
    return out


def _strength(rates: DataFrame, mean: str) -> float:
    """Pseudo-marks of the parent: the within-group variance over that between groups, by moments.

    ``rates`` has n marks and k good ones per group, and the parent's rate in ``mean``.
    """
    q = F.col(mean) * (1 - F.col(mean))
    row = rates.where("n > 1").agg(
        F.sum((F.col("k") - F.col("n") * F.col(mean)) ** 2 / F.col("n")).alias("seen"),
        F.sum(q).alias("within"), F.sum(F.col("n") * q).alias("weight"), F.sum(q).alias("groups"),
    ).first()
    if not row["within"]:
        return 1e3
    # E[seen] = sum(q) + rho * sum((n - 1) q), with rho the share of the variance between groups.
    spread = row["weight"] - row["groups"]
    rho = (row["seen"] - row["within"]) / spread if spread else 0.0
    return min(1e3, max(1.0, (1 - rho) / rho)) if rho > 0 else 1e3


def clip_quality(
    logs: DataFrame, marks: DataFrame, item: str = "item_id", text: str = "log", root: str = "root", folder: str = "dir",
    mark: str = "good",
) -> DataFrame:
    """(item, evidence, root_rate, folder_rate, score, kept): probability that each whole log is a good one.

    ``score`` joins the prior odds of the log's folder with its own evidence;
    ``kept`` is score >= 0.5. Marks (0 or 1) that are null or of no log count
    nowhere; of several marks of one item the largest counts. Null and empty
    texts are judged by their bins like others; a null root or folder is a group
    of its own; groups without marks get their parent's rate, and without any
    mark every score is 0.5. One row per row of ``logs``, repeated ones too.
    Other columns are not read.
    """
    base = logs.select(
        F.col(item).alias("item"), F.col(root).alias("root"), F.col(folder).alias("folder"), F.col(text).alias("log")
    )
    binned = spill(log_bins(base), "log-bins")
    known = marks.where(F.col(item).isNotNull() & F.col(mark).isNotNull()).groupBy(F.col(item).alias("item")).agg(
        F.max(F.col(mark).cast("int")).alias("good")
    )
    marked = spill(binned.join(known, "item"), "marked")
    all_, good = marked.agg(F.count("*"), F.sum("good")).first()
    rate = (good + 0.5) / (all_ + 1) if all_ else 0.5
    evidence = bin_evidence(marked)

    folders = marked.groupBy("root", "folder").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    roots = spill(folders.groupBy("root").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "roots").withColumn(
        "all_rate", F.lit(rate)
    )
    m = _strength(roots, "all_rate")
    roots = roots.select("root", ((F.col("k") + m * F.col("all_rate")) / (F.col("n") + m)).alias("root_rate"))
    named = roots.withColumnRenamed("root", "r")
    folders = spill(folders.join(named, F.col("root").eqNullSafe(F.col("r"))).drop("r"), "folders")
    m = _strength(folders, "root_rate")
    folders = folders.select(
        F.col("root").alias("fr"), F.col("folder").alias("ff"),
        ((F.col("k") + m * F.col("root_rate")) / (F.col("n") + m)).alias("folder_rate"),
    )
    own = sum(
        F.element_at(F.array(*map(F.lit, evidence[p])), F.col(f"bin_{p}") + 1) for p in BINS
    )
    rows = (
        binned.join(named, F.col("root").eqNullSafe(F.col("r")), "left")
        .join(folders, F.col("root").eqNullSafe(F.col("fr")) & F.col("folder").eqNullSafe(F.col("ff")), "left")
        .withColumn("root_rate", F.coalesce("root_rate", F.lit(rate)))
        .withColumn("folder_rate", F.coalesce("folder_rate", "root_rate"))
        .withColumn("evidence", own)
    )
    odds = F.log(F.col("folder_rate") / (1 - F.col("folder_rate"))) + F.col("evidence")
    return rows.withColumn("score", 1 / (1 + F.exp(-odds))).select(
        F.col("item").alias(item), "evidence", "root_rate", "folder_rate", "score", (F.col("score") >= 0.5).alias("kept")
    )
