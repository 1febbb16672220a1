"""Batch planning: inputs, outputs, collisions, skips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.functions.media import bitmap_subtitle_violation
from ratelens.functions.rate import target_bitrate
from ratelens.policy import SIDECAR_EXTENSIONS
from ratelens.session import spread


#: Pairs of one (dir, stem) that one task joins.
PAIRS = 1 << 20


def match_sidecars(videos: DataFrame, subtitles: DataFrame) -> DataFrame:
    """Subtitle files next to a video: same folder, and the name is the video's stem followed by a dot.

    Videos: ``id, dir, stem``; subtitles: ``id, dir, name``. A stem that fits must
    end right before one of the dots of the name, so each name offers its dotted
    prefixes and the join is a plain equality on (dir, stem). What it costs is its
    pairs, not its input: stems with many have their videos dealt out in pieces.
    """
    name = F.col("name")
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    parts = F.split(name, r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")
    )
    named = subtitles.filter(extension.isin(*SIDECAR_EXTENSIONS)).select(
        "dir", F.col("id").alias("subtitle_id"), "name", F.explode(F.array_distinct(prefixes)).alias("stem")
    )
    films = videos.select(F.col("id").alias("video_id"), "dir", "stem")
    key = ["dir", "stem"]
    sizes = films.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).join(named.groupBy(*key).agg(F.count(F.lit(1)).alias("_m")), key)
    # Such a key has 2,000 rows or more, so these are few.
    large = F.broadcast(sizes.where(F.col("_n") * F.col("_m") > PAIRS).select(*key, F.ceil(F.col("_n") * F.col("_m") / PAIRS).alias("_pieces")))
    pieces = F.coalesce("_pieces", F.lit(1).cast("long"))
    films = films.join(large, key, "left").withColumn("_piece", F.pmod(F.xxhash64("video_id"), pieces)).drop("_pieces")
    named = named.join(large, key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("_pieces")
    # Whichever side is broadcast, the other one lies in partitions that are not merged by the size of their input.
    films, named = spread(films, *key, "_piece"), spread(named, *key, "_piece")
    return films.join(named, [*key, "_piece"]).select("video_id", "subtitle_id", "dir", "stem", "name")


def dedupe_sources(df: DataFrame, path: str, order: str) -> DataFrame:
    """First occurrence of each path, ignoring case."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.lower(F.col(path)).alias("_k")).agg(F.min_by(row, F.col(order)).alias("_r")).select("_r.*")


def disambiguate_outputs(df: DataFrame, source: str = "source_path", output: str = "output") -> DataFrame:
    """Outputs that collide (ignoring case) get ``-<first 8 hex of sha1(source)>`` before their extension."""
    key = F.lower(F.col(output))
    counts = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = df.withColumn("_k", key).join(counts, "_k", "left")
    digest = F.substring(F.sha1(F.col(source)), 1, 8)
    stem = F.regexp_replace(F.col(output), r"(?<=[^/.])\.[^./]+$", "")
    extension = F.substr(F.col(output), F.length(stem) + 1)
    changed = F.concat(stem, F.lit("-"), digest, extension)
    return rows.withColumn(output, F.when(F.col("_n").isNotNull(), changed).otherwise(F.col(output))).drop("_k", "_n")


def output_collisions(df: DataFrame, source: str = "source_path", output: str = "output", skip: str = "skip_reason") -> DataFrame:
    """Outputs that more than one source would still write. Rows that are skipped write nothing."""
    return (
        df.filter(F.col(skip).isNull())
        .groupBy(F.lower(F.col(output)).alias("output_key"))
        .agg(F.count_distinct(source).alias("sources"), F.min(source).alias("first_source"))
        .filter("sources > 1")
    )


# Options of a batch. "ratio" None means the codec's default.
DEFAULT_OPTIONS = {
    "codec": "hevc", "container": "mkv", "mode": "smart", "ratio": None, "min_kbps": 250, "max_kbps": 0,
    "copy_subtitles": True, "two_pass": False, "two_pass_supported": True,
}


def plan_batch(
    media: DataFrame, options: dict[str, object] | None = None, *, source: str = "source_id", sidecars: DataFrame | None = None
) -> DataFrame:
    """Bind options to probed media; anything that breaks a rule becomes a skipped row, never a failed batch.

    ``media``: ``source_path, output, video_bitrate_bps, subtitle_codecs`` and a
    nullable ``probe_error``. Any option may instead be a column of ``media``.
    """
    rows = media
    for name, value in (DEFAULT_OPTIONS | (options or {})).items():
        if name not in media.columns:
            rows = rows.withColumn(name, F.lit(value).cast("double") if name == "ratio" else F.lit(value))
    bad = bitmap_subtitle_violation("subtitle_codecs", "container", "copy_subtitles")
    reason = (
        F.when(F.col("probe_error").isNotNull(), F.col("probe_error"))
        .when(F.lower("output") == F.lower("source_path"), F.lit("output path matches the input path"))
        .when(F.col("two_pass") & ~F.col("two_pass_supported"), F.lit("encoder does not support two-pass"))
        .when(bad.isNotNull(), F.concat(F.lit("MP4 cannot carry bitmap subtitles: "), bad))
    )
    fixed = F.col("mode") == "fixed_bitrate"
    goal = F.when(fixed, target_bitrate("video_bitrate_bps", "codec", "min_kbps", "max_kbps", "ratio")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("skip_reason", reason)
    rows = rows.withColumn("target_bps", F.when(F.col("skip_reason").isNull(), goal).otherwise(F.lit(0).cast("long")))
    if sidecars is not None:
        found = sidecars.groupBy(F.col("video_id").alias(source)).agg(F.count(F.lit(1)).alias("sidecars"))
        rows = rows.join(found, source, "left")
        has = F.col("skip_reason").isNull() & (F.col("sidecars") > 0)
        rows = rows.withColumn("warning", F.when(has, F.concat(F.lit("will copy "), F.col("sidecars"), F.lit(" external subtitle file(s)"))))
    return rows.select(
        source, "source_path", "output", "target_bps", "skip_reason", *(["warning"] if sidecars is not None else [])
    )


def _eligible() -> Column:
    # Skips that an analysis chose on purpose.
    wanted = ("smart_analysis", "smart_analysis_decision", "smart_predicted_oversize")
    return (
        F.col("skipped")
        & ~F.coalesce(F.col("needs_decision"), F.lit(False))
        & F.col("skip_origin").isin(*wanted)
        & F.col("skip_reason").isNull()
        & F.col("skipped_output_outcome").isNull()
    )


def skip_groups(results: DataFrame) -> DataFrame:
    """Intentional analysis skips that still need handling, counted by policy (copy / ask / ignore)."""
    return results.filter(_eligible()).groupBy("policy").agg(
        F.count(F.lit(1)).alias("items"), F.sum("source_bytes").cast("long").alias("source_bytes")
    )


def split_leakage(cases: DataFrame, group: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(groups present in more than one split, cases per split)."""
    pairs = cases.groupBy(group, split).agg(F.count(F.lit(1)).alias("_c"))
    leaks = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("splits"), F.sum("_c").alias("cases")).filter("splits > 1")
    return leaks, pairs.groupBy(split).agg(F.sum("_c").alias("cases"), F.count(F.lit(1)).alias("groups"))
