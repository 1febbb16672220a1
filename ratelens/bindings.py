"""Views that give the test tables the schemas the operators expect.

Each binding is stated once, as column expressions that Spark and DuckDB read
alike. :func:`bind` builds it as a DataFrame, :func:`binding_sql` as SQL text for
the oracle. The two frame bindings need a running frame number; Spark derives it
with :func:`ratelens.plans.ordered.position`, the oracle with ``row_number``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.plans.ordered import ordered, value_chunk
from ratelens.session import spread


@dataclass(frozen=True)
class Binding:
    table: str
    columns: dict[str, str]
    group_by: tuple[str, ...] = ()
    where: str | None = None
    helpers: dict[str, str] = field(default_factory=dict)
    #: Almost as many groups as rows: nothing shrinks before the shuffle.
    fine: bool = False

    def sql(self) -> str:
        select = ", ".join(f"{expr} AS {name}" for name, expr in self.columns.items())
        inner = self.table
        if self.helpers:
            extra = ", ".join(f"{expr} AS {name}" for name, expr in self.helpers.items())
            inner = f"(SELECT *, {extra} FROM {self.table}) h"
        text = f"SELECT {select} FROM {inner}"
        if self.where:
            text += f" WHERE {self.where}"
        if self.group_by:
            text += f" GROUP BY {', '.join(self.group_by)}"
        return text

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, self.table)
        if self.where:
            df = df.where(self.where)
        for name, expr in self.helpers.items():
            df = df.withColumn(name, F.expr(expr))
        exprs = [F.expr(expr).alias(name) for name, expr in self.columns.items()]
        if self.fine:
            df = spread(df, *self.group_by)
        if self.group_by:
            return df.groupBy(*self.group_by).agg(*exprs).select(*self.columns)
        return df.select(*exprs)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

BINDINGS = {
    "observations": Binding(
        "lineitem",
        {
            "source_id": "l_suppkey",
            "window_id": "l_partkey",
            "si_p90": "max(l_extendedprice) / 1000",
            "ti_p90": "max(l_quantity)",
            "max_scene_score": "max(l_discount) * 1000",
            "start_sec": "CAST(l_partkey * 2 AS DOUBLE)",
            "duration_sec": "CAST(2 AS DOUBLE)",
        },
        group_by=("l_suppkey", "l_partkey"),
        fine=True,
    ),
    "sources": Binding(
        "orders",
        {
            "source_id": "o_orderkey",
            "source_bytes": "CAST(floor(o_totalprice * 1000) AS BIGINT)",
            "duration_sec": "CAST(20 + o_orderkey % 14000 AS DOUBLE)",
            "audio_bitrate_bps": "1000 * (o_custkey % 320)",
            "codec": "CASE WHEN o_orderstatus = 'F' THEN 'hevc' ELSE 'av1' END",
        },
    ),
    "trials": Binding(
        "lineitem",
        {
            "source_id": "l_suppkey",
            "bitrate_bps": "250000 * CAST(l_quantity AS BIGINT)",
            "window_id": "l_linenumber",
            "gate": "least(CAST(100 AS DOUBLE), 60 + l_quantity * 3 / 5 + 100 * max(l_tax))",
            "encoded_bytes": "CAST(floor(l_quantity * 156250 * (1 + 4 * max(l_discount))) AS BIGINT)",
            "duration_sec": "CAST(5 AS DOUBLE)",
        },
        group_by=("l_suppkey", "l_quantity", "l_linenumber"),
    ),
    "shot_candidates": Binding(
        "lineitem",
        {
            "title_id": "l_suppkey",
            "shot_idx": "l_linenumber",
            "cand_id": "cand",
            "frames": "60 * l_linenumber",
            "mean_vmaf": "80 + 3 * cand + 40 * max(l_tax)",
            "worst_1s_vmaf": "76 + 3 * cand + 40 * max(l_tax)",
            "bytes": "CAST(floor(min(l_extendedprice)) AS BIGINT) * (1 + cand)",
        },
        group_by=("l_suppkey", "l_linenumber", "cand"),
        helpers={"cand": "CAST(floor(l_quantity / 10) AS INT)"},
    ),
    "results": Binding(
        "orders",
        {
            "item_id": "o_orderkey",
            "outcome": "CASE o_orderpriority WHEN '1-URGENT' THEN 'success' WHEN '2-HIGH' THEN 'success' "
            "WHEN '3-MEDIUM' THEN 'failed' WHEN '4-NOT SPECIFIED' THEN 'skipped' ELSE 'needs_decision' END",
            "source_bytes": "CAST(floor(o_totalprice * 1000) AS BIGINT)",
            "output_bytes": "CAST(floor(o_totalprice * (300 + (o_custkey % 90) * 10)) AS BIGINT)",
        },
    ),
    "measurements": Binding(
        "orders",
        {
            "case_id": "o_orderkey",
            "family": "o_orderpriority",
            "split": "o_orderstatus",
            "group_id": "o_custkey",
            "analysis_wall_seconds": "CAST(1 + o_orderkey % 50 AS DOUBLE)",
            "final_encode_wall_seconds": "CASE WHEN o_orderkey % 11 > 0 THEN CAST(10 + o_custkey % 90 AS DOUBLE) END",
            "smart_passed": "o_orderkey % 3 > 0",
            "ground_truth_passed": "CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 4 > 0 END",
            "smart_size_blocked": "o_orderkey % 3 = 0",
            "full_encode_output_bytes": "CAST(floor(o_totalprice) AS BIGINT) + 1",
            "max_output_bytes": "CAST(150000 AS BIGINT)",
            "selected_bps": "CAST(1000 * (500 + o_custkey % 700) AS BIGINT)",
            "oracle_bps": "CASE WHEN o_orderkey % 5 > 0 THEN CAST(1000 * (450 + o_custkey % 600) AS BIGINT) END",
            "error": "CASE WHEN o_orderkey % 13 = 0 THEN 'runner failed' END",
        },
    ),
    "intervals": Binding(
        "events",
        {
            "source_id": "user_id",
            "window_id": "event_id",
            "start_sec": "CAST(event_id AS DOUBLE) / 2",
            "duration_sec": "value",
            "pool": "CASE event_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'holdout' ELSE 'reserve' END",
        },
    ),
    "videos": Binding(
        "part",
        {"id": "p_partkey", "dir": "p_brand", "stem": "concat('p', p_size)"},
        where="p_partkey % 2 = 0",
    ),
    "subtitles": Binding(
        "part",
        {"id": "p_partkey", "dir": "p_brand", "name": "concat('p', p_size, '.', lower(p_type), '.srt')"},
        where="p_partkey % 2 = 1",
    ),
    "phase_lines": Binding(
        "events",
        {
            "line_no": "event_id",
            "line": "concat('[smart phase] {\"phase\": \"', event_type, '\", \"seconds\": ', value, '}')",
        },
    ),
    "progress": Binding(
        "events",
        {
            "item_id": "user_id",
            "seq": "event_id",
            "ts": "ts",
            "state": "CASE event_type WHEN 'view' THEN 'running_pass' WHEN 'click' THEN 'analyzing' "
            "WHEN 'signup' THEN 'waiting_analysis' WHEN 'error' THEN 'failed' ELSE 'validating' END",
            "percent": f"CAST({_K} AS DOUBLE)",
            "speed": "'1.5x'",
        },
    ),
    "probe_json": Binding(
        "orders",
        {
            "source_id": "o_orderkey",
            "probe": "concat('{\"format\":{\"duration\":\"', 20 + o_orderkey % 14000, '\",\"bit_rate\":\"', "
            "CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey * 1000 END, "
            "'\"},\"streams\":[{\"codec_type\":\"video\",\"codec_name\":\"h264\",\"avg_frame_rate\":\"', "
            "CASE WHEN o_orderkey % 3 = 0 THEN '0/0' ELSE '30000/1001' END, "
            "'\",\"r_frame_rate\":\"25/1\",\"pix_fmt\":\"yuv420p10le\"},', "
            "'{\"codec_type\":\"audio\",\"codec_name\":\"aac\",\"bit_rate\":\"128000\"},"
            "{\"codec_type\":\"subtitle\",\"codec_name\":\"', "
            "CASE WHEN o_orderkey % 5 = 0 THEN 'xsub' ELSE 'subrip' END, '\"}]}')",
        },
    ),
}

_FRAME_SQL = {
    "frame_scores": """SELECT user_id AS clip_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_no,
        greatest(CAST(0 AS DOUBLE), 100 - value / 5) AS score, CAST(8 + user_id % 5 AS INT) AS fps FROM events""",
    "frame_metrics": """SELECT user_id AS clip_id, CAST(row_number() OVER w - 1 AS BIGINT) AS frame_no,
        least(value, CAST(200 AS DOUBLE)) AS si, abs(value - lag(value, 1, value) OVER w) AS ti,
        CAST(k * 2 AS DOUBLE) AS luma,
        CASE WHEN event_type = 'error' THEN 10 + CAST(k AS DOUBLE) / 10 ELSE CAST(k AS DOUBLE) / 12 END AS scd_score
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
}


def _numbered_events(spark: SparkSession, sf_dir: str, *, with_before: bool = False) -> DataFrame:
    chunked = value_chunk(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    return ordered(
        chunked,
        ["user_id"],
        ["ts", "event_id"],
        running={"frame_no": ("sum", F.lit(1).cast("long"))},
        before={"_before": "value"} if with_before else None,
    )


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_events(spark, sf_dir).select(
        F.col("user_id").alias("clip_id"),
        "frame_no",
        F.greatest(F.lit(0.0), 100 - F.col("value") / 5).alias("score"),
        F.expr("CAST(8 + user_id % 5 AS INT)").alias("fps"),
    )


def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered_events(spark, sf_dir, with_before=True)
    k = F.expr(_K)
    return rows.select(
        F.col("user_id").alias("clip_id"),
        "frame_no",
        F.least(F.col("value"), F.lit(200.0)).alias("si"),
        F.abs(F.col("value") - F.coalesce("_before", "value")).alias("ti"),
        (k * 2).cast("double").alias("luma"),
        F.when(F.col("event_type") == "error", 10 + k.cast("double") / 10)
        .otherwise(k.cast("double") / 12)
        .alias("scd_score"),
    )


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "frame_scores":
        return frame_scores(spark, sf_dir)
    if name == "frame_metrics":
        return frame_metrics(spark, sf_dir)
    return BINDINGS[name].frame(spark, sf_dir)


def binding_sql(name: str) -> str:
    return _FRAME_SQL.get(name) or BINDINGS[name].sql()
