"""Run a Spark query and its DuckDB oracle and compare names, types and values."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.9g}" if value else "0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def _kind(name):
    name = name.lower()
    if name in ("tinyint", "smallint", "int", "integer", "bigint", "hugeint", "long"):
        return name.replace("integer", "int").replace("long", "bigint")
    if name.startswith("varchar") or name == "string":
        return "string"
    return name


def compare(spark, con, run, sql, sf_dir):
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: _kind(str(d[1])) for d in rel.description}
    rows = rel.fetchall()
    if sorted(names) != cols:
        return f"columns differ: spark {cols} oracle {sorted(names)}"
    index = [names.index(c) for c in cols]
    want = sorted(tuple(_cell(r[i]) for i in index) for r in rows)
    spark_types = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    off = {c: (spark_types[c], types[c]) for c in cols if spark_types[c] != types[c]}
    if len(got) != len(want):
        return f"row counts differ: spark {len(got)} oracle {len(want)}; types {off}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {cols} {bad[0]}; types {off}"
    if off:
        return f"types differ: {off}"
    return f"ok {len(got)}"
