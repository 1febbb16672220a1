"""Licences of catalog files: TF-IDF cosine of headers and licence files, then inheritance from folders.

Headers are lines with a marker word. They, and whole licence files, become
sparse vectors over words; the nearest template above a threshold names the
licence. Whole licence files are also compared with full licence texts, and SPDX
tags are read as they stand. A file without a licence of its own takes that of the nearest folder
above it that holds a licensed licence file. All steps are joins and
aggregations of DataFrames.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names and short forms of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0 Creative Commons Attribution",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Released under the ISC License",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v 2.0",
    "Proprietary": "Copyright All rights reserved",
}
#: Usual titles and headers besides the templates: one counts only where a line has all of its words.
FORMS = (
    ("Apache-2.0", "Apache License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal License"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-2.0", "GNU General Public License version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("GPL-3.0", "GNU General Public License version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
#: Full texts, one file per licence.
TEXTS = Path(__file__).with_name("license_texts")
#: Cosine that a licence file needs to a full text; common words weigh little there, so other prose stays far below.
TEXT_THRESHOLD = 0.8
#: An SPDX tag names its licence itself; the first known identifier of an expression counts.
SPDX = r"(?i)spdx-license-identifier:(.*)"
#: A title whose version stands on the next line is one line.
_SPLIT_TITLE = r"(?i)(licen[cs]e)[ \t]*\r?\n[ \t]*(version\b)"
#: A header is a line with one of these words.
MARKER = r"(?i)\b(licen[cs]ed?|licen[cs]es|copyright|copyrighted|spdx|dedicated|reserved)\b"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|copyright)(\.[a-z]+)?$"
THRESHOLD = 0.7
#: Inverse document frequency of a word that no template has.
OTHER_IDF = 1.0


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _counts(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for word in re.findall("[a-z0-9]+", text.lower()):
        out[word] = out.get(word, 0) + 1
    return out


def _template_words() -> dict[str, dict[str, int]]:
    """Word counts of each template."""
    return {name: _counts(text) for name, text in TEMPLATES.items()}


def template_idf(files: DataFrame, text: str = "content") -> dict[str, float]:
    """ln((1 + files) / (1 + files with the word)) + 0.1 of every template word, over all files."""
    vocabulary = sorted({w for own in _template_words().values() for w in own})
    held = F.array_intersect(_words(F.col(text)), F.array(*map(F.lit, vocabulary)))
    rows = (
        files.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(held, F.array().cast("array<string>")))).alias("w"))
        .groupBy("w").count().collect()  # one row per template word
    )
    counts = {r["w"]: r["count"] for r in rows}
    total = counts.get("", 0)
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 0.1 for w in vocabulary}


def _forms(spark, idf: dict[str, float]) -> DataFrame:
    """(license, form, least, w, share) of the templates, which need no word, and of ``FORMS``, which need all theirs."""
    forms = [(name, text, 0) for name, text in TEMPLATES.items()]
    forms += [(name, text, len(set(re.findall("[a-z0-9]+", text.lower())))) for name, text in FORMS]
    rows = []
    for k, (name, text, least) in enumerate(forms):
        own = _counts(text)
        weight = {w: n * idf.get(w, OTHER_IDF) for w, n in own.items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        rows += [(name, k, least, w, x / norm) for w, x in weight.items()]
    return spark.createDataFrame(rows, "license string, form int, least int, w string, share double")


def full_texts() -> dict[str, str]:
    return {p.name.removesuffix(".txt"): p.read_text("utf-8") for p in sorted(TEXTS.glob("*.txt"))}


def _texts(spark) -> tuple[DataFrame, DataFrame]:
    """(w, text_idf) over the full texts, and their (license, w, share)."""
    counts = {name: _counts(text) for name, text in full_texts().items()}
    held: dict[str, int] = {}
    for own in counts.values():
        for w in own:
            held[w] = held.get(w, 0) + 1
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 0.1 for w, n in held.items()}
    rows = []
    for name, own in counts.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in own.items()))
        rows += [(name, w, n * idf[w] / norm) for w, n in own.items()]
    weights = spark.createDataFrame(sorted(idf.items()), "w string, text_idf double")
    return weights, spark.createDataFrame(rows, "license string, w string, share double")


def _spdx(lines: Column) -> Column:
    """The first known identifier of the first SPDX tag that has one."""
    known = sorted({*TEMPLATES, *(name for name, _ in FORMS)} - {"Proprietary"})
    names = {f"{name}{end}".lower(): name for name in known for end in ("", "-only", "-or-later", "+")}
    by_name = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    ids = F.flatten(F.transform(lines, lambda line: F.split(F.lower(F.regexp_extract(line, SPDX, 1)), r"[^a-z0-9.+-]+")))
    found = F.filter(F.transform(ids, lambda i: by_name[i]), lambda name: name.isNotNull())
    return F.try_element_at(found, F.lit(1))


def own_licenses(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, license, score): the full text that a licence file reaches, else each file's best header.

    Headers are SPDX tags, with score 1, and the templates and forms that reach ``THRESHOLD``.
    """
    spark = files.sparkSession
    idf = template_idf(files, text)
    name = F.element_at(F.split(F.col(path), "/"), -1)
    whole = name.rlike(LICENSE_FILE)
    joined = F.when(F.col(text).rlike(_SPLIT_TITLE), F.regexp_replace(F.col(text), _SPLIT_TITLE, "$1 $2")).otherwise(F.col(text))
    marked = F.filter(F.split(joined, "\n"), lambda line: line.rlike(MARKER))
    lines = F.filter(marked, lambda line: ~line.rlike(SPDX))
    units = F.when(whole, F.concat(lines, F.array(F.col(text)))).otherwise(lines)
    given = files.where(F.col(path).isNotNull() & F.col(text).isNotNull())
    weights = spark.createDataFrame(sorted(idf.items()), "w string, idf double")
    terms = (
        given.select(F.col(path).alias("path"), (F.size(units) - 1).alias("last"), whole.alias("whole"), F.posexplode(units).alias("unit", "line"))
        .select("path", "unit", (F.col("whole") & (F.col("unit") == F.col("last"))).alias("full"), F.explode(_words(F.col("line"))).alias("w"))
        .groupBy("path", "unit", "full", "w").agg(F.count("*").alias("n"))
        .join(F.broadcast(weights), "w", "left")  # the templates' words
        .withColumn("weight", F.col("n") * F.coalesce("idf", F.lit(OTHER_IDF)))
    )
    norms = terms.groupBy("path", "unit").agg(F.sum(F.col("weight") * F.col("weight")).alias("square"))
    dots = (
        terms.join(F.broadcast(_forms(spark, idf)), "w")  # the templates themselves
        .groupBy("path", "unit", "license", "form", "least")
        .agg(F.sum(F.col("weight") * F.col("share")).alias("dot"), F.count("*").alias("held"))
        .where("held >= least")
    )
    scored = dots.join(norms, ["path", "unit"]).withColumn("score", F.round(F.col("dot") / F.sqrt("square"), 6))
    headers = scored.where(F.col("score") >= THRESHOLD).select("path", F.lit(1).alias("rank"), "score", "license")
    tags = given.where(F.col(text).rlike(SPDX)).select(
        F.col(path).alias("path"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"), _spdx(marked).alias("license")
    )
    text_idf, texts = _texts(spark)
    full = (
        terms.where("full").select("path", "unit", "w", "n").join(F.broadcast(text_idf), "w", "left")  # the texts' words
        .withColumn("weight", F.col("n") * F.coalesce("text_idf", F.lit(OTHER_IDF)))
    )
    sizes = full.groupBy("path", "unit").agg(F.sum(F.col("weight") * F.col("weight")).alias("square"))
    whole_texts = (
        full.join(F.broadcast(texts), "w").groupBy("path", "unit", "license")  # the texts themselves
        .agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
        .join(sizes, ["path", "unit"]).withColumn("score", F.round(F.col("dot") / F.sqrt("square"), 6))
        .where(F.col("score") >= TEXT_THRESHOLD).select("path", F.lit(0).alias("rank"), "score", "license")
    )
    return (
        headers.unionByName(tags.where("license IS NOT NULL")).unionByName(whole_texts)
        .groupBy("path")
        .agg(F.min(F.struct("rank", (-F.col("score")).alias("s"), "license")).alias("best"))
        .select("path", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"))
    )


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def folder_licenses(own: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, above, inherited): for each of ``folders`` the nearest licensed folder at or above it."""
    best = Window.partitionBy("above").orderBy(F.desc("score"), "path")
    licensed = (
        own.where(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE))
        .withColumn("above", _folder(F.col("path")))
        .withColumn("r", F.row_number().over(best)).where("r = 1")
        .select("above", F.col("license").alias("inherited"))
    )
    parts = F.split("folder", "/")
    ancestors = F.concat(
        F.array(F.lit("")),
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )
    return (
        folders.withColumn("above", F.explode(F.array_distinct(ancestors)))
        .join(licensed, "above")
        .groupBy("folder")
        .agg(F.max_by(F.struct("above", "inherited"), F.length("above")).alias("found"))
        .select("folder", "found.above", "found.inherited")
    )


def license_scan(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, own_license, score, inherited_license, inherited_from, license) of catalog files.

    ``own_license`` comes from the file's headers, or for a licence file
    (``LICENSE``, ``COPYING``, ``NOTICE`` ...) from its whole text as well: a full
    licence text that it reaches, else an SPDX tag or the template or form with the
    highest cosine, ties by name. ``license`` is the file's own,
    else that of the nearest folder at or above the file with a licensed licence
    file; of several in one folder the best match counts, ties by path. One row
    per row of ``files``; rows with equal paths share the best result. Null texts
    and paths have no licence of their own, a null path inherits nothing, and
    empty tables give an empty result. Other columns are not read.
    """
    own = own_licenses(files, path, text)
    rows = files.select(F.col(path).alias("path")).withColumn("folder", _folder(F.col("path")))
    above = folder_licenses(own, rows.select("folder").where("folder IS NOT NULL").distinct())
    return (
        rows.join(own.withColumnRenamed("license", "own_license"), "path", "left")
        .join(above, "folder", "left")
        .select(
            F.col("path").alias(path), "own_license", "score",
            F.col("inherited").alias("inherited_license"), F.col("above").alias("inherited_from"),
            F.coalesce("own_license", "inherited").alias("license"),
        )
    )
