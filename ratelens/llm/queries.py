"""One query per numbered operator: the given tables mapped to its interface, and results back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.llm.archives import archive_round_trip
from ratelens.llm.credentials import credential_spans
from ratelens.llm.divergence import root_divergence
from ratelens.llm.language import subtitle_language
from ratelens.llm.leakage import passage_leaks
from ratelens.llm.licenses import MARKER, OTHER_IDF, TEMPLATES, THRESHOLD, license_scan
from ratelens.llm.mixing import mix_families
from ratelens.llm.near_logs import near_copies
from ratelens.llm.nearest_windows import top_windows
from ratelens.llm.private_spans import private_spans
from ratelens.llm.quality import BINS, SMOOTH, clip_quality
from ratelens.llm.toxicity import fit_toxicity, score_toxicity
from ratelens.llm.window_codes import ENTRIES, PARTS, ROUNDS, SCALE, window_codes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))) AS s FROM w WHERE len(ws) > 1
    UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON ways.x = reach.other
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@_query("op1_near_logs", _OP1_SQL)
def op1_near_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as logs; sets of two-word shingles."""
    logs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("log"))
    return near_copies(logs, words=2).withColumnRenamed("item_id", "doc_id")


_OP2_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS h FROM pages
), r AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first, CAST(unhex(h) AS BIT) AS bits FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_sum(list_transform(range(0, 5), lambda j: get_bit(bits, CAST(5 * k + j AS INT)) << (4 - j))) AS INT),
    1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM r
"""


@_query("op2_probe_archives", _OP2_SQL)
def op2_probe_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as probe documents, their URLs as paths."""
    probes = _table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("source_id"), F.col("url").alias("path"), F.col("html").alias("probe")
    )
    return archive_round_trip(probes).drop("record_id").withColumnRenamed("source_id", "page_id")


_OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), runs AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT DISTINCT doc_id, item_id, i, runs.n FROM runs JOIN win USING (n, t)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query("op3_passage_leaks", _OP3_SQL)
def op3_passage_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as logs, benchmark items as evaluation cases; exact windows of ten words."""
    logs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("log"))
    cases = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("passage"))
    found = passage_leaks(logs, cases, window=10)
    return found.select(
        F.col("item_id").alias("doc_id"), "n_words", "n_hit", F.size("cases").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "cases"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query("op4_top_windows", _OP4_SQL)
def op4_top_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows' feature vectors; every fiftieth one is a query."""
    windows = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("window_id"), F.col("embedding").alias("features")
    )
    return top_windows(windows, windows.where("window_id % 50 = 0")).withColumnRenamed("window_id", "vec_id")


_OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), src AS (
  SELECT *, 1 + CAST(place % 3 AS BIGINT) AS w FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
      row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM sized GROUP BY source)
), filling AS (
  SELECT *, 3 * source_size AS most,
    coalesce(sum(3 * source_size) OVER o, 0)::DOUBLE AS capped, coalesce(sum(w) OVER o, 0)::DOUBLE AS gone,
    (SELECT sum(source_size) FROM src)::DOUBLE AS total, (SELECT sum(w) FROM src)::DOUBLE AS ws
  FROM src WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lev AS (
  SELECT min_by((total - capped) / (ws - gone), gone) AS level FROM filling
  WHERE most >= (total - capped) / (ws - gone) * w
), target AS (
  SELECT src.*, least((3 * source_size)::DOUBLE, w * (SELECT coalesce(level, 0) FROM lev)) AS target FROM src
), house AS (
  SELECT total, block, (total + block // 2) // block AS seats FROM (
    SELECT total, greatest(1, (total + 1048575) // 1048576) AS block FROM (
      SELECT CAST(coalesce(sum(source_size), 0) AS BIGINT) AS total FROM src))
), won AS (
  SELECT place, count(*) AS quota FROM (
    SELECT place, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, place) AS r FROM (
      SELECT place, target,
        unnest(range(0, CAST(ceil(seats * target / (SELECT sum(target) FROM target) * 1.1) AS BIGINT) + 10)) AS s
      FROM target, house WHERE target > 0)) WHERE r <= (SELECT seats FROM house) GROUP BY place
), plan AS (
  SELECT target.*, least(coalesce(quota, 0) * (SELECT block FROM house), 3 * source_size) AS words
  FROM target LEFT JOIN won USING (place)
), laid AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source
      ORDER BY md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE
    words // source_size * size + greatest(0, least(size, words % source_size - start)) END AS BIGINT) AS taken
FROM laid JOIN plan ON laid.source IS NOT DISTINCT FROM plan.source
"""


@_query("op5_mix_families", _OP5_SQL)
def op5_mix_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as logs, their sources as families."""
    logs = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("family"), F.col("text").alias("log")
    )
    return mix_families(logs).select(
        F.col("item_id").alias("doc_id"), "size", F.col("family_size").alias("source_size"), "target", "taken"
    )


def _held_out(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


@_query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts; the model learns from labelled ones that are not held out."""
    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    marks = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), "toxic")
    model = fit_toxicity(texts, marks.where(~_held_out("item_id")))
    scored = score_toxicity(texts, model).withColumnRenamed("item_id", "doc_id")
    return scored.select(
        "doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _license_sql() -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())
    words = "regexp_extract_all(lower({}), '[a-z0-9]+')"
    return f"""
WITH tpl(license, txt) AS (VALUES {values}),
tw AS (SELECT license, w, count(*) AS n FROM (SELECT license, unnest({words.format('txt')}) AS w FROM tpl) GROUP BY 1, 2),
f AS (
  SELECT doc_id, text AS content, doc_id % 64 = 0 AS is_license,
    concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), CAST(doc_id // 64 AS VARCHAR)) AS folder,
    CASE WHEN doc_id % 64 = 0 THEN 'LICENSE' ELSE concat(doc_id, '.txt') END AS name FROM documents
), held AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct({words.format('content')})) AS w FROM f)
  WHERE w IN (SELECT w FROM tw) GROUP BY w
), idf AS (
  SELECT w, ln((1 + (SELECT count(*) FROM f)) / (1 + coalesce(max(held.n), 0))) + 0.1 AS idf FROM tw LEFT JOIN held USING (w) GROUP BY w
), shares AS (
  SELECT license, w, tw.n * idf / sqrt(sum((tw.n * idf) ** 2) OVER (PARTITION BY license)) AS share FROM tw JOIN idf USING (w)
), lines AS (
  SELECT doc_id, i AS unit, l AS line FROM (
    SELECT doc_id, unnest(string_split(content, chr(10))) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM f)
  WHERE regexp_matches(l, '{MARKER}')
  UNION ALL SELECT doc_id, 0, content FROM f WHERE is_license AND content IS NOT NULL
), terms AS (
  SELECT doc_id, unit, w, count(*) * coalesce(max(idf), {OTHER_IDF}) AS weight
  FROM (SELECT doc_id, unit, unnest({words.format('line')}) AS w FROM lines) LEFT JOIN idf USING (w) GROUP BY 1, 2, 3
), scored AS (
  SELECT doc_id, license, round(dot / sqrt(square), 6) AS score
  FROM (SELECT doc_id, unit, license, sum(weight * share) AS dot FROM terms JOIN shares USING (w) GROUP BY 1, 2, 3)
  JOIN (SELECT doc_id, unit, sum(weight * weight) AS square FROM terms GROUP BY 1, 2) USING (doc_id, unit)
), own AS (
  SELECT doc_id, license, score FROM scored WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1
), above AS (
  SELECT folder, license FROM own JOIN f USING (doc_id) WHERE is_license
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, doc_id) = 1
)
SELECT concat_ws('/', f.folder, name) AS path, f.doc_id, own.license AS own_license, own.score,
  above.license AS inherited_license, CASE WHEN above.license IS NOT NULL THEN f.folder END AS inherited_from,
  coalesce(own.license, above.license) AS license
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN above ON above.folder = f.folder
"""


@_query("op7_license_scan", _license_sql())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the folders source/lang/(64 documents); the first of a folder is its licence file."""
    name = F.when(F.col("doc_id") % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.expr("doc_id DIV 64").cast("string"))
    documents = _table(spark, sf_dir, "documents")
    files = documents.select("doc_id", F.concat_ws("/", folder, name).alias("path"), F.col("text").alias("content"))
    found = license_scan(files).dropDuplicates(["path"])
    return files.select("doc_id", "path").join(found, "path")


@_query("op8_subtitle_language")
def op8_subtitle_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sidecar subtitles; languages are learned from those that are not held out."""
    subtitles = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("subtitle_id"), F.col("text").alias("subtitle"), "lang"
    )
    known = subtitles.where(~_held_out("subtitle_id"))
    found = subtitle_language(subtitles.drop("lang"), known).withColumnRenamed("subtitle_id", "doc_id")
    return found.withColumn("held_out", F.coalesce(_held_out("doc_id"), F.lit(False)))


def _quality_sql() -> str:
    values = {
        "symbols": r"""len(regexp_extract_all(t, '[^\p{L}\p{N}\s.,;:!?''"()-]')) / sz""",
        "repeats": "1 - len(list_distinct(ws))::DOUBLE / len(ws)",
        "capitals": r"len(regexp_extract_all(t, '\p{Lu}')) / sz",
        "digits": r"len(regexp_extract_all(t, '\p{N}')) / sz",
        "word_length": "sz / len(ws)",
        "lines": "1 - len(list_distinct(ls))::DOUBLE / len(ls)",
    }

    def bin_of(name: str) -> str:
        steps = " ".join(f"WHEN {name} <= {edge}::DOUBLE THEN {k}" for k, edge in enumerate(BINS[name]))
        return f"CASE {steps} ELSE {len(BINS[name])} END AS b_{name}"

    all_bins = ", ".join(f"('{name}', {k})" for name, edges in BINS.items() for k in range(len(edges) + 1))
    long = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS p, b_{name} AS b FROM binned" for name in BINS)
    # CRC-32 of the id's digits, bit by bit.
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), "
        "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    )

    def strength(rates: str, mean: str) -> str:
        """Pseudo-marks by moments, as one scalar."""
        return (
            f"(SELECT CASE WHEN within IS NULL OR within = 0 THEN 1e3 WHEN weight - within = 0 OR (seen - within) / (weight - within) <= 0 THEN 1e3 "
            f"ELSE least(1e3, greatest(1, (1 - (seen - within) / (weight - within)) / ((seen - within) / (weight - within)))) END FROM ("
            f"SELECT sum((k - n * {mean}) ** 2 / n) AS seen, sum({mean} * (1 - {mean})) AS within, sum(n * ({mean} * (1 - {mean}))) AS weight FROM {rates} WHERE n > 1))"
        )

    return f"""
WITH d AS (SELECT doc_id, source AS root, lang AS folder, coalesce(text, '') AS t FROM documents),
p AS (SELECT *, greatest(length(t), 1)::DOUBLE AS sz, string_split_regex(trim(t), '\\s+') AS ws, string_split(t, chr(10)) AS ls FROM d),
v AS (SELECT doc_id, root, folder, {', '.join(f'{expr} AS {name}' for name, expr in values.items())} FROM p),
binned AS (SELECT doc_id, root, folder, {', '.join(map(bin_of, BINS))} FROM v),
long AS ({long}),
known AS (SELECT doc_id, max(quality) AS good FROM labels WHERE {crc} % 5 <> 0 AND quality IS NOT NULL GROUP BY 1),
counts AS (SELECT p, b, sum(good) AS g, sum(1 - good) AS h FROM long JOIN known USING (doc_id) GROUP BY 1, 2),
cells AS (SELECT a.p, a.b, coalesce(g, 0) AS g, coalesce(h, 0) AS h FROM (VALUES {all_bins}) a(p, b) LEFT JOIN counts USING (p, b)),
ev AS (
  SELECT p, b, ln((g + {SMOOTH}::DOUBLE) / (sum(g) OVER w + count(*) OVER w * {SMOOTH}::DOUBLE)
    / ((h + {SMOOTH}::DOUBLE) / (sum(h) OVER w + count(*) OVER w * {SMOOTH}::DOUBLE))) AS e FROM cells WINDOW w AS (PARTITION BY p)
), own AS (SELECT doc_id, sum(e) AS evidence FROM long JOIN ev USING (p, b) GROUP BY 1),
marked AS (SELECT root, folder, good FROM binned JOIN known USING (doc_id)),
total AS (SELECT CASE WHEN count(*) = 0 THEN 0.5::DOUBLE ELSE (sum(good) + 0.5::DOUBLE) / (count(*) + 1) END AS rate FROM marked),
r0 AS (SELECT root, count(*) AS n, sum(good) AS k, (SELECT rate FROM total) AS m FROM marked GROUP BY 1),
r1 AS (SELECT root, (k + s * m) / (n + s) AS root_rate FROM r0, (SELECT {strength('r0', 'm')} AS s)),
f0 AS (
  SELECT a.root, a.folder, n, k, root_rate AS m FROM (SELECT root, folder, count(*) AS n, sum(good) AS k FROM marked GROUP BY 1, 2) a
  JOIN r1 ON a.root IS NOT DISTINCT FROM r1.root
), f1 AS (SELECT root, folder, (k + s * m) / (n + s) AS folder_rate FROM f0, (SELECT {strength('f0', 'm')} AS s)),
out AS (
  SELECT doc_id, evidence, coalesce(root_rate, rate) AS root_rate, coalesce(folder_rate, root_rate, rate) AS folder_rate
  FROM binned JOIN own USING (doc_id) CROSS JOIN total LEFT JOIN r1 ON binned.root IS NOT DISTINCT FROM r1.root
  LEFT JOIN f1 ON binned.root IS NOT DISTINCT FROM f1.root AND binned.folder IS NOT DISTINCT FROM f1.folder
), scored AS (SELECT *, 1 / (1 + exp(-(ln(folder_rate / (1 - folder_rate)) + evidence))) AS score FROM out)
SELECT doc_id, round(evidence, 8) AS evidence, round(root_rate, 8) AS root_rate, round(folder_rate, 8) AS folder_rate,
  round(score, 8) AS score, score >= 0.5 AS kept, {crc} % 5 = 0 AS held_out FROM scored
"""


@_query("op9_clip_quality", _quality_sql())
def op9_clip_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as logs, sources as roots, languages as folders; marks of documents that are not held out."""
    logs = _table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("log"), F.col("source").alias("root"), F.col("lang").alias("dir")
    )
    marks = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("good"))
    found = clip_quality(logs, marks.where(~_held_out("item_id"))).withColumnRenamed("item_id", "doc_id")
    rounded = {c: F.round(c, 8) for c in ("evidence", "root_rate", "folder_rate", "score")}
    return found.withColumns(rounded).withColumn("held_out", F.coalesce(_held_out("doc_id"), F.lit(False)))


@_query("op10_credentials")
def op10_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tool logs."""
    logs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("log"))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "format")

    def joined(some):
        return F.array_join(
            F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return credential_spans(logs).select(
        F.col("item_id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )


def _codes_sql() -> str:
    def nearest(book: str) -> str:
        """Per part: squared distance and entry in one number, the nearest and lowest one."""
        return (
            f"SELECT row, x.n, x.part, any_value(x.label) AS label, any_value(x.x) AS x, any_value(x.vec_id) AS vec_id, "
            f"min(CAST(list_dot_product(x.x, x.x) - 2 * list_dot_product(x.x, b.x) + list_dot_product(b.x, b.x) AS BIGINT) * {ENTRIES} + entry) AS best "
            f"FROM parts x JOIN {book} b USING (n, part) GROUP BY 1, 2, 3"
        )

    rounds = ""
    for r in range(ROUNDS):
        rounds += f""", near{r} AS MATERIALIZED ({nearest(f'book{r}')}),
sums{r} AS (
  SELECT n, part, best % {ENTRIES} AS entry, place, CAST(sum(x[place]) AS BIGINT) AS s, count(*) AS c
  FROM (SELECT n, part, best, x, unnest(range(1, len(x) + 1)) AS place FROM near{r}) GROUP BY 1, 2, 3, 4
), mean{r} AS (
  SELECT n, part, entry, list(CAST((s - (s % c + c) % c) // c AS DOUBLE) ORDER BY place) AS x FROM sums{r} GROUP BY 1, 2, 3
), book{r + 1} AS MATERIALIZED (
  SELECT n, part, entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m USING (n, part, entry)
)"""
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, label, len(embedding) AS n,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, vec_id, label, n, part, v[part * n // {PARTS} + 1 : (part + 1) * n // {PARTS}] AS x
  FROM v, (SELECT unnest(range(0, {PARTS})) AS part)
), first AS (
  SELECT n, vec_id, v, row_number() OVER (PARTITION BY n ORDER BY vec_id NULLS LAST) - 1 AS entry
  FROM (SELECT n, vec_id, min(v) AS v FROM v GROUP BY n, vec_id) QUALIFY entry < {ENTRIES}
), book0 AS MATERIALIZED (
  SELECT n, part, entry, v[part * n // {PARTS} + 1 : (part + 1) * n // {PARTS}] AS x
  FROM first, (SELECT unnest(range(0, {PARTS})) AS part)
){rounds}, last AS ({nearest(f'book{ROUNDS}')}),
hashed AS (
  SELECT n, sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS h
  FROM book{ROUNDS} GROUP BY n
), coded AS (
  SELECT row, n, any_value(vec_id) AS vec_id, any_value(label) AS label,
    string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
  FROM last GROUP BY row, n
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN hashed USING (n)
"""


@_query("op11_window_codes", _codes_sql())
def op11_window_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows' feature vectors, their labels as pools."""
    windows = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("window_id"), F.col("embedding").alias("features"), F.col("label").alias("pool")
    )
    return window_codes(windows).select(
        F.col("window_id").alias("vec_id"), "code", "error", F.col("pool_error").alias("label_error"), "codebooks_sha256"
    )


_OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
t AS MATERIALIZED (SELECT row, lang, source, unnest(w) AS term FROM d),
keep AS MATERIALIZED (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 30),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM t JOIN keep USING (lang, term) GROUP BY 1, 2, 3),
nl AS (SELECT lang, term, sum(c) AS c FROM n GROUP BY 1, 2),
v AS (SELECT lang, count(*) AS v, sum(c) AS total FROM nl GROUP BY 1),
q AS MATERIALIZED (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (v.total + 5 * v.v) AS q FROM nl JOIN v USING (lang)
), gs AS (
  SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(s.total, 0) AS total FROM g LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(c) AS total FROM n GROUP BY 1, 2) s ON s.lang = g.lang AND s.source = g.source
), p AS MATERIALIZED (
  SELECT gs.lang, gs.source, keep.term, coalesce(n.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(n.c, 0) + 5)) // (gs.total + 5 * gs.v) AS p
  FROM gs JOIN keep ON keep.lang = gs.lang LEFT JOIN n ON n.lang = gs.lang AND n.source = gs.source AND n.term = keep.term
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS i, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY 1, 2, 3) z
      ON z.lang = a.lang AND z.s = a.source AND z.i = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p.p - q.q FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q)
) WHERE part = 'pair' OR rank <= 50
"""


@_query("op12_root_divergence", _OP12_SQL)
def op12_root_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sidecar subtitles, their sources as roots."""
    subtitles = _table(spark, sf_dir, "documents").select(
        F.col("text").alias("subtitle"), F.col("lang").alias("language"), F.col("source").alias("root")
    )
    return root_divergence(subtitles).withColumnsRenamed({"language": "lang", "root": "source"})


@_query("op13_private_spans")
def op13_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tool logs."""
    logs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("log"))
    spans = F.col("spans")

    def joined(some):
        return F.array_join(
            F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return private_spans(logs).select(
        F.col("item_id").alias("doc_id"), count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"] != "context")), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def llm_queries() -> dict[str, Query]:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
