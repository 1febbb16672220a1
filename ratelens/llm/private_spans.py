"""Personal data in tool logs: fixed patterns, and identifiers that the same contexts lead to.

What the fixed patterns find are the seeds. The words around a seed are its
contexts: the word before, the two words before, the words on both sides. Contexts
and what stands in them make a graph, which is scored in rounds: a context is
trusted for a kind if enough different known entities of the kind stand in it and
most of its occurrences, over all logs, are such; a thing that no pattern knows is
accepted if the trusted contexts it stands in make it likely enough, and then
supports further contexts itself. Accepted identifiers are spans wherever they
occur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ratelens.llm.words import SPACED, buffers, hash_words, mix, slices
from ratelens.session import cut, spill

# The patterns of the kinds, in their order. Emails are found from their "@".
KINDS = ("email", "ip", "card", "phone")
CONTEXT = "context"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Different known entities that a context needs, and the share of its occurrences that they must make up.
SUPPORT = 3
TRUST = 0.6
#: Occurrences that count against every context.
PRIOR = 1
#: Likelihood from which an unknown thing is accepted.
ACCEPT = 0.8
ROUNDS = 5
#: Code points that an identifier has at least.
LEAST_LENGTH = 4
#: Bits that tell which contexts are worth counting; what they let through in excess is joined away.
FILTER_BITS = 1 << 22
SLICE = 4 << 20
_STRIP = "\"'`()[]{}<>,;:!?.*#$%&|=~^"

_MARK = np.zeros(256, bool)
_MARK[0x30:0x3A] = _MARK[0x40] = True
_NUMERIC = np.zeros(256, bool)
_NUMERIC[0x30:0x3A] = True
_NUMERIC[[ord(c) for c in "+()-./"]] = True
_WEIGHTS = [np.uint64(k) for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]


def _emails(log: str) -> Iterator[tuple[int, int]]:
    done, at = 0, log.find("@")
    while at >= 0:
        start = at
        while start > done and log[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(log, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = log.find("@", done)


def _luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(log: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind, by kind, then start."""
    found = [("email", *s) for s in _emails(log)]
    for m in _IP.finditer(log):
        parts = [p.lstrip("0") for p in m.groups()]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(log):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(log) if "+" in log else ():
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.lower().encode(), digest_size=8).digest(), signed=True)


class _Units:
    """The things that stand in contexts: words, and runs of numeric words as one, of a column of logs.

    ``first`` and ``last`` are their words, ``owner`` the log of each, ``marked``
    tells whether it has a digit or an "@"; ``contexts`` has one hash per template,
    0 where the log ends before. Words are hashed with A-Z lowered.
    """

    def __init__(self, column: pa.Array):
        data, offsets = buffers(column)
        self.hashes, bounds = hash_words(column, SPACED)
        self.offsets = offsets
        starts = np.zeros(len(data) + 1, bool)
        starts[offsets[:-1]] = True
        word = SPACED[data]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | starts[1:-1]
        end[:-1] &= ~word[1:] | starts[1:-1]
        self.begins, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        n = len(self.begins)
        owner = np.repeat(np.arange(len(column)), np.diff(bounds))

        def count(kind: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(kind[data])])
            return total[self.ends] - total[self.begins]

        marks = count(_MARK)
        numeric = (count(_NUMERIC) == self.ends - self.begins) & (marks > 0)
        opens = np.ones(n, bool)
        opens[1:] = ~(numeric[1:] & numeric[:-1] & (owner[1:] == owner[:-1]))
        self.first = np.flatnonzero(opens)
        self.last = np.append(self.first[1:], n)[: len(self.first)] - 1
        self.owner = owner[self.first]
        self.marked = marks[self.first] > 0
        low, high = bounds[self.owner], bounds[self.owner + 1]
        h = np.concatenate([self.hashes, np.zeros(2, np.uint64)])
        one, two, right = h[self.first - 1] * _WEIGHTS[0], h[self.first - 2] * _WEIGHTS[1], h[self.last + 1] * _WEIGHTS[2]
        has_one, has_two, has_right = self.first > low, self.first > low + 1, self.last + 1 < high
        self.contexts = [
            np.where(has, mix(value + np.uint64(k + 1)), np.uint64(0)).view(np.int64)
            for k, (has, value) in enumerate(
                [(has_one, one), (has_two, one + two), (has_one & has_right, one + right)]
            )
        ]
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.start = points[self.begins[self.first]] - points[offsets[self.owner]]
        self.end = points[self.ends[self.last]] - points[offsets[self.owner]]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_THINGS = pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("thing", pa.int64()), ("kind", pa.string()), ("contexts", pa.list_(pa.int64())),
]))
_THINGS_SQL = "array<struct<start:int,end:int,thing:long,kind:string,contexts:array<long>>>"


def _things(log: str, spans: list[tuple[str, int, int]], units: _Units, own: np.ndarray) -> list[tuple]:
    """(start, end, thing, kind, contexts) of the marked units ``own`` of a log.

    A unit that base spans of one kind touch is a known entity; one that spans of
    several kinds touch is none, and neither is one that is too short, but both
    count as occurrences of their contexts.
    """
    found = []
    by_start = sorted(spans, key=lambda s: s[1])
    at = 0
    for i in own:
        start, end = int(units.start[i]), int(units.end[i])
        while at < len(by_start) and by_start[at][2] <= start:
            at += 1
        touching, j = [], at
        while j < len(by_start) and by_start[j][1] < end:
            if by_start[j][2] > start:
                touching.append(by_start[j])
            j += 1
        contexts = [int(c[i]) for c in units.contexts if c[i]]
        if touching:
            known = len({s[0] for s in touching}) == 1
            kind, begin, stop = touching[0]
            found.append((begin, stop, _digest(log[begin:stop]) if known else None, kind if known else None, contexts))
            continue
        text = log[start:end]
        start += len(text) - len(text.lstrip(_STRIP))
        text = text.strip(_STRIP)
        usable = len(text) >= LEAST_LENGTH and any(c in "0123456789@" for c in text)
        found.append((start, start + len(text), _digest(text) if usable else None, None, contexts))
    return found


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logs -> (row, item, spans, things); ``row`` numbers the rows of all tasks."""
    row = TaskContext.get().partitionId() << 40
    names = ("start", "end", "thing", "kind", "contexts")
    for batch in batches:
        for part in slices(batch, "log", SLICE):
            units = _Units(part.column("log"))
            marked = np.flatnonzero(units.marked)
            bounds = np.searchsorted(units.owner[marked], np.arange(part.num_rows + 1))
            spans, things = [], []
            for k, log in enumerate(part.column("log").to_pylist()):
                own = marked[bounds[k] : bounds[k + 1]]
                base = base_spans(log) if log and len(own) else []  # each kind needs a digit or an "@"
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in base])
                things.append([dict(zip(names, t)) for t in _things(log, base, units, own)] if len(own) else [])
            rows = pa.array(np.arange(row, row + part.num_rows))
            row += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [rows, part.column("item"), pa.array(spans, _SPANS), pa.array(things, _THINGS)],
                names=["row", "item", "spans", "things"],
            )


def _plain_counts(filter_bits):
    """Logs -> (context, n): occurrences with an unmarked word, of contexts whose bit is set."""

    def over(batches):
        for batch in batches:
            for part in slices(batch, "log", SLICE):
                units = _Units(part.column("log"))
                plain = ~units.marked
                seen = np.concatenate([c[plain] for c in units.contexts])
                seen = seen[(seen != 0) & filter_bits.value[seen & (FILTER_BITS - 1)]]
                contexts, n = np.unique(seen, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(contexts), pa.array(n)], names=["context", "n"])

    return over


def _filter(contexts: DataFrame) -> np.ndarray:
    """One bit per context's place; at most ``FILTER_BITS`` / 32768 rows of 4 KB reach the driver."""
    bits = np.zeros(FILTER_BITS, bool)
    place = contexts.select((F.pmod("context", F.lit(FILTER_BITS)) + 1).alias("b"))
    rows = place.groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")
    )
    for bucket, packed in rows.collect():
        own = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        bits[(bucket - 1) * len(own) : bucket * len(own)] = own
    return bits


def _accepted(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """(thing, kind, score) of the unknown things that the rounds accept.

    ``edges``: (context, thing, kind, n), kind null for unknown things; ``totals``:
    (context, total).
    """
    seeds = edges.where("kind IS NOT NULL").select("thing", "kind").distinct().withColumn("score", F.lit(1.0))
    open_ = edges.where("kind IS NULL").select("context", "thing")
    known, accepted, before = seeds, None, None
    for _ in range(ROUNDS):
        hits = edges.drop("kind").join(known, "thing").groupBy("context", "kind").agg(
            F.sum("score").alias("support"), F.sum(F.col("score") * F.col("n")).alias("hits")
        )
        trust = F.round(F.col("hits") / (F.col("total") + PRIOR), 6).alias("trust")
        trusted = hits.join(totals, "context").where(F.col("support") >= SUPPORT - 1e-6)
        trusted = trusted.select("context", "kind", trust).where(F.col("trust") >= TRUST)
        score = F.round(1 - F.exp(F.sum(F.log(1 - F.col("trust")))), 6).alias("score")
        likely = open_.join(trusted, "context").groupBy("thing", "kind").agg(score).where(F.col("score") >= ACCEPT)
        best = likely.groupBy("thing").agg(F.max(F.struct("score", "kind")).alias("b"))
        accepted = cut(best.select("thing", "b.kind", "b.score"))
        now = accepted.agg(F.count("*"), F.sum(F.xxhash64("thing", "kind", "score").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, known = now, seeds.unionByName(accepted)
    return accepted


def private_spans(logs: DataFrame, item: str = "item_id", log: str = "log") -> DataFrame:
    """(item, spans): personal data in each whole log, as code points [start, end), with kind, likeness and score.

    Spans of the kinds ``email``, ``ip``, ``card`` and ``phone`` are exactly what
    their patterns find, by kind, then start; ``like`` is the kind and ``score`` 1.
    Spans of kind ``context`` follow by start: words with a digit or an "@", or
    runs of numeric words, of ``LEAST_LENGTH`` code points or more without the
    punctuation around them, that no pattern finds and that stand in trusted
    contexts. ``like`` is the kind whose contexts they are, ``score`` 1 - product
    of (1 - trust) over these. A context is a word before, two words before, or
    the words on both sides (white space splits words, A-Z counts as a-z); its
    trust for a kind is the share of known entities of the kind among its
    occurrences and ``PRIOR`` more, and it needs ``SUPPORT`` different ones.

    One row per row of ``logs``, repeated ones too. Null and empty logs have no
    spans; null ids are kept. An empty table gives an empty result. Other columns
    are not read.
    """
    rows = logs.select(F.col(item).alias("item"), F.col(log).cast("string").alias("log"))
    span = StructType.fromDDL("kind string, start int, end int")
    schema = StructType([
        StructField("row", LongType()), rows.schema["item"], StructField("spans", ArrayType(span)),
        *StructType.fromDDL(f"things {_THINGS_SQL}").fields,
    ])
    scanned = spill(rows.mapInArrow(_scanned, schema), "private-scan")
    things = scanned.select("row", F.explode("things").alias("t")).select("row", "t.*")
    graph = things.select("thing", "kind", F.explode("contexts").alias("context"))
    graph = spill(graph.groupBy("context", "thing").agg(F.max("kind").alias("kind"), F.count("*").alias("n")), "private-graph")
    wide = graph.where("thing IS NOT NULL").groupBy("context").count().where(F.col("count") >= SUPPORT).select("context")
    wide = spill(wide, "private-contexts")
    bits = logs.sparkSession.sparkContext.broadcast(_filter(wide))
    plain = rows.select("log").mapInArrow(_plain_counts(bits), "context long, n long")
    counts = plain.unionByName(graph.select("context", "n")).groupBy("context").agg(F.sum("n").alias("total"))
    totals = spill(counts.join(wide, "context", "left_semi"), "private-totals")
    edges = spill(graph.where("thing IS NOT NULL").join(wide, "context", "left_semi"), "private-edges")
    # A thing that is known somewhere is known everywhere.
    sure = edges.groupBy("thing").agg(F.max("kind").alias("kind"))
    edges = spill(edges.drop("kind").join(sure, "thing"), "private-edges")
    accepted = _accepted(edges, totals)
    extra = things.where("kind IS NULL AND thing IS NOT NULL").drop("kind", "contexts").join(accepted, "thing")
    extra = extra.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(
            "start", "end", F.lit(CONTEXT).alias("kind"), F.col("kind").alias("like"), "score"
        ))).alias("extra")
    )
    order = ("kind", "start", "end", "like", "score")
    base = F.transform("spans", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("like"), F.lit(1.0).alias("score")
    ))
    more = F.transform("extra", lambda s: F.struct(*[s[c].alias(c) for c in order]))
    spans = F.when(F.col("extra").isNull(), base).otherwise(F.concat(base, more))
    return scanned.select("row", "item", "spans").join(extra, "row", "left").select(F.col("item").alias(item), spans.alias("spans"))
