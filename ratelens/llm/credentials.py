"""Credentials in tool logs: fixed patterns, and formats inferred from what they find.

The patterns give labelled credentials. Values of one shape (the alphabets and
punctuation in them) and length are a format; those of a shape whose lengths
vary are one together. A format's values are read into a prefix tree over
character classes, and states are merged while their continuations are
statistically compatible (the Hoeffding test of grammar inference): only states
at the same place where the length is fixed, and beyond the first ``HEAD``
places any. So lengths and prefixes survive, and each state still counts its
characters. A shape that occurs without a label far more often than with one
(words, numbers, identifiers) is no format; such tokens teach the automaton of
ordinary ones.

Every candidate, also what remains of a run beside a pattern's span, is scored
by all automata. It is a span of kind ``format`` if some format makes it about as
likely as its own values, and much likelier than the ordinary automaton does.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator, Mapping
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ratelens.llm.words import per_batch
from ratelens.session import cut

# The patterns of the kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
FORMAT = "format"
PLAIN = "plain"
#: Candidates: runs of credential characters, this long at least.
LEAST_LENGTH = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_LENGTH},}}")
#: Values per format that an automaton is inferred from, and ordinary tokens; a hash of the value decides which.
SAMPLE = 1_000
#: Labelled values that make a format, and their least share among all values of the shape.
LEAST_TAUGHT, LEAST_SHARE = 8, 0.05
#: Counts of automata that a task keeps unpacked; others are unpacked when a value of their length is met.
HELD_CELLS = 200_000
#: Places at the start of a format of any length whose states stay apart.
HEAD = 4
#: Characters of a value that may teach.
LONGEST = 256
ALPHA = 0.05
#: Log-likelihood ratio, per character, that a candidate of kind ``format`` needs.
MARGIN = 1.0
#: What a value's log-likelihood per character may lack to the least likely labelled one.
SLACK = 0.25
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_SYMBOL = {char: k for k, chars in enumerate(_CLASSES) for char in chars}
_END = len(_CLASSES)
_ORDER = {kind: k for k, kind in enumerate((*KINDS, FORMAT))}


def base_spans(log: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, leftmost and non-overlapping per kind, by start."""
    found = []
    low = log.lower()
    for m in ASSIGN.finditer(log) if any(word in low for word in _KEYWORDS) else ():
        if len(m[1]) >= ASSIGN_LEAST:
            found.append(("assign", m.start(), m.end(), m[1]))
    if "AKIA" in log:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(log)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(log)]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]]))


def _candidates(log: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs that no base span touches: the ordinary tokens that may teach."""
    found = []
    spans = [(s[1], s[2]) for s in taken]
    begins, reach = [b for b, _ in spans], list(accumulate((e for _, e in spans), max))
    for m in CANDIDATE.finditer(log):
        k = bisect_left(begins, m.end())  # spans that start before the token ends
        if not k or reach[k - 1] <= m.start():
            found.append((m.start(), m.end(), m[0]))
    return found


def _remains(log: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """What base spans, by start, leave of the runs of credential characters; pieces that are long enough for a candidate."""
    found, k = [], 0
    for m in CANDIDATE.finditer(log):
        at = m.start()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < m.end():
            start, end = taken[j]
            if start - at >= LEAST_LENGTH:
                found.append((at, start, log[at:start]))
            at = max(at, end)
            j += 1
        if m.end() - at >= LEAST_LENGTH:
            found.append((at, m.end(), log[at : m.end()]))
    return found


def _merged(spans: list[tuple[str, int, int, str]]) -> list[tuple[int, int]]:
    """The base spans' places, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for _, start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _symbols(value: str) -> list[int]:
    return [_SYMBOL[c] for c in value]


def shape(value: str) -> str:
    """The alphabets of a value and its punctuation; ``x`` and ``X`` are letters of hexadecimal digits alone."""
    seen = {_SYMBOL[c] for c in set(value)}
    parts = [
        "9" if 0 in seen else "",
        "a" if 2 in seen else "x" if 1 in seen else "",
        "A" if 4 in seen else "X" if 3 in seen else "",
        "+" if seen & {5, 6, 9} else "",
        "-" if seen & {7, 10} else "",
        "." if 8 in seen else "",
    ]
    return "".join(parts)


class Automaton:
    """A probabilistic automaton over character classes with the characters of each state.

    ``moves[state][class]`` is (next state, count), ``chars[state][char]`` a count,
    ``ends[state]`` how many values end there. Shares are smoothed with the
    automaton's own shares of classes, characters with equal ones. ``fixed`` is the
    length of all values if states of different places were not merged, else 0.
    ``floor`` is the least log-likelihood per character that one of the values has
    from the others, less ``SLACK``.
    """

    def __init__(self, moves, chars, ends, fixed: int = 0, longest: int = 0, floor: float = -math.inf):
        self.moves, self.chars, self.ends = moves, chars, ends
        self.fixed, self.longest, self.floor = fixed, longest, floor
        self.visits = [e + sum(n for _, n in own.values()) for e, own in zip(ends, moves)]
        total = sum(self.visits)
        self.shares: dict[int, float] = {}
        for own in moves:
            for symbol, (_, n) in own.items():
                self.shares[symbol] = self.shares.get(symbol, 0.0) + n / total
        self.end_share = sum(ends) / total if total else 0.0
        self.usual = [max(own.values(), key=lambda m: (m[1], -m[0]))[0] if own else -1 for own in moves]

    def log_likelihood(self, value: str, unseen: float | None = None, less: int = 0) -> float:
        """``less`` takes that many occurrences out of every count on the way: 1 leaves out the value itself."""
        unseen = _UNSEEN if unseen is None else unseen
        state, total = 0, 0.0
        for char in value:
            symbol = _SYMBOL[char]
            share = self.shares.get(symbol)
            if share is None or self.usual[state] < 0:
                total += unseen
                state = max(self.usual[state], 0)
                continue
            to, n = self.moves[state].get(symbol, (self.usual[state], less))
            size = len(_CLASSES[symbol])
            own = self.chars[state].get(char, less)
            total += math.log((n - less + _SMOOTH * share) / (self.visits[state] - less + _SMOOTH))
            total += math.log((own - less + 1.0) / (n - less + size))
            state = to
        ends = max(self.ends[state] - less, 0) if self.ends[state] else 0
        return total + math.log((ends + _SMOOTH * self.end_share + 1e-9) / (max(self.visits[state] - less, 0) + _SMOOTH))

    def knows(self, value: str) -> bool:
        """Whether the automaton's own values are hardly less likely than ``value``."""
        if self.fixed and len(value) != self.fixed or self.longest and len(value) > 2 * self.longest:
            return False
        return self.log_likelihood(value, _FOREIGN) >= self.floor * len(value)


#: Weight of an automaton's shares of classes in each of its states.
_SMOOTH = 2.0
#: For a class that no value has: in ordinary tokens, and in a format.
_UNSEEN, _FOREIGN = math.log(1e-3), math.log(1e-6)


class _Tree:
    """Prefix tree whose states are merged: ``edges[state][symbol]`` is [next state, count]."""

    def __init__(self, values: list[str], alpha: float):
        self.edges: list[dict[int, list[int]]] = [{}]
        self.chars: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.depth = [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for value in values:
            state = 0
            for char, symbol in zip(value, _symbols(value)):
                edge = self.edges[state].get(symbol)
                if edge is None:
                    edge = self.edges[state][symbol] = [len(self.edges), 0]
                    self.edges.append({})
                    self.chars.append({})
                    self.ends.append(0)
                    self.depth.append(self.depth[state] + 1)
                edge[1] += 1
                self.chars[state][char] = self.chars[state].get(char, 0) + 1
                state = edge[0]
            self.ends[state] += 1

    def visits(self, state: int) -> int:
        return self.ends[state] + sum(n for _, n in self.edges[state].values())

    def compatible(self, kept: int, state: int) -> bool:
        todo = [(kept, state)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits(a), self.visits(b)
            if not na or not nb:
                continue
            most = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if abs(self.ends[a] / na - self.ends[b] / nb) > most:
                return False
            for symbol in self.edges[a].keys() | self.edges[b].keys():
                x, y = self.edges[a].get(symbol), self.edges[b].get(symbol)
                if abs((x[1] if x else 0) / na - (y[1] if y else 0) / nb) > most:
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(self, kept: int, state: int) -> None:
        """Add the counts of ``state``, the root of a subtree that nothing else leads to, to ``kept``."""
        todo = [(kept, state)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for char, n in self.chars[b].items():
                self.chars[a][char] = self.chars[a].get(char, 0) + n
            for symbol, (to, n) in self.edges[b].items():
                edge = self.edges[a].get(symbol)
                if edge is None:
                    self.edges[a][symbol] = [to, n]
                else:
                    edge[1] += n
                    todo.append((edge[0], to))


def infer(values: list[str], alpha: float = ALPHA, head: int | None = HEAD) -> Automaton:
    """Merge compatible states of the values' prefix tree, in breadth-first order.

    Two states are compatible if the shares with which they end, and with which
    they go on with each class, differ by less than the Hoeffding bound at
    ``alpha``, and the states they lead to are compatible as well. A merged state
    adds up the counts of both and of all that hangs on them. States less than
    ``head`` characters from the start merge only with those as far from it;
    without ``head``, all do.
    """
    tree = _Tree(values, alpha)
    kept, known = [0], {0}
    todo = [(0, symbol) for symbol in sorted(tree.edges[0])]
    while todo:
        owner, symbol = todo.pop(0)
        state = tree.edges[owner][symbol][0]
        if state in known:
            continue
        far = tree.depth[state]
        for other in kept:
            near = tree.depth[other]
            may = near == far or (head is not None and min(near, far) >= head)
            if may and tree.compatible(other, state):
                tree.edges[owner][symbol][0] = other
                tree.fold(other, state)
                break
        else:
            kept.append(state)
            known.add(state)
        todo = [(k, s) for k in kept for s in sorted(tree.edges[k]) if tree.edges[k][s][0] not in known]
    number = {state: k for k, state in enumerate(kept)}
    lengths = {len(v) for v in values}
    model = Automaton(
        [{symbol: (number[to], n) for symbol, (to, n) in tree.edges[state].items()} for state in kept],
        [tree.chars[state] for state in kept],
        [tree.ends[state] for state in kept],
        fixed=max(lengths) if head is None and len(lengths) == 1 else 0,
        longest=max(lengths, default=0),
    )
    alone = [model.log_likelihood(v, _FOREIGN, less=1) / len(v) for v in set(values) if v]
    model.floor = min(alone, default=0.0) - SLACK
    return model


def _labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The distinct values of this batch that base spans label, and ordinary candidates."""
    found: tuple[set[str], set[str]] = (set(), set())
    for log in batch.column("log").to_pylist():
        if log:
            spans = base_spans(log)
            found[1].update(value for _, _, _, value in spans)
            found[0].update(value for _, _, value in _candidates(log, spans))
    rows = [(bool(k), shape(v), len(v), _dice(v), v) for k in (0, 1) for v in found[k] if LEAST_LENGTH <= len(v) <= LONGEST]
    columns = zip(*rows) if rows else ((),) * 5
    kinds = (pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["labelled", "shape", "length", "dice", "value"]
    )


def _dice(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=7).digest())


def _inferred(table: pa.Table) -> pa.Table:
    name, length = table.column("format")[0].as_py(), table.column("fixed")[0].as_py()
    values = [v for _, v in sorted(zip(table.column("dice").to_pylist(), table.column("value").to_pylist()))]
    model = infer(values, head=0 if name == PLAIN else None if length else HEAD)
    rows = [(name, -1, "floor", model.fixed, model.floor), (name, -1, "longest", model.longest, 0.0)]
    for k, (own, chars) in enumerate(zip(model.moves, model.chars)):
        rows += [(name, k, char, own[_SYMBOL[char]][0], float(n)) for char, n in sorted(chars.items())]
        rows.append((name, k, "", -1, float(model.ends[k])))
    return pa.Table.from_pylist([dict(zip(_MODEL.names, r)) for r in rows], schema=_MODEL)


_MODEL = pa.schema([
    ("format", pa.string()), ("state", pa.int32()), ("symbol", pa.string()), ("next", pa.int32()), ("weight", pa.float64())
])


def infer_formats(logs: DataFrame, text: str = "log") -> DataFrame:
    """(format, state, symbol, next, weight): one automaton per format, named by shape and length, and one of ordinary tokens.

    All distinct values of ``LEAST_LENGTH`` to ``LONGEST`` characters are counted
    by shape and length, with and without a label. ``LEAST_TAUGHT`` labelled ones
    that are ``LEAST_SHARE`` of all make a format: each length of a shape one, and
    each shape one for any length. An automaton is inferred
    from the ``SAMPLE`` values with the smallest hashes. Unlabelled tokens that are
    of no format's shape teach the ordinary automaton. Without labelled values
    there are no formats.
    """
    found = logs.select(F.col(text).alias("log")).mapInArrow(
        per_batch(_labelled), "labelled boolean, shape string, length int, dice long, value string"
    )
    # A value with a label somewhere is labelled.
    values = cut(found.groupBy("value", "shape", "length", "dice").agg(F.bool_or("labelled").alias("labelled")))
    known, all_ = F.count_if("labelled"), F.count(F.lit(1))
    # At most as many rows as there are shapes times lengths.
    counts = values.groupBy("shape", "length").agg(known.alias("known"), all_.alias("n"))
    enough = (F.col("known") >= LEAST_TAUGHT) & (F.col("known") >= LEAST_SHARE * F.col("n"))
    exact = counts.where(enough).select("shape", "length", F.col("length").alias("fixed"))
    loose = counts.groupBy("shape").agg(F.sum("known").alias("known"), F.sum("n").alias("n")).where(enough)
    loose = loose.select("shape", F.lit(0).alias("fixed"))
    taught = values.where("labelled")
    rows = taught.join(F.broadcast(exact), ["shape", "length"]).unionByName(taught.join(F.broadcast(loose), "shape"))
    rows = rows.withColumn("format", F.concat_ws(":", "shape", "fixed"))
    plain = values.where("NOT labelled").join(F.broadcast(loose), "shape", "left_anti")
    plain = plain.join(F.broadcast(exact), ["shape", "length"], "left_anti")
    rows = rows.unionByName(plain.withColumns({"fixed": F.lit(0), "format": F.lit(PLAIN)}))
    order = Window.partitionBy("format").orderBy("dice", "value")
    sample = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE)
    return sample.select("format", "fixed", "dice", "value").groupBy("format").applyInArrow(
        _inferred, "format string, state int, symbol string, next int, weight double"
    )


def _packed(table: pa.Table) -> pa.Table:
    """A format's rows of a model as one compressed row."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    about = {r["symbol"]: r["next"] for r in table.filter(pc.less(table["state"], 0)).to_pylist()}
    row = {"format": table["format"][0].as_py(), "fixed": about["floor"], "cells": table.num_rows, "packed": out.getvalue().to_pybytes()}
    return pa.Table.from_pylist([row], schema=_PACKED)


_PACKED = pa.schema([("format", pa.string()), ("fixed", pa.int32()), ("cells", pa.int32()), ("packed", pa.binary())])


def _unpacked(packed: bytes) -> Automaton:
    moves, chars, ends, about = {}, {}, {}, {}
    for row in pa.ipc.open_stream(packed).read_all().to_pylist():
        state, symbol = row["state"], row["symbol"]
        if state < 0:
            about |= {"fixed": row["next"], "floor": row["weight"]} if symbol == "floor" else {"longest": row["next"]}
        elif not symbol:
            ends[state] = int(row["weight"])
        else:
            n = int(row["weight"])
            own = moves.setdefault(state, {})
            own[_SYMBOL[symbol]] = (row["next"], own.get(_SYMBOL[symbol], (0, 0))[1] + n)
            chars.setdefault(state, {})[symbol] = n
    states = range(len(ends))
    return Automaton([moves.get(k, {}) for k in states], [chars.get(k, {}) for k in states], [ends[k] for k in states], **about)


class Automata(Mapping):
    """The automata of a model by the name of their format, compressed until they are asked for.

    There are as many as there are shapes and lengths at most. Unpacked ones are
    kept, those used last, up to ``HELD_CELLS`` counts.
    """

    def __init__(self, rows: list[tuple[str, int, int, bytes]]):
        self.packed = {name: (cells, packed) for name, _, cells, packed in rows}
        self.by_length: dict[int, list[str]] = {}
        for name, fixed, _, _ in rows:
            if name != PLAIN:
                self.by_length.setdefault(fixed, []).append(name)
        self.held: OrderedDict[str, Automaton] = OrderedDict()
        self.cells = 0

    def __getitem__(self, name: str) -> Automaton:
        found = self.held.get(name)
        if found is None:
            cells, packed = self.packed[name]
            found = self.held[name] = _unpacked(packed)
            self.cells += cells
            while self.cells > HELD_CELLS and len(self.held) > 1:
                self.cells -= self.packed[self.held.popitem(last=False)[0]][0]
        else:
            self.held.move_to_end(name)
        return found

    def __iter__(self) -> Iterator[str]:
        return iter(self.packed)

    def __len__(self) -> int:
        return len(self.packed)

    def for_length(self, length: int) -> Iterator[Automaton]:
        """Of the formats that values of this length may have."""
        for fixed in (length, 0):
            for name in self.by_length.get(fixed, ()):
                yield self[name]


def _automata(model: DataFrame) -> Automata:
    rows = model.groupBy("format").applyInArrow(_packed, "format string, fixed int, cells int, packed binary").collect()
    return Automata(sorted((r["format"], r["fixed"], r["cells"], bytes(r["packed"])) for r in rows))


def format_score(value: str, automata: Mapping[str, Automaton]) -> float:
    """Log-likelihood ratio per character of the likeliest format that knows the value against ordinary tokens."""
    if isinstance(automata, Automata):
        formats = automata.for_length(len(value))
    else:
        formats = (a for k, a in automata.items() if k != PLAIN)
    known = [a.log_likelihood(value, _FOREIGN) for a in formats if a.knows(value)]
    if not known:
        return -math.inf
    plain = automata[PLAIN].log_likelihood(value) if PLAIN in automata else -len(value) * math.log(len(_SYMBOL))
    return (max(known) - plain) / len(value)


def _formats(start: int, run: str, automata: Mapping[str, Automaton]) -> list[tuple[str, int, int, float]]:
    """Spans of kind ``format`` in a run: the run, or else the parts between ``=``, then also ``/``, then also dots.

    Punctuation at the ends of a part need not fit the format.
    """
    for split in ("[^=]+", "[^/=]+", "[^./=]+") if any(k != PLAIN for k in automata) else ():
        parts = [(0, run)] if split == "[^=]+" else []
        parts += [(m.start(), m[0]) for m in re.finditer(split, run) if LEAST_LENGTH <= len(m[0]) < len(run)]
        hits: list[tuple[str, int, int, float]] = []
        for at, part in parts:
            bare = part.strip("./-_=+")
            score = max(format_score(v, automata) for v in ((part, bare) if LEAST_LENGTH <= len(bare) else (part,)))
            if score >= MARGIN:
                hits.append((FORMAT, start + at, start + at + len(part), score))
                if len(part) == len(run):
                    break
        if hits:
            return hits
    return []


def all_spans(log: str, automata: Mapping[str, Automaton]) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of base and inferred spans, by start, then kind."""
    base = base_spans(log)
    spans = [(kind, start, end, format_score(value, automata)) for kind, start, end, value in base]
    for start, _, value in _remains(log, _merged(base)):
        spans += _formats(start, value, automata)
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]]))


def _redacted(log: str, spans: list[tuple[str, int, int, float]]) -> str:
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [log[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, log[at:]])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _found(automata, redact: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        formats, out = automata.value, []
        for log in batch.column(batch.num_columns - 1).to_pylist():
            spans = all_spans(log, formats) if log else []
            if redact:
                out.append(_redacted(log, spans) if spans else log)
            else:
                out.append([dict(zip(("kind", "start", "end", "score"), s)) for s in spans])
        last = pa.array(out, pa.string() if redact else _SPAN)
        name = "_redacted" if redact else "spans"
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], last], names=[*batch.schema.names[:-1], name])

    return per_batch(run)


def _scan(logs: DataFrame, model: DataFrame, keep: list[str], text: str, redact: bool) -> DataFrame:
    automata = logs.sparkSession.sparkContext.broadcast(_automata(model))
    rows = logs.select(*keep, F.col(text).alias("_scanned"))
    new = "_redacted string" if redact else "spans array<struct<kind:string,start:int,end:int,score:double>>"
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(new).fields])
    return rows.mapInArrow(_found(automata, redact), schema)


def credential_spans(logs: DataFrame, model: DataFrame | None = None, item: str = "item_id", text: str = "log") -> DataFrame:
    """(item, spans): credentials in each whole log, as code points [start, end) with kind and score, by start, then kind.

    Spans of the kinds ``assign``, ``access`` and ``hex`` are exactly what their
    patterns find. Spans of kind ``format`` are other runs of credential
    characters, and what base spans leave of a run, ``LEAST_LENGTH`` long or more, which an inferred format
    knows and to which it gives ``MARGIN`` or more per character over ordinary tokens. ``model`` is from
    :func:`infer_formats`, by default of the same logs. One row per row of
    ``logs``, repeated ones too; null and empty logs have no spans. Other columns
    are not read.
    """
    model = infer_formats(logs, text) if model is None else model
    return _scan(logs, model, [item], text, redact=False)


def redact_credentials(logs: DataFrame, model: DataFrame | None = None, text: str = "log") -> DataFrame:
    """``logs`` with every span of :func:`credential_spans` replaced by its kind in brackets; null stays null.

    Overlapping spans become one, named after the first.
    """
    model = infer_formats(logs, text) if model is None else model
    done = _scan(logs, model, [c for c in logs.columns if c != text], text, redact=True)
    return done.select(*[F.col("_redacted").alias(c) if c == text else c for c in logs.columns])
