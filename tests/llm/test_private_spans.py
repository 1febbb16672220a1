"""Personal data in tool logs."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from ratelens.llm import private_spans as ps
from ratelens.llm.private_spans import base_spans, private_spans

# The patterns as they are stated.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def plain_base(log):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(log):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(part) > 255 for part in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return found


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(logs):
    """Spans of all logs, by dictionaries over words."""
    places, totals, edges = [], Counter(), defaultdict(Counter)
    kinds = {}
    for k, log in enumerate(logs):
        log = log or ""
        base = plain_base(log)
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", log)]

        def numeric(w):
            text = log[w[0] : w[1]]
            return re.fullmatch(r"[0-9+().\-/]+", text) and re.search("[0-9]", text)

        units, i = [], 0
        while i < len(words):
            j = i
            while numeric(words[i]) and j + 1 < len(words) and numeric(words[j + 1]):
                j += 1
            units.append((i, j))
            i = j + 1
        for i, j in units:
            text = [lowered(log[a:b]) for a, b in words]
            contexts = []
            if i > 0:
                contexts.append((1, text[i - 1]))
            if i > 1:
                contexts.append((2, text[i - 2], text[i - 1]))
            if i > 0 and j + 1 < len(words):
                contexts.append((3, text[i - 1], text[j + 1]))
            totals.update(contexts)
            start, end = words[i][0], words[j][1]
            value = log[start:end]
            if not re.search("[0-9@]", value):
                continue
            touching = sorted((s for s in base if s[1] < end and s[2] > start), key=lambda s: s[1])
            if touching:
                if len({s[0] for s in touching}) > 1:
                    continue
                thing = log[touching[0][1] : touching[0][2]].lower()
                kinds[thing] = max(kinds.get(thing, ""), touching[0][0])
            else:
                thing = value.strip(ps._STRIP).lower()
                if len(thing) < 4 or not re.search("[0-9@]", thing):
                    continue
                at = start + len(value) - len(value.lstrip(ps._STRIP))
                places.append((k, at, at + len(thing), thing))
            for c in contexts:
                edges[c][thing] += 1
    known, accepted = {t: (k, 1.0) for t, k in kinds.items()}, {}
    for _ in range(ps.ROUNDS):
        trusted = {}
        for c, things in edges.items():
            for kind in ps.KINDS:
                support = sum(known[t][1] for t in things if t in known and known[t][0] == kind)
                hits = sum(known[t][1] * n for t, n in things.items() if t in known and known[t][0] == kind)
                trust = round(hits / (totals[c] + 1), 6)
                if support >= 3 - 1e-6 and trust >= ps.TRUST:
                    trusted[c, kind] = trust
        rest = defaultdict(float)
        for (c, kind), trust in trusted.items():
            for t in edges[c]:
                if t not in kinds:
                    rest[t, kind] += math.log(1 - trust)
        new = {}
        for (t, kind), log in rest.items():
            score = round(1 - math.exp(log), 6)
            if score >= ps.ACCEPT:
                new[t] = max(new.get(t, (0.0, "")), (score, kind))
        new = {t: (kind, score) for t, (score, kind) in new.items()}
        if new == accepted:
            break
        accepted, known = new, {t: (k, 1.0) for t, k in kinds.items()} | new
    out = [[(kind, a, b, kind, 1.0) for kind, a, b in plain_base(log or "")] for log in logs]
    for k, a, b, thing in sorted(places):
        if thing in accepted:
            out[k].append((ps.CONTEXT, a, b, *accepted[thing]))
    return out


def run(spark, logs):
    rows = [(i, log, "x", 1) for i, log in enumerate(logs)]
    table = spark.createDataFrame(rows, "item_id long, log string, spans string, thing int").repartition(3)
    found = {r["item_id"]: [tuple(s) for s in r["spans"]] for r in private_spans(table).collect()}
    return [found[i] for i in range(len(logs))]


def planted(seed=3, n=150):
    """Logs whose lines name people's addresses after the same words, and (spans, logs) of unknown identifiers."""
    dice = random.Random(seed)
    noise = ["encode", "frame", "of", "the", "window", "pass", "shot", "rate", "done", "at", "12", "v2.1", "48000"]
    logs, hidden = [], []
    for i in range(n):
        lines = [" ".join(dice.choice(noise) for _ in range(dice.randint(3, 12))) for _ in range(3)]
        kind = i % 5
        if kind == 0:
            lines[1] += f"\nsubmitted by user: u{dice.randint(0, 10**6)}@example.com on host farm"
        elif kind == 1:
            lines[1] += f"\nconnection from peer {dice.randint(1, 255)}.{dice.randint(0, 255)}.0.7 accepted now"
        elif kind == 2 and i < 60:
            name = f"ops_{dice.randint(100, 999)}"
            lines[1] += f"\nsubmitted by user: {name} on host farm"
            hidden.append((i, name))
        elif kind == 3 and i < 60:
            name = f"fe80::{dice.randint(1000, 9999)}"
            lines[1] += f"\nconnection from peer {name}, accepted now"
            hidden.append((i, name))
        logs.append("\n".join(lines))
    # The same name where no context tells it.
    logs.append(f"{hidden[0][1]} was seen twice")
    hidden.append((len(logs) - 1, hidden[0][1]))
    return logs, hidden


def test_finds_planted_identifiers(spark):
    logs, hidden = planted()
    found = run(spark, logs)
    spans = {(i, logs[i][s[1] : s[2]]) for i, own in enumerate(found) for s in own if s[0] == ps.CONTEXT}
    assert spans == set(hidden)
    like = {s[3] for own in found for s in own if s[0] == ps.CONTEXT}
    assert like == {"email", "ip"}


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_graph(spark, seed):
    logs, _ = planted(seed, 60)
    logs += logs[:7] + [None, "", "@", "+1 (217) 555-0134 4444 3333 2222 1111 10.0.0.1", "é user: ü7@b.de, " * 40]
    assert run(spark, logs) == plain(logs)


def test_second_round(spark):
    """What one context reveals supports another, which reveals more."""
    logs = [f"mail to u{i}@example.com please" for i in range(12)]
    logs += [f"mail to id{i}00 please" for i in range(4)] + [f"owner=x tag id{i}00 end" for i in range(4)]
    logs += [f"owner=x tag id{i}00 end" for i in range(4)] * 2 + ["owner=x tag zz77 end"]
    found = run(spark, logs)
    assert found == plain(logs)
    assert [s[0] for s in found[-1]] == [ps.CONTEXT]


def test_clean_logs_stay_clean(spark):
    dice = random.Random(5)
    logs = [" ".join(dice.choice(["a", "b", "the", f"{dice.randint(0, 99999)}", "x9@y", "9.9."]) for _ in range(40)) for _ in range(80)]
    assert not [s for own in run(spark, logs) for s in own if s[0] == ps.CONTEXT]


def test_base_spans():
    dice = random.Random(1)
    for _ in range(20_000):
        log = "".join(dice.choice("a1@.-+ (2)0é%") for _ in range(dice.randint(0, 40)))
        assert base_spans(log) == plain_base(log), log
        log = "".join(dice.choice("0123456789 -") for _ in range(dice.randint(10, 60)))
        assert base_spans(log) == plain_base(log), log


def test_long_texts_take_linear_time():
    for piece in ("1", "1.", "a", "a@", "+1", "1 ", "-"):
        base_spans(piece * 300_000)


def test_empty_table(spark):
    assert private_spans(spark.createDataFrame([], "item_id long, log string")).collect() == []
    one = spark.createDataFrame([(None, "u1@b.de"), (7, None), (7, None)], "item_id long, log string")
    assert sorted((r["item_id"] or 0, len(r["spans"])) for r in private_spans(one).collect()) == [(0, 1), (7, 0), (7, 0)]
