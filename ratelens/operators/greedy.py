"""Greedy choices of windows, folded over many sources at a time.

Rows come source by source. Sources with equally many observations are laid side
by side: a matrix has a row per observation, by planned start, and a column per
source, so a step of the fold is a few array operations for all of them. NaN
stands for null. All planned windows of a source share one duration, so two of
them overlap exactly when their starts are closer than it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ratelens.policy import SCENE_CHANGE_THRESHOLD, WINDOW_EPSILON, Profile

#: Rows folded together, unless one source has more.
ROWS = 1 << 17
#: No observation's number.
NOBODY = -2

#: Reasons in the order in which a plan gives them; a window that covers bin b has b + 1 above them.
KINDS = (
    ("highest_spatial_risk", "highest_si"),
    ("highest_motion_risk", "highest_ti"),
    ("global_compression_risk", "global_hardest"),
    ("transition_risk",),
    ("hardship",),
)
_TRANSITION, _HARDSHIP, _BIN = 3, 4, len(KINDS)


def whole_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole sources with the row at which each begins; ``_n`` is the number of rows of a row's source."""
    held: list[pa.RecordBatch] = []
    rows, starts, end = 0, [], 0
    for batch in batches:
        sizes = batch.column("_n").to_numpy()
        while end < rows + len(sizes):
            starts.append(end)
            end += int(sizes[end - rows])
        held.append(batch)
        rows += len(sizes)
        cut = end if end == rows else starts[-1]
        if cut >= ROWS:
            table = pa.Table.from_batches(held)
            yield table.slice(0, cut), np.array([s for s in starts if s < cut])
            held = table.slice(cut).to_batches()
            rows, starts, end = rows - cut, [s - cut for s in starts if s >= cut], end - cut
    if rows:
        yield pa.Table.from_batches(held), np.array(starts)


class Numbers(NamedTuple):
    """Ids as numbers in the order of their bytes; a null id is -1 and equals no other."""

    of: np.ndarray
    ids: pa.Array

    @staticmethod
    def read(column: pa.ChunkedArray) -> Numbers:
        coded = column.combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        places = coded.indices
        of = np.full(len(places), -1)
        known = pc.is_valid(places).to_numpy(zero_copy_only=False)
        of[known] = rank[places.drop_null().to_numpy()]
        return Numbers(of, coded.dictionary.take(order))

    def find(self, ids: pa.Array) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(ids), NOBODY)
        return pc.fill_null(pc.index_in(ids, value_set=self.ids, skip_nulls=True), NOBODY).to_numpy(zero_copy_only=False).astype(np.int64)


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column.cast(pa.float64()), float("nan")).to_numpy()


def _groups(starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of rows, starts, sizes) of groups of one source and length each."""
    rows = np.arange(len(length))
    sizes = np.diff(starts, append=len(length))
    source = np.repeat(np.arange(len(starts)), sizes)
    other = np.append(False, (length[1:] != length[:-1]) & ~(np.isnan(length[1:]) & np.isnan(length[:-1])) & (source[1:] == source[:-1]))
    if other.any():
        rows = np.lexsort((length, source))
        length, source = length[rows], source[rows]
        starts = np.flatnonzero(np.append(True, (source[1:] != source[:-1]) | ((length[1:] != length[:-1]) & ~(np.isnan(length[1:]) & np.isnan(length[:-1])))))
        sizes = np.diff(starts, append=len(length))
    return rows, starts, sizes


def layouts(starts: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers as matrices, a group a column, for groups of equally many rows."""
    rows, starts, sizes = _groups(starts, length)
    for n in np.unique(sizes):
        yield rows[starts[sizes == n][None, :] + np.arange(n)[:, None]]


def _order(*keys: np.ndarray) -> np.ndarray:
    """Per column, the rows by rising keys, the first one first."""
    order = np.argsort(keys[0], axis=0, kind="stable")
    first = np.take_along_axis(keys[0], order, 0)
    tied = np.flatnonzero((first[1:] == first[:-1]).any(axis=0))
    if len(tied):
        order[:, tied] = np.lexsort([k[:, tied] for k in reversed(keys)], axis=0)
    return order


def _nulls_first(key: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(key), -np.inf, key)


def _nulls_last(key: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(key), np.inf, key)


class Picks:
    """Observations of sources side by side, and the windows held in each."""

    def __init__(self, rows: np.ndarray, number: np.ndarray, at: np.ndarray, length: np.ndarray, **values: np.ndarray) -> None:
        order = _order(at[rows], number[rows])
        self.rows = np.take_along_axis(rows, order, 0)
        self.n, self.columns = rows.shape
        self.number, self.at = number[self.rows], at[self.rows]
        self.value = {name: v[self.rows] for name, v in values.items()}
        self.length = length[rows[0]]
        self.near = self.length - WINDOW_EPSILON
        #: Observations that a held window overlaps, and those that are held themselves as well.
        self.hit = np.zeros(rows.shape, bool)
        self.blocked = np.zeros(rows.shape, bool)

    def beside(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.abs(self.at[:, c] - at) < self.near[c]

    def hold(self, c: np.ndarray, number: np.ndarray, at: np.ndarray) -> None:
        """One more held window in the columns ``c``."""
        hit = self.beside(c, at)
        self.hit[:, c] |= hit
        self.blocked[:, c] |= hit | ((self.number[:, c] == number) & (number >= 0))

    def capacity(self, c: np.ndarray, number: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
        """How many more disjoint windows fit beside the held ones, and beside this one."""
        blocked, near = self.blocked[:, c], self.near[c]
        if at is not None:
            blocked |= self.beside(c, at) | ((self.number[:, c] == number) & (number >= 0))
        last, count = np.full(len(c), -np.inf), np.zeros(len(c), np.int64)
        for spot, taken in zip(self.at[:, c], blocked, strict=True):
            free = ~(taken | (np.abs(spot - last) < near))
            last = np.where(free, spot, last)
            count += free
        return count

    def diverse(
        self, base: list[tuple[np.ndarray, np.ndarray, np.ndarray]], count: np.ndarray, reserve: np.ndarray, total: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(columns, rows) of up to ``count`` windows, a slot after the other.

        Each is the best mix of difficulty (.7) and distance to those already
        held (.3). ``base`` has (is there, number, start) of held windows, which
        :meth:`hold` knows. A candidate that overlaps a held window, or leaves
        too little capacity, is dropped for good.
        """
        center, hard, start = (self.value[k] for k in ("center", "difficulty", "start_sec"))
        left, gap = self.number >= 0, np.full(self.number.shape, np.nan)
        size, unknown = np.zeros(self.columns, np.int64), np.zeros(self.columns, bool)
        for there, number, at in base:
            left &= ~(there & (self.number == number))
            gap = np.where(there, np.fmin(gap, np.abs(center - (at + self.length / 2.0))), gap)
            size += there
            unknown |= there & np.isnan(at)
        spacing = np.fmax(total / np.maximum(count + size, 1), 1.0)
        picked = np.zeros(self.columns, np.int64)
        for slot in range(int(count.max(initial=0))):
            c = np.flatnonzero((count > slot) & left.any(axis=0))
            if not len(c):
                return
            far = np.where(np.isnan(gap[:, c]), total[c], gap[:, c])
            score = 0.70 * hard[:, c] + 0.30 * np.fmin(1.0, far / spacing[c])
            order = _order(
                np.where(left[:, c], _nulls_last(-score), np.inf), _nulls_last(-hard[:, c]), _nulls_last(start[:, c]), -self.number[:, c], -self.at[:, c]
            )
            now, open_, done = left.copy(), np.arange(len(c)), np.zeros(len(c), bool)
            for o in order:
                if not len(open_):
                    break
                at_row, at_column = o[open_], c[open_]
                tried = now[at_row, at_column]
                which, at_row, at_column = open_[tried], at_row[tried], at_column[tried]
                number, at = self.number[at_row, at_column], self.at[at_row, at_column]
                left[:, at_column] &= self.number[:, at_column] != number
                fine = ~self.hit[at_row, at_column] & ~unknown[at_column]
                some = at_column[fine]
                need = count[some] - (picked[some] + 1) + reserve[some]
                fine[fine] = self.capacity(some, number[fine], at[fine]) >= need
                some, number, at = at_column[fine], number[fine], at[fine]
                if len(some):
                    self.hold(some, number, at)
                    gap[:, some] = np.fmin(gap[:, some], np.abs(center[:, some] - (at + self.length[some] / 2.0)))
                    picked[some] += 1
                    yield some, at_row[fine]
                done[which[fine]] = True
                open_ = open_[~done[open_]]


def diverse_picks(count: int, reserve: int, source: str, names: list[str]):
    """Folds rows of observations with the windows held, ``_base``, into rows of picks."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_sources(batches):
            numbers = Numbers.read(table.column("id"))
            value = {c: _floats(table.column(c)) for c in ("_len", "_d", "start_sec", "center", "at", "difficulty")}
            base = table.column("_base").combine_chunks()
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for rows in layouts(starts, value["_len"]):
                picks = Picks(rows, numbers.of, value["at"], value["_d"], **{c: value[c] for c in ("start_sec", "center", "difficulty")})
                held, every = [], np.arange(picks.columns)
                own = base.take(pa.array(rows[0]))
                sizes, ends = own.value_lengths().fill_null(0).to_numpy(), own.offsets.to_numpy()[:-1]
                known, at = numbers.find(own.values.field("scout_id")), _floats(own.values.field("start_sec"))
                for i in range(int(sizes.max(initial=0))):
                    there = sizes > i
                    place = np.where(there, ends + i, 0)
                    held.append((there, np.where(there, known[place], NOBODY), at[place]))
                    picks.hold(every[there], known[place][there], at[place][there])
                total, line = value["_len"][rows[0]], np.zeros(picks.columns, np.int64)
                for c, o in picks.diverse(held, np.full(picks.columns, count), np.full(picks.columns, reserve), total):
                    found.append((picks.rows[o, c], rows[0][c], line[c].copy()))
                    line[c] += 1
            if not found:
                continue
            at, first, line = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = {
                source: table.column(source).take(pa.array(first)), "pick_no": pa.array(line, pa.int32()), "scout_id": numbers.ids.take(pa.array(numbers.of[at])),
                "start_sec": pa.array(value["at"][at]), "duration_sec": pa.array(value["_d"][at]),
            }
            yield from pa.table(columns).select(names).combine_chunks().to_batches()

    return fold


class _Plan:
    """The plan of sources side by side, as far as it is made."""

    def __init__(self, picks: Picks, blind: np.ndarray, target: np.ndarray, spare: np.ndarray) -> None:
        self.picks, self.blind, self.target, self.spare = picks, blind, target, spare
        shape = (int(target.max()), picks.columns)
        self.size = np.zeros(picks.columns, np.int64)
        self.number, self.at, self.row = np.full(shape, NOBODY), np.full(shape, np.inf), np.zeros(shape, np.int64)
        self.why = np.zeros(shape, np.int64)

    def add(self, c: np.ndarray, o: np.ndarray, why: int, *, merge: bool) -> np.ndarray:
        """Which of the candidates, rows ``o`` in the columns ``c``, were added or merged."""
        picks = self.picks
        number, at, near = picks.number[o, c], picks.at[o, c], picks.near[c]
        same, over = self.number[:, c] == number, np.abs(self.at[:, c] - at) < near
        known = same.any(axis=0)
        place = np.where(known, same.argmax(axis=0), over.argmax(axis=0))
        known |= over.any(axis=0)
        clear = ~(np.abs(at - self.blind[c]) < near)
        done = known & clear & merge
        self.why[place[done], c[done]] |= why
        fits = ~known & clear & (self.size[c] < self.target[c])
        some = c[fits]
        room = picks.capacity(some, number[fits], at[fits])
        fits[fits] = room >= self.target[some] - (self.size[some] + 1) + self.spare[some]
        some = c[fits]
        if len(some):
            slot = self.size[some]
            self.number[slot, some], self.at[slot, some], self.row[slot, some], self.why[slot, some] = number[fits], at[fits], o[fits], why
            self.size[some] += 1
            picks.hold(some, number[fits], at[fits])
        return done | fits

    def first_accepted(self, c: np.ndarray, order: np.ndarray, why: int, *, merge: bool, allowed: np.ndarray | None = None) -> np.ndarray:
        """Tries rows in order until one is accepted; for every column, whether one was."""
        done = np.zeros(self.picks.columns, bool)
        for o in order:
            if not len(c):
                break
            row, tried = o[c], c
            if allowed is not None:
                good = allowed[row, c]
                row, tried = row[good], c[good]
            done[tried[self.add(tried, row, why, merge=merge)]] = True
            c = c[~done[c]]
        return done


def _ranked(picks: Picks, measure: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Observations by falling measure; ties by distance to the anchor, start, id."""
    center, start = picks.value["center"], picks.value["start_sec"]
    return _order(_nulls_first(-measure), _nulls_first(np.abs(center - anchor)), _nulls_first(start), picks.number, picks.at, _nulls_first(center))


def _search(plan: _Plan, total: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Fills the search pools of the columns ``c``; for every column, whether a bin of the timeline could not be covered."""
    picks, value = plan.picks, plan.picks.value
    center, half = value["center"], picks.length / 2.0
    # Coverage: the hardest admissible window of each timeline bin.
    slots = np.maximum(1, plan.target // 2)
    failed = np.zeros(picks.columns, bool)
    for b in range(int(slots.max())):
        low, high = total * b / slots, total * (b + 1) / slots
        within = (center >= low) & ((center < high) | ((b == slots - 1) & (center <= high))) & (b < slots)
        allowed = within & (picks.at + half >= low) & (picks.at + half < high)
        middle = np.where(slots > 1, (low + high) / 2.0, total * 0.25)
        order = _ranked(picks, np.where(allowed, value["difficulty"], -np.inf), middle)
        some = c[allowed[:, c].any(axis=0)]
        done = plan.first_accepted(some, order, (b + 1) << _BIN, merge=False, allowed=allowed)
        failed |= ~done & within.any(axis=0)
    c = c[~failed[c]]
    # One representative per kind of risk. Anchors.
    for kind, (measure, anchor) in enumerate((("si_rank", 0.25), ("ti_rank", 0.75), ("difficulty", 0.50))):
        plan.first_accepted(c, _ranked(picks, value[measure], total * anchor), 1 << kind, merge=True)
    # The strongest transition, if the source has any.
    scene, cuts = value["scene"], value["cuts"]
    strongest = _order(
        _nulls_first(-value["transition"]), _nulls_first(-scene), _nulls_first(value["start_sec"]), picks.number, picks.at, _nulls_first(scene), _nulls_first(cuts)
    )[0]
    every = np.arange(picks.columns)
    some = c[((scene[strongest, every] >= SCENE_CHANGE_THRESHOLD) | (cuts[strongest, every] > 0))[c]]
    plan.add(some, strongest[some], 1 << _TRANSITION, merge=True)
    # Fill up by difficulty.
    for o in _ranked(picks, value["difficulty"], total / 2.0):
        c = c[plan.size[c] < plan.target[c]]
        if not len(c):
            break
        plan.add(c, o[c], 1 << _HARDSHIP, merge=True)
    return failed


_COLUMNS = ("start_sec", "center", "difficulty", "si_rank", "ti_rank", "transition", "scene", "cuts")
_POOLS = ("search", "holdout", "reserve")
_RANDOM = {"holdout": "holdout_difficulty_and_diversity", "reserve": "reserve_risk_and_timeline_diversity"}
WHOLE = "search:whole-video"
BLIND = "holdout:unscouted"
_FEW = "insufficient_independent_capacity"
_UNCOVERED = "insufficient_coverage_capacity"


def _reasons(why: int) -> list[str]:
    bin_ = [f"coverage_bin_{why >> _BIN}"] if why >> _BIN else []
    return bin_ + [r for kind, names in enumerate(KINDS) if why >> kind & 1 for r in names]


class _Rows:
    """Rows of plans; what a row says beside its observation is one of few texts."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.texts: dict[tuple, int] = {}

    def add(self, first: np.ndarray, at: np.ndarray, seen: np.ndarray | None, text: np.ndarray) -> None:
        self.parts.append((first, at, np.full(len(first), -1) if seen is None else seen, text))

    def text(self, pool: str | None, window: str | None, reasons: list[str], reason: str | None = None) -> int:
        return self.texts.setdefault((pool, window, tuple(reasons), reason), len(self.texts))


def _planned(rows: np.ndarray, numbers: Numbers, value: dict[str, np.ndarray], profile: Profile, out: _Rows) -> None:
    picks = Picks(rows, numbers.of, value["at"], value["_d"], **{k: value[k] for k in _COLUMNS})
    every, first = np.arange(picks.columns), rows[0]
    total, blind = value["_len"][first], value["_b0"][first]
    held, adaptive = value["_rh"][first].astype(np.int64), value["_adaptive"][first].astype(np.int64)
    picks.hold(every, np.full(picks.columns, NOBODY), blind)
    capacity = picks.capacity(every)
    reserves = np.minimum(profile.reserves, np.maximum(0, capacity - held - 1))
    plan = _Plan(picks, blind, np.maximum(1, np.minimum(adaptive, capacity - held - reserves)), held + reserves)
    few = capacity < held + 1
    failed = _search(plan, total, every[~few])

    def say(c: np.ndarray, at: np.ndarray | float, *text) -> None:
        out.add(first[c], np.broadcast_to(at, len(c)), None, np.full(len(c), out.text(*text)))

    say(every[few], 0.0, "search", WHOLE, ["whole_video", _FEW])
    say(every[~few & failed], 0.0, "search", WHOLE, ["whole_video", _UNCOVERED])
    c = every[~few & ~failed]
    short = plan.size[c] != plan.target[c]
    say(c[short], np.nan, None, None, [], "cannot fill the search pool")
    # Sources that keep a plan so far get holdouts and reserves.
    going = np.zeros(picks.columns, bool)
    going[c[~short]] = True
    base = [(plan.size > i, plan.number[i], plan.at[i]) for i in range(len(plan.at))]
    base.append((np.ones(picks.columns, bool), np.full(picks.columns, NOBODY), blind))
    chosen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for pool, wanted, reserve in (("holdout", held, reserves), ("reserve", reserves, np.zeros_like(reserves))):
        chosen[pool] = list(picks.diverse(base, np.where(going, wanted, 0), reserve, total))
        got = np.zeros(picks.columns, np.int64)
        for c, o in chosen[pool]:
            there, number, at = np.zeros(picks.columns, bool), np.full(picks.columns, NOBODY), np.full(picks.columns, np.inf)
            there[c], number[c], at[c] = True, picks.number[o, c], picks.at[o, c]
            base.append((there, number, at))
            got[c] += 1
        lacking = going & (got != wanted)
        say(every[lacking], np.nan, None, None, [], f"cannot fill the {pool} pool")
        going &= ~lacking
    say(every[going], blind[going], "holdout", BLIND, ["unscouted_validation"])
    for i in range(len(plan.at)):
        c = every[going & (plan.size > i)]
        why, which = np.unique(plan.why[i, c], return_inverse=True)
        texts = np.array([out.text("search", None, _reasons(int(w))) for w in why], np.int64)
        seen = picks.rows[plan.row[i, c], c]
        out.add(first[c], value["at"][seen], seen, texts[which])
    for pool, picked in chosen.items():
        for c, o in picked:
            kept = going[c]
            seen = picks.rows[o[kept], c[kept]]
            out.add(first[c[kept]], value["at"][seen], seen, np.full(len(seen), out.text(pool, None, [_RANDOM[pool]])))


def sample_plans(profile: Profile, source: str, names: list[str]):
    """Folds rows of observations into rows of plans: windows, or a ``reason`` why there are none."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_sources(batches):
            numbers = Numbers.read(table.column("id"))
            value = {c: _floats(table.column(c)) for c in ("_len", "_d", "_b0", "_rh", "_adaptive", "at", *_COLUMNS)}
            out = _Rows()
            for rows in layouts(starts, value["_len"]):
                _planned(rows, numbers, value, profile, out)
            first, at, seen, text = (np.concatenate(x) for x in zip(*out.parts, strict=True))
            pools, windows, reasons, problems = zip(*out.texts, strict=True)
            pool = pa.array(pools, pa.string()).take(pa.array(text))
            scout = numbers.ids.take(pa.array(np.where(seen < 0, 0, numbers.of[seen]), mask=seen < 0))
            whole = np.array([w == WHOLE for w in windows])[text]
            columns = {
                source: table.column(source).take(pa.array(first)),
                "pool": pool,
                "window_id": pc.coalesce(pa.array(windows, pa.string()).take(pa.array(text)), pc.binary_join_element_wise(pool, scout, ":")),
                "start_sec": pa.array(at),
                "duration_sec": pa.array(np.where(whole, value["_len"][first], value["_d"][first])),
                "reasons": pa.array([list(r) for r in reasons], pa.list_(pa.string())).take(pa.array(text)),
                "scout_id": scout,
                "reason": pa.array(problems, pa.string()).take(pa.array(text)),
            }
            yield from pa.table(columns).select(names).combine_chunks().to_batches()

    return fold
