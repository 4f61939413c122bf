"""Measurements that can't be real given how their source normally behaves.

Per source: a robust seasonal-trend decomposition (median per month of the year, of irregular readings per day of
the week and twelfth of the year; running median), remainders beyond generalised extreme studentised deviate limits
after which the source returns; separately, stretches in which the value stays still for longer than the source's
habit explains, and values outside the limits of their unit.

Hot sources are cut into time shards, each judged with what is usual in the whole source: its last digit, season,
scatter, steps and habit of resting are added up over the shards first, a shard sees ``BORDER`` moments across each cut, and
whether a spike comes again in other years is looked up in the whole source afterwards.

Defined cases: null and NaN aren't judged; infinite values are outside any limits; a row without a
source or a time is held against the limits only; sources of fewer than ``LEAST`` rows are held
against the limits and the stuck rule only; repeated rows are judged alike; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspring.functions import anomaly
from tallyspring.operators.shards import BROADCAST, across, hot_sources, time_shards
from tallyspring.session import materialize

#: Rows that a shard of a source holds at most, about.
SHARD_ROWS = 100_000
#: Moments that a shard sees across its cuts. A stuck stretch that leaves a shard is seen that far, which is longer than one
#: must be where neighbours are alike with a probability of up to 0.97.
BORDER = 1_000
#: Fewer rows than this show no usual behaviour.
LEAST = 12


@dataclass(frozen=True)
class Habit:
    """How the sources of one table are judged."""

    monthly: bool
    half: int  # of the running median's window, in rows
    wide: int  # of the window for the local scatter
    alpha: float
    margin: float
    longest: int  # moments that a spike lasts
    still: int  # moments that a stuck stretch lasts at least


MONTHLY = Habit(True, half=5, wide=12, alpha=1e-6, margin=1.35, longest=3, still=5)
IRREGULAR = Habit(False, half=10, wide=25, alpha=1e-6, margin=1.15, longest=5, still=6)

#: Cells of one padded matrix.
CELLS = 400_000


def _matrices(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of like size together, so that padding stays small."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and sizes[order[end]] <= 1.3 * sizes[order[at]] + 8 and (end + 1 - at) * sizes[order[end]] <= CELLS:
            end += 1
        yield order[at:end]
        at = end


@dataclass
class Verdict:
    """Per row: whether it is stuck or a spike, its distance from the course, the distance that is too far, and the last digit."""

    stuck: np.ndarray
    spike: np.ndarray
    rest: np.ndarray
    band: np.ndarray
    digit: np.ndarray


def assess(
    starts: np.ndarray, sizes: np.ndarray, t: np.ndarray, v: np.ndarray, habit: Habit, usual: anomaly.Usual | None = None, medians: np.ndarray | None = None, pending: np.ndarray | None = None
) -> Verdict:
    """Of rows that lie group after group, each sorted by time. ``t`` is days, or months where the habit is monthly.

    Groups that are parts of sources come with what is ``usual`` in each source, its season's ``medians``, and with ``pending``
    (per row; see ``anomaly.spike_flags``).
    """
    out = Verdict(*(np.zeros(len(v), k) for k in (bool, bool, float, float, float)))
    out.band += np.inf
    enough = np.flatnonzero(sizes >= habit.still) if usual is None else np.arange(len(sizes))
    starts, sizes = starts[enough], sizes[enough]
    for pick in _matrices(sizes):
        n = sizes[pick]
        width = int(n.max())
        j = np.arange(width)[None, :]
        live = j < n[:, None]
        src = np.where(live, starts[pick][:, None] + j, 0)
        x, when = np.where(live, v[src], 0.0), np.where(live, t[src], 0)
        when = when.astype(np.int64) if habit.monthly else when
        known = usual.pick(pick) if usual is not None else None
        q = anomaly.resolution(x, n) if known is None else known.digit
        flat = anomaly.stuck_flags(x, when, n, q, 1e-3, habit.still, known)
        steps, open_ = None, None if pending is None else np.full(x.shape, np.nan)
        if habit.monthly:
            season, steps = anomaly.seasonal_by_class(x, n, when % 12, 12, 6)
            still = anomaly.stepped(x, n, q)
            season[still] = 0
            steps[still] = 0
        elif known is None:
            season = anomaly.seasonal_by_calendar(x, n, when, habit.half)
        else:
            season = np.where(live, anomaly.season_of(medians[pick], when), 0.0)
        spikes, rest, band = anomaly.spike_flags(
            x, when, n, season, q, half=habit.half, alpha=habit.alpha, margin=habit.margin, longest=habit.longest,
            days_per_t=anomaly.YEAR / 12 if habit.monthly else 1.0, steps=steps, wide=habit.wide, usual=known, pending=open_,
        )
        enough_rows = live & ((n if known is None else known.n) >= LEAST)[:, None]
        at = src[live]
        out.stuck[at], out.spike[at], out.rest[at] = flat[live], (spikes & ~flat & enough_rows)[live], rest[live]
        out.band[at], out.digit[at] = np.where(enough_rows, band, np.inf)[live], np.broadcast_to(q[:, None], x.shape)[live]
        if open_ is not None:
            pending[at] = open_[live]
    return out


def judge(starts: np.ndarray, sizes: np.ndarray, t: np.ndarray, v: np.ndarray, habit: Habit) -> np.ndarray:
    found = assess(starts, sizes, t, v, habit)
    return found.stuck | found.spike


def _whole_groups(batches: Iterator[pa.RecordBatch], least_rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups. Rows come sorted by group (g, h, and shard where there is one); a group may run over several batches."""
    held: list[pa.RecordBatch] = []
    rows, due = 0, least_rows
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < due:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        starts, _ = _groups({k: whole.column(k).to_numpy() for k in ("g", "h", "shard") if k in whole.column_names})
        if len(starts) < 2:
            held, due = whole.to_batches(), 2 * rows
            continue
        due = least_rows
        cut = int(starts[-1])
        yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
        rows = whole.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _by_group(batches: Iterator[pa.RecordBatch], judged: Callable[[pa.Table], pa.RecordBatch], least_rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """``judged`` of tables of whole groups."""
    yield from map(judged, _whole_groups(batches, least_rows))


def _groups(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(c["g"]), bool)
    new[1:] = reduce(lambda a, b: a | b, [np.diff(c[k]) != 0 for k in ("g", "h", "shard") if k in c])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(new)))


def _judge_rows(table: pa.Table, habits: list[Habit]) -> pa.RecordBatch:
    c = {k: table.column(k).to_numpy() for k in ("g", "h", "kind", "t", "v", "row_id", "out")}
    starts, sizes = _groups(c)
    flags = c["out"].copy()
    for k, habit in enumerate(habits):
        mine = np.flatnonzero(c["kind"][starts] == k)
        if len(mine):
            flags |= judge(starts[mine], sizes[mine], c["t"], c["v"], habit)
    return pa.RecordBatch.from_arrays([pa.array(c["kind"][flags]), pa.array(c["row_id"][flags])], names=["kind", "row_id"])


# ---- hot sources: what is usual in the whole, learned from its shards

#: Of a shard: counts (``what``, ``cls``, ``bin``: ``n``), and the rows within ``BORDER`` moments of its ends (``what`` is _FIRST or _LAST).
LEARNED = "kind byte, g long, h long, shard long, what byte, cls int, bin long, n long, t double, v double, row_id long, out boolean"
_DIGIT, _SEASON, _FIRST, _LAST, _SIZE, _PLAIN, _SEASONAL, _PLAIN_MOVING, _SEASONAL_MOVING, _JUMP, _LEVEL, _SPAN = range(12)
#: Places in the numbers that a shard gets of its source.
_N, _Q, _SCALE, _DAYS, _PAIRS, _ALIKE, _RESTS, _VALUE = range(8)
_MEDIANS = 8
#: Values at rest that a shard reports.
LEVELS = 50


class _Counts:
    """Rows of LEARNED being made."""

    def __init__(self, kind: int, g: int, h: int, shard: int):
        self.head, self.parts = (kind, g, h, shard), []

    def add(self, what: int, bins, n, cls: int = 0, t=0.0, v=0.0, row_id=0, out=False) -> None:
        bins, n, t, v, row_id, out = np.broadcast_arrays(*map(np.atleast_1d, (bins, n, t, v, row_id, out)))
        self.parts.append((np.full(len(bins), what, np.int8), np.full(len(bins), cls, np.int32), bins.astype(np.int64), n.astype(np.int64), t.astype(float), v.astype(float), row_id.astype(np.int64), out.astype(bool)))

    def sizes(self, what: int, v: np.ndarray, width: float, cls: int = 0) -> None:
        self.add(what, *np.unique(anomaly.size_class(v, width), return_counts=True), cls=cls)

    def batch(self) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*self.parts)]
        kind, g, h, shard = (pa.array(np.full(len(cols[0]), x, k)) for x, k in zip(self.head, (np.int8, np.int64, np.int64, np.int64)))
        return pa.RecordBatch.from_arrays([kind, g, h, shard, *map(pa.array, cols)], names=[c.split()[0] for c in LEARNED.split(", ")])


def _shards(table: pa.Table) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray | None]]:
    """Columns of each shard, and the numbers of its source where they came along as the first row."""
    c = {k: table.column(k).to_numpy() for k in ("kind", "g", "h", "shard", "t", "v", "row_id", "out", "own")}
    told = table.column("usual")
    starts, sizes = _groups(c)
    for a, m in zip(starts, sizes):
        head = told[a].as_py()
        part = slice(a + (head is not None), a + m)
        yield {k: x[part] for k, x in c.items()}, np.array(head, float) if head is not None else None


def _learn_first(table: pa.Table, habits: list[Habit], border: int) -> Iterator[pa.RecordBatch]:
    """Digits, season, span and borders of each shard."""
    for c, _ in _shards(table):
        x, t, n = c["v"][None, :], c["t"][None, :], np.array([len(c["v"])])
        half = habits[c["kind"][0]].half
        got = _Counts(c["kind"][0], c["g"][0], c["h"][0], c["shard"][0])
        got.add(_DIGIT, -1, n)
        for d in range(7):
            got.add(_DIGIT, d, anomaly.fits_digits(x, d).sum())
        got.add(_SPAN, [0, 1], 0, t=[t.min(), t.max()])
        rest = (x - anomaly.running_median(x, n, half))[0]
        for at, (cls, many) in enumerate(zip(anomaly.calendar_classes(c["t"]), (anomaly.WEEK, anomaly.TWELFTHS))):
            for k in range(many):
                if (cls == k).any():
                    got.sizes(_SEASON, rest[cls == k], anomaly.COARSE, k + at * anomaly.WEEK)
        moment = np.cumsum(np.concatenate(([0], np.diff(c["t"]) != 0)))
        for what, near in ((_FIRST, moment < border), (_LAST, moment > moment[-1] - border)):
            got.add(what, 0, np.ones(near.sum()), t=c["t"][near], v=c["v"][near], row_id=c["row_id"][near], out=c["out"][near])
        yield got.batch()


def _learn_second(table: pa.Table, habits: list[Habit]) -> Iterator[pa.RecordBatch]:
    """Scatter, steps and resting of each shard, its source's last digit and season being known."""
    for c, told in _shards(table):
        x, t, n = c["v"][None, :], c["t"][None, :], np.array([len(c["v"])])
        half, q, medians = habits[c["kind"][0]].half, told[_Q : _Q + 1], told[None, _MEDIANS:]
        got = _Counts(c["kind"][0], c["g"][0], c["h"][0], c["shard"][0])
        near, fresh = anomaly.neighbours(x, t, n, q)
        moves = ~anomaly.at_rest(x, n, q)[0]
        step = np.abs(np.diff(c["v"]))
        got.add(_SIZE, [0, 1, 2, 3], [moves.sum(), (step <= q / 2).sum(), fresh.sum(), (near & fresh).sum()])
        for season, every, moving in ((0.0, _PLAIN, _PLAIN_MOVING), (anomaly.season_of(medians, t), _SEASONAL, _SEASONAL_MOVING)):
            y = x - season
            dev = np.abs(y - anomaly.running_median(y, n, half))[0]
            got.sizes(every, dev, anomaly.FINE)
            got.sizes(moving, dev[moves], anomaly.FINE)
        got.sizes(_JUMP, step[step > q / 2], anomaly.FINE)
        held, often = np.unique(c["v"][(near & fresh)[0]], return_counts=True)
        top = np.argsort(-often, kind="stable")[:LEVELS]
        # a value is counted by its bits
        got.add(_LEVEL, held[top].view(np.int64), often[top])
        yield got.batch()


def _counts_of(r) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """what -> (cls, bin, n) of one source's added-up counts."""
    x = np.array([(e["what"], e["cls"], e["bin"], e["n"]) for e in r.counts], np.int64).reshape(-1, 4)
    return {int(w): tuple(x[x[:, 0] == w, 1:].T) for w in np.unique(x[:, 0])}


NOTHING = (np.zeros(0, np.int64),) * 3


def _usual_first(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in pdf.itertuples():
        c = _counts_of(r)
        digits = dict(zip(c[_DIGIT][1].tolist(), c[_DIGIT][2].tolist()))
        n = digits.pop(-1)
        numbers = np.zeros(_MEDIANS + anomaly.WEEK + anomaly.TWELFTHS)
        numbers[_N], numbers[_DAYS] = n, r.last - r.first
        numbers[_Q] = 10.0 ** -min([d for d, k in digits.items() if k >= 0.98 * n], default=6)
        cls, bins, times = c.get(_SEASON, NOTHING)
        for k in range(anomaly.WEEK + anomaly.TWELFTHS):
            here = cls == k
            if times[here].sum() >= 3:
                if k >= anomaly.WEEK and numbers[_DAYS] < 2 * anomaly.YEAR:
                    break  # less than two years show no season
                numbers[_MEDIANS + k] = anomaly.counted_median(bins[here], times[here], anomaly.COARSE)
        out.append(numbers.tolist())
    return pdf[["kind", "g", "h"]].assign(usual=out)


def _usual_second(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in pdf.itertuples():
        c, numbers = _counts_of(r), np.array(r.usual, float)
        median = lambda what: anomaly.counted_median(*c.get(what, NOTHING)[1:], anomaly.FINE)
        many = dict(zip(c[_SIZE][1].tolist(), c[_SIZE][2].tolist()))
        season = np.nan_to_num(median(_SEASONAL)) < (1 - anomaly.EXPLAINS) * np.nan_to_num(median(_PLAIN))
        if not season:
            numbers[_MEDIANS:] = 0
        every, moving = (_SEASONAL, _SEASONAL_MOVING) if season else (_PLAIN, _PLAIN_MOVING)
        one = lambda v: np.array([v])
        steps = many[1] >= 0.5 * max(numbers[_N] - 1, 1)
        numbers[_SCALE] = anomaly.usual_scale(one(median(moving)), one(many[0]), one(median(every)), one(median(_JUMP)), one(steps), numbers[_Q : _Q + 1])[0]
        numbers[_PAIRS], numbers[_ALIKE] = max(many[2] - 1, 1), many[3]
        _, bits, often = c.get(_LEVEL, NOTHING)
        numbers[_RESTS], numbers[_VALUE] = (often.max(), bits[np.argmax(often) : np.argmax(often) + 1].view(float)[0]) if len(often) else (0, np.nan)
        out.append(numbers.tolist())
    return pdf[["kind", "g", "h"]].assign(usual=out)


JUDGED = "kind byte, g long, h long, row_id long, what byte, moment int, size long"
_SURE, _OPEN, _EVIDENCE = range(3)


def _judge_shards(table: pa.Table, habits: list[Habit]) -> Iterator[pa.RecordBatch]:
    """Rows that are flagged, those that are unless they come again in other years, and what may be such a return."""
    for c, told in _shards(table):
        habit, n = habits[c["kind"][0]], np.array([len(c["v"])])
        usual = anomaly.Usual(*[told[k : k + 1] for k in (_N, _Q, _SCALE, _DAYS, _PAIRS, _ALIKE, _RESTS, _VALUE)])
        pending = np.full(len(c["v"]), np.nan)
        found = assess(np.array([0]), n, c["t"], c["v"], habit, usual, told[None, _MEDIANS:], pending)
        sure = found.stuck | c["out"] | (found.spike & np.isnan(pending))
        open_ = found.spike & ~sure
        # what comes again is at least 0.7 of a spike, and a spike about the first limit
        large = np.abs(found.rest) > 0.6 * habit.margin * anomaly.esd_limits(usual.n, 1, habit.alpha)[0, 0] * usual.scale[0]
        parts = [(_SURE, sure, 0.0 * c["v"]), (_OPEN, open_, pending)]
        if usual.days[0] > 1.5 * anomaly.YEAR:
            parts.append((_EVIDENCE, large, found.rest))
        rows = [(np.full((k & c["own"]).sum(), w, np.int8), np.floor(c["t"][k & c["own"]] * anomaly.PARTS).astype(np.int32), anomaly.size_class(size[k & c["own"]], anomaly.FINE), c["row_id"][k & c["own"]]) for w, k, size in parts]
        what, moment, size, row_id = (np.concatenate(x) for x in zip(*rows))
        kind, g, h = (pa.array(np.full(len(what), c[k][0])) for k in ("kind", "g", "h"))
        yield pa.RecordBatch.from_arrays([kind, g, h, *map(pa.array, (row_id, what, moment, size))], names=[x.split()[0] for x in JUDGED.split(", ")])


def _returning(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one source: moments and sizes of spikes that come again at the same time of two other years."""
    seen, asked = pdf[pdf["what"] == _EVIDENCE], pdf[pdf["what"] == _OPEN]
    middle = lambda x: (x["moment"].to_numpy() + 0.5) / anomaly.PARTS
    size = lambda x: anomaly.class_value(x["size"].to_numpy(), anomaly.FINE)
    days, rest = middle(seen), size(seen)
    keep = [anomaly.returns_yearly(days, rest, d, s) for d, s in zip(middle(asked), size(asked))]
    return asked[np.array(keep, bool)][["kind", "g", "h", "moment", "size"]]


def _judged_hot(rows: DataFrame, hot: DataFrame, many: int, largest: int, habits: list[Habit], shard_rows: int, border: int) -> DataFrame:
    """kind, row_id of flagged rows of hot sources (``rows`` has only theirs)."""
    keys = ["kind", "g", "h"]
    placed = materialize(time_shards(rows.select(*keys, "t", "v", "row_id", "out"), ["g", "h"], "t", shard_rows, hot, many, largest), "shards")
    own = placed.withColumns({"own": F.lit(True), "usual": F.lit(None).cast("array<double>")})

    def over(shards: DataFrame, f: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        ready = shards.repartition("g", "h", "shard").sortWithinPartitions("g", "h", "shard", "t", "row_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _whole_groups(batches, 1):
                yield from f(table)

        return ready.mapInArrow(run, schema)

    def added(counts: DataFrame) -> DataFrame:
        each = counts.where(~F.col("what").isin(_FIRST, _LAST)).groupBy(*keys, "what", "cls", "bin").agg(F.sum("n").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
        return each.groupBy(*keys).agg(
            F.collect_list(F.struct("what", "cls", "bin", "n")).alias("counts"), F.min(F.when(F.col("what") == _SPAN, F.col("lo"))).alias("first"), F.max(F.when(F.col("what") == _SPAN, F.col("hi"))).alias("last")
        )

    def finished(packed: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
        return packed.mapInPandas(lambda it: map(f, it), "kind byte, g long, h long, usual array<double>")

    def heads(shards: DataFrame, usual: DataFrame) -> DataFrame:
        """A row for each shard that brings the numbers of its source, before all others."""
        first = {"t": F.lit(float("-inf")), "v": F.lit(0.0), "row_id": F.lit(0).cast("long"), "out": F.lit(False), "own": F.lit(False)}
        return shards.join(usual, keys).withColumns(first)

    learned = materialize(over(own, lambda x: _learn_first(x, habits, border), LEARNED), "learned")
    shards = learned.where((F.col("what") == _DIGIT) & (F.col("bin") == -1)).select(*keys, "shard")
    usual = materialize(finished(added(learned), _usual_first), "usual")
    second = over(own.unionByName(heads(shards, usual)), lambda x: _learn_second(x, habits), LEARNED)
    usual = materialize(finished(added(second).join(usual, keys), _usual_second), "usual")
    borders = learned.where(F.col("what").isin(_FIRST, _LAST)).select(*keys, "shard", "t", "v", "row_id", "out", (F.col("what") == _FIRST).alias("first"))
    beside = across(borders, shards, keys).withColumns({"own": F.lit(False), "usual": F.lit(None).cast("array<double>")})
    judged = materialize(over(own.unionByName(beside).unionByName(heads(shards, usual)), lambda x: _judge_shards(x, habits), JUDGED), "judged")
    # bounded by the calendar and the classes of size, however many rows there are
    distinct = judged.where(F.col("what") != _SURE).select(*keys, "what", "moment", "size").distinct()
    returning = distinct.groupBy(*keys).applyInPandas(_returning, "kind byte, g long, h long, moment int, size long")
    spikes = judged.where(F.col("what") == _OPEN).join(returning, [*keys, "moment", "size"], "left_anti")
    return judged.where(F.col("what") == _SURE).select("kind", "row_id").unionByName(spikes.select("kind", "row_id"))


POINT = "kind byte, g long, h long, t double, point double, like double, course double, band double, spared double"


def _judge_points(table: pa.Table, habits: list[Habit]) -> pa.RecordBatch:
    """Of one point per source and month: those that are flagged, with how near to the point a row shares its verdict, and those of several rows, with the course.

    A point beyond the band that is no spike (it comes again, behaves as its neighbour, lasts, is at an end) spares the rows within the band around it, too.
    """
    c = {k: table.column(k).to_numpy() for k in ("g", "h", "kind", "t", "v", "n")}
    starts, sizes = _groups(c)
    like, course, band, spared = np.full(len(c["v"]), -1.0), c["v"].copy(), np.full(len(c["v"]), np.inf), np.full(len(c["v"]), -1.0)
    for k, habit in enumerate(habits):
        mine = np.flatnonzero(c["kind"][starts] == k)
        if len(mine):
            found = assess(starts[mine], sizes[mine], c["t"], c["v"], habit)
            like = np.where(found.stuck, 2.01 * found.digit, np.where(found.spike, np.abs(found.rest) / 2, like))
            at = c["kind"] == k
            course, band = np.where(at, c["v"] - found.rest, course), np.where(at & ~found.stuck, found.band, band)
            spared = np.where(at & ~found.stuck & ~found.spike & (np.abs(found.rest) > found.band), found.band, spared)
    keep = (like >= 0) | (c["n"] > 1)
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (c["kind"], c["g"], c["h"], c["t"], c["v"], like, course, band, spared)], names=["kind", "g", "h", "t", "point", "like", "course", "band", "spared"])


@dataclass
class Measured:
    """One table's measurements. ``time`` is a day or timestamp column; ``floor`` and ``ceiling`` may be null."""

    name: str
    rows: DataFrame
    row_id: str
    source: list[Column]
    time: Column
    value: Column
    habit: Habit
    floor: Column | None = None
    ceiling: Column | None = None
    plain: DataFrame | None = None  # the rows before limits were joined to them, where they were

    def keys(self, kind: int) -> tuple[Column, Column]:
        """Two hashes that stand for the source; a row without one is its own."""
        none = reduce(lambda a, b: a | b, [c.isNull() for c in self.source])
        own = F.col(self.row_id).cast("long")
        return F.when(none, own).otherwise(F.xxhash64(F.lit(kind), *self.source)), F.when(none, F.lit(1).cast("long")).otherwise(F.xxhash64(*self.source, F.lit("second")))


def implausible(tables: list[Measured], shard_rows: int = SHARD_ROWS, border: int = BORDER) -> DataFrame:
    """table_name, row_id of all entries that can't be real."""
    parts, plain = [], []
    for kind, m in enumerate(tables):
        value = m.value.cast("double")
        limit = lambda c: F.lit(None).cast("double") if c is None else F.when(~F.isnan(c), c)
        g, h = m.keys(kind)
        if not m.habit.monthly:
            plain.append((m.rows if m.plain is None else m.plain).select(g.alias("g"), h.alias("h")))
        moment = (F.year(m.time) * 12 + F.month(m.time) - 1).cast("double") if m.habit.monthly else F.unix_micros(m.time.cast("timestamp")) / 86_400e6
        parts.append(
            m.rows.select(
                F.lit(kind).cast("byte").alias("kind"), F.col(m.row_id).cast("long").alias("row_id"), moment.alias("t"), value.alias("v"),
                F.coalesce(value < limit(m.floor), F.lit(False)).alias("low"), F.coalesce(value > limit(m.ceiling), F.lit(False)).alias("high"),
                g.alias("g"), h.alias("h"),
            ).where(F.col("v").isNotNull() & ~F.isnan("v"))
        )
    long, counted = (reduce(lambda a, b: a.unionByName(b), x) if x else None for x in (parts, plain))
    infinite = F.abs("v") == float("inf")
    # rows that can only be held against limits become a source of their own
    alone = infinite | F.col("t").isNull()
    long = long.select(
        "kind", "row_id", F.coalesce("t", F.lit(0.0)).alias("t"), F.when(infinite, 0.0).otherwise(F.col("v")).alias("v"),
        (F.col("low") | F.col("high") | infinite).alias("out"), F.when(alone, F.xxhash64("row_id", "kind")).otherwise(F.col("g")).alias("g"),
        F.when(alone, F.lit(2).cast("long")).otherwise(F.col("h")).alias("h"), alone.alias("alone"),
    )
    habits = [m.habit for m in tables]
    monthly = F.col("kind").isin([k for k, h in enumerate(habits) if h.monthly])
    # Irregular sources: single rows, hot sources in shards.
    single = long.where(~monthly)
    hot, many, largest = hot_sources(counted, ["g", "h"], shard_rows) if counted is not None else (None, 0, 0)
    if hot is not None:
        near = F.broadcast if many <= BROADCAST // 5 else (lambda df: df)
        heated = _judged_hot(single.join(near(hot.select("g", "h")), ["g", "h"], "left_semi"), hot, many, largest, habits, shard_rows, border)
        single = single.join(near(hot.select("g", "h")), ["g", "h"], "left_anti")
    ready = single.select("g", "h", "kind", "t", "v", "row_id", "out").repartition("g").sortWithinPartitions("g", "h", "t", "row_id")
    found = ready.mapInArrow(lambda it: _by_group(it, lambda x: _judge_rows(x, habits)), "kind byte, row_id long")
    if hot is not None:
        found = found.unionByName(heated)
    # Monthly sources: a point per month (its middle value), so that a source is as long as the calendar however often its
    # rows are repeated; rows then share the verdict of their month's point, or stand apart from its course themselves.
    rows = long.where(monthly)
    points = rows.where("NOT alone").groupBy("kind", "g", "h", "t").agg(F.percentile_approx("v", 0.5, 1000).alias("v"), F.count(F.lit(1)).alias("n"))
    judged = points.repartition("g").sortWithinPartitions("g", "h", "t").mapInArrow(lambda it: _by_group(it, lambda x: _judge_points(x, habits)), POINT)
    off = F.abs(F.col("v") - F.col("point"))
    shared = (off <= F.col("like")) | ((F.abs(F.col("v") - F.col("course")) > F.col("band")) & (off > F.col("spared")))
    by_month = rows.where("NOT alone AND NOT out").join(judged, ["kind", "g", "h", "t"]).where(shared)
    found = found.unionByName(by_month.select("kind", "row_id")).unionByName(rows.where("out").select("kind", "row_id"))
    names = F.element_at(F.array(*[F.lit(m.name) for m in tables]), F.col("kind").cast("int") + 1)
    return found.select(names.alias("table_name"), "row_id")
