"""The debounce cut inside a key: summaries of time slots, a prefix pass over them, and a second local pass.

A key's samples are cut to slots of ``SLOT_S`` seconds, and what a slot does to
what comes before it is put into a small summary.  Summaries of neighbouring
slots combine to that of both, so ``FAN`` slots make a block and ``FAN`` blocks
a larger one; going down again, every slot learns the state in which it begins.
Two such passes are made:

1. Streaks.  A summary has the last sample below the threshold before the first
   above, the first and last sample above, and the streak open at the end.
2. Cooldown.  A summary is a function of the time from which an event may come:
   for each candidate that can be the first event, the state in which the chain
   of events that it starts leaves the slot.  An earlier event blocks a slot's
   first ``cooldown_s`` at most, so only candidates in these, and the first
   beyond, can be first: the function's size does not grow with the block.

No task and no window holds a key; a task holds a slot's samples or the
summaries of ``FAN`` slots.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow import schema
from lanternflow.config import EVENT_TYPE, MIN_SAMPLES
from lanternflow.operators.debounce import KEY, Thresholds

#: Seconds of a slot; slots of a block, and levels of blocks (60 s in blocks of 4,096^2 are 31 years).
SLOT_S, FAN, LEVELS = 60.0, 4096, 2
NONE = math.nan
#: Seconds by which a slot's beginning may be off.
ROUNDING = 1e-6


@dataclass
class Streak:
    """The streak open at some time; ``n`` is 0 if there is none."""

    start: float = NONE
    frame: float = NONE
    last: float = NONE
    n: float = 0.0
    peak: float = 0.0

    def quiet(self, ts: float, gap: float) -> None:
        """A sample below the threshold."""
        if self.n and ts - self.last > gap:
            self.n = 0.0

    def add(self, ts: float, frame: float, score: float) -> None:
        if not self.n:
            self.start, self.frame, self.peak = ts, frame, score
        self.last, self.n, self.peak = ts, self.n + 1, max(self.peak, score)


@dataclass
class Part:
    """What a stretch of samples does to the streak before it.

    lead: the last sample below before the first above (or of all); tail: the
    streak at its end; one: nothing has broken the streak of its first
    above-sample, so a streak before it goes on in ``tail``; above: whether
    there is any.
    """

    lead: float = NONE
    above: float = 0.0
    one: float = 1.0
    start: float = NONE
    frame: float = NONE
    last: float = NONE
    n: float = 0.0
    peak: float = 0.0

    def tail(self) -> Streak:
        return Streak(self.start, self.frame, self.last, self.n, self.peak)

    def ending(self, s: Streak, one: bool) -> Part:
        return Part(self.lead, 1.0, float(one), s.start, s.frame, s.last, s.n, s.peak)

    @staticmethod
    def of(samples: Iterator[tuple], t: Thresholds) -> Part:
        out, s, one = Part(), Streak(), True
        for ts, frame, _, score, _ in samples:
            if score >= t.confidence:
                one = one and not (out.above and not s.n)
                s.add(ts, frame, score)
                out.above = 1.0
            elif out.above:
                s.quiet(ts, t.max_gap_s)
            else:
                out.lead = ts
        return out.ending(s, one) if out.above else out

    def then(self, later: Part, gap: float) -> Part:
        if not self.above:
            return Part(later.lead if later.lead == later.lead else self.lead, *astuple(later)[1:])
        s = self.tail()
        goes_on = later.carry(s, gap)
        return self.ending(s, bool(self.one and (goes_on or not later.above)))

    def carry(self, s: Streak, gap: float) -> bool:
        """Take a streak over this stretch, in place; whether it has gone on."""
        if self.lead == self.lead:
            s.quiet(self.lead, gap)
        if not self.above:
            return bool(s.n)
        goes_on = bool(s.n and self.one)
        if goes_on:
            s.last, s.peak = self.last, max(s.peak, self.peak)
            s.n = s.n + self.n if self.n else 0.0
        else:
            s.start, s.frame, s.last, s.n, s.peak = self.start, self.frame, self.last, self.n, self.peak
        return goes_on


def _numbers(x: Streak | Part) -> list[float]:
    return [float(v) for v in astuple(x)]


class Chain:
    """The cooldown over a stretch: of each candidate that can be its first event, the state after the last event.

    Candidates are (time, streak), a streak being named by its start, which
    grows from streak to streak; a state is (free, streak): the time from which
    an event may come, and the streak of the last event.
    """

    def __init__(self, flat: list[float]) -> None:
        self.ts, self.streak, self.free, self.after = flat[0::4], flat[1::4], flat[2::4], flat[3::4]

    def flat(self) -> list[float]:
        return [x for row in zip(self.ts, self.streak, self.free, self.after, strict=True) for x in row]

    def first(self, free: float, streak: float) -> int:
        """The first candidate of another streak that may be an event."""
        return max(bisect_left(self.ts, free), bisect_right(self.streak, streak))

    def carry(self, free: float, streak: float) -> tuple[float, float]:
        i = self.first(free, streak)
        return (self.free[i], self.after[i]) if i < len(self.ts) else (free, streak)

    def kept(self, begin: float, cooldown: float) -> Chain:
        """Only candidates that can be first, if no event before ``begin`` blocks longer than the cooldown."""
        i = bisect_left(self.ts, begin + cooldown + ROUNDING)
        # Beyond, the first one; and if the streak open at the beginning has had its event, the first of another.
        more = {i, max(i, bisect_right(self.streak, self.streak[0]))} if self.ts else set()
        flat = self.flat()
        return Chain(flat[: 4 * i] + [x for j in sorted(more) if j < len(self.ts) for x in flat[4 * j : 4 * j + 4]])

    @staticmethod
    def of(found: list[tuple[float, float]], t: Thresholds) -> Chain:
        """Candidates of a stretch in order of time."""
        out = Chain([])
        out.ts, out.streak = [c[0] for c in found], [c[1] for c in found]
        out.free, out.after = [ts + t.cooldown_s for ts in out.ts], list(out.streak)
        for i in range(len(found) - 1, -1, -1):
            j = out.first(out.free[i], out.streak[i])
            if j < len(found):
                out.free[i], out.after[i] = out.free[j], out.after[j]
        return out

    def then(self, later: Chain) -> Chain:
        ends = [later.carry(f, s) for f, s in zip(self.free, self.after, strict=True)]
        out = Chain([])
        out.ts, out.streak = self.ts + later.ts, self.streak + later.streak
        out.free, out.after = [f for f, _ in ends] + later.free, [s for _, s in ends] + later.after
        return out


Rows = Iterator[pd.DataFrame]
_KEY = "clip_id string, vehicle_track_id long"


def _groups(batches: Rows, n: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal first n columns, streamed."""
    rows = (r for pdf in batches for r in pdf.itertuples(index=False, name=None))
    return groupby(rows, key=lambda r: r[:n])


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(*KEY, "pos").sortWithinPartitions(*KEY, "pos", *order)


def _reduce(parts: DataFrame, combine: Callable[[list[tuple[int, list[float]]], int], list[float]]) -> DataFrame:
    """Parts (key, pos, x) to those of blocks of FAN positions."""

    def run(batches: Rows) -> Rows:
        for (clip, vehicle, pos), rows in _groups(batches, 3):
            yield pd.DataFrame([(clip, vehicle, pos, combine([(r[3], r[4]) for r in rows], pos))], columns=["clip_id", "vehicle_track_id", "pos", "x"])

    up = parts.select(*KEY, F.floor(F.col("pos") / FAN).alias("pos"), F.col("pos").alias("child"), "x")
    return _dealt(up, "child").mapInPandas(run, f"{_KEY}, pos long, x array<double>")


def _prefix(parts: DataFrame, idle: list[float], combine: Callable, carry: Callable[[list[float], list[float]], list[float]]) -> DataFrame:
    """The state (key, pos, x) in which each part begins."""
    levels = [parts]
    for level in range(LEVELS):
        levels.append(_reduce(levels[-1], lambda rows, pos, level=level: combine(rows, level)))

    def run(batches: Rows) -> Rows:
        for (clip, vehicle, _), rows in _groups(batches, 3):
            state, out = idle, []
            for r in rows:
                if r[3] is None or r[3] != r[3]:  # the state of the block comes first
                    state = r[4]
                    continue
                out.append((clip, vehicle, int(r[3]), state))
                state = carry(state, r[4])
            yield pd.DataFrame(out, columns=["clip_id", "vehicle_track_id", "pos", "x"])

    # Above the last level a key has few blocks, as a rule one.
    whole = levels[-1].select(*KEY, F.lit(0).cast("long").alias("pos"), F.col("pos").alias("child"), "x")
    states = _dealt(whole, "child").mapInPandas(run, f"{_KEY}, pos long, x array<double>")
    for parts in reversed(levels[:-1]):
        below = parts.select(*KEY, F.floor(F.col("pos") / FAN).alias("pos"), F.col("pos").alias("child"), "x")
        both = below.unionByName(states.withColumn("child", F.lit(None).cast("long")))
        states = _dealt(both, "child").mapInPandas(run, f"{_KEY}, pos long, x array<double>")
    return states


_SAMPLE = ["ts_s", "frame_idx", "vehicle_ord", "score", "track_ids"]
_FOUND = f"{_KEY}, pos long, ts_s double, streak double, frame_idx long, vehicle_ord long, start_frame_idx long, peak double, track_ids array<long>"


def _candidates(samples: DataFrame, t: Thresholds) -> DataFrame:
    """Above-samples that may be events, were it not for the cooldown."""
    gap = t.max_gap_s

    def summary(batches: Rows) -> Rows:
        for key, rows in _groups(batches, 3):
            yield pd.DataFrame([(*key, _numbers(Part.of((r[3:] for r in rows), t)))], columns=["clip_id", "vehicle_track_id", "pos", "x"])

    def combine(rows: list[tuple[int, list[float]]], level: int) -> list[float]:
        out = Part()
        for _, x in rows:
            out = out.then(Part(*x), gap)
        return _numbers(out)

    def carry(state: list[float], x: list[float]) -> list[float]:
        s = Streak(*state)
        Part(*x).carry(s, gap)
        return _numbers(s)

    def local(batches: Rows) -> Rows:
        for key, rows in _groups(batches, 3):
            s, out = Streak(), []
            for ts, frame, order, score, ids, state in (r[3:] for r in rows):
                if state is not None:
                    s = Streak(*state)
                elif score < t.confidence:
                    s.quiet(ts, gap)
                else:
                    s.add(ts, frame, score)
                    if s.n >= MIN_SAMPLES and ts - s.start >= t.min_duration_s:
                        out.append((*key, ts, s.start, int(frame), int(order), int(s.frame), s.peak, ids))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    parts = _dealt(samples.select(*KEY, "pos", *_SAMPLE), *_SAMPLE[:3]).mapInPandas(summary, f"{_KEY}, pos long, x array<double>")
    states = _prefix(parts, _numbers(Streak()), combine, carry)
    both = samples.select(*KEY, "pos", *_SAMPLE).unionByName(states.withColumnRenamed("x", "state"), allowMissingColumns=True)
    return _dealt(both, *(F.asc_nulls_first(c) for c in _SAMPLE[:3])).mapInPandas(local, _FOUND)


def debounce(samples: DataFrame, t: Thresholds = Thresholds(), slot_s: float = SLOT_S, event_type: str = EVENT_TYPE) -> DataFrame:
    """Events of each clip and vehicle, by the rules of ``operators.debounce``.

    ``max_gap_s`` and ``cooldown_s`` must not be negative, and samples have a
    time that is no null.
    """
    if t.max_gap_s < 0 or t.cooldown_s < 0:
        raise ValueError("max_gap_s and cooldown_s must not be negative")

    def summary(batches: Rows) -> Rows:
        for key, rows in _groups(batches, 3):
            yield pd.DataFrame([(*key, Chain.of([r[3:] for r in rows], t).kept(key[2] * slot_s, t.cooldown_s).flat())], columns=["clip_id", "vehicle_track_id", "pos", "x"])

    def combine(rows: list[tuple[int, list[float]]], level: int) -> list[float]:
        begin = rows[0][0] * FAN**level * slot_s
        # From the last to the first, so that what is kept stays short.
        out = Chain(list(rows[-1][1]))
        for _, x in reversed(rows[:-1]):
            out = Chain(list(x)).then(out)
            out = out.kept(out.ts[0] if out.ts else begin, t.cooldown_s)
        return out.flat()

    def carry(state: list[float], x: list[float]) -> list[float]:
        return list(Chain(list(x)).carry(*state))

    def local(batches: Rows) -> Rows:
        for (clip, _, _), rows in _groups(batches, 3):
            free, last, out = -math.inf, -math.inf, []
            for ts, streak, frame, _, start_frame, peak, ids, state in (r[3:] for r in rows):
                if state is not None:
                    free, last = state
                elif ts >= free and streak != last:
                    free, last = ts + t.cooldown_s, streak
                    out.append((clip, event_type, streak, ts, int(start_frame), int(frame), peak, ids))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.EVENTS.split(", ")])

    cut = samples.withColumn("pos", F.floor(F.col("ts_s") / F.lit(slot_s)).cast("long"))
    found = _candidates(cut, t)
    order = ["ts_s", "frame_idx", "vehicle_ord"]
    parts = _dealt(found, *order).select(*KEY, "pos", "ts_s", "streak").mapInPandas(summary, f"{_KEY}, pos long, x array<double>")
    states = _prefix(parts, [-math.inf, -math.inf], combine, carry)
    both = found.unionByName(states.withColumnRenamed("x", "state"), allowMissingColumns=True)
    return _dealt(both, *(F.asc_nulls_first(c) for c in order)).mapInPandas(local, schema.EVENTS)
