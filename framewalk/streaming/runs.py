"""State sequences and contacts as streams: runs, gap filling, renewals and histograms.

A stream of states has (cmp, frame, state, ts): the frames of a compound in order, each with its event time.
A compound's open run, interval or gap is its state in the stream.  Where a watermark is set, a compound that
sends nothing until the watermark has passed its last event time is over: what is open
is given out, marked as cut off by the end of observation, and its state is removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewalk.operators.contacts import AXES
from framewalk.operators.repair import fill_gaps
from framewalk.session import importable

RUN = "cmp long, state int, t0 int, len int, is_first boolean, is_last boolean"
RENEWAL = "ref long, sel long, t0 int, trenew int, is_first boolean, is_last boolean"
PLACED = "ref long, sel long, t0 int, trenew int, us long, " + ", ".join(f"{k} double" for k in (*(f"ref_{a}0" for a in AXES), *(f"ref_d{a}" for a in AXES), *(f"sel_{a}0" for a in AXES)))


def _stateful(stream: DataFrame, key: str, ts: str | None, late: str | None, out: str, held: str, step: Callable, end: Callable) -> DataFrame:
    """A group's rows in order of frame through step(key, rows, state) -> (rows, state), and end(key, state) -> rows at its timeout."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    importable(stream.sparkSession)
    timed = ts is not None and late is not None
    names = [x.split()[0] for x in out.split(", ")]

    def go(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            rows = end(group[0], state.get)
            state.remove()
        else:
            got = pd.concat(list(batches)).sort_values("frame")
            rows, new = step(group[0], got, state.get if state.exists else None)
            state.update(new)
            if timed:
                last = int(got["_ts"].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(rows, columns=names)

    rows = stream.withColumn("_ts", F.col(ts)).withWatermark("_ts", late) if timed else stream
    return rows.groupBy(key).applyInPandasWithState(go, out, held, "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout)


def stream_runs(states: DataFrame, ts: str | None = None, late: str | None = None) -> DataFrame:
    """(cmp, state, t0, len, is_first, is_last) of a stream (cmp, frame, state[, ts]): a run comes out when the next one begins.

    With ts and late (the watermark's delay) a compound's last run comes out at its timeout, with is_last; without them it
    is never given out.
    """

    def step(cmp, rows: pd.DataFrame, held):
        frames, values = rows["frame"].to_numpy(), rows["state"].to_numpy()
        cuts = np.flatnonzero(np.diff(values)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(values)]
        runs = [[int(values[a]), int(frames[a]), int(b - a)] for a, b in zip(starts, ends)]
        first = held is None or held[3]
        if held is not None:
            if held[0] == runs[0][0]:
                runs[0] = [held[0], held[1], held[2] + runs[0][2]]
            else:
                runs.insert(0, list(held[:3]))
        out = [(cmp, *r, first and k == 0, False) for k, r in enumerate(runs[:-1])]
        return out, (*runs[-1], first and len(runs) == 1)

    def end(cmp, held):
        return [(cmp, *held, True)]

    chosen = states.select("cmp", F.col("frame").cast("int").alias("frame"), F.col("state").cast("int").alias("state"), *([ts] if ts else []))
    return _stateful(chosen, "cmp", ts, late, RUN, "state int, t0 int, len int, first boolean", step, end)


def stream_filled(states: DataFrame, intermittency: int, ts: str | None = None, late: str | None = None) -> DataFrame:
    """(cmp, frame, state) with gaps of at most intermittency frames filled, as correct_intermittency does.

    A frame comes out when no later one can change it, intermittency frames on; the last ones come out at the timeout.
    """

    def step(cmp, rows: pd.DataFrame, held):
        start, states_ = (int(rows["frame"].iloc[0]), []) if held is None else (held[0], list(held[1]))
        values = np.array(states_ + rows["state"].tolist(), np.int32)
        done = max(0, len(values) - intermittency - 1)  # frames whose own window has come
        out = fill_gaps(values, intermittency, done)
        return [(cmp, start + k, int(s)) for k, s in enumerate(out[:done])], (start + done, out[done:].tolist())

    def end(cmp, held):
        return [(cmp, held[0] + k, int(s)) for k, s in enumerate(fill_gaps(np.array(held[1], np.int32), intermittency))]

    chosen = states.select("cmp", F.col("frame").cast("int").alias("frame"), F.col("state").cast("int").alias("state"), *([ts] if ts else []))
    return _stateful(chosen, "cmp", ts, late, "cmp long, frame int, state int", "start int, states array<int>", step, end)


def renewed(t0: int, left: set, frame: int, here: set) -> tuple[int, set, int | None]:
    """(t0, left, ended): the interval open after a frame with the partners here, and the partner of the one that ended at it, if one did."""
    if t0 >= 0 and left & here:
        return t0, left & here, None
    return (frame, here, min(left, default=None)) if here else (-1, here, min(left, default=None))


def stream_renewals(partners: DataFrame, ts: str | None = None, late: str | None = None) -> DataFrame:
    """(ref, sel, t0, trenew, is_first, is_last): the bound intervals of a stream (ref, frame, sels[, ts]).

    sels is the array of a compound's partners at a frame, empty without one; frames are dense.  The rule is that of
    events.longest_bound.  is_first marks an interval that was open at the first frame, is_last one that was
    open when observation ended: both are cut off.
    """

    def step(ref, rows: pd.DataFrame, held):
        t0, left, first = (-1, set(), -1) if held is None else (held[0], set(held[1]), held[2])
        out = []
        for frame, sels in zip(rows["frame"].tolist(), rows["sels"]):
            here = set(map(int, sels)) if sels is not None else set()
            first, began = frame if first < 0 else first, t0
            t0, left, ended = renewed(t0, left, frame, here)
            if ended is not None:
                out.append((ref, ended, began, frame - began, began == first, False))
        return out, (t0, sorted(left), first, int(rows["frame"].iloc[-1]))

    def end(ref, held):
        t0, left, first, last = held
        return [(ref, min(left), t0, last + 1 - t0, t0 == first, True)] if t0 >= 0 else []

    chosen = partners.select("ref", F.col("frame").cast("int").alias("frame"), F.col("sels").cast("array<bigint>").alias("sels"), *([ts] if ts else []))
    return _stateful(chosen, "ref", ts, late, RENEWAL, "t0 int, sels array<bigint>, first int, last int", step, end)


def stream_placed_renewals(partners: DataFrame, ts: str, late: str) -> DataFrame:
    """(ref, sel, t0, trenew, ts, ref_x0 .., ref_dx .., sel_x0 ..): renewals of a stream (ref, frame, x, y, z, sels, ts) with positions at t0.

    sels is an array of (sel, x, y, z).  ts is the time of the renewal.  What is open at the first frame or at the end is
    left out, as in events.renewal_events, and so is a renewal without a position of the reference compound at either
    end or of the partner at t0.  A compound's state is its position and those of its candidates when its interval
    began: it grows with the candidates, not with the frames.  The partner's move needs with_partner_moves.
    """

    def step(ref, rows: pd.DataFrame, held):
        t0, left, first, at, places = (-1, set(), -1, [], {}) if held is None else (held[0], set(held[1]), held[2], held[3], dict(zip(held[4], zip(*[iter(held[5])] * 3))))
        out = []
        for frame, us, sels, xyz, *here_at in rows[["frame", "_us", "sels", "xyz", *AXES]].itertuples(index=False):
            frame, first, began = int(frame), int(frame) if first < 0 else first, t0
            here = set() if sels is None else set(map(int, sels))
            t0, left, ended = renewed(t0, left, frame, here)
            if ended is not None and began != first:
                numbers = [*at, *(b - a for a, b in zip(at, here_at)), *places[ended]]
                if not np.isnan(numbers).any():
                    out.append((ref, ended, began, frame - began, int(us), *numbers))
            if t0 == frame:
                at = list(map(float, here_at))
                places = dict(zip(map(int, sels), zip(*[iter(map(float, xyz))] * 3)))
        return out, (t0, sorted(left), first, at, [s for s in places if s in left], [x for s, p in places.items() if s in left for x in p])

    nan = F.lit(float("nan"))
    flat = F.flatten(F.transform("sels", lambda s: F.array(*(F.coalesce(s[a].cast("double"), nan) for a in AXES))))
    chosen = partners.select("ref", F.col("frame").cast("int").alias("frame"), *(F.coalesce(F.col(a).cast("double"), nan).alias(a) for a in AXES), F.transform("sels", lambda s: s["sel"].cast("long")).alias("sels"), flat.alias("xyz"), F.unix_micros(ts).alias("_us"), ts)
    made = _stateful(chosen, "ref", ts, late, PLACED, "t0 int, sels array<bigint>, first int, at array<double>, of array<bigint>, places array<double>", step, lambda ref, held: [])
    return made.withColumn("ts", F.timestamp_micros("us")).drop("us")


def with_partner_moves(renewals: DataFrame, sel_pos: DataFrame, late: str) -> DataFrame:
    """stream_placed_renewals(..) with sel_dx, sel_dy, sel_dz, from the stream of positions (sel, frame, x, y, z, ts).

    A join of two streams at the renewal's own time, so that the watermark bounds what either side holds.  renewals is read from
    where the other query writes it: two operators with state of their own and timeouts cannot be in one query.
    Renewals without a position of their partner at the time are left out.
    """
    left = renewals.withWatermark("ts", late)
    right = sel_pos.select(F.col("sel").alias("_sel"), F.col("ts").alias("_ts"), *(F.col(a).alias(f"_{a}") for a in AXES)).withWatermark("_ts", late)
    made = left.join(right, F.expr("sel = _sel and ts = _ts")).where(" and ".join(f"_{a} is not null" for a in AXES))
    return made.select(*renewals.columns, *((F.col(f"_{a}") - F.col(f"sel_{a}0")).alias(f"sel_d{a}") for a in AXES))


def stream_contact_hist(contacts: DataFrame, ts: str, window: str, late: str) -> DataFrame:
    """(start, n, count): by window of event time, how many reference compounds have n contacts in one frame.

    Two aggregations of a stream (frame, ref, sel, ts): contacts by frame and compound, then compounds by their number; a
    window comes out when the watermark has passed it.
    """
    timed = contacts.withWatermark(ts, late)
    each = timed.groupBy(F.window(ts, window).alias("_w"), "frame", "ref").agg(F.count("*").alias("n"))
    made = each.groupBy(F.window(F.window_time("_w"), window).alias("_v"), "n").agg(F.count("*").alias("count"))
    return made.select(F.col("_v.start").alias("start"), "n", "count")


def windowed_counts(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """(start, key, n): events in windows of event time, those later than `late` being dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("_w"), key).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), key, "n")
