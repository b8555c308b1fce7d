"""Events of contacts: renewals, coordination sequences, and contacts around moves.

All start from contact runs: the spans of frames in which a pair is in contact without
a break.  Where the contacts are a table of runs (contacts.compound_pairs), these are taken; else one window by pair makes them.
"""

from __future__ import annotations

from heapq import heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewalk.functions.geometry import box_columns, min_image
from framewalk.operators.contacts import AXES, RUNS, block_of, contact_frames
from framewalk.operators.contacts import contact_runs as runs_of
from framewalk.operators.joins import with_totals
from framewalk.session import drop, importable, kept

#: Steps of a power iteration that are one job.
STEPS = 4
#: Shares that are broadcast.
FEW = 500_000


def contact_runs(contacts: DataFrame) -> DataFrame:
    """(ref, sel, start, stop): contact at start .. stop - 1."""
    return runs_of(contacts).select("ref", "sel", "start", "stop")


def longest_bound(start: np.ndarray, stop: np.ndarray, sel: np.ndarray) -> list[tuple[int, int, int]]:
    """(t0, stop, sel) of one compound's intervals, from its contact runs ordered by start.

    An interval opens when the compound is bound and none is open; its candidates are
    the partners at that frame.  It lasts until the last of them has gone; of those that go last the
    lowest number is recorded.  The next one opens in the same frame if there are partners.
    """
    out, open_, k, at = [], [], 0, 0  # open_ is a heap: of the runs that go last, the lowest number first
    while True:
        while k < len(start) and start[k] <= at:
            heappush(open_, (-int(stop[k]), int(sel[k])))
            k += 1
        if not open_ or -open_[0][0] <= at:
            open_.clear()
            if k == len(start):
                return out
            at = int(start[k])
            continue
        end = -open_[0][0]
        out.append((at, end, open_[0][1]))
        at = end


def deciding_runs(contacts: DataFrame) -> DataFrame:
    """(ref, sel, start, stop): of the runs of a reference compound that begin at one frame the longest, of the lowest number.

    At any frame the run that goes last, of the lowest number, is one of them, and so bound intervals and renewals of these contacts alone are those of all.
    """
    best = contact_runs(contacts).groupBy("ref", "start").agg(F.max(F.struct("stop", (-F.col("sel").cast("long")).alias("least"))).alias("b"))
    return best.select("ref", (-F.col("b.least")).alias("sel"), "start", F.col("b.stop").alias("stop"))


def bound_intervals(contacts: DataFrame) -> DataFrame:
    """(ref, sel, t0, stop) of longest_bound, for every reference compound.

    Of the runs that begin at one frame only the longest, of the lowest number, can ever decide: a compound's array has at most a run for each frame.
    """
    importable(contacts.sparkSession)

    @F.pandas_udf("array<struct<t0: int, stop: int, sel: bigint>>")
    def intervals(runs: pd.Series) -> pd.Series:
        def one(r):
            start, stop, sel = (np.array([x[c] for x in r]) for c in ("start", "stop", "sel"))
            return [{"t0": a, "stop": b, "sel": s} for a, b, s in longest_bound(start, stop, sel)]

        return runs.map(one)

    each = deciding_runs(contacts).groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("start", "sel", "stop"))).alias("runs"))
    return each.select("ref", F.explode(intervals("runs")).alias("r")).select("ref", "r.sel", "r.t0", "r.stop")


def coordination_sequence(contacts: DataFrame, refs: DataFrame, n_frames: int) -> DataFrame:
    """(cmp, frame, state): for each compound of refs(ref) and frame the partner bound the longest, -1 without one."""
    spans = bound_intervals(contacts).select("ref", F.explode(F.sequence(F.col("t0"), F.col("stop") - 1)).alias("frame"), "sel")
    grid = refs.select("ref").distinct().select("ref", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))).alias("frame"))
    return grid.join(spans, ["ref", "frame"], "left").select(F.col("ref").alias("cmp"), "frame", F.coalesce("sel", F.lit(-1)).cast("long").alias("state"))


def renewal_events(contacts: DataFrame, n_frames: int, ref_pos: DataFrame | None = None, sel_pos: DataFrame | None = None) -> DataFrame:
    """(ref, sel, t0, trenew[, positions at t0 and displacements]): intervals that neither begin at the first frame nor reach the last.

    Positions are (frame, ref|sel, x, y, z), unwrapped; they are joined at t0 and at the renewal only.
    """
    found = bound_intervals(contacts).where((F.col("t0") > 0) & (F.col("stop") < n_frames)).select("ref", "sel", "t0", (F.col("stop") - F.col("t0")).alias("trenew"))
    for side, pos in (("ref", ref_pos), ("sel", sel_pos)):
        if pos is None:
            continue
        start = pos.select(F.col(side), F.col("frame").alias("t0"), *(F.col(a).alias(f"{side}_{a}0") for a in AXES))
        stop = pos.select(F.col(side), F.col("frame").alias("_f"), *(F.col(a).alias(f"_{a}") for a in AXES))
        found = found.join(start, [side, "t0"]).withColumn("_f", F.col("t0") + F.col("trenew")).join(stop, [side, "_f"])
        found = found.withColumns({f"{side}_d{a}": F.col(f"_{a}") - F.col(f"{side}_{a}0") for a in AXES}).drop("_f", *(f"_{a}" for a in AXES))
    return found


def transition_matrix(events: DataFrame, start: Column, stop: Column) -> DataFrame:
    """(bin0, bin1, n, mean_trenew, prob): renewals by the bins of their start and end; prob sums to 1 over bin1.

    Bins that no event starts from are left out of both axes.
    """
    cells = events.select(start.alias("bin0"), stop.alias("bin1"), "trenew").groupBy("bin0", "bin1").agg(F.count("*").alias("n"), F.avg("trenew").alias("mean_trenew"))
    known = cells.select(F.col("bin0").alias("bin1")).distinct()
    cells = cells.join(known, "bin1", "left_semi")
    return cells.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("bin0")))


def stationary_distribution(matrix: DataFrame, tolerance: float = 1e-10, rounds: int = 2000) -> DataFrame:
    """(bin, share): the left eigenvector at eigenvalue 1 of transition_matrix, by power iteration.

    Shares and matrix stay tables: a step is their join and a grouped sum, the mean of it and of the shares before being taken, so that
    chains that go round in a circle come to rest, too.  A few steps are one job, whose result is written.  It ends when no share
    moves by more than the tolerance in a step.  Few shares (they are counted) are broadcast to the cells.  Of a matrix that falls into parts, each keeps the share it has when all
    bins are alike at the start.
    """
    cells = kept(matrix.select("bin0", "bin1", F.col("prob").cast("double").alias("prob")), "matrix")
    bins = cells.select(F.col("bin0").alias("bin")).union(cells.select(F.col("bin1").alias("bin"))).distinct()
    shares = kept(with_totals(bins, bins.agg(F.count("*").alias("_n"))).select("bin", (F.lit(1.0) / F.col("_n")).alias("share")), "shares")
    few = F.broadcast if shares.count() <= FEW else lambda x: x
    for _ in range(0, rounds, STEPS):
        after = shares
        for _ in range(STEPS):
            given = cells.join(few(after.select(F.col("bin").alias("bin0"), "share")), "bin0").groupBy(F.col("bin1").alias("bin")).agg(F.sum(F.col("share") * F.col("prob")).alias("_given"))
            after = after.select("bin", "share").join(few(given), "bin", "left").select("bin", F.col("share").alias("was"), ((F.col("share") + F.coalesce("_given", F.lit(0.0))) / 2).alias("share"))
        done = kept(after, "shares")
        drop(shares)
        shares = done
        if (shares.agg(F.max(F.abs(F.col("share") - F.col("was")))).first()[0] or 0.0) <= tolerance:
            return shares.select("bin", "share")
    raise RuntimeError(f"shares have not come to rest after {rounds} steps")


def with_previous_event(events: DataFrame, columns: list[str]) -> DataFrame:
    """events with the columns of the compound's event before, as prev_*."""
    w = Window.partitionBy("ref").orderBy("t0")
    return events.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def displacement_by_bin(events: DataFrame, bin_: Column, value: Column) -> DataFrame:
    """(bin, n, mean, var, se, msd, ngp) of a displacement by bin: se of the mean, mean square, non-Gaussian parameter in 1-d."""
    rows = events.select(bin_.alias("bin"), value.cast("double").alias("d"))
    square, fourth = F.avg(F.col("d") * F.col("d")), F.avg(F.pow("d", F.lit(4.0)))
    return rows.groupBy("bin").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("var"), (F.stddev_pop("d") / F.sqrt(F.count("d"))).alias("se"), square.alias("msd"), (F.try_divide(fourth, 3 * square * square) - 1).alias("ngp"))


def displacements_of_two_axes(events: DataFrame, bin_: Column, a: Column, b: Column) -> DataFrame:
    """(bin, n, corr, slope): how the displacements along two axes go together, and the slope of b over a; null where one of them is the same throughout."""
    rows = events.select(bin_.alias("bin"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    both = [F.when(known, F.col(c)) for c in ("a", "b")]  # corr itself divides by 0
    corr = F.try_divide(F.covar_pop(*both), F.stddev_pop(both[0]) * F.stddev_pop(both[1]))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), corr.alias("corr"), F.try_divide(F.covar_pop(*both), F.var_pop(both[0])).alias("slope"))


def occupancy_by_bin(events: DataFrame, bin_: Column) -> DataFrame:
    """(bin, weight, share): time spent by bin if positions change only at renewals."""
    cells = events.groupBy(bin_.alias("bin")).agg(F.sum("trenew").alias("weight"))
    return with_totals(cells, cells.agg(F.sum("weight").alias("_t"))).select("bin", "weight", (F.col("weight") / F.col("_t")).alias("share"))


def shared_partners(contacts: DataFrame, most: int) -> DataFrame:
    """(ref, f0, f1, common): in how many contacts a compound is at both of two frames at most so many apart; those that are in none do not appear.

    Only pairs in contact in several frames leave the partition of their block.  Meetings of compound_pairs are summed.
    """
    if "f0" in contacts.columns:
        return contacts.where((F.col("f1") > F.col("f0")) & (F.col("f1") - F.col("f0") <= most)).groupBy("ref", "f0", "f1").agg(F.sum("n").alias("common"))
    runs = runs_of(contacts)
    if RUNS in runs.columns:
        runs = runs.where((F.col(RUNS) > 1) | (F.col("stop") - F.col("start") > 1))
    spans = F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("stop") - 1)))
    frames = runs.groupBy(*block_of(runs), "ref", "sel").agg(spans.alias("fs")).where(F.size("fs") > 1)
    two = F.flatten(F.transform("fs", lambda a: F.transform(F.filter("fs", lambda b: (b > a) & (b <= a + most)), lambda b: F.struct(a.alias("f0"), b.alias("f1")))))
    return frames.select("ref", F.explode(two).alias("f")).groupBy("ref", "f.f0", "f.f1").agg(F.count("*").alias("common"))


def partner_numbers(contacts: DataFrame) -> DataFrame:
    """(frame, ref, n): partners of each compound that has some."""
    if "f0" in contacts.columns:
        return contacts.where("f0 = f1").groupBy(F.col("f0").alias("frame"), "ref").agg(F.sum("n").alias("n"))
    return contact_frames(contacts).groupBy("frame", "ref").agg(F.count("*").alias("n"))


def partner_stats(contacts: DataFrame) -> DataFrame:
    """(frame, ref, n, mean, var, min, max): partners of each compound that has some, and their numbers."""
    if "f0" not in contacts.columns:
        return contact_frames(contacts).groupBy("frame", "ref").agg(F.count("*").alias("n"), F.avg("sel").alias("mean"), F.var_pop("sel").alias("var"), F.min("sel").cast("double").alias("min"), F.max("sel").cast("double").alias("max"))
    part = F.struct("size", "total", "square")
    each = contacts.where("f0 = f1").groupBy(F.col("f0").alias("frame"), "ref").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.sort_array(F.collect_list(part)).alias("parts"), F.min("least").alias("min"), F.max("greatest").alias("max"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["total"])
    each = each.withColumn("mean", F.try_divide(total, F.col("size")))
    about = lambda p: F.try_divide(p["total"], p["size"]) - F.col("mean")
    square = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["square"] + F.coalesce(p["size"] * about(p) * about(p), F.lit(0.0)))
    return each.select("frame", "ref", "n", "mean", F.try_divide(square, F.col("size")).alias("var"), "min", "max")


def _once(contacts: DataFrame, *more: str) -> DataFrame:
    """Meetings, written once since they are read several times; other contacts as they are."""
    return kept(contacts.select("ref", "f0", "f1", "n", *more), "meetings") if "f0" in contacts.columns else contacts


def contacts_at_moves(contacts: DataFrame, dtrj: DataFrame, lag: int = 0) -> DataFrame:
    """(kind, n_events, before, after, common, attached, detached): contacts lag frames before and after frames with and without a move.

    dtrj is (cmp, frame, state) of the reference compounds.  At each frame t0 > lag whose t0 + lag exists, a
    compound stayed or moved (its state at t0 differs from that at t0 - 1) and is at t0 + lag in the state of
    t0 - 1 - lag or not; before is the contact count at t0 - 1 - lag, after at t0 + lag.
    """
    w = Window.partitionBy("cmp").orderBy("frame")
    first, last = F.lag("state", 1 + lag).over(w), F.lead("state", lag).over(w) if lag else F.col("state")
    rows = dtrj.select(F.col("cmp").alias("ref"), F.col("frame").alias("t0"), (F.col("state") != F.lag("state").over(w)).alias("moved"), first.alias("s0"), last.alias("s1")).where("s0 is not null and s1 is not null")
    rows = rows.select("ref", "t0", F.concat(F.when(F.col("moved"), "move").otherwise("stay"), F.when(F.col("s0") == F.col("s1"), F.lit("-same")).otherwise(F.lit("-different"))).alias("kind"))
    contacts = _once(contacts)
    each = kept(partner_numbers(contacts), "partners")
    before = each.select("ref", (F.col("frame") + 1 + lag).alias("t0"), F.col("n").alias("before"))
    after = each.select("ref", (F.col("frame") - lag).alias("t0"), F.col("n").alias("after"))
    both = shared_partners(contacts, 1 + 2 * lag).where(F.col("f1") - F.col("f0") == 1 + 2 * lag).select("ref", (F.col("f0") + 1 + lag).alias("t0"), "common")
    joined = rows.join(before, ["ref", "t0"], "left").join(after, ["ref", "t0"], "left").join(both, ["ref", "t0"], "left").fillna(0, ["before", "after", "common"])
    return joined.groupBy("kind").agg(F.count("*").alias("n_events"), F.sum("before").alias("before"), F.sum("after").alias("after"), F.sum("common").alias("common"), F.sum(F.col("after") - F.col("common")).alias("attached"), F.sum(F.col("before") - F.col("common")).alias("detached"))


def block_transitions(dtrj: DataFrame, min_block: int, max_gap: int) -> DataFrame:
    """(cmp, frame, gap, kind): moves from one run of at least min_block frames to the next such run.

    frame is the last of the first run, gap the frames of the shorter runs between, kind
    left2right, right2left, or with a first step up or down that did not succeed l2r_unsucc, r2l_unsucc.
    Moves with a gap of more than max_gap frames are left out.
    """
    from framewalk.operators.states import runs

    q = Window.partitionBy("cmp").orderBy("run")
    each = runs(dtrj).select("cmp", "run", "state", "t0", "len", "next_state")
    valid = each.where(F.col("len") >= min_block).select("cmp", "run", "state", "t0", "len", "next_state", F.lead("state").over(q).alias("to"), F.lead("t0").over(q).alias("to_t0"))
    moves = valid.where("to is not null").select("cmp", (F.col("t0") + F.col("len") - 1).cast("int").alias("frame"), (F.col("to_t0") - F.col("t0") - F.col("len")).cast("int").alias("gap"), "state", "next_state", "to")
    kind = F.when(F.col("state") < F.col("to"), "left2right").when(F.col("state") > F.col("to"), "right2left").when(F.col("next_state") > F.col("state"), "l2r_unsucc").otherwise("r2l_unsucc")
    return moves.where(F.col("gap") <= max_gap).select("cmp", "frame", "gap", kind.alias("kind"))


def _farthest(rows: DataFrame) -> int:
    return rows.agg(F.max(F.col("f1") - F.col("f0"))).first()[0] or 0


def contacts_at_block_transitions(contacts: DataFrame, moves: DataFrame, lag: int = 0) -> DataFrame:
    """(kind, n_events, avg_before, avg_after, avg_common, avg_attached, avg_detached) for the moves of block_transitions.

    before is taken at frame - lag, after at frame + gap + 1 + lag.
    """
    rows = moves.select(F.col("cmp").alias("ref"), "frame", "gap", "kind").withColumns({"f0": F.col("frame") - lag, "f1": F.col("frame") + F.col("gap") + 1 + lag})
    contacts = _once(contacts)
    each = kept(partner_numbers(contacts), "partners")
    before, after = (each.select("ref", F.col("frame").alias(f), F.col("n").alias(name)) for f, name in (("f0", "b"), ("f1", "a")))
    both = shared_partners(contacts, _farthest(rows)).withColumnRenamed("common", "c")
    full = rows.join(before, ["ref", "f0"], "left").join(after, ["ref", "f1"], "left").join(both, ["ref", "f0", "f1"], "left").fillna(0, ["a", "b", "c"])
    return full.groupBy("kind").agg(F.count("*").alias("n_events"), F.avg("b").alias("avg_before"), F.avg("a").alias("avg_after"), F.avg("c").alias("avg_common"), F.avg(F.col("a") - F.col("c")).alias("avg_attached"), F.avg(F.col("b") - F.col("c")).alias("avg_detached"))


def block_transitions_with_history(dtrj: DataFrame, min_block: int, max_gap: int) -> DataFrame:
    """(cmp, frame, gap, kind, prev, valid, counted): moves between runs of at least min_block frames, with the state of the such run before.

    kind is unsuccessful (back to the same state), left2right or right2left; a move is valid if its gap has at
    most max_gap frames, and counted if that holds for the gap before, too.  The first such run of a compound has no history
    and gives no row.
    """
    from framewalk.operators.states import runs

    q = Window.partitionBy("cmp").orderBy("run")
    end = F.col("t0") + F.col("len")
    long = runs(dtrj).where(F.col("len") >= min_block).select(
        "cmp", "run", "state", (end - 1).cast("int").alias("frame"), (F.lead("t0").over(q) - end).cast("int").alias("gap"), F.lead("state").over(q).alias("to"),
        F.lag("state").over(q).alias("prev"), (F.col("t0") - F.lag(end).over(q)).cast("int").alias("gap_before"),
    )
    kind = F.when(F.col("state") == F.col("to"), "unsuccessful").when(F.col("state") < F.col("to"), "left2right").otherwise("right2left")
    valid = F.col("gap") <= max_gap
    return long.where("prev is not null and to is not null").select("cmp", "frame", "gap", kind.alias("kind"), "prev", valid.alias("valid"), (valid & (F.col("gap_before") <= max_gap)).alias("counted"))


def partners_at_block_transitions(contacts: DataFrame, moves: DataFrame, lag: int = 0) -> DataFrame:
    """(kind, prev, ...) for the moves of block_transitions_with_history: numbers of moves, mean gaps, and of counted moves the mean
    numbers of partners detached, attached and remaining, the mean, variance, least and largest partner number before and after
    (of bound compounds), and their mean absolute change (of those bound both times).
    """
    contacts = _once(contacts, "size", "total", "square", "least", "greatest")
    rows = moves.withColumnRenamed("cmp", "ref").withColumns({"f0": F.col("frame") - lag, "f1": F.col("frame") + F.col("gap") + 1 + lag})
    each = kept(partner_stats(contacts), "partners")
    side = lambda f, tag: each.select(F.col("frame").alias(f), "ref", *(F.col(c).alias(f"{c}_{tag}") for c in ("n", "mean", "var", "min", "max")))
    both = shared_partners(contacts, _farthest(rows.where("counted")))
    full = rows.join(side("f0", "before"), ["ref", "f0"], "left").join(side("f1", "after"), ["ref", "f1"], "left").join(both, ["ref", "f0", "f1"], "left").fillna(0, ["n_before", "n_after", "common"])
    of = lambda c: F.when(F.col("counted"), c)
    stats = [F.avg(of(F.col(f"{c}_{tag}"))).alias(f"{c}_{tag}") for tag in ("before", "after") for c in ("mean", "var", "min", "max")]
    changes = [F.avg(of(F.abs(F.col(f"{c}_before") - F.col(f"{c}_after")))).alias(f"{c}_change") for c in ("mean", "var", "min", "max")]
    return full.groupBy("kind", "prev").agg(
        F.count("*").alias("n_moves"), F.count_if("valid").alias("n_valid"), F.count_if("counted").alias("n_counted"),
        F.avg("gap").alias("gap"), F.avg(F.when(F.col("valid"), F.col("gap"))).alias("gap_valid"), F.avg(of(F.col("gap"))).alias("gap_counted"),
        F.avg(of(F.col("n_before") - F.col("common"))).alias("detached"), F.avg(of(F.col("n_after") - F.col("common"))).alias("attached"), F.avg(of(F.col("common"))).alias("remain"),
        *stats, *changes,
    )


def msd_at_coordination_change(positions: DataFrame, changes: DataFrame) -> DataFrame:
    """(dt, n, msd): square displacement of compounds between consecutive coordination changes, by their distance in frames.

    changes has (frame, ref): the frames at which a compound's partners change (see attach_detach); the
    first frame starts the first interval.  positions has (frame, ref, x, y, z).
    """
    starts = positions.where("frame = 0").select("frame", "ref")
    w = Window.partitionBy("ref").orderBy("frame")
    marks = changes.where("frame > 0").select("frame", "ref").unionByName(starts).join(positions, ["frame", "ref"])
    square = sum(((F.col(a) - F.lag(a).over(w)) * (F.col(a) - F.lag(a).over(w)) for a in AXES), F.lit(0.0))
    steps = marks.select((F.col("frame") - F.lag("frame").over(w)).alias("dt"), square.alias("d2")).where("dt is not null")
    return steps.groupBy("dt").agg(F.count("*").alias("n"), F.avg("d2").alias("msd"))


def contact_hists_at_moves(counts: DataFrame, refs: DataFrame, dtrj: DataFrame) -> DataFrame:
    """(moved, n, diff, same, tot, pair): contact histograms of the compounds that changed their state since the frame before, and of those that did not.

    counts is (frame, ref, sel, n), refs (frame, ref), dtrj (cmp, frame, state) of the reference compounds.
    """
    from framewalk.operators.contacts import hists_of_levels, levels

    w = Window.partitionBy("cmp").orderBy("frame")
    flags = dtrj.select("frame", F.col("cmp").alias("ref"), (F.col("state") != F.lag("state").over(w)).alias("moved")).where("moved is not null")
    return hists_of_levels(kept(levels(counts), "levels").join(flags, ["frame", "ref"]), refs.join(flags, ["frame", "ref"]), ["moved"])


def events_by_bin(events: DataFrame, bin_: Column, compounds: DataFrame | None = None) -> DataFrame:
    """(bin, n, error[, rate]): events by bin with Poisson errors; compounds has (bin, weight), the mean number of compounds in a bin, to divide by."""
    made = events.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sqrt(F.count("*")).alias("error"))
    if compounds is None:
        return made
    return made.join(compounds, "bin", "left").select("bin", "n", "error", F.try_divide(F.col("n").cast("double"), F.col("weight")).alias("rate"))


def topological_map(positions: DataFrame, center: DataFrame, cutoff: float, boxes: DataFrame, levels: list[str]) -> DataFrame:
    """(frame, n_atoms, and the sorted numbers of each level): what lies within a cutoff of one point in each frame.

    positions has (frame, atom, levels, x, y, z), center one row a frame (frame, x, y, z).
    """
    box = box_columns(boxes.columns)
    rows = positions.join(center.select("frame", *(F.col(a).alias(f"c{a}") for a in AXES)), "frame").join(boxes.select("frame", *box), "frame")
    squared = sum((d * d for d in min_image([F.col(a) - F.col(f"c{a}") for a in AXES], box)), F.lit(0.0))
    near = rows.where(squared <= cutoff * cutoff)
    return near.groupBy("frame").agg(F.count("*").alias("n_atoms"), *(F.array_sort(F.collect_set(k)).alias(k) for k in levels))
