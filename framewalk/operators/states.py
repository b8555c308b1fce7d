"""State sequences: runs, transitions, lifetimes, rates, survival and return.

A state sequence ("dtrj") is a table (cmp, frame, state): one row for each compound
and frame, frames being dense from 0; compounds may differ in length.  Negative states mean "nowhere".  Nearly all
below are aggregates of the runs of equal states, made by one window sort on cmp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewalk.operators import changes
from framewalk.operators.lags import at_least, in_runs, lag_pairs, run_overlaps


def _flags(discard_neg_start: bool, discard_all_neg: bool) -> None:
    if discard_neg_start and discard_all_neg:
        raise ValueError("discard_neg_start and discard_all_neg are mutually exclusive")


def n_frames_of(dtrj: DataFrame) -> int:
    return (dtrj.agg(F.max("frame")).first()[0] or 0) + 1


def runs(dtrj: DataFrame) -> DataFrame:
    """(cmp, run, state, t0, len, is_first, is_last, next_state, next2_state, next_t0, next2_t0, same_t0).

    next* are those of the compound's next runs, same_t0 is the start of its next run in
    the same state.  The window over the runs reuses the partitioning by cmp.
    """
    w = Window.partitionBy("cmp").orderBy("frame")
    q = Window.partitionBy("cmp").orderBy("run")
    changed = F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(0))
    numbered = dtrj.select("cmp", "frame", "state", changed.alias("c")).select("cmp", "frame", "state", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    each = numbered.groupBy("cmp", "run").agg(F.first("state").alias("state"), F.min("frame").alias("t0"), F.count("*").alias("len"))
    return each.select(
        "cmp", "run", "state", "t0", "len",
        F.lag("run").over(q).isNull().alias("is_first"), F.lead("run").over(q).isNull().alias("is_last"),
        F.lead("state").over(q).alias("next_state"), F.lead("state", 2).over(q).alias("next2_state"),
        F.lead("t0").over(q).alias("next_t0"), F.lead("t0", 2).over(q).alias("next2_t0"),
        F.lead("t0").over(Window.partitionBy("cmp", "state").orderBy("run")).alias("same_t0"),
    )


def locate_trans(dtrj: DataFrame, discard_neg: str | None = None, trans_type=None, wrap: bool = False, tfft: bool = False, tlft: bool = False, mic: bool = False, min_state: int | None = None, max_state: int | None = None) -> DataFrame:
    """dtrj with booleans trans_start (last frame before) and trans_end (first frame after a transition)."""
    found = changes.locate_changes(dtrj, ["cmp"], "frame", "state", discard_neg, trans_type, 0.0, 0.0, wrap, tfft, tlft, mic, min_state, max_state)
    return found.withColumnsRenamed({"before": "trans_start", "after": "trans_end", "change_type": "trans_type"})


def trans_ix(dtrj: DataFrame, pin: str = "end", **options) -> DataFrame:
    """The (cmp, frame, state) rows at which transitions start or end; with pin "both" each has a column pin that tells which."""
    if pin not in ("start", "end", "both"):
        raise ValueError(f"unknown pin {pin!r}")
    found = locate_trans(dtrj, **options)
    if pin == "both":
        found = changes.either_end(found, {"start": "trans_start", "end": "trans_end"})
    else:
        found = found.where(F.col(f"trans_{pin}"))
    return found.drop("trans_start", "trans_end")


def _state_range(dtrj: DataFrame, min_state: int | None, max_state: int | None) -> tuple[int, int]:
    if min_state is None or max_state is None:
        low, high = dtrj.agg(F.min("state"), F.max("state")).first()
        min_state, max_state = low if min_state is None else min_state, high if max_state is None else max_state
    if max_state <= min_state:
        raise ValueError("max_state must be greater than min_state")
    return min_state, max_state


def _kinds(options: dict) -> Column:
    """The types of transitions asked for, a row each."""
    return F.explode(F.array(*map(F.lit, changes.type_names(options.get("trans_type")))))


def trans_per_state(dtrj: DataFrame, min_state: int | None = None, max_state: int | None = None, **options) -> DataFrame:
    """(state, [trans_type,] n_start, n_end): transitions out of and into each state, zeros included."""
    low, high = _state_range(dtrj, min_state, max_state)
    found = locate_trans(dtrj, min_state=min_state, max_state=max_state, **options)
    keys = ["trans_type"] if "trans_type" in found.columns else []
    counts = found.groupBy("state", *keys).agg(F.count_if("trans_start").alias("n_start"), F.count_if("trans_end").alias("n_end"))
    states = dtrj.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("state"))
    grid = states.withColumn("trans_type", _kinds(options)) if keys else states
    return grid.join(counts, ["state", *keys], "left").fillna(0, ["n_start", "n_end"])


def trans_per_state_vs_time(dtrj: DataFrame, n_frames: int | None = None, min_state: int | None = None, max_state: int | None = None, **options) -> DataFrame:
    """(state, frame, [trans_type,] n_start, n_end) for every state of the range and every frame."""
    low, high = _state_range(dtrj, min_state, max_state)
    n = n_frames or n_frames_of(dtrj)
    found = locate_trans(dtrj, min_state=min_state, max_state=max_state, **options)
    keys = ["trans_type"] if "trans_type" in found.columns else []
    counts = found.groupBy("state", "frame", *keys).agg(F.count_if("trans_start").alias("n_start"), F.count_if("trans_end").alias("n_end"))
    grid = dtrj.sparkSession.range(n).select(F.col("id").cast("int").alias("frame"), F.explode(F.sequence(F.lit(low), F.lit(high))).alias("state"))
    if keys:
        grid = grid.withColumn("trans_type", _kinds(options))
    return grid.join(counts, ["state", "frame", *keys], "left").fillna(0, ["n_start", "n_end"])


def trans_counts_cumulative(per_frame: DataFrame) -> DataFrame:
    """trans_per_state_vs_time with running sums over the frames."""
    w = Window.partitionBy("state").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return per_frame.withColumns({"n_start": F.sum("n_start").over(w), "n_end": F.sum("n_end").over(w)})


def _valid(discard_neg_start: bool, discard_all_neg: bool) -> Column:
    """Which runs count."""
    _flags(discard_neg_start, discard_all_neg)
    if discard_all_neg:
        return (F.col("state") >= 0) & (F.coalesce(F.col("next_state"), F.lit(0)) >= 0)
    return F.col("state") >= 0 if discard_neg_start else F.lit(True)


def lifetimes(dtrj: DataFrame, uncensored: bool = False, discard_neg_start: bool = False, discard_all_neg: bool = False) -> DataFrame:
    """(cmp, state, t0, lifetime): the lengths of the runs.

    uncensored leaves out each compound's first and last run; discard_all_neg also
    leaves out runs that are followed by a negative one.
    """
    found = runs(dtrj).where(_valid(discard_neg_start, discard_all_neg))
    if uncensored:
        found = found.where("not is_first and not is_last")
    return found.select("cmp", "state", "t0", F.col("len").alias("lifetime"))


def lifetime_counts(dtrj: DataFrame, **options) -> DataFrame:
    """(state, lifetime, n): how often each lifetime occurs; as many rows as there are different ones."""
    return lifetimes(dtrj, **options).groupBy("state", "lifetime").agg(F.count("*").alias("n"))


def lifetimes_per_state(dtrj: DataFrame, ddof: int = 0, lists: bool = False, **options) -> DataFrame:
    """(state, n, avg, std, total[, lifetimes]): the lifetimes of each state.

    lists adds them as an array, by compound and start: one row then holds all of a state's.
    """
    each = lifetimes(dtrj, **options)
    std = F.stddev_samp("lifetime") if ddof == 1 else F.stddev_pop("lifetime")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("cmp", "t0", "lifetime"))), lambda x: x["lifetime"])
    return each.groupBy("state").agg(F.count("*").alias("n"), F.avg("lifetime").alias("avg"), std.alias("std"), F.sum("lifetime").alias("total"), *([ordered.alias("lifetimes")] if lists else []))


def _rate(found: DataFrame, *keys: str) -> DataFrame:
    made = found.groupBy(*keys).agg(F.count_if(~F.col("is_last")).alias("n_trans"), F.sum("len").alias("n_frames"))
    return made.withColumn("rate", F.try_divide(F.col("n_trans"), F.col("n_frames")))


def trans_rate_tot(dtrj: DataFrame, discard_neg_start: bool = False, discard_all_neg: bool = False) -> DataFrame:
    """(n_trans, n_frames, rate) over all compounds and states."""
    return _rate(runs(dtrj).where(_valid(discard_neg_start, discard_all_neg)))


def trans_rate(dtrj: DataFrame, discard_neg_start: bool = False, discard_all_neg: bool = False) -> DataFrame:
    """(cmp, n_trans, n_frames, rate); compounds without a valid run do not appear."""
    return _rate(runs(dtrj).where(_valid(discard_neg_start, discard_all_neg)), "cmp")


def trans_rate_per_state(dtrj: DataFrame, discard_neg_start: bool = False, discard_all_neg: bool = False) -> DataFrame:
    """(state, n_trans, n_frames, rate); states without a valid run do not appear."""
    return _rate(runs(dtrj).where(_valid(discard_neg_start, discard_all_neg)), "state")


def with_state2(found: DataFrame, dtrj2: DataFrame, at: Column) -> DataFrame:
    """Rows with the second sequence's state at the frame `at`, as state2."""
    second = dtrj2.select(F.col("cmp").alias("_c"), F.col("frame").alias("_f"), F.col("state").alias("state2"))
    return found.join(second, (F.col("cmp") == F.col("_c")) & (at == F.col("_f"))).drop("_c", "_f")


def n_leaves_vs_time(dtrj: DataFrame, dtrj2: DataFrame | None = None, n_frames: int | None = None, discard_neg_start: bool = False, discard_all_neg: bool = False) -> DataFrame:
    """([state2,] t, n_leaves, n_risk) for t = 0 .. n_frames - 1.

    n_risk counts the runs of at least t frames, n_leaves those of exactly t frames that
    are neither the first nor the last of their compound.  With discard_all_neg, leaving
    into a negative state counts as an end of observation.  With a second sequence the
    counts are kept apart by its state at the run's start, and first runs are left out.
    The runs are counted by length before anything else, so that what follows is small.
    """
    _flags(discard_neg_start, discard_all_neg)
    n = n_frames or n_frames_of(dtrj)
    found = runs(dtrj)
    keys = []
    if dtrj2 is not None:
        found, keys = with_state2(found.where("not is_first"), dtrj2, F.col("t0")), ["state2"]
    if discard_neg_start or discard_all_neg:
        found = found.where("state >= 0")
    leaves = ~F.col("is_first") & ~F.col("is_last")
    if discard_all_neg:
        leaves = leaves & (F.col("next_state") >= 0)
    # runs as long as the whole sequence are at risk at all times: they are put at t = n, which is left out at the end
    by_length = found.groupBy(*keys, F.least(F.col("len"), F.lit(n)).alias("t")).agg(F.count_if(leaves).alias("n_leaves"), F.count("*").alias("n"))
    if keys:
        grid = dtrj2.select(F.col("state").alias("state2")).distinct().select("state2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))).alias("t"))
    else:
        grid = dtrj.sparkSession.range(n + 1).select(F.col("id").alias("t"))
    later = Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    risk = F.coalesce(F.sum("n").over(later), F.lit(0))
    joined = grid.join(by_length, [*keys, "t"], "left")
    return joined.select(*keys, "t", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), risk.alias("n_risk")).where(F.col("t") < n)


def leave_prob(dtrj: DataFrame, dtrj2: DataFrame | None = None, **options) -> DataFrame:
    """n_leaves_vs_time with prob = n_leaves / n_risk (null without risk)."""
    return n_leaves_vs_time(dtrj, dtrj2, **options).withColumn("prob", F.try_divide(F.col("n_leaves"), F.col("n_risk")))


def survival_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, n_leaves, n_risk, sf, sf_var) from (keys, t, n_leaves, n_risk): Kaplan-Meier with Greenwood's variance.

    Both are null from the first t without risk on.
    """
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("n_leaves").cast("double"), F.col("n_risk").cast("double")
    steps = counts.withColumns({"h": F.try_divide(d, n), "g": F.coalesce(F.try_divide(d, n * (n - d)), F.lit(0.0)), "none": (F.col("n_risk") == 0).cast("int")})
    over = steps.withColumns({"s": F.product(F.coalesce(1 - F.col("h"), F.lit(1.0))).over(w), "v": F.sum("g").over(w), "ended": F.max("none").over(w)})
    ended = F.col("ended") == 1
    return over.select(*keys, "t", "n_leaves", "n_risk", F.when(~ended, F.col("s")).alias("sf"), F.when(~ended, F.col("s") * F.col("s") * F.col("v")).alias("sf_var"))


def kaplan_meier(dtrj: DataFrame, dtrj2: DataFrame | None = None, **options) -> DataFrame:
    """([state2,] t, n_leaves, n_risk, sf, sf_var): the estimated survival function of the states."""
    return survival_of(n_leaves_vs_time(dtrj, dtrj2, **options), ["state2"] if dtrj2 is not None else [])


def remain_prob(dtrj: DataFrame, dtrj2: DataFrame | None = None, restart: int = 1, continuous: bool = False, discard_neg_start: bool = False, discard_all_neg: bool = False, n_frames: int | None = None, max_lag: int | None = None) -> DataFrame:
    """([state2,] lag, n_same, n_valid, prob): is a compound after a lag in the state it was in at t0.

    continuous: without leaving it.  Starts are the frames 0, restart, ... but the last.
    With discard_all_neg a pair counts only if all its frames are not negative.  With a
    second sequence the counts are kept apart by its state at t0.  prob is 1 at lag 0 and
    null without valid pairs.

    All valid pairs, and continuous ones that hold, follow from run ends alone.  If every frame is a start, pairs in the
    same state are counted by pairs of runs; otherwise by joining on (cmp, state) and buckets of frames.
    """
    _flags(discard_neg_start, discard_all_neg)
    n = n_frames or n_frames_of(dtrj)
    most = min(n - 1, max_lag or n - 1)
    keys = ["state2"] if dtrj2 is not None else []
    here, back = Window.partitionBy("cmp").orderBy("frame"), Window.partitionBy("cmp").orderBy(F.desc("frame"))
    ahead = back.rowsBetween(Window.unboundedPreceding, -1)
    changed = F.when(F.col("state") != F.lag("state").over(here), F.col("frame"))
    marked = dtrj.select("cmp", "frame", "state", changed.alias("c"), F.when(F.col("state") < 0, F.col("frame")).alias("g"), (F.max("frame").over(Window.partitionBy("cmp")) + 1).alias("end"))
    marked = marked.select("cmp", "frame", "state", "end", F.coalesce(F.min("c").over(ahead), "end").alias("change"), F.coalesce(F.least(F.min("g").over(ahead), "g"), "end").alias("negative"))
    starts = marked.where((F.col("frame") % restart == 0) & (F.col("frame") < F.col("end") - 1))
    if discard_neg_start or discard_all_neg:
        starts = starts.where("state >= 0")
    if keys:
        starts = with_state2(starts, dtrj2, F.col("frame"))
    reach = (F.col("negative") if discard_all_neg else F.col("end")) - 1 - F.col("frame")  # the largest valid lag
    lags = dtrj.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("lag"))
    grid = dtrj2.select(F.col("state").alias("state2")).distinct().select("state2", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag")) if keys else lags
    valid = at_least(starts.groupBy(*keys, reach.alias("reach")).agg(F.count("*").alias("n")), grid, keys, "reach", "n_valid")
    if continuous:
        holds = F.least(F.col("change") - 1 - F.col("frame"), reach)
        same = at_least(starts.groupBy(*keys, holds.alias("holds")).agg(F.count("*").alias("n")), grid, keys, "holds", "n_same")
    elif restart == 1:
        chosen = F.col("state") >= 0 if discard_neg_start or discard_all_neg else F.lit(True)
        # with discard_all_neg, a pair's frames lie before the same negative one
        of = ["cmp", "state", "negative"] if discard_all_neg else ["cmp", "state"]
        same = run_overlaps(in_runs(starts, [*of, *keys]), in_runs(marked.where(chosen), of), of, most, grid, "n_same", keys)
    else:
        first = starts.select(*keys, "cmp", "state", F.col("frame").alias("f0"), F.least(reach, F.lit(most)).alias("reach"))
        pairs = lag_pairs(first, dtrj.select("cmp", "state", "frame"), ["cmp", "state"], most, min_lag=1).where(F.col("lag") <= F.col("reach"))
        same = pairs.groupBy(*keys, "lag").agg(F.count("*").alias("n_same"))
    zero = lambda c: F.when(F.col("lag") == 0, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    joined = grid.join(valid, [*keys, "lag"], "left").join(same, [*keys, "lag"], "left").select(*keys, "lag", zero("n_same"), zero("n_valid"))
    prob = F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("n_same").cast("double"), F.col("n_valid")))
    return joined.select(*keys, "lag", "n_same", "n_valid", prob.alias("prob"))


def back_jump_prob(dtrj: DataFrame, dtrj2: DataFrame | None = None, continuous: bool = False, discard_neg: bool = False, discard_neg_btw: bool = False, n_frames: int | None = None) -> DataFrame:
    """([state2,] lag, n_back, norm, prob): returns to the state left, by frames since the jump.

    lag 0 is the first frame after the jump.  continuous: only a return straight from the
    state jumped to.  discard_neg leaves out jumps from or to negative states,
    discard_neg_btw those with a negative state before the return.  norm counts the jumps
    with more than lag frames left; prob is null where it is 0.
    """
    n = n_frames or n_frames_of(dtrj)
    keys = ["state2"] if dtrj2 is not None else []
    w = Window.partitionBy("cmp").orderBy("run")
    neg = (F.col("state") < 0).cast("int")
    each = runs(dtrj).withColumns({"neg_upto": F.sum(neg).over(w.rowsBetween(Window.unboundedPreceding, 0)), "neg_all": F.sum(neg).over(Window.partitionBy("cmp")), "end": F.sum("len").over(Window.partitionBy("cmp"))})
    each = each.withColumn("neg_back", F.lead(F.col("neg_upto") - neg).over(Window.partitionBy("cmp", "state").orderBy("run")))
    back = F.when(F.col("next2_state") == F.col("state"), F.col("next2_t0")) if continuous else F.col("same_t0")
    jumps = each.where("not is_last").withColumns({"back": back - F.col("next_t0"), "left": F.col("end") - F.col("next_t0")})
    if discard_neg:
        jumps = jumps.where("state >= 0")
    if discard_neg_btw:  # negative runs between the jump and the return, or the end without one
        jumps = jumps.where("next_state >= 0" if continuous else "coalesce(neg_back, neg_all) = neg_upto")
    if keys:
        jumps = with_state2(jumps, dtrj2, F.col("next_t0") - 1)
    returned = jumps.where("back is not null").groupBy(*keys, F.col("back").cast("int").alias("lag")).agg(F.count("*").alias("n_back"))
    grid = dtrj.sparkSession.range(n - 1).select(F.col("id").cast("int").alias("lag"))
    if keys:
        grid = dtrj2.select(F.col("state").alias("state2")).distinct().select("state2", F.explode(F.sequence(F.lit(0), F.lit(n - 2))).alias("lag"))
    left = at_least(jumps.groupBy(*keys, (F.col("left") - 1).alias("reach")).agg(F.count("*").alias("n")), grid, keys, "reach", "norm")
    joined = grid.join(returned, [*keys, "lag"], "left").join(left, [*keys, "lag"], "left").fillna(0, ["n_back", "norm"])
    return joined.select(*keys, "lag", "n_back", "norm", F.try_divide(F.col("n_back").cast("double"), F.col("norm")).alias("prob"))


def in_blocks(dtrj: DataFrame, n_blocks: int, n_frames: int) -> DataFrame:
    """dtrj with block, its frames numbered from 0 in each and cmp made of the compound and the block; left-over frames are dropped."""
    size = n_frames // n_blocks
    block = F.floor(F.col("frame") / size).cast("int")
    rows = dtrj.withColumn("block", block).where(F.col("block") < n_blocks)
    return rows.withColumns({"cmp": F.col("cmp") * n_blocks + F.col("block"), "frame": (F.col("frame") - F.col("block") * size).cast("int")})


def remain_prob_in_blocks(dtrj: DataFrame, n_blocks: int, n_frames: int, **options) -> DataFrame:
    """(lag, mean, sd): remain_prob of each of n_blocks parts of the sequences, averaged over them."""
    from framewalk.operators.dynamics import block_average

    rows = in_blocks(dtrj, n_blocks, n_frames)
    second = rows.select("cmp", "frame", F.col("block").alias("state"))
    by_block = remain_prob(rows.select("cmp", "frame", "state"), second, **options)
    return block_average(by_block, ["lag"], "prob")


def lifetime_moments(dtrj: DataFrame, dtrj2: DataFrame | None = None, threshold: float = 0.01, **options) -> DataFrame:
    """(state, count_mean, count_std, [integral_mean]): mean lifetimes by counting, and by integrating the survival function of each state."""
    from framewalk.operators.stats import describe, moments_of_survival

    counted = describe(lifetimes(dtrj, uncensored=True), ["state"], "lifetime").select("state", F.col("mean").alias("count_mean"), F.col("std").alias("count_std"))
    curve = kaplan_meier(dtrj, dtrj, **options)
    moments = moments_of_survival(curve, ["state2"], "t", "sf", 1, threshold).select(F.col("state2").alias("state"), F.col("m1").alias("integral_mean"))
    return counted.join(moments, "state", "full")


def lifetime_methods(dtrj: DataFrame, threshold: float = 0.01, **options) -> DataFrame:
    """(state, method, n, mean, std): the mean lifetime of each state by every estimator, one row each.

    Methods: count (all runs), count_uncensored (without each compound's first and last), rate (frames by transitions),
    integral (of the survival function, null unless it falls to the threshold), and weibull and burr12, the means of
    curves fitted to it; n is the number of runs, transitions or points.
    """
    from framewalk.functions.models import burr12_mean, kww_mean
    from framewalk.operators.fits import fit_model, fit_window
    from framewalk.operators.stats import moments_of_survival

    none = F.lit(None).cast("double")
    counted = [lifetimes(dtrj, uncensored=u).groupBy("state").agg(F.lit(name).alias("method"), F.count("*").alias("n"), F.avg("lifetime").alias("mean"), F.stddev_samp("lifetime").alias("std")) for name, u in (("count", False), ("count_uncensored", True))]
    rate = trans_rate_per_state(dtrj).select("state", F.lit("rate").alias("method"), F.col("n_trans").alias("n"), F.try_divide(F.lit(1.0), "rate").alias("mean"), none.alias("std"))
    curve = kaplan_meier(dtrj, dtrj, **options).select(F.col("state2").alias("state"), "t", "sf")
    moments = moments_of_survival(curve, ["state"], "t", "sf", 2, threshold)
    points = curve.where("sf is not null").groupBy("state").agg(F.count("*").alias("n"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("m2") - F.col("m1") * F.col("m1")))
    integral = moments.join(points, "state").select("state", F.lit("integral").alias("method"), "n", F.col("m1").alias("mean"), spread.alias("std"))
    window = fit_window(curve.where("sf is not null"), ["state"], "t", "sf", stop=threshold)
    fitted = [
        fit_model(window, model, ["state"], "t", "sf").select("state", F.lit(model).alias("method"), "n", mean.alias("mean"), none.alias("std"))
        for model, mean in (("weibull", kww_mean("tau", "beta")), ("burr12", burr12_mean("tau", "beta", "delta")))
    ]
    out = counted[0]
    for part in (counted[1], rate, integral, *fitted):
        out = out.unionByName(part)
    return out


def trans_info(dtrj: DataFrame) -> DataFrame:
    """One row: compounds that stay in one state, are always or never negative; negative frames; transitions, by the signs of their states."""
    here, there = F.col("state") >= 0, F.col("next_state") >= 0
    each = runs(dtrj).groupBy("cmp").agg(
        F.count("*").alias("r"), F.min("state").alias("low"), F.max("state").alias("high"),
        F.sum(F.when(~here, F.col("len")).otherwise(0)).alias("neg"),
        F.count_if(here & there).alias("pp"), F.count_if(here & ~there).alias("pn"), F.count_if(~here & there).alias("np"), F.count_if(~here & ~there).alias("nn"),
    )
    return each.agg(
        F.count_if(F.col("r") == 1).alias("n_stay"), F.count_if(F.col("high") < 0).alias("always_neg"), F.count_if(F.col("low") >= 0).alias("never_neg"),
        F.sum("neg").alias("n_frames_neg"), F.sum(F.col("r") - 1).alias("n_trans"),
        F.sum("pp").alias("pos2pos"), F.sum("pn").alias("pos2neg"), F.sum("np").alias("neg2pos"), F.sum("nn").alias("neg2neg"),
    )
