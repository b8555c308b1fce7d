"""Statistics of series and distributions.  A series is (id, t, x), t dense from 0."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewalk.operators.joins import with_totals
from framewalk.operators.lags import correlate, lag_pairs
from framewalk.session import drop, importable, kept

#: Values of a group that are sorted in one row once its bracket holds no more; parts that sketches cut a bracket into, and the accuracy of their ranks.
SORTED, CUTS, ACCURACY = 4096, 1000, 10_000
#: Numbers of a table of brackets that is broadcast.
FEW = 500_000


def acf(series: DataFrame, dt: int | None = 1, dtau: int = 1, tau_max: int | None = None, center: bool = True, unbiased: bool = False) -> DataFrame:
    """(id, lag, acf): autocorrelation of each series, 1 at lag 0.

    Starts are every dt-th t; dt None takes every lag-th, so that samples do not overlap.  unbiased divides each sum
    by its number of terms.  The series is joined with itself on id and buckets of t; tau_max (exclusive) bounds the lags
    and with them the pairs.
    """
    w = Window.partitionBy("id")
    x = F.col("x").cast("double")
    rows = series.select("id", "t", (x - F.avg(x).over(w) if center else x).alias("x"))
    longest = tau_max - 1 if tau_max is not None else rows.agg(F.max("t")).first()[0] or 0
    pairs = lag_pairs(rows, rows.select("id", F.col("t").alias("t2"), F.col("x").alias("x2")), ["id"], longest, "t", "t2").where(F.col("lag") % dtau == 0)
    step = F.greatest(F.lit(1), F.col("lag")) if dt is None else F.lit(dt)
    made = pairs.where(F.col("t") % step == 0).groupBy("id", "lag").agg(F.sum(F.col("x") * F.col("x2")).alias("s"), F.count("*").alias("n"))
    value = F.col("s") / F.col("n") if unbiased else F.col("s")
    zero = F.max(F.when(F.col("lag") == 0, value)).over(w)
    return made.select("id", "lag", F.try_divide(value, zero).alias("acf"))


def acf_all_lags(series: DataFrame, center: bool = True, unbiased: bool = False) -> DataFrame:
    """acf with every t as a start and all lags, by Fourier transforms: a series is a group and takes T * log(T) steps."""
    importable(series.sparkSession)
    kind = series.schema["id"].dataType.simpleString()

    def one(r: pd.DataFrame) -> pd.DataFrame:
        t = r["t"].to_numpy()
        there, x = np.zeros(t.max() + 1), np.zeros(t.max() + 1)
        there[t], x[t] = 1.0, r["x"].to_numpy() - (r["x"].mean() if center else 0.0)
        n = np.rint(correlate(there, there))
        sums = correlate(x, x)
        value = sums / np.maximum(n, 1) if unbiased else sums
        zero = (x @ x) / (n[0] if unbiased else 1)
        made = pd.DataFrame({"id": r["id"].iloc[0], "lag": np.arange(len(x), dtype=np.int32), "acf": value / zero if zero > 0 else np.full(len(x), np.nan)})
        return made[n > 0]

    rows = series.select("id", F.col("t").cast("int").alias("t"), F.col("x").cast("double").alias("x"))
    made = rows.groupBy("id").applyInPandas(one, f"id {kind}, lag int, acf double")
    return made.withColumn("acf", F.nanvl("acf", F.lit(None).cast("double")))


def acf_se(curve: DataFrame, n: int | None = None) -> DataFrame:
    """acf(id, lag, acf) with se, Bartlett's standard errors for n samples (the number of lags unless given)."""
    w = Window.partitionBy("id").orderBy("lag")
    before = F.sum(F.col("acf") * F.col("acf")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.pow(F.first("acf").over(Window.partitionBy("id").orderBy("lag").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(2.0))
    size = F.count("*").over(Window.partitionBy("id")) if n is None else F.lit(n)
    k = F.row_number().over(w) - 1
    return curve.withColumn("se", F.when(k == 0, 0.0).otherwise(F.sqrt((1 + 2 * (before - first)) / size)))


def acf_confint(curve: DataFrame, alpha: float = 0.05, n: int | None = None) -> DataFrame:
    """acf with se and ci, half the width of the confidence interval."""
    return acf_se(curve, n).withColumn("ci", F.col("se") * NormalDist().inv_cdf(1 - alpha / 2))


def centered(series: DataFrame, by: list[str], x: str) -> DataFrame:
    return series.withColumn(x, F.col(x) - F.avg(x).over(Window.partitionBy(*by)))


def standardized(series: DataFrame, by: list[str], x: str, ddof: int = 0) -> DataFrame:
    w = Window.partitionBy(*by)
    std = F.stddev_samp(x).over(w) if ddof == 1 else F.stddev_pop(x).over(w)
    return series.withColumn(x, F.try_divide(F.col(x) - F.avg(x).over(w), std))


def ngp(x: Column, d: int = 1, is_squared: bool = False) -> Column:
    """Non-Gaussian parameter in d dimensions, as an aggregate of distances (or squared ones)."""
    squared = x if is_squared else x * x
    mean = F.avg(squared)
    return F.try_divide(F.avg(squared * squared), (1 + 2 / d) * mean * mean) - 1


def ngp_by(df: DataFrame, keys: list[str], x: str, d: int = 1, is_squared: bool = False, center: bool = False) -> DataFrame:
    """(keys, ngp); center takes the mean of each group's values away first."""
    if center and is_squared:
        raise ValueError("squared distances cannot be centred")
    rows = with_means(df, keys, F.col(x)) if center else df.withColumn("_m", F.lit(0.0))
    return rows.groupBy(*keys).agg(ngp(F.col(x) - F.col("_m"), d, is_squared).alias("ngp"))


def with_means(df: DataFrame, keys: list[str], x: Column, w: Column | None = None) -> DataFrame:
    """df with _m, the (weighted) mean of its group: a small table, joined back, so that no group meets in a task."""
    mean = F.avg(x) if w is None else F.try_divide(F.sum(w * x), F.sum(w))
    means = df.groupBy(*keys).agg(mean.cast("double").alias("_m"))
    return df.join(means, keys) if keys else with_totals(df, means)


def weighted_moments(df: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    """(keys, mean, var, std) with weights, var and std being those of the population.

    Squares are taken of differences to the mean: those of large values that differ little do not cancel.
    """
    d = F.col(x) - F.col("_m")
    rows = with_means(df.where(F.col(x).isNotNull() & F.col(w).isNotNull()), keys, F.col(x), F.col(w))
    made = rows.groupBy(*keys).agg(F.first("_m").alias("mean"), F.try_divide(F.sum(F.col(w) * d * d), F.sum(w)).alias("var"))
    return made.withColumn("std", F.sqrt("var"))


def cumav(series: DataFrame) -> DataFrame:
    """(id, t, x) with the mean up to each t."""
    w = Window.partitionBy("id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return series.select("id", "t", F.avg("x").over(w).alias("x"))


def movav(series: DataFrame, wlen: int) -> DataFrame:
    """(id, t, x) with the mean of wlen values from t on; only full windows."""
    w = Window.partitionBy("id").orderBy("t").rowsBetween(0, wlen - 1)
    return series.select("id", "t", F.avg("x").over(w).alias("x"), F.count("*").over(w).alias("_n")).where(F.col("_n") == wlen).drop("_n")


def medians(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, median): exact, the mean of the two middle values of an even number; groups without values are left out.

    No group's values meet in a row.  Each round, a sketch of the values in a group's bracket cuts it into CUTS parts, and counts of the
    values around the parts next to the middle say in which the middle is, however good the sketch was; an end of a part that
    the middle falls on is the answer itself.  A bracket of at most SORTED values is sorted.  Jobs run when it is called: a
    round takes a bracket to about a 300th, so there are few.  NaN counts as larger than any number; keys may be null.
    """
    by = [f"_k{i}" for i in range(len(keys))] or ["_k"]
    known = df.select(*([F.col(k).alias(b) for k, b in zip(keys, by)] or [F.lit(0).alias("_k")]), F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    none, v = F.lit(None).cast("double"), F.col("_x")

    def beside(state: DataFrame) -> DataFrame:
        side = state.withColumnsRenamed({b: f"_b{b}" for b in by})
        few = state.count() * len(state.columns) <= FEW
        return known.join(F.broadcast(side) if few else side, [F.col(b).eqNullSafe(F.col(f"_b{b}")) for b in by]).drop(*(f"_b{b}" for b in by))

    def within(low: str, high: str):
        return (F.col(low).isNull() | (v > F.col(low))) & (F.col(high).isNull() | (v < F.col(high)))

    # of a group: size, rank (from 0) of the lower middle value among the n values between lo and hi, and that value once it is known
    size = known.groupBy(*by).agg(F.count("*").alias("size"))
    state = kept(size.select(*by, "size", F.col("size").alias("n"), F.floor((F.col("size") - 1) / 2).alias("rank"), none.alias("lo"), none.alias("hi"), none.alias("v")), "median")
    while most := state.where(F.col("v").isNull()).agg(F.max("n")).first()[0]:
        todo = state.where(F.col("v").isNull())
        rows = beside(todo).where(within("lo", "hi"))
        held, spare = [F.first(c).alias(c) for c in ("size", "n", "rank", "lo", "hi")], [state]
        if most <= SORTED:
            new = rows.groupBy(*by).agg(*held, F.array_sort(F.collect_list(v)).alias("xs")).select(*by, "size", "n", "rank", "lo", "hi", F.get("xs", F.col("rank").cast("int")).alias("v"))
        else:
            part = F.floor(F.col("rank") * CUTS / F.col("n")).cast("int")
            sketch = rows.groupBy(*by).agg(*held, F.percentile_approx(v, [i / CUTS for i in range(CUTS + 1)], ACCURACY).alias("q"))
            ends = sketch.select(*by, "size", "n", "rank", "lo", "hi", F.when(part > 1, F.get("q", part - 1)).alias("a"), F.when(part < CUTS - 2, F.get("q", part + 2)).alias("b"))
            ends = kept(ends, "median")
            spare.append(ends)
            inside = beside(ends).where(within("lo", "hi"))
            count = lambda test: F.sum(test.cast("long"))
            zero = F.lit(0).cast("long")
            counts = [F.coalesce(count(t), zero).alias(c) for c, t in (("c1", v < F.col("a")), ("c2", v == F.col("a")), ("c3", within("a", "b")), ("c4", v == F.col("b")))]
            found = inside.groupBy(*by).agg(*held, F.first("a").alias("a"), F.first("b").alias("b"), *counts)
            r, c1, c2, c3, c4 = (F.col(c) for c in ("rank", "c1", "c2", "c3", "c4"))

            def case(below, at_a, between, at_b, above):
                return F.when(r < c1, below).when(r < c1 + c2, at_a).when(r < c1 + c2 + c3, between).when(r < c1 + c2 + c3 + c4, at_b).otherwise(above)

            low, high, before, upto = F.col("lo"), F.col("hi"), c1 + c2, c1 + c2 + c3 + c4
            new = found.select(
                *by, "size", case(c1, zero, c3, zero, F.col("n") - upto).alias("n"), case(r, zero, r - before, zero, r - upto).alias("rank"),
                case(low, none, F.coalesce("a", low), none, F.col("b")).alias("lo"), case(F.col("a"), none, F.coalesce("b", high), none, high).alias("hi"), case(none, F.col("a"), none, F.col("b"), none).alias("v"),
            )
        state = kept(state.where(F.col("v").isNotNull()).unionByName(new), "median")
        drop(*spare)
    both = beside(state).groupBy(*by).agg(F.first("size").alias("size"), F.first("v").alias("v"), F.sum((v <= F.col("v")).cast("long")).alias("upto"), F.min(F.when(v > F.col("v"), v)).alias("next"))
    alone = (F.col("size") % 2 == 1) | (F.col("upto") > F.floor(F.col("size") / 2))
    return both.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.when(alone, F.col("v")).otherwise(0.5 * F.col("v") + 0.5 * F.col("next")).alias("median"))


def describe(df: DataFrame, keys: list[str], x: str, exact: bool = True) -> DataFrame:
    """(keys, n, mean, se, std, cv, skew, kurt, median, min, max, m1 .. m4): sample characteristics.

    std has one degree of freedom less; skewness and kurtosis are corrected for bias; m are raw moments.
    The exact median is that of medians, which runs jobs; without exact it is within 1 / 10,000 of its rank.
    """
    v, n = F.col(x).cast("double"), F.count(x)
    raw = {k: F.avg(F.pow(v, F.lit(float(k)))) for k in (1, 2, 3, 4)}
    made = df.groupBy(*keys).agg(n.alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"), *([] if exact else [F.percentile_approx(v, 0.5).alias("median")]), F.min(v).alias("min"), F.max(v).alias("max"), *(m.alias(f"m{k}") for k, m in raw.items()))
    if exact:
        middle = medians(df, keys, x).withColumnsRenamed({k: f"_m{i}" for i, k in enumerate(keys)})
        made = made.join(middle, [F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)] or F.lit(True), "left")
    c = F.col("n").cast("double")
    skew = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(c * (c - 1)) / (c - 2))
    kurt = F.when(F.col("n") > 3, ((c + 1) * F.col("g2") + 6) * (c - 1) / ((c - 2) * (c - 3)))
    return made.select(*keys, "n", "mean", (F.col("std") / F.sqrt("n")).alias("se"), "std", F.try_divide(F.col("std"), F.col("mean")).alias("cv"), skew.alias("skew"), kurt.alias("kurt"), "median", "min", "max", "m1", "m2", "m3", "m4")


def moments_of_survival(curve: DataFrame, keys: list[str], t: str, sf: str, n_moms: int = 4, threshold: float = 0.01) -> DataFrame:
    """(keys, m1 ..): raw moments n * integral of t^(n-1) S, null unless S falls to the threshold."""
    w = Window.partitionBy(*keys).orderBy(t)
    f = {n: n * F.pow(F.col(t).cast("double"), F.lit(float(n - 1))) * F.col(sf) for n in range(1, n_moms + 1)}
    rows = curve.where(F.col(sf).isNotNull()).withColumns({f"_f{n}": e for n, e in f.items()})
    area = {n: (F.col(t) - F.lag(t).over(w)) * (F.col(f"_f{n}") + F.lag(f"_f{n}").over(w)) / 2 for n in f}
    made = rows.withColumns({f"_a{n}": e for n, e in area.items()}).groupBy(*keys).agg(F.min(sf).alias("_low"), *(F.sum(f"_a{n}").alias(f"m{n}") for n in f))
    return made.select(*keys, *(F.when(F.col("_low") <= threshold, F.col(f"m{n}")).alias(f"m{n}") for n in f))


def first_crossing(curve: DataFrame, keys: list[str], x: str, y: str, level: float) -> DataFrame:
    """(keys, x): the first x at which y is at or below a level, by linear interpolation from the point before."""
    w = Window.partitionBy(*keys).orderBy(x)
    rows = curve.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).alias("_y"), F.lag(F.col(x).cast("double")).over(w).alias("_x0"), F.lag(y).over(w).alias("_y0")).where(F.col("_y") <= level)
    at = F.when(F.col("_y0").isNull() | (F.col("_y0") == F.col("_y")), F.col("_x")).otherwise(F.col("_x0") + (level - F.col("_y0")) * (F.col("_x") - F.col("_x0")) / (F.col("_y") - F.col("_y0")))
    return rows.groupBy(*keys).agg(F.min_by(at, "_x").alias(x))


def fit_goodness(df: DataFrame, keys: list[str], y: str, fit: str) -> DataFrame:
    """(keys, r2, rmse) of a fit."""
    r = F.col(y) - F.col(fit)
    return df.where(F.col(y).isNotNull() & F.col(fit).isNotNull()).groupBy(*keys).agg((1 - F.try_divide(F.sum(r * r), F.var_pop(y) * F.count(y))).alias("r2"), F.sqrt(F.avg(r * r)).alias("rmse"))


def normal_test(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, n, z_skew, z_kurt, k2, p): D'Agostino and Pearson's test of normality, for n >= 20 (null below).

    k2 is the sum of the squared scores of skewness and kurtosis, p its chance with two degrees of freedom.
    """
    made = df.groupBy(*keys).agg(F.count(x).cast("double").alias("_n"), F.skewness(x).alias("_g"), (F.kurtosis(x) + 3).alias("_b"))
    n, g, b = F.col("_n"), F.col("_g"), F.col("_b")
    y = g * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    skew = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    z = (b - mean) / F.sqrt(var)
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / (third * third)))
    root = (1 - 2 / a) / (1 + z * F.sqrt(2 / (a - 4)))
    kurt = ((1 - 2 / (9 * a)) - F.signum(root) * F.pow(F.abs(root), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    good = n >= 20
    scored = made.where(g.isNotNull()).select(*keys, n.cast("long").alias("n"), F.when(good, skew).alias("z_skew"), F.when(good, kurt).alias("z_kurt"))
    k2 = F.col("z_skew") * F.col("z_skew") + F.col("z_kurt") * F.col("z_kurt")
    return scored.withColumn("k2", k2).withColumn("p", F.exp(-F.col("k2") / 2))


def auto_histogram(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, bin, lo, hi, n, density): bins of a width that suits n normal values, std * (24 sqrt(pi) / n) ** (1/3), from the least value on.

    The width is made in one aggregation; bins without values do not appear.
    """
    width = F.col("_s") * F.cbrt(24 * F.sqrt(F.lit(3.141592653589793)) / F.col("_n"))
    size = df.groupBy(*keys).agg(F.min(x).cast("double").alias("_m"), F.stddev_pop(x).alias("_s"), F.count(x).alias("_n"))
    size = size.select(*keys, "_m", "_n", F.when(width > 0, width).otherwise(1.0).alias("_w"))
    known = df.where(F.col(x).isNotNull())
    rows = known.join(size, keys) if keys else with_totals(known, size)
    made = rows.groupBy(*keys, F.floor((F.col(x) - F.col("_m")) / F.col("_w")).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first("_m").alias("_m"), F.first("_w").alias("_w"), F.first("_n").alias("_n"))
    low = F.col("_m") + F.col("bin") * F.col("_w")
    return made.select(*keys, "bin", low.alias("lo"), (low + F.col("_w")).alias("hi"), "n", (F.col("n") / (F.col("_n") * F.col("_w"))).alias("density"))
