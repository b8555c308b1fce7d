"""Curve fits by group.  Straight-line ones are sums; others are least squares in a grouped map."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewalk.session import importable

#: Stands in for a standard deviation of 0.
TINY = 1e-30


def fit_exp_decay(curve: DataFrame, keys: list[str], t: str, y: str, sd: str | None = None) -> DataFrame:
    """(keys, k, k_sd, n): y = exp(-k t) fitted to ln y, k >= 0; points that are not finite or not in (0, 1] are left out.

    A least-squares line through the origin: sums only.
    """
    valid = curve.where(F.col(y).isNotNull() & (F.col(y) > 0) & (F.col(y) <= 1))
    u = F.log(F.col(y))
    w = F.pow(F.col(y) / F.greatest(F.coalesce(F.col(sd), F.lit(0.0)), F.lit(TINY)), F.lit(2.0)) if sd else F.lit(1.0)
    x = F.col(t).cast("double")
    made = valid.groupBy(*keys).agg(F.sum(w * x * x).alias("_xx"), F.sum(w * x * u).alias("_xu"), F.sum(w * u * u).alias("_uu"), F.count("*").alias("n"))
    k = F.greatest(F.lit(0.0), -F.try_divide(F.col("_xu"), F.col("_xx")))
    rest = F.col("_uu") + 2 * k * F.col("_xu") + k * k * F.col("_xx")
    return made.select(*keys, k.alias("k"), F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(rest, (F.col("n") - 1) * F.col("_xx"))))).alias("k_sd"), "n")


def fit_einstein(curve: DataFrame, keys: list[str], t: str, y: str, d: int, start: float, stop: float) -> DataFrame:
    """(keys, D, D_sd, n): y = 2 d D t fitted in a window of t, through the origin."""
    x = F.col(t).cast("double")
    made = curve.where((x >= start) & (x <= stop)).groupBy(*keys).agg(F.sum(x * F.col(y)).alias("_xy"), F.sum(x * x).alias("_xx"), F.sum(F.col(y) * F.col(y)).alias("_yy"), F.count("*").alias("n"))
    slope = F.try_divide(F.col("_xy"), F.col("_xx"))
    rest = F.col("_yy") - slope * F.col("_xy")
    return made.select(*keys, (slope / (2 * d)).alias("D"), (F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(rest, (F.col("n") - 1) * F.col("_xx"))))) / (2 * d)).alias("D_sd"), "n")


def fit_power_law(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, a, b): y = a x^b by a line through the logarithms."""
    u, v = F.log(F.col(x)), F.log(F.col(y))
    return curve.where((F.col(x) > 0) & (F.col(y) > 0)).groupBy(*keys).agg(F.exp(F.regr_intercept(v, u)).alias("a"), F.regr_slope(v, u).alias("b"))


def least_squares(f: Callable, x: np.ndarray, y: np.ndarray, p0: np.ndarray, low: np.ndarray, high: np.ndarray, sd: np.ndarray | None = None, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Parameters within bounds and their standard deviations: Levenberg-Marquardt steps, cut at the bounds."""
    w = np.ones_like(y) if sd is None else 1 / np.where(sd > 0, sd, TINY)
    p, damp = np.clip(p0, low, high).astype(float), 1e-3

    def residual(q):
        return w * (f(x, *q) - y)

    def slopes(q, r):
        out = np.empty((len(x), len(q)))
        for k in range(len(q)):
            h = 1e-6 * max(1.0, abs(q[k]))
            h = -h if q[k] + h > high[k] else h
            moved = q.copy()
            moved[k] += h
            out[:, k] = (residual(moved) - r) / h
        return out

    with np.errstate(all="ignore"):
        r = residual(p)
        for _ in range(rounds):
            j = slopes(p, r)
            if not np.isfinite(j).all():
                break
            a, g = j.T @ j, j.T @ r
            free = ~(((p <= low) & (g > 0)) | ((p >= high) & (g < 0)))
            if not free.any():
                break
            better = False
            for _ in range(12):
                m = a[np.ix_(free, free)]
                try:
                    move = np.linalg.solve(m + damp * np.diag(np.maximum(np.diag(m), 1e-12)), -g[free])
                except np.linalg.LinAlgError:
                    damp *= 10
                    continue
                q = p.copy()
                q[free] = np.clip(p[free] + move, low[free], high[free])
                s = residual(q)
                if np.isfinite(s).all() and s @ s < r @ r:
                    better = (r @ r - s @ s) > 1e-14 * max(1e-300, r @ r)
                    p, r, damp = q, s, max(damp / 10, 1e-12)
                    break
                damp *= 10
            if not better:
                break
        j = slopes(p, residual(p))
        try:
            cov = np.linalg.inv(j.T @ j) * (r @ r / max(1, len(x) - len(p)) if sd is None else 1)
            return p, np.sqrt(np.maximum(np.diag(cov), 0))
        except np.linalg.LinAlgError:
            return p, np.full(len(p), np.nan)


def _kww(t, tau, beta):
    return np.exp(-((t / tau) ** beta))


def _burr(t, tau, beta, delta):
    return (1 + (t / tau) ** beta) ** -delta


def _burr_alt(t, tau, beta, d):
    return (1 + (t / tau) ** beta) ** -(d / beta)


def _gauss(x, mu, sigma):
    return np.exp(-0.5 * ((x - mu) / sigma) ** 2) / (np.sqrt(2 * np.pi) * sigma)


def _maxwell(v, var, drift):
    s = v - drift
    return 4 * np.pi * s * s * (2 * np.pi * var) ** -1.5 * np.exp(-s * s / (2 * var))


def _tau0(x: np.ndarray, y: np.ndarray, level: float) -> float:
    """The first x at which y is at a level; beyond the last x if there is none."""
    at = np.flatnonzero(y <= level)
    start = x[at[0]] if at.size else (1 + y[-1] - level) * x[-1]
    return max(float(start), 1e-9)


#: name: function, parameters, start, lower and upper bounds.
MODELS = {
    "kww": (_kww, ("tau", "beta"), lambda x, y: (_tau0(x, y, np.exp(-1)), 1.0), (1e-12, 1e-6), (np.inf, 1.0)),
    "weibull": (_kww, ("tau", "beta"), lambda x, y: (_tau0(x, y, np.exp(-1)), 1.0), (1e-12, 1e-6), (np.inf, np.inf)),
    "burr12": (_burr, ("tau", "beta", "delta"), lambda x, y: (_tau0(x, y, 0.5), 1.0, 1.0), (1e-12, 1e-6, 1.0), (np.inf, np.inf, 2.0)),
    "burr12_alt": (_burr_alt, ("tau", "beta", "d"), lambda x, y: (_tau0(x, y, 0.5), 1.0, 1.0 + 1e-6), (1e-12, 1e-6, 1.0 + 1e-6), (np.inf, np.inf, 2.0)),
    "gaussian": (_gauss, ("mu", "sigma"), lambda x, y: (float(x[np.argmax(y)]), max(1e-9, float(np.ptp(x)) / 6)), (-np.inf, 1e-12), (np.inf, np.inf)),
    "maxwell": (_maxwell, ("var", "drift"), lambda x, y: (max(1e-9, float(x[np.argmax(y)]) ** 2 / 2), 0.0), (1e-12, -np.inf), (np.inf, np.inf)),
}


def fit_model(curve: DataFrame, model: str, keys: list[str], t: str, y: str, sd: str | None = None) -> DataFrame:
    """(keys, each parameter and its _sd, n): a model fitted to each group's points, null where it cannot be.

    Survival models ("kww", "weibull", "burr12", "burr12_alt") take only points with 0 < y <= 1.  A group is one curve.
    """
    importable(curve.sparkSession)
    f, names, start, low, high = MODELS[model]
    survival = model in ("kww", "weibull", "burr12", "burr12_alt")
    columns = [c for n in names for c in (n, f"{n}_sd")]
    kinds = {k: curve.schema[k].dataType.simpleString() for k in keys}

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_t")
        x, v = rows["_t"].to_numpy(float), rows["_y"].to_numpy(float)
        good = np.isfinite(x) & np.isfinite(v) & ((v > 0) & (v <= 1) if survival else True)
        s = rows["_s"].to_numpy(float)[good] if sd else None
        head = {k: rows[k].iloc[0] for k in keys}
        n = int(good.sum())
        out = [None] * len(columns)
        if n >= len(names):
            p, e = least_squares(f, x[good], v[good], np.array(start(x[good], v[good])), np.array(low), np.array(high), s)
            out = [float(z) if np.isfinite(z) else None for pair in zip(p, e) for z in pair]
        return pd.DataFrame([head | dict(zip(columns, out)) | {"n": n}])

    schema = ", ".join([*(f"`{k}` {v}" for k, v in kinds.items()), *(f"{c} double" for c in columns), "n long"])
    rows = curve.select(*keys, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y"), *([F.col(sd).cast("double").alias("_s")] if sd else []))
    return rows.groupBy(*keys).applyInPandas(one, schema)


def fit_window(curve: DataFrame, keys: list[str], t: str, y: str, share: float = 0.9, stop: float = 0.01) -> DataFrame:
    """The points of each curve to be fitted: the first share of them, up to the first below stop, two at least."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(t)
    ended = F.max((F.col(y) < stop).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumns({"_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys)), "_e": F.coalesce(ended, F.lit(0))})
    return rows.where((F.col("_k") <= 2) | ((F.col("_k") <= share * F.col("_n")) & (F.col("_e") == 0))).drop("_k", "_n", "_e")


def spectrum(series: DataFrame, dt: float = 1.0) -> DataFrame:
    """(id, frequency, amplitude) of each series by the discrete Fourier transform; a group is one series."""
    importable(series.sparkSession)
    kind = series.schema["id"].dataType.simpleString()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("t")["x"].to_numpy(float)
        return pd.DataFrame({"id": rows["id"].iloc[0], "frequency": np.fft.rfftfreq(len(x), dt), "amplitude": np.abs(np.fft.rfft(x - x.mean()))})

    return series.select("id", "t", "x").groupBy("id").applyInPandas(one, f"id {kind}, frequency double, amplitude double")
