"""Curve fits by aggregated normal equations: all curves at once, as joins and grouped sums.

A step of the Levenberg-Marquardt method needs, of a curve, the sums of its squared residuals, of the products of its
slopes, and of those with the residuals.  Slopes are column expressions, so the sums are one aggregation over the points of all
curves; the equations of a curve are two or three, and are solved in columns.  A curve is a row of numbers, its points stay
rows, and no curve is a group in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewalk.session import drop, kept

#: Steps that are one job, and curves that are broadcast to their points.
STEPS, FEW = 2, 10_000
#: A step that takes less than this part of the squared residuals away is the last one; so is one that leaves less than this part of the
#: squared values, or is damped more than this.
SETTLED, EXACT, STUCK = 1e-12, 1e-20, 1e8


@dataclass(frozen=True)
class Model:
    """Parameters; the function and its slopes as SQL over t and the parameters; starts as SQL over the aggregates of START; bounds."""

    names: tuple[str, ...]
    f: str
    slopes: tuple[str, ...]
    start: tuple[str, ...]
    low: tuple[float | None, ...]
    high: tuple[float | None, ...]
    survival: bool = False


_U, _LOG = "pow(t / tau, beta)", "CASE WHEN t > 0 THEN ln(t / tau) ELSE 0 END"
_TAU = "greatest(coalesce(min(CASE WHEN y <= {0} THEN t END), (1 + max_by(y, t) - {0}) * max(t)), 1e-9)"
_G = "(exp(-0.5 * pow((t - mu) / sigma, 2)) / (sqrt(2 * pi()) * sigma))"
_M = "4 * pi() * pow(2 * pi() * var, -1.5) * exp(-pow(t - drift, 2) / (2 * var))"
_E = "exp(-1)"

MODELS = {
    "kww": Model(("tau", "beta"), f"exp(-{_U})", (f"exp(-{_U}) * {_U} * beta / tau", f"-exp(-{_U}) * {_U} * {_LOG}"), (_TAU.format(_E), "1.0"), (1e-12, 1e-6), (None, 1.0), True),
    "weibull": Model(("tau", "beta"), f"exp(-{_U})", (f"exp(-{_U}) * {_U} * beta / tau", f"-exp(-{_U}) * {_U} * {_LOG}"), (_TAU.format(_E), "1.0"), (1e-12, 1e-6), (None, None), True),
    "burr12": Model(
        ("tau", "beta", "delta"), f"pow(1 + {_U}, -delta)",
        (f"delta * pow(1 + {_U}, -delta - 1) * {_U} * beta / tau", f"-delta * pow(1 + {_U}, -delta - 1) * {_U} * {_LOG}", f"-pow(1 + {_U}, -delta) * ln(1 + {_U})"),
        (_TAU.format("0.5"), "1.0", "1.0"), (1e-12, 1e-6, 1.0), (None, None, 2.0), True,
    ),
    "burr12_alt": Model(
        ("tau", "beta", "d"), f"pow(1 + {_U}, -d / beta)",
        (f"d * pow(1 + {_U}, -d / beta - 1) * {_U} / tau", f"-d / beta * pow(1 + {_U}, -d / beta - 1) * {_U} * {_LOG} + pow(1 + {_U}, -d / beta) * ln(1 + {_U}) * d / (beta * beta)", f"-pow(1 + {_U}, -d / beta) * ln(1 + {_U}) / beta"),
        (_TAU.format("0.5"), "1.0", "1.000001"), (1e-12, 1e-6, 1.000001), (None, None, 2.0), True,
    ),
    "gaussian": Model(("mu", "sigma"), _G, (f"{_G} * (t - mu) / (sigma * sigma)", f"{_G} * (pow((t - mu) / sigma, 2) - 1) / sigma"), ("min_by(t, top)", "greatest((max(t) - min(t)) / 6, 1e-9)"), (None, 1e-12), (None, None)),
    "maxwell": Model(("var", "drift"), f"{_M} * pow(t - drift, 2)", (f"{_M} * pow(t - drift, 2) * (pow(t - drift, 2) / (2 * var * var) - 1.5 / var)", f"{_M} * (pow(t - drift, 3) / var - 2 * (t - drift))"), ("greatest(pow(min_by(t, top), 2) / 2, 1e-9)", "0.0"), (1e-12, None), (None, None)),
}


def _pairs(m: int) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(m), 2))


def sums_sql(model: Model) -> list[tuple[str, str]]:
    """(name, SQL) of the sums of a step: points (t, y, w) with the parameters as columns."""
    r = f"(({model.f}) - y)"
    out = [("s", f"sum(w * {r} * {r})")]
    out += [(f"b{i}", f"sum(w * {r} * ({model.slopes[i]}))") for i in range(len(model.names))]
    return out + [(f"a{i}{j}", f"sum(w * ({model.slopes[i]}) * ({model.slopes[j]}))") for i, j in _pairs(len(model.names))]


def cells_sql(model: Model) -> list[tuple[str, str]]:
    """(name, SQL) of the damped equations from the parameters, sums (a, b) and damping (damp): a parameter at its bound that would cross it stays."""
    m = len(model.names)
    bound = []
    for k, name in enumerate(model.names):
        at = [f"({name} <= {model.low[k]!r} AND b{k} > 0)"] if model.low[k] is not None else []
        at += [f"({name} >= {model.high[k]!r} AND b{k} < 0)"] if model.high[k] is not None else []
        bound.append(" OR ".join(at) or "FALSE")
    out = [(f"c{i}{j}", f"CASE WHEN {bound[i]} OR {bound[j]} THEN {'1.0' if i == j else '0.0'} ELSE a{i}{j}{f' + damp * greatest(a{i}{i}, 1e-12)' if i == j else ''} END") for i, j in _pairs(m)]
    return out + [(f"r{i}", f"CASE WHEN {bound[i]} THEN 0.0 ELSE -b{i} END") for i in range(m)]


def move_sql(model: Model) -> list[str]:
    """SQL of each parameter's next trial from the parameters and the cells."""
    m = len(model.names)

    def determinant(rows: list[list[str]]) -> str:
        if len(rows) == 1:
            return rows[0][0]
        parts = [f"{'-' if j % 2 else '+'} {rows[0][j]} * ({determinant([r[:j] + r[j + 1 :] for r in rows[1:]])})" for j in range(len(rows))]
        return f"({' '.join(parts)[2:]})"

    whole = [[f"c{min(i, j)}{max(i, j)}" for j in range(m)] for i in range(m)]
    out = []
    for k, name in enumerate(model.names):
        part = determinant([[f"r{i}" if j == k else whole[i][j] for j in range(m)] for i in range(m)])
        moved = f"{name} + {part} / nullif({determinant(whole)}, 0)"
        if model.low[k] is not None:
            moved = f"greatest({moved}, {model.low[k]!r})"
        out.append(f"least({moved}, {model.high[k]!r})" if model.high[k] is not None else moved)
    return out


def spread_sql(model: Model) -> list[str]:
    """SQL of each parameter's variance but for the residuals' own: the diagonal of the inverse of a."""
    m = len(model.names)
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    if m == 2:
        whole = "(a00 * a11 - a01 * a01)"
        return [f"a{1 - k}{1 - k} / nullif({whole}, 0)" for k in range(2)]

    def minor(k: int) -> str:
        i, j = (x for x in range(3) if x != k)
        return f"({a(i, i)} * {a(j, j)} - {a(i, j)} * {a(i, j)})"

    whole = "(a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02))"
    return [f"{minor(k)} / nullif({whole}, 0)" for k in range(3)]


def fit_by_sums(curve: DataFrame, model: str, keys: list[str], t: str, y: str, sd: str | None = None, rounds: int = 200) -> DataFrame:
    """(keys, each parameter and its _sd, n): as fits.fit_model, whose models, points and bounds these are, by sums alone.

    A curve of fewer points than parameters has nulls.  Curves that settle sooner wait for the others.
    """
    of, m = MODELS[model], len(MODELS[model].names)
    of_curve: list[str] = keys or ["_one"]
    x, v = F.col(t).cast("double"), F.col(y).cast("double")
    weight = F.pow(F.greatest(F.coalesce(F.col(sd).cast("double"), F.lit(0.0)), F.lit(1e-30)), F.lit(-2.0)) if sd else F.lit(1.0)
    rows = curve if keys else curve.withColumn("_one", F.lit(1))
    points = rows.select(*of_curve, x.alias("t"), v.alias("y"), weight.alias("w"), F.struct((-v).alias("v"), x.alias("x")).alias("top"))
    good = F.col("t").isNotNull() & ~F.isnan("t") & F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("t") < float("inf")) & (F.abs("y") < float("inf"))
    points = kept(points.where(good & (F.col("y") > 0) & (F.col("y") <= 1) if of.survival else good), "points")
    every = rows.select(*of_curve).distinct()
    begun = points.groupBy(*of_curve).agg(*(F.expr(s).cast("double").alias(f"q_{n}") for n, s in zip(of.names, of.start)), F.count("*").alias("n"), F.expr("sum(w * y * y)").alias("yy")).where(F.col("n") >= m)
    sums = [n for n, _ in sums_sql(of)]
    none = F.lit(None).cast("double")
    state = kept(begun.select(*of_curve, "n", "yy", *(f"q_{n}" for n in of.names), *(none.alias(n) for n in of.names), *(none.alias(s) for s in sums), F.lit(1e-3).alias("damp"), F.lit(False).alias("done")), "fits")
    few = F.broadcast if state.count() <= FEW else lambda rows: rows
    inside = points.select(*of_curve, "t", "y", "w")

    def step(state: DataFrame) -> DataFrame:
        trial = state.select(*of_curve, *(F.col(f"q_{n}").alias(n) for n in of.names))
        made = inside.join(few(trial), of_curve).groupBy(*of_curve).agg(*(F.expr(s).alias(f"q_{n}_") for n, s in sums_sql(of)))
        both = state.join(few(made), of_curve)
        finite = ~F.isnan("q_s_") & (F.col("q_s_") < float("inf"))
        better = ~F.col("done") & F.coalesce(finite & (F.col("s").isNull() | (F.col("q_s_") < F.col("s"))), F.lit(False))
        last = F.coalesce(F.col("s") - F.col("q_s_") <= SETTLED * F.col("s"), F.lit(False)) | (F.col("q_s_") <= EXACT * F.col("yy"))
        # a trial that is no better is damped more; what is damped beyond all measure is where it stays
        both = both.withColumns({"better": better, "ended": F.col("done") | better & last | ~better & (F.col("damp") > STUCK)})
        taken = both.select(
            *of_curve, "n", "yy", F.col("ended").alias("done"), *(F.when(F.col("better"), F.col(f"q_{n}")).otherwise(F.col(n)).alias(n) for n in of.names), *(F.when(F.col("better"), F.col(f"q_{s}_")).otherwise(F.col(s)).alias(s) for s in sums),
            F.when(F.col("better"), F.greatest(F.col("damp") / 10, F.lit(1e-12))).otherwise(F.col("damp") * 10).alias("damp"),
        )
        celled = taken.select(*taken.columns, *(F.expr(s).alias(n) for n, s in cells_sql(of)))
        return celled.select(*taken.columns, *(F.expr(s).alias(f"q_{n}") for n, s in zip(of.names, move_sql(of))))

    for _ in range(0, rounds, STEPS):
        after = state
        for _ in range(STEPS):
            after = step(after)
        after = kept(after, "fits")
        drop(state)
        state = after
        if state.where("not done").isEmpty():
            break
    own = F.lit(1.0) if sd else F.col("s") / F.greatest(F.lit(1), F.col("n") - m)
    spread = [F.sqrt(F.greatest(F.lit(0.0), F.expr(s) * own)) for s in spread_sql(of)]
    made = state.select(*of_curve, *(c for k, n in enumerate(of.names) for c in (F.col(n), F.when(~F.isnan(spread[k]), spread[k]).alias(f"{n}_sd"))))
    counted = points.groupBy(*of_curve).agg(F.count("*").alias("n"))
    out = every.join(made, of_curve, "left").join(counted, of_curve, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(*keys, *(c for n in of.names for c in (n, f"{n}_sd")), "n")


def fit_sql(points: str, model: str, keys: list[str], rounds: int = 60) -> str:
    """The same steps as SQL with recursion, over a query of (keys, t, y): for checks against another engine."""
    of = MODELS[model]
    by = ", ".join(keys)
    sums = sums_sql(of)
    trial = ", ".join(f"st.q_{n} AS {n}" for n in of.names)
    start = ", ".join(f"CAST({s.replace('top', 'struct_pack(v := -y, x := t)').replace('max_by', 'arg_max').replace('min_by', 'arg_min')} AS DOUBLE) AS q_{n}" for n, s in zip(of.names, of.start))
    empty = ", ".join(f"NULL::DOUBLE AS {n}" for n in (*of.names, *(s for s, _ in sums)))
    same = " AND ".join(f"n_.{k} = st.{k}" for k in keys)
    take = ", ".join(f"CASE WHEN better THEN st.q_{n} ELSE st.{n} END AS {n}" for n in of.names) + ", " + ", ".join(f"CASE WHEN better THEN n_.{s} ELSE st.{s} END AS {s}" for s, _ in sums)
    moves = ", ".join(f"{s} AS q_{n}" for n, s in zip(of.names, move_sql(of)))
    columns = ", ".join((*of.names, *(s for s, _ in sums)))
    spread = ", ".join(f"{n}, sqrt(greatest(0.0, {s} * s / greatest(1, n - {len(of.names)}))) AS {n}_sd" for n, s in zip(of.names, spread_sql(of)))
    return f"""WITH RECURSIVE pt AS (SELECT {by}, CAST(t AS DOUBLE) AS t, CAST(y AS DOUBLE) AS y, 1.0::DOUBLE AS w FROM ({points}) {"WHERE y > 0 AND y <= 1" if of.survival else ""}),
state({by}, k, n, yy, done, {columns}, damp, {", ".join(f"q_{n}" for n in of.names)}) AS (
  SELECT {by}, 0, count(*), sum(w * y * y), FALSE, {empty}, 1e-3::DOUBLE AS damp, {start} FROM pt GROUP BY {by}
  UNION ALL
  SELECT {by}, k, n, yy, done, {columns}, damp, {moves} FROM (SELECT *, {", ".join(f"{s} AS {n}" for n, s in cells_sql(of))} FROM (
    SELECT {", ".join(f"st.{x} AS {x}" for x in keys)}, st.k + 1 AS k, st.n AS n, st.yy AS yy, st.done OR (better AND (coalesce(st.s - n_.s <= {SETTLED} * st.s, FALSE) OR n_.s <= {EXACT} * st.yy)) OR (NOT better AND st.damp > {STUCK}) AS done, {take},
           CASE WHEN better THEN greatest(st.damp / 10, 1e-12) ELSE st.damp * 10 END AS damp
    FROM (SELECT st, n_, NOT st.done AND coalesce(isfinite(n_.s) AND (st.s IS NULL OR n_.s < st.s), FALSE) AS better
          FROM state st JOIN (SELECT {by}, {", ".join(f"{s} AS {n}" for n, s in sums)} FROM (SELECT pt.*, {trial} FROM pt JOIN state st ON {" AND ".join(f"pt.{x} = st.{x}" for x in keys)}) GROUP BY {by}) n_ ON {same}) z)) WHERE k <= {rounds})
SELECT {by}, {spread}, n FROM state WHERE k = {rounds}"""
