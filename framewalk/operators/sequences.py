"""Sequences in long form: islands, numbering, slicing, matrices as (i, j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that distinct values are numbered in.
RANGES = 256


def islands(df: DataFrame, by: list[str], order: str, value: str, step: float = 1, tol: float = 1e-8, sort: bool = False) -> DataFrame:
    """df with island: the number of the contiguous sequence a row is in, one ending where the difference to the value before is not step.

    sort orders by the value itself.
    """
    w = Window.partitionBy(*by).orderBy(value if sort else order)
    broken = F.coalesce((F.abs(F.col(value) - F.lag(value).over(w) - step) > tol).cast("int"), F.lit(0))
    rows = df.withColumn("_b", broken)
    return rows.withColumn("island", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_b")


def const_seqs(df: DataFrame, by: list[str], order: str, value: str, tol: float = 1e-8, sort: bool = False) -> DataFrame:
    """(by, island, start, length, value): runs of constant values; start is the position from 0."""
    w = Window.partitionBy(*by).orderBy(value if sort else order)
    rows = islands(df, by, order, value, 0, tol, sort).withColumn("_pos", F.row_number().over(w) - 1)
    return rows.groupBy(*by, "island").agg(F.min("_pos").alias("start"), F.count("*").alias("length"), F.avg(value).alias("value"))


def first_const_seq(df: DataFrame, by: list[str], order: str, value: str, n: int, **options) -> DataFrame:
    """(by, start, length, value) of the first run of at least n values."""
    found = const_seqs(df, by, order, value, **options).where(F.col("length") >= n)
    return found.groupBy(*by).agg(F.min(F.struct("start", "length", "value")).alias("_s")).select(*by, "_s.*")


def longest_const_seq(df: DataFrame, by: list[str], order: str, value: str, **options) -> DataFrame:
    """(by, start, length, value) of the longest run, the first of equals."""
    found = const_seqs(df, by, order, value, **options)
    return found.groupBy(*by).agg(F.max(F.struct("length", (-F.col("start")).alias("_s"), "value")).alias("_m")).select(*by, (-F.col("_m._s")).alias("start"), F.col("_m.length").alias("length"), F.col("_m.value").alias("value"))


def sequenize(df: DataFrame, value: str, step: int = 1, start: int = 0, out: str = "seq") -> DataFrame:
    """df with the rank of the value among the distinct ones, times step, plus start.

    Distinct values are dealt into RANGES ranges by a sample of them and numbered there; the ranges' sizes give the
    offsets, so that no task numbers them all.  Nulls get a null.
    """
    distinct = df.select(F.col(value).alias("_v")).where(F.col(value).isNotNull()).distinct()
    bounds = sorted(r["_v"] for r in distinct.orderBy(F.xxhash64("_v"), "_v").limit(RANGES - 1).collect())
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("_v"))) if bounds else F.lit(0)
    inner = distinct.withColumn("_p", below).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_v")) - 1)
    sizes = distinct.groupBy(below.alias("_p")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    ranks = inner.join(F.broadcast(offsets), "_p").select("_v", (F.lit(start) + (F.col("_o") + F.col("_r")) * step).alias(out))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def group_values(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): the values of each key in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])
    return df.groupBy(key).agg(ordered.alias("values"))


def slice_frames(df: DataFrame, begin: int, end: int, every: int, frame: str = "frame") -> DataFrame:
    """The rows of every every-th frame from begin to end - 1; a filter that reaches the scan."""
    return df.where((F.col(frame) >= begin) & (F.col(frame) < end) & ((F.col(frame) - begin) % every == 0))


def symmetrize(matrix: DataFrame, lower: bool = True) -> DataFrame:
    """matrix(i, j, v) with one triangle mirrored on the other."""
    half = matrix.where("i >= j" if lower else "i <= j")
    return half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def tilt_diagonals(matrix: DataFrame, n: int, clockwise: bool = True) -> DataFrame:
    """matrix(i, j, v) of n columns with its (wrapped) diagonals as columns, or as rows."""
    d = F.pmod(F.col("j") - F.col("i"), F.lit(n))
    return matrix.select("i", d.alias("j"), "v") if clockwise else matrix.select(d.alias("i"), "j", "v")


def linear_region(series: DataFrame, window_length: int, tol: float = 0.1, delta: float = 1.0) -> DataFrame:
    """(id, t, x, linear): whether the second derivative of a local parabola is within tol of 0.

    The derivative is a fixed weighted sum over a window of odd length (Savitzky-Golay); at the ends, where the
    window does not fit, that of the nearest full window is taken.
    """
    if window_length % 2 == 0 or window_length < 3:
        raise ValueError("window_length must be odd and at least 3")
    h = window_length // 2
    points = range(-h, h + 1)
    s2, s4 = sum(k**2 for k in points), sum(k**4 for k in points)
    det = window_length * s4 - s2 * s2
    weights = [2 * (window_length * k * k - s2) / det / delta**2 for k in points]
    w = Window.partitionBy("id").orderBy("t")
    second = sum((F.lag("x", -k).over(w) * c if k < 0 else F.col("x") * c if k == 0 else F.lead("x", k).over(w) * c for k, c in zip(points, weights)), F.lit(0.0))
    rows = series.select("id", "t", "x", second.alias("_d"))
    ahead, behind = w.rowsBetween(0, h), w.rowsBetween(-h, 0)
    full = F.coalesce("_d", F.first("_d", True).over(ahead), F.last("_d", True).over(behind))
    return rows.select("id", "t", "x", (F.abs(full) <= tol).alias("linear"))


def number_names(atoms: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """atoms with names numbered from 1 in each group of by, in order.

    Without by all are one group, numbered in ranges (see sequenize) so that no task numbers them all; order is unique then.
    """
    if by:
        rows = atoms.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    else:
        rows = sequenize(atoms, order, 1, 1, "_n")
    return rows.withColumn(name, F.concat(F.regexp_replace(name, "[0-9]", ""), F.col("_n").cast("string"))).drop("_n")


def sort_by_names(atoms: DataFrame, name: str, wanted: list[str], order: str) -> DataFrame:
    """atoms sorted by the place of a name in a list, those not in it last."""
    rank = F.array_position(F.lit(wanted), F.col(name))
    return atoms.orderBy(F.when(rank == 0, len(wanted) + 1).otherwise(rank), order)
