"""Pairs of rows of one key that lie a bounded number of frames apart.

Frames are cut into buckets.  A start goes to the buckets that its lags reach
into, and meets the rows of the same key and bucket: with a bound on
the lag each start meets as many rows as two or three buckets have, however long
the sequence is, and a long sequence's pairs are made by many tasks.  Where all starts count,
pairs of runs do instead of pairs of frames (run_overlaps).  Sums over all pairs of a
sequence, at every lag, need no pairs: correlate makes them by Fourier transforms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fewest frames of a bucket, and most: a longest lag beyond it makes a start go to several more buckets.
LEAST, MOST = 64, 4096


def bucket_width(max_lag: int) -> int:
    return max(LEAST, min(MOST, max_lag))


def lag_pairs(starts: DataFrame, later: DataFrame, keys: list[str], max_lag: int, frame0: str = "f0", frame: str = "frame", min_lag: int = 0) -> DataFrame:
    """starts joined with the rows of later that are min_lag .. max_lag frames after them, with the column lag.

    starts has keys and frame0, later keys and frame; their other columns must differ.
    """
    width = bucket_width(max_lag)
    bucket = lambda f: F.floor(f / F.lit(width))
    reach = F.sequence(bucket(F.col(frame0) + min_lag), bucket(F.col(frame0) + max_lag))
    left = starts.withColumn("_bucket", F.explode(reach))
    right = later.withColumn("_bucket", bucket(F.col(frame)))
    lag = (F.col(frame) - F.col(frame0)).cast("int")
    return left.join(right, [*keys, "_bucket"]).drop("_bucket").withColumn("lag", lag).where(F.col("lag").between(min_lag, max_lag))


def at_least(counts: DataFrame, grid: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """(keys, lag, name): for each lag of the grid (keys, lag) the sum of n over the rows of counts (keys, column, n) whose column is no less.

    One running sum over the distinct values and the lags, so that its cost goes with their number, not with its square.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("lag")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = counts.select(*keys, F.col(column).cast("long").alias("lag"), F.col("n").cast("long").alias("n"), F.lit(False).alias("asked"))
    both = both.unionByName(grid.select(*keys, F.col("lag").cast("long").alias("lag"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    return both.withColumn(name, F.sum("n").over(w)).where("asked").select(*keys, F.col("lag").cast("int").alias("lag"), name)


def in_runs(rows: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """(keys, t0, len): the runs of consecutive frames of each key; a frame counts once."""
    w = Window.partitionBy(*keys).orderBy(frame)
    island = (F.col(frame) - F.row_number().over(w)).alias("_island")
    return rows.select(*keys, frame).distinct().select(*keys, frame, island).groupBy(*keys, "_island").agg(F.min(frame).alias("t0"), F.count("*").alias("len")).drop("_island")


def run_overlaps(first: DataFrame, later: DataFrame, keys: list[str], max_lag: int, grid: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """(by, lag, name): the number of pairs of a frame in a run of first and the frame `lag` after it in a run of later, of equal keys.

    first has keys, by, t0 and len, later keys, t0 and len; grid has (by, lag), lags from 1 to max_lag.  As the lag grows, the overlap of two
    runs rises, stays and falls by one a step: a trapezoid, the sum of four ramps that begin at differences of the
    runs' ends.  So each pair of runs, however long, gives four numbers, which are summed by place; a lag's count is a running sum.
    Runs are cut at the borders of buckets, so that the pairs of one key are made by many tasks.
    """
    by = by or []
    width = bucket_width(max_lag)

    def pieces(runs: DataFrame, start: str, length: str) -> DataFrame:
        end = F.col("t0") + F.col("len")
        rows = runs.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor((end - 1) / width))))
        low = F.greatest(F.col("t0"), F.col("_bucket") * width)
        return rows.withColumns({start: low, length: F.least(end, (F.col("_bucket") + 1) * width) - low}).drop("t0", "len")

    a = pieces(first.select(*keys, *(c for c in by if c not in keys), "t0", "len"), "_a", "_la")
    a = a.withColumn("_bucket", F.explode(F.sequence(F.col("_bucket"), F.floor((F.col("_a") + F.col("_la") - 1 + max_lag) / width))))
    b = pieces(later.select(*keys, "t0", "len"), "_b", "_lb")
    pairs = a.join(b, [*keys, "_bucket"]).where("_b + _lb - 1 > _a")
    gap = F.col("_b") - F.col("_a")
    ramps = F.array(*(F.struct(at.cast("long").alias("at"), F.lit(sign).alias("d")) for at, sign in ((gap - F.col("_la"), 1), (gap, -1), (gap + F.col("_lb") - F.col("_la"), -1), (gap + F.col("_lb"), 1))))
    summed = pairs.select(*by, F.explode(ramps).alias("r")).groupBy(*by, F.col("r.at").alias("lag")).agg(F.sum("r.d").cast("long").alias("d"))
    return at_lags(summed, grid, name, by)


def at_lags(ramps: DataFrame, grid: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """(by, lag, name): at the lags of grid the sum of ramps (by, lag, d), each of which is 0 up to its lag and grows by d a step from there."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("lag").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = ramps.withColumn("asked", F.lit(False)).unionByName(grid.select(*by, F.col("lag").cast("long").alias("lag"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("asked")))
    value = F.col("lag") * F.sum("d").over(w) - F.sum(F.col("d") * F.col("lag")).over(w)
    return both.withColumn(name, value).where("asked and lag > 0").select(*by, F.col("lag").cast("int").alias("lag"), name)


def correlate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sums of a[t] * b[t + lag] for the lags 0 .. len - 1, in len * log(len) steps."""
    size = 1 << (2 * len(a) - 1).bit_length()
    return np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)[: len(a)]
