"""Checks and repairs of parameters on the driver."""

from __future__ import annotations

import warnings
from decimal import ROUND_DOWN, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_slicing(start: int, stop: int, step: int, n_frames_tot: int | None = None) -> tuple[int, int, int, int]:
    """(start, stop, step, number of frames) that fit a sequence of n_frames_tot frames."""
    n = stop if n_frames_tot is None else n_frames_tot
    start, step = max(0, start), max(1, step)
    if stop <= 0 or stop > n:
        stop = n
    if start >= stop:
        start = max(0, stop - step)
    step = min(step, max(1, stop - start))
    if (stop - start) % step > 1:
        stop -= (stop - start) % step - 1
    return start, stop, step, -(-(stop - start) // step)


def restarts(restart: int, every: int, n_frames: int) -> int:
    """Frames between starts as a multiple of every, at least that, in units of frames read."""
    restart = min(max(restart, every), n_frames * every)
    if restart % every:
        warnings.warn(f"restart {restart} is rounded down to a multiple of {every}", stacklevel=2)
    return max(1, restart // every)


def frame_lag(lag: int, every: int, n_frames_tot: int | None = None, allow_zero: bool = False) -> int:
    """A lag that is a multiple of every and shorter than the sequence."""
    if n_frames_tot is not None:
        lag = min(lag, n_frames_tot - 1)
    lag -= lag % every
    return max(lag, 0 if allow_zero else every)


def block_averaging(n_blocks: int, n_frames: int) -> tuple[int, int]:
    """(blocks, frames of each); frames that are left over are dropped."""
    n_blocks = min(max(1, n_blocks), n_frames)
    return n_blocks, n_frames // n_blocks


def n_restarts(n_frames: int, restart: int) -> list[int]:
    """Starts 0, restart, ... with a frame at each lag."""
    return [-(-(n_frames - lag) // restart) for lag in range(n_frames)]


def bins(start: float, stop: float, step: float | None = None, num: int | None = None, amin: float = 0, amax: float | None = None, precision: int = 9) -> tuple[float, float, float, int]:
    """(start, stop, step, num) of equal bins within [amin, amax], step or num being made of the other."""
    unit = Decimal(1).scaleb(-precision)
    cut = lambda x: Decimal(repr(float(x))).quantize(unit, rounding=ROUND_DOWN)
    a, b = cut(max(start, amin)), cut(stop if amax is None else min(stop, amax))
    if b <= a:
        raise ValueError("stop must be greater than start")
    if (step is None) == (num is None):
        raise ValueError("give either step or num")
    if num is None:
        width = min(cut(step), b - a)
        if width <= 0:
            raise ValueError("step must be positive")
        num = int((b - a) / width)
        b = a + width * num
    elif num < 1:
        raise ValueError("num must be at least 1")
    return float(a), float(b), float((b - a) / num), num


def distance_bins(lengths: tuple[float, float, float], start: float, stop: float, step: float | None = None, num: int | None = None, precision: int = 9) -> tuple[float, float, float, int]:
    """bins for distances under the minimum image convention in an orthorhombic box: none is longer than half its diagonal."""
    if min(lengths) <= 0:
        raise ValueError("box lengths must be positive")
    return bins(start, stop, step, num, amin=0, amax=sum(x * x for x in lengths) ** 0.5 / 2, precision=precision)


def bin_edges(edges: list[float], amin: float = 0, amax: float = 1, tol: float = 1e-6) -> list[float]:
    """Sorted distinct edges that cover [amin, amax]: the ends are added, the last one widened by tol."""
    inner = sorted({float(e) for e in edges})
    if not inner:
        raise ValueError("no edges")
    if inner[0] > amin:
        inner.insert(0, float(amin))
    if inner[-1] < amax:
        inner.append(float(amax))
    if abs(inner[-1] - amax) <= tol:
        inner[-1] = amax + tol
    return inner


def check_dtrj(dtrj: DataFrame) -> DataFrame:
    """One row that tells if a table is a state sequence: integral, without nulls, frames dense and each once."""
    whole = F.col("state").cast("double") == F.floor(F.col("state").cast("double"))
    each = dtrj.groupBy("cmp").agg(F.count("*").alias("n"), F.count_distinct("frame").alias("d"), F.min("frame").alias("a"), F.max("frame").alias("b"), F.count_if(~whole).alias("f"), F.count_if(F.col("state").isNull() | F.col("frame").isNull() | F.col("cmp").isNull()).alias("u"))
    return each.agg(F.count("*").alias("n_cmps"), F.max(F.col("b") + 1).alias("n_frames"), F.coalesce(F.bool_and((F.col("n") == F.col("d")) & (F.col("a") == 0) & (F.col("n") == F.col("b") + 1)), F.lit(True)).alias("dense"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_fractions"), F.coalesce(F.sum("u"), F.lit(0)).alias("n_nulls"))


def check_boxes(boxes: DataFrame) -> DataFrame:
    """One row: boxes with a length that is not positive, and with an angle outside (0, 180) if there are angles."""
    bad = (F.col("lx") <= 0) | (F.col("ly") <= 0) | (F.col("lz") <= 0)
    angles = [F.col(a) for a in ("alpha", "beta", "gamma") if a in boxes.columns]
    skew = F.lit(False)
    for a in angles:
        skew = skew | (a <= 0) | (a >= 180)
    return boxes.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad_lengths"), F.count_if(skew).alias("bad_angles"))


def check_time_step(frames: DataFrame, time: str = "time", frame: str = "frame") -> DataFrame:
    """(min_dt, max_dt) between consecutive frames: over chunks of frames, so that no task sorts them all."""
    rows = frames.select(F.col(frame).alias("f"), F.col(time).alias("t")).distinct()
    later = rows.select((F.col("f") - 1).alias("f"), F.col("t").alias("t1"))
    return rows.join(later, "f").agg(F.min(F.col("t1") - F.col("t")).alias("min_dt"), F.max(F.col("t1") - F.col("t")).alias("max_dt"))


def check_masses(atoms: DataFrame) -> DataFrame:
    """One row: atoms, those without and those with a mass that is not positive."""
    return atoms.agg(F.count("*").alias("n"), F.count_if(F.col("mass").isNull()).alias("missing"), F.count_if(F.col("mass") <= 0).alias("not_positive"))


def describe_atoms(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """(attribute, n_distinct) of the columns named, in one pass."""
    made = atoms.agg(*(F.count_distinct(k).alias(k) for k in keys))
    return made.select(F.explode(F.array(*(F.struct(F.lit(k).alias("attribute"), F.col(k).alias("n_distinct")) for k in keys))).alias("k")).select("k.*")


# ---- the same rules for columns, so that a table of parameters is checked where it is


def restarts_by_lag(lengths: DataFrame, keys: list[str], n_frames: str, restart: int) -> DataFrame:
    """(keys, lag, starts): n_restarts of each row's number of frames."""
    rows = lengths.select(*keys, F.col(n_frames).cast("long").alias("_n"), F.explode(F.sequence(F.lit(0), F.col(n_frames).cast("int") - 1)).alias("lag"))
    return rows.select(*keys, "lag", F.ceil((F.col("_n") - F.col("lag")) / restart).cast("int").alias("starts"))


def checked_blocks(n_blocks: Column, n_frames: Column) -> list[Column]:
    """block_averaging of columns: blocks, frames of each."""
    blocks = F.least(F.greatest(F.lit(1), n_blocks), n_frames)
    return [blocks, F.floor(n_frames / blocks)]


def checked_restart(restart: Column, every: int, n_frames: Column) -> Column:
    """restarts of columns: the frames between starts, counted in read frames."""
    return F.greatest(F.lit(1), F.floor(F.least(F.greatest(restart, F.lit(every)), n_frames * every) / every))


def checked_lag(lag: Column, every: int, n_frames: Column) -> Column:
    """frame_lag of columns: a multiple of every, less than the number of frames, every at least."""
    most = F.least(lag, n_frames - 1)
    return F.greatest(most - most % every, F.lit(every))


def bins_of(df: DataFrame, keys: list[str], x: str, num: int | None = None, step: float | None = None, amin: float | None = None, amax: float | None = None) -> DataFrame:
    """(keys, start, stop, step, num): bins over each group's range of x, cut to [amin, amax]; groups of one value have none."""
    if (step is None) == (num is None):
        raise ValueError("give either step or num")
    low, high = F.min(x).cast("double"), F.max(x).cast("double")
    low, high = (F.greatest(low, F.lit(float(amin))) if amin is not None else low), (F.least(high, F.lit(float(amax))) if amax is not None else high)
    ends = df.groupBy(*keys).agg(low.alias("start"), high.alias("_stop")).where("_stop > start")
    if num is not None:
        return ends.select(*keys, "start", F.col("_stop").alias("stop"), ((F.col("_stop") - F.col("start")) / num).alias("step"), F.lit(num).alias("num"))
    width = F.least(F.lit(float(step)), F.col("_stop") - F.col("start"))
    n = F.floor((F.col("_stop") - F.col("start")) / width)
    return ends.select(*keys, "start", (F.col("start") + width * n).alias("stop"), width.alias("step"), n.cast("int").alias("num"))


def distance_bins_of(boxes: DataFrame, keys: list[str], num: int) -> DataFrame:
    """(keys, start, stop, step, num): distance_bins from 0 on of each row's orthorhombic box, up to half its diagonal."""
    half = F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly") + F.col("lz") * F.col("lz")) / 2
    return boxes.where("lx > 0 and ly > 0 and lz > 0").select(*keys, F.lit(0.0).alias("start"), half.alias("stop"), (half / num).alias("step"), F.lit(num).alias("num"))


def bin_edges_of(edges: Column, amin: float = 0, amax: float = 1, tol: float = 1e-6) -> Column:
    """bin_edges of an array column: sorted distinct edges within (amin, amax), the ends added, the last one widened by tol."""
    inner = F.filter(F.array_sort(F.array_distinct(edges)), lambda e: (e > amin) & (e < amax))
    return F.concat(F.array(F.lit(float(amin))), inner, F.array(F.lit(float(amax + tol))))
