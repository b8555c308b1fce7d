"""Array expressions, for sequences that are held in a row."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def take(a: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """A slice of an array; bounds as in Python, negative ones from the end, step positive."""
    n = F.size(a)
    bound = lambda x, other: other if x is None else F.lit(x) if x >= 0 else F.greatest(n + x, F.lit(0))
    low, high = bound(start, F.lit(0)), F.least(bound(stop, n), n)
    return F.filter(a, lambda _, i: (i >= low) & (i < high) & ((i - low) % step == 0))


def find_nearest(a: Column, value: Column, index: bool = False) -> Column:
    """The element nearest to a value, the first of equals; or its index from 0."""
    keyed = F.transform(a, lambda x, i: F.struct(F.abs(x - value).alias("d"), i.alias("i"), x.alias("x")))
    best = F.array_min(keyed)
    return best["i"] if index else best["x"]


def argmin_last(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))["i"]


def argmax_last(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]


def get_middle(a: Column, n: int = 1) -> Column:
    """The n innermost elements."""
    return F.slice(a, F.floor((F.size(a) - n) / 2).cast("int") + 1, F.lit(n))


def extend(a: Column, length: int, fill) -> Column:
    """The array padded at its end up to a length."""
    return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(a))))


def match_shape(a: Column, b: Column, fill) -> tuple[Column, Column]:
    """Both arrays padded to the length of the longer one."""
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(fill), n - F.size(x)))
    return pad(a), pad(b)


def ceil_divide(a: Column, b: Column) -> Column:
    return -F.floor(-a / b)


def moment_raw2cen(raw: list[Column]) -> Column:
    """The n-th central moment from the raw moments 1 .. n."""
    n, m = len(raw), [F.lit(1.0), *raw]
    return sum((comb(n, k) * F.pow(-raw[0], F.lit(float(n - k))) * m[k] for k in range(1, n + 1)), F.pow(-raw[0], F.lit(float(n))))


def digitize(x: Column, edges: list[float], right: bool = False) -> Column:
    """Index of the bin: 0 below the first edge, len(edges) from the last on; bins hold their left (or right) edge."""
    array = F.lit([float(e) for e in edges])
    return F.when(x.isNotNull(), F.size(F.filter(array, (lambda e: e < x) if right else (lambda e: e <= x))))


def digitize_dd(xs: list[Column], edges: list[list[float]], right: bool = False) -> Column:
    """One number for a bin in several dimensions, the last one running fastest, with a bin beyond either end of each."""
    out = F.lit(0)
    for x, e in zip(xs, edges):
        out = out * (len(e) + 1) + digitize(x, e, right)
    return out


def uniform_bin(x: Column, start: float, width: float, count: int) -> Column:
    """Bin 0 .. count - 1 of equal bins; -1 below, count from the end on.  No list of edges is walked."""
    k = F.floor((x - start) / width)
    return F.greatest(F.lit(-1), F.least(F.lit(count), k)).cast("int")
