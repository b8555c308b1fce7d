"""Item changes along an ordered sequence: where values change, and how."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subtract_mic(x1: Column, x2: Column, amin: float, amax: float) -> Column:
    """x1 - x2 brought into [-(amax - amin) / 2, (amax - amin) / 2)."""
    gap = float(amax) - float(amin)
    if gap <= 0:
        raise ValueError("amax must be greater than amin")
    d = x1.cast("double") - x2.cast("double")
    return d - F.floor(d / F.lit(gap) + F.lit(0.5)) * F.lit(gap)


def diff_mic(df: DataFrame, by: list[str], order: str, value: str, amin: float, amax: float, out: str = "diff") -> DataFrame:
    """Minimum-image difference of each value to the one before it (null at the first)."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(out, subtract_mic(F.col(value), F.lag(value).over(w), amin, amax))


def _tests(change_type, rtol: float, atol: float) -> list[tuple[str, object]]:
    """(name, predicate of a difference) for each type asked for."""
    if change_type is None:
        return [("any", lambda d: d != 0)]
    if isinstance(change_type, str):
        named = {"higher": lambda d: d > 0, "lower": lambda d: d < 0}
        if change_type == "both":
            return list(named.items())
        if change_type not in named:
            raise ValueError(f"unknown change type {change_type!r}")
        return [(change_type, named[change_type])]
    wanted = list(change_type) if isinstance(change_type, Iterable) else [change_type]
    if not wanted:
        raise IndexError("change_type must not be empty")
    return [(f"{x:+g}", lambda d, x=x: F.abs(d - F.lit(x)) <= F.lit(atol + rtol * abs(x))) for x in wanted]


def type_names(change_type) -> list[str]:
    """The names that locate_changes gives to the types asked for."""
    return [name for name, _ in _tests(change_type, 0.0, 0.0)]


def locate_changes(df: DataFrame, by: list[str], order: str, value: str, discard_neg: str | None = None, change_type=None, rtol: float = 1e-5, atol: float = 1e-8, wrap: bool = False, tfic: bool = False, tlic: bool = False, mic: bool = False, amin: float | None = None, amax: float | None = None) -> DataFrame:
    """df with booleans `before` and `after`: last item before, first item after a change.

    change_type None, "higher", "lower", a number (the wanted difference), "both" or a
    list of numbers; with the last two each row is repeated for every type, named in
    column change_type.  wrap continues the sequence by itself; tfic and tlic count the
    first and last item as changes.  Sequences are the groups of `by`, ordered by
    `order`; one window sort on them is all that is shuffled.
    """
    if discard_neg not in (None, "start", "end", "both"):
        raise ValueError(f"unknown discard_neg {discard_neg!r}")
    if (tfic or tlic) and (discard_neg is not None or change_type is not None or wrap or mic):
        raise ValueError("tfic and tlic must not be used together with discard_neg, change_type, wrap or mic")
    if mic and (amin is None or amax is None):
        low, high = df.agg(F.min(value), F.max(value)).first()
        amin, amax = low if amin is None else amin, high if amax is None else amax
    w = Window.partitionBy(*by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.col(value)
    rows = df.withColumns({"_n": F.lead(x).over(w), "_p": F.lag(x).over(w), "_is_last": F.lead(order).over(w).isNull(), "_is_first": F.lag(order).over(w).isNull()})
    if wrap:
        rows = rows.withColumns({"_f": F.first_value(x).over(whole), "_l": F.last_value(x).over(whole)})
        rows = rows.withColumns({"_n": F.when(F.col("_is_last"), F.col("_f")).otherwise(F.col("_n")), "_p": F.when(F.col("_is_first"), F.col("_l")).otherwise(F.col("_p"))})

    def changed(start: Column, end: Column, test) -> Column:
        out = test(subtract_mic(end, start, amin, amax) if mic else end.cast("double") - start.cast("double"))
        if discard_neg in ("start", "both"):
            out = out & (start >= 0)
        if discard_neg in ("end", "both"):
            out = out & (end >= 0)
        return F.coalesce(out, F.lit(False))

    tests = _tests(change_type, rtol, atol)
    kinds = F.explode(F.array(*(F.struct(F.lit(name).alias("change_type"), (changed(x, F.col("_n"), t) | (F.col("_is_last") & tlic)).alias("before"), (changed(F.col("_p"), x, t) | (F.col("_is_first") & tfic)).alias("after")) for name, t in tests)))
    made = rows.withColumn("_k", kinds)
    named = ["_k.change_type"] if len(tests) > 1 else []
    return made.select(*df.columns, *named, "_k.before", "_k.after")


def either_end(found: DataFrame, ends: dict[str, str]) -> DataFrame:
    """The rows of found in which one of several booleans holds, a row for each that does; pin tells which (ends: its value -> the column)."""
    kinds = F.filter(F.array(*(F.when(F.col(c), F.lit(name)) for name, c in ends.items())), lambda x: x.isNotNull())
    return found.withColumn("pin", F.explode(kinds))


def change_positions(df: DataFrame, by: list[str], order: str, value: str, pin: str = "after", **options) -> DataFrame:
    """The rows of locate_changes that are `before` or `after` a change; with pin "both" each has a column pin that tells which."""
    if pin not in ("before", "after", "both"):
        raise ValueError(f"unknown pin {pin!r}")
    found = locate_changes(df, by, order, value, **options)
    found = either_end(found, {"before": "before", "after": "after"}) if pin == "both" else found.where(F.col(pin))
    return found.drop("before", "after")


def first_items(df: DataFrame, by: list[str], order: str, value: str, wrap: bool = False, prepend_first: bool = True) -> DataFrame:
    """Rows where a run of equal values starts; the first row too, unless told otherwise or wrap finds it equal to the last."""
    return locate_changes(df, by, order, value, wrap=wrap, tfic=prepend_first and not wrap).where("after").drop("before", "after")
