"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def excel_colname(n: Column, upper: bool = True, letters: int = 14) -> Column:
    """Column name of a spreadsheet for a number: 1 is A, 27 is AA, 0 is '0'; signs are ignored.

    `letters` bounds the steps; 14 letters hold every 64-bit number.
    """
    step = F.sequence(F.lit(1), F.lit(letters))
    start = F.struct(F.abs(n.cast("long")).alias("n"), F.lit("").alias("s"))

    def digit(acc: Column, _: Column) -> Column:
        rest = acc["n"] - 1
        letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.pmod(rest, F.lit(26)) + 1).cast("int"), F.lit(1))
        return F.when(acc["n"] > 0, F.struct(F.call_function("div", rest, F.lit(26)).alias("n"), F.concat(letter, acc["s"]).alias("s"))).otherwise(acc)

    name = F.aggregate(step, start, digit, lambda acc: acc["s"])
    name = F.when(n == 0, F.lit("0")).otherwise(name)
    return name if upper else F.lower(name)


def excel_colnum(name: Column) -> Column:
    """The inverse of excel_colname; 0 for '0'."""
    letters = F.split(F.upper(name), "")
    total = F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0).cast("long"), lambda acc, x: acc * 26 + F.ascii(x) - 64)
    return F.when(name == "0", F.lit(0).cast("long")).otherwise(total)


def trailing_digits(n: Column, digit: int = 0) -> Column:
    """How often a number ends in a digit, one after the other."""
    s = n.cast("string")
    return F.length(s) - F.length(F.regexp_replace(s, f"{digit}+$", ""))


def numbered(name: Column, number: Column) -> Column:
    return F.concat(name, number.cast("string"))


def unnumbered(name: Column) -> Column:
    """A name without its digits."""
    return F.regexp_replace(name, "[0-9]", "")


def sci_notation_tex(x: Column, places: int = 1) -> Column:
    """A number as TeX, as in 1.5 \\times 10^{3}."""
    e = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
    return F.format_string(f"%.{places}f \\times 10^{{%d}}", x / F.pow(F.lit(10.0), e.cast("double")), e)
