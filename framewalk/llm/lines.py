"""Lines of texts as columns, for the operators that count lines across documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"


def lines_of(text: Column) -> Column:
    """The lines of a text, cut at each \\n; a null text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normalised(line: Column) -> Column:
    """A-Z in lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), BLANKS, " "))


#: The same in DuckDB's SQL, for a line in {0}.
NORMALISED_SQL = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
