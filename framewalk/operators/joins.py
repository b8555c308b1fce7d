"""Small tables beside large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df with the columns of a table of one row: an equi-join on a constant, that row being broadcast."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")
