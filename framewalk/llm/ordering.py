"""Places in an order that no task sees whole: range partitioning, then prefix sums over the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace


def placed(frame: DataFrame, groups: list[str], order: list[str], work: Workspace, name: str) -> DataFrame:
    """frame with column `place`: a row's number, from 0 and without gaps, among those of its group, in ascending order.

    Values of `groups` must not be null; nulls in `order` come first.  Rows that are equal in all of `order` get their places in
    any order, but do not pile up in one task: the row's number in its input partition parts them.
    """
    keys = [*groups, *order, "_from"]
    rows = frame.withColumn("_from", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_from")
    rows = work.keep(rows.withColumn("_at", F.monotonically_increasing_id()), name)  # partition << 33 | row
    part = F.shiftright("_at", 33).alias("_part")
    runs = rows.groupBy(*groups, part).agg(F.count("*").alias("n"), F.min("_at").alias("first"))  # each group's rows in a partition follow each other
    before = Window.partitionBy(*groups, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift")
    shifts = work.side(runs.select(*groups, "_part", shift), f"{name}-shifts", F.lit(2 + len(groups)))
    found = rows.withColumn("_part", part).join(shifts, [*groups, "_part"])
    return found.select(*frame.columns, (F.col("_at") + F.col("_shift")).alias("place"))
