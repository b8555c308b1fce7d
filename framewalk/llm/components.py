"""Connected components of a link table by alternating large-star and small-star.

Both steps are grouped minima and joins on DataFrames.  A hub never meets in one
task as a list: its links stay rows and the minimum is aggregated before the
shuffle.  The minima are written before their join: few are broadcast, so that links are
not dealt out by a node at all; with many, both sides of the join are plain exchanges, whose
large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace


def _least_neighbour(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    return work.side(links.groupBy("u").agg(F.min("v").alias("m")), name, F.lit(2))


def _large_star(links: DataFrame, work: Workspace) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both, work, "least1").withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, work: Workspace) -> DataFrame:
    least = _least_neighbour(links, work, "least2")
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def connected_components(links: DataFrame, work: Workspace, rounds: int = 60) -> DataFrame:
    """(u, v) links of long ids -> (node, root), root being the least id of the component.

    Roots themselves and nodes without a link to another one are not returned.  Direction, repeated
    links and links of a node to itself do not matter; links with a null are
    ignored.  Every round is written to the shared folder; the loop ends when a
    round leaves the link set as it was (each then points to its root).
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, seen = work.keep(links, "links0"), None
    for k in range(1, rounds + 1):
        stars = work.keep(_large_star(links, work), "stars")
        links = work.keep(_small_star(stars, work), f"links{k}")
        work.drop(f"links{k - 1}", "stars", "least1", "least2")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(now)
    raise RuntimeError(f"components are not settled after {rounds} rounds")
