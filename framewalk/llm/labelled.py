"""Labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows (in expectation) that a classifier is fitted on.
TRAIN_ROWS = 16_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int = TRAIN_ROWS) -> DataFrame:
    """(text, y, u): about `bound` labelled rows that are not held out, drawn by the id's hash; u is even in 0..1.

    Ids labelled more than once count once, with their largest label; rows without
    an id or a label do not count.  Texts that come twice count once, so that a group of copies
    weighs as one.  The ids drawn are few, so they are broadcast to the scan of docs.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    share = min(1.0, bound / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(target)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    once = rows.groupBy(F.xxhash64("text").alias("key")).agg(F.max_by("text", "doc_id").alias("text"), F.max("y").alias("y"))
    return once.select("text", "y", (F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(1000)) / 1000).alias("u"))
