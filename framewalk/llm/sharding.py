"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries, by which all rows are
dealt into ranges.  Ranges that turn out overfull are subdivided.  Prefix sums
over the ranges, and inside each, then give every row its place in the one order
of all rows, and with it a shard and a slot.  Only the sample, the boundaries and
the sums of the ranges (all of bounded number) ever come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table

#: Ranges, and the expected rows of the sample that finds their boundaries.
RANGES, SAMPLE = 1024, 1 << 14
#: A range with more than so many times its even share is subdivided.
OVERFULL = 2
#: A row of more than this part of a shard is dealt out by itself.
GIANT = 64


def key_of(group: Column, row: Column) -> Column:
    """40 bits of the group's hash, then 24 of the row's: equal groups lie together and can still be cut."""
    return F.xxhash64(group).bitwiseAND(F.lit(-1 << 24)).bitwiseOR(F.xxhash64(row, F.lit("row")).bitwiseAND(F.lit((1 << 24) - 1)))


def tie_of(group: Column, row: Column, *rest: Column) -> Column:
    """The full hash of the group, the row's id, and the hash of the rest: the same rows get the same places in every run."""
    return F.struct(F.xxhash64(group, F.lit("tie"), *rest).alias("h"), row.cast("string").alias("id"))


def splitters(rows: DataFrame, total: int, ranges: int, sample: int) -> list[int]:
    """At most ranges - 1 boundaries: quantiles of a sample in which a row's chance goes with its size."""
    chance = F.shiftrightunsigned(F.xxhash64("key", "size", F.lit("sample")), 11) / F.lit(float(1 << 53))
    drawn = rows.where(chance * F.lit(float(total)) < F.lit(float(sample)) * F.col("size")).select("key")
    ordered = drawn.agg(F.sort_array(F.collect_list("key")).alias("k"))
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda j: F.get("k", F.floor(j * F.size("k") / F.lit(ranges)).cast("int")))
    found = ordered.select(F.array_compact(F.array_distinct(at)).alias("b")).first()
    return found["b"]


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of boundaries that are not above the key, by bisection."""
    steps = [1 << i for i in reversed(range(max(1, len(bounds).bit_length())))]
    array = F.lit(bounds).cast("array<bigint>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda low, step: F.when(F.get(array, low + step - 1) <= key, low + step).otherwise(low))


def _ordered(rows: DataFrame, total: int, work: Workspace, ranges: int, sample: int) -> DataFrame:
    """rows with their place in the one order: middle (twice the bytes up to a row's middle) and at (its number, from 0)."""
    ranged = rows.withColumn("range", range_of(F.col("key"), splitters(rows, total, ranges, sample)))
    share = max(1, total // ranges)
    full = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).select("range", F.when(F.col("bytes") > OVERFULL * share, F.ceil(F.col("bytes") / share)).otherwise(1).alias("parts"))
    full = work.keep(full, "ranges")  # at most `ranges` rows
    cut = ranged.join(F.broadcast(full), "range").withColumn("cut", F.pmod(F.xxhash64("key", "size", F.lit("cut")), "parts")).drop("parts")
    before = Window.orderBy("range", "cut").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut.groupBy("range", "cut").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    cells = cells.select("range", "cut", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows0"))
    cells = work.keep(cells, "cells")  # at most 2 * ranges rows and one
    inside = Window.partitionBy("range", "cut").orderBy("key", "size", "tie")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = cut.join(F.broadcast(cells), ["range", "cut"]).withColumn("middle", 2 * (F.col("bytes0") + upto) - F.col("size")).withColumn("at", F.col("rows0") + F.row_number().over(inside) - 1)
    return placed.drop("range", "cut", "bytes0", "rows0")


def place(rows: DataFrame, shards: int, work: Workspace, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """rows (with columns key, size and tie, size at least 1) with shard and slot added, near equal in bytes.

    tie orders what is equal in key and size; rows that are equal in it, too, must be interchangeable.

    Rows of more than 1 / GIANT of a shard are fewer than GIANT * shards; they are dealt
    out first, largest first and to and fro.  The others fill what is left of each
    shard in the order of their ranges, so that a shard is off by less than 1 / GIANT.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    giant = F.col("size") * F.lit(GIANT * shards) > F.lit(total)
    turn = F.row_number().over(Window.orderBy(F.desc("size"), "key", "tie")) - 1
    fro = F.floor(turn / shards) % 2 == 1
    giants = rows.where(giant).withColumn("shard", F.when(fro, shards - 1 - turn % shards).otherwise(turn % shards).cast("int"))
    giants = work.keep(giants, "giants")
    taken = {r["shard"]: r["b"] for r in giants.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    room = [max(0, total / shards - taken.get(s, 0)) for s in range(shards)]
    rest, free = total - sum(taken.values()), sum(room)
    edges = [int(2 * rest * sum(room[: s + 1]) / free) for s in range(shards - 1)] if free else []
    few = _ordered(rows.where(~giant), rest, work, ranges, sample)
    few = work.keep(few.withColumn("shard", range_of(F.col("middle"), edges)).drop("middle"), "placed")
    starts = work.keep(few.groupBy("shard").agg(F.min("at").alias("start"), F.count("*").alias("n")), "starts")  # a row a shard
    slots = few.join(F.broadcast(starts.drop("n")), "shard").withColumn("slot", F.col("at") - F.col("start")).drop("at", "start")
    after = F.row_number().over(Window.partitionBy("shard").orderBy("key", "size", "tie")) - 1
    last = giants.join(F.broadcast(starts.drop("start")), "shard", "left").withColumn("slot", F.coalesce("n", F.lit(0)) + after).drop("n")
    return slots.unionByName(last)


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_table(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: (doc_id, size, text_crc32, shard, slot), by the law `bytes`.

    The order of rows is by key and size, the key being made of the text's and the
    id's hash: equal texts lie together in one shard, but for groups that reach over
    a boundary and for very long texts.  Shards differ from an even share of the
    bytes by about a 64th at most, unless one row alone is larger than a shard.  A
    null text counts as empty; rows with a null id are placed like any other.
    """
    work = Workspace(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_size(F.col(text_col)).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key_of(text, F.col(id_col)).alias("key"), tie_of(text, F.col(id_col)).alias("tie"))
    return place(work.keep(rows, "rows"), shards, work, ranges, sample).select("doc_id", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of docs as Parquet below path, a folder for each shard, ordered by slot inside each file."""
    work = Workspace(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_size(F.col(text_col)).alias("size"), key_of(text, F.col(id_col)).alias("key"), tie_of(text, F.col(id_col), *rest).alias("tie"))
    placed = place(rows, shards, work)
    placed.select("shard", "slot", "row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shard_table(table(spark, sf_dir, "documents"), 16)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
