"""SimHash near-dedup by tiled exact comparison.

Fingerprints are made once per row.  The distinct ones are dealt into tiles by
the population counts of their two halves; two fingerprints within the radius
lie in tiles whose counts differ by no more than the radius in sum, so all other
tile pairs are skipped.  The pairs that are left are compared whole, with numpy
exclusive-or and bit counts, and each gives a spanning forest of its links
(never all pairs of a group of copies).  Components of the forest's links are
the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table
from framewalk.llm.components import connected_components

#: Most fingerprints in a tile (1 MB); larger tiles are cut into parts by hash.  A tile is sent once for each pair that
#: it is in, so that larger tiles mean fewer bytes shuffled.
TILE = 1 << 17
#: Shingles that are hashed at a time.
BLOCK = 1 << 14
#: Pairs compared at a time.
CELLS = 1 << 20


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: ASCII letters in lower case, words between ASCII white space, shingles with repeats."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles: Iterator[bytes] = iter([b" ".join(w)])
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    n = max(1, len(w) - words + 1)
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for start in range(0, n, BLOCK):
        size = min(BLOCK, n - start)
        h = np.fromiter((hashed(s, seed) for s, _ in zip(shingles, range(size))), np.uint64, size)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(words: int = 4, seed: int = 42):
    """A column function: text -> fingerprint as a long (the same 64 bits, signed)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64))

    return of


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class Forest:
    """Sets of nodes 0..n-1, joined by arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.parent
        while i.size:
            a, b = p[i], p[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while True:
                q = p[p]
                if np.array_equal(q, p):
                    break
                p[:] = q


def quarters(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fp >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (0, 16, 32, 48)]).astype(np.int16)


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that join the same fingerprints as all pairs of a and b within the radius.

    Inside the tiles the same rule holds for smaller tiles: the rows of a with
    equal counts in the four quarters meet only those rows of b whose counts
    differ by no more than the radius in sum.
    """
    one = a is b
    forest, base = Forest(len(a) if one else len(a) + len(b)), 0 if one else len(a)
    qa, qb = quarters(a), quarters(b)
    order = np.lexsort(qa)
    cuts = np.flatnonzero(np.any(np.diff(qa[:, order], axis=1), axis=0)) + 1
    for rows in np.split(order, cuts):
        near = np.flatnonzero(np.abs(qb - qa[:, rows[:1]]).sum(axis=0) <= radius)
        step = max(1, CELLS // max(1, near.size))
        for s in range(0, rows.size if near.size else 0, step):
            part = rows[s : s + step]
            i, j = np.nonzero(np.bitwise_count(a[part][:, None] ^ b[near][None, :]) <= radius)
            forest.join(part[i], near[j] + base)
    values = a if one else np.concatenate([a, b])
    moved = np.flatnonzero(forest.parent != np.arange(len(values)))
    return values[moved], values[forest.parent[moved]]


def _tiles(distinct: DataFrame, size: int) -> DataFrame:
    """(tile, hi, lo, part, fps): at most about `size` fingerprints each."""
    keyed = distinct.select("fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"))
    parts = keyed.groupBy("hi", "lo").agg(F.ceil(F.count("*") / size).alias("parts"))  # at most 33 * 33 rows
    dealt = keyed.join(F.broadcast(parts), ["hi", "lo"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    tiles = dealt.groupBy("hi", "lo", "part").agg(F.collect_list("fp").alias("fps"))
    return tiles.withColumn("tile", (F.col("part") * 64 + F.col("hi")) * 64 + F.col("lo"))


def _tile_pairs(heads: DataFrame, radius: int) -> DataFrame:
    """(l, r) of tiles that may hold links, each pair once, a tile with itself too."""
    steps = [(i, j) for i in range(radius + 1) for j in range(-radius, radius + 1) if i + abs(j) <= radius and (i > 0 or j >= 0)]
    moves = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps)))
    left = heads.select(F.col("tile").alias("l"), "hi", "lo", moves.alias("d")).select("l", (F.col("hi") + F.col("d.i")).alias("hi"), (F.col("lo") + F.col("d.j")).alias("lo"), (F.col("d.i") + F.abs("d.j") == 0).alias("same"))
    return left.join(heads.withColumnRenamed("tile", "r"), ["hi", "lo"]).where("not same or l <= r").select("l", "r")


def fingerprint_links(distinct: DataFrame, radius: int, work: Workspace, tile: int = TILE) -> DataFrame:
    """(u, v): links that join exactly the fingerprints (column fp, distinct) joined by pairs within the radius."""
    tiles = work.keep(_tiles(distinct, tile), "tiles")
    pairs = _tile_pairs(tiles.select("tile", "hi", "lo"), radius)
    left, right = tiles.select(F.col("tile").alias("l"), F.col("fps").alias("a")), tiles.select(F.col("tile").alias("r"), F.col("fps").alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for l, r, x, y in zip(batch["l"].to_pylist(), batch["r"].to_pylist(), batch["a"], batch["b"]):
                a = x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                found.append(tile_links(a, a if l == r else y.values.to_numpy(zero_copy_only=False).view(np.uint64), radius))
            u = np.concatenate([np.empty(0, np.uint64), *(x for x, _ in found)]).view(np.int64)
            v = np.concatenate([np.empty(0, np.uint64), *(x for _, x in found)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return pairs.join(left, "l").join(right, "r").select("l", "r", "a", "b").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, tile: int = TILE) -> DataFrame:
    """One row per row of docs: (doc_id, fingerprint long, component_id).

    component_id is the least id whose fingerprint is reached by steps of at most
    `radius` differing bits.  Null and empty texts and texts of white space have
    fingerprint zero and are linked like any other.  Rows with a null id take
    part; a class of such rows alone has a null component_id.  An id that comes
    twice gives two rows.
    """
    work = Workspace(docs.sparkSession, "simhash")
    made = work.keep(docs.select(F.col(id_col).alias("doc_id"), fingerprints(words)(F.col(text_col)).alias("fp")), "fingerprints")
    distinct = work.keep(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(fingerprint_links(distinct, radius, work, tile), work)
    classed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = work.side(classed.select("fp", "root").join(least, "root").drop("root"), "classes", F.lit(2))
    work.drop("tiles", "distinct")
    return made.join(classes, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of docs, of which each class keeps the least id only.

    Rows that share that id all stay, and so do rows without an id.
    """
    found = near_duplicates(docs, **options)
    others = Workspace(docs.sparkSession, "simhash").side(found.where("component_id < doc_id").select("doc_id").distinct(), "others")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")
