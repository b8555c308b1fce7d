"""Merkle manifest of a dataset: leaves, roots, inclusion proofs, and their check.

Every row is hashed to a leaf where it is read.  A tree's leaves get their places
by a range partitioning, and are dealt into aligned blocks of fanout ** levels.
In a block the digests are a contiguous matrix of 64 hexadecimal bytes a row: a
level is the matrix below it, reshaped so that a row holds a run of nodes, and
hashed row by row; the siblings of all leaves at all levels are rows found by index
arithmetic.  A block's top is a node of the next round, so that a tree of n leaves
takes log n / log(block) rounds; the way from a block's top to the root then comes down
the same rounds, and meets each block once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table
from framewalk.llm.ordering import placed

#: Most leaves of a block.
BLOCK = 1 << 12
#: Columns of a leaf, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(*fields: Column) -> Column:
    """The lowercase hex sha256 of the fields, each `-` if null, else its length in UTF-8 bytes, `:` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


# ---- one block


def matrix(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)


def hashed(rows: np.ndarray) -> np.ndarray:
    """The digests of a matrix's rows, as a matrix of hex bytes."""
    rows = np.ascontiguousarray(rows)
    return matrix([sha256(r).hexdigest() for r in rows])


def levels_of(leaves: np.ndarray, fanout: int, steps: int | None) -> list[np.ndarray]:
    """The leaves and the levels above them: `steps` of them, or up to a single node."""
    levels = [leaves]
    while len(levels) <= steps if steps is not None else len(levels[-1]) > 1:
        below = levels[-1]
        full = len(below) // fanout
        up = hashed(below[: full * fanout].reshape(full, fanout * 64))
        if full * fanout < len(below):
            up = np.concatenate([up, hashed(below[full * fanout :].reshape(1, -1))])
        levels.append(up)
    return levels


def runs_of(levels: list[np.ndarray], fanout: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level but the last: the nodes of every leaf's run (-1 where the last run ends early), and the leaf's own place in it."""
    at = np.arange(len(levels[0]))
    for level in levels[:-1]:
        own = at % fanout
        run = (at - own)[:, None] + np.arange(fanout)
        yield np.where(run < len(level), run, -1), own
        at = at // fanout


def siblings_of(levels: list[np.ndarray], fanout: int) -> np.ndarray:
    """For each leaf, the rows of np.concatenate(levels) that hold its siblings, level by level, left to right; -1 for none."""
    out, start = [np.empty((len(levels[0]), 0), np.int64)], 0
    for level, (run, own) in zip(levels, runs_of(levels, fanout)):
        others = run[np.arange(fanout) != own[:, None]].reshape(len(run), fanout - 1)
        out.append(np.where(others < 0, -1, others + start))
        start += len(level)
    return np.hstack(out)


def proofs(levels: list[np.ndarray], fanout: int, above: bytes) -> np.ndarray:
    """The digest of each leaf's siblings, those above the block included."""
    nodes, rows = np.concatenate(levels), siblings_of(levels, fanout)
    held = (rows >= 0).sum(axis=1)
    out, end = np.empty((len(rows), 64), np.uint8), np.frombuffer(above, np.uint8)
    for n in np.unique(held):  # two widths in a block, or a few at its end
        same = np.flatnonzero(held == n)
        own = nodes[rows[same][rows[same] >= 0]].reshape(len(same), n * 64)
        out[same] = hashed(np.hstack([own, np.broadcast_to(end, (len(same), len(end)))]))
    return out


def folded(leaves: np.ndarray, levels: list[np.ndarray], fanout: int, left: list[str], right: list[str]) -> np.ndarray:
    """The root that each of `leaves`, in its place, makes with the siblings in levels and those above the block."""
    now = leaves
    for level, (run, own) in zip(levels, runs_of(levels, fanout)):
        held, up = (run >= 0).sum(axis=1), np.empty_like(now)
        for n in np.unique(held):
            same = np.flatnonzero(held == n)
            nodes = level[run[same, :n]]
            nodes[np.arange(len(same)), own[same]] = now[same]
            up[same] = hashed(nodes.reshape(len(same), n * 64))
        now = up
    for before, after in zip(left, right):
        sides = [np.broadcast_to(np.frombuffer(x.encode(), np.uint8), (len(now), len(x))) for x in (before, after)]
        now = hashed(np.hstack([sides[0], now, sides[1]]))
    return now


def texts(digests: np.ndarray) -> list[str]:
    whole = digests.tobytes().decode()
    return [whole[k : k + 64] for k in range(0, len(whole), 64)]


# ---- rounds of blocks


def _steps(block: int, levels: int) -> int | None:
    """The first block ends at a single node: when there are others it is full, so that this is the same."""
    return levels if block else None


def _tops(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, place, digest) of the blocks' tops."""

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = levels_of(matrix(rows.sort_values("place")["digest"].tolist()), fanout, _steps(key[1], levels))
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "digest": texts(made[-1])})

    block = F.floor(F.col("place") / fanout**levels).cast("long")
    return nodes.select("tree", block.alias("block"), "place", "digest").groupBy("tree", "block").applyInPandas(top, "tree string, place long, digest string")


def _ways(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, block, left, right, subroot, root) for each node, of those for the blocks of nodes: the way up begins with its own levels."""

    def ways(key: tuple, rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        made = levels_of(matrix(rows["digest"].tolist()), fanout, _steps(key[1], levels))
        left: list[list[str]] = [[] for _ in range(len(rows))]
        right: list[list[str]] = [[] for _ in range(len(rows))]
        for level, (run, own) in zip(made, runs_of(made, fanout)):
            names = texts(level)
            for k, (r, o) in enumerate(zip(run.tolist(), own.tolist())):
                left[k].append("".join(names[x] for x in r[:o]))
                right[k].append("".join(names[x] for x in r[o + 1 :] if x >= 0))
        top = up.iloc[0]
        return pd.DataFrame({"tree": key[0], "block": rows["place"].to_numpy(), "left": [x + list(top["left"]) for x in left], "right": [x + list(top["right"]) for x in right], "subroot": top["subroot"], "root": top["root"]})

    block = F.floor(F.col("place") / fanout**levels).cast("long")
    inside = nodes.select("tree", block.alias("block"), "place", "digest").groupBy("tree", "block")
    return inside.cogroup(above.groupBy("tree", "block")).applyInPandas(ways, WAY)


WAY = "tree string, block long, left array<string>, right array<string>, subroot string, root string"


def _climb(nodes: DataFrame, fanout: int, levels: int, work: Workspace, name: str) -> list[DataFrame]:
    """The nodes of each round, the last one with one node a tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("place")).first()[0] or 0) > 0:
        rounds.append(work.keep(_tops(rounds[-1], fanout, levels), f"{name}{len(rounds)}"))
    return rounds


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: list[str] | None = None, fanout: int = 2, block: int = BLOCK, changed: Column | None = None) -> DataFrame:
    """One row per row of docs: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

    A tree for each value of tree_col: leaves ascend by id (null first); while several nodes remain, each `fanout` in a
    row (the last run may be shorter, a single node too) become their hash.  The trees' subroots, ordered by the value (null
    first, by UTF-8 bytes), likewise become the root.  proof_sha256 is the hash of the siblings, level by level, left to right: of
    nothing where there are none.  folded_root is made from the siblings and the column `changed` (a leaf; null or none: the row's own).

    Rows of one id and tree are ordered by leaf, equal rows as they come.  A null id, value or text is hashed as `-`.  An
    empty table has no rows.
    """
    work = Workspace(docs.sparkSession, "merkle")
    levels = max(1, int(np.log(block) / np.log(fanout) + 1e-9))
    leaf = leaf_of(*(F.col(c) for c in fields or FIELDS))
    tree = F.when(F.col(tree_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string")))  # null comes first
    rows = docs.select(F.col(id_col).alias("doc_id"), tree.alias("tree"), leaf.alias("digest"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    leaves = work.keep(placed(rows, ["tree"], ["doc_id", "digest"], work, "hashed"), "leaves")
    rounds = _climb(leaves.select("tree", "place", "digest"), fanout, levels, work, "nodes")
    one = F.lit("")
    subroots = placed(rounds[-1].select("tree", "digest"), [], ["tree"], work, "subroots")
    tops = work.keep(subroots.select(one.alias("tree"), "place", "digest", F.col("tree").alias("of")), "trees")
    over = _climb(tops.select("tree", "place", "digest"), fanout, levels, work, "roots")
    nothing = F.array().cast("array<string>")
    ways = over[-1].select("tree", F.lit(0).cast("long").alias("block"), nothing.alias("left"), nothing.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for k, nodes in enumerate(reversed(over[:-1])):
        ways = work.keep(_ways(nodes, ways, fanout, levels), f"over{k}")
    # the place of a tree's subroot among the subroots is its block there
    ways = tops.drop("tree").withColumnRenamed("place", "block").join(ways.drop("subroot", "tree"), "block")
    ways = ways.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("block"), "left", "right", F.col("digest").alias("subroot"), "root")
    for k, nodes in enumerate(reversed(rounds[1:-1])):
        ways = work.keep(_ways(nodes, ways, fanout, levels), f"ways{k}")
    kind = docs.schema[id_col].dataType.simpleString()

    def checked(key: tuple, rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        own, top = matrix(rows["digest"].tolist()), up.iloc[0]
        made = levels_of(own, fanout, _steps(key[1], levels))
        left, right = list(top["left"]), list(top["right"])
        other = matrix(rows["changed"].fillna(rows["digest"]).tolist())
        above = "".join(a + b for a, b in zip(left, right)).encode()
        root = texts(folded(other, made, fanout, left, right))
        return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": top["subroot"], "root": top["root"], "proof_sha256": texts(proofs(made, fanout, above)), "folded_root": root, "verified": [x == top["root"] for x in root]})

    inside = leaves.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("block", F.floor(F.col("place") / fanout**levels).cast("long")).groupBy("tree", "block")
    return inside.cogroup(ways.groupBy("tree", "block")).applyInPandas(checked, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").withColumn("doc_id", F.col("doc_id").cast(kind))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = leaf_of(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS))
    return manifest(docs, changed=F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered))


#: DuckDB has no crc32: eight steps for each byte of a list of numbers in {0}.
CRC32_SQL = "xor(4294967295, list_reduce([4294967295] || {0}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"
_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in FIELDS) + ")"
_DIGITS = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
_UP = "list_transform(range(CAST((len(nodes) + 1) // 2 AS BIGINT)), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))"

OP12_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, leaf, CASE WHEN {CRC32_SQL.format(_DIGITS)} % 7 = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} ELSE leaf END AS now
  FROM (SELECT *, {_LEAF} AS leaf FROM documents)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows_),
levels(tree, level, nodes) AS (
  SELECT tree, 0, list(leaf ORDER BY place) FROM leaves GROUP BY tree
  UNION ALL SELECT tree, level + 1, {_UP} FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT tree, level AS depth, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS number FROM levels WHERE len(nodes) = 1),
over_(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY number) FROM subroots
  UNION ALL SELECT level + 1, {_UP} FROM over_ WHERE len(nodes) > 1),
top AS (SELECT nodes[1] AS root FROM over_ WHERE len(nodes) = 1),
steps AS (
  SELECT l.doc_id, l.leaf, l.tree, v.level, (l.place >> v.level) & 1 AS own, v.nodes[xor(l.place >> v.level, 1) + 1] AS other
  FROM leaves l JOIN levels v ON l.tree = v.tree WHERE len(v.nodes) > 1
  UNION ALL
  SELECT l.doc_id, l.leaf, l.tree, s.depth + v.level, (s.number >> v.level) & 1, v.nodes[xor(s.number >> v.level, 1) + 1]
  FROM leaves l JOIN subroots s ON l.tree = s.tree CROSS JOIN over_ v WHERE len(v.nodes) > 1),
ways AS (SELECT doc_id, leaf, tree, list(own ORDER BY level) AS own, list(other ORDER BY level) AS other FROM steps GROUP BY ALL),
folds(doc_id, leaf, tree, k, now) AS (
  SELECT doc_id, leaf, tree, 0, now FROM leaves
  UNION ALL
  SELECT f.doc_id, f.leaf, f.tree, k + 1, sha256(CASE WHEN w.own[k + 1] = 1 THEN w.other[k + 1] || now ELSE now || coalesce(w.other[k + 1], '') END)
  FROM folds f JOIN ways w ON f.doc_id = w.doc_id AND f.leaf = w.leaf AND f.tree = w.tree WHERE k < len(w.own))
SELECT l.doc_id, l.leaf, s.subroot, t.root, sha256(coalesce(array_to_string(w.other, ''), '')) AS proof_sha256, f.now AS folded_root, f.now = t.root AS verified
FROM leaves l JOIN subroots s ON l.tree = s.tree CROSS JOIN top t
LEFT JOIN ways w ON l.doc_id = w.doc_id AND l.leaf = w.leaf AND l.tree = w.tree
JOIN folds f ON l.doc_id = f.doc_id AND l.leaf = f.leaf AND l.tree = f.tree AND f.k = coalesce(len(w.own), 0)"""
