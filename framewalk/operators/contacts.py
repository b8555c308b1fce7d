"""Contacts: the distance join of two particle sets, and what is made of its pairs.

A contact table has (frame, ref, sel), one row for each pair within the cutoff; count
tables have a further column n.  Sets of compounds that may have no contact at all are
given as tables of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from framewalk.functions import geometry
from framewalk.operators import near
from framewalk.operators.lags import at_lags, at_least, in_runs, lag_pairs, run_overlaps
from framewalk.session import importable, kept

AXES = ("x", "y", "z")
#: Particles of a cell from which on it is dealt out.
CROWD = 1 << 13
#: Pairs of a block or task, and fewest of them.
PAIRS, FEWEST = 1_500_000, 16
#: Pairs of a block whose pairs are not rows; where what leaves it is no more than particles, most blocks for the sake of its pairs, and particles that it holds.
BLOCK_PAIRS, BLOCKS, HELD = 4_000_000, 64, 1_500_000
#: Column of the block of a pair of compounds, in tables that come from contact_pairs with blocks.
BLOCK = "block"
#: Column of the number of runs of a pair of compounds, in tables that come from compound_pairs.
RUNS = "runs"


def min_image(d: Column, length: Column) -> Column:
    return d - F.floor(d / length + 0.5) * length


def block_of(rows: DataFrame) -> list[str]:
    """The key that goes before a pair of compounds in groups and windows, where there is one: a pair's block, by which the rows are partitioned."""
    return [BLOCK] if BLOCK in rows.columns else []


_LOWER = [(i, k) for i in range(3) for k in range(i + 1)]


def _shapes(boxes: DataFrame, cutoff: float) -> DataFrame:
    """(frame, lx, ly, lz or a skewed box's lower triangle m00 .. m22, nx, ny, nz): what pairs and cells need of a box, made once for each box.

    nx, ny, nz are the numbers of cells, from the distances of opposite faces: volume by the area of a face.
    """
    box = geometry.box_columns(boxes.columns)
    if len(box) == 3:
        heights, kept_ = [F.col(c) for c in box], [F.col(c) for c in box]
    else:
        a, b, c = matrix = geometry.box_matrix(box)
        cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
        volume = a[0] * b[1] * c[2]
        heights, kept_ = [volume / geometry.norm(cross(u, v)) for u, v in ((b, c), (c, a), (a, b))], [matrix[i][k].alias(f"m{i}{k}") for i, k in _LOWER]
    return boxes.select("frame", *kept_, *(F.greatest(F.lit(1), F.floor(h / cutoff)).alias(f"n{x}") for x, h in zip(AXES, heights)))


def _blocks(one: DataFrame, many: DataFrame, cell: list[str], most: int | None = None) -> tuple[int, int]:
    """(number of blocks for about PAIRS, or so many, contacts each, frames), from the particles of equal cells: a sphere has about 4 times the content of a cell."""
    count = lambda rows, name: rows.groupBy(*cell).agg(F.count("*").alias(name))
    pairs, frames = count(one, "_l").join(count(many, "_r"), cell).agg(F.sum(4.2 * F.col("_l") * F.col("_r")), F.count_distinct("frame")).first()
    return max(FEWEST, math.ceil((pairs or 0) / (most or PAIRS))), max(1, frames)


def _few_blocks(left: DataFrame, right: DataFrame, cell: list[str], by_frame: bool) -> tuple[int, int]:
    """As _blocks, where a block's pairs are taken part by part: no more than BLOCKS, unless its particles would be more than HELD, since each block of a row of the grid gets them."""
    count = lambda rows, name: rows.groupBy(*cell).agg(F.count("*").alias(name))
    cells = count(left, "_l").join(count(right, "_r"), cell, "full_outer")
    pairs, particles, frames = cells.agg(F.sum(4.2 * F.col("_l") * F.col("_r")), F.sum(F.coalesce("_l", F.lit(0)) + F.coalesce("_r", F.lit(0))), F.count_distinct("frame")).first()
    side = math.ceil((particles or 0) / (HELD * (max(1, frames) if by_frame else 1)))
    most = math.ceil((particles or 0) / HELD) if by_frame else 0  # frames that share a block
    return max(FEWEST, min(BLOCKS, math.ceil((pairs or 0) / BLOCK_PAIRS)), most, side * side * (max(1, frames) if by_frame and side > 1 else 1)), max(1, frames)


def _numbered(left: DataFrame, right: DataFrame, sides: tuple[str, str], blocks: str, most: tuple[int, int]) -> tuple[DataFrame, DataFrame, int]:
    """left and right with a column block, and the number of blocks: a grid of compounds by compounds, each row of a side in all blocks that its compound has in the grid.

    A grid of n by n blocks holds each particle n times; with blocks of frames every frame has a grid of its own.
    """
    n, frames = most
    by_frame = blocks == "frames"
    side = math.ceil(math.sqrt(-(-n // frames) if by_frame else n))
    parts = side * side if not by_frame else min(frames, n) if side == 1 else frames * side * side
    at = F.col("frame") * (side * side) if by_frame else F.lit(0)

    def placed(rows: DataFrame, compound: str, along: int) -> DataFrame:
        own, other = F.pmod(F.xxhash64(compound), F.lit(side)), F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
        place = (own * side + F.col("_other")) if along == 0 else (F.col("_other") * side + own)
        return rows.withColumn("_other", other).withColumn(BLOCK, F.pmod(at + place, F.lit(parts)).cast("int")).drop("_other")

    return placed(left, sides[0], 0), placed(right, sides[1], 1), parts


def _in_blocks(left: DataFrame, right: DataFrame, sides: tuple[str, str], blocks: str, most: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """_numbered, left and right partitioned by block."""
    left, right, parts = _numbered(left, right, sides, blocks, most)
    return left.repartitionById(parts, F.col(BLOCK)), right.repartitionById(parts, F.col(BLOCK))


def _dealt(left: DataFrame, right: DataFrame, crowded: DataFrame, cell: list[str], number: str) -> tuple[DataFrame, DataFrame]:
    """left and right with a column part, 0 in cells that are not crowded: each row of right in one part of its cell, each of left in all of them."""
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(crowded, cell, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    right = right.join(crowded, cell, "left").withColumn("part", F.pmod(F.xxhash64(number), parts).cast("int")).drop("parts")
    return left, right


def _matrix() -> list[list[Column]]:
    return [[F.col(f"m{i}{k}") if k <= i else F.lit(0.0) for k in range(3)] for i in range(3)]


def _by_cell(ref: DataFrame, sel: DataFrame, cutoff: float, boxes: DataFrame | None, spread: str, compound: str | None) -> tuple:
    """(the set that is spread, with its cell, its box and the numbers of cells; the other one, with its cell; columns of the box, those of its shape, and by axis the cells to go to)."""
    box = geometry.box_columns(boxes.columns) if boxes is not None else None
    shape: list[str] = []
    if boxes is not None:
        shapes = _shapes(boxes, cutoff)
        shape = shapes.columns[1:-3]
        ref, sel = (p.join(shapes, "frame") for p in (ref, sel))
    xyz = tuple(F.col(a).cast("double") for a in AXES)
    cells, steps = {}, {}
    if box is None:
        for a, x in zip(AXES, xyz):
            cells[a] = F.floor(x / cutoff)
            steps[a] = F.array(*(F.col(f"_c{a}") + k for k in (-1, 0, 1)))
    else:
        parts = [x / F.col(c) for x, c in zip(xyz, box)] if len(box) == 3 else geometry.cart2box(xyz, _matrix())
        for a, frac in zip(AXES, parts):
            n = F.col(f"n{a}")
            cells[a] = F.least(n - 1, F.floor((frac - F.floor(frac)) * n))
            steps[a] = F.array_distinct(F.array(*(F.pmod(F.col(f"_c{a}") + k, n) for k in (-1, 0, 1))))
    one, many = (ref, sel) if spread == "ref" else (sel, ref)
    other = "sel" if spread == "ref" else "ref"
    of = lambda side: [F.col(compound).alias(f"{side}_cmp")] if compound else []
    left = one.select("frame", spread, *of(spread), *(F.col(a).cast("double").alias(f"r{a}") for a in AXES), *shape, *([f"n{a}" for a in AXES] if box else []), *(cells[a].alias(f"_c{a}") for a in AXES))
    right = many.select("frame", other, *of(other), *(x.alias(a) for a, x in zip(AXES, xyz)), *(cells[a].alias(f"c{a}") for a in AXES))
    return left, right, box, shape, steps


def contact_pairs(ref: DataFrame, sel: DataFrame, cutoff: float, boxes: DataFrame | None = None, spread: str = "ref", compound: str | None = None, blocks: str | None = None) -> DataFrame:
    """(frame, ref, sel, dist[, ref_cmp, sel_cmp][, block]) of all pairs at most cutoff apart.

    ref has (frame, ref, x, y, z), sel (frame, sel, x, y, z), boxes (frame, lx, ly, lz[, alpha, beta, gamma]), or is
    None without periodic boundaries.  Space is cut into cells (along the box vectors) no
    smaller than the cutoff; each particle of one set is met by those of the other in the cells
    around it, as an equi-join on frame and cell.  Cells that coincide because a box has
    fewer than three of them are entered once.  The work is in proportion to the pairs of neighbouring cells.
    A crowded cell, of more than CROWD particles, is dealt out: its particles by number into parts, those of the other set into each, so that
    no task has more than CROWD particles of one cell at a time.  Cells are counted for it when the function is called.
    spread is the set whose particles are put into up to 27 cells each: the smaller one.  compound is a column of both sets
    that the pairs keep, so that sums by compound need no further join.

    Pairs are many more than particles, so with blocks it is the particles that are shuffled: "pairs" puts all contacts of two compounds
    into one partition, "frames" those of each frame, and the pairs have the block's number.  What groups by block, compounds
    (and frame) then stays in its partition.  The number of blocks comes from a count of the cells.
    """
    if spread not in ("ref", "sel"):
        raise ValueError(f"unknown spread {spread!r}")
    if blocks not in (None, "pairs", "frames") or (blocks and not compound):
        raise ValueError("blocks is pairs or frames, with a compound")
    left, right, box, shape, steps = _by_cell(ref, sel, cutoff, boxes, spread, compound)
    other = "sel" if spread == "ref" else "ref"
    cell = ["frame", "cx", "cy", "cz"]
    streams = right.isStreaming or left.isStreaming
    most = None if streams else _blocks(left.withColumnsRenamed({f"_c{a}": f"c{a}" for a in AXES}), right, cell)
    if blocks:
        left, right = _in_blocks(left, right, (f"{spread}_cmp", f"{other}_cmp"), blocks, most)
    for a in AXES:
        left = left.withColumn(f"c{a}", F.explode(steps[a]))
    left = left.drop(*(f"{k}{a}" for a in AXES for k in ("_c", "n")))
    if blocks:
        cell, right = [BLOCK, *cell], right.hint("shuffle_hash")
    elif not streams:
        crowded = right.groupBy(*cell).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")).where("parts > 1")
        if not crowded.isEmpty():
            left, right = _dealt(left, right, kept(crowded, "crowded"), cell, other)
            cell = [*cell, "part"]
        left, right = (p.repartition(most[0], *cell) for p in (left, right))  # by the pairs, not by the bytes of the particles
    pairs = left.join(right, cell)
    chosen = ["frame", "ref", "sel", "dist", *(["ref_cmp", "sel_cmp"] if compound else []), *([BLOCK] if blocks else [])]
    d = [F.col(a) - F.col(f"r{a}") for a in AXES]
    if box is not None and len(box) > 3:
        return _near_skewed(pairs, d, _matrix(), cutoff).select(*chosen)
    squared = sum((x * x for x in geometry.min_image(d, box)), F.lit(0.0))
    return pairs.withColumn("dist", F.sqrt(squared)).where(F.col("dist") <= cutoff).select(*chosen)


def _in_cells(ref: DataFrame, sel: DataFrame, cutoff: float, boxes: DataFrame | None, compound: str | None) -> tuple:
    """(ref and sel with their cells, as blocks take them; columns of the shape of the box, and of the cell); without what has no cell."""
    left, right, _, shape, _ = _by_cell(ref, sel, cutoff, boxes, "ref", compound)
    left = left.withColumnsRenamed({f"_c{a}": f"c{a}" for a in AXES})
    cell = ["frame", *(f"c{a}" for a in AXES)]
    left, right = (rows.withColumns({c: F.col(c).cast("long") for c in (*cell, *(f"n{a}" for a in AXES)) if c in rows.columns}).dropna(subset=cell) for rows in (left, right))
    return left, right, shape, cell


def particle_pairs(ref: DataFrame, sel: DataFrame, cutoff: float, boxes: DataFrame | None = None) -> DataFrame:
    """(frame, ref, sel, dist) of contact_pairs, for pairs that are many more than particles: found block by block (operators/near.py).

    The particles are shuffled once for each block of a row of the grid of their frame, as few times as memory allows, and not into the cells around each.  Pairs
    leave a task as they are found, a batch at a time: they are not sorted, not shuffled and not held.
    """
    importable(ref.sparkSession)
    left, right, shape, cell = _in_cells(ref, sel, cutoff, boxes, None)
    blocks = _numbered(left, right, ("ref", "sel"), "frames", _few_blocks(left, right, cell, True))
    schema = StructType([ref.schema["frame"], ref.schema["ref"], sel.schema["sel"], StructField("dist", DoubleType())])
    return _streamed(*blocks, schema, lambda one, many: near.particle_pairs(one, many, shape, cutoff))


def _streamed(left: DataFrame, right: DataFrame, parts: int, schema: StructType, make: Callable[[pa.Table, pa.Table], Iterator[pa.Table]]) -> DataFrame:
    """The rows that make gives out, table by table, for the particles of each block."""
    out, names = to_arrow_schema(schema), (left.columns, right.columns)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        one, many = (rows.filter(pc.equal(rows["_left"], side)).select(c) for side, c in zip((True, False), names))
        del rows
        for table in make(one, many):
            yield from table.cast(out).to_batches()

    both = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    return both.repartitionById(parts, F.col(BLOCK)).groupBy(BLOCK).applyInArrow(found, schema)


#: Columns of what compound_pairs makes, and what it has to be told for it.
MADE = {
    "counts": ("frame {frame}, ref {ref}, sel {sel}, n long", ()),
    "runs": (f"ref {{ref}}, sel {{sel}}, start int, stop int, {RUNS} int", ()),
    "longest": ("ref {ref}, sel {sel}, start int, stop int", ()),
    "levels": ("frame {frame}, ref {ref}, n long, k long", ()),
    "common": ("ref {ref}, sel {sel}", ("n_frames",)),
    "lags": ("frame {frame}, at long, n long", ("max_lag",)),
    "meetings": ("ref {ref}, f0 int, f1 int, n long, size long, total double, square double, least double, greatest double", ("apart",)),
    "filled": ("frame {frame}, ref {ref}, sel {sel}", ("intermittency", "n_frames")),
    "checks": ("n long, repeated long, nulls long, outside long", ("n_frames", "n_refs", "n_sels")),
}
#: What is no more than particles, or seldom is.
FEWER = ("longest", "levels", "common", "lags", "meetings", "checks")


def compound_pairs(ref: DataFrame, sel: DataFrame, cutoff: float, boxes: DataFrame | None = None, compound: str = "cmp", make: str = "counts", blocks: str = "pairs", **options) -> DataFrame:
    """Contacts of the compounds of ref and sel (see contact_pairs), found and summed block by block (operators/near.py).

    make is counts: (block, frame, ref, sel, n), the contacts of their particles; runs: (block, ref, sel, start, stop, runs), where they have a
    contact at start .. stop - 1, and how many runs the two have; longest: (block, ref, sel, start, stop), of the runs of a reference compound
    that begin at one frame the longest, of the lowest number, in each block; levels: (block, frame, ref, n, k), see levels, whose k are
    to be summed over blocks; common: (block, ref, sel), those in contact in n_frames frames; lags: (block, frame, at, n), of a part of a block what autocorrelation sums, of lags up to max_lag (None: all); meetings: (block, ref, f0, f1, n, size, total, square, least, greatest), in how many
    contacts a reference compound is at both frames, of f0 = f1 and of f1 - f0 from apart[0] to apart[1], and of f0 = f1 how many of the partners have a number, their sum,
    the squares about their mean, and the ends, in each block; filled: (block, frame, ref, sel), repair.correct_contact_intermittency by
    intermittency and n_frames; checks: (block, n, repeated, nulls, outside), of a part of a block check_contacts by n_frames, n_refs and n_sels.
    Counts, levels and checks alone are right with blocks of frames.  Blocks of what is no more than particles are few, and take their pairs part by part.
    """
    if make not in MADE or (make not in ("counts", "levels", "checks") and blocks != "pairs"):
        raise ValueError(f"unknown result {make!r} of blocks of {blocks}")
    options = {c: options.get(c) for c in MADE[make][1]}
    importable(ref.sparkSession)
    left, right, shape, cell = _in_cells(ref, sel, cutoff, boxes, compound)
    number = _few_blocks(left, right, cell, blocks == "frames") if make in FEWER else _blocks(left, right, cell, BLOCK_PAIRS)
    left, right = _in_blocks(left, right, ("ref_cmp", "sel_cmp"), blocks, number)
    ref_type, sel_type = (rows.schema[f"{side}_cmp"].dataType.simpleString() for side, rows in (("ref", left), ("sel", right)))
    schema = StructType.fromDDL(f"{BLOCK} int, " + MADE[make][0].format(frame=ref.schema["frame"].dataType.simpleString(), ref=ref_type, sel=sel_type))
    out = to_arrow_schema(schema)

    def found(key: tuple, one: pa.Table, many: pa.Table) -> pa.Table:
        pairs = near.block_pairs(one, many, shape, cutoff, make, options)
        if pairs is None:
            return out.empty_table()
        number = pa.chunked_array([pa.repeat(key[0], len(b)) for b in pairs.to_batches()], key[0].type)
        return pairs.add_column(0, BLOCK, number).cast(out)

    return left.drop("ref").groupBy(BLOCK).cogroup(right.drop("sel").groupBy(BLOCK)).applyInArrow(found, schema)


def _near_skewed(pairs: DataFrame, d: list[Column], matrix: list, cutoff: float) -> DataFrame:
    """The rows of pairs whose difference d has a minimum image of at most the cutoff, with its length dist.

    The steps of geometry.vdist, each a column of its own: as one expression, of which every step is used several times, they
    make a function too long to be compiled.  The explode keeps the filter behind them.
    """
    rows = pairs.withColumns({f"_d{a}": x for a, x in zip(AXES, d)})
    dx, dy, dz, fx, fy, fz, ix, iy, iz = (F.col(f"_{k}{a}") for k in "dfi" for a in AXES)
    rows = rows.withColumn("_fz", dz / matrix[2][2]).withColumn("_fy", (dy - fz * matrix[2][1]) / matrix[1][1])
    rows = rows.withColumn("_fx", (dx - fz * matrix[2][0] - fy * matrix[1][0]) / matrix[0][0])
    rows = rows.withColumns({f"_i{a}": F.floor(F.col(f"_f{a}") + 0.5) for a in AXES})
    rows = rows.withColumns({f"_n{a}": x - s for a, x, s in zip(AXES, (dx, dy, dz), geometry.box2cart((ix, iy, iz), matrix))})
    rows = rows.withColumn("_sq", sum((F.col(f"_n{a}") * F.col(f"_n{a}") for a in AXES), F.lit(0.0)))
    length = F.sqrt("_sq")
    return rows.withColumn("dist", F.explode(F.when(length <= cutoff, F.array(length))))


def contacts_around_point(positions: DataFrame, point: tuple[float, float, float], cutoff: float, lengths: tuple[float, float, float] | None = None) -> DataFrame:
    """The rows of positions at most cutoff from a point, by the minimum image if lengths are given."""
    squared = F.lit(0.0)
    for k, a in enumerate(AXES):
        d = F.col(a).cast("double") - point[k]
        d = min_image(d, F.lit(float(lengths[k]))) if lengths else d
        squared = squared + d * d
    return positions.where(squared <= cutoff * cutoff)


def compound_counts(contacts: DataFrame, ref_of: DataFrame | None = None, sel_of: DataFrame | None = None) -> DataFrame:
    """(frame, ref, sel, n[, block]): contacts summed by compound; ref_of has (ref, cmp), sel_of (sel, cmp).

    Without them the contacts' own compounds count where they have some (see contact_pairs), else the particles.
    """
    rows = contacts.select("frame", "ref", "sel")
    if ref_of is None and sel_of is None and "ref_cmp" in contacts.columns:
        rows = contacts.select(*block_of(contacts), "frame", F.col("ref_cmp").alias("ref"), F.col("sel_cmp").alias("sel"))
    for side, of in (("ref", ref_of), ("sel", sel_of)):
        if of is not None:
            rows = rows.join(of.select(F.col(side), F.col("cmp").alias("_c")), side).drop(side).withColumnRenamed("_c", side)
    return rows.groupBy(*block_of(rows), "frame", "ref", "sel").agg(F.count("*").alias("n"))


def compound_contacts(contacts: DataFrame, ref_of: DataFrame | None = None, sel_of: DataFrame | None = None, min_contacts: int = 1) -> DataFrame:
    """(frame, ref, sel) of compounds with at least min_contacts contacts of their particles."""
    return enough(compound_counts(contacts, ref_of, sel_of), min_contacts)


def enough(counts: DataFrame, min_contacts: int) -> DataFrame:
    """(frame, ref, sel) of compound_counts with at least min_contacts."""
    return counts.where(F.col("n") >= min_contacts).select("frame", "ref", "sel")


def contact_counts_all_levels(contacts: DataFrame, ref_of: DataFrame | None = None, sel_of: DataFrame | None = None) -> DataFrame:
    """(level, frame, ref, sel, n) for particles and compounds on either side; without tables of them the contacts' own compounds count."""
    if ref_of is None and sel_of is None:
        both, own = contacts.withColumnsRenamed({"ref_cmp": "rc", "sel_cmp": "sc"}), block_of(contacts)
    else:
        own, both = [], contacts.join(ref_of.select("ref", F.col("cmp").alias("rc")), "ref").join(sel_of.select("sel", F.col("cmp").alias("sc")), "sel")
    sides = F.explode(F.array(*(F.struct(F.lit(f"{r}-{s}").alias("level"), (F.col("ref") if r == "atm" else F.col("rc")).cast("long").alias("ref"), (F.col("sel") if s == "atm" else F.col("sc")).cast("long").alias("sel")) for r in ("atm", "cmp") for s in ("atm", "cmp"))))
    return both.select(*own, "frame", sides.alias("k")).select(*own, "k.level", "frame", "k.ref", "k.sel").groupBy(*own, "level", "frame", "ref", "sel").agg(F.count("*").alias("n")).drop(*own)


def all_levels(ref: DataFrame, sel: DataFrame, cutoff: float, boxes: DataFrame | None = None, compound: str = "cmp") -> DataFrame:
    """(level, frame, ref, sel, n) of contact_counts_all_levels, for contacts that are many more than particles: found and summed in blocks of frames (see particle_pairs)."""
    importable(ref.sparkSession)
    numbers = [rows.withColumns({c: F.col(c).cast("long") for c in (side, compound)}) for side, rows in (("ref", ref), ("sel", sel))]
    left, right, shape, cell = _in_cells(*numbers, cutoff, boxes, compound)
    blocks = _numbered(left, right, ("ref_cmp", "sel_cmp"), "frames", _few_blocks(left, right, cell, True))
    schema = StructType.fromDDL(f"kind int, frame {ref.schema['frame'].dataType.simpleString()}, ref long, sel long, n long")
    made = _streamed(*blocks, schema, lambda one, many: near.all_levels(one, many, shape, cutoff))
    level = F.when(F.col("kind") == 0, "atm-atm").when(F.col("kind") == 1, "atm-cmp").when(F.col("kind") == 2, "cmp-atm").otherwise("cmp-cmp")
    return made.select(level.alias("level"), "frame", "ref", "sel", "n")


def frame_type(contacts: DataFrame):
    return contacts.schema["frame" if "frame" in contacts.columns else "start"].dataType


def contact_runs(contacts: DataFrame) -> DataFrame:
    """([block,] ref, sel, start, stop[, runs]): contact at start .. stop - 1; contacts that are runs already stay as they are."""
    if "start" in contacts.columns:
        return contacts
    own = block_of(contacts)
    island = F.col("frame") - F.row_number().over(Window.partitionBy(*own, "ref", "sel").orderBy("frame"))
    rows = contacts.select(*own, "frame", "ref", "sel").distinct().withColumn("island", island)
    return rows.groupBy(*own, "ref", "sel", "island").agg(F.min("frame").cast("int").alias("start"), (F.max("frame") + 1).cast("int").alias("stop")).drop("island")


def contact_frames(contacts: DataFrame) -> DataFrame:
    """([block,] frame, ref, sel), each once, of contacts or of runs of them."""
    if "start" in contacts.columns:
        return contacts.select(*block_of(contacts), F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("frame"), "ref", "sel")
    return contacts.select(*block_of(contacts), "frame", "ref", "sel").distinct()


def n_contacts(contacts: DataFrame) -> DataFrame:
    """(frame, n): contacts in each frame that has some."""
    return contacts.groupBy("frame").agg(F.count("*").alias("n"))


def n_common_contacts(contacts: DataFrame, n_frames: int) -> DataFrame:
    """One row: n, the pairs in contact in every frame."""
    return common_contacts(contacts, n_frames).agg(F.count("*").alias("n"))


def common_contacts(contacts: DataFrame, n_frames: int) -> DataFrame:
    """(ref, sel) in contact in every one of n_frames frames: the intersection of the frames' sets; those that compound_pairs has found stay as they are."""
    if "frame" not in contacts.columns and "start" not in contacts.columns:
        return contacts.select("ref", "sel")
    runs = contact_runs(contacts)
    keys = [*block_of(runs), "ref", "sel"]
    if RUNS in runs.columns:  # of those with a single run it alone tells
        runs = runs.where((F.col(RUNS) > 1) | (F.col("stop") - F.col("start") == n_frames))
    return runs.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias("k")).where(F.col("k") == n_frames).select("ref", "sel")


def fill_missing(counts: DataFrame, low: int, high: int, column: str) -> DataFrame:
    """All values low..high of a column, with counts' rows where there are some."""
    grid = counts.sparkSession.range(low, high + 1).select(F.col("id").alias(column))
    return grid.join(counts, column, "left")


def sel_index_stats(contacts: DataFrame, refs: DataFrame, unbound_null: bool = False) -> DataFrame:
    """(frame, ref, n, mean, var, min, max) of the partners' numbers; refs has (frame, ref).  Unbound ones get 0, or null."""
    made = contacts.groupBy("frame", "ref").agg(F.count("*").alias("n"), F.avg("sel").alias("mean"), F.var_pop("sel").alias("var"), F.min("sel").cast("double").alias("min"), F.max("sel").cast("double").alias("max"))
    joined = refs.select("frame", "ref").join(made, ["frame", "ref"], "left").fillna(0, ["n"])
    return joined if unbound_null else joined.fillna(0.0, ["mean", "var", "min", "max"])


def contact_hists(counts: DataFrame, refs: DataFrame, keys: list[str] | None = None, max_n: int | None = None) -> DataFrame:
    """(keys, n, diff, same, tot, pair): how often reference compounds have n ...

    diff: different partners; same: contacts with one and the same partner (a compound
    counts once for each n it has); tot: contacts in all; pair: contacts in a pair (0 at
    n = 0).  counts has (keys, ref, sel, n), refs (keys, ref) all compounds; without
    keys all rows are one group, frames being summed over.  At n = 0 the first three
    count the compounds without contact.
    """
    keys = keys or []
    return hists_of_levels(kept(levels(counts, keys), "levels"), refs, keys, max_n)


def levels(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """([keys,] [frame,] ref, n, k): with how many partners a reference compound has n contacts; far fewer rows than counts.  Levels of compound_pairs stay as they are, a row for each block."""
    if "k" in counts.columns:
        return counts.select(*(c for c in counts.columns if c != BLOCK))
    by = [*(keys or []), "ref", *(["frame"] if "frame" in counts.columns and "frame" not in (keys or []) else [])]
    return counts.groupBy(*by, "n").agg(F.count("*").alias("k"))


def hists_of_levels(counts: DataFrame, refs: DataFrame, keys: list[str], max_n: int | None = None) -> DataFrame:
    """contact_hists from what levels has made of the counts."""
    by = [*keys, "ref", *(["frame"] if "frame" in counts.columns and "frame" not in keys else [])]
    each = counts.groupBy(*by).agg(F.sum("k").alias("d"), F.sum(F.col("n") * F.col("k")).alias("t"), F.collect_set("n").alias("s"))
    full = refs.select(*by).join(each, by, "left").select(*keys, F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("s", F.array(F.lit(0).cast("long"))).alias("s"))
    kinds = F.explode(F.concat(F.array(F.struct(F.lit("diff").alias("kind"), F.col("d").cast("long").alias("n")), F.struct(F.lit("tot").alias("kind"), F.col("t").cast("long").alias("n"))), F.transform("s", lambda n: F.struct(F.lit("same").alias("kind"), n.cast("long").alias("n")))))
    bins = full.select(*keys, kinds.alias("k")).groupBy(*keys, "k.kind", "k.n").agg(F.count("*").alias("c"))
    pairs = counts.groupBy(*keys, F.lit("pair").alias("kind"), F.col("n").cast("long").alias("n")).agg(F.sum("k").alias("c"))
    both = bins.unionByName(pairs)
    wide = both.groupBy(*keys, "n").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("c"))), F.lit(0)).alias(k) for k in ("diff", "same", "tot", "pair")))
    most = wide.groupBy(*keys).agg(F.max("n").alias("most"))
    top = F.greatest(F.col("most"), F.lit(max_n if max_n is not None else 0))
    grid = most.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), top.cast("long"))).alias("n"))
    return grid.join(wide, [*keys, "n"], "left").fillna(0, ["diff", "same", "tot", "pair"])


def contact_averages(counts: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: contacts per reference compound and frame, over all of them and over the bound ones; and the same of partners.  counts may be levels."""
    of = (F.sum("k"), F.sum(F.col("n") * F.col("k"))) if "k" in counts.columns else (F.count("*"), F.sum("n"))
    each = counts.groupBy("frame", "ref").agg(of[0].alias("d"), of[1].alias("t"))
    full = refs.select("frame", "ref").join(each, ["frame", "ref"], "left")
    return full.agg(F.count("*").alias("n_refs"), F.count("d").alias("n_bound"), F.try_divide(F.sum("t"), F.count("*")).alias("contacts_all"), F.avg("t").alias("contacts_bound"), F.try_divide(F.sum("d"), F.count("*")).alias("partners_all"), F.avg("d").alias("partners_bound"))


def unbound(contacts: DataFrame, compounds: DataFrame, side: str = "ref") -> DataFrame:
    """The rows of compounds(frame, side) without any contact in their frame."""
    return compounds.join(contacts.select("frame", side).distinct(), ["frame", side], "left_anti")


def autocorrelation(members: DataFrame, keys: list[str], n_frames: int, restart: int = 1, max_lag: int | None = None) -> DataFrame:
    """(lag, n_both, n_start, acf): the share of members (frame, keys) at t0 that are members at t0 + lag too.

    Starts are the frames 0, restart, ... but the last.  If every frame is a start, pairs are counted by pairs of runs
    (memberships from one frame to another), otherwise by an equi-join on keys and buckets of frames.  Of the lags of compound_pairs, whose starts are
    all frames, the sums are taken.
    """
    most = min(n_frames - 1, max_lag or n_frames - 1)
    grid = members.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("lag"))
    is_start = (F.col("frame") % restart == 0) & (F.col("frame") < n_frames - 1)
    reach = (F.lit(n_frames - 1) - F.col("frame")).alias("reach")
    if "at" in members.columns:
        if restart != 1:
            raise ValueError("lags of blocks start at every frame")
        sums = kept(members.groupBy("frame", "at").agg(F.sum("n").alias("n")), "lags")
        both = at_lags(sums.where("at is not null").select(F.col("at").alias("lag"), F.col("n").alias("d")), grid, "n_both")
        counts = sums.where("at is null").where(is_start).select(reach, "n")
    else:
        keys = [*block_of(members), *keys]
        rows = members.select("frame", *keys).distinct()
        starts = rows.where(is_start)
        if restart == 1:
            spans = in_runs(rows, keys)
            both = run_overlaps(spans, spans, keys, most, grid, "n_both")
        else:
            both = lag_pairs(starts.withColumnRenamed("frame", "f0"), rows, keys, most, min_lag=1).groupBy("lag").agg(F.count("*").alias("n_both"))
        counts = starts.groupBy(reach).agg(F.count("*").alias("n"))
    total = at_least(counts, grid, [], "reach", "n_start").where("lag > 0")
    joined = grid.join(both, "lag", "left").join(total, "lag", "left").fillna(0, ["n_both", "n_start"])
    return joined.withColumn("acf", F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("n_both").cast("double"), F.col("n_start"))))


def attach_detach(contacts: DataFrame, n_frames: int) -> DataFrame:
    """(frame, ref, n_attached, n_detached) against the frame before, for frames 1 .. n_frames - 1; frames without change do not appear.

    A pair's run of contact begins with an attachment, and after its last frame is a detachment.
    """
    runs = contact_runs(contacts)
    turn = lambda at, a, d: F.struct(at.cast(frame_type(contacts)).alias("frame"), F.lit(a).alias("a"), F.lit(d).alias("d"))
    new, gone = F.when(F.col("start") > 0, turn(F.col("start"), 1, 0)), F.when(F.col("stop") < n_frames, turn(F.col("stop"), 0, 1))
    turns = runs.select("ref", F.explode(F.array(new, gone)).alias("t")).where("t is not null")  # a filter of the array would not be compiled
    return turns.groupBy("t.frame", "ref").agg(F.sum("t.a").alias("n_attached"), F.sum("t.d").alias("n_detached"))


def coordination_changes(contacts: DataFrame, n_frames: int, kind: str = "any", n_det: int = 1, n_att: int = 1) -> DataFrame:
    """The rows of attach_detach with a change of a kind.

    any: a partner more or less; detachment: n_det partners or more at once that leave; attachment: n_att or more that come;
    exchange: both in the same frame.
    """
    return changes_of_kind(attach_detach(contacts, n_frames), kind, n_det, n_att)


def changes_of_kind(found: DataFrame, kind: str = "any", n_det: int = 1, n_att: int = 1) -> DataFrame:
    """coordination_changes of what attach_detach has found."""
    if kind not in ("any", "detachment", "attachment", "exchange"):
        raise ValueError(f"unknown kind {kind!r}")
    left, came = F.col("n_detached") >= n_det, F.col("n_attached") >= n_att
    return found if kind == "any" else found.where({"detachment": left, "attachment": came, "exchange": left & came}[kind])


def check_contacts(contacts: DataFrame, n_frames: int | None = None, n_refs: int | None = None, n_sels: int | None = None) -> DataFrame:
    """One row: contacts, repeated ones, those with a null, and those outside of the frames and numbers from 0 that are given.

    What holds for a sequence of equal contact matrices, said of its long form.  Checks of compound_pairs are summed.
    """
    if "repeated" in contacts.columns:
        return contacts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "repeated", "nulls", "outside")))
    null = F.col("frame").isNull() | F.col("ref").isNull() | F.col("sel").isNull()
    outside = F.lit(False)
    for c, n in (("frame", n_frames), ("ref", n_refs), ("sel", n_sels)):
        outside = outside | (F.col(c) < 0) | ((F.col(c) >= n) if n is not None else F.lit(False))
    each = contacts.groupBy(*block_of(contacts), "frame", "ref", "sel").agg(F.count("*").alias("k"))
    return each.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeated"), F.coalesce(F.sum(F.when(null, F.col("k"))), F.lit(0)).alias("nulls"), F.coalesce(F.sum(F.when(outside, F.col("k"))), F.lit(0)).alias("outside"))
