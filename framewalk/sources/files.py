"""Readers and writers.  Parquet is the form to work on; the others come in or go out.

Text files, structures too, are read by Spark itself, in blocks, and .npy files in stretches of bytes; .xz and
.npz files, which are compressed, are opened in the tasks, one file at a time.
"""

from __future__ import annotations

import io
import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewalk.functions import geometry
from framewalk.functions.geometry import box_columns, box_matrix
from framewalk.session import importable, system_of

#: Rows that a reader of arrays returns at a time, and bytes of an .npy file that a task reads.
ROWS, STRETCH = 100_000, 16 << 20


def npy_head(file) -> tuple[tuple[int, int], bool, np.dtype, int]:
    """(compounds and frames, whether frames come first, type, where the numbers begin) of an open .npy file."""
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[np.lib.format.read_magic(file)]
    shape, turned, kind = read(file)
    if kind.hasobject or len(shape) > 2:
        raise ValueError("not an array of numbers with at most two axes")
    return (1,) * (2 - len(shape)) + tuple(shape), turned, kind, file.tell()


def integral(name: str, values: np.ndarray) -> np.ndarray:
    if (values != np.floor(values)).any():
        raise ValueError(f"{name}: states must be integral")
    return values.astype(np.int32)


def read_dtrj_npy(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """(path, cmp, frame, state) of .npy and .npz files that hold (compounds, frames) arrays of integers.

    An .npy file is read by as many tasks as it has stretches of bytes, each of which opens it where its numbers begin.
    """
    importable(spark)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                for array in map(np.atleast_2d, (data[k] for k in data.files)):
                    frames = array.shape[1]
                    for s in range(0, array.size, ROWS):
                        k = np.arange(s, min(s + ROWS, array.size))
                        yield pd.DataFrame({"path": name, "cmp": k // frames, "frame": (k % frames).astype(np.int32), "state": integral(name, array.ravel()[k])})

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, number in zip(batch["path"], batch["number"]):
                system, place = system_of(name)
                with system.open_input_file(place) as file:
                    (compounds, frames), turned, kind, begin = npy_head(file)
                    each = max(1, stretch // kind.itemsize)
                    first, last = number * each, min((number + 1) * each, compounds * frames)
                    file.seek(begin + first * kind.itemsize)
                    for s in range(first, last, ROWS):
                        k = np.arange(s, min(s + ROWS, last))
                        values = np.frombuffer(file.read(len(k) * kind.itemsize), kind)
                        cmp, frame = (k % compounds, k // compounds) if turned else (k // frames, k % frames)
                        yield pd.DataFrame({"path": name, "cmp": cmp, "frame": frame.astype(np.int32), "state": integral(name, values)})

    columns = "path string, cmp long, frame int, state int"
    files = spark.read.format("binaryFile").load(path)
    packed = F.lower("path").endswith(".npz")
    parts = files.where(~packed).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / stretch))).alias("number"))
    read = parts.repartition(max(1, parts.count()), "path", "number").mapInPandas(part, columns)
    return read.unionByName(files.where(packed).select("path", "content").mapInPandas(whole, columns))


def write_dtrj(dtrj: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """State sequences as Parquet, those of a compound together and in order."""
    dtrj.select("cmp", "frame", "state").repartition("cmp").sortWithinPartitions("cmp", "frame").write.mode(mode).parquet(path)


def read_text_xz(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of .xz and .lzma text files."""
    importable(spark)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with lzma.open(io.BytesIO(content), "rt") as f:
                    lines: list[str] = []
                    start = 0
                    for line in f:
                        lines.append(line.rstrip("\n"))
                        if len(lines) == ROWS:
                            yield pd.DataFrame({"path": name, "line": range(start, start + ROWS), "value": lines})
                            start, lines = start + ROWS, []
                    yield pd.DataFrame({"path": name, "line": range(start, start + len(lines)), "value": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(load, "path string, line long, value string")


def read_columns(spark: SparkSession, path: str, names: list[str], comment: str = "#") -> DataFrame:
    """Columns of numbers parted by white space, lines that begin with a comment sign left out."""
    text = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith(comment))
    parts = F.split("v", r"\s+")
    return text.select(*(F.get(parts, i).try_cast("double").alias(n) for i, n in enumerate(names)))


def read_matrix(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(var1, var2, z) of text matrices whose first row and column hold the two variables.

    The first row of each file is known by its place, the start of the file's first block, and is joined with
    the others, which are read in parallel.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where((F.col("v") != "") & ~F.col("v").startswith(comment))
    heads = lines.where("block = 0").groupBy("file").agg(F.min(F.struct("id", "v")).alias("h"))
    numbers = lambda c: F.transform(F.split(c, r"\s+"), lambda x: x.try_cast("double"))
    rows = lines.join(heads.select("file", F.col("h.id").alias("first"), numbers(F.col("h.v")).alias("head")), "file").where((F.col("block") != 0) | (F.col("id") > F.col("first")))
    cells = rows.select("head", numbers(F.col("v")).alias("c")).select("head", F.get("c", 0).alias("var1"), F.posexplode(F.slice("c", F.lit(2), F.greatest(F.lit(0), F.size("c") - 1))).alias("k", "z"))
    return cells.select("var1", F.get("head", F.col("k") + 1).alias("var2"), "z")


def write_matrix(matrix: DataFrame, path: str, var1: str, var2: str, z: str, values: list[float] | None = None, block: str | None = None) -> None:
    """A long matrix as text, a row for each var1, a column for each var2; with block, a folder for each of its values."""
    keys = [block] if block else []
    wide = matrix.groupBy(*keys, var1).pivot(var2, values).agg(F.first(z)).orderBy(*keys, var1)
    out = wide.write.mode("errorifexists").option("sep", " ").option("header", True)
    (out.partitionBy(block) if block else out).csv(path)


def write_columns(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("sep", " ").option("header", True).csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of text files with their numbers from 0 in each file.

    Files are read in blocks by many tasks; a block's lines are counted once, and their running sum (a row a block) gives
    each line its number.
    """
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    blocks = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("path", "block", "first", before.alias("before"))
    return rows.join(starts, ["path", "block"]).select("path", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def _framed(spark: SparkSession, path: str, count_line: int, extra: int) -> DataFrame:
    """(path, frame, k, value, n): numbered_lines by frame, each of n + extra lines, n being in line count_line of a file."""
    lines = numbered_lines(spark, path)
    size = lines.where(F.col("line") == count_line).select("path", F.trim("value").try_cast("int").alias("n"))
    rows = lines.join(size, "path").withColumn("span", F.col("n") + extra)
    framed = rows.select("path", F.floor(F.col("line") / F.col("span")).cast("int").alias("frame"), (F.col("line") % F.col("span")).cast("int").alias("k"), "value", "n")
    other = (F.col("k") == count_line) & (F.trim("value") != F.col("n").cast("string")) & (F.trim("value") != "")
    odd = framed.groupBy("path").agg(F.count_if(other).alias("odd"))  # a row a file
    said = F.raise_error(F.concat(F.col("path"), F.lit(": frames of different sizes; cut the file into one a size"))).cast("boolean")
    return framed.join(odd, "path").where(F.when(F.col("odd") > 0, said).otherwise(F.lit(True))).drop("odd")


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, atom_ix, resid, resname, name, x, y, z, lx, ly, lz, alpha, beta, gamma) of .gro files of one or more frames; nm.

    The frames of a file have the same number of atoms each, so that a line's number tells its frame and its atom: a file is
    read by as many tasks as it has blocks.  A box line of nine numbers keeps its tilt.
    """
    rows = _framed(spark, path, 1, 3)
    part = lambda start, length: F.trim(F.substring("value", start, length))
    atoms = rows.where((F.col("k") >= 2) & (F.col("k") < F.col("n") + 2)).select(
        "path", "frame", (F.col("k") - 2).cast("long").alias("atom_ix"), part(1, 5).try_cast("int").alias("resid"), part(6, 5).alias("resname"), part(11, 5).alias("name"),
        *(part(start, 8).try_cast("double").alias(a) for a, start in (("x", 21), ("y", 29), ("z", 37))),
    )
    v = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("double"))
    at = lambda i: F.coalesce(F.get(v, i), F.lit(0.0))
    box = geometry.triclinic_box([(at(0), at(3), at(4)), (at(5), at(1), at(6)), (at(7), at(8), at(2))])
    ends = rows.where(F.col("k") == F.col("n") + 2).select("path", "frame", *(c.alias(n) for c, n in zip(box, ("lx", "ly", "lz", "alpha", "beta", "gamma"))))
    return atoms.join(ends, ["path", "frame"])


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, atom_ix, name, x, y, z) of .xyz files, read as read_gro does."""
    rows = _framed(spark, path, 0, 2)
    words = F.split(F.trim("value"), r"\s+")
    return rows.where(F.col("k") >= 2).select("path", "frame", (F.col("k") - 2).cast("long").alias("atom_ix"), F.get(words, 0).alias("name"), *(F.get(words, i).try_cast("double").alias(a) for i, a in ((1, "x"), (2, "y"), (3, "z"))))


def write_gro(atoms: DataFrame, path: str) -> None:
    """Frames as text in .gro form: a folder for each frame, its lines in order; atoms has the columns of read_gro (angles may be missing)."""
    line = F.format_string("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", F.col("resid") % 100_000, "resname", "name", ((F.col("atom_ix") + 1) % 100_000).cast("int"), "x", "y", "z")
    body = atoms.select("frame", F.col("atom_ix").alias("k"), line.alias("value"))
    box = box_columns(atoms.columns)
    ends = atoms.groupBy("frame").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in box), F.max("atom_ix").alias("top"))
    a, b, c = box_matrix(box)
    straight = F.format_string("%10.5f%10.5f%10.5f", a[0], b[1], c[2])
    if len(box) == 6:
        tilted = F.concat(straight, F.format_string("%10.5f" * 6, F.lit(0.0), F.lit(0.0), b[0], F.lit(0.0), c[0], c[1]))
        straight = F.when((F.col("alpha") == 90) & (F.col("beta") == 90) & (F.col("gamma") == 90), straight).otherwise(tilted)
    extra = F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("k"), F.format_string("frame %d", "frame").alias("value")), F.struct(F.lit(-1).cast("long").alias("k"), F.format_string("%5d", "n").alias("value")), F.struct((F.col("top") + 1).alias("k"), straight.alias("value"))))
    rows = body.unionByName(ends.select("frame", extra.alias("e")).select("frame", "e.k", "e.value"))
    rows.repartition("frame").sortWithinPartitions("frame", "k").select("frame", "value").write.mode("errorifexists").partitionBy("frame").text(path)


def write_xyz(atoms: DataFrame, path: str) -> None:
    """Frames as text in .xyz form, as write_gro does; atoms has the columns of read_xyz."""
    body = atoms.select("frame", F.col("atom_ix").alias("k"), F.format_string("%s %.6f %.6f %.6f", "name", "x", "y", "z").alias("value"))
    ends = atoms.groupBy("frame").agg(F.count("*").cast("string").alias("n"))
    head = F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("k"), F.col("n").alias("value")), F.struct(F.lit(-1).cast("long").alias("k"), F.format_string("frame %d", "frame").alias("value"))))
    rows = body.unionByName(ends.select("frame", head.alias("e")).select("frame", "e.k", "e.value"))
    rows.repartition("frame").sortWithinPartitions("frame", "k").select("frame", "value").write.mode("errorifexists").partitionBy("frame").text(path)


def same_as(atoms: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of atoms that share the columns (as resid, segid) with one of the chosen: a selection completed to whole residues."""
    return atoms.join(chosen.select(*columns).distinct(), columns, "left_semi")


def around(atoms: DataFrame, chosen: DataFrame, cutoff: float, boxes: DataFrame | None = None) -> DataFrame:
    """The rows of atoms (frame, atom_ix, x, y, z, ...) within a cutoff of a chosen one in the same frame, the chosen ones left out.

    By the distance join of contact_pairs, so that no frame's atoms are all compared.
    """
    from framewalk.operators.contacts import contact_pairs

    point = lambda rows, name: rows.select("frame", F.col("atom_ix").alias(name), "x", "y", "z")
    near = contact_pairs(point(chosen, "ref"), point(atoms, "sel"), cutoff, boxes).select("frame", F.col("sel").alias("atom_ix")).distinct()
    return atoms.join(near, ["frame", "atom_ix"], "left_semi").join(chosen.select("frame", "atom_ix"), ["frame", "atom_ix"], "left_anti")


def generate_dtrj(spark: SparkSession, n_cmps: int, n_frames: int, taus: list[float], dist: str = "weibull", beta: float = 1.0, delta: float = 1.0, seed: int = 0, adjacent: bool = False, discard: int = 0) -> DataFrame:
    """(cmp, frame, state): state sequences with drawn lifetimes, one scale for each state.

    Lifetimes are generalized gamma ("weibull" with delta 1) or Burr XII; adjacent moves one state up or down only;
    the first discard frames are left out.  Each compound has a generator of its own, so that the rows do not depend
    on how the work is dealt out.
    """
    importable(spark)
    if dist not in ("weibull", "burr12"):
        raise ValueError(f"unknown distribution {dist!r}")
    total = n_frames + discard

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cmp in batch["id"]:
                rng = np.random.default_rng([seed, int(cmp)])
                out, at = np.empty(total, np.int32), 0
                state = int(rng.integers(len(taus)))
                while at < total:
                    if dist == "burr12":
                        life = taus[state] * (rng.random() ** (-1 / delta) - 1) ** (1 / beta)
                    else:
                        life = taus[state] * rng.gamma(delta) ** (1 / beta)
                    stop = min(total, at + max(1, int(np.ceil(life))))
                    out[at:stop], at = state, stop
                    if len(taus) > 1:
                        step = 1 if adjacent and state == 0 else -1 if adjacent and state == len(taus) - 1 else int(rng.choice([-1, 1])) if adjacent else 1 + int(rng.integers(len(taus) - 1))
                        state = (state + step) % len(taus)
                yield pd.DataFrame({"cmp": cmp, "frame": np.arange(n_frames, dtype=np.int32), "state": out[discard:]})

    return spark.range(n_cmps).mapInPandas(draw, "cmp long, frame int, state int")
