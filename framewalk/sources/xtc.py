"""Binary trajectories (.xtc) as a Spark data source, to read and to write.

    register(spark)
    spark.read.format("xtc").load(path).where("frame between 100 and 199")
    write_xtc(atoms, path)

A frame's length is in its head, so the frames of a file are indexed by hopping from head to head.  Stretches of
the index are the partitions: a file is read by as many tasks as it has stretches.  Filters on path, frame, step and time
are answered from the index, so that frames they leave out are neither planned nor read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from framewalk.functions import packed
from framewalk.functions.geometry import box_columns, box_matrix
from framewalk.session import importable, system_of

#: Bytes of frames that one task reads (option "stretch"), if a frame is not longer; files whose heads are read at a time; atoms of a batch of rows.
STRETCH, AT_ONCE, ROWS = 16 << 20, 32, 1 << 16

SCHEMA = "path string, frame int, step int, time double, atom_ix long, x double, y double, z double, lx double, ly double, lz double, alpha double, beta double, gamma double"
INPUT = "file long, frame int, step int, time double, atom_ix long, x double, y double, z double, " + ", ".join(f"v{i}{j} double" for i in range(3) for j in range(3))


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder whose names end in .xtc, in order."""
    from pyarrow import fs

    system, name = system_of(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    head = path[: len(path) - len(name)] if "://" in path else ""
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(name, recursive=True)) if f.is_file and f.path.endswith(".xtc") and not f.base_name.startswith(("_", "."))]
    return sorted((head + f.path, f.size) for f in found)


def frames_of(path: str, size: int) -> Iterator[tuple[int, int, int, int, float]]:
    """(frame, offset, length, step, time) of a file's frames; only their heads are read.  A last frame that is cut off is left out."""
    system, name = system_of(path)
    with system.open_input_file(name) as file:
        at = frame = 0
        while at + packed.HEAD <= size:
            file.seek(at)
            head = file.read(packed.HEAD + 36)
            try:
                _, step, time, _ = packed.head_of(head)
            except ValueError as odd:
                raise ValueError(f"{path}, byte {at}: {odd}") from None
            try:
                length = packed.length_of(head)
            except Exception:  # the head itself is cut off
                return
            if at + length > size:
                return
            yield frame, at, length, step, time
            at, frame = at + length, frame + 1


@dataclass
class Stretch(ds.InputPartition):
    """Frames of one file that one task reads: (frame, offset, length) each."""

    path: str
    frames: list[tuple[int, int, int]]


class XtcReader(ds.DataSourceReader):
    def __init__(self, path: str, stretch: int):
        self.path, self.stretch, self.filters = path, stretch, []

    def pushFilters(self, filters: list[ds.Filter]):
        """Takes comparisons and lists on what the index holds, gives back the others."""
        known = (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.In)
        for f in filters:
            if isinstance(f, known) and f.attribute in (("path",), ("frame",), ("step",), ("time",)):
                self.filters.append(f)
            elif not (isinstance(f, ds.IsNotNull) and f.attribute in (("path",), ("frame",), ("step",), ("time",))):
                yield f

    def _passes(self, row: dict) -> bool:
        tests = {ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.In: lambda a, b: a in b}
        return all(tests[type(f)](row[f.attribute[0]], f.value) for f in self.filters)

    def partitions(self) -> list[Stretch]:
        def stretches(file: tuple[str, int]) -> list[Stretch]:
            path, size = file
            if not self._passes_path(path):
                return []
            out, held = [], self.stretch
            for frame, at, length, step, time in frames_of(path, size):
                if self._passes({"path": path, "frame": frame, "step": step, "time": time}):
                    if held + length > self.stretch:
                        out.append(Stretch(path, []))
                        held = 0
                    out[-1].frames.append((frame, at, length))
                    held += length
            return out

        with ThreadPoolExecutor(AT_ONCE) as pool:
            return [s for each in pool.map(stretches, files_below(self.path)) for s in each] or [Stretch("", [])]

    def _passes_path(self, path: str) -> bool:
        return all(path == f.value if isinstance(f, ds.EqualTo) else path in f.value if isinstance(f, ds.In) else True for f in self.filters if f.attribute == ("path",))

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if not part.frames:
            return
        system, name = system_of(part.path)
        held: list[dict] = []
        with system.open_input_file(name) as file:
            for frame, at, length in part.frames:
                file.seek(at)
                data = file.read(length)
                atoms, step, time, box = packed.head_of(data)
                held.append({"frame": frame, "step": step, "time": time, "box": box_of(box), "points": packed.unpack(data[packed.HEAD :], atoms)})
                if sum(len(h["points"]) for h in held) >= ROWS:
                    yield self._batch(part.path, held)
                    held = []
        if held:
            yield self._batch(part.path, held)

    def _batch(self, path: str, held: list[dict]) -> pa.RecordBatch:
        counts = [len(h["points"]) for h in held]
        each = lambda values, kind: pa.array(np.repeat(np.array(values), counts), kind)
        points = np.concatenate([h["points"] for h in held]).astype(np.float64)
        columns = [pa.array([path] * sum(counts), pa.string()), each([h["frame"] for h in held], pa.int32()), each([h["step"] for h in held], pa.int32()), each([h["time"] for h in held], pa.float64())]
        columns += [pa.array(np.concatenate([np.arange(n) for n in counts]), pa.int64()), *(pa.array(points[:, k]) for k in range(3))]
        columns += [each([h["box"][k] for h in held], pa.float64()) for k in range(6)]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])


def box_of(vectors: np.ndarray) -> list[float]:
    """Lengths and angles of a box of row vectors; zeros without one."""
    lengths = np.sqrt((vectors**2).sum(axis=1))
    if not lengths.all():
        return [*map(float, lengths), 90.0, 90.0, 90.0]
    angle = lambda i, j: math.degrees(math.acos(max(-1.0, min(1.0, float(vectors[i] @ vectors[j] / lengths[i] / lengths[j])))))
    return [*map(float, lengths), angle(1, 2), angle(0, 2), angle(0, 1)]


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


class XtcWriter(ds.DataSourceArrowWriter):
    """Rows of (file, frame, atom_ix, ...), each file's in order and in one task, to a file each.

    A task writes below names of its own; they get their final ones when all tasks have ended, so that repeated and lost tasks leave nothing.
    """

    def __init__(self, path: str, precision: float, overwrite: bool):
        self.path, self.precision = path, precision
        if overwrite:
            raise ValueError("an .xtc folder is not overwritten")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from uuid import uuid4

        system, base = system_of(self.path)
        system.create_dir(base, recursive=True)
        own, names, out, of, parts = uuid4().hex, [], None, None, []

        def finish() -> None:
            if parts:
                columns = [np.concatenate([p[k] for p in parts]) for k in range(14)]
                box = [columns[k][0] for k in range(5, 14)]
                out.write(packed.frame_of(np.stack(columns[2:5], axis=1), int(columns[0][0]), float(columns[1][0]), np.array(box).reshape(3, 3), self.precision))
                parts.clear()

        for batch in batches:
            file, frame = (batch[c].to_numpy() for c in ("file", "frame"))
            values = [batch[c].to_numpy() for c in ("step", "time", "x", "y", "z", *(f"v{i}{j}" for i in range(3) for j in range(3)))]
            cuts = np.flatnonzero((np.diff(frame) != 0) | (np.diff(file) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(frame)]):
                if low == high:
                    continue
                if (file[low], frame[low]) != of:
                    finish()
                    if of is None or file[low] != of[0]:
                        if out:
                            out.close()
                        names.append(f"_{own}-{file[low]:08d}.xtc")
                        out = system.open_output_stream(f"{base}/{names[-1]}")
                    of = (file[low], frame[low])
                parts.append([v[low:high] for v in values])
        finish()
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = system_of(self.path)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{base}/{name}", f"{base}/part-{name[-12:]}")

    def abort(self, messages: list[Written | None]) -> None:
        system, base = system_of(self.path)
        for m in messages:
            for name in m.names if m else []:
                system.delete_file(f"{base}/{name}")


class XtcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "xtc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> XtcReader:
        return XtcReader(self.options["path"], int(self.options.get("stretch", STRETCH)))

    def writer(self, schema, overwrite: bool) -> XtcWriter:
        return XtcWriter(self.options["path"], float(self.options.get("precision", "1000")), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Python sources take filters (a setting of the session)."""
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(XtcSource)


def read_xtc(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, step, time, atom_ix, x, y, z, lx, ly, lz, alpha, beta, gamma) of an .xtc file or a folder of them; nm and ps.

    Frames are numbered from 0 in each file, atoms in each frame.  A file's last frame, if cut off, is left out.  The index is made on the
    driver, many files at a time: a few dozen bytes read a frame, three numbers held for each that is wanted.
    """
    register(spark)
    return spark.read.format("xtc").load(path)


def write_xtc(atoms: DataFrame, path: str, frames: int = 100, precision: float = 1000.0) -> None:
    """Writes atoms(frame, atom_ix, x, y, z, lx, ly, lz[, alpha, beta, gamma][, step][, time]) as .xtc files of so many frames each below path.

    Files are named by their first frame's number divided by `frames`, so that they follow each other; frames and atoms go by their
    numbers.  Coordinates are rounded to multiples of 1 / precision.  Null coordinates are an error, as is a folder with files.
    """
    register(atoms.sparkSession)
    if os.path.basename(path.rstrip("/")) == "":
        raise ValueError("no path")
    box = box_matrix(box_columns(atoms.columns))
    has = lambda c, other: F.col(c) if c in atoms.columns else other
    rows = atoms.select(
        F.floor(F.col("frame") / frames).cast("long").alias("file"), F.col("frame").cast("int").alias("frame"), has("step", F.col("frame")).cast("int").alias("step"), has("time", F.col("frame")).cast("double").alias("time"),
        F.col("atom_ix").cast("long").alias("atom_ix"), *(F.col(c).cast("double").alias(c) for c in "xyz"), *(F.when(F.lit(True), box[i][j]).cast("double").alias(f"v{i}{j}") for i in range(3) for j in range(3)),
    )
    rows.repartition("file").sortWithinPartitions("file", "frame", "atom_ix").write.format("xtc").option("precision", str(precision)).mode("append").save(path)
