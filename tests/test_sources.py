"""Readers, writers, parameter checks, streams and the registered queries."""

import lzma
import os
import struct

import numpy as np
import pytest
from helpers import agree, column, near, rows
from pyspark.sql import functions as F

from framewalk.functions import packed
from framewalk.operators import events, repair, states
from framewalk.plans import registry
from framewalk.sources import files, selection, slicing, xtc
from framewalk.streaming import replay
from framewalk.streaming import runs as streams

SF = "/root/testdata/sf0.001"


def test_slicing():
    assert slicing.frame_slicing(0, -1, 1, 10) == (0, 10, 1, 10)
    assert slicing.frame_slicing(-3, 99, 2, 10) == (0, 10, 2, 5)
    assert slicing.frame_slicing(0, 9, 4, 10) == (0, 9, 4, 3)
    assert slicing.frame_slicing(0, 8, 3, 10) == (0, 7, 3, 3)
    assert slicing.n_restarts(10, 3) == [4, 3, 3, 3, 2, 2, 2, 1, 1, 1]
    assert slicing.restarts(7, 2, 100) == 3
    assert slicing.frame_lag(99, 4, 20) == 16
    assert slicing.block_averaging(3, 10) == (3, 3)
    assert slicing.bins(0, 1, num=4) == (0.0, 1.0, 0.25, 4)
    assert slicing.bins(0, 1, step=0.3) == (0.0, 0.9, 0.3, 3)
    assert slicing.bin_edges([0.5, 0.2, 0.5]) == [0.0, 0.2, 0.5, 1.000001]
    with pytest.raises(ValueError):
        slicing.bins(1, 0, num=3)


def test_npz(spark, tmp_path, dtrj):
    a = np.arange(12).reshape(3, 4)
    np.savez_compressed(tmp_path / "a.npz", dtrj=a)
    np.save(tmp_path / "b.npy", a[0])
    made = files.read_dtrj_npy(spark, f"file://{tmp_path}/a.npz")
    assert column(made, "state", "cmp", "frame") == list(range(12))
    assert files.read_dtrj_npy(spark, f"file://{tmp_path}/b.npy").count() == 4
    files.write_dtrj(made, f"file://{tmp_path}/out")
    assert rows(spark.read.parquet(f"file://{tmp_path}/out")) == rows(made.drop("path"))


@pytest.mark.parametrize("order", ["C", "F"])
def test_npy_in_stretches(spark, tmp_path, order):
    """A file is read by many tasks, in either order of its axes; types of any width, empty arrays and single numbers are read, too."""
    a = np.random.default_rng(3).integers(-5, 90, (7, 101))
    for name, kind in (("a", np.int64), ("b", np.float32), ("c", np.int8)):
        np.save(tmp_path / f"{name}.npy", np.asarray(a.astype(kind), order=order))
    np.save(tmp_path / "empty.npy", np.zeros((0, 4), np.int16))
    made = files.read_dtrj_npy(spark, f"file://{tmp_path}/*.npy", stretch=256)
    assert made.rdd.getNumPartitions() > 20
    got = made.groupBy("path").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in got) == [a.size] * 3
    for name in "abc":
        found = made.where(F.col("path").endswith(f"/{name}.npy")).orderBy("cmp", "frame").toPandas()
        assert (found["state"].to_numpy().reshape(a.shape) == a).all()
    np.save(tmp_path / "half.npy", np.array([[0.5, 1.0]]))
    with pytest.raises(Exception, match="integral"):
        files.read_dtrj_npy(spark, f"file://{tmp_path}/half.npy").collect()


def test_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# head\n0 1 2\n10 3.5 4\n20 5 6\n")
    assert rows(files.read_matrix(spark, f"file://{tmp_path}/m.txt")) == [(10.0, 1.0, 3.5), (10.0, 2.0, 4.0), (20.0, 1.0, 5.0), (20.0, 2.0, 6.0)]
    assert files.read_columns(spark, f"file://{tmp_path}/m.txt", ["a", "b", "c"]).count() == 3
    with lzma.open(tmp_path / "t.xz", "wt") as f:
        f.write("one\ntwo\n")
    assert column(files.read_text_xz(spark, f"file://{tmp_path}/t.xz"), "value", "line") == ["one", "two"]
    files.write_matrix(spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 1, 4.0)], "a int, b int, z double"), f"file://{tmp_path}/w", "a", "b", "z")
    assert spark.read.option("sep", " ").option("header", True).csv(f"file://{tmp_path}/w").count() == 2


def test_structures(spark, tmp_path):
    atom = "%5d%-5s%5s%5d%8.3f%8.3f%8.3f\n"
    frame = "title\n    2\n" + atom % (1, "SOL", "OW", 1, 0.1, 0.2, 0.3) + atom % (1, "SOL", "HW", 2, 1.0, 2.0, 3.0) + "   4.0 5.0 6.0\n"
    (tmp_path / "a.gro").write_text(frame * 2)
    made = files.read_gro(spark, f"file://{tmp_path}/a.gro")
    assert rows(made.where("frame = 1"), "name", "resname", "x", "lz") == [("HW", "SOL", 1.0, 6.0), ("OW", "SOL", 0.1, 6.0)]
    (tmp_path / "t.gro").write_text("title\n    1\n" + atom % (1, "SOL", "OW", 1, 0.1, 0.2, 0.3) + "   4.0 5.0 6.0 0.0 0.0 3.0 0.0 0.0 0.0\n")
    tilted = files.read_gro(spark, f"file://{tmp_path}/t.gro").first()
    assert near([tilted[c] for c in ("lx", "ly", "lz", "alpha", "beta")], [4.0, 34**0.5, 6.0, 90.0, 90.0]) and abs(tilted["gamma"] - 59.0362) < 1e-3
    (tmp_path / "a.xyz").write_text("2\nhead\nC 0 1 2\nO 3 4 5\n" * 3)
    assert files.read_xyz(spark, f"file://{tmp_path}/a.xyz").count() == 6


def test_structures_in_blocks(spark, tmp_path):
    """A trajectory in one file is read by many tasks; frames of another size are refused."""
    n, frames = 50, 120
    with open(tmp_path / "long.xyz", "w") as f:
        for t in range(frames):
            f.write(f"{n}\nframe {t}\n" + "".join(f"C {t} {k} 0.5\n" for k in range(n)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        made = files.read_xyz(spark, f"file://{tmp_path}/long.xyz")
        assert spark.read.text(f"file://{tmp_path}/long.xyz").rdd.getNumPartitions() > 4
        assert made.count() == n * frames and made.where("x <> frame or y <> atom_ix").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    (tmp_path / "odd.xyz").write_text("1\nh\nC 0 0 0\n2\nh\nC 0 0 0\nC 0 0 0\n")
    with pytest.raises(Exception, match="different sizes"):
        files.read_xyz(spark, f"file://{tmp_path}/odd.xyz").collect()


def test_write_gro(spark, tmp_path):
    atoms = spark.createDataFrame([(f, k, 1, "SOL", "OW", 0.5 * k, 1.0, 2.0, 3.0, 3.0, 3.0) for f in range(2) for k in range(3)], "frame int, atom_ix long, resid int, resname string, name string, x double, y double, z double, lx double, ly double, lz double")
    files.write_gro(atoms, f"file://{tmp_path}/out")
    back = files.read_gro(spark, f"file://{tmp_path}/out/*/*.txt")
    assert column(back, "x", "path", "atom_ix") == [0.0, 0.5, 1.0] * 2
    assert back.count() == 6
    files.write_xyz(atoms, f"file://{tmp_path}/xyz")
    assert rows(files.read_xyz(spark, f"file://{tmp_path}/xyz/*/*.txt"), "atom_ix", "name", "x", "y", "z") == rows(back, "atom_ix", "name", "x", "y", "z")


def test_windowed_counts(spark, tmp_path):
    from pyspark.sql import functions as F

    rows_ = [(f"2024-01-01 00:{m:02d}:00", k) for m in (1, 3, 12, 14, 31) for k in ("a", "b")]
    data = spark.createDataFrame(rows_, "t string, key string").withColumn("t", F.to_timestamp("t"))
    data.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"file://{tmp_path}/in")
    q = streams.windowed_counts(stream, "t", "key", "10 minutes", "1 minute").writeStream.format("memory").queryName("counts_out").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"].minute, r["key"]): r["n"] for r in spark.table("counts_out").collect()}
    assert got == {(m, k): 2 for m in (0, 10) for k in "ab"}


ATOMS = [  # atom_ix, frame, name, resname, resid, segid, mass, x, y, z
    (0, 0, "N", "ALA", 1, "A", 14.0, 0.0, 0.0, 0.0), (1, 0, "CA", "ALA", 1, "A", 12.0, 1.0, 0.0, 0.0), (2, 0, "CB", "ALA", 1, "A", 12.0, 2.0, 0.0, 0.0), (3, 0, "OW", "SOL", 2, "B", 16.0, 3.0, 0.0, 0.0),
    (4, 0, "HW1", "SOL", 2, "B", 1.0, 3.5, 0.0, 0.0), (5, 0, "HW2", "SOL", 2, "C", 1.0, 9.0, 0.0, 0.0), (6, 0, "OW", "SOL", 3, "C", 16.0, 9.5, 0.0, 0.0), (7, 0, None, "NA", None, None, None, 5.0, 5.0, 5.0),
]


@pytest.mark.parametrize("text, found", [
    ("name C*", {1, 2}), ("name C[!A]", {2}), ("name ?W", {3, 6}), ("name HW[12] N", {0, 4, 5}), ("not name C* N", {3, 4, 5, 6, 7}), ("all and not none", set(range(8))),
    ("resid 1 3", {0, 1, 2, 6}), ("resid 2-", {3, 4, 5, 6}), ("index 1:2 5", {1, 2, 5}), ("bynum 1-2", {0, 1}), ("mass 12.0:14", {0, 1, 2}), ("mass 16", {3, 6}),
    ("protein", {0, 1, 2}), ("backbone", {0, 1}), ("not protein and not resname SOL", {7}), ("name CA or name CB and name CA", {1}), ("(name CA or name CB) and name CB", {2}), ("not not name CA", {1}),
    ("prop x >= 3 and prop abs y < 1", {3, 4, 5, 6}), ("prop mass != 1", {0, 1, 2, 3, 6}), ("point 0 0 0 1.5", {0, 1}),
    ("around 1.1 name CB", {1, 3}), ("around 1.1 protein and name CB", {1, 3}), ("(around 1.1 protein) and name OW", {3}), ("around 1 around 1 name N", {0, 2}), ("around 3 none", set()),
    ("byres name HW1", {3, 4}), ("same resid as name HW1", {3, 4, 5}), ("same residue as around 1.1 name CB", {0, 1, 2, 3, 4, 5}), ("not (byres name CA) and not name OW", {4, 5, 7}), ("same segid as index 7", set()),
    ("sphzone 1 protein", {0, 1, 2}), ("sphlayer 1 2.4 protein", {3}), ("sphlayer 1 2.5 protein", {3, 4}), ("isolayer 1 1.5 protein", {4}), ("cyzone 2 1 -1 protein", {0, 1, 2, 3}), ("bonded name CA", {0, 2}), ("bonded bonded name N", {0, 2}),
    ("name CA or around 1.1 name CA or bonded name HW1", {0, 1, 2}), ("sphzone 3 none", set()), ("byres bonded name N and name CA", {0, 1, 2}), ("name HW1 or (same resid as name N)", {0, 1, 2, 4}),
])
@pytest.mark.parametrize("framed", [True, False])
def test_selection(spark, text, found, framed):
    if not framed and len(text) % 3:
        return
    atoms = spark.createDataFrame([(*a, "x") for a in ATOMS], "atom_ix long, frame int, name string, resname string, resid int, segid string, mass double, x double, y double, z double, other string")
    bonds = spark.createDataFrame([(0, 1), (2, 1)], "a long, b long")
    if framed:  # a frame without any atom in common
        atoms = atoms.unionByName(atoms.where("atom_ix < 2").withColumn("frame", F.lit(1)).withColumn("name", F.lit("X")).withColumn("resname", F.lit("Y")).withColumns({"mass": F.lit(-1.0), "x": F.lit(2.0), "resid": F.lit(77), "segid": F.lit("Z")}))
    else:
        atoms = atoms.drop("frame")
    made = selection.select_atoms(atoms, text, bonds=bonds)
    assert made.columns == atoms.columns
    made = made.where("frame = 0") if framed else made
    assert sorted(r["atom_ix"] for r in made.collect()) == sorted(found)


def test_periodic_selection(spark):
    atoms = spark.createDataFrame([(k, 0, float(x), 0.0, 0.0, "A" if k == 0 else "B") for k, x in enumerate((0.2, 9.9, 9.0, 5.0))], "atom_ix long, frame int, x double, y double, z double, name string")
    box = spark.createDataFrame([(0, 10.0, 10.0, 10.0)], "frame int, lx double, ly double, lz double")
    pick = lambda rows, text, b: sorted(r["atom_ix"] for r in selection.select_atoms(rows, text, b).collect())
    for rows, b in ((atoms, box), (atoms.drop("frame"), box.drop("frame"))):
        assert pick(rows, "around 0.5 name A", b) == [1] and pick(rows, "around 0.5 name A", None) == []
        assert pick(rows, "sphzone 1.5 name A", b) == [0, 1, 2] and pick(rows, "sphlayer 1 1.5 name A", b) == [2]
    assert pick(atoms.limit(0), "around 3 name A", box) == []


@pytest.mark.parametrize("bad", ["", "name", "shape round", "prop x; 1", "prop x =< 1", "(name CA", "name CA)", "around name CA", "around 3", "same as name CA", "same resid name CA", "name CA and", "resid A", "index 1:B", "point 1 2 3", "bonded name CA", "prop x < name"])
def test_bad_selections(spark, bad):
    atoms = spark.createDataFrame([], "atom_ix long, frame int, name string, resid int, x double, y double, z double")
    with pytest.raises(ValueError):
        selection.select_atoms(atoms, bad)


# ---- binary trajectories


def test_packed_frames():
    rng = np.random.default_rng(1)
    shapes = [lambda n: rng.uniform(-5, 5, (n, 3)), lambda n: np.cumsum(rng.normal(0, 0.05, (n, 3)), axis=0), lambda n: np.repeat(rng.uniform(0, 9, (n, 3)), 3, axis=0)[:n] + rng.normal(0, 0.04, (n, 3)), lambda n: rng.uniform(-2e4, 2e4, (n, 3)), lambda n: np.zeros((n, 3))]
    for n in (0, 1, 9, 10, 11, 300):
        for shape in shapes:
            for changes in (None, lambda g: int(rng.integers(-1, 2)), lambda g: -1, lambda g: 1):
                points = shape(n)
                data = packed.pack(points, 1000.0, changes)
                assert np.abs(packed.unpack(data, n) - points).max(initial=0) <= 0.00051 + 1e-6 * np.abs(points).max(initial=0)
                whole = packed.frame_of(points, 3, 1.5, np.eye(3) * 4)
                assert packed.length_of(whole[: packed.HEAD + 36]) == len(whole)
    waters = np.repeat(rng.uniform(0, 9, (1000, 3)), 3, axis=0) + rng.normal(0, 0.04, (3000, 3))
    assert len(packed.pack(waters)) < 3000 * 12 / 2
    with pytest.raises(ValueError):
        packed.head_of(b"x" * 60)
    with pytest.raises(ValueError):
        packed.pack(np.full((10, 3), 1e9))


def test_packed_bits():
    """A frame put together by hand: a whole place, then two steps, of which the first is of the atom before."""
    low, high = [0, 0, 0], [7, 7, 7]  # 10 bits a place (for 512 itself, too), steps in a range of 8 in 9 bits
    number = lambda v, of, bits=9: format((n := (v[0] * of + v[1]) * of + v[2]) & 255, "08b") + format(n >> 8, f"0{bits - 8}b")
    groups = number([3, 3, 3], 8, 10) + "1" + format(2 * 3 + 1, "05b") + number([4, 5, 3], 8) + number([6, 4, 4], 8)
    single = number([7, 0, 1], 8, 10) + "1" + format(1, "05b")
    rest = "".join(number([k % 8, 0, 0], 8, 10) + "0" for k in range(7))
    text = groups + single + rest
    data = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    head = struct.pack(">f3i3iii", 10.0, *low, *high, 9, len(data))
    got = np.rint(packed.unpack(head + data + b"\0" * 4, 11) * 10).astype(int).tolist()
    assert got == [[3, 4, 2], [3, 3, 3], [5, 4, 2], [7, 0, 1], *([k % 8, 0, 0] for k in range(7))]


def _trajectory(spark, n_frames=30, n_atoms=20):
    rng = np.random.default_rng(2)
    rows = [(f, a, *map(float, rng.uniform(-3, 12, 3)), 10.0, 9.0, 8.0, 90.0, 75.0, 90.0, 2.5 * f) for f in range(n_frames) for a in range(n_atoms)]
    return rows, spark.createDataFrame(rows, "frame int, atom_ix long, x double, y double, z double, lx double, ly double, lz double, alpha double, beta double, gamma double, time double")


def test_xtc(spark, tmp_path):
    rows, atoms = _trajectory(spark)
    xtc.write_xtc(atoms.repartition(5), f"{tmp_path}/t", frames=12)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == [f"part-0000000{k}.xtc" for k in range(3)]
    back = xtc.read_xtc(spark, f"{tmp_path}/t")
    got = sorted((r["step"], r["atom_ix"], round(r["x"], 3), round(r["y"], 3), round(r["z"], 3), round(r["beta"], 3), round(r["lx"], 4), r["time"]) for r in back.collect())
    assert got == [(f, a, round(x, 3), round(y, 3), round(z, 3), 75.0, 10.0, t) for f, a, x, y, z, *_, t in rows]
    assert {(r["path"][-5:], r["frame"], r["step"]) for r in back.collect()} == {(f"{f // 12}.xtc", f % 12, f) for f in range(30)}
    one = xtc.read_xtc(spark, f"{tmp_path}/t/part-00000001.xtc")
    assert one.agg(F.min("step"), F.max("step")).first() == (12, 23)
    with pytest.raises(Exception, match="not overwritten"):
        atoms.select("frame").write.format("xtc").mode("overwrite").save(f"{tmp_path}/t")


def test_xtc_frames_that_are_not_asked_for_are_not_read(spark, tmp_path):
    """A file is several partitions; a filter on frames leaves the others out of them, and their bytes unread."""
    _, atoms = _trajectory(spark)
    xtc.write_xtc(atoms, f"{tmp_path}/t", frames=100)
    path = f"{tmp_path}/t/part-00000000.xtc"
    size = os.path.getsize(path)
    frames = list(xtc.frames_of(path, size))
    assert len(frames) == 30
    rows = spark.read.format("xtc").option("stretch", str(3 * max(f[2] for f in frames))).load(path)
    assert rows.rdd.getNumPartitions() == 10
    with open(path, "r+b") as f:  # what is packed in all frames but 10 to 14 is made unreadable
        for frame, at, length, *_ in frames:
            if not 10 <= frame < 15:
                f.seek(at + packed.HEAD + 36)
                f.write(b"\xff" * (length - packed.HEAD - 36))
    some = rows.where("frame >= 10 and frame < 15 and x > -100")
    assert some.rdd.getNumPartitions() == 2
    assert some.count() == 5 * 20 and rows.where("frame = 12").count() == 20 and rows.where("time in (25.0, 27.5)").count() == 40 and rows.where("step > 13 and step <= 14").count() == 20
    assert rows.where("frame > 99").count() == 0 and rows.where("path = 'x'").count() == 0
    with open(path, "r+b") as f:
        f.truncate(size - 5)
    assert len(list(xtc.frames_of(path, size - 5))) == 29


def test_generator(spark):
    made = files.generate_dtrj(spark, 40, 400, [5.0, 20.0], seed=1)
    assert slicing.check_dtrj(made).first()["dense"]
    again = files.generate_dtrj(spark, 40, 400, [5.0, 20.0], seed=1)
    assert made.exceptAll(again).count() == 0
    means = {r["state"]: r["avg"] for r in states.lifetimes_per_state(made, uncensored=True).collect()}
    assert 4 < means[0] < 7.5 and 13 < means[1] < 25
    near = files.generate_dtrj(spark, 5, 200, [3.0, 3.0, 3.0], "burr12", 1.5, 2.0, adjacent=True)
    assert states.trans_ix(near, trans_type=[2, -2]).count() == 0


def test_checks(spark, dtrj):
    r = slicing.check_dtrj(dtrj([[1, 2], [3, 4]])).first()
    assert (r["n_cmps"], r["n_frames"], r["dense"]) == (2, 2, True)
    assert not slicing.check_dtrj(dtrj([[1, 2], [3, 4]]).where("frame > 0")).first()["dense"]
    boxes = spark.createDataFrame([(0, 1.0, 1.0, -1.0, 90.0, 190.0, 90.0)], "frame int, lx double, ly double, lz double, alpha double, beta double, gamma double")
    assert tuple(slicing.check_boxes(boxes).first()) == (1, 1, 1)
    frames = spark.createDataFrame([(0, 0.0), (1, 2.0), (2, 5.0)], "frame int, time double")
    assert tuple(slicing.check_time_step(frames).first()) == (2.0, 3.0)


def in_files(spark, tmp_path, parts):
    """A stream of tables, one file each, in order."""
    for k, d in enumerate(parts):
        d.coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")


def run_stream(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def timed(d):
    return d.selectExpr("*", "timestamp_seconds(1700000000 + frame * 60) as ts")


def test_stream(spark, tmp_path, dtrj):
    d = dtrj([[1, 1, 2, 2, 2, 3], [5, 5, 5, 5, 6, 6]])
    stream = in_files(spark, tmp_path, [d.where(f"frame between {2 * k} and {2 * k + 1}") for k in range(3)])
    made = run_stream(spark, streams.stream_runs(stream), tmp_path, "runs_out")
    assert rows(made) == rows(states.runs(d).where("not is_last").select("cmp", "state", "t0", "len", "is_first", "is_last"))


def test_stream_to_its_end(spark, tmp_path, dtrj):
    """A compound that sends nothing more is over when the watermark has passed: its last run comes out as cut off."""
    d = timed(dtrj([[1, 1, 2, 2, 2, 3], [5, 5, 5, 5, 5, 5]]))
    late = spark.createDataFrame([(99, 500, 0)], "cmp long, frame int, state int")
    stream = in_files(spark, tmp_path, [*(d.where(f"frame between {3 * k} and {3 * k + 2}") for k in range(2)), timed(late)])
    made = run_stream(spark, streams.stream_runs(stream, "ts", "1 minute"), tmp_path, "runs_to_end").where("cmp < 99")
    assert rows(made) == rows(states.runs(d).select("cmp", "state", "t0", "len", "is_first", "is_last"))


@pytest.mark.parametrize("width", [1, 4])
def test_stream_filled(spark, tmp_path, dtrj, width):
    d = timed(dtrj([[1, 2, 1, 1, 3, 4, 1, 2, 2, 5, 5, 2], [0, 1, 0, 1, 0, 0, 1, 1, 1, 0, 1, 1], [1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 3]]))
    late = spark.createDataFrame([(99, 500, 0)], "cmp long, frame int, state int")
    stream = in_files(spark, tmp_path, [*(d.where(f"frame >= {f} and frame < {f + width}") for f in range(0, 12, width)), timed(late)])
    made = run_stream(spark, streams.stream_filled(stream, 2, "ts", "1 minute"), tmp_path, f"filled_{width}").where("cmp < 99")
    assert rows(made) == rows(repair.correct_intermittency(d.drop("ts"), 2))


def test_stream_renewals(spark, tmp_path):
    import random

    rng = random.Random(1)
    pairs = [(f, r, s) for r in range(6) for f in range(20) for s in range(4) if rng.random() < 0.45]
    contacts_ = spark.createDataFrame(pairs, "frame int, ref long, sel long")
    grid = spark.range(6).selectExpr("id as ref", "explode(sequence(0, 19)) as frame")
    partners = grid.join(contacts_.groupBy("frame", "ref").agg({"sel": "collect_list"}).withColumnRenamed("collect_list(sel)", "sels"), ["frame", "ref"], "left")
    late = spark.createDataFrame([(500, 99, None)], "frame int, ref long, sels array<bigint>")
    stream = in_files(spark, tmp_path, [*(timed(partners.where(f"frame between {5 * k} and {5 * k + 4}")) for k in range(4)), timed(late)])
    made = run_stream(spark, streams.stream_renewals(stream, "ts", "1 minute"), tmp_path, "renewals_out").where("ref < 99")
    wanted = events.bound_intervals(contacts_).selectExpr("ref", "sel", "t0", "stop - t0 as trenew", "t0 = 0 as is_first", "stop = 20 as is_last")
    assert rows(made.where("not is_last")) == rows(wanted.where("not is_last"))
    assert rows(made.where("is_last"), "ref", "t0", "trenew") == rows(wanted.where("is_last"), "ref", "t0", "trenew")


def test_stream_renewals_with_positions(spark, tmp_path):
    """The same rows as in batch, over many batches of the streams; positions that are missing, null or too late leave their renewals out."""
    import random

    rng = random.Random(4)
    n, refs, sels = 40, 5, 4
    contacts_ = spark.createDataFrame([(f, r, s) for r in range(refs) for f in range(n) for s in range(sels) if rng.random() < 0.4], "frame int, ref long, sel long")
    place = lambda i, f: tuple(None if rng.random() < 0.04 else rng.uniform(0, 9) for _ in "xyz")
    ref_pos = spark.createDataFrame([(r, f, *place(r, f)) for r in range(refs) for f in range(n)], "ref long, frame int, x double, y double, z double")
    every = [(s, f, *place(s, f)) for s in range(sels) for f in range(n) if rng.random() > 0.05]
    shape = "sel long, frame int, x double, y double, z double"
    is_late = lambda p: p[0] == 1 and p[1] in (3, 4, 5, 6)
    sel_pos, late_pos = spark.createDataFrame([p for p in every if not is_late(p)], shape), spark.createDataFrame([p for p in every if is_late(p)], shape)

    pairs = contacts_.join(spark.createDataFrame(every, shape), ["sel", "frame"], "left").groupBy("ref", "frame").agg(F.collect_list(F.struct("sel", "x", "y", "z")).alias("sels"))
    stream, late = replay.in_order(ref_pos.join(pairs, ["ref", "frame"], "left"), "ref", 8)
    placed = streams.stream_placed_renewals(stream, "ts", late)
    renewals = spark.readStream.schema(placed.schema).parquet(replay.written(placed))
    tick = lambda d: d.withColumn("ts", F.timestamp_seconds((F.col("frame") + 1) * replay.TICK))
    parts = [*(tick(sel_pos.where(f"frame between {5 * k} and {5 * k + 4}")) for k in range(8)), tick(late_pos)]
    made = replay.to_end(streams.with_partner_moves(renewals, in_files(spark, tmp_path, parts), late))

    wanted = events.renewal_events(contacts_, n, ref_pos, spark.createDataFrame(every, shape)).dropna()
    lost = (F.col("sel") == 1) & (F.col("t0") + F.col("trenew")).between(3, 6)
    assert wanted.where(lost).count() > 0 and wanted.where(~lost).count() > 20
    columns = [c for c in made.columns if c != "ts"]
    assert rows(made, *columns) == rows(wanted.where(~lost), *columns)
    assert events.renewal_events(contacts_, n).count() > wanted.count()


def test_stream_contact_hist(spark, tmp_path):
    data = timed(spark.createDataFrame([(f, r, s) for f in range(4) for r in range(3) for s in range(r + f % 2)], "frame int, ref long, sel long"))
    late = timed(spark.createDataFrame([(500, 0, 0)], "frame int, ref long, sel long"))
    stream = in_files(spark, tmp_path, [data, late, late.selectExpr("frame + 100 as frame", "ref", "sel", "ts + interval 2 hours as ts")])
    made = run_stream(spark, streams.stream_contact_hist(stream, "ts", "30 minutes", "1 minute"), tmp_path, "hist_out")
    assert {(r["n"], r["count"]) for r in made.where("start < timestamp_seconds(1700000000 + 3600)").collect()} == {(1, 4), (2, 4), (3, 2)}


def test_matrices(spark, tmp_path):
    """Rows that look like the head line are rows; each file has a head of its own; heads may begin with a word."""
    (tmp_path / "m.txt").write_text("0 1 2 3\n0 1 5 6\n1 7 8 9\n")
    made = rows(files.read_matrix(spark, f"file://{tmp_path}/m.txt"))
    assert made == sorted([(0.0, 1.0, 1.0), (0.0, 2.0, 5.0), (0.0, 3.0, 6.0), (1.0, 1.0, 7.0), (1.0, 2.0, 8.0), (1.0, 3.0, 9.0)], key=repr)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("# one\nx 1 2\n10 1 2\n")
    (tmp_path / "d" / "b.txt").write_text("x 5\n10 7\n11 8\n")
    assert rows(files.read_matrix(spark, f"file://{tmp_path}/d")) == sorted([(10.0, 1.0, 1.0), (10.0, 2.0, 2.0), (10.0, 5.0, 7.0), (11.0, 5.0, 8.0)], key=repr)


def test_distance_bins():
    assert slicing.distance_bins((6.0, 8.0, 1e-12), 0, 9, num=5) == (0.0, 5.0, 1.0, 5)
    with pytest.raises(ValueError):
        slicing.distance_bins((0.0, 1.0, 1.0), 0, 1, num=2)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    made = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE_SQL:
        agree(made, registry.ORACLE_SQL[name], duck)
    else:
        assert made.count() >= 0
