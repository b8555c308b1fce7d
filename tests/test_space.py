"""Geometry, contacts, events and displacements."""

import itertools
import random

import numpy as np
import pytest
from helpers import column, near, plain, rows
from pyspark.sql import functions as F

from framewalk.functions import geometry
from framewalk.operators import binning, contacts, dynamics, events, repair
from framewalk.plans import space_queries, tables

SF = "/root/testdata/sf0.001"
# Inputs of documented examples; the results below that are lists of numbers are theirs.
CM = [(1, 0), (2, 0), (2, 1), (3, 1), (3, 2), (4, 0), (4, 1), (4, 2), (4, 3)]


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


def one(spark, *columns):
    return [plain(x) for x in spark.range(1).select(*columns).first()]


def test_boxes(spark):
    assert near(one(spark, *geometry.triclinic_box([lits(1, 0, 0), lits(2, 3, 0), lits(4, 5, 6)])), [1, 3.60555128, 8.77496439, 43.36781871, 62.88085723, 56.30993247])
    assert near(one(spark, *(c for v in geometry.triclinic_vectors(lits(1, 2, 3), lits(40, 60, 80)) for c in v)), [1, 0, 0, 0.34729636, 1.96961551, 0, 1.5, 2.06909527, 1.57125579])
    assert near(one(spark, geometry.volume(lits(2, 3, 4)), geometry.box_volume(lits(2, 3, 4), lits(90, 90, 90)), geometry.diagonal(lits(2, 3, 6))), [24, 24, 7])


def test_positions(spark):
    ortho = [lits(4, 0, 0), lits(0, 5, 0), lits(0, 0, 6)]
    assert near(one(spark, *geometry.wrap_pos(lits(0, 3, 6), ortho)), [0, 3, 0])
    box = [lits(3, 0, 0), lits(0, 2, 0), lits(0, 0, 2)]
    assert near(one(spark, *geometry.vdist(lits(0, 2, 4), lits(5, 3, 1))), [-5, -1, 3])
    assert near(one(spark, *geometry.vdist(lits(0, 2, 4), lits(5, 3, 1), box)), [1, -1, -1])
    skew = geometry.triclinic_vectors(lits(1, 2, 3), lits(40, 60, 80))
    there = geometry.box2cart(lits(0.25, 0.5, 0.75), skew)
    assert near(one(spark, *geometry.cart2box(there, skew)), [0.25, 0.5, 0.75])


@pytest.mark.parametrize("method", ["scaling", "displacement", "in-house", "heuristic", "hybrid"])
def test_unwrap(spark, method):
    rng = random.Random(3)
    rows_, true = [], {}
    for p in range(4):
        x = [rng.uniform(0, 5), rng.uniform(0, 6), rng.uniform(0, 7)]
        for t in range(30):
            true[p, t] = list(x)
            rows_.append((t, p, *x))
            x = [a + rng.uniform(-1.5, 1.5) for a in x]
    pos = spark.createDataFrame(rows_, "frame int, p long, x double, y double, z double")
    boxes = spark.range(30).select(F.col("id").cast("int").alias("frame"), F.lit(5.0).alias("lx"), F.lit(6.0).alias("ly"), F.lit(7.0).alias("lz"))
    made = dynamics.unwrap(dynamics.wrap(pos, boxes), boxes, "p", method)
    for r in made.collect():
        assert np.allclose([r["x"], r["y"], r["z"]], true[r["p"], r["frame"]])


def brute(ref, sel, cutoff, box):
    out = set()
    for (f, i, *a), (g, j, *b) in itertools.product(ref, sel):
        if f == g:
            d = [q - p for p, q in zip(a, b)]
            if box:
                d = [x - np.floor(x / length + 0.5) * length for x, length in zip(d, box)]
            if sum(x * x for x in d) ** 0.5 <= cutoff:
                out.add((f, i, j))
    return out


@pytest.mark.parametrize("box", [None, (10.0, 7.0, 4.0), (2.0, 2.0, 2.0)])
def test_contact_pairs(spark, box):
    rng = random.Random(5)
    make = lambda n: [(f, i, *(rng.uniform(-1, 11) for _ in range(3))) for f in range(3) for i in range(n)]
    ref, sel = make(40), make(30)
    boxes = spark.createDataFrame([(f, *box) for f in range(3)], "frame int, lx double, ly double, lz double") if box else None
    made = contacts.contact_pairs(spark.createDataFrame(ref, "frame int, ref long, x double, y double, z double"), spark.createDataFrame(sel, "frame int, sel long, x double, y double, z double"), 1.5, boxes)
    got = [(r["frame"], r["ref"], r["sel"]) for r in made.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(ref, sel, 1.5, box)


@pytest.fixture(scope="module")
def cm(spark):
    return spark.createDataFrame([(0, r, s) for r, s in CM], "frame int, ref long, sel long"), spark.createDataFrame([(0, r) for r in range(5)], "frame int, ref long")


def test_contact_hists(spark, cm):
    found, refs = cm
    h = contacts.contact_hists(contacts.compound_counts(found), refs).orderBy("n")
    assert [column(h, c, "n") for c in ("diff", "same", "tot", "pair")] == [[1, 1, 2, 0, 1], [1, 4, 0, 0, 0], [1, 1, 2, 0, 1], [0, 9, 0, 0, 0]]
    ref_of = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)], "ref long, cmp long")
    sel_of = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "sel long, cmp long")
    both = contacts.compound_counts(found, ref_of, sel_of)
    assert rows(both, "ref", "sel", "n") == [(0, 0, 1), (1, 0, 3), (1, 1, 1), (2, 0, 2), (2, 1, 2)]
    h = contacts.contact_hists(both, spark.createDataFrame([(0, r) for r in range(3)], "frame int, ref long"))
    assert [column(h, c, "n") for c in ("same", "tot", "pair")] == [[0, 2, 1, 1, 0], [0, 1, 0, 0, 2], [0, 2, 2, 1, 0]]


def test_contact_sets(spark):
    cms = [[(0, 0), (0, 1), (1, 1), (1, 2)], [(0, 0), (1, 2)], [(0, 0), (0, 1), (1, 2)]]
    found = spark.createDataFrame([(f, r, s) for f, c in enumerate(cms) for r, s in c], "frame int, ref long, sel long")
    assert column(contacts.n_contacts(found), "n", "frame") == [4, 2, 3]
    assert contacts.n_common_contacts(found, 3).first()[0] == 2
    assert rows(contacts.attach_detach(found, 3)) == [(1, 0, 0, 1), (1, 1, 0, 1), (2, 0, 1, 0)]


def test_partner_stats(spark):
    found = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (0, 2, 1), (0, 3, 1), (0, 3, 2), (0, 4, 2), (0, 4, 3)], "frame int, ref long, sel long")
    refs = spark.createDataFrame([(0, r) for r in range(5)], "frame int, ref long")
    wanted = [(0, 0, 0, 0, 0), (1, 0, 0, 0, 0), (2, 0.5, 0.25, 0, 1), (2, 1.5, 0.25, 1, 2), (2, 2.5, 0.25, 2, 3)]
    got = contacts.sel_index_stats(found, refs).orderBy("ref").collect()
    assert [tuple(r[c] for c in ("n", "mean", "var", "min", "max")) for r in got] == wanted
    assert contacts.sel_index_stats(found, refs, True).where("ref = 0").first()["mean"] is None


def machine(frames, n):
    """The renewal rule, frame by frame."""
    out, t0, cand = [], None, set()
    for f in range(n):
        now = frames.get(f, set())
        if t0 is not None:
            left = cand & now
            if not left:
                out.append((t0, f, min(cand)))
                t0, cand = (f, set(now)) if now else (None, set())
            else:
                cand = left
        elif now:
            t0, cand = f, set(now)
    if t0 is not None:
        out.append((t0, n, min(cand)))
    return out


def test_renewals(spark):
    rng = random.Random(11)
    n, data, wanted = 40, [], []
    for ref in range(6):
        frames = {}
        for sel in range(4):
            on = False
            for f in range(n):
                on = rng.random() < (0.8 if on else 0.15)
                if on:
                    frames.setdefault(f, set()).add(sel)
                    data.append((f, ref, sel))
        wanted += [(ref, s, a, b) for a, b, s in machine(frames, n)]
    found = spark.createDataFrame(data, "frame int, ref long, sel long")
    assert rows(events.bound_intervals(found), "ref", "sel", "t0", "stop") == sorted(wanted, key=repr)
    kept = sorted(((r, s, a, b - a) for r, s, a, b in wanted if a > 0 and b < n), key=repr)
    assert rows(events.renewal_events(found, n), "ref", "sel", "t0", "trenew") == kept
    refs = spark.createDataFrame([(r,) for r in range(6)], "ref long")
    assert events.coordination_sequence(found, refs, n).count() == 6 * n


def test_gap_repair(spark, dtrj):
    a, b, c, d = [0, 0, 0, 1, 1, 1], [1, 1, 1, 0, 0, 0], [1, 0, 1, 0, 1, 0], [0, 1, 0, 1, 0, 1]
    frames = [list(x) for x in zip(a, b, c, d)]
    for n, wanted in ((0, [a, b, c, d]), (1, [a, c, c, d]), (2, [a, a, a, d]), (9, [a, a, a, d])):
        made = repair.correct_intermittency(dtrj(frames), n)
        assert column(made, "state", "frame", "cmp") == [x for f in wanted for x in f]
    found = spark.createDataFrame([(0, 0, 0), (2, 0, 0), (6, 0, 0)], "frame int, ref long, sel long")
    assert column(repair.correct_contact_intermittency(found, 1, 8), "frame", "frame") == [0, 1, 2]


def test_short_sequences(dtrj):
    made = repair.replace_short_sequences(dtrj([[1, 1, 2, 3, 3, 3]]), 2, 0)
    assert column(made, "state", "frame") == [1, 1, 0, 3, 3, 3]
    made = repair.replace_short_sequences_global(dtrj([[1, 2, 3, 3], [2, 1, 1, 4]]), 2, 0)
    assert column(made, "state", "cmp", "frame") == [1, 2, 3, 3, 2, 1, 1, 0]


def test_rmsd(spark):
    a = spark.createDataFrame([(0, 0, 3.0, 4.0, 5.0)], "frame int, p long, x double, y double, z double")
    b = spark.createDataFrame([(0, 0, 1.0, 7.0, -1.0)], "frame int, p long, x double, y double, z double")
    r = dynamics.rmsd(a, b, ["frame"], "p").first()
    assert near([r["msd_x"], r["msd_y"], r["msd_z"], r["rmsd"]], [4, 9, 36, 7])
    boxes = spark.createDataFrame([(0, 5.0, 3.0, 3.0)], "frame int, lx double, ly double, lz double")
    assert near([dynamics.rmsd(a, b, ["frame"], "p", boxes=boxes).first()["rmsd"]], [2])


def test_make_whole(spark):
    pos = spark.createDataFrame([(0, 0, k, float((8 + k) % 10), 1.0, 1.0) for k in range(7)], "frame int, mol long, atom long, x double, y double, z double")
    boxes = spark.createDataFrame([(0, 10.0, 10.0, 10.0)], "frame int, lx double, ly double, lz double")
    bonds = spark.createDataFrame([(k, k + 1) for k in range(6)], "a long, b long")
    made = dynamics.make_whole_by_bonds(pos, boxes, "mol", "atom", bonds)
    assert column(made, "x", "atom") == [8.0, 9.0, 10.0, 11.0, 12.0, 13.0, 14.0]
    assert column(dynamics.make_whole(pos.where("atom < 4"), boxes, "mol", "atom"), "x", "atom") == [8.0, 9.0, 10.0, 11.0]


def test_grid(spark):
    pos = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 1.0), (0, 3.0, 1.0, 1.0, -2.0), (0, 9.5, 1.0, 1.0, 5.0)], "frame int, x double, y double, z double, q double")
    boxes = spark.createDataFrame([(0, 10.0, 10.0, 10.0)], "frame int, lx double, ly double, lz double")
    r = binning.subvolume_charge(pos, boxes, [3.0]).first()
    assert (r["n_cubes"], r["n_atoms"]) == (27, 2)
    assert near([r["mean_q"], r["mean_q2"]], [-1 / 27, 5 / 27])


def test_hexagon_faces():
    lengths = (3.0, 3**0.5)
    vertices = [(0.0, 0.0), (1.0, 0.0), (1.5, 3**0.5 / 2), (2.5, 3**0.5 / 2)]
    faces = binning.hexagon_faces(vertices, 1.0, lengths)
    assert sorted((round(x, 6), round(y, 6)) for x, y in faces) == [(0.5, 0.866025), (2.0, 0.0)]


def test_contacts_of_any_day(spark, tmp_path):
    """Events before day 0 and from day 30 on are in the contacts, too."""
    days = ["2023-12-30", "2024-01-01", "2024-01-31", "2024-03-01"]
    data = [(2 * k + j, 7, kind, 5.0 + j, f"{day} 10:00:00", '{"k": 3}') for k, day in enumerate(days) for j, kind in enumerate(["click", "purchase"])]
    made = spark.createDataFrame(data, "event_id long, user_id long, event_type string, value double, ts string, props string")
    made.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"file://{tmp_path}/events.parquet")
    for name in ("contact_pairs", "topological_map"):
        found = space_queries.QUERIES[name](spark, f"file://{tmp_path}").collect()
        assert sorted(r["frame"] for r in found) == [-2, 0, 30, 60]


def test_msd_of_all_starts(spark):
    """At lag 0 every position is a start."""
    made = space_queries.QUERIES["msd_all_starts"](spark, SF)
    assert made.where("lag = 0").first()["n"] == tables.positions(spark, SF).count()


def skewed(rng, n_frames, n, box):
    """Positions in skewed boxes, and the boxes' vectors."""
    import numpy as np

    a, b, c, al, be, ga = (*box[:3], *np.radians(box[3:]))
    y = (np.cos(al) - np.cos(be) * np.cos(ga)) / np.sin(ga)
    m = np.array([[a, 0, 0], [b * np.cos(ga), b * np.sin(ga), 0], [c * np.cos(be), c * y, c * np.sqrt(1 - np.cos(be) ** 2 - y * y)]])
    return rng.random((n_frames, n, 3)) @ m, m


BOXES = "frame int, lx double, ly double, lz double, alpha double, beta double, gamma double"


def test_skewed_boxes(spark):
    """Contacts, wrapping and unwrapping against brute force over images."""
    import numpy as np

    rng = np.random.default_rng(3)
    box = (9.0, 8.0, 7.0, 75.0, 80.0, 65.0)
    pos, m = skewed(rng, 2, 40, box)
    data = spark.createDataFrame([(f, k, *map(float, pos[f, k])) for f in range(2) for k in range(40)], "frame int, ref long, x double, y double, z double")
    boxes = spark.createDataFrame([(f, *box) for f in range(2)], BOXES)
    sel = data.withColumnRenamed("ref", "sel")
    for spread in ("ref", "sel"):
        made = {(r["frame"], r["ref"], r["sel"]): r["dist"] for r in contacts.contact_pairs(data, sel, 1.6, boxes, spread).collect()}
        wanted = {}
        for f in range(2):
            d = pos[f][None] - pos[f][:, None]
            d = d - np.floor(d @ np.linalg.inv(m) + 0.5) @ m
            for i, j in np.argwhere(np.linalg.norm(d, axis=2) <= 1.6):
                wanted[f, int(i), int(j)] = float(np.linalg.norm(d[i, j]))
        assert made.keys() == wanted.keys() and all(abs(made[k] - wanted[k]) < 1e-9 for k in made)
    walk = np.cumsum(np.concatenate([pos[:1], rng.normal(size=(30, 40, 3)) * 0.6]), axis=0)
    steps = spark.createDataFrame([(t, k, *map(float, walk[t, k])) for t in range(31) for k in range(40)], "frame int, ref long, x double, y double, z double")
    long_boxes = spark.createDataFrame([(t, *box) for t in range(31)], BOXES)
    wrapped = dynamics.wrap(steps, long_boxes)
    for method in ("scaling", "displacement", "in-house", "heuristic", "hybrid"):
        made = dynamics.unwrap(wrapped, long_boxes, "ref", method).collect()
        assert all(np.allclose([r["x"], r["y"], r["z"]], walk[r["frame"], r["ref"]], atol=1e-8) for r in made)


def test_skewed_compounds(spark):
    """A compound that reaches over the faces of a skewed box is put together, and its centre into the box."""
    import numpy as np

    rng = np.random.default_rng(5)
    box = (9.0, 8.0, 7.0, 75.0, 80.0, 65.0)
    pos, m = skewed(rng, 1, 6, box)
    whole = pos[0][:, None] + rng.normal(size=(6, 4, 3)) * 0.4
    inside = whole - np.floor(whole @ np.linalg.inv(m)) @ m
    data = spark.createDataFrame([(0, c, a, *map(float, inside[c, a]), 1.0 + a) for c in range(6) for a in range(4)], "frame int, cmp long, atom long, x double, y double, z double, mass double")
    boxes = spark.createDataFrame([(0, *box)], BOXES)
    for reference, weight in (("first", None), ("cog", None), ("com", "mass")):
        made = dynamics.make_whole(data, boxes, "cmp", "atom", reference, weight).collect()
        got = np.zeros((6, 4, 3))
        for r in made:
            got[r["cmp"], r["atom"]] = r["x"], r["y"], r["z"]
        assert np.allclose(got - got[:, :1], whole - whole[:, :1])
        w = np.ones(4) if weight is None else np.arange(1.0, 5)
        center = (got * w[:, None]).sum(1) / w.sum()
        if reference != "first":
            part = center @ np.linalg.inv(m)
            assert ((part >= 0) & (part < 1)).all()
    made = dynamics.centers(data, ["frame", "cmp"], None, boxes, "atom", True).orderBy("cmp").collect()
    part = whole.mean(1) @ np.linalg.inv(m)
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in made], (part - np.floor(part)) @ m)
    with pytest.raises(ValueError):
        dynamics.make_whole(data, boxes, "cmp", "atom", "com")


def test_detached_at_the_end(spark):
    """A pair that parts and never meets again is detached at the frame after its last contact."""
    found = spark.createDataFrame([(0, 1, 2), (1, 1, 2)], "frame int, ref long, sel long")
    assert rows(contacts.attach_detach(found, 10)) == [(2, 1, 0, 1)]
    assert rows(contacts.attach_detach(found, 2)) == []


def test_nearest_site_with_gaps(spark):
    """Sites of very uneven density, a single one, and positions far from all of them."""
    import numpy as np

    rng = np.random.default_rng(2)
    at = rng.random((300, 2)) * [20.0, 10.0]
    data = spark.createDataFrame([(k, 0, float(x), float(y), float(k % 2)) for k, (x, y) in enumerate(at)], "cmp long, frame int, x double, y double, z double")
    for points in ([(3.0, 4.0)], [(1.0, 1.0), (1.01, 1.0), (1.0, 1.01)] + [(0.5 + 0.02 * k, 0.5) for k in range(60)] + [(19.9, 9.9)]):
        sites = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "site int, x double, y double")
        d = at[:, None] - np.array(points)[None]
        d = d - np.floor(d / [20.0, 10.0] + 0.5) * [20.0, 10.0]
        wanted = np.argmin((d**2).sum(2), axis=1)
        made = {r["cmp"]: r["state"] for r in binning.nearest_site(data, sites, (20.0, 10.0), (0.5, 2.0)).collect()}
        assert len(made) == 300 and all(made[k] == (wanted[k] if k % 2 else -1) for k in made)


def test_hexagon_axes():
    """Every line passes through faces that are neighbours: one lattice constant apart along nearest axes, sqrt(3) of it along the others."""
    import math

    side, a = 1.0, math.sqrt(3.0)
    lengths = (6.0, 2 * a)
    vertices = sorted({(round((x + 1.5 * i) % lengths[0], 6), round((a / 2 * i + a * j) % lengths[1], 6)) for i in range(4) for j in range(2) for x in (1.0, 2.0)})
    faces = binning.hexagon_faces(vertices, side, lengths)
    for neighbours, apart in ((1, a), (2, 3.0)):
        axes = binning.hexagon_axes(vertices, side, lengths, neighbours)
        assert {x[2] for x in axes} == ({30.0, 90.0, 150.0} if neighbours == 1 else {0.0, 60.0, 120.0})
        for x0, y0, angle in axes:
            x, y = x0 + apart * math.cos(math.radians(angle)), y0 + apart * math.sin(math.radians(angle))
            d = [((x - fx + lengths[0] / 2) % lengths[0] - lengths[0] / 2) ** 2 + ((y - fy + lengths[1] / 2) % lengths[1] - lengths[1] / 2) ** 2 for fx, fy in faces]
            assert min(d) < 1e-6


def test_hexagonal_distribution(spark):
    data = spark.createDataFrame([(1.0, 5.0), (1.2, 9.9), (3.0, 5.0)], "x double, y double")
    made = binning.hexagonal_distribution(data, [(1.0, 0.0, 90.0)], (12.0, 10.0), 1.0, [0.0, 1.0, 4.0, 6.0])
    assert column(made, "n", "bin") == [1, 0, 1]
    slant = binning.hexagonal_distribution(data, [(1.0, 5.0, 30.0)], (12.0, 10.0), 0.2, [0.0, 1.0, 4.0])
    assert column(slant, "n", "bin") == [1, 0]


def test_msd_by_bucket(spark):
    """With a bound on the lag, long sequences are joined by bucket; the same as over all pairs."""
    data = spark.range(2000).selectExpr("id div 1000 as cmp", "cast(id % 1000 as int) as frame", "cast((id * 37) % 101 as double) as x", "cast((id * 17) % 89 as double) as y", "0D as z")
    made = dynamics.msd(data, "cmp", 1000, restart=3, max_lag=70)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in next(line for line in plan.splitlines() if "Join" in line)
    data.createOrReplaceTempView("walk_")
    wanted = spark.sql("select cast(b.frame - a.frame as int) lag, count(*) n, avg(pow(b.x - a.x, 2)) msd_x from walk_ a join walk_ b on a.cmp = b.cmp and b.frame - a.frame between 0 and 70 where a.frame % 3 = 0 group by 1")
    assert rows(made, "lag", "n", "msd_x") == rows(wanted, "lag", "n", "msd_x")


def test_msd_of_all_lags(spark):
    """By Fourier transforms the same as over all pairs, with frames missing, too; 100,000 frames in seconds."""
    data = spark.range(300).selectExpr("id div 100 as cmp", "cast(id % 100 as int) as frame", "cast((id * 37) % 101 as double) + 1e4 as x", "cast((id * 17) % 89 as double) as y", "0D as z").where("not (cmp = 1 and frame in (5, 6) or cmp = 2 and frame = 99)")
    a, b = dynamics.msd_all_lags(data, "cmp"), dynamics.msd(data, "cmp", 100)
    assert rows(a, "lag", "n") == rows(b, "lag", "n")
    assert all(abs(x["msd"] - y["msd"]) < 1e-6 for x, y in zip(a.orderBy("lag").collect(), b.orderBy("lag").collect()))
    halves = dynamics.msd_all_lags(data.withColumn("frame", F.col("frame") % 50), "cmp", F.floor(F.col("y") / 1000))
    assert halves.columns[0] == "block"
    long = spark.range(2 * 100_000).selectExpr("id div 100000 as cmp", "cast(id % 100000 as int) as frame", "cast(id % 100000 as double) as x", "0D as y", "0D as z")
    made = dynamics.msd_all_lags(long, "cmp").where("lag in (1, 1000)").orderBy("lag").collect()
    assert [(r["n"], round(r["msd_x"], 2)) for r in made] == [(199_998, 1.0), (198_000, 1e6)]
