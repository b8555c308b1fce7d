"""Lag counts of runs, gap repair of runs, bonds, crowded cells, shares at rest: against plain versions."""

import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from framewalk.operators import contacts, dynamics, events, lags, repair, states


def sequences(rng, n, length, values, stay=0.7):
    out = []
    for _ in range(n):
        one = [rng.choice(values)]
        for _ in range(rng.randrange(length // 2, length)):
            one.append(one[-1] if rng.random() < stay else rng.choice(values))
        out.append(one)
    return out


@pytest.mark.parametrize("options", [{}, {"discard_neg_start": True}, {"discard_all_neg": True}, {"max_lag": 7}, {"max_lag": 7, "discard_all_neg": True}])
@pytest.mark.parametrize("second", [False, True])
def test_pairs_of_runs_are_pairs_of_frames(spark, dtrj, monkeypatch, options, second):
    """remain_prob from runs, with buckets shorter than the runs, equals counting all pairs."""
    monkeypatch.setattr(lags, "LEAST", 4)
    monkeypatch.setattr(lags, "MOST", 8)
    rng = random.Random(3)
    seqs = sequences(rng, 12, 40, [-1, 0, 1])
    marks = [[rng.choice([5, 6]) for _ in s] for s in seqs]
    made = states.remain_prob(dtrj(seqs), dtrj(marks) if second else None, **options)
    n = max(map(len, seqs))
    most = options.get("max_lag", n - 1)
    want = {}
    for s, m in zip(seqs, marks):
        for a in range(len(s) - 1):
            for lag in range(1, most + 1):
                b = a + lag
                if b >= len(s) or (options and "max_lag" not in options or "discard_all_neg" in options) and s[a] < 0 or options.get("discard_all_neg") and min(s[a : b + 1]) < 0:
                    continue
                cell = want.setdefault((m[a] if second else None, lag), [0, 0])
                cell[0] += s[a] == s[b]
                cell[1] += 1
    got = {(r["state2"] if second else None, r["lag"]): [r["n_same"], r["n_valid"]] for r in made.collect() if r["lag"]}
    assert {k: v for k, v in got.items() if v != [0, 0]} == want
    assert len(got) == most * (2 if second else 1)


def test_long_sequences_take_linear_time(spark):
    """Two compounds of 100,000 frames without a bound on the lag."""
    import time

    rows_ = spark.range(200_000).select(F.floor(F.col("id") / 100_000).alias("cmp"), (F.col("id") % 100_000).cast("int").alias("frame"), (F.floor(F.col("id") / 137) % 3 + F.floor(F.col("id") / 911) % 2).cast("int").alias("state"))
    start = time.time()
    assert states.remain_prob(rows_).count() == 100_000
    assert states.remain_prob(rows_, continuous=True).where("n_same > 0").count() > 100
    assert time.time() - start < 120


def test_autocorrelation(spark):
    rng = random.Random(4)
    members = {(k, f) for k in range(5) for f in range(60) if rng.random() < 0.6}
    frame = spark.createDataFrame(sorted(members), "ref long, frame int")
    for restart, most in ((1, None), (1, 9), (3, None)):
        made = {r["lag"]: (r["n_both"], r["n_start"]) for r in contacts.autocorrelation(frame, ["ref"], 60, restart, most).collect()}
        for lag in range(1, (most or 59) + 1):
            starts = [(k, f) for k, f in members if f % restart == 0 and f + lag < 60]
            assert made[lag] == (sum((k, f + lag) in members for k, f in starts), len(starts))


def test_gaps_of_runs(spark, dtrj):
    """The rule on runs against the rule frame by frame."""
    rng = random.Random(5)
    seqs = sequences(rng, 150, 40, [-1, 0, 1, 2], 0.5) + sequences(rng, 100, 30, [0, 1], 0.6) + [[1], [1, 2], [1, 2, 1], [2, 1, 2, 1]]
    for n in (1, 2, 3, 8):
        made = {}
        for r in repair.correct_intermittency(dtrj(seqs), n).collect():
            made.setdefault(r["cmp"], {})[r["frame"]] = r["state"]
        for k, s in enumerate(seqs):
            assert [made[k][f] for f in range(len(s))] == repair.fill_gaps(np.array(s), n).tolist()
            assert len(made[k]) == len(s)


def test_gaps_of_contacts(spark):
    rng = random.Random(6)
    n_frames = 25
    pairs = {(r, s): [int(rng.random() < p) for _ in range(n_frames)] for r in range(12) for s, p in enumerate((0.1, 0.3, 0.5, 0.7, 0.9, 1.0))}
    found = spark.createDataFrame([(f, r, s) for (r, s), b in pairs.items() for f in range(n_frames) if b[f]], "frame int, ref long, sel long")
    for n in (1, 2, 5):
        got = {tuple(x) for x in repair.correct_contact_intermittency(found, n, n_frames).collect()}
        assert got == {(f, r, s) for (r, s), b in pairs.items() if any(b) for f, x in enumerate(repair.fill_gaps(np.array(b), n)) if x}
    assert repair.correct_contact_intermittency(found.limit(0), 2, n_frames).count() == 0


def test_bonds_of_chains_rings_and_branches(spark):
    rng = random.Random(7)
    length = (5.0, 6.0, 7.0)
    bonds, place = [], {0: (1.0, 2.0, 3.0)}
    atoms = list(range(300))
    shuffled = atoms[1:]
    rng.shuffle(shuffled)
    names = [0, *shuffled]  # numbers that go up and down along the chain
    for k in range(1, 200):  # a chain
        place[names[k]] = tuple(x + rng.uniform(-1, 1) for x in place[names[k - 1]])
        bonds.append((names[k - 1], names[k]))
    for k in range(200, 290):  # branches
        of = names[rng.randrange(200)]
        place[names[k]] = tuple(x + rng.uniform(-1, 1) for x in place[of])
        bonds.append((names[k], of))
    near = lambda a, b: all(abs(x - y) < 2 for x, y in zip(place[a], place[b]))
    bonds += [(a, b) for a in names[:290] for b in names[:290] if a < b and near(a, b)][:40]  # rings
    bonds += [(5, 5), bonds[0], (900, 901)]
    for k in range(290, 300):  # alone
        place[names[k]] = tuple(rng.uniform(0, 5) for _ in range(3))
    wrapped = [(f, a, *(x % b for x, b in zip(place[a], length)), "m") for f in (0, 4) for a in atoms if (f, a) != (4, names[100])]
    pos = spark.createDataFrame(wrapped, "frame int, atom long, x double, y double, z double, mol string")
    boxes = spark.createDataFrame([(f, *length) for f in (0, 4)], "frame int, lx double, ly double, lz double")
    made = dynamics.make_whole_by_bonds(pos, boxes, "mol", "atom", spark.createDataFrame(bonds, "a long, b long"))
    assert made.columns == pos.columns and made.count() == len(wrapped)
    got = {(r["frame"], r["atom"]): (r["x"], r["y"], r["z"]) for r in made.collect()}
    start = {(f, a): p for f, a, *p, _ in wrapped}
    for f in (0, 4):
        for a, b in bonds:
            if (f, a) in got and (f, b) in got and a != b:
                assert all(abs((x - y) - (u - v)) < 1e-6 for x, y, u, v in zip(got[f, a], got[f, b], place[a], place[b]))
        assert got[f, 0] == pytest.approx(start[f, 0])
        for k in range(290, 300):
            assert got[f, names[k]] == pytest.approx(start[f, names[k]])
    assert dynamics.make_whole_by_bonds(pos.limit(0), boxes, "mol", "atom", spark.createDataFrame(bonds, "a long, b long")).count() == 0


def test_crowded_cells(spark, monkeypatch):
    """Nine tenths of the particles in one cell: the same pairs, no part of the cell with many more rows than its bound."""
    rng = random.Random(8)
    point = lambda k: (k % 2, k, *((rng.uniform(0, 1) if rng.random() < 0.9 else rng.uniform(0, 50)) for _ in range(3)))
    ref = spark.createDataFrame([point(k) for k in range(300)], "frame int, ref long, x double, y double, z double")
    sel = spark.createDataFrame([point(k) for k in range(400)], "frame int, sel long, x double, y double, z double")
    boxes = spark.createDataFrame([(f, 50.0, 50.0, 50.0) for f in (0, 1)], "frame int, lx double, ly double, lz double")
    for box in (None, boxes):
        plain = rows(contacts.contact_pairs(ref, sel, 1.5, box), "frame", "ref", "sel")
        assert len(plain) > 10_000
        with monkeypatch.context() as m:
            m.setattr(contacts, "CROWD", 16)
            assert rows(contacts.contact_pairs(ref, sel, 1.5, box), "frame", "ref", "sel") == plain
            assert rows(contacts.contact_pairs(ref, sel, 1.5, box, spread="sel"), "frame", "ref", "sel") == plain
    cell = ["frame", "cx", "cy", "cz"]
    crowded = spark.createDataFrame([(0, 0, 0, 0, 12)], "frame int, cx long, cy long, cz long, parts int")
    left = spark.createDataFrame([(0, k, 0, 0, 0) for k in range(10)] + [(1, 99, 0, 0, 0)], "frame int, ref long, cx long, cy long, cz long")
    right = spark.createDataFrame([(0, k, 0, 0, 0) for k in range(192)] + [(1, 99, 0, 0, 0)], "frame int, sel long, cx long, cy long, cz long")
    a, b = contacts._dealt(left, right, crowded, cell, "sel")
    assert a.count() == 121 and b.count() == 193
    assert max(r["count"] for r in b.groupBy(*cell, "part").count().collect()) <= 40
    assert a.join(b, [*cell, "part"]).count() == 10 * 192 + 1


def test_shares_at_rest(spark):
    rng = np.random.default_rng(9)
    p = rng.random((6, 6)) ** 4
    p[0] = [0, 1, 0, 0, 0, 0]
    p /= p.sum(axis=1, keepdims=True)
    values, vectors = np.linalg.eig(p.T)
    v = np.abs(np.real(vectors[:, np.argmin(np.abs(values - 1))]))
    cells = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(6) for j in range(6) if p[i, j]], "bin0 int, bin1 int, prob double")
    got = {r["bin"]: r["share"] for r in events.stationary_distribution(cells, 1e-7).collect()}
    assert [got[k] for k in range(6)] == pytest.approx((v / v.sum()).tolist(), abs=1e-5)
    circle = spark.createDataFrame([(k, (k + 1) % 5, 1.0) for k in range(5)], "bin0 int, bin1 int, prob double")
    assert [r["share"] for r in events.stationary_distribution(circle).collect()] == pytest.approx([0.2] * 5)
    assert events.stationary_distribution(circle.limit(0)).count() == 0


def test_kinds_of_change(spark):
    rows_ = [(0, 1, 1), (0, 1, 2), (1, 1, 3), (1, 1, 4), (2, 1, 3), (3, 1, 3), (3, 1, 5), (3, 1, 6)]
    found = spark.createDataFrame(rows_, "frame int, ref long, sel long")
    of = lambda *a: [tuple(r) for r in contacts.coordination_changes(found, 5, *a).orderBy("frame").collect()]
    assert of() == [(1, 1, 2, 2), (2, 1, 0, 1), (3, 1, 2, 0), (4, 1, 0, 3)]
    assert [r[0] for r in of("detachment", 2)] == [1, 4] and [r[0] for r in of("attachment", 1, 2)] == [1, 3]
    assert [r[0] for r in of("exchange", 1, 1)] == [1] and of("exchange", 3, 1) == []
    with pytest.raises(ValueError):
        of("other")
