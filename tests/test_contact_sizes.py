"""Halves of boxes, and contacts whose pairs stay in the partition where they are found."""

import math

import numpy as np
import pyarrow as pa
import pytest
from helpers import rows
from pyspark.sql import functions as F

from framewalk.operators import contacts, dynamics, events, near, repair
from framewalk.plans import registry


@pytest.mark.parametrize("method", ["heuristic", "hybrid"])
def test_unwrap_at_half_a_box(spark, method):
    """A step of half a box goes the way that division by its length says, as in SQL, not multiplication by the inverse."""
    length, steps = 10.013, [3, 29, -40, -2]
    rows = [(t, p, *([length * (n + 0.5) * t] * 3)) for p, n in enumerate(steps) for t in range(2)]
    pos = spark.createDataFrame(rows, "frame int, p long, x double, y double, z double")
    boxes = spark.range(2).select(F.col("id").cast("int").alias("frame"), *(F.lit(length).alias(f"l{a}") for a in "xyz"))
    for r in dynamics.unwrap(pos, boxes, "p", method).where("frame = 1").collect():
        d = length * (steps[r["p"]] + 0.5)
        assert r["x"] == r["y"] == r["z"] == d - length * math.floor(d / length + 0.5)


def test_skewed_distance_is_compiled_in_steps(spark):
    """The steps of a skewed distance are columns of their own, and tasks go by the pairs, not by the few bytes of the particles."""
    ref, sel = (spark.range(50).select(F.lit(0).alias("frame"), F.col("id").alias(side), *((F.rand(k) * 30).alias(a) for k, a in enumerate("xyz", seed))) for side, seed in (("ref", 1), ("sel", 5)))
    boxes = spark.createDataFrame([(0, 30.0, 30.0, 30.0, 80.0, 75.0, 70.0)], "frame int, lx double, ly double, lz double, alpha double, beta double, gamma double")
    made = contacts.contact_pairs(ref, sel, 5.0, boxes)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(line) for line in plan.split("\n") if "dist" in line) < 4000
    assert plan.count("RepartitionByExpression") == 2


@pytest.mark.parametrize("blocks", ["pairs", "frames"])
def test_pairs_stay_in_their_blocks(spark, blocks, monkeypatch):
    """Blocks give the same contacts and renewals, and nothing of a pair's size is shuffled: the particles are, twice, and what is summed by compound."""
    monkeypatch.setattr(contacts, "FEWEST", 9)
    ref, sel = (spark.range(120).select((F.col("id") % 3).cast("int").alias("frame"), F.col("id").alias(side), (F.col("id") % 11).alias("cmp"), *((F.rand(seed + k) * 12).alias(a) for k, a in enumerate("xyz"))) for side, seed in (("ref", 1), ("sel", 5)))
    ref, sel = ref.localCheckpoint(), sel.localCheckpoint()
    boxes = spark.range(3).select(F.col("id").cast("int").alias("frame"), *(F.lit(12.0).alias(c) for c in ("lx", "ly", "lz")))
    plain, placed = (contacts.compound_counts(contacts.contact_pairs(ref, sel, 3.0, boxes, compound="cmp", blocks=b)) for b in (None, blocks))
    assert rows(plain) == rows(placed.drop("block"))
    assert placed.withColumn("p", F.spark_partition_id()).groupBy("block", "ref", "sel", *(["frame"] if blocks == "frames" else [])).agg(F.count_distinct("p").alias("k")).where("k > 1").isEmpty()
    assert placed._jdf.queryExecution().executedPlan().toString().count("Exchange") - placed._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 2
    if blocks == "pairs":
        assert rows(events.bound_intervals(plain)) == rows(events.bound_intervals(placed))
        assert rows(contacts.attach_detach(plain, 3)) == rows(contacts.attach_detach(placed, 3))
        assert rows(contacts.autocorrelation(plain, ["ref", "sel"], 3)) == rows(contacts.autocorrelation(placed, ["ref", "sel"], 3))


ORTHO, SKEWED = "frame int, lx double, ly double, lz double", "frame int, lx double, ly double, lz double, alpha double, beta double, gamma double"


@pytest.mark.parametrize("box", [None, (12.0, 12.0, 12.0), (10.0, 7.0, 3.5), (12.0, 13.0, 14.0, 80.0, 75.0, 70.0)])
def test_compound_pairs(spark, box, monkeypatch):
    """What blocks find and sum on their own is what the join of particles gives: counts, runs and all made of runs; no pair is shuffled, however few are held."""
    monkeypatch.setattr(contacts, "FEWEST", 9)
    sides = []
    for side, seed in (("ref", 1), ("sel", 5)):
        at = [((F.rand(seed + k) - 0.3) * 20).alias(a) for k, a in enumerate("xyz")]
        at[0] = F.when(F.col("id") == 7, F.lit(None)).otherwise(at[0]).alias("x")
        number = F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), (F.col("id") % 11).cast("string"))).alias("cmp")
        sides.append(spark.range(400).select((F.col("id") % 6 + F.when(F.col("id") % 6 > 3, 2).otherwise(0)).cast("int").alias("frame"), F.col("id").alias(side), number, *at).localCheckpoint())
    boxes = spark.createDataFrame([(f, *box) for f in range(8)], ORTHO if len(box) == 3 else SKEWED) if box else None
    plain = contacts.compound_counts(contacts.contact_pairs(*sides, 3.0, boxes, compound="cmp")).coalesce(1).localCheckpoint()
    made = {(m, b): contacts.compound_pairs(*sides, 3.0, boxes, make=m, blocks=b) for m, b in (("counts", "pairs"), ("counts", "frames"), ("runs", "pairs"), ("longest", "pairs"))}
    for b in ("pairs", "frames"):
        assert rows(made["counts", b].drop("block")) == rows(plain)
        assert made["counts", b]._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "").count("Exchange") == 2
    known = plain.where("ref is not null and sel is not null").withColumns({c: F.substring(c, 2, 9).cast("long") for c in ("ref", "sel")})
    runs, best = (made[m, "pairs"].coalesce(1).localCheckpoint().where("ref is not null and sel is not null").withColumns({c: F.substring(c, 2, 9).cast("long") for c in ("ref", "sel")}) for m in ("runs", "longest"))
    assert rows(events.contact_runs(runs)) == rows(events.contact_runs(known))
    assert rows(contacts.attach_detach(runs, 8)) == rows(contacts.attach_detach(known, 8))
    assert rows(contacts.common_contacts(runs, 2)) == rows(contacts.common_contacts(known, 2))
    assert rows(events.shared_partners(runs, 3)) == rows(events.shared_partners(known, 3))
    assert rows(events.partner_numbers(runs)) == rows(events.partner_numbers(known))
    for gap in (0, 1, 2):
        assert rows(repair.correct_contact_intermittency(runs, gap, 8)) == rows(repair.correct_contact_intermittency(known, gap, 8))
    assert rows(events.bound_intervals(best)) == rows(events.bound_intervals(known))


def test_few_pairs_are_held(monkeypatch):
    """A block compares a bounded many pairs at a time, and repeated keys are summed as they come."""
    monkeypatch.setattr(near, "COMPARED", 50)
    monkeypatch.setattr(near, "HELD", 64)
    made = np.random.default_rng(3)
    one, many = ({"frame": np.sort(made.integers(0, 2, n)), **{f"c{a}": made.integers(0, 3, n) for a in "xyz"}, **{f"{k}{a}": made.random(n) for a in "xyz"}} for k, n in (("r", 60), ("", 70)))
    found = list(near.Block(one, many, [], 0.8).pairs())
    assert max(len(i) for i, _, _ in found) <= 50 + 70
    want = sum(one["frame"][i] == many["frame"][j] and all(abs(one[f"c{a}"][i] - many[f"c{a}"][j]) < 2 for a in "xyz") and sum((one[f"r{a}"][i] - many[a][j]) ** 2 for a in "xyz") <= 0.64 for i in range(60) for j in range(70))
    assert sum(len(i) for i, _, _ in found) == want > 500
    keys, n = near.summed(np.asarray(i % 5) for i, _, _ in found)
    assert keys.tolist() == [0, 1, 2, 3, 4] and n.sum() == want
    assert near.longest(np.array([0, 1, 2, 3]), np.array([1, 1, 0, 0]), np.array([1, 1, 1, 2]), 2, 3, np.array([4, 5, 6]))[0].tolist() == [0, 3]


@pytest.mark.parametrize("box", [None, (12.0, 12.0, 12.0), (10.0, 7.0, 3.5), (12.0, 13.0, 14.0, 80.0, 75.0, 70.0)])
def test_blocks_in_parts(box, monkeypatch):
    """A block's pairs are taken part by part, no more keys than a part's are held, and along x only what is in reach is compared."""
    made, n = np.random.default_rng(5), 900
    shape = geometry_shape(box)
    many = {"frame": made.integers(0, 2, n), **{a: made.random(n) * 40 - 8 for a in "xyz"}}
    one = {"frame": made.integers(0, 2, n), **{f"r{a}": made.random(n) * 40 - 8 for a in "xyz"}}
    for side, places in ((one, ("rx", "ry", "rz")), (many, ("x", "y", "z"))):
        for a, share in zip("xyz", shares([side[p] for p in places], box, shape)):
            side[f"c{a}"] = np.floor(share / 3.0).astype(np.int64) if not box else np.minimum(shape[f"n{a}"] - 1, np.floor((share - np.floor(share)) * shape[f"n{a}"])).astype(np.int64)
    names = [c for c in shape if c[0] != "n"]
    one |= {c: np.full(n, v) for c, v in shape.items()}
    left, right = pa.table({**one, "ref_cmp": made.integers(0, 60, n)}), pa.table({**many, "sel_cmp": made.integers(0, 50, n)})
    sizes, summed = [], near.summed
    monkeypatch.setattr(near, "summed", lambda keys: sizes.append(summed(keys)) or sizes[-1])
    whole = near.block_pairs(left, right, names, 3.0, "counts")
    ends, sizes[:] = len(sizes), []
    monkeypatch.setattr(near, "PART", 200)
    parts = near.block_pairs(left, right, names, 3.0, "counts")
    assert ends == 1 and len(sizes) > 2 and max(len(k) for k, _ in sizes) < 0.6 * len(whole)
    order = [(c, "ascending") for c in ("frame", "ref", "sel")]
    assert parts.combine_chunks().sort_by(order).equals(whole.combine_chunks().sort_by(order))
    block = near.Block({k: v for k, v in one.items()}, many, names, 3.0)
    i, j = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    i, j = i[one["frame"][:, None] == many["frame"]], j[one["frame"][:, None] == many["frame"]]
    d2 = least_squares_of_images(np.stack([many[a][j] - one[f"r{a}"][i] for a in "xyz"]), box, shape)
    assert sum(len(a) for a, _, _ in block.pairs()) == (np.sqrt(d2) <= 3.0).sum() == np.asarray(whole["n"]).sum() > 300
    _, low, high = block.ranges()
    assert len(names) == 6 or (high - low).sum() < (6 if box else 5) * (np.sqrt(d2) <= 3.0).sum()


def geometry_shape(box):
    if not box:
        return {}
    if len(box) == 3:
        return {**{f"n{a}": max(1, math.floor(v / 3.0)) for a, v in zip("xyz", box)}, **{f"l{a}": v for a, v in zip("xyz", box)}}
    (ax, bx, cx), by = (box[0], box[1] * math.cos(math.radians(box[5])), box[2] * math.cos(math.radians(box[4]))), box[1] * math.sin(math.radians(box[5]))
    cy = (box[1] * box[2] * math.cos(math.radians(box[3])) - bx * cx) / by
    cz = math.sqrt(box[2] ** 2 - cx * cx - cy * cy)
    m = np.array([[ax, 0, 0], [bx, by, 0], [cx, cy, cz]])
    heights = 1 / np.linalg.norm(np.linalg.inv(m), axis=0)
    return {**{f"n{a}": max(1, math.floor(h / 3.0)) for a, h in zip("xyz", heights)}, **{f"m{i}{k}": m[i, k] for i in range(3) for k in range(i + 1)}}


def shares(places, box, shape):
    if not box:
        return places
    if len(box) == 3:
        return [p / v for p, v in zip(places, box)]
    z = places[2] / shape["m22"]
    y = (places[1] - z * shape["m21"]) / shape["m11"]
    return [(places[0] - z * shape["m20"] - y * shape["m10"]) / shape["m00"], y, z]


def least_squares_of_images(d, box, shape):
    """Squares of the distances, by the steps that the queries' SQL has."""
    if box and len(box) == 3:
        d = np.stack([v - np.floor(v / length + 0.5) * length for v, length in zip(d, box)])
    elif box:
        ix, iy, iz = (np.floor(f + 0.5) for f in shares(d, box, shape))
        d = np.stack([d[0] - (ix * shape["m00"] + iy * shape["m10"] + iz * shape["m20"]), d[1] - (iy * shape["m11"] + iz * shape["m21"]), d[2] - iz * shape["m22"]])
    return (d * d).sum(0)


def test_sums_of_blocks(spark, monkeypatch):
    """What blocks sum, without a pair as a row, is what is made of the contacts; in several blocks and parts."""
    monkeypatch.setattr(contacts, "FEWEST", 9)
    sides = []
    for side, seed in (("ref", 1), ("sel", 5)):
        at = [(F.rand(seed + k) * 9).alias(a) for k, a in enumerate("xyz")]
        sides.append(spark.range(500).select((F.col("id") % 8).cast("int").alias("frame"), F.col("id").alias(side), (F.xxhash64("id", F.lit(seed)) % 13).alias("cmp"), *at).localCheckpoint())
    boxes = spark.range(8).select(F.col("id").cast("int").alias("frame"), *(F.lit(9.0).alias(f"l{a}") for a in "xyz"))
    plain = contacts.compound_counts(contacts.contact_pairs(*sides, 1.5, boxes, compound="cmp")).coalesce(1).localCheckpoint()
    made = lambda make, blocks="pairs", **options: contacts.compound_pairs(*sides, 1.5, boxes, make=make, blocks=blocks, **options).coalesce(1).localCheckpoint()
    refs = sides[0].select("frame", F.col("cmp").alias("ref")).distinct()
    levels = made("levels", "frames")
    assert rows(contacts.contact_hists(levels, refs)) == rows(contacts.contact_hists(plain, refs))
    assert rows(contacts.contact_averages(made("levels"), refs)) == rows(contacts.contact_averages(plain, refs))
    dtrj = refs.sparkSession.range(13 * 8).select((F.col("id") % 13 - 6).alias("cmp"), F.floor(F.col("id") / 13).cast("int").alias("frame"), (F.xxhash64("id") % 2).alias("state"))
    dtrj = dtrj.unionByName(dtrj.select((F.col("cmp") - 13).alias("cmp"), "frame", "state")).unionByName(dtrj.select((F.col("cmp") + 13).alias("cmp"), "frame", "state"))
    assert rows(events.contact_hists_at_moves(levels, refs, dtrj)) == rows(events.contact_hists_at_moves(plain, refs, dtrj))
    for n in (1, 2):
        assert rows(contacts.n_common_contacts(made("common", n_frames=n), n)) == rows(contacts.n_common_contacts(plain, n))
        assert rows(made("filled", intermittency=n, n_frames=8).drop("block")) == rows(repair.correct_contact_intermittency(plain, n, 8))
    meetings = made("meetings", apart=(1, 8))
    assert meetings.select("block").distinct().count() > 3
    assert rows(events.partner_numbers(meetings)) == rows(events.partner_numbers(plain))
    stats = lambda found: rows(found.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("mean", "var")}))
    assert stats(events.partner_stats(meetings)) == stats(events.partner_stats(plain))
    assert rows(events.shared_partners(meetings, 3)) == rows(events.shared_partners(plain, 3))
    assert rows(events.contacts_at_moves(made("meetings", apart=(3, 3)), dtrj, 1)) == rows(events.contacts_at_moves(plain, dtrj, 1))
    moves = events.block_transitions(dtrj, 1, 3)
    assert rows(events.contacts_at_block_transitions(meetings, moves)) == rows(events.contacts_at_block_transitions(plain, moves))
    history = events.block_transitions_with_history(dtrj, 1, 3)
    assert rows(events.partners_at_block_transitions(meetings, history)) == rows(events.partners_at_block_transitions(plain, history))
    assert rows(contacts.check_contacts(made("checks", "frames", n_frames=6, n_refs=5), 6, 5)) == rows(contacts.check_contacts(plain, 6, 5))


def test_few_blocks(spark, monkeypatch):
    """Blocks whose result is no more than particles are no more for more pairs, so that each particle is shuffled no more often; only for more particles than one holds."""
    side = spark.range(4000).select((F.col("id") % 2).cast("int").alias("frame"), *(F.lit(0).alias(c) for c in ("cx", "cy", "cz")))
    cell = ["frame", "cx", "cy", "cz"]
    monkeypatch.setattr(contacts, "BLOCK_PAIRS", 1000)
    assert contacts._blocks(side, side, cell, contacts.BLOCK_PAIRS)[0] > 30000
    assert contacts._few_blocks(side, side, cell, False) == (64, 2) == contacts._few_blocks(side, side, cell, True)
    monkeypatch.setattr(contacts, "HELD", 500)
    assert contacts._few_blocks(side, side, cell, False) == (256, 2)
    assert contacts._few_blocks(side, side, cell, True) == (128, 2)


def most_rows(spark):
    """The most rows that a step of the last query gave out."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    last = store.executionsList().last().executionId()
    values, found, nodes = store.executionMetrics(last), [], store.planGraph(last).allNodes()
    for metrics in (nodes.apply(k).metrics() for k in range(nodes.size())):
        for m in (metrics.apply(i) for i in range(metrics.size())):
            if m.name() in ("number of output rows", "shuffle records written") and values.contains(m.accumulatorId()):
                found.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return max(found)


@pytest.mark.parametrize("name, n", [("events_by_bin", 1), ("displacements_of_two_axes", 1), ("occupancy_by_bin", 1), ("previous_events", 70), ("renewal_events", 70), ("compound_contact_counts", 9800)])
def test_pairs_of_particles_are_no_rows(spark, tmp_path, name, n):
    """On two of four days 210 clicks meet 210 purchases each: no step of these queries has a row for each of the 88,200 pairs."""
    at = F.when((F.col("click") == 1) | F.col("day").isin(1, 2), 50.0).otherwise(300.0) + F.col("user_id") % 3
    days = spark.range(1680).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("day"), F.floor(F.col("id") / 4) % 2, F.floor(F.col("id") / 24).alias("user_id")).toDF("event_id", "day", "click", "user_id")
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 10:00:00")) + F.col("day") * 86400)
    table = days.select("event_id", ts.alias("ts"), "user_id", F.when(F.col("click") == 1, "click").otherwise("purchase").alias("event_type"), at.alias("value"), F.lit('{"k": 5}').alias("props"))
    table.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert len(registry.QUERIES[name](spark, str(tmp_path)).collect()) == n
    assert 1680 <= most_rows(spark) < 20_000
