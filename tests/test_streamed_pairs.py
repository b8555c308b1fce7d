"""Pairs of particles that leave their blocks as they are found, and what is summed in blocks without them."""

import pytest
from conftest import SF
from helpers import rows
from pyspark.sql import functions as F

from framewalk.operators import contacts, events, near
from framewalk.plans import registry
from framewalk.streaming import replay, runs


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def shuffled(spark, since):
    """The rows shuffled by all queries after the first so many."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    new = executions(spark) - since
    for e in (store.executionsList(since, new).apply(k).executionId() for k in range(new)):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for metrics in (nodes.apply(k).metrics() for k in range(nodes.size())):
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if m.name() == "shuffle records written" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """A folder of events: on each of four days 210 clicks of 70 users are at the place of 210 purchases of theirs, 44,100 contacts a day of 4,900 pairs of users."""
    folder = tmp_path_factory.mktemp("crowd")
    days = spark.range(1680).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("day"), F.floor(F.col("id") / 4) % 2, F.floor(F.col("id") / 24).alias("user_id")).toDF("event_id", "day", "click", "user_id")
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 10:00:00")) + F.col("day") * 86400)
    table = days.select("event_id", ts.alias("ts"), "user_id", F.when(F.col("click") == 1, "click").otherwise("purchase").alias("event_type"), (50.0 + F.col("user_id") % 3).alias("value"), F.lit('{"k": 5}').alias("props"))
    table.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


BOXES = [None, (12.0, 12.0, 12.0), (10.0, 7.0, 3.5), (12.0, 13.0, 14.0, 80.0, 75.0, 70.0), (60.0, 11.0, 8.0, 80.0, 75.0, 70.0)]


def two_sides(spark, n=400):
    """Particles of six frames, with one place and some compounds unknown; numbers of one side are texts."""
    sides = []
    for side, seed in (("ref", 1), ("sel", 5)):
        at = [((F.rand(seed + k) - 0.3) * 20).alias(a) for k, a in enumerate("xyz")]
        at[0] = F.when(F.col("id") == 7, F.lit(None)).otherwise(at[0]).alias("x")
        number = F.col("id") if side == "ref" else F.concat(F.lit("p"), F.col("id").cast("string"))
        sides.append(spark.range(n).select((F.col("id") % 6 + F.when(F.col("id") % 6 > 3, 2).otherwise(0)).cast("int").alias("frame"), number.alias(side), F.when(F.col("id") % 17 > 0, F.col("id") % 11).alias("cmp"), *at).localCheckpoint())
    return sides


def boxes_of(spark, box):
    names = ("lx", "ly", "lz", "alpha", "beta", "gamma")
    return spark.createDataFrame([(f, *box) for f in range(8)], "frame int, " + ", ".join(f"{c} double" for c in names[: len(box)])) if box else None


@pytest.mark.parametrize("held", [10_000, 20])
@pytest.mark.parametrize("box", BOXES)
def test_particle_pairs(spark, box, held, monkeypatch):
    """Pairs found in blocks, of whole frames and of parts of them, are those of the join."""
    monkeypatch.setattr(contacts, "FEWEST", 3)
    monkeypatch.setattr(contacts, "HELD", held)
    monkeypatch.setattr(near, "ROWS", 50)
    sides, boxes = two_sides(spark), boxes_of(spark, box)
    made, plain = contacts.particle_pairs(*sides, 3.0, boxes), contacts.contact_pairs(*sides, 3.0, boxes)
    assert made.dtypes == plain.dtypes
    assert rows(made) == rows(plain)
    assert made.count() > 100
    assert rows(contacts.particle_pairs(sides[0].where("frame > 90"), sides[1], 3.0, boxes)) == []


def test_skewed_pairs_shuffle_particles(spark):
    """Particles are shuffled a few times, not once for each of the 27 cells around one."""
    n = spark.read.parquet(f"{SF}/events.parquet").where("event_type in ('click', 'purchase')").count()
    made = registry.QUERIES["contact_pairs_skewed"](spark, SF)
    since = executions(spark)
    made.collect()
    assert n <= shuffled(spark, since) <= 4 * n


@pytest.mark.parametrize("most", [None, 2])
def test_lags_of_blocks(spark, most, monkeypatch):
    """Lags that blocks sum from runs, part by part, are those of all contacts."""
    monkeypatch.setattr(contacts, "FEWEST", 4)
    sides, boxes = two_sides(spark), boxes_of(spark, BOXES[1])
    plain = contacts.compound_counts(contacts.contact_pairs(*sides, 3.0, boxes, compound="cmp")).localCheckpoint()
    lags = contacts.compound_pairs(*sides, 3.0, boxes, make="lags", max_lag=most)
    made, wanted = (contacts.autocorrelation(m, ["ref", "sel"], 8, max_lag=most) for m in (lags, plain.dropna()))
    known = contacts.autocorrelation(contacts.compound_pairs(*(s.dropna(subset=["cmp"]) for s in sides), 3.0, boxes, make="lags", max_lag=most), ["ref", "sel"], 8, max_lag=most)
    assert rows(known) == rows(wanted)
    assert sum(r["n_both"] for r in known.collect()) > 50
    assert made.where("n_start is null").isEmpty()
    with pytest.raises(ValueError):
        contacts.autocorrelation(lags, ["ref", "sel"], 8, 2)


def test_autocorr_bound_shuffles_no_pairs(spark, crowd, monkeypatch):
    """The 19,600 pairs of users and days stay in their blocks; the particles, counted and dealt out, leave them."""
    monkeypatch.setattr(contacts, "FEWEST", 1)
    since = executions(spark)
    made = registry.QUERIES["autocorr_bound"](spark, crowd).orderBy("lag").collect()
    assert [(r["lag"], r["n_both"], r["n_start"], r["acf"]) for r in made] == [(0, 0, 0, 1.0), *((k, 4900 * (4 - k), 4900 * min(3, 4 - k), 1.0) for k in (1, 2, 3))]
    assert 1680 <= shuffled(spark, since) < 5000


def test_deciding_runs_renew_alike(spark):
    """With the partners of deciding runs alone, the rule of the stream renews at the same frames with the same partners."""
    made = spark.range(4 * 9 * 14).select((F.col("id") % 4).alias("ref"), (F.floor(F.col("id") / 4) % 9).alias("sel"), F.floor(F.col("id") / 36).cast("int").alias("frame")).where(F.xxhash64("ref", "sel", F.floor(F.col("frame") * 0.7), F.lit(3)) % 5 == 0).localCheckpoint()
    few = contacts.contact_frames(events.deciding_runs(made)).localCheckpoint()
    assert few.count() < made.count()

    def renewals(of):
        here, out = {}, []
        for r in of.collect():
            here.setdefault((r["ref"], r["frame"]), set()).add(r["sel"])
        for ref in range(4):
            t0, left = -1, set()
            for frame in range(15):
                began = t0
                t0, left, ended = runs.renewed(t0, left, frame, here.get((ref, frame), set()))
                if ended is not None:
                    out.append((ref, ended, began, frame))
        return out

    assert renewals(few) == renewals(made)
    assert len(renewals(made)) > 12


def test_few_partners_are_replayed(spark, crowd, monkeypatch):
    """Of 19,600 partners on all days the stream gets one a user and day."""

    class Seen(Exception):
        pass

    def in_order(rows, key):
        raise Seen(rows.agg(F.sum(F.size("sels"))).first()[0], rows.count())

    monkeypatch.setattr(replay, "in_order", in_order)
    with pytest.raises(Seen) as seen:
        registry.QUERIES["stream_renewal_moves"](spark, crowd)
    assert seen.value.args == (280, 280)


@pytest.mark.parametrize("part", [1 << 20, 3])
@pytest.mark.parametrize("box", [BOXES[1], BOXES[3]])
def test_all_levels(spark, box, part, monkeypatch):
    """Levels summed in blocks, in many parts and with particles that are there twice, are those of the joined contacts."""
    monkeypatch.setattr(contacts, "FEWEST", 3)
    monkeypatch.setattr(near, "PART", part)
    ref, sel = two_sides(spark, 200)
    sel, boxes = sel.withColumn("sel", F.substring("sel", 2, 9).cast("long")), boxes_of(spark, box)
    for again in (ref.limit(0), ref.where("ref % 10 = 3")):
        sides = ref.unionByName(again), sel
        made, plain = contacts.all_levels(*sides, 3.0, boxes), contacts.contact_counts_all_levels(contacts.contact_pairs(*sides, 3.0, boxes, compound="cmp"))
        assert made.dtypes == plain.dtypes
        assert rows(made) == rows(plain)


def test_levels_shuffle_no_contacts(spark, crowd, monkeypatch):
    """The 176,400 contacts on four days are no rows of a shuffle, nor are their sums, and particles are not shuffled more often for more contacts."""
    for name in ("PAIRS", "BLOCK_PAIRS"):
        monkeypatch.setattr(contacts, name, 1000)
    made = registry.QUERIES["contact_counts_all_levels"](spark, crowd)
    since = executions(spark)
    found = {r["level"]: (r["k"], r["n"]) for r in made.groupBy("level").agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}
    assert found == {"atm-atm": (176_400, 176_400), "atm-cmp": (58_800, 176_400), "cmp-atm": (58_800, 176_400), "cmp-cmp": (19_600, 176_400)}
    assert 1680 <= shuffled(spark, since) < 8000
