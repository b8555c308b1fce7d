"""Queries that run a stream over a whole table to its end; their SQL is that of the operation in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewalk.operators import contacts, events
from framewalk.operators.contacts import AXES
from framewalk.plans import box_queries, space_queries
from framewalk.plans.space_queries import _RENEWALS, _day_positions, _user_counts, _user_runs
from framewalk.plans.tables import EVENTS_SQL, N_DAYS_SQL, RUNS_SQL, dtrj, n_days, particles
from framewalk.session import drop, kept
from framewalk.streaming import replay, runs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {EVENTS_SQL}, {RUNS_SQL} SELECT cmp, CAST(state AS INTEGER) AS state, t0, CAST(len AS INTEGER) AS len, is_first, is_last FROM runs")
def stream_runs(spark, sf_dir):
    stream, late = replay.in_order(dtrj(spark, sf_dir), "cmp")
    return replay.to_end(runs.stream_runs(stream, "ts", late)).where("cmp >= 0")


@query(box_queries.ORACLE_SQL["correct_intermittency"])
def stream_filled(spark, sf_dir):
    stream, late = replay.in_order(dtrj(spark, sf_dir), "cmp")
    return replay.to_end(runs.stream_filled(stream, 2, "ts", late)).where("cmp >= 0")


def _grid(spark, sf_dir):
    """(ref, frame) of all reference compounds and days."""
    refs = _user_counts(spark, sf_dir)[1].select("ref").distinct()
    return refs.select(F.col("ref").cast("long").alias("ref"), F.explode(F.sequence(F.lit(0), F.lit(n_days(spark, sf_dir) - 1))).alias("frame"))


@query(space_queries.ORACLE_SQL["renewal_events"])
def stream_renewals(spark, sf_dir):
    partners = _user_counts(spark, sf_dir)[0].groupBy("ref", "frame").agg(F.collect_set("sel").alias("sels"))
    stream, late = replay.in_order(_grid(spark, sf_dir).join(partners, ["ref", "frame"], "left"), "ref")
    return replay.to_end(runs.stream_renewals(stream, "ts", late)).where("ref >= 0 and not is_first and not is_last").select("ref", "sel", "t0", "trenew")


def _partner_positions(spark, sf_dir):
    """A position for each user and day with a purchase: that of the first."""
    first = F.min_by(F.struct(*AXES), "sel")
    return particles(spark, sf_dir)[1].groupBy("frame", F.col("cmp").alias("sel")).agg(first.alias("p")).select("frame", "sel", "p.*")


_PLACE = "SELECT frame, user_id AS cmp, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y, arg_min(z, event_id) AS z FROM pt WHERE event_type = '{}' GROUP BY ALL"
_MOVES = ", ".join(f"round({s}.{a} + 1e-7, 5) + 0.0 AS {k}_{a}0, round({e}.{a} - {s}.{a} + 1e-7, 5) + 0.0 AS {k}_d{a}" for k, s, e in (("ref", "r0", "r1"), ("sel", "s0", "s1")) for a in AXES)


@query(f"""{_RENEWALS}, rp AS ({_PLACE.format("click")}), sp AS ({_PLACE.format("purchase")})
SELECT n.ref, n.sel, CAST(n.t0 AS INTEGER) AS t0, CAST(n.stop - n.t0 AS INTEGER) AS trenew, {_MOVES}
FROM op o JOIN nx n ON n.ref = o.ref AND n.t0 = o.t0 JOIN rp r0 ON r0.cmp = n.ref AND r0.frame = n.t0 JOIN rp r1 ON r1.cmp = n.ref AND r1.frame = n.stop
JOIN sp s0 ON s0.cmp = n.sel AND s0.frame = n.t0 JOIN sp s1 ON s1.cmp = n.sel AND s1.frame = n.stop WHERE n.t0 > 0 AND n.stop < {N_DAYS_SQL}""")
def stream_renewal_moves(spark, sf_dir):
    """Two streaming queries: renewals with what is known when they come, then the join with the positions of their partners.

    Of the contacts those of the deciding runs are replayed: a few for each user and day, where all partners would be a row for each pair.  The stream's rule is
    that of all partners, and its renewals are the same.
    """
    places = _partner_positions(spark, sf_dir)
    runs_ = events.deciding_runs(_user_runs(spark, sf_dir, "longest"))
    pairs = contacts.contact_frames(runs_).join(places, ["sel", "frame"], "left")
    partners = pairs.groupBy("ref", "frame").agg(F.collect_list(F.struct("sel", *AXES)).alias("sels"))
    grid = particles(spark, sf_dir)[0].select(F.col("cmp").cast("long").alias("ref")).distinct().select("ref", F.explode(F.sequence(F.lit(0), F.lit(n_days(spark, sf_dir) - 1))).alias("frame"))
    rows = kept(grid.join(partners, ["ref", "frame"], "left").join(_day_positions(spark, sf_dir), ["ref", "frame"], "left"), "partners")
    stream, late = replay.in_order(rows, "ref")
    drop(rows)
    placed = runs.stream_placed_renewals(stream, "ts", late)
    renewals = spark.readStream.schema(placed.schema).parquet(replay.written(placed))
    made = replay.to_end(runs.with_partner_moves(renewals, replay.in_order(places, "sel")[0], late))
    return made.select("ref", "sel", "t0", "trenew", *((F.round(F.col(c) + 1e-7, 5) + F.lit(0.0)).alias(c) for c in made.columns if c[:3] in ("ref", "sel") and len(c) > 3))
