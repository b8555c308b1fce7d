"""The driver's tables in the forms that the operators take, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Box of the positions made of events.
BOX = (600.0, 144.0, 100.0)
#: Frames of the contact tables, in SQL: days from the first one up to the last that has an event.
N_DAYS_SQL = "(SELECT max(frame) + 1 FROM pt)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cmp, frame, state, state2, x, y, z, event_id): a user's events in order; users differ in their number."""
    rows = table(spark, sf_dir, "events")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    state = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 3).otherwise(-1)
    made = rows.select(
        F.col("user_id").alias("cmp"), number.cast("int").alias("frame"), state.alias("state"), F.least(F.lit(3), F.floor(F.col("value") / 25)).cast("int").alias("state2"),
        F.col("value").alias("x"), ((F.hour("ts") * 60 + F.minute("ts")) / 10).alias("y"), F.get_json_object("props", "$.k").cast("double").alias("z"), "event_id",
    )
    return made


EVENTS_SQL = """
ev AS (
    SELECT user_id AS cmp, count(*) OVER (PARTITION BY user_id) AS n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame,
           CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE -1 END AS state,
           CAST(least(3, floor(value / 25)) AS INTEGER) AS state2,
           value AS x, (hour(ts) * 60 + minute(ts)) / 10.0::DOUBLE AS y, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS z, event_id
    FROM events),
fr AS (SELECT unnest(range(0, (SELECT max(frame) + 1 FROM ev))) AS t)"""

RUNS_SQL = """
rc AS (SELECT *, CASE WHEN state <> lag(state) OVER w THEN 1 ELSE 0 END AS chg FROM ev WINDOW w AS (PARTITION BY cmp ORDER BY frame)),
ri AS (SELECT *, sum(chg) OVER (PARTITION BY cmp ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM rc),
rr AS (SELECT cmp, run, state, min(frame) AS t0, count(*) AS len FROM ri GROUP BY cmp, run, state),
runs AS (
  SELECT *, lag(run) OVER q IS NULL AS is_first, lead(run) OVER q IS NULL AS is_last, lead(state) OVER q AS nxt, lead(state, 2) OVER q AS nxt2,
         lead(t0) OVER q AS nxt_t0, lead(t0, 2) OVER q AS nxt2_t0, lead(t0) OVER (PARTITION BY cmp, state ORDER BY run) AS same_t0
  FROM rr WINDOW q AS (PARTITION BY cmp ORDER BY run))"""


def dtrj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("cmp", "frame", "state")


def dtrj2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("cmp", "frame", F.col("state2").alias("state"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("cmp", "frame", "x", "y", "z")


def boxes(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("frame"), *(F.lit(v).alias(f"l{a}") for a, v in zip("xyz", BOX)))


def n_days(spark: SparkSession, sf_dir: str) -> int:
    """Frames of the contact tables."""
    frame = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    return (table(spark, sf_dir, "events").agg(F.max(frame)).first()[0] or 0) + 1


def boxes_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for every day from the first to the last that has an event."""
    frame = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    low, high = table(spark, sf_dir, "events").agg(F.min(frame), F.max(frame)).first()
    return spark.range(low or 0, (high or 0) + 1).select(F.col("id").cast("int").alias("frame"), *(F.lit(v).alias(f"l{a}") for a, v in zip("xyz", BOX)))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, x): the values of a user's events."""
    return events(spark, sf_dir).select(F.col("cmp").alias("id"), F.col("frame").alias("t"), "x")


def particles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference (clicks) and selection particles (purchases) by day, at the events' positions."""
    rows = table(spark, sf_dir, "events")
    frame = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    made = rows.select(frame.alias("frame"), "event_type", "event_id", "user_id", F.col("value").alias("x"), ((F.hour("ts") * 60 + F.minute("ts")) / 10).alias("y"), F.get_json_object("props", "$.k").cast("double").alias("z"))
    ref = made.where("event_type = 'click'").select("frame", F.col("event_id").alias("ref"), "x", "y", "z", F.col("user_id").alias("cmp"))
    sel = made.where("event_type = 'purchase'").select("frame", F.col("event_id").alias("sel"), "x", "y", "z", F.col("user_id").alias("cmp"))
    return ref, sel


#: Cutoff of the contact queries.
CUTOFF = 12.0

CONTACTS_SQL = f"""
pt AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS frame, event_type, event_id, user_id, value AS x,
         (hour(ts) * 60 + minute(ts)) / 10.0::DOUBLE AS y, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS z
  FROM events),
pairs AS (
  SELECT a.frame, a.event_id AS ref, b.event_id AS sel, a.user_id AS rc, b.user_id AS sc, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz
  FROM pt a JOIN pt b ON a.frame = b.frame AND a.event_type = 'click' AND b.event_type = 'purchase'),
dist AS (
  SELECT frame, ref, sel, rc, sc, sqrt((dx - floor(dx / {BOX[0]} + 0.5) * {BOX[0]}) ** 2 + (dy - floor(dy / {BOX[1]} + 0.5) * {BOX[1]}) ** 2 + (dz - floor(dz / {BOX[2]} + 0.5) * {BOX[2]}) ** 2) AS dist
  FROM pairs),
con AS (SELECT * FROM dist WHERE dist <= {CUTOFF})"""
