"""Queries of the checks, and of writers and readers one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewalk.operators import states
from framewalk.plans.tables import EVENTS_SQL, boxes, dtrj, events, table
from framewalk.session import new_folder
from framewalk.sources import files, slicing

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- checks


@query(f"""WITH {EVENTS_SQL}, n AS (SELECT DISTINCT cmp, n FROM ev), l AS (SELECT cmp, n, unnest(range(0, n)) AS lag FROM n) SELECT cmp, CAST(lag AS INTEGER) AS lag, CAST(ceil((n - lag) / 7.0) AS INTEGER) AS starts FROM l""")
def n_restarts(spark, sf_dir):
    lengths = events(spark, sf_dir).groupBy("cmp").agg(F.count("*").alias("n"))
    return slicing.restarts_by_lag(lengths, ["cmp"], "n", 7)


@query("""
SELECT p_partkey, CAST(least(greatest(1, p_size), 20) AS INTEGER) AS blocks, CAST(20 // least(greatest(1, p_size), 20) AS INTEGER) AS frames,
       CAST(greatest(1, least(greatest(p_size, 3), 60) // 3) AS INTEGER) AS restart, CAST(greatest(least(p_size, 19) - least(p_size, 19) % 3, 3) AS INTEGER) AS lag
FROM part""")
def block_and_lag_checks(spark, sf_dir):
    size, n = F.col("p_size"), F.lit(20)
    blocks, frames = slicing.checked_blocks(size, n)
    made = {"blocks": blocks, "frames": frames, "restart": slicing.checked_restart(size, 3, n), "lag": slicing.checked_lag(size, 3, n)}
    return table(spark, sf_dir, "part").select("p_partkey", *(c.cast("int").alias(name) for name, c in made.items()))


@query("""
WITH r AS (SELECT p_type, greatest(min(p_retailprice), 905.0) AS a, least(max(p_retailprice), 1900.0) AS b FROM part GROUP BY p_type),
d AS (SELECT nation.n_nationkey, sqrt(6.0 * 6.0 + 8.0 * 8.0 + n_nationkey * n_nationkey) / 2 AS half FROM nation WHERE n_nationkey > 0)
SELECT 'num' AS kind, p_type AS name, round(a, 6) + 0.0 AS start, round(b, 6) + 0.0 AS stop, round((b - a) / 6, 6) + 0.0 AS step, 6 AS num FROM r
UNION ALL SELECT 'step', p_type, round(a, 6) + 0.0, round(a + least(70.0::DOUBLE, b - a) * floor((b - a) / least(70.0::DOUBLE, b - a)), 6) + 0.0, round(least(70.0::DOUBLE, b - a), 6) + 0.0, CAST(floor((b - a) / least(70.0::DOUBLE, b - a)) AS INTEGER) FROM r
UNION ALL SELECT 'distance', CAST(n_nationkey AS VARCHAR), 0.0, round(half, 6) + 0.0, round(half / 5, 6) + 0.0, 5 FROM d""")
def bin_checks(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    boxes_ = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.lit(6.0).alias("lx"), F.lit(8.0).alias("ly"), F.col("n_nationkey").cast("double").alias("lz"))
    each = [("num", slicing.bins_of(part.withColumnRenamed("p_type", "name"), ["name"], "p_retailprice", num=6, amin=905, amax=1900)), ("step", slicing.bins_of(part.withColumnRenamed("p_type", "name"), ["name"], "p_retailprice", step=70, amin=905, amax=1900)), ("distance", slicing.distance_bins_of(boxes_, ["name"], 5))]
    rows = [made.select(F.lit(kind).alias("kind"), "name", *((F.round(F.col(c), 6) + F.lit(0.0)).alias(c) for c in ("start", "stop", "step")), "num") for kind, made in each]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""
WITH e AS (SELECT p_brand, list_sort(list_distinct(list(p_size / 40.0::DOUBLE))) AS e FROM part GROUP BY p_brand),
a AS (SELECT p_brand, list_concat(list_concat([0.0::DOUBLE], list_filter(e, lambda x: x > 0 AND x < 1)), [1.000001::DOUBLE]) AS e FROM e)
SELECT p_brand, CAST(i - 1 AS INTEGER) AS i, e[i] AS edge FROM (SELECT p_brand, e, unnest(range(1, len(e) + 1)) AS i FROM a)""")
def bin_edge_checks(spark, sf_dir):
    edges = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size") / 40.0).alias("e"))  # at most as many as there are sizes
    return edges.select("p_brand", F.posexplode(slicing.bin_edges_of(F.col("e"))).alias("i", "edge"))


@query("SELECT count(*) AS n, count(CASE WHEN p_size = 13 THEN 1 END) AS missing, count(CASE WHEN p_size <> 13 AND p_retailprice < 950 THEN 1 END) AS not_positive FROM part")
def check_masses(spark, sf_dir):
    mass = F.when(F.col("p_size") != 13, F.when(F.col("p_retailprice") < 950, -1.0).otherwise(F.col("p_retailprice")))
    return slicing.check_masses(table(spark, sf_dir, "part").select(mass.alias("mass")))


@query("SELECT count(*) AS n, count(CASE WHEN p_size <= 5 THEN 1 END) AS bad_lengths, count(CASE WHEN p_size * 4 >= 180 THEN 1 END) AS bad_angles FROM part")
def check_boxes(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select((size - 5.0).alias("lx"), F.lit(1.0).alias("ly"), F.lit(1.0).alias("lz"), F.lit(90.0).alias("alpha"), F.lit(90.0).alias("beta"), (size * 4.0).alias("gamma"))
    return slicing.check_boxes(rows)


@query(f"WITH {EVENTS_SQL}, t AS (SELECT frame, min(x) AS t FROM ev GROUP BY frame), d AS (SELECT lead(t) OVER (ORDER BY frame) - t AS d FROM t) SELECT round(min(d) + 1e-9, 6) + 0.0 AS min_dt, round(max(d) + 1e-9, 6) + 0.0 AS max_dt FROM d")
def check_time_step(spark, sf_dir):
    frames = events(spark, sf_dir).groupBy("frame").agg(F.min("x").alias("time"))
    made = slicing.check_time_step(frames)
    return made.select(*((F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) for c in ("min_dt", "max_dt")))


@query("SELECT 'p_type' AS attribute, count(DISTINCT p_type) AS n_distinct FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part")
def describe_atoms(spark, sf_dir):
    return slicing.describe_atoms(table(spark, sf_dir, "part"), ["p_type", "p_size", "p_brand"])


# ---- selections


@query("SELECT p_partkey FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size = 1) ")
def select_same_as(spark, sf_dir):
    atoms = table(spark, sf_dir, "part")
    return files.same_as(atoms, atoms.where("p_size = 1"), ["p_type"]).select("p_partkey")


@query(f"""
WITH {EVENTS_SQL}, c AS (SELECT * FROM ev WHERE state = 1),
d AS (SELECT e.frame, e.event_id, min((e.x - c.x - floor((e.x - c.x) / 600 + 0.5) * 600) ** 2 + (e.y - c.y - floor((e.y - c.y) / 144 + 0.5) * 144) ** 2 + (e.z - c.z - floor((e.z - c.z) / 100 + 0.5) * 100) ** 2) AS d FROM ev e JOIN c ON e.frame = c.frame WHERE e.state <> 1 GROUP BY ALL)
SELECT frame, event_id AS atom_ix FROM d WHERE d <= 64""")
def select_around(spark, sf_dir):
    atoms = events(spark, sf_dir).select("frame", F.col("event_id").alias("atom_ix"), "x", "y", "z", "state")
    found = files.around(atoms, atoms.where("state = 1"), 8.0, boxes(spark, states.n_frames_of(atoms)))
    return found.select("frame", "atom_ix")


# ---- there and back


@query(f"WITH {EVENTS_SQL} SELECT CAST(state AS DOUBLE) AS var1, CAST(state2 AS DOUBLE) AS var2, CAST(count(*) AS DOUBLE) AS z FROM ev GROUP BY state, state2")
def matrix_there_and_back(spark, sf_dir):
    cells = events(spark, sf_dir).groupBy("state", "state2").agg(F.count("*").alias("z"))
    path = new_folder(spark, "matrix")
    files.write_matrix(cells, path, "state", "state2", "z")
    return files.read_matrix(spark, path).where("z is not null")


@query("SELECT CAST(p_partkey AS DOUBLE) AS k, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size FROM part")
def columns_there_and_back(spark, sf_dir):
    path = new_folder(spark, "columns")
    files.write_columns(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), path)
    return files.read_columns(spark, path, ["k", "price", "size"], "p_partkey")


@query(f"WITH {EVENTS_SQL} SELECT cmp, frame, CAST(state AS INTEGER) AS state FROM ev")
def dtrj_there_and_back(spark, sf_dir):
    path = new_folder(spark, "dtrj")
    files.write_dtrj(dtrj(spark, sf_dir), path)
    return spark.read.parquet(path)


@query(f"""WITH {EVENTS_SQL} SELECT frame, count(*) AS n_atoms, round(sum(round(x, 3)) + 1e-6, 2) + 0.0 AS sx, round(sum(round(z, 3)) + 1e-6, 2) + 0.0 AS sz, 600.0::DOUBLE AS lx, 100.0::DOUBLE AS lz, 75.0::DOUBLE AS beta FROM ev GROUP BY frame""")
def structures_there_and_back(spark, sf_dir):
    rows = events(spark, sf_dir)
    atoms = rows.select("frame", F.col("cmp").alias("atom_ix"), F.lit(1).alias("resid"), F.lit("SOL").alias("resname"), F.lit("OW").alias("name"), "x", "y", "z", *(F.lit(v).alias(c) for c, v in zip(("lx", "ly", "lz", "alpha", "beta", "gamma"), (600.0, 144.0, 100.0, 90.0, 75.0, 90.0))))
    path = new_folder(spark, "structures")
    files.write_gro(atoms, path)
    back = files.read_gro(spark, f"{path}/*/*.txt").withColumn("number", F.regexp_extract("path", "frame=([0-9]+)", 1).cast("int"))
    made = back.groupBy(F.col("number").alias("frame")).agg(F.count("*").alias("n_atoms"), F.sum("x").alias("sx"), F.sum("z").alias("sz"), *(F.max(c).alias(c) for c in ("lx", "lz", "beta")))
    return made.select("frame", "n_atoms", *((F.round(F.col(c) + 1e-6, 2) + 0.0).alias(c) for c in ("sx", "sz")), F.round("lx", 3).alias("lx"), F.round("lz", 3).alias("lz"), F.round("beta", 2).alias("beta"))
