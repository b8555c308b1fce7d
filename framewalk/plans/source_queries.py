"""Queries of binary trajectories and of selections that need other rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewalk.operators import states
from framewalk.plans.tables import BOX, EVENTS_SQL, boxes, events
from framewalk.session import new_folder
from framewalk.sources import selection, xtc

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- binary trajectories


def _atoms(spark, sf_dir):
    rows = events(spark, sf_dir).select("frame", F.col("cmp").alias("atom_ix"), "x", "y", "z")
    return rows.join(boxes(spark, states.n_frames_of(rows)), "frame")


_XTC = f"""WITH {EVENTS_SQL}
SELECT CAST(row_number() OVER (PARTITION BY frame ORDER BY cmp) - 1 AS BIGINT) AS atom_ix, frame AS step, CAST(frame AS DOUBLE) AS time, {", ".join(f"round({a} + 1e-7, 3) + 0.0 AS {a}" for a in "xyz")}, {", ".join(f"{v}::DOUBLE AS l{a}" for a, v in zip("xyz", BOX))}, 90.0::DOUBLE AS alpha
FROM ev"""


def _columns(back):
    return back.select("atom_ix", "step", "time", *((F.round(F.col(a) + 1e-7, 3) + F.lit(0.0)).alias(a) for a in "xyz"), "lx", "ly", "lz", "alpha")


@query(_XTC)
def xtc_there_and_back(spark, sf_dir):
    """All atoms of all frames, written as packed frames and read again."""
    path = new_folder(spark, "xtc")
    xtc.write_xtc(_atoms(spark, sf_dir), path, frames=16)
    return _columns(xtc.read_xtc(spark, path))


@query(_XTC + " WHERE frame >= 20 AND frame < 40")
def xtc_frames(spark, sf_dir):
    """A range of steps: the other frames are not read."""
    path = new_folder(spark, "xtc")
    xtc.write_xtc(_atoms(spark, sf_dir), path, frames=16)
    return _columns(xtc.read_xtc(spark, path).where("step >= 20 and step < 40"))


# ---- selections


_AT = f"""WITH {EVENTS_SQL}, am AS (SELECT frame, cmp AS atom_ix, cmp // 5 AS resid, state, x, y, z FROM ev),
pr AS (SELECT a.frame, a.atom_ix, a.state, b.state AS bs, b.z AS bz, {" + ".join(f"(a.{c} - b.{c} - floor((a.{c} - b.{c}) / {v} + 0.5) * {v}) ** 2" for c, v in zip("xyz", BOX))} AS d2 FROM am a JOIN am b ON a.frame = b.frame)"""


def _selected(spark, sf_dir, text):
    atoms = events(spark, sf_dir).select("frame", F.col("cmp").alias("atom_ix"), F.floor(F.col("cmp") / 5).alias("resid"), "state", "x", "y", "z")
    return selection.select_atoms(atoms, text, boxes(spark, states.n_frames_of(atoms))).select("frame", "atom_ix")


@query(f"""{_AT},
a AS (SELECT DISTINCT frame, atom_ix FROM pr WHERE state <> 1 AND bs = 1 AND d2 <= 64),
s AS (SELECT DISTINCT frame, resid FROM am WHERE z > 95),
r AS (SELECT DISTINCT frame, resid FROM am WHERE x > 300),
n AS (SELECT DISTINCT frame, atom_ix FROM pr WHERE bz < 3 AND d2 <= 400)
SELECT frame, atom_ix FROM am
WHERE (frame, atom_ix) IN (SELECT frame, atom_ix FROM a) AND (frame, resid) NOT IN (SELECT frame, resid FROM s)
   OR (frame, resid) IN (SELECT frame, resid FROM r) AND z >= 3 AND (frame, atom_ix) NOT IN (SELECT frame, atom_ix FROM n)""")
def select_nested(spark, sf_dir):
    return _selected(spark, sf_dir, "(around 8 prop state == 1) and not (same resid as prop z > 95) or (byres prop x > 300) and not ((around 20 prop z < 3) or prop z < 3)")


_FROM = "{0} - c{0} - floor(({0} - c{0}) / {1} + 0.5) * {1}"


@query(f"""{_AT},
c2 AS (SELECT frame, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM am WHERE state = 2 GROUP BY frame),
c3 AS (SELECT frame, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM am WHERE state = 3 AND z > 20 GROUP BY frame),
l AS (SELECT frame, atom_ix FROM (SELECT frame, atom_ix, {" + ".join(f"({_FROM.format(a, v)}) ** 2" for a, v in zip("xyz", BOX))} AS d2 FROM am JOIN c2 USING (frame)) WHERE d2 <= 1600 AND d2 > 400),
y AS (SELECT frame, atom_ix FROM (SELECT frame, atom_ix, {" + ".join(f"({_FROM.format(a, v)}) ** 2" for a, v in zip("xy", BOX))} AS d2, {_FROM.format("z", BOX[2])} AS dz FROM am JOIN c3 USING (frame)) WHERE d2 <= 900 AND dz BETWEEN -10 AND 15),
i AS (SELECT frame, atom_ix FROM pr WHERE bs = 1 AND state <> 1 GROUP BY frame, atom_ix HAVING min(d2) <= 225 AND min(d2) > 36)
SELECT frame, atom_ix FROM am WHERE (frame, atom_ix) IN (SELECT frame, atom_ix FROM l) OR (frame, atom_ix) IN (SELECT frame, atom_ix FROM y) OR (frame, atom_ix) IN (SELECT frame, atom_ix FROM i)""")
def select_layers(spark, sf_dir):
    return _selected(spark, sf_dir, "(sphlayer 20 40 prop state == 2) or (cyzone 30 15 -10 (prop state == 3 and prop z > 20)) or (isolayer 6 15 prop state == 1)")
