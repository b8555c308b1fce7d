"""Queries of what takes skewed or changing boxes, of unwrapping, and of sites and axes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framewalk.functions import geometry
from framewalk.operators import binning, contacts, dynamics, events, repair, states
from framewalk.plans.space_queries import _RENEWALS, _USERS, MATRIX, _day_positions, _matrix, _round, _spread, _tie, _user_counts, _user_runs, _xyz
from framewalk.plans.tables import BOX, CONTACTS_SQL, CUTOFF, EVENTS_SQL, N_DAYS_SQL, boxes, n_days, particles, positions, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A skewed box, and its vectors (a along x, b in the xy plane).
SKEW = (60.0, 40.0, 50.0, 80.0, 75.0, 70.0)


def _vectors() -> list[list[float]]:
    a, b, c, al, be, ga = (*SKEW[:3], *map(math.radians, SKEW[3:]))
    y = (math.cos(al) - math.cos(be) * math.cos(ga)) / math.sin(ga)
    return [[a, 0.0, 0.0], [b * math.cos(ga), b * math.sin(ga), 0.0], [c * math.cos(be), c * y, c * math.sqrt(1 - math.cos(be) ** 2 - y * y)]]


V = _vectors()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _skewed(spark, n: int):
    names = ("lx", "ly", "lz", "alpha", "beta", "gamma")
    return spark.range(n).select(F.col("id").cast("int").alias("frame"), *(F.lit(v).alias(c) for c, v in zip(names, SKEW)))


def _fractions(x: str, y: str, z: str) -> tuple[str, str, str]:
    """Box coordinates of a vector in SQL."""
    fz = f"(({z}) / {V[2][2]!r})"
    fy = f"((({y}) - {fz} * {V[2][1]!r}) / {V[1][1]!r})"
    return f"((({x}) - {fz} * {V[2][0]!r} - {fy} * {V[1][0]!r}) / {V[0][0]!r})", fy, fz


def _shifted(x: str, y: str, z: str, images: tuple[str, str, str]) -> tuple[str, str, str]:
    """A vector less so many box vectors, in SQL."""
    return tuple(f"({p}) - " + " - ".join(f"{n} * {V[i][k]!r}" for i, n in enumerate(images)) for k, p in enumerate((x, y, z)))


_AT = "least(3, floor(value / 25))"

# ---- volumes and vectors


@query("SELECT p_partkey, round((p_size + 1.0::DOUBLE) * (p_size + 2.0::DOUBLE) * p_retailprice, 4) + 0.0 AS volume FROM part")
def volume(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", _round(geometry.volume((size + 1.0, size + 2.0, F.col("p_retailprice"))), 4).alias("volume"))


@query(f"""WITH {EVENTS_SQL}, q AS (SELECT event_id, x / 100 AS a, y / 50 AS b, z / 80 AS c FROM ev)
SELECT event_id, {", ".join(f"round(a * {MATRIX[0][k]} + b * {MATRIX[1][k]} + c * {MATRIX[2][k]}, 6) + 0.0 AS {n}" for k, n in enumerate(("cx", "cy", "cz")))} FROM q""")
def box2cart(spark, sf_dir):
    rows = _spread(spark, sf_dir).select("event_id", ((F.col("px") + 500) / 300).alias("a"), ((F.col("py") + 100) / 100).alias("b"), ((F.col("pz") + 150) / 320).alias("c"))
    made = geometry.box2cart(_xyz("a", "b", "c"), _matrix())
    return rows.select("event_id", *(_round(x).alias(n) for x, n in zip(made, ("cx", "cy", "cz"))))


# ---- centres and whole compounds


@query("SELECT l_orderkey, round(sum(q * l_quantity) / nullif(sum(q), 0) + 1e-8, 6) + 0.0 AS x, round(sum(q * l_extendedprice) / nullif(sum(q), 0) + 1e-8, 5) + 0.0 AS y FROM (SELECT *, l_linenumber - 2.5::DOUBLE AS q FROM lineitem) GROUP BY l_orderkey")
def center_of_charge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.lit(0.0).alias("z"), (F.col("l_linenumber") - 2.5).alias("q"))
    made = dynamics.centers(rows, ["l_orderkey"], F.col("q"))
    return made.select("l_orderkey", _tie(F.col("x"), 6).alias("x"), _tie(F.col("y"), 5).alias("y"))


_BOX = (300.0, 72.0, 50.0)
_NEAR = ", ".join(f"f{a} + ({a} - f{a}) - floor(({a} - f{a}) / {b} + 0.5) * {b} AS {a}" for a, b in zip("xyz", _BOX))
_WHOLE = f"""
{EVENTS_SQL},
fi AS (SELECT *, cmp % 7 AS g, {", ".join(f"first_value({a}) OVER (PARTITION BY frame, cmp % 7 ORDER BY cmp) AS f{a}" for a in "xyz")} FROM ev),
wh AS (SELECT cmp, frame, g, {_NEAR} FROM fi)"""


def _groups(spark, sf_dir):
    rows = positions(spark, sf_dir).withColumn("g", F.col("cmp") % 7)
    box = boxes(spark, states.n_frames_of(rows)).select("frame", *(F.lit(v).alias(f"l{a}") for a, v in zip("xyz", _BOX)))
    return rows, box


@query(f"WITH {_WHOLE} SELECT cmp, frame, round(x + 1e-9, 6) + 0.0 AS x, round(y + 1e-9, 6) + 0.0 AS y, round(z + 1e-9, 6) + 0.0 AS z FROM wh")
def make_whole(spark, sf_dir):
    rows, box = _groups(spark, sf_dir)
    return dynamics.make_whole(rows, box, "g", "cmp").select("cmp", "frame", *(_round(F.col(a) + 1e-9).alias(a) for a in "xyz"))


@query(f"""WITH {_WHOLE}, c AS (SELECT frame, g, {", ".join(f"avg({a}) AS c{a}" for a in "xyz")} FROM wh GROUP BY ALL)
SELECT w.cmp, w.frame, {", ".join(f"round({a} - {b} * floor(c{a} / {b}) + 1e-9, 5) + 0.0 AS {a}" for a, b in zip("xyz", _BOX))} FROM wh w JOIN c ON w.frame = c.frame AND w.g = c.g""")
def make_whole_around_center(spark, sf_dir):
    rows, box = _groups(spark, sf_dir)
    return dynamics.make_whole(rows, box, "g", "cmp", "cog").select("cmp", "frame", *(_round(F.col(a) + 1e-9, 5).alias(a) for a in "xyz"))


@query(f"""WITH {_WHOLE}, c AS (SELECT frame, g, {", ".join(f"avg({a}) AS {a}" for a in "xyz")} FROM wh GROUP BY ALL)
SELECT frame, g, {", ".join(f"round({a} - {b} * floor({a} / {b}) + 1e-9, 5) + 0.0 AS {a}" for a, b in zip("xyz", _BOX))} FROM c""")
def center_of_whole_compounds(spark, sf_dir):
    rows, box = _groups(spark, sf_dir)
    made = dynamics.centers(rows, ["frame", "g"], boxes=box, whole="cmp", wrapped=True)
    return made.select("frame", "g", *(_round(F.col(a) + 1e-9, 5).alias(a) for a in "xyz"))


# ---- skewed boxes


_F = _fractions("x", "y", "z")
_W = _shifted("x", "y", "z", tuple(f"floor({f})" for f in _F))


@query(f"WITH {EVENTS_SQL} SELECT cmp, frame, {', '.join(f'round({w} + 1e-9, 6) + 0.0 AS {a}' for a, w in zip('xyz', _W))} FROM ev")
def wrap_skewed(spark, sf_dir):
    rows = positions(spark, sf_dir)
    made = dynamics.wrap(rows, _skewed(spark, states.n_frames_of(rows)))
    return made.select("cmp", "frame", *(_round(F.col(a) + 1e-9).alias(a) for a in "xyz"))


_SKEW_STEPS = f"""
{EVENTS_SQL}, wr AS (SELECT cmp, frame, {', '.join(f'{w} AS {a}' for a, w in zip('xyz', _W))} FROM ev),
fr_ AS (SELECT *, {', '.join(f'{f} AS f{a}' for a, f in zip('xyz', _F))} FROM wr),
st AS (SELECT cmp, frame, x, y, z, {', '.join(f'coalesce(floor(f{a} - lag(f{a}) OVER w + 0.5), 0) AS s{a}' for a in 'xyz')} FROM fr_ WINDOW w AS (PARTITION BY cmp ORDER BY frame)),
su AS (SELECT cmp, frame, x, y, z, {', '.join(f'sum(s{a}) OVER (PARTITION BY cmp ORDER BY frame ROWS UNBOUNDED PRECEDING) AS n{a}' for a in 'xyz')} FROM st)"""
_UNSKEWED = f"WITH {_SKEW_STEPS} SELECT cmp, frame, {', '.join(f'round({w} + 1e-9, 4) + 0.0 AS {a}' for a, w in zip('xyz', _shifted('x', 'y', 'z', ('nx', 'ny', 'nz'))))} FROM su"


def _unskewed(spark, sf_dir, method: str):
    rows = positions(spark, sf_dir)
    box = _skewed(spark, states.n_frames_of(rows))
    made = dynamics.unwrap(dynamics.wrap(rows, box), box, "cmp", method)
    return made.select("cmp", "frame", *(_round(F.col(a) + 1e-9, 4).alias(a) for a in "xyz"))


@query(_UNSKEWED)
def unwrap_skewed(spark, sf_dir):
    return _unskewed(spark, sf_dir, "scaling")


@query(_UNSKEWED)
def unwrap_skewed_displacement(spark, sf_dir):
    return _unskewed(spark, sf_dir, "displacement")


_D = ("b.x - a.x", "b.y - a.y", "b.z - a.z")
_DI = _shifted(*_D, tuple(f"floor({f} + 0.5)" for f in _fractions(*_D)))


@query(f"""WITH {CONTACTS_SQL}, d AS (
  SELECT a.frame, a.event_id AS ref, b.event_id AS sel, sqrt({' + '.join(f'({x}) ** 2' for x in _DI)}) AS dist
  FROM pt a JOIN pt b ON a.frame = b.frame AND a.event_type = 'click' AND b.event_type = 'purchase')
SELECT frame, ref, sel, round(dist, 6) + 0.0 AS dist FROM d WHERE dist <= {CUTOFF}""")
def contact_pairs_skewed(spark, sf_dir):
    made = contacts.particle_pairs(*particles(spark, sf_dir), CUTOFF, _skewed(spark, n_days(spark, sf_dir)))
    return made.withColumn("dist", F.floor(F.col("dist") * 1e6 + 0.5) / 1e6)  # round() goes through decimals, a microsecond each


@query(f"""
WITH {EVENTS_SQL}, r AS (SELECT cmp, x AS rx, y AS ry, z AS rz FROM ev WHERE frame = 0), d AS (SELECT frame, x - rx AS dx, y - ry AS dy, z - rz AS dz FROM ev JOIN r ON ev.cmp = r.cmp),
i AS (SELECT frame, {', '.join(f'{x} AS d{a}' for a, x in zip('xyz', _shifted('dx', 'dy', 'dz', tuple(f'floor({f} + 0.5)' for f in _fractions('dx', 'dy', 'dz')))))} FROM d)
SELECT frame, count(*) AS n, {', '.join(f'round(avg(d{a} ** 2), 5) + 0.0 AS msd_{a}' for a in 'xyz')}, round(sqrt(avg(dx ** 2) + avg(dy ** 2) + avg(dz ** 2)), 5) + 0.0 AS rmsd FROM i GROUP BY frame""")
def rmsd_skewed(spark, sf_dir):
    rows = positions(spark, sf_dir)
    made = dynamics.rmsd_vs_time(rows, "cmp", 0, boxes=_skewed(spark, states.n_frames_of(rows)))
    return made.select("frame", "n", *(_round(F.col(c), 5).alias(c) for c in ("msd_x", "msd_y", "msd_z", "rmsd")))


# ---- unwrapping in boxes that change


_L = {"x": "(60.013::DOUBLE + frame % 3)", "y": "(14.37::DOUBLE + 0.11::DOUBLE * (frame % 5))", "z": "(10.013::DOUBLE + 0.25::DOUBLE * (frame % 2))"}
_WR = f"{EVENTS_SQL}, wr AS (SELECT cmp, frame, {', '.join(f'{a} - {b} * floor({a} / {b}) AS {a}, {b}::DOUBLE AS l{a}' for a, b in _L.items())} FROM ev)"


def _changing(spark, n: int):
    f = F.col("frame")
    rows = spark.range(n).select(F.col("id").cast("int").alias("frame"))
    return rows.select("frame", (60.013 + f % 3).alias("lx"), (14.37 + 0.11 * (f % 5)).alias("ly"), (10.013 + 0.25 * (f % 2)).alias("lz"))


def _unwrapped(spark, sf_dir, method: str):
    rows = positions(spark, sf_dir)
    box = _changing(spark, states.n_frames_of(rows))
    made = dynamics.unwrap(dynamics.wrap(rows, box), box, "cmp", method)
    return made.select("cmp", "frame", *(_round(F.col(a) + 1e-9, 4).alias(a) for a in "xyz"))


def _recursive(step) -> str:
    return f"""
WITH RECURSIVE {_WR},
pairs_ AS (SELECT b.cmp, b.frame, {', '.join(f'a.{x} AS {x}0, b.{x} AS {x}, a.l{x} AS l{x}0, b.l{x} AS l{x}' for x in 'xyz')} FROM wr a JOIN wr b ON a.cmp = b.cmp AND b.frame = a.frame + 1),
un AS (
  SELECT cmp, frame, x AS ux, y AS uy, z AS uz FROM wr WHERE frame = 0
  UNION ALL
  SELECT p.cmp, p.frame, {', '.join(step(x) for x in 'xyz')} FROM un u JOIN pairs_ p ON p.cmp = u.cmp AND p.frame = u.frame + 1)
SELECT cmp, frame, round(ux + 1e-9, 4) + 0.0 AS x, round(uy + 1e-9, 4) + 0.0 AS y, round(uz + 1e-9, 4) + 0.0 AS z FROM un"""


@query(_recursive(lambda x: f"u.u{x} + (p.{x} - p.{x}0) - p.l{x} * floor((p.{x} - p.{x}0) / p.l{x} + 0.5) - floor((p.{x}0 - u.u{x}) / p.l{x}0 + 0.5) * (p.l{x} - p.l{x}0)"))
def unwrap_hybrid(spark, sf_dir):
    return _unwrapped(spark, sf_dir, "hybrid")


@query(_recursive(lambda x: f"p.{x} - p.l{x} * floor((p.{x} - u.u{x}) / p.l{x} + 0.5)"))
def unwrap_heuristic(spark, sf_dir):
    return _unwrapped(spark, sf_dir, "heuristic")


def _summed(step) -> str:
    steps = ", ".join(f"coalesce({step(a)}, 0) AS s{a}" for a in "xyz")
    return f"""WITH {_WR}, st AS (SELECT cmp, frame, {', '.join(f'first_value({a}) OVER w AS f{a}' for a in 'xyz')}, {steps} FROM wr WINDOW w AS (PARTITION BY cmp ORDER BY frame))
SELECT cmp, frame, {', '.join(f'round(f{a} + sum(s{a}) OVER u + 1e-9, 4) + 0.0 AS {a}' for a in 'xyz')} FROM st WINDOW u AS (PARTITION BY cmp ORDER BY frame ROWS UNBOUNDED PRECEDING)"""


@query(_summed(lambda a: f"({a} - lag({a}) OVER w) - l{a} * floor(({a} - lag({a}) OVER w) / l{a} + 0.5)"))
def unwrap_displacement(spark, sf_dir):
    return _unwrapped(spark, sf_dir, "displacement")


@query(_summed(lambda a: f"{a} - l{a} * lag({a}) OVER w / lag(l{a}) OVER w - l{a} * floor({a} / l{a} - lag({a}) OVER w / lag(l{a}) OVER w + 0.5)"))
def unwrap_in_house(spark, sf_dir):
    return _unwrapped(spark, sf_dir, "in-house")


# ---- contacts


@query(f"WITH {_USERS}, g AS (SELECT unnest(range(0, 41)) AS frame) SELECT g.frame, count(c.frame) AS k, max(c.n) AS n FROM g LEFT JOIN (SELECT frame, count(*) AS n FROM cc GROUP BY frame) c ON g.frame = c.frame GROUP BY g.frame")
def fill_missing(spark, sf_dir):
    counts = contacts.n_contacts(_user_counts(spark, sf_dir)[0])
    return contacts.fill_missing(counts, 0, 40, "frame").select("frame", F.when(F.col("n").isNull(), 0).otherwise(1).cast("long").alias("k"), "n")


@query(f"""WITH {CONTACTS_SQL}, d AS (SELECT event_id, x - 10.0 AS dx, y - 100.0 AS dy, z - 95.0 AS dz FROM pt WHERE event_type = 'click')
SELECT event_id AS ref FROM d WHERE {' + '.join(f'(d{a} - floor(d{a} / {b} + 0.5) * {b}) ** 2' for a, b in zip('xyz', BOX))} <= 1600""")
def atoms_around_point(spark, sf_dir):
    return contacts.contacts_around_point(particles(spark, sf_dir)[0], (10.0, 100.0, 95.0), 40.0, BOX).select("ref")


@query(f"WITH {_USERS} SELECT count(*) AS n, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS nulls, count(CASE WHEN ref >= 100 OR frame >= 20 THEN 1 END) AS outside FROM cc")
def check_contacts(spark, sf_dir):
    return contacts.check_contacts(_user_runs(spark, sf_dir, "checks", blocks="frames", n_frames=20, n_refs=100))


def _gaps_sql(rows: str, out: str) -> str:
    """Gaps of at most two frames filled, frame by frame, in lists s of n values by key k; i is the place in the list from 1."""
    fill = "list_transform(s, lambda v, j: CASE WHEN j > i AND j <= i + {n} THEN s[i] ELSE v END)"
    return f"""
{rows},
fg AS (
  SELECT k, 1 AS i, s FROM lists
  UNION ALL
  SELECT k, i + 1, CASE WHEN i + 3 <= len(s) AND s[i + 3] = s[i] THEN {fill.format(n=2)} WHEN s[i + 2] = s[i] THEN {fill.format(n=1)} ELSE s END FROM fg WHERE i <= len(s) - 2),
dn AS (SELECT k, s FROM fg WHERE i = greatest(1, len(s) - 1))
{out}"""


@query(_gaps_sql(f"WITH RECURSIVE {EVENTS_SQL}, lists AS (SELECT cmp AS k, list(state ORDER BY frame) AS s FROM ev GROUP BY cmp)", "SELECT k AS cmp, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS frame, CAST(unnest(s) AS INTEGER) AS state FROM dn"))
def correct_intermittency(spark, sf_dir):
    from framewalk.plans.tables import dtrj

    return repair.correct_intermittency(dtrj(spark, sf_dir), 2)


@query(_gaps_sql(f"""WITH RECURSIVE {_USERS}, lists AS (
  SELECT struct_pack(r := ref, s := sel) AS k, list_transform(range(0, {N_DAYS_SQL}), lambda f: CASE WHEN list_contains(l, CAST(f AS INTEGER)) THEN 1 ELSE 0 END) AS s
  FROM (SELECT ref, sel, list(DISTINCT frame) AS l FROM cc GROUP BY ref, sel))""", """, un AS (SELECT k, generate_subscripts(s, 1) - 1 AS frame, unnest(s) AS b FROM dn) SELECT CAST(frame AS INTEGER) AS frame, k.r AS ref, k.s AS sel FROM un WHERE b = 1"""))
def contact_intermittency(spark, sf_dir):
    return _user_runs(spark, sf_dir, "filled", intermittency=2, n_frames=n_days(spark, sf_dir)).drop(contacts.BLOCK)


# ---- renewals and displacements


_MOVED = f"""{_RENEWALS},
dp AS (SELECT frame, user_id AS ref, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y, arg_min(z, event_id) AS z FROM pt WHERE event_type = 'click' GROUP BY ALL),
rn AS (SELECT n.ref, n.sel, n.t0, n.stop - n.t0 AS trenew, a.x AS x0, b.x - a.x AS dx, b.y - a.y AS dy FROM op o JOIN nx n ON n.ref = o.ref AND n.t0 = o.t0 JOIN dp a ON a.ref = n.ref AND a.frame = n.t0 JOIN dp b ON b.ref = n.ref AND b.frame = n.stop WHERE n.t0 > 0 AND n.stop < {N_DAYS_SQL})"""


def _moved(spark, sf_dir):
    return events.renewal_events(_user_runs(spark, sf_dir, "longest"), n_days(spark, sf_dir), _day_positions(spark, sf_dir))


@query(f"""{_MOVED}
SELECT CAST(floor(x0 / 100) AS BIGINT) AS bin, count(*) AS n, round(avg(dx) + 1e-8, 5) + 0.0 AS mean, round(var_pop(dx) + 1e-8, 4) + 0.0 AS var, round(stddev_pop(dx) / sqrt(count(*)) + 1e-8, 5) + 0.0 AS se,
       round(avg(dx ** 2) + 1e-8, 4) + 0.0 AS msd, round(avg(dx ** 4) / nullif(3 * avg(dx ** 2) ** 2, 0) - 1 + 1e-8, 5) + 0.0 AS ngp FROM rn GROUP BY ALL""")
def displacement_by_bin(spark, sf_dir):
    made = events.displacement_by_bin(_moved(spark, sf_dir), F.floor(F.col("ref_x0") / 100), F.col("ref_dx"))
    return made.select("bin", "n", *(_tie(F.col(c), p).alias(c) for c, p in (("mean", 5), ("var", 4), ("se", 5), ("msd", 4), ("ngp", 5))))


@query(f"{_MOVED} SELECT sel % 3 AS bin, count(*) AS n, round(corr(dx, dy), 6) + 0.0 AS corr, round(regr_slope(dy, dx), 6) + 0.0 AS slope FROM rn GROUP BY ALL")
def displacements_of_two_axes(spark, sf_dir):
    made = events.displacements_of_two_axes(_moved(spark, sf_dir), F.col("sel") % 3, F.col("ref_dx"), F.col("ref_dy"))
    return made.select("bin", "n", _round(F.col("corr")).alias("corr"), _round(F.col("slope")).alias("slope"))


@query(f"""{_RENEWALS}, rn AS (SELECT n.ref, n.sel, n.t0, CAST(n.stop - n.t0 AS INTEGER) AS trenew FROM op o JOIN nx n ON n.ref = o.ref AND n.t0 = o.t0 WHERE n.t0 > 0 AND n.stop < {N_DAYS_SQL})
SELECT ref, sel, CAST(t0 AS INTEGER) AS t0, trenew, lag(sel) OVER w AS prev_sel, lag(trenew) OVER w AS prev_trenew FROM rn WINDOW w AS (PARTITION BY ref ORDER BY t0)""")
def previous_events(spark, sf_dir):
    found = events.renewal_events(_user_runs(spark, sf_dir, "longest"), n_days(spark, sf_dir))
    return events.with_previous_event(found, ["sel", "trenew"])


def _squared(to: str, of: str) -> str:
    return f"{to} AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM {of} a JOIN {of} b ON a.j = b.i GROUP BY a.i, b.j)"


@query(f"""{_RENEWALS}, ev_ AS (SELECT n.sel % 3 AS i, (n.ref + n.stop) % 3 AS j FROM op o JOIN nx n ON n.ref = o.ref AND n.t0 = o.t0 WHERE n.t0 > 0 AND n.stop < {N_DAYS_SQL}),
c_ AS (SELECT i, j, count(*) AS n FROM ev_ WHERE j IN (SELECT i FROM ev_) GROUP BY ALL), m0 AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS p FROM c_),
{", ".join(_squared(f"m{k + 1}", f"m{k}") for k in range(8))}
SELECT CAST(j AS INTEGER) AS bin, round(sum(p) / (SELECT count(DISTINCT i) FROM c_), 6) + 0.0 AS share FROM m8 GROUP BY j""")
def stationary_distribution(spark, sf_dir):
    found = events.renewal_events(_user_runs(spark, sf_dir, "longest"), n_days(spark, sf_dir))
    shares = events.stationary_distribution(events.transition_matrix(found, F.col("sel") % 3, (F.col("ref") + F.col("t0") + F.col("trenew")) % 3))
    return shares.select(F.col("bin").cast("int").alias("bin"), _round(F.col("share")).alias("share"))


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT b.frame - a.frame AS lag, (b.x - a.x) ** 2 AS d, a.state2 AS layer, a.frame AS f0 FROM ev a JOIN ev b ON a.cmp = b.cmp AND b.frame >= a.frame WHERE b.frame - a.frame <= 20 AND a.frame % 5 = 0),
m AS (SELECT layer, CAST(lag AS INTEGER) AS lag, avg(d) AS m FROM p WHERE f0 < (SELECT max(frame) FROM ev) GROUP BY ALL)
SELECT layer, arg_min(lag, struct_pack(d := round(abs(m - 400), 6), l := lag)) AS lag FROM m GROUP BY layer""")
def lag_at_msd(spark, sf_dir):
    from framewalk.plans.tables import events as rows_of

    rows = rows_of(spark, sf_dir)
    curve = dynamics.msd_by_layer(positions(spark, sf_dir), "cmp", rows.select("cmp", "frame", F.col("state2").alias("layer")), states.n_frames_of(rows), restart=5, max_lag=20)
    return dynamics.lag_at_value(curve.withColumn("msd_x", F.lit(400) - F.round(F.abs(F.col("msd_x") - 400), 6)), ["layer"], "lag", "msd_x", 400)


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT b.frame - a.frame AS lag, (b.x - a.x) ** 2 AS d, a.state2 AS layer, a.frame AS f0 FROM ev a JOIN ev b ON a.cmp = b.cmp AND b.frame >= a.frame ),
m AS (SELECT layer, CAST(lag AS INTEGER) AS lag, avg(d) AS m FROM p WHERE f0 < (SELECT max(frame) FROM ev) GROUP BY ALL)
SELECT layer, arg_min(lag, struct_pack(d := round(abs(m - 400), 6), l := lag)) AS lag FROM m GROUP BY layer""")
def lag_at_msd_all_starts(spark, sf_dir):
    from framewalk.plans.tables import events as rows_of

    rows = rows_of(spark, sf_dir)
    curve = dynamics.msd_by_layer_all_lags(positions(spark, sf_dir), "cmp", rows.select("cmp", "frame", F.col("state2").alias("layer")), states.n_frames_of(rows))
    return dynamics.lag_at_value(curve.withColumn("msd_x", F.lit(400) - F.round(F.abs(F.col("msd_x") - 400), 6)), ["layer"], "lag", "msd_x", 400)


@query(f"""WITH RECURSIVE {EVENTS_SQL},
p AS (SELECT frame, cmp, x - 60 * floor(x / 60) AS x, y - 14.4 * floor(y / 14.4) AS y, z - 10 * floor(z / 10) AS z, CASE WHEN cmp % 7 = 0 THEN cmp // 2 ELSE cmp - 1 END AS up FROM ev),
w AS (
  SELECT p.*, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, 0.0::DOUBLE AS sz FROM p LEFT JOIN p q ON q.frame = p.frame AND q.cmp = p.up AND p.cmp <> p.up WHERE q.cmp IS NULL
  UNION ALL
  SELECT p.*, {", ".join(f"w.s{a} - floor((p.{a} - w.{a}) / {b} + 0.5)" for a, b in zip("xyz", (60.0, 14.4, 10.0)))} FROM w JOIN p ON p.frame = w.frame AND p.up = w.cmp AND p.cmp <> p.up)
SELECT frame, cmp, {", ".join(f"round({a} + s{a} * {b}, 4) + 0.0 AS {a}" for a, b in zip("xyz", (60.0, 14.4, 10.0)))} FROM w""")
def make_whole_along_bonds(spark, sf_dir):
    """Users as the atoms of a molecule with branches; a bond holds in the frames that have both."""
    rows = positions(spark, sf_dir)
    small = boxes(spark, states.n_frames_of(rows)).select("frame", F.lit(60.0).alias("lx"), F.lit(14.4).alias("ly"), F.lit(10.0).alias("lz"))
    up = F.when(F.col("cmp") % 7 == 0, F.floor(F.col("cmp") / 2)).otherwise(F.col("cmp") - 1)
    bonds = rows.select(F.col("cmp").alias("a"), up.alias("b")).distinct()
    made = dynamics.make_whole_by_bonds(dynamics.wrap(rows, small).withColumn("mol", F.lit(0)), small, "mol", "cmp", bonds)
    return made.select("frame", "cmp", *(_round(F.col(a), 4).alias(a) for a in "xyz"))


# ---- sites and axes


_HEX = (6 * math.sqrt(3.0), 18.0)
_SITES = [(k, *p) for k, p in enumerate((2.0 * math.sqrt(3.0) * (c + 0.5 * (r % 2)) % _HEX[0], 3.0 * r) for r in range(6) for c in range(3))]


@query(f"""
WITH {EVENTS_SQL}, s(site, sx, sy) AS (VALUES {", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for k, x, y in _SITES)}),
d AS (SELECT cmp, frame, site, (x - sx - floor((x - sx) / {_HEX[0]!r} + 0.5) * {_HEX[0]!r}) ** 2 + (y - sy - floor((y - sy) / {_HEX[1]!r} + 0.5) * {_HEX[1]!r}) ** 2 AS d2 FROM ev CROSS JOIN s)
SELECT cmp, frame, round(min(d2), 6) + 0.0 AS d2 FROM d GROUP BY cmp, frame""")
def nearest_lattice_site(spark, sf_dir):
    """The distances to the sites found, since a lattice has ties."""
    sites = spark.createDataFrame(_SITES, "site int, sx double, sy double")
    found = binning.nearest_site(positions(spark, sf_dir), sites.select("site", F.col("sx").alias("x"), F.col("sy").alias("y")), _HEX)
    rows = found.join(positions(spark, sf_dir), ["cmp", "frame"]).join(sites, F.col("state") == F.col("site"))
    d = [geometry.mic_ortho(F.col(a) - F.col(f"s{a}"), F.lit(length)) for a, length in zip("xy", _HEX)]
    return rows.select("cmp", "frame", _round(d[0] * d[0] + d[1] * d[1]).alias("d2"))


#: Sheet of a lattice of hexagons of side 2 with a flat side along x.
_SHEET = (12.0, 4 * math.sqrt(3.0))


@query(f"""
WITH {EVENTS_SQL}, a(x0, y0) AS (VALUES (1.0::DOUBLE, 2.0::DOUBLE), (6.0, 0.5)),
k AS (SELECT abs(y - y0 - floor((y - y0) / {_SHEET[1]!r} + 0.5) * {_SHEET[1]!r}) AS s, x - x0 - floor((x - x0) / 12.0 + 0.5) * 12.0 AS d FROM ev CROSS JOIN a),
b AS (SELECT CAST(v AS INTEGER) AS bin FROM range(0, 7) AS r(v))
SELECT 90.0::DOUBLE AS angle, b.bin, (b.bin * 0.5)::DOUBLE AS lo, (b.bin * 0.5 + 0.5)::DOUBLE AS hi, count(k.s) AS n FROM b LEFT JOIN k ON abs(d) < 0.5 AND s >= b.bin * 0.5 AND (s < b.bin * 0.5 + 0.5 OR (b.bin = 6 AND s = 3.5)) GROUP BY ALL""")
def hexagonal_distribution(spark, sf_dir):
    return binning.hexagonal_distribution(positions(spark, sf_dir), [(1.0, 2.0, 90.0), (6.0, 0.5, 90.0)], _SHEET, 1.0, [0.5 * k for k in range(8)])
