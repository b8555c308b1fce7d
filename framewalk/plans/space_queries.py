"""Queries of the geometry, contact, event and displacement operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewalk.functions import geometry
from framewalk.operators import binning, contacts, dynamics, events, fits, repair, states
from framewalk.plans.tables import BOX, CONTACTS_SQL, CUTOFF, EVENTS_SQL, N_DAYS_SQL, boxes, boxes_of_days, dtrj, n_days, particles, positions, table
from framewalk.plans.tables import events as user_events
from framewalk.session import kept

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A skewed box: rows of its matrix.
MATRIX = ((600.0, 0.0, 0.0), (60.0, 144.0, 0.0), (30.0, 20.0, 100.0))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _round(c, places: int = 6):
    return F.round(c, places) + F.lit(0.0)


def _tie(c, places: int):
    """As _round, for values that often lie half-way between two: both sides move them up a little."""
    return F.round(c + 1e-8, places) + F.lit(0.0)


def _tie5(c):
    return F.round(c + 1e-9, 5) + F.lit(0.0)


def _xyz(*names: str):
    return tuple(F.col(n) for n in names)


def _matrix():
    return [tuple(F.lit(v) for v in row) for row in MATRIX]


# ---- geometry


@query("""
SELECT p_partkey, round(a * b * c * sqrt(greatest(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg, 0.0)), 4) + 0.0 AS volume, round(sqrt(a * a + b * b + c * c), 6) + 0.0 AS diagonal
FROM (SELECT p_partkey, p_size + 1.0::DOUBLE AS a, p_size + 2.0::DOUBLE AS b, p_retailprice / 100 AS c, cos(radians(60 + p_size % 30)) AS ca, cos(radians(70 + p_size % 20)) AS cb, cos(radians(80 + p_size % 10)) AS cg FROM part)""")
def box_volume(spark, sf_dir):
    size = F.col("p_size")
    lengths = (size + 1.0, size + 2.0, F.col("p_retailprice") / 100)
    angles = tuple((b + size % m).cast("double") for b, m in ((60, 30), (70, 20), (80, 10)))
    return table(spark, sf_dir, "part").select("p_partkey", _round(geometry.box_volume(lengths, angles), 4).alias("volume"), _round(geometry.diagonal(lengths)).alias("diagonal"))


@query("""
WITH p AS (SELECT p_partkey, p_size + 1.0::DOUBLE AS a, p_size + 2.0::DOUBLE AS b, p_retailprice / 100 AS c, cos(radians(60 + p_size % 30)) AS ca, cos(radians(70 + p_size % 20)) AS cb, radians(80 + p_size % 10) AS g FROM part)
SELECT p_partkey, round(b * cos(g), 6) + 0.0 AS bx, round(b * sin(g), 6) + 0.0 AS "by", round(c * cb, 6) + 0.0 AS cx, round(c * (ca - cb * cos(g)) / sin(g), 6) + 0.0 AS cy,
       round(c * sqrt(1 - cb * cb - ((ca - cb * cos(g)) / sin(g)) ** 2), 6) + 0.0 AS cz
FROM p""")
def triclinic_vectors(spark, sf_dir):
    size = F.col("p_size")
    lengths = (size + 1.0, size + 2.0, F.col("p_retailprice") / 100)
    angles = tuple((b + size % m).cast("double") for b, m in ((60, 30), (70, 20), (81, 10)))
    angles = (angles[0], angles[1], (80 + size % 10).cast("double"))
    _, b, c = geometry.triclinic_vectors(lengths, angles)
    return table(spark, sf_dir, "part").select("p_partkey", _round(b[0]).alias("bx"), _round(b[1]).alias("by"), _round(c[0]).alias("cx"), _round(c[1]).alias("cy"), _round(c[2]).alias("cz"))


@query("SELECT p_partkey, round(p_size + 1.0::DOUBLE, 6) AS a, round(p_size + 2.0::DOUBLE, 6) AS b, round(p_retailprice / 100, 6) AS c, CAST(60 + p_size % 30 AS DOUBLE) AS alpha, CAST(70 + p_size % 20 AS DOUBLE) AS beta, CAST(80 + p_size % 10 AS DOUBLE) AS gamma FROM part")
def triclinic_box(spark, sf_dir):
    size = F.col("p_size")
    lengths = (size + 1.0, size + 2.0, F.col("p_retailprice") / 100)
    angles = tuple((b + size % m).cast("double") for b, m in ((60, 30), (70, 20), (80, 10)))
    back = geometry.triclinic_box(geometry.triclinic_vectors(lengths, angles))
    return table(spark, sf_dir, "part").select("p_partkey", *(_round(c).alias(n) for c, n in zip(back, ("a", "b", "c", "alpha", "beta", "gamma"))))


_FRAC = f"""
{EVENTS_SQL},
q AS (SELECT *, x * 3 - 500 AS px, y * 2 - 100 AS py, z * 4 - 150 AS pz FROM ev),
f AS (SELECT *, pz / {MATRIX[2][2]} AS fz, (py - pz / {MATRIX[2][2]} * {MATRIX[2][1]}) / {MATRIX[1][1]} AS fy FROM q),
g AS (SELECT *, (px - fz * {MATRIX[2][0]} - fy * {MATRIX[1][0]}) / {MATRIX[0][0]} AS fx FROM f)"""


def _spread(spark, sf_dir):
    return user_events(spark, sf_dir).select("event_id", (F.col("x") * 3 - 500).alias("px"), (F.col("y") * 2 - 100).alias("py"), (F.col("z") * 4 - 150).alias("pz"))


@query(f"WITH {_FRAC} SELECT event_id, round(fx, 6) + 0.0 AS fx, round(fy, 6) + 0.0 AS fy, round(fz, 6) + 0.0 AS fz FROM g")
def cart2box(spark, sf_dir):
    made = geometry.cart2box(_xyz("px", "py", "pz"), _matrix())
    return _spread(spark, sf_dir).select("event_id", *(_round(c).alias(n) for c, n in zip(made, ("fx", "fy", "fz"))))


@query(f"""WITH {_FRAC} SELECT event_id, round(px - floor(fx) * {MATRIX[0][0]} - floor(fy) * {MATRIX[1][0]} - floor(fz) * {MATRIX[2][0]}, 6) + 0.0 AS wx,
round(py - floor(fy) * {MATRIX[1][1]} - floor(fz) * {MATRIX[2][1]}, 6) + 0.0 AS wy, round(pz - floor(fz) * {MATRIX[2][2]}, 6) + 0.0 AS wz FROM g""")
def wrap_pos(spark, sf_dir):
    made = geometry.wrap_pos(_xyz("px", "py", "pz"), _matrix())
    return _spread(spark, sf_dir).select("event_id", *(_round(c).alias(n) for c, n in zip(made, ("wx", "wy", "wz"))))


@query(f"""WITH {_FRAC} SELECT event_id, round(px - floor(fx + 0.5) * {MATRIX[0][0]} - floor(fy + 0.5) * {MATRIX[1][0]} - floor(fz + 0.5) * {MATRIX[2][0]}, 6) + 0.0 AS dx,
round(py - floor(fy + 0.5) * {MATRIX[1][1]} - floor(fz + 0.5) * {MATRIX[2][1]}, 6) + 0.0 AS dy, round(pz - floor(fz + 0.5) * {MATRIX[2][2]}, 6) + 0.0 AS dz FROM g""")
def vdist(spark, sf_dir):
    zero = (F.lit(0.0), F.lit(0.0), F.lit(0.0))
    made = geometry.vdist(_xyz("px", "py", "pz"), zero, _matrix())
    return _spread(spark, sf_dir).select("event_id", *(_round(c).alias(n) for c, n in zip(made, ("dx", "dy", "dz"))))


# ---- centres


_CENTER = "SELECT l_orderkey, round(sum({w} * l_quantity) / nullif(sum({w}), 0) + 1e-8, 6) + 0.0 AS x, round(sum({w} * l_extendedprice) / nullif(sum({w}), 0) + 1e-8, 5) + 0.0 AS y, round(sum({w} * l_linenumber) / nullif(sum({w}), 0) + 1e-8, 6) + 0.0 AS z FROM lineitem GROUP BY l_orderkey"


def _centers(spark, sf_dir, weight):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_linenumber").cast("double").alias("z"), "l_discount", "l_tax")
    made = dynamics.centers(rows, ["l_orderkey"], weight)
    return made.select("l_orderkey", _tie(F.col("x"), 6).alias("x"), _tie(F.col("y"), 5).alias("y"), _tie(F.col("z"), 6).alias("z"))


@query(_CENTER.format(w="1"))
def center_of_geometry(spark, sf_dir):
    return _centers(spark, sf_dir, None)


@query(_CENTER.format(w="(l_discount + 1)"))
def center_of_mass(spark, sf_dir):
    return _centers(spark, sf_dir, F.col("l_discount") + 1)


@query("SELECT l_orderkey, round(sum((1 - l_discount) * l_quantity) / sum(1 - l_discount), 6) + 0.0 AS value, count(*) AS n_atoms FROM lineitem GROUP BY l_orderkey")
def compound_attributes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("w", 1 - F.col("l_discount"))
    value = dynamics.compound_attribute(rows, ["l_orderkey"], "l_quantity", "w").withColumn("value", _round(F.col("value")))
    return value.join(dynamics.atoms_per_compound(rows, ["l_orderkey"]), "l_orderkey")


@query(f"""
WITH {EVENTS_SQL}, w AS (SELECT cmp, frame, z, avg(z * 4 - 150) OVER (PARTITION BY frame, cmp % 7) AS c FROM ev)
SELECT cmp, frame, round(z * 4 - 150 - {BOX[2]} * floor(c / {BOX[2]}), 6) + 0.0 AS z FROM w""")
def wrap_compounds(spark, sf_dir):
    rows = positions(spark, sf_dir).withColumn("z", F.col("z") * 4 - 150).withColumn("group", F.col("cmp") % 7)
    n = states.n_frames_of(rows)
    return dynamics.wrap_compounds(rows, boxes(spark, n), "group").select("cmp", "frame", _round(F.col("z")).alias("z"))


# ---- contacts


@query(f"WITH {CONTACTS_SQL} SELECT frame, ref, sel, round(dist, 6) + 0.0 AS dist FROM con")
def contact_pairs(spark, sf_dir):
    ref, sel = particles(spark, sf_dir)
    made = contacts.contact_pairs(ref, sel, CUTOFF, boxes_of_days(spark, sf_dir))
    return made.withColumn("dist", _round(F.col("dist")))


def _user_counts(spark, sf_dir, blocks="frames"):
    """Contacts of users, and the users by day; blocks of pairs for what goes over several days."""
    ref, sel = particles(spark, sf_dir)
    found = contacts.compound_pairs(ref, sel, CUTOFF, boxes_of_days(spark, sf_dir), blocks=blocks)
    return found, ref.select("frame", F.col("cmp").alias("ref")).distinct(), sel.select("frame", F.col("cmp").alias("sel")).distinct()


def _user_runs(spark, sf_dir, make="runs", **options):
    """Runs of contact of users; the longest by start are enough for renewals, and other sums need no runs at all."""
    return contacts.compound_pairs(*particles(spark, sf_dir), CUTOFF, boxes_of_days(spark, sf_dir), make=make, **options)


def _user_levels(spark, sf_dir):
    """Contacts of a user and day by their number in a pair, and the users by day."""
    return _user_runs(spark, sf_dir, "levels", blocks="frames"), particles(spark, sf_dir)[0].select("frame", F.col("cmp").alias("ref")).distinct()


_USERS = f"""
{CONTACTS_SQL},
cc AS (SELECT frame, rc AS ref, sc AS sel, count(*) AS n FROM con GROUP BY ALL),
rf AS (SELECT DISTINCT frame, user_id AS ref FROM pt WHERE event_type = 'click'),
sf AS (SELECT DISTINCT frame, user_id AS sel FROM pt WHERE event_type = 'purchase')"""


@query(f"WITH {_USERS} SELECT * FROM cc")
def compound_contact_counts(spark, sf_dir):
    return _user_counts(spark, sf_dir)[0].drop(contacts.BLOCK)


@query(f"WITH {_USERS} SELECT frame, ref, sel FROM cc WHERE n >= 2")
def compound_contacts(spark, sf_dir):
    return contacts.enough(_user_counts(spark, sf_dir)[0], 2)


@query(f"""
WITH {_USERS}
SELECT 'atm-atm' AS level, frame, ref, sel, count(*) AS n FROM con GROUP BY ALL
UNION ALL SELECT 'atm-cmp', frame, ref, sc, count(*) FROM con GROUP BY ALL
UNION ALL SELECT 'cmp-atm', frame, rc, sel, count(*) FROM con GROUP BY ALL
UNION ALL SELECT 'cmp-cmp', frame, rc, sc, count(*) FROM con GROUP BY ALL""")
def contact_counts_all_levels(spark, sf_dir):
    return contacts.all_levels(*particles(spark, sf_dir), CUTOFF, boxes_of_days(spark, sf_dir))


@query(f"""
WITH {_USERS},
e AS (SELECT r.frame, r.ref, count(c.sel) AS d, coalesce(sum(c.n), 0) AS t FROM rf r LEFT JOIN cc c ON r.frame = c.frame AND r.ref = c.ref GROUP BY ALL),
s AS (SELECT DISTINCT frame, ref, n FROM cc UNION ALL SELECT frame, ref, 0 FROM e WHERE d = 0),
k AS (SELECT CAST(d AS BIGINT) AS n, 'd' AS k FROM e UNION ALL SELECT CAST(t AS BIGINT), 't' FROM e UNION ALL SELECT CAST(n AS BIGINT), 's' FROM s UNION ALL SELECT CAST(n AS BIGINT), 'p' FROM cc),
g AS (SELECT unnest(range(0, (SELECT max(n) + 1 FROM k))) AS n)
SELECT g.n, count(CASE WHEN k = 'd' THEN 1 END) AS diff, count(CASE WHEN k = 's' THEN 1 END) AS same, count(CASE WHEN k = 't' THEN 1 END) AS tot, count(CASE WHEN k = 'p' THEN 1 END) AS pair
FROM g LEFT JOIN k ON g.n = k.n GROUP BY g.n""")
def contact_hists(spark, sf_dir):
    return contacts.contact_hists(*_user_levels(spark, sf_dir))


@query(f"""
WITH {_USERS}, e AS (SELECT r.frame, r.ref, count(c.sel) AS d, sum(c.n) AS t FROM rf r LEFT JOIN cc c ON r.frame = c.frame AND r.ref = c.ref GROUP BY ALL)
SELECT count(*) AS n_refs, count(t) AS n_bound, round(sum(t) / count(*), 6) + 0.0 AS contacts_all, round(avg(t), 6) + 0.0 AS contacts_bound,
       round(sum(d) / count(*), 6) + 0.0 AS partners_all, round(avg(CASE WHEN d > 0 THEN d END), 6) + 0.0 AS partners_bound
FROM e""")
def contact_averages(spark, sf_dir):
    made = contacts.contact_averages(*_user_levels(spark, sf_dir))
    return made.withColumns({c: _round(F.col(c)) for c in ("contacts_all", "contacts_bound", "partners_all", "partners_bound")})


@query(f"WITH {_USERS} SELECT frame, count(*) AS n FROM cc GROUP BY frame")
def contacts_per_frame(spark, sf_dir):
    return contacts.n_contacts(_user_counts(spark, sf_dir)[0])


@query(f"WITH {_USERS}, p AS (SELECT ref, sel FROM cc GROUP BY ref, sel HAVING count(DISTINCT frame) = 2) SELECT count(*) AS n FROM p")
def contacts_in_common(spark, sf_dir):
    return contacts.n_common_contacts(_user_runs(spark, sf_dir, "common", n_frames=2), 2)


@query(f"""
WITH {_USERS}
SELECT r.frame, r.ref, count(c.sel) AS n, round(coalesce(avg(c.sel), 0), 6) + 0.0 AS mean, round(coalesce(var_pop(c.sel), 0), 4) + 0.0 AS var,
       coalesce(min(c.sel), 0)::DOUBLE AS min, coalesce(max(c.sel), 0)::DOUBLE AS max
FROM rf r LEFT JOIN cc c ON r.frame = c.frame AND r.ref = c.ref GROUP BY ALL""")
def contact_partner_stats(spark, sf_dir):
    counts, refs, _ = _user_counts(spark, sf_dir)
    made = contacts.sel_index_stats(counts, refs)
    return made.withColumns({"mean": _round(F.col("mean")), "var": _round(F.col("var"), 4)})


@query(f"WITH {_USERS} SELECT r.frame, r.ref FROM rf r WHERE NOT EXISTS (SELECT 1 FROM cc c WHERE c.frame = r.frame AND c.ref = r.ref)")
def unbound_compounds(spark, sf_dir):
    counts, refs, _ = _user_counts(spark, sf_dir)
    return contacts.unbound(counts, refs)


def _acf_sql(rows: str) -> str:
    return f"""
WITH {_USERS}, m AS ({rows}), g AS (SELECT CAST(v AS INTEGER) AS lag FROM (SELECT unnest(range(0, {N_DAYS_SQL})) AS v)),
b AS (SELECT b.frame - a.frame AS lag, count(*) AS n FROM m a JOIN m b ON a.k = b.k AND b.frame > a.frame GROUP BY ALL),
s AS (SELECT g.lag, count(*) AS n FROM g JOIN m ON m.frame + g.lag <= {N_DAYS_SQL} - 1 AND m.frame < {N_DAYS_SQL} - 1 WHERE g.lag > 0 GROUP BY g.lag)
SELECT g.lag, coalesce(b.n, 0) AS n_both, coalesce(s.n, 0) AS n_start, CASE WHEN g.lag = 0 THEN 1.0 ELSE round(coalesce(b.n, 0) / nullif(s.n, 0), 6) + 0.0 END AS acf
FROM g LEFT JOIN b ON g.lag = b.lag LEFT JOIN s ON g.lag = s.lag"""


@query(_acf_sql("SELECT frame, struct_pack(r := ref, s := sel) AS k FROM cc"))
def autocorr_bound(spark, sf_dir):
    made = contacts.autocorrelation(_user_runs(spark, sf_dir, "lags"), ["ref", "sel"], n_days(spark, sf_dir))
    return made.withColumn("acf", _round(F.col("acf")))


@query(_acf_sql("SELECT r.frame, r.ref AS k FROM rf r WHERE NOT EXISTS (SELECT 1 FROM cc c WHERE c.frame = r.frame AND c.ref = r.ref)"))
def autocorr_unbound(spark, sf_dir):
    counts, refs, _ = _user_counts(spark, sf_dir)
    made = contacts.autocorrelation(kept(contacts.unbound(counts, refs), "unbound"), ["ref"], n_days(spark, sf_dir))
    return made.withColumn("acf", _round(F.col("acf")))


_CHANGES = f"""
{_USERS},
u AS (
  SELECT frame, ref, 1 AS a, 0 AS d FROM cc c WHERE frame > 0 AND NOT EXISTS (SELECT 1 FROM cc o WHERE o.ref = c.ref AND o.sel = c.sel AND o.frame = c.frame - 1)
  UNION ALL
  SELECT frame + 1, ref, 0, 1 FROM cc c WHERE frame < {N_DAYS_SQL} - 1 AND NOT EXISTS (SELECT 1 FROM cc o WHERE o.ref = c.ref AND o.sel = c.sel AND o.frame = c.frame + 1)),
ad AS (SELECT frame, ref, CAST(sum(a) AS BIGINT) AS n_attached, CAST(sum(d) AS BIGINT) AS n_detached FROM u GROUP BY ALL)"""


@query(f"WITH {_CHANGES} SELECT * FROM ad")
def attach_detach(spark, sf_dir):
    return contacts.attach_detach(_user_runs(spark, sf_dir), n_days(spark, sf_dir))


def _day_positions(spark, sf_dir):
    """A position for each user and day with a click: that of the first."""
    ref, _ = particles(spark, sf_dir)
    first = F.min_by(F.struct("x", "y", "z"), "ref")
    return ref.groupBy("frame", F.col("cmp").alias("ref")).agg(first.alias("p")).select("frame", "ref", "p.*")


@query(f"""
WITH {_CHANGES},
dp AS (SELECT frame, user_id AS ref, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y, arg_min(z, event_id) AS z FROM pt WHERE event_type = 'click' GROUP BY ALL),
m AS (SELECT frame, ref FROM ad WHERE frame > 0 UNION ALL SELECT frame, ref FROM dp WHERE frame = 0),
s AS (SELECT m.frame - lag(m.frame) OVER w AS dt, (x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2 AS d2
      FROM m JOIN dp ON m.frame = dp.frame AND m.ref = dp.ref WINDOW w AS (PARTITION BY m.ref ORDER BY m.frame))
SELECT dt, count(*) AS n, round(avg(d2) + 1e-8, 4) + 0.0 AS msd FROM s WHERE dt IS NOT NULL GROUP BY dt""")
def msd_at_coordination_change(spark, sf_dir):
    changes = contacts.attach_detach(_user_runs(spark, sf_dir), n_days(spark, sf_dir))
    made = events.msd_at_coordination_change(_day_positions(spark, sf_dir), changes)
    return made.withColumn("msd", _tie(F.col("msd"), 4))


_KINDS = {"detachment": "n_detached >= 1", "attachment": "n_attached >= 2", "exchange": "n_detached >= 1 AND n_attached >= 1"}


@query(f"""
WITH {_CHANGES},
dp AS (SELECT frame, user_id AS ref, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y, arg_min(z, event_id) AS z FROM pt WHERE event_type = 'click' GROUP BY ALL),
k AS ({" UNION ALL ".join(f"SELECT '{kind}' AS kind, frame, ref FROM ad WHERE frame > 0 AND {test} UNION ALL SELECT '{kind}', frame, ref FROM dp WHERE frame = 0" for kind, test in _KINDS.items())}),
s AS (SELECT kind, k.frame - lag(k.frame) OVER w AS dt, (x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2 AS d2
      FROM k JOIN dp ON k.frame = dp.frame AND k.ref = dp.ref WINDOW w AS (PARTITION BY kind, k.ref ORDER BY k.frame))
SELECT kind, dt, count(*) AS n, round(avg(d2) + 1e-8, 4) + 0.0 AS msd FROM s WHERE dt IS NOT NULL GROUP BY kind, dt""")
def msd_at_kinds_of_change(spark, sf_dir):
    found, places = kept(contacts.attach_detach(_user_runs(spark, sf_dir), n_days(spark, sf_dir)), "changes"), kept(_day_positions(spark, sf_dir), "places")
    made = [events.msd_at_coordination_change(places, contacts.changes_of_kind(found, kind, 1, n_att)).withColumn("kind", F.lit(kind)) for kind, n_att in (("detachment", 1), ("attachment", 2), ("exchange", 1))]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("kind", "dt", "n", _tie(F.col("msd"), 4).alias("msd"))


@query(f"""
WITH {_USERS}, i AS (SELECT ref, sel, frame, frame - row_number() OVER (PARTITION BY ref, sel ORDER BY frame) AS g FROM cc)
SELECT ref, sel, CAST(min(frame) AS INTEGER) AS start, CAST(max(frame) + 1 AS INTEGER) AS stop FROM i GROUP BY ref, sel, g""")
def contact_runs(spark, sf_dir):
    return events.contact_runs(_user_runs(spark, sf_dir))


_RENEWALS = f"""
WITH RECURSIVE {_USERS},
i AS (SELECT ref, sel, frame, frame - row_number() OVER (PARTITION BY ref, sel ORDER BY frame) AS g FROM cc),
cr AS (SELECT ref, sel, min(frame) AS a, max(frame) + 1 AS b FROM i GROUP BY ref, sel, g),
fr AS (SELECT DISTINCT ref, frame FROM cc),
nx AS (
  SELECT f.ref, f.frame AS t0, max(r.b) AS stop, arg_min(r.sel, struct_pack(b := -r.b, s := r.sel)) AS sel
  FROM fr f JOIN cr r ON r.ref = f.ref AND r.a <= f.frame AND r.b > f.frame GROUP BY f.ref, f.frame),
op AS (
  SELECT ref, min(frame) AS t0 FROM fr GROUP BY ref
  UNION ALL
  SELECT o.ref, (SELECT min(f.frame) FROM fr f WHERE f.ref = o.ref AND f.frame >= n.stop) AS t0
  FROM op o JOIN nx n ON n.ref = o.ref AND n.t0 = o.t0
  WHERE EXISTS (SELECT 1 FROM fr f WHERE f.ref = o.ref AND f.frame >= n.stop))"""


@query(f"{_RENEWALS} SELECT n.ref, n.sel, CAST(n.t0 AS INTEGER) AS t0, CAST(n.stop AS INTEGER) AS stop FROM op o JOIN nx n ON n.ref = o.ref AND n.t0 = o.t0")
def bound_intervals(spark, sf_dir):
    return events.bound_intervals(_user_runs(spark, sf_dir, "longest"))


@query(f"{_RENEWALS} SELECT n.ref, n.sel, CAST(n.t0 AS INTEGER) AS t0, CAST(n.stop - n.t0 AS INTEGER) AS trenew FROM op o JOIN nx n ON n.ref = o.ref AND n.t0 = o.t0 WHERE n.t0 > 0 AND n.stop < {N_DAYS_SQL}")
def renewal_events(spark, sf_dir):
    return events.renewal_events(_user_runs(spark, sf_dir, "longest"), n_days(spark, sf_dir))


@query(f"""{_RENEWALS}, iv AS (SELECT n.* FROM op o JOIN nx n ON n.ref = o.ref AND n.t0 = o.t0),
u AS (SELECT DISTINCT ref FROM rf), d AS (SELECT CAST(v AS INTEGER) AS frame FROM (SELECT unnest(range(0, {N_DAYS_SQL})) AS v))
SELECT u.ref AS cmp, d.frame, coalesce(iv.sel, -1) AS state FROM u CROSS JOIN d LEFT JOIN iv ON iv.ref = u.ref AND iv.t0 <= d.frame AND iv.stop > d.frame""")
def coordination_sequence(spark, sf_dir):
    refs = particles(spark, sf_dir)[0].select(F.col("cmp").alias("ref"))
    return events.coordination_sequence(_user_runs(spark, sf_dir, "longest"), refs, n_days(spark, sf_dir))


@query(f"""{_RENEWALS},
ev AS (SELECT n.t0 % 4 AS bin0, n.stop % 4 AS bin1, n.stop - n.t0 AS trenew FROM op o JOIN nx n ON n.ref = o.ref AND n.t0 = o.t0 WHERE n.t0 > 0 AND n.stop < {N_DAYS_SQL}),
c AS (SELECT CAST(bin0 AS INTEGER) AS bin0, CAST(bin1 AS INTEGER) AS bin1, count(*) AS n, round(avg(trenew), 6) + 0.0 AS mean_trenew FROM ev GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY bin0), 6) + 0.0 AS prob FROM c WHERE bin1 IN (SELECT bin0 FROM c)""")
def transition_matrix(spark, sf_dir):
    found = events.renewal_events(_user_runs(spark, sf_dir, "longest"), n_days(spark, sf_dir))
    made = events.transition_matrix(found, F.col("t0") % 4, (F.col("t0") + F.col("trenew")) % 4)
    return made.select("bin0", "bin1", "n", _round(F.col("mean_trenew")).alias("mean_trenew"), _round(F.col("prob")).alias("prob"))


@query(f"""{_RENEWALS}, ev AS (SELECT n.sel % 5 AS bin, n.stop - n.t0 AS trenew FROM op o JOIN nx n ON n.ref = o.ref AND n.t0 = o.t0 WHERE n.t0 > 0 AND n.stop < {N_DAYS_SQL})
SELECT bin, CAST(sum(trenew) AS BIGINT) AS weight, round(sum(trenew) / (SELECT sum(trenew) FROM ev), 6) + 0.0 AS share FROM ev GROUP BY bin""")
def occupancy_by_bin(spark, sf_dir):
    found = events.renewal_events(_user_runs(spark, sf_dir, "longest"), n_days(spark, sf_dir))
    return events.occupancy_by_bin(found, F.col("sel") % 5).withColumn("share", _round(F.col("share")))


def _user_states(spark, sf_dir):
    return dtrj(spark, sf_dir)


_OWN = f"{EVENTS_SQL}, {_USERS}, own AS (SELECT DISTINCT frame, ref, sel FROM cc)"


@query(f"""
WITH {EVENTS_SQL}, {_USERS},
f AS (SELECT frame, cmp AS ref, state <> lag(state) OVER (PARTITION BY cmp ORDER BY frame) AS moved FROM ev),
rm AS (SELECT rf.frame, rf.ref, moved FROM rf JOIN f ON rf.frame = f.frame AND rf.ref = f.ref WHERE moved IS NOT NULL),
cm AS (SELECT cc.*, moved FROM cc JOIN f ON cc.frame = f.frame AND cc.ref = f.ref WHERE moved IS NOT NULL),
e AS (SELECT r.moved, r.frame, r.ref, count(c.sel) AS d, coalesce(sum(c.n), 0) AS t FROM rm r LEFT JOIN cm c ON r.frame = c.frame AND r.ref = c.ref GROUP BY ALL),
s AS (SELECT DISTINCT moved, frame, ref, n FROM cm UNION ALL SELECT moved, frame, ref, 0 FROM e WHERE d = 0),
k AS (SELECT moved, CAST(d AS BIGINT) AS n, 'd' AS k FROM e UNION ALL SELECT moved, CAST(t AS BIGINT), 't' FROM e UNION ALL SELECT moved, CAST(n AS BIGINT), 's' FROM s UNION ALL SELECT moved, CAST(n AS BIGINT), 'p' FROM cm),
g AS (SELECT moved, unnest(range(0, top + 1)) AS n FROM (SELECT moved, max(n) AS top FROM k GROUP BY moved))
SELECT g.moved, g.n, count(CASE WHEN k = 'd' THEN 1 END) AS diff, count(CASE WHEN k = 's' THEN 1 END) AS same, count(CASE WHEN k = 't' THEN 1 END) AS tot, count(CASE WHEN k = 'p' THEN 1 END) AS pair
FROM g LEFT JOIN k ON g.n = k.n AND g.moved = k.moved GROUP BY g.moved, g.n""")
def contact_hists_at_moves(spark, sf_dir):
    return events.contact_hists_at_moves(*_user_levels(spark, sf_dir), _user_states(spark, sf_dir))


@query(f"""{_RENEWALS}, ev AS (SELECT n.sel % 5 AS bin FROM op o JOIN nx n ON n.ref = o.ref AND n.t0 = o.t0 WHERE n.t0 > 0 AND n.stop < {N_DAYS_SQL})
SELECT bin, count(*) AS n, round(sqrt(count(*)), 6) + 0.0 AS error FROM ev GROUP BY bin""")
def events_by_bin(spark, sf_dir):
    found = events.renewal_events(_user_runs(spark, sf_dir, "longest"), n_days(spark, sf_dir))
    return events.events_by_bin(found, F.col("sel") % 5).withColumn("error", _round(F.col("error")))


@query(f"""
WITH {CONTACTS_SQL}, c AS (SELECT frame, arg_min(x, event_id) AS cx, arg_min(y, event_id) AS cy, arg_min(z, event_id) AS cz FROM pt GROUP BY frame),
d AS (SELECT pt.frame, event_type, x - cx AS dx, y - cy AS dy, z - cz AS dz FROM pt JOIN c ON pt.frame = c.frame)
SELECT frame, count(*) AS n_atoms, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_type
FROM d WHERE (dx - floor(dx / {BOX[0]} + 0.5) * {BOX[0]}) ** 2 + (dy - floor(dy / {BOX[1]} + 0.5) * {BOX[1]}) ** 2 + (dz - floor(dz / {BOX[2]} + 0.5) * {BOX[2]}) ** 2 <= 900 GROUP BY frame""")
def topological_map(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("frame"), "event_id", "event_type", F.col("value").alias("x"), ((F.hour("ts") * 60 + F.minute("ts")) / 10).alias("y"), F.get_json_object("props", "$.k").cast("double").alias("z"))
    center = rows.groupBy("frame").agg(F.min_by(F.struct("x", "y", "z"), "event_id").alias("p")).select("frame", "p.*")
    made = events.topological_map(rows, center, 30.0, boxes_of_days(spark, sf_dir), ["event_type"])
    return made.withColumn("event_type", F.array_join("event_type", ","))


@query(f"""
WITH {CONTACTS_SQL},
a AS (SELECT frame, user_id, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y, arg_min(z, event_id) AS z, arg_max(x, event_id) AS u, arg_max(y, event_id) AS v, arg_max(z, event_id) AS w FROM pt GROUP BY ALL)
SELECT frame, count(*) AS n, round(avg((u - x) ** 2) + 1e-8, 5) + 0.0 AS msd_x, round(avg((v - y) ** 2) + 1e-8, 5) + 0.0 AS msd_y, round(avg((w - z) ** 2) + 1e-8, 5) + 0.0 AS msd_z,
       round(sqrt(avg((u - x) ** 2) + avg((v - y) ** 2) + avg((w - z) ** 2)) + 1e-9, 6) + 0.0 AS rmsd FROM a GROUP BY frame""")
def rmsd_two_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("frame"), "event_id", "user_id", F.col("value").alias("x"), ((F.hour("ts") * 60 + F.minute("ts")) / 10).alias("y"), F.get_json_object("props", "$.k").cast("double").alias("z"))
    ends = [rows.groupBy("frame", "user_id").agg(best(F.struct("x", "y", "z"), "event_id").alias("p")).select("frame", "user_id", "p.*") for best in (F.min_by, F.max_by)]
    made = dynamics.rmsd(*ends, ["frame"], "user_id")
    return made.select("frame", "n", *(_tie(F.col(c), 5).alias(c) for c in ("msd_x", "msd_y", "msd_z")), F.round(F.col("rmsd") + 1e-9, 6).alias("rmsd"))


@query(f"""
WITH {_OWN},
r AS (SELECT cmp AS ref, frame AS t0, state <> lag(state) OVER w AS moved, lag(state, 2) OVER w AS s0, lead(state, 1) OVER w AS s1 FROM ev WINDOW w AS (PARTITION BY cmp ORDER BY frame)),
k AS (SELECT ref, t0, CASE WHEN moved THEN 'move' ELSE 'stay' END || CASE WHEN s0 = s1 THEN '-same' ELSE '-different' END AS kind FROM r WHERE s0 IS NOT NULL AND s1 IS NOT NULL),
n AS (
  SELECT k.kind, (SELECT count(*) FROM own o WHERE o.ref = k.ref AND o.frame = k.t0 - 2) AS b, (SELECT count(*) FROM own o WHERE o.ref = k.ref AND o.frame = k.t0 + 1) AS a,
         (SELECT count(*) FROM own o JOIN own q ON o.ref = q.ref AND o.sel = q.sel WHERE o.ref = k.ref AND o.frame = k.t0 - 2 AND q.frame = k.t0 + 1) AS c FROM k)
SELECT kind, count(*) AS n_events, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after, CAST(sum(c) AS BIGINT) AS common, CAST(sum(a - c) AS BIGINT) AS attached, CAST(sum(b - c) AS BIGINT) AS detached
FROM n GROUP BY kind""")
def contacts_at_moves(spark, sf_dir):
    return events.contacts_at_moves(_user_runs(spark, sf_dir, "meetings", apart=(3, 3)), _user_states(spark, sf_dir), 1)


_BLOCKS = """
vb AS (SELECT *, lead(state) OVER q AS to_, lead(t0) OVER q AS to_t0 FROM runs WHERE len >= 2 WINDOW q AS (PARTITION BY cmp ORDER BY run)),
mv AS (
  SELECT cmp, CAST(t0 + len - 1 AS INTEGER) AS frame, CAST(to_t0 - t0 - len AS INTEGER) AS gap,
         CASE WHEN state < to_ THEN 'left2right' WHEN state > to_ THEN 'right2left' WHEN nxt > state THEN 'l2r_unsucc' ELSE 'r2l_unsucc' END AS kind
  FROM vb WHERE to_ IS NOT NULL AND to_t0 - t0 - len <= 6)"""


#: Frames from 1 before a move to 1 after it, with gaps of up to 6.
_APART = (3, 9)


def _blocks_sql(select: str) -> str:
    from framewalk.plans.tables import RUNS_SQL

    return f"WITH {_OWN}, {RUNS_SQL}, {_BLOCKS} {select}"


@query(_blocks_sql("SELECT * FROM mv"))
def block_transitions(spark, sf_dir):
    return events.block_transitions(_user_states(spark, sf_dir), 2, 6)


@query(_blocks_sql(""", n AS (
  SELECT kind, (SELECT count(*) FROM own o WHERE o.ref = m.cmp AND o.frame = m.frame - 1) AS b, (SELECT count(*) FROM own o WHERE o.ref = m.cmp AND o.frame = m.frame + gap + 2) AS a,
         (SELECT count(*) FROM own o JOIN own q ON o.ref = q.ref AND o.sel = q.sel WHERE o.ref = m.cmp AND o.frame = m.frame - 1 AND q.frame = m.frame + gap + 2) AS c FROM mv m)
SELECT kind, count(*) AS n_events, round(avg(b), 6) + 0.0 AS avg_before, round(avg(a), 6) + 0.0 AS avg_after, round(avg(c), 6) + 0.0 AS avg_common, round(avg(a - c), 6) + 0.0 AS avg_attached, round(avg(b - c), 6) + 0.0 AS avg_detached
FROM n GROUP BY kind"""))
def contacts_at_block_transitions(spark, sf_dir):
    moves = events.block_transitions(_user_states(spark, sf_dir), 2, 6)
    made = events.contacts_at_block_transitions(_user_runs(spark, sf_dir, "meetings", apart=_APART), moves, 1)
    return made.withColumns({c: _round(F.col(c)) for c in made.columns if c.startswith("avg")})


_STATS = ", ".join(f"round(avg(CASE WHEN counted THEN {t}.{c} END) + 1e-9, 5) + 0.0 AS {c}_{n}" for t, n in (("b", "before"), ("a", "after")) for c in ("mean", "var", "min", "max"))
_STATS += ", " + ", ".join(f"round(avg(CASE WHEN counted THEN abs(b.{c} - a.{c}) END) + 1e-9, 5) + 0.0 AS {c}_change" for c in ("mean", "var", "min", "max"))


@query(_blocks_sql(f""", hb AS (
  SELECT cmp, state, CAST(t0 + len - 1 AS INTEGER) AS frame, CAST(lead(t0) OVER q - t0 - len AS INTEGER) AS gap, lead(state) OVER q AS to_, lag(state) OVER q AS prev, t0 - lag(t0 + len) OVER q AS pre
  FROM runs WHERE len >= 2 WINDOW q AS (PARTITION BY cmp ORDER BY run)),
hm AS (SELECT cmp, frame, gap, CASE WHEN state = to_ THEN 'unsuccessful' WHEN state < to_ THEN 'left2right' ELSE 'right2left' END AS kind, prev, gap <= 6 AS valid, gap <= 6 AND pre <= 6 AS counted FROM hb WHERE prev IS NOT NULL AND to_ IS NOT NULL),
st AS (SELECT frame, ref, count(*) AS n, avg(sel) AS mean, var_pop(sel) AS var, min(sel) AS min, max(sel) AS max FROM own GROUP BY ALL),
hc AS (SELECT *, (SELECT count(*) FROM own o JOIN own q ON o.ref = q.ref AND o.sel = q.sel WHERE o.ref = m.cmp AND o.frame = m.frame - 1 AND q.frame = m.frame + gap + 2) AS common FROM hm m)
SELECT h.kind, CAST(h.prev AS INTEGER) AS prev, count(*) AS n_moves, count(CASE WHEN valid THEN 1 END) AS n_valid, count(CASE WHEN counted THEN 1 END) AS n_counted,
       round(avg(gap) + 1e-9, 5) + 0.0 AS gap, round(avg(CASE WHEN valid THEN gap END) + 1e-9, 5) + 0.0 AS gap_valid, round(avg(CASE WHEN counted THEN gap END) + 1e-9, 5) + 0.0 AS gap_counted,
       round(avg(CASE WHEN counted THEN coalesce(b.n, 0) - common END) + 1e-9, 5) + 0.0 AS detached, round(avg(CASE WHEN counted THEN coalesce(a.n, 0) - common END) + 1e-9, 5) + 0.0 AS attached,
       round(avg(CASE WHEN counted THEN common END) + 1e-9, 5) + 0.0 AS remain, {_STATS}
FROM hc h LEFT JOIN st b ON b.ref = h.cmp AND b.frame = h.frame - 1 LEFT JOIN st a ON a.ref = h.cmp AND a.frame = h.frame + gap + 2 GROUP BY h.kind, h.prev"""))
def partners_at_block_transitions(spark, sf_dir):
    moves = events.block_transitions_with_history(_user_states(spark, sf_dir), 2, 6)
    made = events.partners_at_block_transitions(_user_runs(spark, sf_dir, "meetings", apart=_APART), moves, 1)
    return made.withColumns({c: _tie5(F.col(c)) for c in made.columns if made.schema[c].dataType.typeName() == "double"})


# ---- displacements


_MSD = """
p AS (SELECT b.frame - a.frame AS lag, {g} (b.x - a.x) ** 2 AS dx2, (b.y - a.y) ** 2 AS dy2, (b.z - a.z) ** 2 AS dz2, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz
      FROM ev a JOIN ev b ON a.cmp = b.cmp AND b.frame >= a.frame WHERE a.frame % {r} = 0)"""


@query(f"""WITH {EVENTS_SQL}, {_MSD.format(g='', r=5)}
SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, round(avg(dx2) + 1e-8, 4) + 0.0 AS msd_x, round(avg(dy2) + 1e-8, 4) + 0.0 AS msd_y, round(avg(dz2) + 1e-8, 4) + 0.0 AS msd_z, round(avg(dx2) + avg(dy2) + avg(dz2) + 1e-8, 4) + 0.0 AS msd FROM p GROUP BY lag""")
def msd(spark, sf_dir):
    rows = positions(spark, sf_dir)
    made = dynamics.msd(rows, "cmp", states.n_frames_of(rows), restart=5)
    return made.withColumns({c: _tie(F.col(c), 4) for c in ("msd_x", "msd_y", "msd_z", "msd")})


@query(f"""WITH {EVENTS_SQL}, {_MSD.format(g='', r=1)}
SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, round(avg(dx2) + 1e-8, 4) + 0.0 AS msd_x, round(avg(dy2) + 1e-8, 4) + 0.0 AS msd_y, round(avg(dz2) + 1e-8, 4) + 0.0 AS msd_z, round(avg(dx2) + avg(dy2) + avg(dz2) + 1e-8, 4) + 0.0 AS msd FROM p GROUP BY lag""")
def msd_all_starts(spark, sf_dir):
    made = dynamics.msd_all_lags(positions(spark, sf_dir), "cmp")
    return made.withColumns({c: _tie(F.col(c), 4) for c in ("msd_x", "msd_y", "msd_z", "msd")})


@query(f"""WITH {EVENTS_SQL}, {_MSD.format(g='a.state2 AS layer, a.frame AS f0,', r=5)}
SELECT layer, CAST(lag AS INTEGER) AS lag, count(*) AS n, round(avg(dx) + 1e-8, 4) + 0.0 AS md_x, round(avg(dy) + 1e-8, 4) + 0.0 AS md_y, round(avg(dz) + 1e-8, 4) + 0.0 AS md_z,
       round(avg(dx2) + 1e-8, 4) + 0.0 AS msd_x, round(avg(dy2) + 1e-8, 4) + 0.0 AS msd_y, round(avg(dz2) + 1e-8, 4) + 0.0 AS msd_z FROM p WHERE f0 < (SELECT max(frame) FROM ev) GROUP BY ALL""")
def msd_by_layer(spark, sf_dir):
    rows = user_events(spark, sf_dir)
    made = dynamics.msd_by_layer(positions(spark, sf_dir), "cmp", rows.select("cmp", "frame", F.col("state2").alias("layer")), states.n_frames_of(rows), restart=5)
    return made.withColumns({c: _tie(F.col(c), 4) for c in made.columns if c.startswith("m")})


@query(f"""WITH {EVENTS_SQL}, {_MSD.format(g='a.state2 AS layer, a.frame AS f0,', r=1)}
SELECT layer, CAST(lag AS INTEGER) AS lag, count(*) AS n, round(avg(dx) + 1e-8, 4) + 0.0 AS md_x, round(avg(dy) + 1e-8, 4) + 0.0 AS md_y, round(avg(dz) + 1e-8, 4) + 0.0 AS md_z,
       round(avg(dx2) + 1e-8, 4) + 0.0 AS msd_x, round(avg(dy2) + 1e-8, 4) + 0.0 AS msd_y, round(avg(dz2) + 1e-8, 4) + 0.0 AS msd_z FROM p WHERE f0 < (SELECT max(frame) FROM ev) GROUP BY ALL""")
def msd_by_layer_all_starts(spark, sf_dir):
    rows = user_events(spark, sf_dir)
    made = dynamics.msd_by_layer_all_lags(positions(spark, sf_dir), "cmp", rows.select("cmp", "frame", F.col("state2").alias("layer")), states.n_frames_of(rows))
    return made.withColumns({c: _tie(F.col(c), 4) for c in made.columns if c.startswith("m")})


@query(f"""WITH {EVENTS_SQL}, {_MSD.format(g='', r=5)}, m AS (SELECT lag, avg(dx2) + avg(dy2) + avg(dz2) AS msd FROM p WHERE lag >= 1 AND lag <= 20 GROUP BY lag),
s AS (SELECT sum(lag * msd) / sum(lag * lag) AS s FROM m)
SELECT round(any_value(s) / 6, 5) + 0.0 AS "D", round(sqrt(sum((msd - s * lag) ** 2) / ((count(*) - 1) * sum(lag * lag))) / 6, 5) + 0.0 AS "D_sd", count(*) AS n FROM m, s""")
def fit_einstein(spark, sf_dir):
    rows = positions(spark, sf_dir)
    made = fits.fit_einstein(dynamics.msd(rows, "cmp", states.n_frames_of(rows), restart=5), [], "lag", "msd", 3, 1, 20)
    return made.select(_round(F.col("D"), 5).alias("D"), _round(F.col("D_sd"), 5).alias("D_sd"), "n")


@query(f"""WITH {EVENTS_SQL}, {_MSD.format(g='', r=1)}, m AS (SELECT lag, avg(dx2) + avg(dy2) + avg(dz2) AS msd FROM p WHERE lag >= 1 AND lag <= 20 GROUP BY lag),
s AS (SELECT sum(lag * msd) / sum(lag * lag) AS s FROM m)
SELECT round(any_value(s) / 6, 5) + 0.0 AS "D", round(sqrt(sum((msd - s * lag) ** 2) / ((count(*) - 1) * sum(lag * lag))) / 6, 5) + 0.0 AS "D_sd", count(*) AS n FROM m, s""")
def fit_einstein_all_starts(spark, sf_dir):
    made = fits.fit_einstein(dynamics.msd_all_lags(positions(spark, sf_dir), "cmp"), [], "lag", "msd", 3, 1, 20)
    return made.select(_round(F.col("D"), 5).alias("D"), _round(F.col("D_sd"), 5).alias("D_sd"), "n")


@query(f"""
WITH {EVENTS_SQL},
s AS (SELECT cmp, frame, x, y, z, {", ".join(f"coalesce(-floor({a} / {b} - lag({a}) OVER w / {b} + 0.5), 0) AS s{a}" for a, b in zip("xyz", (60.0, 14.4, 10.0)))} FROM (SELECT cmp, frame, x - 60 * floor(x / 60) AS x, y - 14.4 * floor(y / 14.4) AS y, z - 10 * floor(z / 10) AS z FROM ev) WINDOW w AS (PARTITION BY cmp ORDER BY frame))
SELECT cmp, frame, {", ".join(f"round({a} + {b} * sum(s{a}) OVER u, 4) + 0.0 AS {a}" for a, b in zip("xyz", (60.0, 14.4, 10.0)))} FROM s WINDOW u AS (PARTITION BY cmp ORDER BY frame ROWS UNBOUNDED PRECEDING)""")
def unwrap_scaling(spark, sf_dir):
    rows = positions(spark, sf_dir)
    n = states.n_frames_of(rows)
    small = boxes(spark, n).select("frame", F.lit(60.0).alias("lx"), F.lit(14.4).alias("ly"), F.lit(10.0).alias("lz"))
    made = dynamics.unwrap(dynamics.wrap(rows, small), small, "cmp", "scaling")
    return made.select("cmp", "frame", *(_round(F.col(a), 4).alias(a) for a in "xyz"))


@query(f"""
WITH {EVENTS_SQL}, r AS (SELECT cmp, x AS rx, y AS ry, z AS rz FROM ev WHERE frame = 0),
d AS (SELECT frame, x - rx AS dx, y - ry AS dy, z - rz AS dz, r.cmp % 7 + 1 AS w FROM ev JOIN r ON ev.cmp = r.cmp)
SELECT frame, count(*) AS n, {", ".join(f"round(sum(w * (d{a} - floor(d{a} / {b} + 0.5) * {b}) ** 2) / sum(w) / count(*), 6) + 0.0 AS msd_{a}" for a, b in zip("xyz", BOX))},
       round(sqrt(({" + ".join(f"sum(w * (d{a} - floor(d{a} / {b} + 0.5) * {b}) ** 2)" for a, b in zip("xyz", BOX))}) / sum(w) / count(*)), 6) + 0.0 AS rmsd
FROM d GROUP BY frame""")
def rmsd_vs_time(spark, sf_dir):
    rows = positions(spark, sf_dir).withColumn("w", F.col("cmp") % 7 + 1)
    made = dynamics.rmsd_vs_time(rows, "cmp", 0, weight="w", boxes=boxes(spark, states.n_frames_of(rows)))
    return made.select("frame", "n", *(_round(F.col(c)).alias(c) for c in ("msd_x", "msd_y", "msd_z", "rmsd")))


# ---- grids


_EDGES = [0.0, 0.1, 0.3, 0.6, 1.0]


@query(f"""
WITH {EVENTS_SQL}, r AS (SELECT cmp, frame, z / {BOX[2]} - floor(z / {BOX[2]}) AS u FROM ev)
SELECT cmp, frame, CAST(CASE WHEN u < 0.1 THEN 0 WHEN u < 0.3 THEN 1 WHEN u < 0.6 THEN 2 ELSE 3 END AS INTEGER) AS state FROM r""")
def discrete_positions(spark, sf_dir):
    rows = positions(spark, sf_dir)
    return binning.discrete_positions(rows, boxes(spark, states.n_frames_of(rows)), "z", _EDGES)


@query(f"""
WITH {EVENTS_SQL}, r AS (SELECT least(9, floor((x / {BOX[0]} - floor(x / {BOX[0]})) * 10)) AS bx, least(11, floor((y / {BOX[1]} - floor(y / {BOX[1]})) * 12)) AS "by", z / {BOX[2]} - floor(z / {BOX[2]}) AS u FROM ev),
g AS (SELECT CAST(a AS INTEGER) AS bx, CAST(b AS INTEGER) AS "by" FROM range(0, 10) AS p(a), range(0, 12) AS q(b))
SELECT g.bx, g."by", count(r.bx) AS n, round(count(r.bx) / ((SELECT max(frame) + 1 FROM ev) * ({BOX[0]} * {BOX[1]} / 120) * {BOX[2]} * 0.5), 9) + 0.0 AS density
FROM g LEFT JOIN r ON g.bx = r.bx AND g."by" = r."by" AND u >= 0.25 AND u < 0.75 GROUP BY ALL""")
def density_map(spark, sf_dir):
    rows = positions(spark, sf_dir)
    made = binning.density_map(rows, boxes(spark, states.n_frames_of(rows)), ("x", "y"), "z", (0.25, 0.75), (10, 12))
    return made.withColumn("density", F.round("density", 9) + F.lit(0.0))


@query(f"""
WITH {EVENTS_SQL}, q AS (SELECT frame, x, y, z, (state + 1) * 0.5 - 0.75 AS q FROM ev), c(c) AS (VALUES (20.0), (30.0), (50.0)),
b AS (SELECT c.c, q.frame, floor(x / c) AS cx, floor(y / c) AS cy, floor(z / c) AS cz, sum(q) AS q, count(*) AS n FROM q CROSS JOIN c
      WHERE floor(x / c) < floor({BOX[0]} / c) AND floor(y / c) < floor({BOX[1]} / c) AND floor(z / c) < floor({BOX[2]} / c) GROUP BY ALL),
k AS (SELECT c AS length, CAST(floor({BOX[0]} / c) * floor({BOX[1]} / c) * floor({BOX[2]} / c) * (SELECT max(frame) + 1 FROM ev) AS BIGINT) AS n_cubes FROM c)
SELECT CAST(k.length AS DOUBLE) AS length, n_cubes, CAST(sum(n) AS BIGINT) AS n_atoms, round(sum(q) / n_cubes, 6) + 0.0 AS mean_q, round(sum(q * q) / n_cubes, 6) + 0.0 AS mean_q2
FROM k JOIN b ON k.length = b.c GROUP BY k.length, n_cubes""")
def subvolume_charge(spark, sf_dir):
    rows = user_events(spark, sf_dir).select("frame", "x", "y", "z", ((F.col("state") + 1) * 0.5 - 0.75).alias("q"))
    made = binning.subvolume_charge(rows, boxes(spark, states.n_frames_of(rows)), [20.0, 30.0, 50.0])
    return made.withColumns({c: _round(F.col(c)) for c in ("mean_q", "mean_q2")})


_SITES = [(k, 30.0 + 120.0 * (k % 5), 24.0 + 48.0 * (k // 5)) for k in range(15)]


@query(f"""
WITH {EVENTS_SQL}, s(site, sx, sy) AS (VALUES {", ".join(map(str, _SITES))}),
d AS (SELECT cmp, frame, z, site, (x - sx - floor((x - sx) / {BOX[0]} + 0.5) * {BOX[0]}) ** 2 + (y - sy - floor((y - sy) / {BOX[1]} + 0.5) * {BOX[1]}) ** 2 AS d2 FROM ev CROSS JOIN s)
SELECT cmp, frame, CAST(CASE WHEN any_value(z) >= 20 AND any_value(z) < 80 THEN arg_min(site, struct_pack(d := d2, s := site)) ELSE -1 END AS INTEGER) AS state FROM d GROUP BY cmp, frame""")
def nearest_site(spark, sf_dir):
    sites = spark.createDataFrame(_SITES, "site int, x double, y double")
    return binning.nearest_site(positions(spark, sf_dir), sites, BOX[:2], (20.0, 80.0))


@query(f"""
WITH {EVENTS_SQL}, a(x0, y0, ux, uy) AS (VALUES (0.0, 72.0, 1.0, 0.0), (300.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.6, 0.8)),
k AS (SELECT (x - x0) * ux + (y - y0) * uy AS s, abs((y - y0) * ux - (x - x0) * uy) AS d FROM ev CROSS JOIN a),
b AS (SELECT CAST(v AS INTEGER) AS bin, v * 50.0 AS lo, v * 50.0 + 50.0 AS hi FROM range(0, 12) AS r(v))
SELECT b.bin, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, count(k.s) AS n FROM b LEFT JOIN k ON d <= 10 AND s >= lo AND (s < hi OR (bin = 11 AND s = hi)) GROUP BY ALL""")
def axial_distribution(spark, sf_dir):
    axes = [(0.0, 72.0, 1.0, 0.0), (300.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.6, 0.8)]
    return binning.axial_distribution(positions(spark, sf_dir), axes, 20.0, [50.0 * k for k in range(13)])


@query(f"""
WITH {EVENTS_SQL}
SELECT cmp, frame, (CASE WHEN x < 0 THEN 0 WHEN x < 10 THEN 1 WHEN x < 50 THEN 2 ELSE 3 END * 4 + CASE WHEN z < 20 THEN 0 WHEN z < 50 THEN 1 WHEN z < 90 THEN 2 ELSE 3 END)::INTEGER AS cell
FROM ev WHERE z >= 20 AND z < 90""")
def assign_to_grid(spark, sf_dir):
    rows = binning.assign_to_grid(positions(spark, sf_dir), {"x": [0.0, 10.0, 50.0], "z": [20.0, 50.0, 90.0]})
    return rows.where("bz > 0 and bz < 3").select("cmp", "frame", "cell")
