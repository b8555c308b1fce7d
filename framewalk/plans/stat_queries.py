"""Queries of the statistics, sequence, array, text and model operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewalk.functions import arrays, models, text
from framewalk.operators import binning, changes, dynamics, fits, normal_fits, sequences, stats
from framewalk.plans.tables import EVENTS_SQL, events, series, table
from framewalk.sources import selection, slicing

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _round(c, places: int = 6):
    """Rounded, values half-way between two being moved up a little on both sides."""
    return F.round(c + 1e-9, places) + F.lit(0.0)


# ---- statistics


_CEN = f"{EVENTS_SQL}, s AS (SELECT cmp AS id, frame AS t, x, x - avg(x) OVER (PARTITION BY cmp) AS c FROM ev)"


@query(f"""
WITH {_CEN}, p AS (SELECT a.id, b.t - a.t AS lag, sum(a.c * b.c) AS v FROM s a JOIN s b ON a.id = b.id AND b.t >= a.t GROUP BY ALL)
SELECT id, CAST(lag AS INTEGER) AS lag, round(v / max(CASE WHEN lag = 0 THEN v END) OVER (PARTITION BY id) + 1e-9, 6) + 0.0 AS acf FROM p""")
def acf(spark, sf_dir):
    return stats.acf(series(spark, sf_dir)).withColumn("acf", _round(F.col("acf")))


@query(f"""
WITH {_CEN}, p AS (SELECT a.id, b.t - a.t AS lag, sum(a.c * b.c) AS v FROM s a JOIN s b ON a.id = b.id AND b.t >= a.t GROUP BY ALL)
SELECT id, CAST(lag AS INTEGER) AS lag, round(v / max(CASE WHEN lag = 0 THEN v END) OVER (PARTITION BY id) + 1e-9, 6) + 0.0 AS acf FROM p""")
def acf_all_lags(spark, sf_dir):
    return stats.acf_all_lags(series(spark, sf_dir)).withColumn("acf", _round(F.col("acf")))


@query(f"""
WITH {_CEN}, p AS (SELECT a.id, b.t - a.t AS lag, sum(a.x * b.x) / count(*) AS v FROM s a JOIN s b ON a.id = b.id AND b.t >= a.t AND (b.t - a.t) % 2 = 0 AND b.t - a.t < 20 AND a.t % greatest(1, b.t - a.t) = 0 GROUP BY ALL)
SELECT id, CAST(lag AS INTEGER) AS lag, round(v / max(CASE WHEN lag = 0 THEN v END) OVER (PARTITION BY id) + 1e-9, 6) + 0.0 AS acf FROM p""")
def acf_options(spark, sf_dir):
    return stats.acf(series(spark, sf_dir), dt=None, dtau=2, tau_max=20, center=False, unbiased=True).withColumn("acf", _round(F.col("acf")))


@query(f"""
WITH {_CEN}, p AS (SELECT a.id, b.t - a.t AS lag, sum(a.c * b.c) AS v FROM s a JOIN s b ON a.id = b.id AND b.t >= a.t GROUP BY ALL),
r AS (SELECT id, lag, v / max(CASE WHEN lag = 0 THEN v END) OVER (PARTITION BY id) AS r, count(*) OVER (PARTITION BY id) AS n FROM p),
e AS (SELECT id, lag, CASE WHEN lag = 0 THEN 0 ELSE sqrt((1 + 2 * (sum(r * r) OVER (PARTITION BY id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1)) / n) END AS se FROM r)
SELECT id, CAST(lag AS INTEGER) AS lag, round(se + 1e-9, 6) + 0.0 AS se, round(se * 1.959963984540054 + 1e-9, 6) + 0.0 AS ci FROM e""")
def acf_confint(spark, sf_dir):
    made = stats.acf_confint(stats.acf(series(spark, sf_dir)))
    return made.select("id", "lag", _round(F.col("se")).alias("se"), _round(F.col("ci")).alias("ci"))


@query(f"WITH {EVENTS_SQL} SELECT cmp AS id, frame AS t, round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) + 1e-9, 6) + 0.0 AS x FROM ev WINDOW w AS (PARTITION BY cmp)")
def standardize(spark, sf_dir):
    return stats.standardized(series(spark, sf_dir), ["id"], "x", 1).withColumn("x", _round(F.col("x")))


@query(f"WITH {EVENTS_SQL} SELECT cmp AS id, frame AS t, round(x - avg(x) OVER (PARTITION BY cmp) + 1e-9, 6) + 0.0 AS x FROM ev")
def center(spark, sf_dir):
    return stats.centered(series(spark, sf_dir), ["id"], "x").withColumn("x", _round(F.col("x")))


@query(f"WITH {EVENTS_SQL} SELECT cmp AS id, frame AS t, round(avg(x) OVER (PARTITION BY cmp ORDER BY frame ROWS UNBOUNDED PRECEDING) + 1e-9, 6) + 0.0 AS x FROM ev")
def cumav(spark, sf_dir):
    return stats.cumav(series(spark, sf_dir)).withColumn("x", _round(F.col("x")))


@query(f"""
WITH {EVENTS_SQL}, m AS (SELECT cmp AS id, frame AS t, avg(x) OVER w AS x, count(*) OVER w AS k FROM ev WINDOW w AS (PARTITION BY cmp ORDER BY frame ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT id, t, round(x + 1e-9, 6) + 0.0 AS x FROM m WHERE k = 5""")
def movav(spark, sf_dir):
    return stats.movav(series(spark, sf_dir), 5).withColumn("x", _round(F.col("x")))


@query("""
WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, round(avg(x ** 4) / (3 * avg(x * x) ** 2) - 1 + 1e-9, 6) + 0.0 AS ngp FROM v GROUP BY label""")
def ngp(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return stats.ngp_by(rows, ["label"], "x").withColumn("ngp", _round(F.col("ngp")))


@query("""
WITH m AS (SELECT l_returnflag AS k, avg(l_quantity) AS m FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(avg((l_quantity - m) ** 4) / (5 / 3.0::DOUBLE * avg((l_quantity - m) ** 2) ** 2) - 1 + 1e-9, 6) + 0.0 AS ngp FROM lineitem JOIN m ON l_returnflag = k GROUP BY l_returnflag""")
def ngp_centered(spark, sf_dir):
    return stats.ngp_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 3, center=True).withColumn("ngp", _round(F.col("ngp")))


@query("""
WITH m AS (SELECT l_returnflag AS k, sum(l_quantity * l_discount) / sum(l_quantity) AS m FROM lineitem GROUP BY ALL),
v AS (SELECT l_returnflag, any_value(m) AS m, sum(l_quantity * (l_discount - m) ** 2) / sum(l_quantity) AS v FROM lineitem JOIN m ON l_returnflag = k GROUP BY ALL)
SELECT l_returnflag, round(m + 1e-9, 6) + 0.0 AS mean, round(v + 1e-9, 6) + 0.0 AS var, round(sqrt(v) + 1e-9, 6) + 0.0 AS std FROM v""")
def var_weighted(spark, sf_dir):
    made = stats.weighted_moments(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")
    return made.withColumns({c: _round(F.col(c)) for c in ("mean", "var", "std")})


@query(f"""
WITH {EVENTS_SQL}, b AS (SELECT frame % 5 AS block, state, avg(x) AS m FROM ev GROUP BY ALL)
SELECT state, round(avg(m) + 1e-9, 6) + 0.0 AS mean, round(stddev_samp(m) / sqrt(count(*)) + 1e-9, 6) + 0.0 AS sd FROM b GROUP BY state""")
def block_average(spark, sf_dir):
    blocks = events(spark, sf_dir).groupBy((F.col("frame") % 5).alias("block"), "state").agg(F.avg("x").alias("m"))
    made = dynamics.block_average(blocks, ["state"], "m", 1)
    return made.select("state", _round(F.col("mean")).alias("mean"), _round(F.col("sd")).alias("sd"))


@query("""
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity) + 1e-9, 6) + 0.0 AS mean, round(stddev_samp(l_quantity) / sqrt(count(*)) + 1e-9, 6) + 0.0 AS se, round(stddev_samp(l_quantity) + 1e-9, 6) + 0.0 AS std,
       round(stddev_samp(l_quantity) / avg(l_quantity) + 1e-9, 6) + 0.0 AS cv, round(skewness(l_quantity) + 1e-9, 6) + 0.0 AS skew, round(kurtosis(l_quantity) + 1e-9, 6) + 0.0 AS kurt, median(l_quantity) AS median,
       min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity) + 1e-9, 6) + 0.0 AS m1, round(avg(l_quantity ** 2) + 1e-9, 4) + 0.0 AS m2
FROM lineitem GROUP BY l_returnflag""")
def describe(spark, sf_dir):
    made = stats.describe(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return made.select("l_returnflag", "n", *(_round(F.col(c)).alias(c) for c in ("mean", "se", "std", "cv", "skew", "kurt")), "median", "min", "max", _round(F.col("m1")).alias("m1"), _round(F.col("m2"), 4).alias("m2"))


@query("""
SELECT l_returnflag, round(avg(l_quantity ** 3) - 3 * avg(l_quantity) * avg(l_quantity ** 2) + 2 * avg(l_quantity) ** 3 + 1e-9, 3) + 0.0 AS mu3, round(avg(l_quantity ** 2) - avg(l_quantity) ** 2 + 1e-9, 5) + 0.0 AS mu2 FROM lineitem GROUP BY l_returnflag""")
def moment_raw2cen(spark, sf_dir):
    q = F.col("l_quantity")
    made = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg(q).alias("a"), F.avg(q * q).alias("b"), F.avg(q * q * q).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return made.select("l_returnflag", _round(arrays.moment_raw2cen([a, b, c]), 3).alias("mu3"), _round(arrays.moment_raw2cen([a, b]), 5).alias("mu2"))


@query(f"""
WITH {EVENTS_SQL}, c AS (SELECT cmp, frame, exp(-frame / (3.0 + cmp % 5)) AS s FROM ev),
a AS (SELECT cmp, (s + lag(s) OVER w) / 2 AS a1, (2 * frame * s + 2 * (frame - 1) * lag(s) OVER w) / 2 AS a2, s FROM c WINDOW w AS (PARTITION BY cmp ORDER BY frame))
SELECT cmp, CASE WHEN min(s) <= 0.01 THEN round(sum(a1) + 1e-9, 6) + 0.0 END AS m1, CASE WHEN min(s) <= 0.01 THEN round(sum(a2) + 1e-9, 6) + 0.0 END AS m2 FROM a GROUP BY cmp""")
def moments_of_survival(spark, sf_dir):
    curve = events(spark, sf_dir).select("cmp", "frame", F.exp(-F.col("frame") / (3.0 + F.col("cmp") % 5)).alias("s"))
    made = stats.moments_of_survival(curve, ["cmp"], "frame", "s", 2)
    return made.select("cmp", _round(F.col("m1")).alias("m1"), _round(F.col("m2")).alias("m2"))


@query(f"""
WITH {EVENTS_SQL}, c AS (SELECT cmp, frame, x, lag(x) OVER (PARTITION BY cmp ORDER BY frame) AS p FROM ev),
d AS (SELECT cmp, frame, CASE WHEN p IS NULL OR p = x THEN frame ELSE frame - 1 + (5 - p) / (x - p) END AS hit FROM c WHERE x <= 5)
SELECT cmp, round(arg_min(hit, frame) + 1e-9, 6) + 0.0 AS frame FROM d GROUP BY cmp""")
def first_crossing(spark, sf_dir):
    made = stats.first_crossing(events(spark, sf_dir), ["cmp"], "frame", "x", 5.0)
    return made.select("cmp", _round(F.col("frame")).alias("frame"))


@query(f"WITH {EVENTS_SQL} SELECT state, round(1 - sum((x - y) ** 2) / (var_pop(x) * count(*)) + 1e-9, 5) + 0.0 AS r2, round(sqrt(avg((x - y) ** 2)) + 1e-9, 5) + 0.0 AS rmse FROM ev GROUP BY state")
def fit_goodness(spark, sf_dir):
    made = stats.fit_goodness(events(spark, sf_dir), ["state"], "x", "y")
    return made.select("state", _round(F.col("r2"), 5).alias("r2"), _round(F.col("rmse"), 5).alias("rmse"))


@query(f"WITH {EVENTS_SQL} SELECT state, round(exp(regr_intercept(ln(x), ln(z))), 5) + 0.0 AS a, round(regr_slope(ln(x), ln(z)), 5) + 0.0 AS b FROM ev WHERE x > 0 AND z > 0 GROUP BY state")
def fit_power_law(spark, sf_dir):
    made = fits.fit_power_law(events(spark, sf_dir), ["state"], "z", "x")
    return made.select("state", (F.round("a", 5) + 0.0).alias("a"), (F.round("b", 5) + 0.0).alias("b"))


@query(f"""
WITH {EVENTS_SQL}, c AS (SELECT cmp AS id, frame AS t, n, x - avg(x) OVER (PARTITION BY cmp) AS c FROM ev),
k AS (SELECT id, n, unnest(range(0, n // 2 + 1)) AS k FROM (SELECT DISTINCT id, n FROM c))
SELECT k.id, round(any_value(k.k::DOUBLE / k.n), 6) + 0.0 AS frequency, round(sqrt(sum(c * cos(2 * pi() * k.k * t / k.n)) ** 2 + sum(c * sin(2 * pi() * k.k * t / k.n)) ** 2) + 1e-7, 5) + 0.0 AS amplitude
FROM k JOIN c ON k.id = c.id GROUP BY k.id, k.k""")
def spectrum(spark, sf_dir):
    made = fits.spectrum(series(spark, sf_dir))
    return made.select("id", (F.round("frequency", 6) + 0.0).alias("frequency"), (F.round(F.col("amplitude") + 1e-7, 5) + 0.0).alias("amplitude"))


_HIST = """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT label, CASE WHEN x = 4 THEN 31 ELSE CAST(floor((x + 4) / 0.25) AS INTEGER) END AS bin, count(*) AS n FROM x WHERE x >= -4 AND x <= 4 GROUP BY ALL),
g AS (SELECT label, CAST(v AS INTEGER) AS bin FROM (SELECT DISTINCT label FROM x), range(0, 32) AS r(v))
SELECT g.label, -4 + 0.25 * g.bin + 0.125 AS t, coalesce(n, 0) / sum(n) OVER (PARTITION BY g.label) / 0.25 AS y FROM g LEFT JOIN b ON g.label = b.label AND g.bin = b.bin"""


def _density(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    hist = binning.histogram(rows, F.col("x"), [-4.0 + 0.25 * k for k in range(33)], ["label"])
    total = F.sum("n").over(Window.partitionBy("label"))
    return hist.select("label", ((F.col("lo") + F.col("hi")) / 2).alias("c"), (F.col("n") / total / 0.25).alias("d"))


def _label_fit(made, *names):
    return made.select("label", "n", *((F.round(F.col(c) + 1e-7, 5) + F.lit(0.0)).alias(c) for x in names for c in (x, f"{x}_sd")))


def _label_sql(model, *names):
    return f"SELECT label, n, {', '.join(f'round({c} + 1e-7, 5) + 0.0 AS {c}' for x in names for c in (x, x + '_sd'))} FROM ({normal_fits.fit_sql(_HIST, model, ['label'])})"


@query(_label_sql("gaussian", "mu", "sigma"))
def fit_gaussian(spark, sf_dir):
    return _label_fit(normal_fits.fit_by_sums(_density(spark, sf_dir), "gaussian", ["label"], "c", "d"), "mu", "sigma")


@query(_label_sql("maxwell", "var", "drift"))
def fit_maxwell(spark, sf_dir):
    """The same bell by a function of another form: what the least squares make of it is the same in both engines."""
    return _label_fit(normal_fits.fit_by_sums(_density(spark, sf_dir), "maxwell", ["label"], "c", "d"), "var", "drift")


@query("""
WITH b AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, count(*)::DOUBLE AS n, avg(x) AS c FROM b GROUP BY label),
g AS (SELECT b.label, any_value(m.n) AS n, avg((x - c) ** 3) / avg((x - c) ** 2) ** 1.5 AS g, avg((x - c) ** 4) / avg((x - c) ** 2) ** 2 AS b FROM b JOIN m ON b.label = m.label GROUP BY b.label),
s AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta FROM g),
w AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2 FROM s),
zs AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, (b - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS q,
       6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS t FROM w),
za AS (SELECT *, 6 + 8 / t * (2 / t + sqrt(1 + 4 / (t * t))) AS a FROM zs), zr AS (SELECT *, (1 - 2 / a) / (1 + q * sqrt(2 / (a - 4))) AS r FROM za),
z AS (SELECT label, n, zs, (1 - 2 / (9 * a) - sign(r) * abs(r) ** (1 / 3.0::DOUBLE)) / sqrt(2 / (9 * a)) AS zk FROM zr)
SELECT label, CAST(n AS BIGINT) AS n, round(zs, 5) + 0.0 AS z_skew, round(zk, 5) + 0.0 AS z_kurt, round(zs * zs + zk * zk, 5) + 0.0 AS k2, round(exp(-(zs * zs + zk * zk) / 2), 6) + 0.0 AS p FROM z""")
def normal_test(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    made = stats.normal_test(rows, ["label"], "x")
    return made.select("label", "n", *((F.round(c, p) + F.lit(0.0)).alias(c) for c, p in (("z_skew", 5), ("z_kurt", 5), ("k2", 5), ("p", 6))))


@query("""
WITH w AS (SELECT p_type, min(p_retailprice) AS m, stddev_pop(p_retailprice) * cbrt(24 * sqrt(pi()) / count(*)) AS w, count(*) AS n FROM part GROUP BY p_type),
b AS (SELECT p.p_type, CAST(floor((p_retailprice - m) / w.w) AS INTEGER) AS bin, m, w.w AS w, w.n AS all_ FROM part p JOIN w ON p.p_type = w.p_type)
SELECT p_type, bin, round(any_value(m) + bin * any_value(w) + 1e-9, 6) + 0.0 AS lo, round(any_value(m) + bin * any_value(w) + any_value(w) + 1e-9, 6) + 0.0 AS hi, count(*) AS n, round(count(*) / (any_value(all_) * any_value(w)) + 1e-9, 6) + 0.0 AS density FROM b GROUP BY p_type, bin""")
def auto_histogram(spark, sf_dir):
    made = stats.auto_histogram(table(spark, sf_dir, "part"), ["p_type"], "p_retailprice")
    return made.select("p_type", "bin", _round(F.col("lo")).alias("lo"), _round(F.col("hi")).alias("hi"), "n", _round(F.col("density")).alias("density"))


# ---- sequences


@query(f"""
WITH {EVENTS_SQL}, b AS (SELECT cmp, frame, z, CASE WHEN abs(z - lag(z) OVER w - 1) > 10 THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY cmp ORDER BY frame))
SELECT cmp, frame, CAST(sum(b) OVER (PARTITION BY cmp ORDER BY frame ROWS UNBOUNDED PRECEDING) AS INTEGER) AS island FROM b""")
def islands(spark, sf_dir):
    return sequences.islands(events(spark, sf_dir), ["cmp"], "frame", "z", 1, 10.0).select("cmp", "frame", "island")


_CONST = f"""
{EVENTS_SQL}, cb AS (SELECT cmp, frame, state, CASE WHEN state <> lag(state) OVER w THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY cmp ORDER BY frame)),
ci AS (SELECT cmp, frame, state, sum(b) OVER (PARTITION BY cmp ORDER BY frame ROWS UNBOUNDED PRECEDING) AS island FROM cb),
cs AS (SELECT cmp, island, min(frame) AS start, count(*) AS length, avg(state) AS value FROM ci GROUP BY ALL)"""


@query(f"WITH {_CONST} SELECT cmp, CAST(island AS INTEGER) AS island, CAST(start AS INTEGER) AS start, length, value FROM cs")
def const_seqs(spark, sf_dir):
    return sequences.const_seqs(events(spark, sf_dir), ["cmp"], "frame", "state")


@query(f"WITH {_CONST} SELECT cmp, CAST(min(start) AS INTEGER) AS start, arg_min(length, start) AS length, arg_min(value, start) AS value FROM cs WHERE length >= 2 GROUP BY cmp")
def first_const_seq(spark, sf_dir):
    return sequences.first_const_seq(events(spark, sf_dir), ["cmp"], "frame", "state", 2)


@query(f"WITH {_CONST}, m AS (SELECT *, row_number() OVER (PARTITION BY cmp ORDER BY length DESC, start) AS r FROM cs) SELECT cmp, CAST(start AS INTEGER) AS start, length, value FROM m WHERE r = 1")
def longest_const_seq(spark, sf_dir):
    return sequences.longest_const_seq(events(spark, sf_dir), ["cmp"], "frame", "state")


@query("SELECT o_orderkey, 5 + 2 * (dense_rank() OVER (ORDER BY o_totalprice) - 1) AS seq FROM orders")
def sequenize(spark, sf_dir):
    return sequences.sequenize(table(spark, sf_dir, "orders"), "o_totalprice", 2, 5).select("o_orderkey", "seq")


@query(f"WITH {EVENTS_SQL} SELECT cmp, string_agg(CAST(state AS VARCHAR), ',' ORDER BY frame) AS states FROM ev GROUP BY cmp")
def group_by(spark, sf_dir):
    made = sequences.group_values(events(spark, sf_dir), "cmp", "state", "frame")
    return made.select("cmp", F.array_join(F.col("values").cast("array<string>"), ",").alias("states"))


@query(f"WITH {EVENTS_SQL} SELECT cmp, frame, state FROM ev WHERE frame >= 3 AND frame < 40 AND (frame - 3) % 4 = 0")
def slice_frames(spark, sf_dir):
    begin, end, every, _ = slicing.frame_slicing(3, 40, 4, 45)
    return sequences.slice_frames(events(spark, sf_dir), begin, 40 if end <= 40 else end, every).select("cmp", "frame", "state")


_MATRIX = f"{EVENTS_SQL}, m AS (SELECT CAST(frame % 12 AS INTEGER) AS i, CAST(state + 1 + 5 * (state2 % 2) AS INTEGER) AS j, count(*) AS v FROM ev GROUP BY ALL)"


def _matrix(spark, sf_dir):
    return events(spark, sf_dir).groupBy((F.col("frame") % 12).alias("i"), (F.col("state") + 1 + 5 * (F.col("state2") % 2)).alias("j")).agg(F.count("*").alias("v"))


@query(f"WITH {_MATRIX}, h AS (SELECT * FROM m WHERE i >= j) SELECT i, j, v FROM h UNION ALL SELECT j, i, v FROM h WHERE i <> j")
def symmetrize(spark, sf_dir):
    return sequences.symmetrize(_matrix(spark, sf_dir))


@query(f"WITH {_MATRIX} SELECT i, CAST((j - i + 120) % 10 AS INTEGER) AS j, v FROM m")
def tilt_diagonals(spark, sf_dir):
    return sequences.tilt_diagonals(_matrix(spark, sf_dir), 10)


@query(f"""WITH {_MATRIX}, a AS (SELECT i, (j - lag(j) OVER w) * (v + lag(v) OVER w) / 2 AS a FROM m WINDOW w AS (PARTITION BY i ORDER BY j)), r AS (SELECT i, coalesce(sum(a), 0) AS s FROM a GROUP BY i),
b AS (SELECT (i - lag(i) OVER (ORDER BY i)) * (s + lag(s) OVER (ORDER BY i)) / 2 AS b FROM r) SELECT round(sum(b) + 1e-9, 6) + 0.0 AS integral FROM b""")
def trapz2d(spark, sf_dir):
    return binning.trapezoid_2d(_matrix(spark, sf_dir), "i", "j", "v").select(_round(F.col("integral")).alias("integral"))


@query(f"WITH {_MATRIX} SELECT j, round(avg(v) + 1e-9, 6) + 0.0 AS v FROM m WHERE abs(i - 5) <= 1.5 GROUP BY j")
def cross_section(spark, sf_dir):
    return binning.cross_section(_matrix(spark, sf_dir), "i", 5, 3, "j", "v").withColumn("v", _round(F.col("v")))


@query(f"""
WITH {_MATRIX}, p AS (SELECT CAST(t AS BIGINT) AS i, 0.5 + t * 0.4 AS x, 0.25 + t * 0.35 AS y FROM range(0, 25) AS r(t)),
c AS (SELECT p.i, p.x, p.y, floor(x) + a AS r, floor(y) + b AS c, (CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) AS w FROM p, (VALUES (0), (1)) AS q(a), (VALUES (0), (1)) AS s(b)),
k AS (SELECT c.i, c.w, m.v FROM c LEFT JOIN m ON m.i = c.r AND m.j = c.c WHERE w > 0)
SELECT i, CASE WHEN count(v) = count(*) THEN round(sum(w * v) + 1e-9, 6) + 0.0 END AS z FROM k GROUP BY i""")
def cross_section_line(spark, sf_dir):
    points = spark.range(25).select(F.col("id").alias("i"), (F.lit(0.5) + F.col("id") * 0.4).alias("x"), (F.lit(0.25) + F.col("id") * 0.35).alias("y"))
    cells = _matrix(spark, sf_dir).select(F.col("i").cast("long").alias("r"), F.col("j").cast("long").alias("c"), F.col("v").alias("z"))
    return binning.bilinear(cells, points).select("i", _round(F.col("z")).alias("z"))


@query(f"""
WITH {EVENTS_SQL}, d AS (SELECT cmp AS id, frame AS t, (2 * lag(x, 2) OVER w - lag(x) OVER w - 2 * x - lead(x) OVER w + 2 * lead(x, 2) OVER w) / 7 AS d FROM ev WINDOW w AS (PARTITION BY cmp ORDER BY frame))
SELECT id, t, abs(coalesce(d, first_value(d IGNORE NULLS) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), last_value(d IGNORE NULLS) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))) <= 5 + 1e-9 AS linear FROM d""")
def find_linear_region(spark, sf_dir):
    return sequences.linear_region(series(spark, sf_dir), 5, 5.0 + 1e-9).select("id", "t", "linear")


# ---- arrays


@query("""
WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x, len(embedding) AS n FROM embeddings)
SELECT vec_id, CAST(arg_min(i, struct_pack(x := x, i := i)) AS INTEGER) AS first_min, CAST(arg_min(i, struct_pack(d := abs(x - 0.25::FLOAT), i := i)) AS INTEGER) AS at, round(arg_min(x, struct_pack(d := abs(x - 0.25::FLOAT), i := i)), 5)::DOUBLE AS value, any_value(n) AS n FROM l GROUP BY vec_id""")
def find_nearest(spark, sf_dir):
    rows, quarter = table(spark, sf_dir, "embeddings"), F.lit(0.25).cast("float")
    a = F.col("embedding")
    return rows.select("vec_id", arrays.find_nearest(a, F.array_min(a), True).cast("int").alias("first_min"), arrays.find_nearest(a, quarter, True).cast("int").alias("at"), F.round(arrays.find_nearest(a, quarter), 5).cast("double").alias("value"), F.size(a).cast("long").alias("n"))


_LIST = "SELECT cmp, list(state ORDER BY frame) AS a FROM ev GROUP BY cmp"


def _lists(spark, sf_dir):
    return sequences.group_values(events(spark, sf_dir), "cmp", "state", "frame").withColumnRenamed("values", "a")


@query(f"""
WITH {EVENTS_SQL}, l AS ({_LIST})
SELECT cmp, CAST(len(a) - list_position(list_reverse(a), list_max(a)) AS INTEGER) AS last_max, CAST(len(a) - list_position(list_reverse(a), list_min(a)) AS INTEGER) AS last_min,
       array_to_string(list_transform(a[3:20:4], lambda x: CAST(x AS VARCHAR)), ',') AS taken, CAST(list_sum(a[(len(a) - 3) // 2 + 1 : (len(a) - 3) // 2 + 3]) AS BIGINT) AS middle, greatest(len(a), 60) AS extended
FROM l""")
def array_functions(spark, sf_dir):
    a = F.col("a")
    total = F.aggregate(arrays.get_middle(a, 3), F.lit(0).cast("long"), lambda x, y: x + y)
    return _lists(spark, sf_dir).select(
        "cmp", arrays.argmax_last(a).cast("int").alias("last_max"), arrays.argmin_last(a).cast("int").alias("last_min"),
        F.array_join(arrays.take(a, 2, 20, 4).cast("array<string>"), ",").alias("taken"), total.alias("middle"), F.size(arrays.extend(a, 60, 9)).cast("long").alias("extended"),
    )


@query("SELECT p_partkey, CAST((CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 45 THEN 2 ELSE 3 END) * 4 + (CASE WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice < 1000 THEN 1 WHEN p_retailprice < 1100 THEN 2 ELSE 3 END) AS INTEGER) AS bin, CAST(CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 20 THEN 1 WHEN p_size <= 45 THEN 2 ELSE 3 END AS INTEGER) AS right_bin, CAST(-floor(-p_size / 7.0) AS BIGINT) AS ceiled FROM part")
def digitize_dd(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    edges = [[10, 20, 45], [950, 1000, 1100]]
    return table(spark, sf_dir, "part").select("p_partkey", arrays.digitize_dd([size, price], edges).alias("bin"), arrays.digitize(size, edges[0], True).alias("right_bin"), arrays.ceil_divide(size, F.lit(7)).cast("long").alias("ceiled"))


@query("""
WITH b AS (SELECT CAST(v AS INTEGER) AS bin, 900 + 20.0 * v AS lo, 920 + 20.0 * v AS hi FROM range(0, 10) AS r(v)), t AS (SELECT DISTINCT p_type FROM part)
SELECT t.p_type, b.bin, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, count(p.p_partkey) AS n FROM t CROSS JOIN b LEFT JOIN part p ON p.p_type = t.p_type AND p_retailprice >= lo AND (p_retailprice < hi OR (bin = 9 AND p_retailprice = hi)) GROUP BY ALL""")
def histogram(spark, sf_dir):
    return binning.histogram(table(spark, sf_dir, "part"), F.col("p_retailprice"), [900.0 + 20 * k for k in range(11)], ["p_type"])


# ---- texts


@query("""
WITH RECURSIVE n AS (SELECT p_partkey, p_partkey + 1 AS v FROM part), r AS (
  SELECT p_partkey, v AS rest, '' AS s FROM n
  UNION ALL SELECT p_partkey, (rest - 1) // 26, chr(CAST(65 + (rest - 1) % 26 AS INTEGER)) || s FROM r WHERE rest > 0)
SELECT p_partkey, s AS name, p_partkey + 1 AS number, CAST(length(CAST(p_partkey AS VARCHAR)) - length(rtrim(CAST(p_partkey AS VARCHAR), '0')) AS INTEGER) AS zeros FROM r WHERE rest = 0""")
def excel_names(spark, sf_dir):
    key = F.col("p_partkey")
    name = text.excel_colname(key + 1)
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), text.excel_colnum(name).alias("number"), text.trailing_digits(key).alias("zeros"))


@query("SELECT p_partkey, regexp_replace(p_brand, '[0-9]', '', 'g') || CAST(row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_partkey) AS VARCHAR) AS p_brand FROM part")
def number_names(spark, sf_dir):
    return sequences.number_names(table(spark, sf_dir, "part"), ["p_type", "p_size"], "p_partkey", "p_brand").select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_type, row_number() OVER (ORDER BY CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'ECONOMY' THEN 2 ELSE 3 END, p_partkey) AS place FROM part")
def sort_by_names(spark, sf_dir):
    rows = sequences.sort_by_names(table(spark, sf_dir, "part"), "p_type", ["STANDARD", "ECONOMY"], "p_partkey")
    rank = F.when(F.col("p_type") == "STANDARD", 1).when(F.col("p_type") == "ECONOMY", 2).otherwise(3)
    placed = sequences.sequenize(rows.withColumn("k", rank * 10**12 + F.col("p_partkey")), "k", 1, 1, "place")
    return placed.select("p_partkey", "p_type", "place")


@query("SELECT p_partkey FROM part WHERE (p_type LIKE 'ECO%' OR p_type = 'PROMO') AND NOT (p_partkey BETWEEN 10 AND 400) AND p_size > 20")
def select_atoms(spark, sf_dir):
    atoms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("atom_ix"), F.col("p_type").alias("type"), "p_size")
    return selection.select_atoms(atoms, "type ECO* PROMO and not index 10:400 and prop p_size > 20").select(F.col("atom_ix").alias("p_partkey"))


# ---- models


_FOURIER = ("p_size::DOUBLE", "(p_retailprice / 1000)", "0.7::DOUBLE", "(p_size / 10.0::DOUBLE)")


@query(f"""
WITH f AS (SELECT p_partkey, {", ".join(f"{c} AS c{k}" for k, c in enumerate(_FOURIER))} FROM part)
SELECT p_partkey, round(c1 + 0.5 * (c0 + c2) + 1e-9, 6) + 0.0 AS r0, round(0.5 * (3 * c2 - c0) + 1e-9, 6) + 0.0 AS r1, round(4 * c3 - c1 + 1e-9, 6) + 0.0 AS r2, round(-2 * c2 + 1e-9, 6) + 0.0 AS r3, round(-4 * c3 + 1e-9, 6) + 0.0 AS r4,
       0.0::DOUBLE AS r5, {", ".join(f"round(c{k} + 1e-9, 6) + 0.0 AS f{k}" for k in range(4))} FROM f""")
def fourier_to_rb(spark, sf_dir):
    c = [F.col("p_size").cast("double"), F.col("p_retailprice") / 1000, F.lit(0.7), F.col("p_size") / 10]
    rb = models.fourier_to_rb(c)
    back = models.rb_to_fourier(rb)
    return table(spark, sf_dir, "part").select("p_partkey", *(_round(x).alias(f"r{k}") if k < 5 else x.alias("r5") for k, x in enumerate(rb)), *(_round(x).alias(f"f{k}") for k, x in enumerate(back)))


@query(f"""
WITH {EVENTS_SQL}
SELECT event_id, round(exp(-((frame / 4.0::DOUBLE) ** 0.7)) + 1e-9, 6) + 0.0 AS kww, round(1 / ((1 + (frame / 4.0::DOUBLE) ** 1.3) ** 1.5) + 1e-9, 6) + 0.0 AS burr, round(exp(-0.5 * ((z - 50) / 20.0::DOUBLE) ** 2) / (sqrt(2 * pi()) * 20) + 1e-9, 6) + 0.0 AS gauss,
       round(exp(-0.1 * frame) + 1e-9, 6) + 0.0 AS decay, round(4 * pi() * (z / 30) ** 2 * (2 * pi() * 1.5::DOUBLE) ** -1.5 * exp(-((z / 30) ** 2) / 3.0::DOUBLE) + 1e-9, 6) + 0.0 AS mb, round(6 * 0.3 * frame + 1e-9, 6) + 0.0 AS msd,
       round(sqrt(frame / 10.0::DOUBLE) * exp(-frame / 10.0::DOUBLE) / (sqrt(pi()) / 2) + 1e-9, 6) + 0.0 AS ekin
FROM ev""")
def model_functions(spark, sf_dir):
    z = F.col("z")
    return events(spark, sf_dir).select(
        "event_id", _round(models.kww("frame", 4.0, 0.7)).alias("kww"), _round(models.burr12_sf("frame", 4.0, 1.3, 1.5)).alias("burr"), _round(models.gaussian("z", 50.0, 20.0)).alias("gauss"),
        _round(models.exp_decay("frame", 0.1)).alias("decay"), _round(models.mb_dist(z / 30, 1.5)).alias("mb"), _round(models.msd("frame", 0.3)).alias("msd"), _round(models.ekin_dist(F.col("frame") / 10, 1.0)).alias("ekin"),
    )


@query(f"""
WITH {EVENTS_SQL}
SELECT event_id, round(0.3 * frame - 2 + 1e-9, 6) + 0.0 AS line, round((z + 2) / 0.3::DOUBLE + 1e-9, 5) + 0.0 AS line_inv, round(-0.1 * frame + 1e-9, 6) + 0.0 AS decay_log, round(1 / (1 + (frame / 4.0::DOUBLE) ** 1.3) ** (2 / 1.3::DOUBLE) + 1e-9, 6) + 0.0 AS burr_alt,
       round(0.2 * exp(-0.2::DOUBLE * frame) + 1e-9, 6) + 0.0 AS exp_dist, round(ln(0.2::DOUBLE) - 0.2 * frame + 1e-9, 6) + 0.0 AS exp_dist_log, round(0.5 * frame ** 0.6::DOUBLE + 1e-9, 6) + 0.0 AS sub_diffusive, round(1.5 * (frame + 1.0::DOUBLE) ** 0.5 + 1e-9, 6) + 0.0 AS power
FROM ev""")
def more_model_functions(spark, sf_dir):
    made = {
        "line": models.line("frame", 0.3, -2.0), "line_inv": models.line_inv("z", 0.3, -2.0), "decay_log": models.exp_decay_log("frame", 0.1), "burr_alt": models.burr12_sf_alt("frame", 4.0, 1.3, 2.0),
        "exp_dist": models.exp_dist("frame", 0.2), "exp_dist_log": models.exp_dist_log("frame", 0.2), "sub_diffusive": models.msd_non_diffusive("frame", 0.5, 0.6), "power": models.power_law(F.col("frame") + 1, 1.5, 0.5),
    }
    return events(spark, sf_dir).select("event_id", *(_round(c, 5 if n == "line_inv" else 6).alias(n) for n, c in made.items()))


@query("WITH t AS (SELECT (p_partkey % 9 + 2) / 5.0::DOUBLE AS b, p_partkey, p_size FROM part) SELECT p_partkey, round((p_size + 1) / b * gamma(1 / b), 5) + 0.0 AS kww, CASE WHEN 3 * b > 1 THEN round((p_size + 1) * gamma(3 - 1 / b) * gamma(1 + 1 / b) / gamma(3.0::DOUBLE), 5) + 0.0 END AS burr FROM t")
def model_means(spark, sf_dir):
    tau, beta = F.col("p_size") + 1.0, (F.col("p_partkey") % 9 + 2) / 5
    return table(spark, sf_dir, "part").select("p_partkey", (F.round(models.kww_mean(tau, beta), 5) + 0.0).alias("kww"), (F.round(models.burr12_mean(tau, beta, 3.0), 5) + 0.0).alias("burr"))


@query(f"""
WITH {EVENTS_SQL}, t AS (SELECT cmp, frame, state2, lag(state2) OVER w AS p, lead(state2) OVER w AS nx FROM ev WINDOW w AS (PARTITION BY cmp ORDER BY frame))
SELECT cmp, frame, state2, 'before' AS pin FROM t WHERE nx - state2 = 1 UNION ALL SELECT cmp, frame, state2, 'after' FROM t WHERE state2 - p = 1""")
def item_change_positions(spark, sf_dir):
    rows = events(spark, sf_dir).select("cmp", "frame", "state2")
    return changes.change_positions(rows, ["cmp"], "frame", "state2", "both", change_type=1)


@query(f"""
WITH {EVENTS_SQL}, t AS (SELECT cmp, frame, state2, lag(state2) OVER (PARTITION BY cmp ORDER BY frame) AS p FROM ev)
SELECT cmp, frame, state2 FROM t WHERE p IS NULL OR state2 <> p""")
def first_items(spark, sf_dir):
    return changes.first_items(events(spark, sf_dir).select("cmp", "frame", "state2"), ["cmp"], "frame", "state2")


@query(f"""WITH {EVENTS_SQL}, l AS ({_LIST}), m AS (SELECT cmp, a, list_filter(a, lambda x: x >= 1) AS b FROM l)
SELECT cmp, greatest(len(a), len(b)) AS na, greatest(len(a), len(b)) AS nb, CAST(list_sum(a) AS BIGINT) AS sa, CAST(coalesce(list_sum(b), 0) + 9 * (len(a) - len(b)) AS BIGINT) AS sb FROM m""")
def match_shape(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    a, b = arrays.match_shape(F.col("a"), F.filter("a", lambda x: x >= 1), 9)
    return _lists(spark, sf_dir).select("cmp", F.size(a).cast("long").alias("na"), F.size(b).cast("long").alias("nb"), total(a).alias("sa"), total(b).alias("sb"))


@query("SELECT p_partkey, regexp_replace(p_brand, '[0-9]', '', 'g') AS plain, p_type || CAST(p_size AS VARCHAR) AS numbered FROM part")
def unnumber_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.unnumbered(F.col("p_brand")).alias("plain"), text.numbered(F.col("p_type"), F.col("p_size")).alias("numbered"))


@query("SELECT p_partkey, regexp_replace(p_brand, '[0-9]', '', 'g') || CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR) AS p_brand FROM part")
def number_all_names(spark, sf_dir):
    return sequences.number_names(table(spark, sf_dir, "part"), [], "p_partkey", "p_brand").select("p_partkey", "p_brand")
