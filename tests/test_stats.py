"""Statistics, sequences, arrays, texts, models and fits."""

import math

import numpy as np
import pytest
from helpers import column, near, plain, rows
from pyspark.sql import functions as F

from framewalk.functions import arrays, models, text
from framewalk.operators import fits, normal_fits, sequences, stats

# The inputs and results below that are lists of numbers are those of documented examples.


@pytest.fixture(scope="module")
def series(spark):
    def make(*xs):
        return spark.createDataFrame([(i, t, float(v)) for i, x in enumerate(xs) for t, v in enumerate(x)], "id long, t int, x double")

    return make


@pytest.mark.parametrize(
    "options, wanted",
    [
        ({}, [1, -0.8, 0.56666667, -0.4, 0.13333333]),
        ({"dt": None}, [1, -0.8, 0.26666667, -0.2, 0.13333333]),
        ({"unbiased": True}, [1, -1, 0.94444444, -1, 0.66666667]),
        ({"unbiased": True, "dt": None}, [1, -1, 0.66666667, -1, 0.66666667]),
        ({"center": False}, [1, -0.8, 0.6, -0.4, 0.2]),
        ({"center": False, "dtau": 2}, [1, 0.6, 0.2]),
        ({"center": False, "tau_max": 2}, [1, -0.8]),
        ({"center": False, "dt": None}, [1, -0.8, 0.4, -0.2, 0.2]),
    ],
)
def test_acf(series, options, wanted):
    assert near(column(stats.acf(series([-2, 2, -2, 2, -2]), **options), "acf", "lag"), wanted)


def test_acf_se(spark):
    curve = spark.createDataFrame([(0, k, float(k)) for k in range(4)], "id long, lag int, acf double")
    assert near(column(stats.acf_se(curve), "se", "lag"), [0, 0.5, 0.8660254, 1.6583124])


def test_averages(series):
    s = series([1, 2, 6, 7])
    assert near(column(stats.cumav(s), "x", "t"), [1, 1.5, 3, 4])
    assert near(column(stats.movav(s, 2), "x", "t"), [1.5, 4, 6.5])
    assert near(column(stats.standardized(s, ["id"], "x"), "x", "t"), [-3 / 6.5**0.5, -2 / 6.5**0.5, 2 / 6.5**0.5, 3 / 6.5**0.5])


def test_describe(series):
    r = stats.describe(series([1, 2, 4, 9, 16]), ["id"], "x").first()
    x = np.array([1, 2, 4, 9, 16.0])
    n, m = 5, x.mean()
    g1 = ((x - m) ** 3).mean() / ((x - m) ** 2).mean() ** 1.5
    g2 = ((x - m) ** 4).mean() / ((x - m) ** 2).mean() ** 2 - 3
    assert near([r["std"], r["skew"], r["kurt"], r["median"]], [x.std(ddof=1), g1 * (n * (n - 1)) ** 0.5 / (n - 2), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), 4])


@pytest.mark.parametrize("sorted_", [4096, 3])
def test_medians(spark, monkeypatch, sorted_):
    """Equal to numpy's for groups of all sizes, ties, outliers and null keys; with brackets narrowed to three values as well."""
    monkeypatch.setattr(stats, "SORTED", sorted_)
    rng = np.random.default_rng(5)
    groups = {
        "even": [1.0, 2.0, 4.0, 8.0], "one": [3.0], "ties": [2.0] * 50 + [7.0] * 50, "most": [1.0, *[5.0] * 40, 9.0], "far": [-1e300, 0.0, 1e-300, 5.0, 1e300, 1e308],
        "many": list(rng.normal(size=5001)), "coarse": list(rng.integers(0, 9, 4000).astype(float)), None: [2.0, 3.0, 10.0], "edge": list(np.arange(600.0)) + [-1e9] * 598,
    }
    data = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("none", None), ("many", None)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r["g"]: r["median"] for r in stats.medians(df, ["g"], "x").collect()}
    assert got == {k: float(np.median(xs)) for k, xs in groups.items()}
    every = [x for xs in groups.values() for x in xs]
    assert stats.medians(df, [], "x").first()[0] == np.median(every)
    assert {r["g"]: r["median"] for r in stats.describe(df, ["g"], "x").collect()} == got | {"none": None}
    assert stats.medians(df.where("false"), ["g"], "x").count() == 0
    assert stats.describe(df.where("false"), [], "x").select("n", "median").first() == (0, None)


def test_medians_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 0)
    monkeypatch.setattr(stats, "SORTED", 2)
    df = spark.range(3000).selectExpr("if(id % 10 < 9, 0, id % 7) as g", "double((id * 7919) % 1013) as x")
    wanted = {r[0]: r[1] for r in df.groupBy("g").agg(F.percentile("x", 0.5)).collect()}
    assert {r["g"]: r["median"] for r in stats.medians(df, ["g"], "x").collect()} == wanted


def test_moments(spark):
    got = spark.range(1).select(arrays.moment_raw2cen([F.lit(2.0), F.lit(5.0)]), arrays.moment_raw2cen([F.lit(2.0), F.lit(5.0), F.lit(16.0)])).first()
    assert near(got, [1, 16 - 3 * 2 * 5 + 2 * 8])


def test_islands(spark):
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate([0, 2, 2, 4, 4, 4, 2, 2, 0])], "g long, k int, v double")
    assert rows(sequences.first_const_seq(df, ["g"], "k", "v", 2), "start", "length", "value") == [(1, 2, 2.0)]
    assert rows(sequences.first_const_seq(df, ["g"], "k", "v", 2, sort=True), "start", "length", "value") == [(0, 2, 0.0)]
    assert rows(sequences.longest_const_seq(df, ["g"], "k", "v"), "start", "length", "value") == [(3, 3, 4.0)]
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate([0, 1, 2, 5, 7, 9])], "g long, k int, v double")
    assert column(sequences.islands(df, ["g"], "k", "v", 2), "island", "k") == [0, 1, 2, 3, 3, 3]


def test_sequenize(spark):
    df = spark.createDataFrame([(v,) for v in (-5, -3, 6, -1, 2, 4, 4, None)], "v long")
    assert rows(sequences.sequenize(df, "v", 3, 1).where("v is not null")) == sorted([(-5, 1), (-3, 4), (-1, 7), (2, 10), (4, 13), (4, 13), (6, 16)], key=repr)


def test_arrays(spark):
    a = F.lit([1.0, 3.0, 1.0, 3.0, 2.0])
    got = spark.range(1).select(arrays.argmin_last(a), arrays.argmax_last(a), arrays.find_nearest(a, F.lit(2.4)), arrays.take(a, -3, None, 2), arrays.get_middle(a), arrays.extend(a, 6, 0.0), arrays.ceil_divide(F.lit(7), F.lit(2))).first()
    assert list(got) == [2, 3, 2.0, [1.0, 2.0], [1.0], [1.0, 3.0, 1.0, 3.0, 2.0, 0.0], 4]
    df = spark.createDataFrame([(-1.0, 0.5), (0.0, 1.5), (1.0, 2.5)], "x double, y double")
    assert column(df.select("x", arrays.digitize_dd([F.col("x"), F.col("y")], [[-1, 0, 1], [1, 2, 3]]).alias("b")), "b", "x") == [4, 9, 14]
    assert column(df.select("x", arrays.digitize(F.col("x"), [0, 1], True).alias("b")), "b", "x") == [0, 0, 1]


def test_texts(spark):
    for n, name in ((0, "0"), (1, "A"), (-1, "A"), (26, "Z"), (27, "AA"), (703, "AAA"), (2**62, None)):
        got = spark.range(1).select(text.excel_colname(F.lit(n)).alias("n")).withColumn("b", text.excel_colnum(F.col("n"))).first()
        assert name is None or got["n"] == name
        assert got["b"] == abs(n)
    digits = spark.range(1).select(*(text.trailing_digits(F.lit(n), d) for n, d in ((1, 0), (1, 1), (10, 0), (100, 0), (100, 1), (-100, 0)))).first()
    assert list(digits) == [0, 1, 1, 2, 0, 2]
    assert spark.range(1).select(text.sci_notation_tex(F.lit(1500.0))).first()[0] == "1.5 \\times 10^{3}"


def test_dihedrals(spark):
    rb = models.fourier_to_rb([F.lit(x) for x in (1.1, -2.2, 3.3, -4.4)])
    assert near(spark.range(1).select(*rb).first(), [0, 4.4, -15.4, -6.6, 17.6, 0])
    assert near(spark.range(1).select(*models.rb_to_fourier([F.lit(x) for x in (0.0, 4.4, -15.4, -6.6, 17.6, 0.0)])).first(), [1.1, -2.2, 3.3, -4.4])
    assert spark.range(1).select(*models.rb_to_fourier([F.lit(x) for x in (9.0, 4.4, -15.4, -6.6, 17.6, 0.0)])).first()[0] is None
    with pytest.raises(ValueError):
        models.fourier_to_rb([F.lit(1.0)] * 5)


def test_models(spark):
    df = spark.createDataFrame([(float(k),) for k in range(5)], "x double")
    assert near(column(df.select("x", models.mb_dist("x", 1.0).alias("y")), "y", "x"), [0, 0.48394145, 0.43192773, 0.07977327, 0.00428257])
    assert near(column(df.select("x", models.mb_dist("x", 1.0, d=2).alias("y")), "y", "x"), [0, 0.60653066, 0.27067057, 0.03332699, 0.00134185])
    df = spark.createDataFrame([(0.75 * k,) for k in range(5)], "x double")
    assert near(column(df.select("x", models.ekin_dist("x", 1.0).alias("y")), "y", "x"), [0, 0.46159897, 0.30836066, 0.17839543, 0.09730435])
    for beta in (0.3, 0.5, 1.0):
        assert near([spark.range(1).select(models.kww_mean(2.0, beta)).first()[0]], [2 / beta * math.gamma(1 / beta)])


@pytest.mark.parametrize("model, f, true", [("kww", lambda t, a, b: np.exp(-((t / a) ** b)), (7.0, 0.6)), ("burr12", lambda t, a, b, c: (1 + (t / a) ** b) ** -c, (5.0, 1.4, 1.7)), ("gaussian", lambda x, m, s: np.exp(-0.5 * ((x - m) / s) ** 2) / (s * (2 * np.pi) ** 0.5), (20.0, 4.0))])
def test_fits(spark, model, f, true):
    t = np.arange(0, 60, 1.0)
    curve = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(t, f(t, *true))], "g long, t double, y double")
    r = fits.fit_model(curve, model, ["g"], "t", "y").first()
    assert np.allclose([r[n] for n in fits.MODELS[model][1]], true, rtol=2e-2)


def test_closed_form_fits(spark):
    curve = spark.createDataFrame([(0, float(t), math.exp(-0.3 * t), 2.4 * t, 3.0 * t**1.5) for t in range(1, 20)], "g long, t double, y double, m double, p double")
    assert near([fits.fit_exp_decay(curve, ["g"], "t", "y").first()["k"]], [0.3])
    assert near([fits.fit_einstein(curve, ["g"], "t", "m", 3, 2, 10).first()["D"]], [0.4])
    r = fits.fit_power_law(curve, ["g"], "t", "p").first()
    assert near([r["a"], r["b"]], [3, 1.5])
    empty = fits.fit_exp_decay(curve.where("t > 99"), ["g"], "t", "y")
    assert empty.count() == 0
    few = fits.fit_model(curve.where("t < 2"), "kww", ["g"], "t", "y").first()
    assert few["tau"] is None and plain(few["n"]) == 1


def test_normal_test(spark):
    rng = np.random.default_rng(4)
    rows_ = [(g, float(v)) for g in range(300) for v in rng.normal(size=80)] + [(999, float(v)) for v in rng.exponential(size=80)] + [(1000, 1.0)] * 5
    made = {r["g"]: r for r in stats.normal_test(spark.createDataFrame(rows_, "g long, x double"), ["g"], "x").collect()}
    p = np.array([made[g]["p"] for g in range(300)])
    assert 0.01 < (p < 0.05).mean() < 0.1 and 0.4 < p.mean() < 0.6
    z = np.array([made[g]["z_kurt"] for g in range(300)])
    assert abs(z.mean()) < 0.2 and 0.8 < z.std() < 1.2
    assert made[999]["p"] < 1e-4
    assert 1000 not in made or made[1000]["p"] is None


def test_auto_histogram(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=5000)
    made = stats.auto_histogram(spark.createDataFrame([(0, float(v)) for v in x], "g long, x double"), ["g"], "x").collect()
    width = x.std() * (24 * math.pi**0.5 / 5000) ** (1 / 3)
    assert all(abs(r["hi"] - r["lo"] - width) < 1e-9 for r in made)
    assert sum(r["n"] for r in made) == 5000
    assert abs(sum(r["density"] * width for r in made) - 1) < 1e-9


def test_weighted_moments_of_large_values(spark):
    """Values that differ little from a large mean: squares of the values themselves would cancel."""
    data = spark.createDataFrame([("a", 1e9 + k, 1.0 + k % 2) for k in range(10)], "k string, x double, w double")
    x, w = [float(k) for k in range(10)], [1.0 + k % 2 for k in range(10)]
    mean = sum(a * b for a, b in zip(x, w)) / sum(w)
    var = sum(b * (a - mean) ** 2 for a, b in zip(x, w)) / sum(w)
    for keys in (["k"], []):
        made = stats.weighted_moments(data, keys, "x", "w").first()
        assert abs(made["mean"] - 1e9 - mean) < 1e-5 and abs(made["var"] - var) < 1e-6 and abs(made["std"] - var**0.5) < 1e-6


def test_ngp_center(spark):
    data = spark.createDataFrame([(0, float(v) + 50) for v in (-2, -1, 0, 1, 2)], "k int, x double")
    assert near([stats.ngp_by(data, ["k"], "x", center=True).first()["ngp"]], [(34 / 5) / (3 * 4) - 1])
    with pytest.raises(ValueError):
        stats.ngp_by(data, ["k"], "x", is_squared=True, center=True)


@pytest.mark.parametrize("center, unbiased", [(True, False), (False, True)])
def test_acf_of_all_lags(spark, center, unbiased):
    data = spark.range(200).selectExpr("id div 100 as id", "cast(id % 100 as int) as t", "cast((id * 37) % 101 as double) as x").where("not (id = 1 and t in (5, 6))")
    a, b = (f(data, center=center, unbiased=unbiased).orderBy("id", "lag").collect() for f in (stats.acf_all_lags, stats.acf))
    assert [(x["id"], x["lag"]) for x in a] == [(x["id"], x["lag"]) for x in b]
    assert all(abs(x["acf"] - y["acf"]) < 1e-9 for x, y in zip(a, b))
    flat = spark.createDataFrame([(0, t, 3.0) for t in range(4)], "id int, t int, x double")
    assert {r["acf"] for r in stats.acf_all_lags(flat).collect()} == {None}


@pytest.mark.parametrize("model", ["kww", "gaussian", "maxwell", "burr12_alt"])
def test_fits_by_sums(spark, model):
    """All curves at once by grouped sums: the parameters of the plain method, curve by curve."""
    rng = np.random.default_rng(8)
    f, names, start, low, high = fits.MODELS[model]
    x = np.linspace(-3, 4, 50) if model == "gaussian" else np.linspace(0.2, 4, 40) if model == "maxwell" else np.arange(40.0)
    true = {"gaussian": [(0.3, 0.8), (1.0, 1.2)], "maxwell": [(0.8, 0.0), (0.5, -0.2)], "kww": [(5, 0.7), (12, 1.4)], "weibull": [(5, 0.7), (12, 1.4)]}.get(model, [(8, 1.3, 1.4), (4, 0.9, 1.7)])
    points = [(g, float(t), float(y) if survival_ok(model, y) else 0.5) for g, p in enumerate(true) for t, y in zip(x, f(x, *p) + rng.normal(0, 0.004, len(x)))]
    points += [(8, 1.0, 0.5), (9, 1.0, None), (9, float("nan"), 0.1)]
    curve = spark.createDataFrame(points, "g long, t double, y double")
    made = {r["g"]: r for r in normal_fits.fit_by_sums(curve, model, ["g"], "t", "y").collect()}
    plain_ = {r["g"]: r for r in fits.fit_model(curve, model, ["g"], "t", "y").collect()}
    assert made.keys() == plain_.keys()
    for g in range(len(true)):
        for n in names:
            assert made[g][n] == pytest.approx(plain_[g][n], rel=1e-5, abs=1e-6)
            assert made[g][f"{n}_sd"] == pytest.approx(plain_[g][f"{n}_sd"], rel=1e-3, abs=1e-6)
        assert made[g]["n"] == plain_[g]["n"]
    assert made[8][names[0]] is None and made[8]["n"] == 1 and made[9]["n"] == 0


def survival_ok(model, y):
    return model in ("gaussian", "maxwell") or 0 < y <= 1
