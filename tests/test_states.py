"""State sequences against known results."""

import pytest
from helpers import column, near, plain, rows

from framewalk.operators import states
from framewalk.plans import state_queries, tables

NAN = float("nan")
SF = "/root/testdata/sf0.001"
# Inputs of documented examples; the results below that are lists of numbers are theirs.
F1 = [[1, -2, -2, 3, 3, 3], [-2, -2, 3, 3, 3, 1], [3, 3, 3, 1, -2, -2], [1, 3, 3, 3, -2, -2], [1, 4, 4, 4, 4, -1]]
F2 = [[1, 2, 2, 3, 3, 3], [2, 2, 3, 3, 3, 1], [3, 3, 3, 1, 2, 2], [1, 3, 3, 3, 2, 2]]
F3 = [[1, 2, 2, 1, 3, 3, 3], [-1, 2, 2, -1, 3, 3, 3], [1, -2, -2, 1, 3, 3, 3], [1, 2, 2, 3, 3, 3, 1], [-1, 2, 2, 3, 3, 3, -1], [1, 2, 2, -3, -3, -3, 1]]
RATES = [[1, -2, -2, 3, 3, 3], [-2, -2, 3, 3, 3, 1], [3, 3, 3, 1, 2, 2], [1, 3, 3, 3, -2, -2], [1, 4, 4, 4, 4, -1], [-6] * 6, [6] * 6]
START, ALL = {"discard_neg_start": True}, {"discard_all_neg": True}


def turned(a):
    return [list(r) for r in zip(*a)]


@pytest.mark.parametrize(
    "options, sf, var",
    [
        ({}, [1, 0.93333333, 0.82962963, 0.49777778, 0, NAN], [0, 0.00414815, 0.01283707, 0.03765904, 0, NAN]),
        (START, [1, 0.9, 0.9, 0.54, 0, NAN], [0, 0.009, 0.009, 0.04212, 0, NAN]),
        (ALL, [1, 1, 1, 0.8, 0.8, NAN], [0, 0, 0, 0.032, 0.032, NAN]),
    ],
)
def test_kaplan_meier(dtrj, options, sf, var):
    made = states.kaplan_meier(dtrj(F1), **options)
    assert near(column(made, "sf", "t"), sf)
    assert near(column(made, "sf_var", "t"), var)


def test_kaplan_meier_discrete(dtrj):
    d = dtrj([*F2, [1, 4, 4, 4, 4, 1]])
    wanted = [1, 0.66666667, *[NAN] * 4, 1, 1, 0.66666667, *[NAN] * 3, 1, 1, 1, 0.33333333, NAN, NAN, 1, 1, 1, 1, 0, NAN]
    assert near(column(states.kaplan_meier(d, d), "sf", "state2", "t"), wanted)


@pytest.mark.parametrize(
    "turn, options, wanted",
    [
        (False, {}, [1, 0.6, 0.3, 0.06666667, 0, 0]),
        (False, {"restart": 3}, [1, 0.5, 0.2, 0, 0, 0]),
        (False, {"continuous": True}, [1, 0.6, 0.3, 0.06666667, 0, 0]),
        (False, START, [1, 0.57894737, 0.375, 0.09090909, 0, 0]),
        (False, ALL, [1, 0.73333333, 0.6, 0.2, 0, NAN]),
        (False, ALL | {"continuous": True}, [1, 0.73333333, 0.6, 0.2, 0, NAN]),
        (True, {}, [1, 0.375, 0.11111111, 0.16666667, 0.16666667]),
        (True, {"restart": 2}, [1, 0.58333333, 0, 0.33333333, 0.16666667]),
        (True, {"continuous": True}, [1, 0.375, 0.05555556, 0, 0]),
        (True, START, [1, 0.375, 0.16666667, 0.25, 0.25]),
        (True, START | {"continuous": True}, [1, 0.375, 0.08333333, 0, 0]),
        (True, ALL, [1, 0.46153846, 0.28571429, 0.33333333, 0]),
    ],
)
def test_remain_prob(dtrj, turn, options, wanted):
    assert near(column(states.remain_prob(dtrj(turned(F1) if turn else F1), **options), "prob", "lag"), wanted)


def test_remain_prob_discrete(dtrj):
    d = dtrj(turned(F1))
    wanted = [*[1, NAN, NAN, NAN, NAN] * 2, 1, 0.5, 0, NAN, NAN, 1, 0.45454545, 0.33333333, 0.33333333, 0, 1, NAN, NAN, NAN, NAN]
    assert near(column(states.remain_prob(d, d, **ALL), "prob", "state2", "lag"), wanted)


@pytest.mark.parametrize(
    "options, third, last",
    [
        ({}, 0.2, 0.5),
        ({"discard_neg": True}, 0.18181818, 0.5),
        ({"discard_neg_btw": True}, 0.2, 0.5),
        ({"discard_neg": True, "discard_neg_btw": True}, 0.16666667, 0.5),
        ({"continuous": True}, 0.2, 0),
        ({"continuous": True, "discard_neg": True}, 0.18181818, 0),
        ({"continuous": True, "discard_neg_btw": True}, 0.16666667, 0),
        ({"continuous": True, "discard_neg": True, "discard_neg_btw": True}, 0.125, 0),
    ],
)
def test_back_jump_prob(dtrj, options, third, last):
    assert near(column(states.back_jump_prob(dtrj(F3), **options), "prob", "lag"), [0, 0, third, 0, 0, last])


def test_back_jump_prob_discrete(dtrj):
    made = states.back_jump_prob(dtrj(F3), dtrj(F3), discard_neg_btw=True)
    wanted = [0, *[NAN] * 5, 0, 0, 0, 0, NAN, NAN, 0, 0, 0.33333333, 0, 0, 0.5, 0, 0, 0.25, 0, 0, 0.5, 0, 0, 0, 0, NAN, NAN, 0, *[NAN] * 5]
    assert near(column(made, "prob", "state2", "lag"), wanted)


def test_rates(dtrj):
    for rows_, wanted in ((RATES, [0.23809523, 0.27586206, 0.23809523]), (turned(RATES), [0.69047619, 0.58620689, 0.45])):
        assert near([states.trans_rate_tot(dtrj(rows_), **o).first()["rate"] for o in ({}, START, ALL)], wanted)
    assert near(column(states.trans_rate_per_state(dtrj(RATES), **ALL), "rate", "state"), [0.75, 0, 0.22222222, 0])
    assert near(column(states.trans_rate(dtrj(turned(RATES)), **ALL), "rate", "cmp"), [0.5, 0.33333333, 0.25, 0.6, 0.33333333, 0.66666667])


def test_lifetimes(dtrj):
    assert column(states.lifetimes(dtrj(F1)), "lifetime", "cmp", "t0") == [1, 2, 3, 2, 3, 1, 3, 1, 2, 1, 3, 2, 1, 4, 1]
    assert column(states.lifetimes(dtrj(F1), uncensored=True), "lifetime", "cmp", "t0") == [2, 3, 1, 3, 4]
    assert column(states.lifetimes(dtrj(F1), **START), "lifetime", "cmp", "t0") == [1, 3, 3, 1, 3, 1, 1, 3, 1, 4]
    listed = states.lifetimes_per_state(dtrj(F1), lists=True).where("state = 1").first()
    assert (listed["lifetimes"], listed["total"]) == ([1] * 5, 5)
    assert rows(states.lifetime_counts(dtrj(F1))) == [(-1, 1, 1), (-2, 2, 4), (1, 1, 5), (3, 3, 4), (4, 4, 1)]
    assert rows(states.lifetimes_per_state(dtrj(F1)), "state", "n", "avg") == [(-1, 1, 1.0), (-2, 4, 2.0), (1, 5, 1.0), (3, 4, 3.0), (4, 1, 4.0)]


def test_transitions(dtrj):
    plain_ = states.trans_per_state(dtrj(F2)).orderBy("state").collect()
    assert [(r["n_start"], r["n_end"]) for r in plain_] == [(3, 2), (2, 3), (3, 3)]
    both = states.trans_per_state(dtrj(F2), trans_type="both", wrap=True).orderBy("trans_type", "state").collect()
    assert [(r["n_start"], r["n_end"]) for r in both] == [(4, 0), (3, 3), (0, 4), (0, 4), (1, 1), (4, 0)]
    ends = states.trans_per_state(dtrj(F2), tfft=True, tlft=True).orderBy("state").collect()
    assert [(r["n_start"], r["n_end"]) for r in ends] == [(4, 4)] * 3
    steps = states.trans_per_state_vs_time(dtrj(F2), trans_type=(1, -1), wrap=True).orderBy("trans_type", "state", "frame").collect()
    assert [r["n_start"] for r in steps[:18]] == [1, 0, 0, 1, 0, 1, 0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert [r["n_start"] for r in steps[18:]] == [0] * 6 + [0, 0, 0, 0, 0, 1] + [0, 0, 0, 1, 0, 0]
    with pytest.raises(ValueError):
        states.locate_trans(dtrj(F2), tfft=True, wrap=True)


def test_both_pins(dtrj):
    made = states.trans_ix(dtrj([[1, 1, 2, 3]]), "both")
    assert rows(made, "frame", "pin") == sorted([(1, "start"), (2, "end"), (2, "start"), (3, "end")], key=repr)
    with pytest.raises(ValueError):
        states.trans_ix(dtrj([[1]]), "middle")


def test_long_sequences(spark):
    """100 compounds of 100,000 frames: survival and remain probabilities with a bounded lag, in time in proportion to the frames."""
    d = spark.range(100 * 100_000).selectExpr("id div 100000 as cmp", "cast(id % 100000 as int) as frame", "cast(floor(id % 100000 / (1 + id div 100000)) % 3 as int) as state")
    curve = states.kaplan_meier(d)
    assert curve.count() == 100_000
    assert near([curve.where("t = 1").first()["sf"]], [1 - 99_998 / curve.where("t = 1").first()["n_risk"]])
    one = d.where("cmp = 60")
    made = {r["lag"]: r["prob"] for r in states.remain_prob(one, max_lag=100).collect()}
    assert len(made) == 101 and made[1] > 0.98 > made[20]


def test_lag_join_is_by_bucket(dtrj):
    plan = states.remain_prob(dtrj(F1), max_lag=2)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in next(line for line in plan.splitlines() if "Join" in line and "cmp" in line)


def test_lifetime_methods(spark):
    from framewalk.sources.files import generate_dtrj

    d = generate_dtrj(spark, 200, 400, [6.0, 12.0], seed=3)
    made = {(r["state"], r["method"]): r["mean"] for r in states.lifetime_methods(d).collect()}
    assert {m for _, m in made} == {"count", "count_uncensored", "rate", "integral", "weibull", "burr12"}
    for state, tau in ((0, 6.5), (1, 12.5)):  # lifetimes are rounded up
        assert all(abs(made[state, m] - tau) < 0.1 * tau for m in ("count_uncensored", "integral", "weibull", "rate"))


def test_trans_info(dtrj):
    d = [[1, 2, 2, 3, 3, 3], [-2, -2, -3, -3, -3, -1], [3, 3, 3, 1, -2, -2], [-1, 3, 3, 3, -2, -2], [6] * 6]
    assert tuple(states.trans_info(dtrj(d)).first()) == (1, 1, 2, 11, 8, 3, 2, 1, 2)
    assert tuple(states.trans_info(dtrj(turned(d))).first()) == (0, 0, 0, 11, 20, 4, 7, 7, 2)


def test_ragged_and_empty(spark, dtrj):
    d = dtrj([[1, 1, 2], [3, 3, 3, 3, 4]])
    assert states.remain_prob(d).count() == 5
    assert plain(states.trans_rate_tot(d).first()["rate"]) == plain(2 / 8)
    empty = spark.createDataFrame([], "cmp long, frame int, state int")
    assert states.runs(empty).count() == 0
    assert states.lifetimes(empty).count() == 0


def test_properties(dtrj):
    made = states.kaplan_meier(dtrj(F1)).where("sf is not null").orderBy("t").collect()
    assert all(0 <= r["sf"] <= 1 for r in made)
    assert all(a["sf"] >= b["sf"] for a, b in zip(made, made[1:]))
    assert states.lifetimes(dtrj(F1)).agg({"lifetime": "sum"}).first()[0] == 30


def test_blocks_reach_the_last_frames(spark):
    rows = tables.dtrj(spark, SF)
    n = states.n_frames_of(rows)
    made = state_queries.QUERIES["remain_prob_in_blocks"](spark, SF)
    assert n > 45
    assert sorted(r["lag"] for r in made.collect()) == list(range(n // 3))
