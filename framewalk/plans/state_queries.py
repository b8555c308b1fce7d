"""Queries of the state-sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewalk.operators import changes, fits, normal_fits, repair, states
from framewalk.plans.tables import EVENTS_SQL, RUNS_SQL, dtrj, dtrj2, events
from framewalk.sources import slicing

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _survival_sql(where: str, leaves: str, keys: str = "", source: str = "runs") -> str:
    k, kj = (f"{keys}, ", f"r.{keys} = g.{keys} AND ") if keys else ("", "")
    grid = "(SELECT DISTINCT state2 FROM ev) s, fr AS t" if keys else "fr AS t"
    gk = "s.state2, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
WITH {EVENTS_SQL}, {RUNS_SQL},
src AS (SELECT r.*{', e.state2' if keys else ''} FROM {source} r {'JOIN ev e ON r.cmp = e.cmp AND r.t0 = e.frame WHERE NOT r.is_first' if keys else ''}),
g AS (SELECT {gk}t.t FROM {grid}),
c AS (
  SELECT {('g.' + keys + ', ') if keys else ''}g.t, count(r.cmp) AS n_risk, count(CASE WHEN r.len = g.t AND NOT r.is_first AND NOT r.is_last {leaves} THEN 1 END) AS n_leaves
  FROM g LEFT JOIN src r ON {kj}r.len >= g.t {where} GROUP BY ALL),
s AS (
  SELECT *, product(CASE WHEN n_risk = 0 THEN 1.0 ELSE 1.0 - n_leaves / n_risk END) OVER w AS p,
         sum(CASE WHEN n_risk = 0 OR n_risk = n_leaves THEN 0.0 ELSE n_leaves::DOUBLE / (n_risk * (n_risk - n_leaves)) END) OVER w AS v,
         max(CASE WHEN n_risk = 0 THEN 1 ELSE 0 END) OVER w AS ended
  FROM c WINDOW w AS ({part} ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT {k}CAST(t AS BIGINT) AS t, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(n_risk AS BIGINT) AS n_risk,
       CASE WHEN ended = 0 THEN round(p, 6) + 0.0 END AS sf, CASE WHEN ended = 0 THEN round(p * p * v, 6) + 0.0 END AS sf_var
FROM s"""


def _km(spark, sf_dir, second=False, **options):
    made = states.kaplan_meier(dtrj(spark, sf_dir), dtrj2(spark, sf_dir) if second else None, **options)
    return _rounded(made, "sf", "sf_var")


@query(_survival_sql("", ""))
def kaplan_meier(spark, sf_dir):
    return _km(spark, sf_dir)


@query(_survival_sql("AND r.state >= 0", ""))
def kaplan_meier_discard_neg_start(spark, sf_dir):
    return _km(spark, sf_dir, discard_neg_start=True)


@query(_survival_sql("AND r.state >= 0", "AND r.nxt >= 0"))
def kaplan_meier_discard_all_neg(spark, sf_dir):
    return _km(spark, sf_dir, discard_all_neg=True)


@query(_survival_sql("", "", "state2"))
def kaplan_meier_discrete(spark, sf_dir):
    return _km(spark, sf_dir, True)


def _leave_sql(keys: str = "") -> str:
    inner = _survival_sql("", "", keys)
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}t, n_leaves, n_risk, CASE WHEN n_risk > 0 THEN round(n_leaves / n_risk, 6) + 0.0 END AS prob FROM ({inner})"


@query(_leave_sql())
def leave_prob(spark, sf_dir):
    return _rounded(states.leave_prob(dtrj(spark, sf_dir)), "prob")


@query(_leave_sql("state2"))
def leave_prob_discrete(spark, sf_dir):
    return _rounded(states.leave_prob(dtrj(spark, sf_dir), dtrj2(spark, sf_dir)), "prob")


@query(f"WITH {EVENTS_SQL}, {RUNS_SQL} SELECT cmp, CAST(run AS BIGINT) AS run, CAST(state AS INTEGER) AS state, t0, CAST(len AS BIGINT) AS len, is_first, is_last FROM runs")
def runs(spark, sf_dir):
    return states.runs(dtrj(spark, sf_dir)).select("cmp", "run", "state", "t0", "len", "is_first", "is_last")


@query(f"WITH {EVENTS_SQL}, {RUNS_SQL} SELECT cmp, CAST(state AS INTEGER) AS state, t0, CAST(len AS BIGINT) AS lifetime FROM runs WHERE NOT is_first AND NOT is_last AND state >= 0 AND nxt >= 0")
def lifetimes(spark, sf_dir):
    return states.lifetimes(dtrj(spark, sf_dir), uncensored=True, discard_all_neg=True)


@query(f"WITH {EVENTS_SQL}, {RUNS_SQL} SELECT CAST(state AS INTEGER) AS state, count(*) AS n, round(avg(len), 6) + 0.0 AS avg, round(stddev_pop(len), 6) + 0.0 AS std, CAST(sum(len) AS BIGINT) AS total FROM runs GROUP BY state")
def lifetimes_per_state(spark, sf_dir):
    return _rounded(states.lifetimes_per_state(dtrj(spark, sf_dir)), "avg", "std")


@query(f"WITH {EVENTS_SQL}, {RUNS_SQL} SELECT CAST(state AS INTEGER) AS state, string_agg(CAST(len AS VARCHAR), ',' ORDER BY cmp, t0) AS lifetimes FROM runs GROUP BY state")
def lifetimes_listed(spark, sf_dir):
    made = states.lifetimes_per_state(dtrj(spark, sf_dir), lists=True)
    return made.select("state", F.array_join(F.col("lifetimes").cast("array<string>"), ",").alias("lifetimes"))


@query(f"WITH {EVENTS_SQL}, {RUNS_SQL} SELECT CAST(state AS INTEGER) AS state, CAST(len AS BIGINT) AS lifetime, count(*) AS n FROM runs WHERE state >= 0 GROUP BY ALL")
def lifetime_counts(spark, sf_dir):
    return states.lifetime_counts(dtrj(spark, sf_dir), discard_neg_start=True)


def _rate_sql(key: str, where: str) -> str:
    k, g = (f"CAST({key} AS {'INTEGER' if key == 'state' else 'BIGINT'}) AS {key}, ", f"GROUP BY {key}") if key else ("", "")
    return f"WITH {EVENTS_SQL}, {RUNS_SQL} SELECT {k}count(CASE WHEN NOT is_last THEN 1 END) AS n_trans, CAST(sum(len) AS BIGINT) AS n_frames, round(count(CASE WHEN NOT is_last THEN 1 END) / nullif(sum(len), 0), 6) + 0.0 AS rate FROM runs WHERE {where} {g}"


@query(_rate_sql("", "state >= 0"))
def trans_rate_tot(spark, sf_dir):
    return _rounded(states.trans_rate_tot(dtrj(spark, sf_dir), discard_neg_start=True), "rate")


@query(_rate_sql("cmp", "TRUE"))
def trans_rate(spark, sf_dir):
    return _rounded(states.trans_rate(dtrj(spark, sf_dir)), "rate")


@query(_rate_sql("state", "state >= 0 AND coalesce(nxt, 0) >= 0"))
def trans_rate_per_state(spark, sf_dir):
    return _rounded(states.trans_rate_per_state(dtrj(spark, sf_dir), discard_all_neg=True), "rate")


def _remain_sql(valid: str, same: str, keys: str = "", restart: int = 1) -> str:
    k, a = (f"{keys}, ", f"a.{keys}, ") if keys else ("", "")
    grid = "(SELECT DISTINCT state2 FROM ev) s, (SELECT t AS lag FROM fr) l" if keys else "(SELECT t AS lag FROM fr) l"
    return f"""
WITH {EVENTS_SQL},
e AS (
  SELECT *, coalesce(min(CASE WHEN c THEN frame END) OVER (PARTITION BY cmp ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS nch,
         coalesce(min(CASE WHEN state < 0 THEN frame END) OVER (PARTITION BY cmp ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) AS nneg
  FROM (SELECT *, state <> lag(state) OVER (PARTITION BY cmp ORDER BY frame) AS c FROM ev)),
p AS (
  SELECT {a}b.frame - a.frame AS lag, count(CASE WHEN {valid} THEN 1 END) AS n_valid, count(CASE WHEN {valid} AND a.state = b.state {same} THEN 1 END) AS n_same
  FROM e a JOIN e b ON a.cmp = b.cmp AND b.frame > a.frame WHERE a.frame % {restart} = 0 AND a.frame < a.n - 1 GROUP BY ALL),
g AS (SELECT {k}CAST(lag AS INTEGER) AS lag FROM {grid})
SELECT {('g.' + keys + ', ') if keys else ''}g.lag, coalesce(p.n_same, 0) AS n_same, coalesce(p.n_valid, 0) AS n_valid,
       CASE WHEN g.lag = 0 THEN 1.0 ELSE round(p.n_same / nullif(p.n_valid, 0), 6) + 0.0 END AS prob
FROM g LEFT JOIN p ON g.lag = p.lag {f'AND g.{keys} = p.{keys}' if keys else ''}"""


@query(_remain_sql("TRUE", ""))
def remain_prob(spark, sf_dir):
    return _rounded(states.remain_prob(dtrj(spark, sf_dir)), "prob")


@query(_remain_sql("TRUE", "AND b.frame < a.nch", restart=3))
def remain_prob_continuous(spark, sf_dir):
    return _rounded(states.remain_prob(dtrj(spark, sf_dir), restart=3, continuous=True), "prob")


@query(_remain_sql("TRUE", "AND b.frame < a.nch"))
def remain_prob_continuous_all_starts(spark, sf_dir):
    return _rounded(states.remain_prob(dtrj(spark, sf_dir), continuous=True), "prob")


@query(_remain_sql("a.state >= 0", ""))
def remain_prob_discard_neg_start(spark, sf_dir):
    return _rounded(states.remain_prob(dtrj(spark, sf_dir), discard_neg_start=True), "prob")


@query(_remain_sql("b.frame < a.nneg", ""))
def remain_prob_discard_all_neg(spark, sf_dir):
    return _rounded(states.remain_prob(dtrj(spark, sf_dir), discard_all_neg=True), "prob")


@query(_remain_sql("TRUE", "", "state2"))
def remain_prob_discrete(spark, sf_dir):
    return _rounded(states.remain_prob(dtrj(spark, sf_dir), dtrj2(spark, sf_dir)), "prob")


def _back_sql(back: str, where: str = "TRUE", keys: str = "") -> str:
    lags = "(SELECT t AS lag FROM fr WHERE t < (SELECT max(t) FROM fr)) l"
    grid = f"(SELECT DISTINCT state2 FROM ev) s, {lags}" if keys else lags
    k, j = (f"{keys}, ", f"j.{keys} = g.{keys} AND ") if keys else ("", "")
    return f"""
WITH {EVENTS_SQL}, {RUNS_SQL},
j AS (
  SELECT r.*, {back} - nxt_t0 AS back, (SELECT count(*) FROM ev x WHERE x.cmp = r.cmp) - nxt_t0 AS remaining{', e.state2' if keys else ''}
  FROM runs r {'JOIN ev e ON r.cmp = e.cmp AND r.nxt_t0 - 1 = e.frame' if keys else ''} WHERE NOT is_last AND {where}),
g AS (SELECT {k}CAST(lag AS INTEGER) AS lag FROM {grid})
SELECT {('g.' + keys + ', ') if keys else ''}g.lag, count(CASE WHEN j.back = g.lag THEN 1 END) AS n_back, count(j.cmp) AS norm,
       round(count(CASE WHEN j.back = g.lag THEN 1 END) / nullif(count(j.cmp), 0), 6) + 0.0 AS prob
FROM g LEFT JOIN j ON {j}j.remaining > g.lag GROUP BY ALL"""


@query(_back_sql("same_t0"))
def back_jump_prob(spark, sf_dir):
    return _rounded(states.back_jump_prob(dtrj(spark, sf_dir)), "prob")


@query(_back_sql("CASE WHEN nxt2 = r.state THEN nxt2_t0 END", "r.state >= 0 AND nxt >= 0"))
def back_jump_prob_continuous(spark, sf_dir):
    return _rounded(states.back_jump_prob(dtrj(spark, sf_dir), continuous=True, discard_neg=True, discard_neg_btw=True), "prob")


@query(_back_sql("same_t0", keys="state2"))
def back_jump_prob_discrete(spark, sf_dir):
    return _rounded(states.back_jump_prob(dtrj(spark, sf_dir), dtrj2(spark, sf_dir)), "prob")


@query(f"""
WITH {EVENTS_SQL}
SELECT cmp, frame, state, coalesce(lead(state) OVER w <> state, FALSE) AS trans_start, coalesce(lag(state) OVER w <> state, FALSE) AS trans_end
FROM ev WINDOW w AS (PARTITION BY cmp ORDER BY frame)""")
def locate_trans(spark, sf_dir):
    return states.locate_trans(dtrj(spark, sf_dir))


@query(f"""
WITH {EVENTS_SQL}, t AS (SELECT *, lag(state) OVER (PARTITION BY cmp ORDER BY frame) AS p FROM ev)
SELECT cmp, frame, state FROM t WHERE state > p AND p >= 0 AND state >= 0""")
def trans_ix(spark, sf_dir):
    return states.trans_ix(dtrj(spark, sf_dir), "end", trans_type="higher", discard_neg="both")


@query(f"""
WITH {EVENTS_SQL}, t AS (SELECT *, lag(state) OVER w AS p, lead(state) OVER w AS nx FROM ev WINDOW w AS (PARTITION BY cmp ORDER BY frame))
SELECT cmp, frame, state, 'start' AS pin FROM t WHERE nx <> state UNION ALL SELECT cmp, frame, state, 'end' FROM t WHERE p <> state""")
def trans_ix_both(spark, sf_dir):
    return states.trans_ix(dtrj(spark, sf_dir), "both")


_ENDS = f"""
{EVENTS_SQL},
t AS (
  SELECT cmp, frame, state, coalesce(lead(state) OVER w, first_value(state) OVER f) AS n, coalesce(lag(state) OVER w, last_value(state) OVER f) AS p
  FROM ev WINDOW w AS (PARTITION BY cmp ORDER BY frame), f AS (PARTITION BY cmp ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(f"""
WITH {_ENDS}, s AS (SELECT CAST(v AS INTEGER) AS state FROM range(-1, 4) AS r(v)), k(trans_type) AS (VALUES ('higher'), ('lower'))
SELECT s.state, k.trans_type, count(CASE WHEN (k.trans_type = 'higher' AND n > t.state) OR (k.trans_type = 'lower' AND n < t.state) THEN 1 END) AS n_start,
       count(CASE WHEN (k.trans_type = 'higher' AND p < t.state) OR (k.trans_type = 'lower' AND p > t.state) THEN 1 END) AS n_end
FROM s CROSS JOIN k LEFT JOIN t ON t.state = s.state GROUP BY ALL""")
def trans_per_state(spark, sf_dir):
    return states.trans_per_state(dtrj(spark, sf_dir), trans_type="both", wrap=True)


@query(f"""
WITH {EVENTS_SQL}, t AS (SELECT *, lead(state) OVER w AS nx, lag(state) OVER w AS p FROM ev WINDOW w AS (PARTITION BY cmp ORDER BY frame)),
g AS (SELECT CAST(s AS INTEGER) AS state, CAST(f AS INTEGER) AS frame FROM range(-1, 4) AS a(s), (SELECT t AS f FROM fr) b),
c AS (SELECT state, frame, count(CASE WHEN nx <> state THEN 1 END) AS n_start, count(CASE WHEN p <> state THEN 1 END) AS n_end FROM t GROUP BY ALL)
SELECT g.state, g.frame, CAST(sum(coalesce(n_start, 0)) OVER w AS BIGINT) AS n_start, CAST(sum(coalesce(n_end, 0)) OVER w AS BIGINT) AS n_end
FROM g LEFT JOIN c ON g.state = c.state AND g.frame = c.frame WINDOW w AS (PARTITION BY g.state ORDER BY g.frame ROWS UNBOUNDED PRECEDING)""")
def trans_per_state_vs_time(spark, sf_dir):
    return states.trans_counts_cumulative(states.trans_per_state_vs_time(dtrj(spark, sf_dir)))


@query(f"""
WITH {EVENTS_SQL}, {RUNS_SQL},
e AS (
  SELECT cmp, count(*) AS r, min(state) AS low, max(state) AS high, sum(CASE WHEN state < 0 THEN len ELSE 0 END) AS neg,
         count(CASE WHEN state >= 0 AND nxt >= 0 THEN 1 END) AS pp, count(CASE WHEN state >= 0 AND nxt < 0 THEN 1 END) AS pn,
         count(CASE WHEN state < 0 AND nxt >= 0 THEN 1 END) AS np, count(CASE WHEN state < 0 AND nxt < 0 THEN 1 END) AS nn
  FROM runs GROUP BY cmp)
SELECT count(CASE WHEN r = 1 THEN 1 END) AS n_stay, count(CASE WHEN high < 0 THEN 1 END) AS always_neg, count(CASE WHEN low >= 0 THEN 1 END) AS never_neg,
       CAST(sum(neg) AS BIGINT) AS n_frames_neg, CAST(sum(r - 1) AS BIGINT) AS n_trans, CAST(sum(pp) AS BIGINT) AS pos2pos, CAST(sum(pn) AS BIGINT) AS pos2neg,
       CAST(sum(np) AS BIGINT) AS neg2pos, CAST(sum(nn) AS BIGINT) AS neg2neg
FROM e""")
def trans_info(spark, sf_dir):
    return states.trans_info(dtrj(spark, sf_dir))


@query(f"""
WITH {_ENDS}, d AS (SELECT cmp, frame, (state - p) - floor((state - p) / 4.0 + 0.5) * 4.0 AS d, (n - state) - floor((n - state) / 4.0 + 0.5) * 4.0 AS e FROM t)
SELECT cmp, frame, d > 0 AS after, e > 0 AS before FROM d""")
def locate_item_change_mic(spark, sf_dir):
    found = changes.locate_changes(dtrj(spark, sf_dir), ["cmp"], "frame", "state", change_type="higher", wrap=True, mic=True, amin=-1, amax=3)
    return found.select("cmp", "frame", "before", "after")


@query(f"""
WITH {EVENTS_SQL}
SELECT cmp, frame, CAST(d - floor(d / 4.0 + 0.5) * 4.0 AS DOUBLE) AS diff FROM (SELECT cmp, frame, state - lag(state) OVER (PARTITION BY cmp ORDER BY frame) AS d FROM ev)""")
def diff_mic(spark, sf_dir):
    return changes.diff_mic(dtrj(spark, sf_dir), ["cmp"], "frame", "state", -1, 3).select("cmp", "frame", "diff")


@query(f"""
WITH {EVENTS_SQL}, {RUNS_SQL}
SELECT i.cmp, i.frame, CAST(CASE WHEN r.len < 2 THEN 7 ELSE i.state END AS INTEGER) AS state FROM ri i JOIN rr r ON i.cmp = r.cmp AND i.run = r.run""")
def replace_short_sequences(spark, sf_dir):
    return repair.replace_short_sequences(dtrj(spark, sf_dir), 2, 7)


@query(f"""
WITH {EVENTS_SQL}, v AS (SELECT cmp, frame, CAST(floor(x * 10) AS INTEGER) AS state FROM ev),
pr AS (SELECT DISTINCT frame, state FROM v),
isl AS (SELECT frame, state, frame - row_number() OVER (PARTITION BY state ORDER BY frame) AS g FROM pr),
len AS (SELECT frame, state, count(*) OVER (PARTITION BY state, g) AS n FROM isl)
SELECT f.cmp, f.frame, CAST(CASE WHEN l.n < 3 THEN -7 ELSE f.state END AS INTEGER) AS state FROM v f JOIN len l ON f.frame = l.frame AND f.state = l.state""")
def replace_short_sequences_global(spark, sf_dir):
    values = events(spark, sf_dir).select("cmp", "frame", F.floor(F.col("x") * 10).cast("int").alias("state"))
    return repair.replace_short_sequences_global(values, 3, -7)


@query(f"""
WITH {EVENTS_SQL}, e AS (SELECT cmp, count(*) AS n, count(DISTINCT frame) AS d, min(frame) AS a, max(frame) AS b FROM ev GROUP BY cmp)
SELECT count(*) AS n_cmps, max(b) + 1 AS n_frames, bool_and(n = d AND a = 0 AND n = b + 1) AS dense, CAST(0 AS BIGINT) AS n_fractions, CAST(0 AS BIGINT) AS n_nulls FROM e""")
def check_dtrj(spark, sf_dir):
    return slicing.check_dtrj(dtrj(spark, sf_dir))


_CURVE = f"SELECT CAST(t AS DOUBLE) AS t, sf FROM ({_survival_sql('', '')}) WHERE sf > 0 AND sf <= 1"


@query(f"""WITH c AS ({_CURVE}), k AS (SELECT greatest(0.0, -sum(t * ln(sf)) / sum(t * t)) AS k FROM c)
SELECT round(any_value(k), 5) AS k, round(sqrt(sum((ln(sf) + k * t) ** 2) / ((count(*) - 1) * sum(t * t))), 5) AS k_sd, count(*) AS n FROM c, k""")
def fit_exp_decay(spark, sf_dir):
    made = fits.fit_exp_decay(_km(spark, sf_dir), [], "t", "sf")
    return made.select(F.round("k", 5).alias("k"), F.round("k_sd", 5).alias("k_sd"), "n")


# the curves of remain_prob, all starts, by the second state at the start; then the part of each that is fitted
_REMAIN_CURVE = f"""WITH {EVENTS_SQL}, {RUNS_SQL},
h AS (SELECT i.state2, r.t0 + r.len - 1 - i.frame AS holds, i.n - 1 - i.frame AS reach FROM ri i JOIN rr r ON i.cmp = r.cmp AND i.run = r.run WHERE i.frame < i.n - 1),
g AS (SELECT state2, t AS lag FROM (SELECT DISTINCT state2 FROM ev), fr),
c AS (SELECT g.state2, g.lag, CASE WHEN g.lag = 0 THEN 1.0 ELSE count(CASE WHEN holds >= g.lag THEN 1 END) / nullif(count(h.reach), 0) END AS prob FROM g LEFT JOIN h ON h.state2 = g.state2 AND h.reach >= g.lag GROUP BY g.state2, g.lag),
w AS (SELECT *, row_number() OVER q AS k, count(*) OVER (PARTITION BY state2) AS n, max(CASE WHEN prob < 0.01 THEN 1 ELSE 0 END) OVER q AS e FROM c WINDOW q AS (PARTITION BY state2 ORDER BY lag))
SELECT state2, lag AS t, prob AS y FROM w WHERE k <= 2 OR (k <= 0.9 * n AND e = 0)"""


def _fit_sql(points: str, model: str, keys: list[str], places: int = 4) -> str:
    names = normal_fits.MODELS[model].names
    return f"SELECT {', '.join(keys)}, n, {', '.join(f'round({c} + 1e-7, {places}) + 0.0 AS {c}' for x in names for c in (x, x + '_sd'))} FROM ({normal_fits.fit_sql(points, model, keys)})"


def _fitted(made, model: str, keys: list[str], places: int = 4):
    return made.select(*keys, "n", *((F.round(F.col(c) + 1e-7, places) + F.lit(0.0)).alias(c) for x in normal_fits.MODELS[model].names for c in (x, f"{x}_sd")))


def _remain_fit(spark, sf_dir, model: str):
    curve = states.remain_prob(dtrj(spark, sf_dir), dtrj2(spark, sf_dir), continuous=True)
    return _fitted(normal_fits.fit_by_sums(fits.fit_window(curve, ["state2"], "lag", "prob"), model, ["state2"], "lag", "prob"), model, ["state2"])


@query(_fit_sql(_REMAIN_CURVE, "kww", ["state2"]))
def fit_kww_discrete(spark, sf_dir):
    return _remain_fit(spark, sf_dir, "kww")


@query()
def fit_burr12(spark, sf_dir):
    """A curve a group: with three parameters on a few points the equations are so near to singular that two engines' last digits differ."""
    curve = states.remain_prob(dtrj(spark, sf_dir), dtrj2(spark, sf_dir), continuous=True)
    return fits.fit_model(fits.fit_window(curve, ["state2"], "lag", "prob"), "burr12", ["state2"], "lag", "prob")


@query(_fit_sql(_REMAIN_CURVE, "weibull", ["state2"]))
def fit_weibull(spark, sf_dir):
    return _remain_fit(spark, sf_dir, "weibull")


@query(f"""
WITH {EVENTS_SQL}, z AS (SELECT (max(frame) + 1) // 3 AS size FROM ev),
b AS (SELECT cmp, CAST(frame // size AS INTEGER) AS block, frame % size AS frame, state FROM ev, z WHERE frame < 3 * size),
l AS (SELECT *, max(frame) OVER (PARTITION BY cmp, block) + 1 AS n FROM b),
p AS (SELECT a.block, c.frame - a.frame AS lag, count(*) AS v, count(CASE WHEN a.state = c.state THEN 1 END) AS s FROM l a JOIN l c ON a.cmp = c.cmp AND a.block = c.block AND c.frame > a.frame WHERE a.frame < a.n - 1 GROUP BY ALL),
q AS (SELECT block, lag, s / v AS prob FROM p UNION ALL SELECT DISTINCT block, 0, 1.0 FROM b)
SELECT CAST(lag AS INTEGER) AS lag, round(avg(prob), 6) + 0.0 AS mean, round(stddev_pop(prob) / sqrt(count(*)), 6) + 0.0 AS sd FROM q GROUP BY lag""")
def remain_prob_in_blocks(spark, sf_dir):
    # three blocks of the longest sequence; only its frames that three does not divide are left out
    rows = dtrj(spark, sf_dir)
    made = states.remain_prob_in_blocks(rows, 3, states.n_frames_of(rows))
    return _rounded(made, "mean", "sd")


@query(f"""
WITH c AS (SELECT state2, t, sf, lag(t) OVER w AS t0, lag(sf) OVER w AS sf0 FROM ({_survival_sql("", "", "state2").replace("least(3, floor(value / 25))", "(CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE -1 END)").replace("round(p, 6) + 0.0", "p")}) WHERE sf IS NOT NULL WINDOW w AS (PARTITION BY state2 ORDER BY t)),
i AS (SELECT state2, CASE WHEN min(sf) <= 0.9 THEN sum((t - t0) * (sf + sf0) / 2) END AS m FROM c GROUP BY state2),
{EVENTS_SQL.lstrip()}, {RUNS_SQL},
k AS (SELECT CAST(state AS INTEGER) AS state, avg(len) AS a, stddev_samp(len) AS s FROM runs WHERE NOT is_first AND NOT is_last GROUP BY state)
SELECT coalesce(k.state, i.state2) AS state, round(a, 6) + 0.0 AS count_mean, round(s, 6) + 0.0 AS count_std, round(m, 6) + 0.0 AS integral_mean FROM k FULL JOIN i ON k.state = i.state2""")
def lifetime_moments(spark, sf_dir):
    made = states.lifetime_moments(dtrj(spark, sf_dir), threshold=0.9)
    return _rounded(made, "count_mean", "count_std", "integral_mean").select("state", "count_mean", "count_std", "integral_mean")


@query(f"""
WITH c AS (SELECT state2, t, sf, lag(t) OVER w AS t0, lag(sf) OVER w AS sf0 FROM ({_survival_sql("", "", "state2").replace("least(3, floor(value / 25))", "(CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE -1 END)").replace("round(p, 6) + 0.0", "p")}) WHERE sf IS NOT NULL WINDOW w AS (PARTITION BY state2 ORDER BY t)),
i AS (SELECT state2, count(*) AS n, CASE WHEN min(sf) <= 0.9 THEN sum((t - t0) * (sf + sf0) / 2) END AS m FROM c GROUP BY state2),
{EVENTS_SQL.lstrip()}, {RUNS_SQL}
SELECT CAST(state AS INTEGER) AS state, 'count' AS method, count(*) AS n, round(avg(len), 6) + 0.0 AS mean FROM runs GROUP BY state
UNION ALL SELECT CAST(state AS INTEGER), 'count_uncensored', count(*), round(avg(len), 6) + 0.0 FROM runs WHERE NOT is_first AND NOT is_last GROUP BY state
UNION ALL SELECT CAST(state AS INTEGER), 'rate', count(CASE WHEN NOT is_last THEN 1 END), round(sum(len) / nullif(count(CASE WHEN NOT is_last THEN 1 END), 0), 6) + 0.0 FROM runs GROUP BY state
UNION ALL SELECT state2, 'integral', n, round(m, 6) + 0.0 FROM i""")
def lifetime_methods(spark, sf_dir):
    """Those of the estimators that SQL can express; the fitted ones are tested on drawn lifetimes."""
    made = states.lifetime_methods(dtrj(spark, sf_dir), 0.9).where("method not in ('weibull', 'burr12')")
    return _rounded(made, "mean").select("state", "method", "n", "mean")
