"""Queries on what goes on from the race, lines by folds of neighbours, own models, and tables beside those of other modules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import texts
from tidemark.operators import accuracy, cells, choice, ensemble, estimators, panel, pool, race, vintage
from tidemark.plans.accuracy_queries import ERRORS, y_growth
from tidemark.plans.cell_queries import _MEMBERS, _quarters, _y, groups, m08, members, months
from tidemark.plans.ensemble_queries import _ALL, _bands, regime_log
from tidemark.plans.pool_queries import POOL, WEIGHTS, readings
from tidemark.plans.queries import _SCREEN, QS, TEST, _growths, query, rounded
from tidemark.plans.selection_queries import e04
from tidemark.sources.files import written
from tidemark.testbed import meta, obs, target

RELEASE = 2


# --- after the race ---------------------------------------------------------------------------------------------------

_RATIO = ERRORS + """, nc AS (SELECT date, lag(growth) OVER (ORDER BY date) AS nc FROM ygrowth), bench AS (SELECT vintage, round(sqrt(avg(pow(nc - actual, 2))), 6) AS base FROM (SELECT DISTINCT date, vintage, actual FROM readings WHERE actual IS NOT NULL) JOIN nc USING (date) GROUP BY 1),
scored AS (SELECT spec, vintage, rmse, round(rmse / base, 6) AS ratio FROM m JOIN bench USING (vintage) WHERE rmse IS NOT NULL)"""


def against_no_change(s: SparkSession, d: str) -> DataFrame:
    """(spec, vintage, rmse, ratio): error of each specification, over that of no change in the same quarters."""
    r = written(readings(s, d))
    y = _growths(s, d)[1].select("date", F.lag("growth").over(W.orderBy("date")).alias("nc"))
    base = r.filter("actual is not null").select("date", "vintage", "actual").distinct().join(F.broadcast(y), "date")
    base = base.groupBy("vintage").agg(F.round(accuracy.rms(F.col("nc") - F.col("actual")), 6).alias("base"))
    e = rounded(pool.errors(r), "rmse").filter("rmse is not null").join(F.broadcast(base), "vintage")
    return e.select("spec", "vintage", "rmse", F.round(F.col("rmse") / F.col("base"), 6).alias("ratio"))


@query("t01_beating", _RATIO + " SELECT * FROM scored WHERE ratio < 1 UNION ALL SELECT * FROM (SELECT * FROM scored ORDER BY rmse, spec, vintage LIMIT 15) WHERE NOT EXISTS (SELECT 1 FROM scored WHERE ratio < 1)")
def t01_beating(s, d):
    """Specifications that beat no change at a vintage, or else the fifteen best."""
    return choice.beating(written(against_no_change(s, d)), ["spec", "vintage"], "rmse")


@query("t01_fallback", _RATIO + " SELECT spec, vintage, rmse, ratio FROM (SELECT *, min(ratio) OVER () AS low FROM scored) ORDER BY rmse, spec, vintage LIMIT 15")
def t01_fallback(s, d):
    """The fifteen best, measured against the best one of all, which none beats."""
    x = written(against_no_change(s, d))
    low = x.agg(F.min("ratio").alias("low"))
    hard = x.join(F.broadcast(low)).withColumn("over", F.col("ratio") / F.col("low"))
    return choice.beating(hard, ["spec", "vintage"], "rmse", "over").select("spec", "vintage", "rmse", "ratio")


@query("t01_closest", _RATIO + " SELECT * FROM scored ORDER BY abs(ratio - 1), spec, vintage LIMIT 3")
def t01_closest(s, d):
    """The three specifications whose error is closest to that of no change."""
    return choice.closest(written(against_no_change(s, d)), ["spec", "vintage"])


@query("a22_race_by_method", None)
def a22_race(s, d):
    """By screen: sizes that beat the line on all series, the best ratio and its size, the median ratio."""
    return choice.by_method(written(m08(s, d)))


@query("m12_consensus", None)
def m12(s, d):
    """What the screens that beat the line on all series agree on, in their order, with the race's score of the group."""
    rows, quarters, known, _ = _quarters(s, d)
    y = np.array([known.get(q, np.nan) for q in quarters if str(q) < TEST])
    skip = int(np.isnan(y[:1]).sum())
    rows = written(rows.select("ticket", F.slice("x", 1 + skip, len(y) - skip).alias("x"), F.slice("seen", 1 + skip, len(y) - skip).alias("seen")))
    ranked = members(s, d)
    agreed = written(choice.agreed(ranked, written(race.race(ranked, rows, y[skip:], (5, 40)))))
    scores = race.race(agreed.select(F.col("name").alias("method"), "ticket", "rank"), rows, y[skip:], (3, 40))
    return rounded(choice.kept(agreed, scores), "mse", "ratio")


#: Groups written down by hand; the last ticket of each is in no panel of the test data.
FROZEN = (("frozen1", "S0000003 S0000001 S0000003 S0000007 X0000001"), ("frozen2", " S0000009  S0000002 S0000005 S0000004 X0000002"), ("frozen3", "X0000003"))


@query(
    "m12_frozen_groups",
    """, frozen AS (SELECT spec, i, ticket, t.ticket IS NOT NULL AS there FROM (VALUES ('frozen1', 1, 'S0000003'), ('frozen1', 2, 'S0000001'), ('frozen1', 3, 'S0000007'), ('frozen1', 4, 'X0000001'), ('frozen2', 1, 'S0000009'), ('frozen2', 2, 'S0000002'), ('frozen2', 3, 'S0000005'), ('frozen2', 4, 'S0000004'), ('frozen2', 5, 'X0000002'), ('frozen3', 1, 'X0000003')) AS f(spec, i, ticket) LEFT JOIN (SELECT DISTINCT ticket FROM obs) t USING (ticket))
SELECT spec, count(*) FILTER (there) AS size, coalesce(string_agg(ticket, ' ' ORDER BY i) FILTER (there), '') AS selected, coalesce(string_agg(ticket, ' ' ORDER BY i) FILTER (NOT there), '') AS missing FROM frozen GROUP BY 1""",
)
def m12_frozen(s, d):
    """Groups written down by hand: the tickets this panel has, and those it lacks."""
    return choice.fixed(s.createDataFrame(list(FROZEN), "spec string, tickets string"), obs(s, d))


@query(
    "e13_oracle_panel",
    POOL + """, one AS (SELECT date, spec, 'OLS' AS estimator, CAST(regexp_extract(spec, '^Brand#([0-9]+)$', 1) AS INTEGER) AS k, pred, actual FROM readings WHERE vintage = 1), mid AS (SELECT date, round(median(pred), 9) AS pool_median FROM one GROUP BY 1)
SELECT one.date, spec, estimator, k, pred, actual, round(median(pred) OVER (PARTITION BY one.date), 9) AS panel_median, pool_median FROM one JOIN mid USING (date) WHERE k IN (12, 13, 24, 31, 55)""",
)
def e13(s, d):
    """Lines of five brands at vintage 1 beside their median and the pool's."""
    r = readings(s, d).withColumn("estimator", F.lit("OLS"))
    return rounded(choice.sized_panel(r, ["Brand#"], [12, 13, 24, 31, 55], ["OLS"], 1), "panel_median", "pool_median", places=9)


_ALIGNED = f""", aobs AS (SELECT ticket, CAST(date + to_months(CAST(greatest(months_lag + 2, 0) AS INTEGER)) AS DATE) AS date, value, agg_method FROM obs JOIN meta USING (ticket)),
aq AS (SELECT ticket, {QS} AS date, CASE any_value(agg_method) WHEN 'mean' THEN avg(value) WHEN 'last' THEN max_by(value, date) ELSE sum(value) END AS value FROM aobs GROUP BY 1, 2),
ag AS (SELECT ticket, date, 100 * (value / nullif(lag(value) OVER (PARTITION BY ticket ORDER BY date), 0) - 1) AS growth FROM aq)"""


@query("m29_aligned_screen", _ALIGNED + _SCREEN.replace("FROM qgrowth q", "FROM ag q") + " SELECT ticket, score, rank FROM ranked")
def m29(s, d):
    """The correlation screen on series as they look two months before the quarter ends."""
    x = vintage.aligned(obs(s, d), meta(s, d), -2)
    return vintage.screened(panel.quarterly_growth(panel.to_quarter(x, meta(s, d))), _growths(s, d)[1], TEST)


# --- lines ------------------------------------------------------------------------------------------------------------


@query("m27_contiguous_folds", None)
def m27(s, d):
    """Ridge and lasso of each group at the first test quarter, their penalty by five folds of neighbouring quarters."""
    m = members(s, d)
    specs = cells.designs(groups(m)).filter("factors = 0 and flat = 3").withColumn("estimators", F.array(*map(F.lit, estimators.FOLDED)))
    table = cells.coefficients(specs, m, months(s, d, TEST, m), _y(s, d), TEST, TEST, lines=estimators.FOLDED)
    return rounded(table.filter((F.col("beta") != 0) | (F.col("ticket") == cells.CONSTANT)).select("spec", "estimator", "ticket", "lag", "beta"), "beta", places=5)


def steady(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> estimators.Line:
    """An own regressor: ridge of fixed penalty whose rows count less the farther off they are, in ten rounds."""
    v = w
    for _ in range(10):
        c, b = estimators.ridge(x, y, v, (5.0,))
        off = np.abs(y - c - x @ b)
        scale = max(float(np.median(off)), 1e-9)
        v = w / np.maximum(1.0, off / (2 * scale))
    return c, b


OWN, LIVE = "own", "2001-12-01"


def own_cells(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readings of the first four series of the correlation screen by the own regressor, with two quarters of the target, at
    every test quarter and at a live one; the target; and the coefficient table."""
    y = _y(s, d)
    y = y.filter("y is not null and date < date'%s'" % LIVE)
    spec = s.createDataFrame([(OWN, "sis", 4, 0, 3, 2, [OWN])], "spec string, method string, size int, factors int, flat int, lags int, estimators array<string>")
    m = members(s, d)
    x = months(s, d, LIVE, m)
    table = written(cells.coefficients(spec, m, x, y, TEST, lines={OWN: steady}, live=LIVE))
    asked = y.select("date", "y").unionByName(s.sql(f"select date'{LIVE}' as date, cast(null as double) as y"))
    p = y.select(F.col("date").alias("p"), "y")
    own = vintage.grid(asked).join(F.broadcast(p), (F.col("p") < F.col("date")) & (F.add_months("p", RELEASE) <= F.add_months("date", F.col("vintage"))))
    own = own.withColumn("l", F.row_number().over(W.partitionBy("date", "vintage").orderBy(F.desc("p")))).filter("l <= 2").select("date", "vintage", "l", "y")
    return cells.readings(table, x, meta(s, d), own), y, table


@query("m30_own_model", None)
def m30(s, d):
    """An own regressor on own series: error at every vintage, and the live quarter refitted on all prints."""
    r, y, _ = own_cells(s, d)
    e = r.join(F.broadcast(y), "date", "left").groupBy("vintage")
    live = F.col("date") == F.to_date(F.lit(LIVE))
    x = e.agg(F.count("y").alias("n"), accuracy.rms(F.col("pred") - F.col("y")).alias("rmse"), F.max(F.when(live, F.col("pred"))).alias("live"))
    return rounded(x, "rmse", "live", places=5)


@query("m23_survival", None)
def m23_survival(s, d):
    """The largest lasso penalty at which each series of a screen's first twelve is still in use, by their quarterly growth."""
    rows, quarters, known, _ = _quarters(s, d)
    at = [i + 1 for i, q in enumerate(quarters) if str(q) < TEST and q in known]
    y = np.array([known[quarters[i - 1]] for i in at])
    x = members(s, d).filter("rank <= 12").join(rows, "ticket").select("method", "ticket", F.transform(F.array(*map(F.lit, at)), lambda i: F.element_at("x", i)).alias("x"))
    alphas = np.geomspace(1e-3, 10**0.5, 80)

    def one(t):
        t = t.sort_values("ticket", ignore_index=True)
        path, last = estimators.survival(np.stack(t["x"].to_list()).T, y, np.ones(len(y)), alphas)
        return t[["method", "ticket"]].assign(survives=last, smallest=path[0])

    return rounded(x.groupBy("method").applyInPandas(one, "method string, ticket string, survives double, smallest double"), "survives", "smallest")


_P = """CASE WHEN df % 2 = 1 THEN 2 / pi() * (a + CASE WHEN df > 1 THEN sin(a) * cos(a) * list_sum(list_transform(range(0, (df - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cos(a), 2 * k))) ELSE 0 END)
 ELSE sin(a) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos(a), 2 * k))) END"""


@query(
    "m22_p_values",
    f""", f AS (SELECT ticket, count(*) AS n, regr_slope(y.growth, q.growth) AS slope, sqrt((1 - regr_r2(y.growth, q.growth)) * regr_syy(y.growth, q.growth) / (count(*) - 2) / regr_sxx(y.growth, q.growth)) AS se FROM qgrowth q JOIN ygrowth y USING (date) WHERE q.growth IS NOT NULL AND y.growth IS NOT NULL GROUP BY 1 HAVING count(*) > 2 AND var_pop(q.growth) > 0),
a AS (SELECT ticket, n - 2 AS df, round(slope / se, 4) AS t, atan(abs(round(slope / se, 4)) / sqrt(n - 2)) AS a FROM f WHERE se > 0) SELECT ticket, df, t, round(greatest(1 - ({_P}), 0), 5) AS p FROM a""",
)
def m22_p(s, d):
    """Slope of the target's growth on each series': t statistic to four places, and its two-sided p-value."""
    g, y = _growths(s, d)
    c = ("y", "growth")
    x = g.filter("growth is not null").join(F.broadcast(y.filter("growth is not null").withColumnRenamed("growth", "y")), "date").groupBy("ticket")
    x = x.agg(F.count("*").alias("n"), F.regr_slope(*c).alias("slope"), F.regr_r2(*c).alias("r2"), F.regr_syy(*c).alias("syy"), F.regr_sxx(*c).alias("sxx")).filter("n > 2 and sxx > 0")
    x = x.withColumn("df", F.col("n") - 2).withColumn("se", F.sqrt((1 - F.col("r2")) * F.col("syy") / F.col("df") / F.col("sxx"))).filter("se > 0").withColumn("t", F.round(F.col("slope") / F.col("se"), 4))
    return x.select("ticket", "df", "t", F.round(choice.two_sided(F.col("t"), F.col("df")), 5).alias("p"))


THETAS = (0.0, -0.25, -0.5, -1.0, -2.0)
_LAGGED = " + ".join(f"m{k} * exp({k} * th)" for k in range(6))
_NORM = " + ".join(f"exp({k} * th)" for k in range(6))


@query(
    "m25_combined",
    f""", c AS (SELECT ticket, date, value AS m0, {', '.join(f'lag(value, {k}) OVER w AS m{k}' for k in range(1, 6))} FROM obs WINDOW w AS (PARTITION BY ticket ORDER BY date)),
x AS (SELECT ticket, date, y.growth AS y, th, ({_LAGGED}) / ({_NORM}) AS x FROM c JOIN ygrowth y USING (date), unnest([0.0, -0.25, -0.5, -1.0, -2.0]) AS t(th) WHERE m5 IS NOT NULL AND y.growth IS NOT NULL),
f AS (SELECT ticket, th, round(regr_r2(y, x), 6) AS r2, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM x GROUP BY 1, 2 HAVING count(*) >= 8),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY r2 DESC, th DESC) AS r FROM f) WHERE r = 1), p AS (SELECT ticket, date, round(intercept + slope * x, 6) AS pred, y AS actual FROM x JOIN b USING (ticket, th)),
e AS (SELECT ticket, sqrt(avg(pow(pred - actual, 2))) AS rmse FROM p GROUP BY 1), u AS (SELECT ticket, CASE WHEN (SELECT max(rmse) > min(rmse) FROM e) THEN (SELECT max(rmse) FROM e) - rmse ELSE 1 END AS w FROM e)
SELECT date, count(*) AS n, round(avg(pred), 5) AS mean, CASE WHEN sum(w) > 0 THEN round(sum(w * pred) / sum(w), 5) END AS weighted, round(max(actual), 6) AS actual FROM p JOIN u USING (ticket) WHERE pred IS NOT NULL GROUP BY 1""",
)
def m25_combined(s, d):
    """Mixed-frequency lines of one series each, put together: plain mean, and weighted by distance from the worst fit."""
    by = W.partitionBy("ticket").orderBy("date")
    c = obs(s, d).select("ticket", "date", *[F.lag("value", k).over(by).alias(f"m{k}") for k in range(6)]).filter("m5 is not null")
    y = _growths(s, d)[1].filter("growth is not null").select("date", F.col("growth").alias("y"))
    x = c.join(F.broadcast(y), "date").withColumn("theta", F.explode(F.array(*map(F.lit, THETAS))))
    w = [F.exp(k * F.col("theta")) for k in range(6)]
    x = x.select("ticket", "date", "y", "theta", (sum(F.col(f"m{k}") * w[k] for k in range(6)) / sum(w)).alias("x"))
    f = x.groupBy("ticket", "theta").agg(F.count("*").alias("n"), F.round(F.regr_r2("y", "x"), 6).alias("r2"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")).filter("n >= 8")
    best = f.groupBy("ticket").agg(F.max_by(F.struct("theta", "slope", "intercept"), F.struct("r2", "theta")).alias("b")).select("ticket", "b.*")
    p = x.join(best, ["ticket", "theta"]).select("ticket", "date", F.round(F.col("intercept") + F.col("slope") * F.col("x"), 6).alias("pred"), F.col("y").alias("actual"))
    return rounded(rounded(choice.weighted_by_distance(written(p)), "mean", "weighted", places=5), "actual")


# --- tables beside those of other modules -----------------------------------------------------------------------------


@query(
    "p18_resolved",
    _MEMBERS + """ SELECT CASE WHEN (g.method, g.size) = (SELECT (method, size) FROM best) THEN 'bench' ELSE g.method END || g.size || design AS spec, g.method, CAST(g.size AS INTEGER) AS k, CASE design WHEN '' THEN 'base' ELSE design END AS variant
FROM grp g, (VALUES ('', 0), ('flats', 0), ('p5', 5), ('p3', 3), ('p5l2', 5)) AS t(design, factors) WHERE factors = 0 OR factors < g.size""",
)
def p18_resolved(s, d):
    """Names of specifications in their parts; `bench` is resolved to the method it stands for."""
    specs = cells.designs(groups(members(s, d)))
    stands = specs.filter(F.col("spec").startswith("bench")).select("spec", F.col("method").alias("stands"))
    x = specs.select("spec", *texts.spec_parts(F.col("spec"), r"^(sis|tstat|bench)([0-9]+)(flats|p5l2|p5|p3)?$")).join(F.broadcast(stands), "spec", "left")
    return x.select("spec", F.coalesce("stands", "method").alias("method"), "k", F.when(F.col("variant") == "", "base").otherwise(F.col("variant")).alias("variant"))


@query("p21_legacy_names", " SELECT DISTINCT date, CAST(v AS BIGINT) AS vintage, CASE v WHEN -2 THEN 'two_back' WHEN -1 THEN 'one_back' WHEN 0 THEN 'zero_back' WHEN 1 THEN 'one_ahead' ELSE 'two_ahead' END AS name FROM target, unnest(range(-2, 3)) AS t(v)")
def p21_legacy(s, d):
    """The grid from -2 to 2 keeps its own names."""
    five = range(-2, 3)
    return vintage.grid(target(s, d)).filter(F.col("vintage").isin(*five)).select("date", F.col("vintage").cast("long").alias("vintage"), texts.vintage_name(F.col("vintage"), five).alias("name"))


def _converted(kind: str, at: str) -> str:
    return f"SELECT ticket, {at} AS stamp, max_by(value, date) AS value FROM kinds WHERE {kind} GROUP BY 1, 2"


@query(
    "a03_converted",
    f""", kinds AS (SELECT ticket, date, value, CAST(right(ticket, 1) AS INTEGER) % 4 AS k FROM obs), m AS ({_converted('k < 2', "CAST(date_trunc('month', date) AS DATE)")}), q AS ({_converted('k = 2', QS)}), y AS ({_converted('k = 3', "CAST(date_trunc('year', date) AS DATE)")}),
one AS (SELECT ticket, stamp AS date, value FROM m UNION ALL SELECT ticket, stamp, value FROM q)
SELECT 'jan' AS yearly, * FROM one UNION ALL SELECT 'jan', ticket, stamp, value FROM y UNION ALL SELECT 'ffill', * FROM one UNION ALL SELECT 'ffill', ticket, CAST(stamp + to_months(CAST(i AS INTEGER)) AS DATE), value FROM y, unnest(range(0, 12)) AS t(i)""",
)
def a03_converted(s, d):
    """Series taken as monthly, quarterly and yearly by their last digit, at month starts; years at January, then in all months."""
    x = obs(s, d)
    digit = F.substring("ticket", -1, 1).cast("int") % 4
    kinds = x.select("ticket").distinct().withColumn("frequency", F.when(digit == 2, "quarterly").when(digit == 3, "yearly").when(digit == 1, "irregular").otherwise("monthly"))
    jan, all_ = (panel.to_months(x, kinds, y).select(F.lit(y).alias("yearly"), "ticket", "date", "value") for y in ("jan", "ffill"))
    return jan.unionByName(all_)


@query(
    "a29_box",
    ERRORS + """, q AS (SELECT vintage, quantile_cont(rmse, 0.25) AS q1, quantile_cont(rmse, 0.5) AS med, quantile_cont(rmse, 0.75) AS q3 FROM m WHERE rmse IS NOT NULL GROUP BY 1), x AS (SELECT *, rmse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS within FROM m JOIN q USING (vintage) WHERE rmse IS NOT NULL)
SELECT vintage, round(q1, 9) AS q1, round(med, 9) AS median, round(q3, 9) AS q3, min(rmse) FILTER (within) AS low, max(rmse) FILTER (within) AS high, count(*) FILTER (NOT within) AS beyond FROM x GROUP BY 1, 2, 3, 4""",
)
def a29_box(s, d):
    """Box statistics of the errors at each vintage."""
    return rounded(accuracy.box(rounded(pool.errors(readings(s, d)), "rmse"), "rmse", ["vintage"]), "q1", "median", "q3", places=9)


@query("a30_spec_flags", POOL + ", m AS (SELECT spec, vintage, sqrt(avg(pow(pred - actual, 2))) AS rmse FROM readings GROUP BY 1, 2), k AS (SELECT spec, median(rmse) AS med FROM m GROUP BY 1) SELECT spec, round(med, 5) AS med, med > (SELECT median(med) FROM k) AS above FROM k")
def a30_flags(s, d):
    """All specifications, flagged where their median error is above the median of medians."""
    k = written(pool.errors(readings(s, d)).groupBy("spec").agg(F.median("rmse").alias("med")))
    return k.join(F.broadcast(k.agg(F.median("med").alias("mid")))).select("spec", F.round("med", 5).alias("med"), (F.col("med") > F.col("mid")).alias("above"))


@query(
    "w11_two_lags",
    WEIGHTS + """, n AS (SELECT date, vintage, round(sum(pred * w) / sum(w), 5) AS nowcast FROM weighted GROUP BY 1, 2), g AS (SELECT t.date, CAST(v AS INTEGER) AS vintage, CAST(l AS INTEGER) AS l, CAST(t.date - to_months(CAST(3 * l AS INTEGER)) AS DATE) AS q FROM ygrowth t, unnest(range(-2, 7)) AS u(v), unnest([1, 2]) AS k(l)),
own AS (SELECT g.date, g.vintage, l, max_by(n.nowcast, n.vintage) AS own FROM g JOIN n ON n.date = g.q AND n.vintage <= g.vintage + 3 * l GROUP BY 1, 2, 3),
seen AS (SELECT g.date, g.vintage, l, max_by(y.growth, y.date) AS recent, max(y.date) AS recent_date FROM g JOIN ygrowth y ON y.date <= g.q AND y.date + INTERVAL 2 MONTH <= g.date + to_months(g.vintage) WHERE y.growth IS NOT NULL GROUP BY 1, 2, 3)
SELECT g.date, g.vintage, g.l, round(coalesce(CASE WHEN recent_date = g.q THEN recent END, own, recent), 5) AS y FROM g LEFT JOIN own USING (date, vintage, l) LEFT JOIN seen USING (date, vintage, l)""",
)
def w11_two(s, d):
    """The two quarters before, at each reading: print, else own latest nowcast, else the latest print before."""
    n = rounded(pool.combined(pool.weights(readings(s, d), RELEASE)), "nowcast", places=5)
    return rounded(vintage.chained_lags(n, _y(s, d), RELEASE), "y", places=5)


_SAMPLE = """SELECT vintage, '{name}' AS sample, count(*) AS quarters, round(sqrt(avg(pow(nowcast - actual, 2))), 5) AS rmse, round(avg(abs(nowcast - actual)), 5) AS mae, round(sqrt(avg(pow(mid - actual, 2))), 5) AS rmse_median, round(sqrt(avg(pow(nc - actual, 2))), 5) AS rmse_no_change,
  count(*) FILTER (actual BETWEEN lo_80 AND hi_80) AS in_80, count(*) FILTER (actual BETWEEN lo_95 AND hi_95) AS in_95 FROM t WHERE {where} GROUP BY 1"""


@query(
    "a15_bands",
    _ALL + _bands() + """, nc AS (SELECT date, round(lag(growth) OVER (ORDER BY date), 6) AS nc FROM ygrowth),
t AS (SELECT date, vintage, max(actual) AS actual, max(prints) AS prints, sum(w * pred) / sum(w) AS nowcast, median(pred) AS mid, any_value(round(p10, 4)) AS lo_80, any_value(round(p90, 4)) AS hi_80, any_value(round(p025, 4)) AS lo_95, any_value(round(p975, 4)) AS hi_95, any_value(nc) AS nc
  FROM w JOIN bands USING (date, vintage) LEFT JOIN nc USING (date) WHERE actual IS NOT NULL GROUP BY 1, 2) """ + _SAMPLE.format(name="all", where="true") + " UNION ALL " + _SAMPLE.format(name="after", where="prints >= 3"),
)
def a15_bands(s, d):
    """Accuracy of the published nowcast at each vintage, in all quarters and behind the burn-in, with hits of its bands."""
    r = written(readings(s, d))
    w = written(ensemble.weights(r, regime_log(s, d, r), RELEASE, e04(s, d).select("spec", "residual")))
    b = ensemble.bands(w).select("date", "vintage", *[F.round(c, 4).alias(c) for c in ("lo_80", "hi_80", "lo_95", "hi_95")])
    each = w.groupBy("date", "vintage").agg(F.median("pred").alias("median"), (F.max("prints") < 3).alias("burn_in"))
    x = ensemble.nowcast(w).select("date", "vintage", "actual", "nowcast").join(each, ["date", "vintage"]).join(b, ["date", "vintage"])
    return rounded(accuracy.scored(x, y_growth(s, d)), "rmse", "mae", "rmse_median", "rmse_no_change", places=5)
