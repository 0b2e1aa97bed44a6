"""Queries that choose series: screens, pruning, factors, judged sets, and the record of a shock quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import panel, pool, screens
from tidemark.plans.pool_queries import POOL, readings
from tidemark.plans.queries import _SCREEN, TEST, _growths, query, rounded
from tidemark.sources.files import written
from tidemark.testbed import target

FIRST = "1995-06-01"
_T = f""", yl AS (SELECT date, growth AS y, lag(growth) OVER (ORDER BY date) AS y1, lag(growth, 2) OVER (ORDER BY date) AS y2 FROM ygrowth WHERE date < DATE '{TEST}'),
smp AS (SELECT ticket, date, q.growth AS x, y, y1, y2 FROM qgrowth q JOIN yl USING (date) WHERE q.growth IS NOT NULL AND y IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL),
mom AS (SELECT ticket, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(y1) AS m1, avg(y2) AS m2, var_pop(y1) AS v1, var_pop(y2) AS v2, covar_pop(y1, y2) AS v12, covar_pop(x, y1) AS x1, covar_pop(x, y2) AS x2, covar_pop(y, y1) AS p1, covar_pop(y, y2) AS p2 FROM smp GROUP BY 1 HAVING count(*) > 5 AND var_pop(x) > 0),
res AS (SELECT ticket, date, n, x - mx - ((x1 * v2 - x2 * v12) * (y1 - m1) + (x2 * v1 - x1 * v12) * (y2 - m2)) / (v1 * v2 - v12 * v12) AS rx, y - my - ((p1 * v2 - p2 * v12) * (y1 - m1) + (p2 * v1 - p1 * v12) * (y2 - m2)) / (v1 * v2 - v12 * v12) AS ry FROM smp JOIN mom USING (ticket)),
slope AS (SELECT ticket, sum(rx * ry) / sum(rx * rx) AS b, sum(rx * rx) AS sxx FROM res GROUP BY 1),
moment AS (SELECT ticket, date, n, b, sxx, rx * (ry - b * rx) AS g, row_number() OVER (PARTITION BY ticket ORDER BY date) AS i FROM res JOIN slope USING (ticket)),
near AS (SELECT a.ticket, sum(a.g * c.g * (1 - abs(a.i - c.i) / 5.0)) AS s FROM moment a JOIN moment c ON a.ticket = c.ticket AND abs(a.i - c.i) <= 4 GROUP BY 1),
tstat AS (SELECT ticket, n, round(abs(b) * sxx / sqrt(s), 6) AS score FROM (SELECT DISTINCT ticket, n, b, sxx FROM moment) JOIN near USING (ticket))"""


@query("m02_tstat", _T + " SELECT ticket, n, score FROM tstat")
def m02(s, d):
    return rounded(screens.t_statistics(*_growths(s, d), TEST), "score")


@query("m03_multiple_testing", None)
def m03(s, d):
    return rounded(screens.multiple_testing(*_growths(s, d), TEST), "score")


@query("m04_model_averaging", None)
def m04(s, d):
    return rounded(screens.model_averaging(*_growths(s, d), TEST), "score", places=5)


@query("m09_factor_count", None)
def m09(s, d):
    """Criteria for 0 to 10 factors; each least one names a number of factors."""
    found = screens.factor_criteria(*screens.products(screens.whole_rows(_growths(s, d)[0], FIRST, TEST)))
    return rounded(s.createDataFrame(found, "r int, ic1 double, ic2 double, ic3 double"), "ic1", "ic2", "ic3")


@query("m11_factors", None)
def m11(s, d):
    """Five factors fitted before the test quarter and read on every quarter, also later ones."""
    g = _growths(s, d)[0]
    rows = screens.whole_rows(g, FIRST, TEST)
    return rounded(screens.projected(g, screens.loadings(rows, screens.products(rows)[0], 5)), "value", places=5)


def rankings(s: SparkSession, d: str, most: int = 40) -> DataFrame:
    """(method, ticket, rank): the first series of the correlation and of the t-statistic screen."""
    from tidemark.operators import vintage

    both = [(m, x.select("ticket", "score")) for m, x in (("sis", vintage.screened(*_growths(s, d), TEST)), ("tstat", rounded(screens.t_statistics(*_growths(s, d), TEST), "score")))]
    out = [x.orderBy(F.desc("score"), "ticket").limit(most).select(F.lit(m).alias("method"), "ticket", F.row_number().over(W.orderBy(F.desc("score"), "ticket")).alias("rank")) for m, x in both]
    return out[0].unionByName(out[1])


@query("m07_frozen_errors", None)
def m07(s, d):
    """Test errors of prefixes of two rankings, all by one recipe."""
    g, y = _growths(s, d)
    return rounded(screens.frozen_errors(rankings(s, d), g, y, TEST, [5, 10, 20, 40]), "rmse", places=5)


@query("m28_race", None)
def m28(s, d):
    """Each set's test error over that of the training mean; kept below 1."""
    y = target(s, d).select("date", panel.growth(F.col("y"), F.lag("y").over(W.orderBy("date"))).alias("growth")).filter("growth is not null")
    test = F.col("date") >= F.to_date(F.lit(TEST))
    naive = y.filter(test).join(F.broadcast(y.filter(~test).agg(F.avg("growth").alias("m")))).agg(F.sqrt(F.avg((F.col("growth") - F.col("m")) ** 2)).alias("naive"))
    x = m07(s, d).join(F.broadcast(naive)).withColumn("ratio", F.round(F.col("rmse") / F.col("naive"), 4))
    return x.select("method", "size", "rmse", "ratio", (F.col("ratio") < 1).alias("kept"))


_PAIRS = ", pairs AS (SELECT a.ticket AS a, b.ticket AS b, corr(a.growth, b.growth) AS r FROM qgrowth a JOIN qgrowth b ON a.date = b.date AND a.ticket < b.ticket WHERE a.growth IS NOT NULL AND b.growth IS NOT NULL GROUP BY 1, 2)"


@query(
    "d12_pruned",
    _SCREEN + _PAIRS + """, bad AS (SELECT x AS ticket, list(y) AS near FROM (SELECT a AS x, b AS y, r FROM pairs UNION ALL SELECT b, a, r FROM pairs) WHERE abs(r) >= 0.5 GROUP BY 1),
steps AS (SELECT rank, ticket, score, coalesce(near, []) AS near FROM ranked LEFT JOIN bad USING (ticket))
SELECT ticket, score FROM ranked WHERE ticket IN (SELECT unnest(kept) FROM (
  WITH RECURSIVE walk AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS kept UNION ALL
    SELECT i + 1, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, ticket) END FROM walk JOIN steps ON rank = i + 1)
  SELECT kept FROM walk ORDER BY i DESC LIMIT 1))""",
)
def d12(s, d):
    """The walk down the correlation screen; at 0.5, since few of these series reach the usual 0.8."""
    from tidemark.operators import vintage

    g, y = _growths(s, d)
    g = written(g)
    return screens.pruned_along(vintage.screened(g, y, TEST).select("ticket", "score"), g.filter("growth is not null").withColumnRenamed("growth", "value"), 0.5)


_SHOCK = """, shock AS (SELECT min_by(date, growth) AS date, min(growth) AS actual FROM ygrowth WHERE growth IS NOT NULL),
cell AS (SELECT bg.spec, bg.date, bg.growth AS x, y.growth AS y FROM bg JOIN ygrowth y USING (date) WHERE bg.growth IS NOT NULL AND y.growth IS NOT NULL),
line AS (SELECT spec, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM cell WHERE date <> (SELECT date FROM shock) GROUP BY 1 HAVING count(*) >= 8),
loo AS (SELECT spec, cell.date AS shock_date, round(cell.y, 6) AS actual, round(a + b * x, 6) AS predicted, round(a + b * x, 6) - round(cell.y, 6) AS residual FROM cell JOIN line USING (spec) JOIN shock ON cell.date = shock.date)"""


def shock_residuals(s: SparkSession, d: str) -> DataFrame:
    """Each brand's line refitted without the target's worst quarter, and its error there."""
    from tidemark.functions.calendar import quarter_stamp
    from tidemark.testbed import read

    sales = read(s, d, "lineitem").join(read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q = sales.groupBy(F.col("p_brand").alias("ticket"), quarter_stamp("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("value"))
    y = _growths(s, d)[1].filter("growth is not null").withColumnRenamed("growth", "y")
    shock = F.broadcast(y.agg(F.min_by("date", "y").alias("shock_date")))
    x = panel.quarterly_growth(q).filter("growth is not null").join(F.broadcast(y), "date").join(shock)
    held = F.col("date") == F.col("shock_date")
    fit = x.groupBy(F.col("ticket").alias("spec"), "shock_date").agg(
        F.regr_slope(F.when(~held, F.col("y")), F.when(~held, F.col("growth"))).alias("b"), F.regr_intercept(F.when(~held, F.col("y")), F.when(~held, F.col("growth"))).alias("a"),
        F.count_if(~held).alias("n"), F.max(F.when(held, F.col("y"))).alias("y"), F.max(F.when(held, F.col("growth"))).alias("x"),
    )
    out = fit.filter("n >= 8 and x is not null").select("spec", "shock_date", F.round("y", 6).alias("actual"), F.round(F.col("a") + F.col("b") * F.col("x"), 6).alias("predicted"))
    return out.withColumn("residual", F.col("predicted") - F.col("actual"))


@query("m19_shock_residuals", POOL + _SHOCK + " SELECT spec, shock_date, actual, predicted, round(residual, 5) AS residual FROM loo")
def m19(s, d):
    return rounded(shock_residuals(s, d), "residual", places=5)


@query("e03_robust_order", POOL + _SHOCK + " SELECT spec, round(abs(residual), 5) AS score FROM loo ORDER BY 2, 1")
def e03(s, d):
    return shock_residuals(s, d).select("spec", F.round(F.abs("residual"), 5).alias("score")).orderBy("score", "spec")


_NAMED = "spec NOT LIKE '%3'"


@query("e04_shock_record", POOL + _SHOCK + f", own AS (SELECT spec, residual FROM loo WHERE {_NAMED}) SELECT spec, round(residual, 5) AS residual, true AS own FROM own UNION ALL SELECT spec, round((SELECT median(abs(residual)) FROM own), 5), false FROM (SELECT DISTINCT spec FROM readings) WHERE spec NOT IN (SELECT spec FROM own)")
def e04(s, d):
    """Brands that end in 3 play the cells that were never refitted: they stand at the median size of the others' errors."""
    own = shock_residuals(s, d).filter(_NAMED).select("spec", "residual", F.lit(True).alias("own"))
    mid = own.groupBy("spec").agg(F.sqrt(F.avg(F.col("residual") ** 2)).alias("rmse")).agg(F.median("rmse").alias("residual"))
    rest = readings(s, d).select("spec").distinct().join(own, "spec", "left_anti").join(F.broadcast(mid)).select("spec", "residual", F.lit(False).alias("own"))
    return rounded(own.unionByName(rest), "residual", places=5)


@query(
    "m22_diagnostics",
    _SHOCK.split("cell AS")[0] + """j AS (SELECT ticket, date, q.growth AS x, y.growth AS y FROM qgrowth q JOIN ygrowth y USING (date) WHERE q.growth IS NOT NULL AND y.growth IS NOT NULL),
b AS (SELECT *, false AS without_shock FROM j UNION ALL SELECT *, true FROM j WHERE date <> (SELECT date FROM shock)),
f AS (SELECT ticket, without_shock, count(*) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / (count(*) - 2) / regr_sxx(y, x)) AS se FROM b GROUP BY 1, 2 HAVING count(*) > 2 AND var_pop(x) > 0)
SELECT ticket, without_shock, n, round(slope, 6) AS slope, round(slope / se, 5) AS t, round(r2, 6) AS r2 FROM f""",
)
def m22(s, d):
    """Slope, t and R2 of each series' line, with the target's worst quarter and without it."""
    g, y = _growths(s, d)
    y = y.filter("growth is not null").withColumnRenamed("growth", "y")
    x = g.filter("growth is not null").join(F.broadcast(y), "date").join(F.broadcast(y.agg(F.min_by("date", "y").alias("shock"))))
    x = x.withColumn("without_shock", F.explode(F.when(F.col("date") == F.col("shock"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    c = ("y", "growth")
    fit = x.groupBy("ticket", "without_shock").agg(F.count("*").alias("n"), F.regr_slope(*c).alias("slope"), F.regr_r2(*c).alias("r2"), F.regr_syy(*c).alias("syy"), F.regr_sxx(*c).alias("sxx")).filter("n > 2 and sxx > 0")
    se = F.sqrt((1 - F.col("r2")) * F.col("syy") / (F.col("n") - 2) / F.col("sxx"))
    return fit.select("ticket", "without_shock", "n", F.round("slope", 6).alias("slope"), F.round(F.col("slope") / se, 5).alias("t"), F.round("r2", 6).alias("r2"))


@query("a22_guarded_pool", POOL + ", e AS (SELECT spec, vintage, sqrt(avg(pow(pred - actual, 2))) AS rmse FROM readings WHERE abs(pred) <= 20 GROUP BY 1, 2), b AS (SELECT vintage, median(rmse) AS mid FROM e GROUP BY 1) SELECT vintage, count(*) FILTER (rmse < mid) AS better, round(min(rmse), 5) AS best, arg_min(spec, rmse) AS spec, round(median(rmse), 5) AS median FROM e JOIN b USING (vintage) GROUP BY 1")
def a22(s, d):
    """By vintage: cells better than the median one, the best cell and its error, readings beyond 20 left out."""
    e = pool.errors(pool.guarded(readings(s, d), 20.0).filter("pred is not null"))
    b = e.groupBy("vintage").agg(F.median("rmse").alias("mid"))
    return e.join(F.broadcast(b), "vintage").groupBy("vintage").agg(F.count_if(F.col("rmse") < F.col("mid")).alias("better"), F.round(F.min("rmse"), 5).alias("best"), F.min_by("spec", "rmse").alias("spec"), F.round(F.median("rmse"), 5).alias("median"))


@query("m10_rolling_screen", f", t AS (SELECT date AS as_of FROM ygrowth WHERE date >= DATE '{TEST}'), c AS (SELECT as_of, ticket, round(abs(corr(q.growth, y.growth)), 8) AS score, count(*) AS n FROM qgrowth q JOIN ygrowth y USING (date) JOIN t ON date < as_of WHERE q.growth IS NOT NULL AND y.growth IS NOT NULL GROUP BY 1, 2) SELECT as_of, ticket, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY as_of ORDER BY score DESC, ticket) AS INTEGER) AS rank FROM c WHERE n >= 8 AND score IS NOT NULL AND NOT isnan(score)) WHERE rank <= 20")
def m10(s, d):
    """The correlation screen anew before each test quarter."""
    return screens.rolling_screen(*_growths(s, d), TEST, 20)


ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]


@query("m23_penalty_path", None)
def m23(s, d):
    """Ridge lines of two rankings' prefixes over all penalties."""
    return rounded(screens.ridge_path(rankings(s, d), *_growths(s, d), TEST, [5, 10, 20], ALPHAS), "loo", "norm", "rmse", places=5)


@query("m15_ridge", None)
def m15(s, d):
    """Of each prefix the penalty with the least error of quarters left out."""
    best = m23(s, d).groupBy("method", "size").agg(F.min_by(F.struct("alpha", "loo", "rmse"), F.struct("loo", "alpha")).alias("b"))
    return best.select("method", "size", "b.*")
