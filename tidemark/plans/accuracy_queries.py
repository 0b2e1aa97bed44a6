"""Queries on how well readings did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import accuracy, panel, pool, vintage
from tidemark.plans.pool_queries import POOL, readings
from tidemark.plans.queries import query, rounded
from tidemark.testbed import meta, obs, target

ERRORS = POOL + ", m AS (SELECT spec, vintage, round(sqrt(avg(pow(pred - actual, 2))), 6) AS rmse FROM readings GROUP BY 1, 2)"
GROUP = "substr(spec, 1, 7)"


def errors(s: SparkSession, d: str) -> DataFrame:
    return rounded(pool.errors(readings(s, d)), "rmse").filter("rmse is not null")


def group():
    return F.substring("spec", 1, 7)


def y_growth(s: SparkSession, d: str) -> DataFrame:
    return target(s, d).select("date", F.round(panel.growth(F.col("y"), F.lag("y").over(W.orderBy("date"))), 6).alias("growth"))


@query(
    "a15_accuracy",
    POOL + """, e AS (SELECT vintage, round(sqrt(avg(pow(pred - actual, 2))), 5) AS rmse, round(avg(abs(pred - actual)), 5) AS mae, count(*) AS n FROM readings WHERE actual IS NOT NULL GROUP BY 1),
b AS (SELECT date, round(lag(growth) OVER (ORDER BY date), 6) AS nc FROM ygrowth), k AS (SELECT date, vintage, median(pred) AS mid, max(actual) AS actual FROM readings WHERE actual IS NOT NULL GROUP BY 1, 2),
c AS (SELECT vintage, round(sqrt(avg(pow(mid - actual, 2))), 5) AS rmse_median, round(sqrt(avg(pow(nc - actual, 2))), 5) AS rmse_no_change FROM k JOIN b USING (date) GROUP BY 1) SELECT * FROM e JOIN c USING (vintage)""",
)
def a15(s, d):
    return rounded(accuracy.table(readings(s, d), y_growth(s, d)), "rmse", "mae", "rmse_median", "rmse_no_change", places=5)


@query(
    "a16_interval",
    ERRORS + """, x AS (SELECT date, vintage, sum(pred / rmse) / sum(1 / rmse) AS mean, 1 / sqrt(sum(1 / rmse)) AS se FROM readings JOIN m USING (spec, vintage) WHERE rmse > 0 GROUP BY 1, 2)
SELECT date, vintage, round(mean, 5) AS mean, round(se, 5) AS se, round(mean - 1.96 * se, 5) AS low, round(mean + 1.96 * se, 5) AS high FROM x""",
)
def a16(s, d):
    return rounded(accuracy.interval(readings(s, d), errors(s, d)), "mean", "se", "low", "high", places=5)


@query("a18_inverse_square", ERRORS + " SELECT spec, vintage, round(pow(rmse, -2) / sum(pow(rmse, -2)) OVER (PARTITION BY vintage), 7) AS w FROM m WHERE rmse > 0")
def a18(s, d):
    return rounded(accuracy.inverse_square(errors(s, d)), "w", places=7)


@query("a20_ranges", POOL + " SELECT date, min(pred) AS low, max(pred) AS high, round(quantile_cont(pred, 0.05), 9) AS p05, round(quantile_cont(pred, 0.95), 9) AS p95 FROM readings GROUP BY 1")
def a20(s, d):
    return rounded(accuracy.ranges(readings(s, d)), "p05", "p95", places=9)


@query("a21_group_means", POOL + f" SELECT date, vintage, grp, round(s / n, 9) AS mean, round(sum(s) OVER w / sum(n) OVER w, 9) AS pool_mean FROM (SELECT date, vintage, {GROUP} AS grp, sum(pred) AS s, count(pred) AS n FROM readings GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY date, vintage)")
def a21(s, d):
    return rounded(accuracy.by_group(readings(s, d), group()), "mean", "pool_mean", places=9)


@query(
    "a22_head_to_head",
    ERRORS + f""", r AS (SELECT spec, vintage, round(rmse / median(rmse) OVER (PARTITION BY vintage), 6) AS ratio FROM m WHERE rmse IS NOT NULL)
SELECT {GROUP} AS grp, count(*) FILTER (WHERE ratio < 1) AS better, min(ratio) AS best, arg_min(spec, struct_pack(ratio := ratio, spec := spec, vintage := vintage)) AS best_spec, round(median(ratio), 9) AS mid FROM r GROUP BY 1""",
)
def a22(s, d):
    return rounded(accuracy.head_to_head(errors(s, d), group()), "mid", places=9)


_TOP = ", top AS (SELECT vintage, spec FROM (SELECT *, row_number() OVER (PARTITION BY vintage ORDER BY rmse, spec) AS r FROM m WHERE rmse IS NOT NULL) WHERE r <= 5)"


@query("a23_overlap", ERRORS + _TOP + " SELECT x.vintage AS a, y.vintage AS b, count(*) / 5.0::DOUBLE AS share FROM top x JOIN top y USING (spec) GROUP BY 1, 2")
def a23(s, d):
    return accuracy.overlap(accuracy.top(errors(s, d), 5), 5)


@query("a26_share_of_squares", ", g AS (SELECT date, pow(y - avg(y) OVER (), 2) AS q FROM target) SELECT date, round(q / sum(q) OVER (), 8) AS share FROM g")
def a26(s, d):
    """Each quarter's share of the target's total sum of squares."""
    y = target(s, d)
    q = y.crossJoin(F.broadcast(y.agg(F.avg("y").alias("mean")))).select("date", F.pow(F.col("y") - F.col("mean"), F.lit(2)).alias("q"))
    return q.crossJoin(F.broadcast(q.agg(F.sum("q").alias("all")))).select("date", F.round(F.col("q") / F.col("all"), 8).alias("share"))


_BIN = "CAST(CASE WHEN {x} < {a} THEN 0 WHEN {x} >= {b} THEN {n} + 1 ELSE floor(({x} - ({a})) * {n} / ({b} - ({a}))) + 1 END AS INTEGER)"


@query("a29_error_histogram", ERRORS + f" SELECT vintage, {_BIN.format(x='rmse', a=0.0, b=40.0, n=20)} AS bin, count(*) AS n FROM m WHERE rmse IS NOT NULL GROUP BY 1, 2")
def a29(s, d):
    return accuracy.histogram(errors(s, d), "rmse", ["vintage"], 0.0, 40.0, 20)


@query("a29_below_median", ERRORS + " SELECT spec, vintage, rmse FROM (SELECT *, median(rmse) OVER (PARTITION BY vintage) AS mid FROM m) WHERE rmse <= mid")
def a29b(s, d):
    return accuracy.at_most(errors(s, d), F.median("rmse"))


@query("a34_density", POOL + f" SELECT date, vintage, {_BIN.format(x='pred', a=-10.0, b=10.0, n=40)} AS bin, count(*) AS n FROM readings GROUP BY 1, 2, 3")
def a34(s, d):
    return accuracy.histogram(readings(s, d), "pred", ["date", "vintage"], -10.0, 10.0, 40)


SPLIT = "2000-01-01"
BREADTH = f""", v AS (SELECT DISTINCT date AS quarter, CAST(v AS INTEGER) AS vintage FROM target, unnest(range(-2, 7)) AS t(v)), x AS (SELECT o.*, months_lag, CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE) AS quarter FROM obs o JOIN meta USING (ticket)),
f AS (SELECT ticket, quarter, min(value) AS low FROM x WHERE quarter < DATE '{SPLIT}' GROUP BY 1, 2), cut AS (SELECT ticket, avg(low) - 0.75 * stddev_samp(low) AS cut FROM f GROUP BY 1),
k AS (SELECT ticket, quarter, vintage, min(value) AS low FROM x JOIN v USING (quarter) WHERE date + to_months(months_lag) <= quarter + to_months(vintage) GROUP BY 1, 2, 3),
breadth AS (SELECT quarter, vintage, count(*) AS n, count(*) FILTER (WHERE low < cut) AS broken FROM k LEFT JOIN cut USING (ticket) GROUP BY 1, 2),
regime AS (SELECT quarter, vintage, n, broken, bool_or(broken >= greatest(4, ceil(n * 5 / 100.0))) OVER (PARTITION BY quarter ORDER BY vintage ROWS UNBOUNDED PRECEDING) AS shock FROM breadth)"""


def broad(s: SparkSession, d: str) -> DataFrame:
    return accuracy.breadth(obs(s, d), meta(s, d), vintage.grid(target(s, d)), SPLIT, 0.75)


@query("e05_breadth", BREADTH + " SELECT quarter, vintage, n, broken FROM breadth")
def e05(s, d):
    return broad(s, d)


@query("e14_at_most_mean", ERRORS + " SELECT spec, vintage, rmse FROM (SELECT *, avg(rmse) OVER (PARTITION BY vintage) AS mid FROM m) WHERE rmse <= mid")
def e14(s, d):
    return accuracy.at_most(errors(s, d), F.avg("rmse"))


@query("m21_naive", ", t AS (SELECT date, growth, lag(growth) OVER (ORDER BY date) AS before FROM ygrowth), a AS (SELECT avg(growth) AS mean, regr_slope(growth, before) AS slope, regr_intercept(growth, before) AS intercept FROM t WHERE date < DATE '2000-01-01') SELECT date, round(mean, 6) AS mean, round(intercept + slope * before, 6) AS ar1 FROM t, a WHERE date >= DATE '2000-01-01'")
def m21(s, d):
    """Training mean and AR(1) as forecasts of the test quarters."""
    y = target(s, d).select("date", panel.growth(F.col("y"), F.lag("y").over(W.orderBy("date"))).alias("growth"))
    t = y.withColumn("before", F.lag("growth").over(W.orderBy("date")))
    split = F.to_date(F.lit(SPLIT))
    fit = t.filter(F.col("date") < split).agg(F.avg("growth").alias("mean"), F.regr_slope("growth", "before").alias("slope"), F.regr_intercept("growth", "before").alias("intercept"))
    return rounded(t.filter(F.col("date") >= split).crossJoin(F.broadcast(fit)).select("date", "mean", (F.col("intercept") + F.col("slope") * F.col("before")).alias("ar1")), "mean", "ar1")
