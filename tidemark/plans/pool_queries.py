"""Queries on the pool of readings and on sites. A reading is the target's line in one brand's month, as known at a vintage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import month
from tidemark.operators import cells, panel, pool
from tidemark.plans.queries import query, rounded
from tidemark.sources.files import written
from tidemark.testbed import daily, obs, read, target


def brand_lags(series: DataFrame) -> DataFrame:
    """(ticket, months_lag): a brand's publication lag is its number's rest by 5."""
    return series.select("ticket").distinct().select("ticket", (F.regexp_extract("ticket", "([0-9]+)$", 1).cast("int") % 5).alias("months_lag"))


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly growth of every brand's quantity, null where a month or the one before it has no sales."""
    sales = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q = sales.groupBy(F.col("p_brand").alias("ticket"), month("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("value"))
    return panel.monthly_growth(q).withColumnRenamed("growth", "value")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, vintage, spec, pred, actual): the target's line in each brand's month, fitted for every quarter on the quarters
    before it and read at every vintage."""
    y = target(spark, sf_dir).select("date", panel.growth(F.col("y"), F.lag("y").over(W.orderBy("date"))).alias("y"))
    last = y.agg(F.max("date")).first()[0]
    x = written(cells.carried(brands(spark, sf_dir), str(last)))
    r = cells.readings(cells.lines(x, y), x, brand_lags(x)).join(F.broadcast(y), "date")
    return r.select("date", "vintage", "spec", F.round("pred", 6).alias("pred"), F.round("y", 6).alias("actual"))


POOL = """, bq AS (SELECT p_brand AS spec, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE) AS date, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
bg AS (SELECT spec, date, 100 * (value / nullif(lag(value) OVER (PARTITION BY spec ORDER BY date), 0) - 1) AS growth FROM bq),
bm AS (SELECT p_brand AS spec, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
bx AS (SELECT a.spec, a.date, 100 * (a.value / nullif(b.value, 0) - 1) AS g FROM bm a JOIN bm b ON b.spec = a.spec AND b.date = a.date - INTERVAL 1 MONTH),
bd AS (SELECT CAST(unnest(generate_series(min(date), (SELECT max(date) FROM ygrowth), INTERVAL 1 MONTH)) AS DATE) AS date FROM bx WHERE g IS NOT NULL),
bf AS (SELECT s.spec, bd.date, coalesce(last_value(g IGNORE NULLS) OVER u, first_value(g IGNORE NULLS) OVER (PARTITION BY s.spec ORDER BY bd.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x, count(g) OVER u AS seen
  FROM (SELECT DISTINCT spec FROM bx WHERE g IS NOT NULL) s CROSS JOIN bd LEFT JOIN bx ON bx.spec = s.spec AND bx.date = bd.date WINDOW u AS (PARTITION BY s.spec ORDER BY bd.date ROWS UNBOUNDED PRECEDING)),
bw AS (SELECT spec, date, x, seen, y.growth AS y, pow(0.95, -datediff('day', DATE '1970-01-01', date) / 90.0 + 100) AS w FROM bf JOIN ygrowth y USING (date) WHERE y.growth IS NOT NULL),
bs AS (SELECT spec, date, lag(seen) OVER (PARTITION BY spec ORDER BY date) AS seen, count(*) OVER v AS n, sum(w) OVER v AS s, sum(w * x) OVER v AS sx, sum(w * y) OVER v AS sy, sum(w * x * x) OVER v AS sxx, sum(w * x * y) OVER v AS sxy
  FROM bw WINDOW v AS (PARTITION BY spec ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bl AS (SELECT spec, date, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b, s, sx, sy FROM bs WHERE n >= 8 AND seen >= 23 AND s * sxx - sx * sx > 0),
readings AS (SELECT bl.date, CAST(v AS INTEGER) AS vintage, bl.spec, round((sy - b * sx) / s + b * bf.x, 6) AS pred, round(y.growth, 6) AS actual FROM bl JOIN ygrowth y USING (date), unnest(range(-2, 7)) AS t(v)
  JOIN bf ON bf.spec = bl.spec AND bf.date = bl.date - to_months(CAST(greatest(0, CAST(regexp_extract(bl.spec, '[0-9]+$') AS INTEGER) % 5 - v) AS INTEGER)))"""
_SEEN = "p.date < r.date AND p.date + INTERVAL 2 MONTH <= r.date + to_months(r.vintage)"
WEIGHTS = POOL + f""", hist AS (SELECT r.date, r.vintage, r.spec, r.pred, count(p.actual) AS prints, avg(pow(p.pred - p.actual, 2)) AS mse FROM readings r LEFT JOIN readings p ON p.spec = r.spec AND p.vintage = r.vintage AND p.actual IS NOT NULL AND {_SEEN} GROUP BY 1, 2, 3, 4),
raw AS (SELECT *, CASE WHEN prints < 3 THEN 1.0 ELSE 1 / greatest(mse, 1e-12) END AS u FROM hist),
weighted AS (SELECT date, vintage, spec, pred, prints, u / sum(u) OVER (PARTITION BY date, vintage) AS w FROM raw)"""


@query("a12_spread", POOL + " SELECT date, vintage, count(pred) AS n, round(quantile_cont(pred, 0.25), 6) AS p25, round(quantile_cont(pred, 0.5), 6) AS p50, round(quantile_cont(pred, 0.75), 6) AS p75, max(actual) AS actual FROM readings GROUP BY 1, 2")
def a12(s, d):
    return rounded(pool.spread(readings(s, d)), "p25", "p50", "p75")


@query("a14_errors", POOL + " SELECT spec, vintage, round(sqrt(avg(pow(pred - actual, 2))), 5) AS rmse FROM readings GROUP BY 1, 2")
def a14(s, d):
    return rounded(pool.errors(readings(s, d)), "rmse", places=5)


@query("d15_guarded", POOL + " SELECT date, vintage, spec, CASE WHEN abs(pred) <= 5 THEN pred END AS pred, actual FROM readings")
def d15(s, d):
    return pool.guarded(readings(s, d), 5.0)


@query("w13_latched", POOL + ", f AS (SELECT date, vintage, count(*) FILTER (WHERE pred < 0) > 12 AS flag FROM readings GROUP BY 1, 2) SELECT date, vintage, flag, bool_or(flag) OVER (PARTITION BY date ORDER BY vintage ROWS UNBOUNDED PRECEDING) AS \"on\" FROM f")
def w13(s, d):
    return pool.latched(readings(s, d).groupBy("date", "vintage").agg((F.count_if(F.col("pred") < 0) > 12).alias("flag")))


@query("n01_site_neighbourhood", " SELECT a.sector, a.site, a.date, round(avg(b.value), 6) AS value FROM daily a JOIN daily b ON b.sector = a.sector AND b.date = a.date AND b.site BETWEEN a.site - 1 AND a.site + 1 GROUP BY 1, 2, 3")
def n01(s, d):
    """Mean over a site and its neighbours: each reading is sent to the sites beside it, then averaged by site."""
    x = daily(s, d)
    around = x.withColumn("near", F.explode(F.array(*[F.col("site") + k for k in (-1, 0, 1)]))).groupBy("sector", F.col("near").alias("site"), "date").agg(F.round(F.avg("value"), 6).alias("value"))
    return around.join(x.select("sector", "site", "date"), ["sector", "site", "date"], "left_semi")


@query("n09_last_date", " SELECT sector, site, max(date) AS last, count(*) AS days FROM daily GROUP BY 1, 2")
def n09(s, d):
    return daily(s, d).groupBy("sector", "site").agg(F.max("date").alias("last"), F.count("*").alias("days"))


@query("j12_pairs", " SELECT a.ticket AS a, b.ticket AS b, count(*) AS n, round(corr(a.growth, b.growth), 5) AS r FROM qgrowth a JOIN qgrowth b ON a.date = b.date AND a.ticket < b.ticket AND substr(a.ticket, 1, 7) = substr(b.ticket, 1, 7) WHERE a.growth IS NOT NULL AND b.growth IS NOT NULL GROUP BY 1, 2")
def j12(s, d):
    """Correlation of the pairs within a family: pairs across families are not formed."""
    from tidemark.testbed import meta

    g = panel.quarterly_growth(panel.to_quarter(obs(s, d), meta(s, d))).filter("growth is not null").withColumn("family", F.substring("ticket", 1, 7))
    a, b = g.alias("a"), g.alias("b")
    j = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.date") == F.col("b.date")) & (F.col("a.ticket") < F.col("b.ticket")))
    return rounded(j.groupBy(F.col("a.ticket").alias("a"), F.col("b.ticket").alias("b")).agg(F.count("*").alias("n"), F.corr("a.growth", "b.growth").alias("r")), "r", places=5)


@query("j12_all_pairs", " SELECT a.ticket AS a, b.ticket AS b, count(*) AS n, round(corr(a.growth, b.growth), 5) AS r FROM qgrowth a JOIN qgrowth b ON a.date = b.date AND a.ticket < b.ticket WHERE a.growth IS NOT NULL AND b.growth IS NOT NULL GROUP BY 1, 2")
def j12_all(s, d):
    """Correlation of all pairs of series."""
    from tidemark.testbed import meta

    g = panel.quarterly_growth(panel.to_quarter(obs(s, d), meta(s, d))).filter("growth is not null")
    return rounded(panel.pair_correlations(g.withColumnRenamed("growth", "value")), "r", places=5)


@query("a30_spec_trim", POOL + ", m AS (SELECT spec, vintage, sqrt(avg(pow(pred - actual, 2))) AS rmse FROM readings GROUP BY 1, 2), k AS (SELECT spec, median(rmse) AS med FROM m GROUP BY 1) SELECT spec, round(med, 5) AS med FROM k WHERE med <= (SELECT median(med) FROM k)")
def a30(s, d):
    """Specifications whose median error is not above the median of medians."""
    k = pool.errors(readings(s, d)).groupBy("spec").agg(F.median("rmse").alias("med"))
    return k.join(F.broadcast(k.agg(F.median("med").alias("mid"))), F.col("med") <= F.col("mid")).select("spec", F.round("med", 5).alias("med"))


@query("t01_best", POOL + ", m AS (SELECT spec, vintage, round(sqrt(avg(pow(pred - actual, 2))), 5) AS rmse FROM readings GROUP BY 1, 2) SELECT vintage, spec, rmse, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY vintage ORDER BY rmse, spec) AS INTEGER) AS rank FROM m) WHERE rank <= 3")
def t01(s, d):
    e = pool.errors(readings(s, d)).withColumn("rmse", F.round("rmse", 5))
    return e.withColumn("rank", F.row_number().over(W.partitionBy("vintage").orderBy("rmse", "spec"))).filter("rank <= 3").select("vintage", "spec", "rmse", "rank")
