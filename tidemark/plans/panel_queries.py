"""Queries on quality rules, further aggregates and windows, the pool, incremental jobs and sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import month
from tidemark.operators import panel, pool, seasonal, vintage
from tidemark.plans.pool_queries import POOL, WEIGHTS, readings
from tidemark.plans.queries import _A, _B, _GRID, BY, QS, SPLIT, TEST, _growths, query, rounded
from tidemark.testbed import daily, meta, obs, read, target

END = "2001-06-01"


# ---------------------------------------------------------------- aggregates


@query("a10_complete", " SELECT date, count(DISTINCT site) AS sites, count(DISTINCT site) >= 0.99 * max(count(DISTINCT site)) OVER () AS complete FROM daily GROUP BY 1")
def a10(s, d):
    """A day is complete when nearly as many sites are present as on the fullest day."""
    x = daily(s, d).groupBy("date").agg(F.count_distinct("site").alias("sites"))
    return x.join(F.broadcast(x.agg(F.max("sites").alias("most"))), F.lit(True)).select("date", "sites", (F.col("sites") >= 0.99 * F.col("most")).alias("complete"))


SHARES = (0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975)


@query(
    "a17_quantiles",
    WEIGHTS + """, c AS (SELECT *, sum(w) OVER (PARTITION BY date, vintage ORDER BY pred, spec ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY date, vintage) AS c FROM weighted),
l AS (SELECT *, lag(c) OVER (PARTITION BY date, vintage ORDER BY pred, spec) AS c0, lag(pred) OVER (PARTITION BY date, vintage ORDER BY pred, spec) AS v0 FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY date, vintage, q ORDER BY c, spec) AS r FROM l, unnest([0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975]) AS t(q) WHERE c >= q - 1e-12)
SELECT date, vintage, CAST(q AS DOUBLE) AS share, round(CASE WHEN c0 IS NULL THEN pred ELSE v0 + (pred - v0) * (q - c0) / (c - c0) END, 4) AS value FROM f WHERE r = 1""",
)
def a17(s, d):
    """Seven weighted quantiles of the pool at each reading."""
    w = pool.weights(readings(s, d), 2)
    by = W.partitionBy("date", "vintage").orderBy("pred", "spec")
    x = w.withColumn("c", F.sum("w").over(by.rowsBetween(W.unboundedPreceding, 0)) / F.sum("w").over(W.partitionBy("date", "vintage")))
    x = x.withColumn("c0", F.lag("c").over(by)).withColumn("v0", F.lag("pred").over(by)).withColumn("share", F.explode(F.array(*map(F.lit, SHARES))))
    at = F.when(F.col("c0").isNull(), F.col("pred")).otherwise(F.col("v0") + (F.col("pred") - F.col("v0")) * (F.col("share") - F.col("c0")) / (F.col("c") - F.col("c0")))
    return rounded(x.filter(F.col("c") >= F.col("share") - 1e-12).groupBy("date", "vintage", "share").agg(F.min_by(at, F.struct("c", "spec")).alias("value")), "value", places=4)


@query("a19_correlations", " SELECT ticket, count(*) AS n, round(corr(q.growth, y.growth), 6) AS r FROM qgrowth q JOIN ygrowth y USING (date) WHERE q.growth IS NOT NULL AND y.growth IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def a19(s, d):
    q, y = _growths(s, d)
    j = q.join(F.broadcast(y.withColumnRenamed("growth", "y")), "date").filter("growth is not null and y is not null")
    return j.groupBy("ticket").agg(F.count("*").alias("n"), F.round(F.corr("growth", "y"), 6).alias("r")).filter("n >= 3")


@query("a25_extreme_place", ", z AS (SELECT sector, site, date, round(abs(value - avg(value) OVER (PARTITION BY sector)) / stddev_samp(value) OVER (PARTITION BY sector), 6) AS z FROM daily) SELECT sector, site, date, z FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY z DESC, site, date) AS r FROM z WHERE z IS NOT NULL) WHERE r = 1")
def a25(s, d):
    """Where each sector's largest absolute z-score is."""
    x = daily(s, d)
    m = x.groupBy("sector").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    z = x.join(F.broadcast(m), "sector").withColumn("z", F.round(F.abs(F.col("value") - F.col("m")) / F.col("sd"), 6)).filter("z is not null")
    return z.groupBy("sector").agg(F.min(F.struct((-F.col("z")).alias("k"), "site", "date")).alias("x")).select("sector", "x.site", "x.date", (-F.col("x.k")).alias("z"))


@query("a27_group_totals", " SELECT date, regexp_extract(ticket, '([0-9])$', 1) AS family, sum(value) AS total FROM obs WHERE regexp_matches(ticket, '[0-4]$') GROUP BY 1, 2")
def a27(s, d):
    return obs(s, d).filter(F.col("ticket").rlike("[0-4]$")).groupBy("date", F.regexp_extract("ticket", "([0-9])$", 1).alias("family")).agg(F.sum("value").alias("total"))


@query("a31_first_source", ", x AS (SELECT sector, date, CASE sector WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS rank, value, site FROM daily) SELECT site, date, arg_min(value, (rank, sector)) AS value FROM x WHERE value IS NOT NULL GROUP BY 1, 2")
def a31(s, d):
    """First non-null value of a site and date in the order of its sources."""
    rank = F.when(F.col("sector") == "view", 1).when(F.col("sector") == "click", 2).otherwise(3)
    return daily(s, d).filter("value is not null").groupBy("site", "date").agg(F.min_by("value", F.struct(rank, F.col("sector"))).alias("value"))


@query(
    "a32_aligned_daily",
    """, x AS (SELECT sector, date, avg(value) AS value FROM daily GROUP BY 1, 2), c AS (SELECT CAST(m AS DATE) AS date FROM (SELECT min(date) AS a, max(date) AS b FROM daily), unnest(generate_series(a, b, INTERVAL 1 DAY)) AS t(m)),
g AS (SELECT c.date, v.value AS view, k.value AS click FROM c LEFT JOIN (SELECT * FROM x WHERE sector = 'view') v USING (date) LEFT JOIN (SELECT * FROM x WHERE sector = 'click') k USING (date))
SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS days, count(view) AS view_days, round(avg(view), 6) AS view, round(avg(click), 6) AS click FROM g GROUP BY 1""",
)
def a32(s, d):
    """Two daily sources on one calendar of days, then their means within months."""
    all_days = daily(s, d)
    x = all_days.groupBy("date").pivot("sector", ["view", "click"]).agg(F.avg("value"))
    c = all_days.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    out = c.join(x, "date", "left").groupBy(month("date").alias("month")).agg(F.count("*").alias("days"), F.count("view").alias("view_days"), F.avg("view").alias("view"), F.avg("click").alias("click"))
    return rounded(out, "view", "click")


@query("a33_stock_or_mean", " SELECT sector, site, CAST(date_trunc('month', date) AS DATE) AS month, round(CASE WHEN sector = 'view' THEN max_by(value, date) ELSE avg(value) END, 6) AS value FROM daily GROUP BY 1, 2, 3")
def a33(s, d):
    """Monthly means, but the last value of stocks."""
    x = panel.to_month(daily(s, d), ["sector", "site"])
    return x.select("sector", "site", "month", F.round(F.when(F.col("sector") == "view", F.col("last")).otherwise(F.col("mean")), 6).alias("value"))


@query("a35_null_aware_sum", ", p AS (SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) FILTER (l_returnflag = 'R') AS a, sum(l_quantity) FILTER (l_returnflag = 'A') AS b FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, date, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END AS total FROM p")
def a35(s, d):
    """A sum of columns that stays null where all of them are."""
    x = read(s, d, "lineitem").groupBy("l_suppkey", month("l_shipdate").alias("date")).pivot("l_returnflag", ["R", "A"]).agg(F.sum("l_quantity"))
    both = F.coalesce("R", F.lit(0.0)) + F.coalesce("A", F.lit(0.0))
    return x.select("l_suppkey", "date", F.when(F.col("R").isNotNull() | F.col("A").isNotNull(), both).alias("total"))


# ---------------------------------------------------------------- windows


@query("w14_last_distinct", " SELECT ticket, count(DISTINCT value) AS distinct_values FROM (SELECT ticket, value, row_number() OVER (PARTITION BY ticket ORDER BY date DESC) AS r FROM obs) WHERE r <= 36 GROUP BY 1")
def w14(s, d):
    last = obs(s, d).withColumn("r", F.row_number().over(W.partitionBy("ticket").orderBy(F.desc("date")))).filter("r <= 36")
    return last.groupBy("ticket").agg(F.count_distinct("value").alias("distinct_values"))


@query(
    "w11_chain_lags",
    WEIGHTS + """, n AS (SELECT date, vintage, round(sum(pred * w) / sum(w), 5) AS nowcast FROM weighted GROUP BY 1, 2), g AS (SELECT t.date, CAST(v AS INTEGER) AS vintage, CAST(t.date - INTERVAL 3 MONTH AS DATE) AS q FROM ygrowth t, unnest(range(-2, 7)) AS u(v)),
own AS (SELECT g.date, g.vintage, max_by(n.nowcast, n.vintage) AS own FROM g JOIN n ON n.date = g.q AND n.vintage <= g.vintage + 3 GROUP BY 1, 2),
seen AS (SELECT g.date, g.vintage, round(max_by(y.growth, y.date), 6) AS recent, max(y.date) AS recent_date FROM g JOIN ygrowth y ON y.date < g.date AND y.date + INTERVAL 2 MONTH <= g.date + to_months(g.vintage) WHERE y.growth IS NOT NULL GROUP BY 1, 2)
SELECT g.date, g.vintage, round(coalesce(CASE WHEN recent_date = g.q THEN recent END, own, recent), 5) AS y FROM g LEFT JOIN own USING (date, vintage) LEFT JOIN seen USING (date, vintage)""",
)
def w11(s, d):
    """The quarter before, at each reading: its print if published, else its own latest nowcast, else the latest print."""
    n = rounded(pool.combined(pool.weights(readings(s, d), 2)), "nowcast", places=5)
    y = _growths(s, d)[1]
    g = vintage.grid(y).withColumn("q", F.add_months("date", -3))
    own = g.join(n.select(F.col("date").alias("q"), F.col("vintage").alias("at"), "nowcast"), "q").filter(F.col("at") <= F.col("vintage") + 3)
    own = own.groupBy("date", "vintage").agg(F.max_by("nowcast", "at").alias("own"))
    p = y.filter("growth is not null").select(F.col("date").alias("p"), "growth")  # one row a quarter
    seen = g.join(F.broadcast(p), (F.col("p") < F.col("date")) & (F.add_months("p", 2) <= F.add_months("date", F.col("vintage"))))
    seen = seen.groupBy("date", "vintage").agg(F.round(F.max_by("growth", "p"), 6).alias("recent"), F.max("p").alias("recent_date"))
    x = g.join(own, ["date", "vintage"], "left").join(seen, ["date", "vintage"], "left")
    return x.select("date", "vintage", F.round(F.coalesce(F.when(F.col("recent_date") == F.col("q"), F.col("recent")), "own", "recent"), 5).alias("y"))


@query("w20_extended", " SELECT c.ticket, c.date, o.value FROM (SELECT ticket, CAST(m AS DATE) AS date FROM (SELECT ticket, min(date) AS a FROM obs GROUP BY 1), unnest(generate_series(a, DATE '2002-06-01', INTERVAL 1 MONTH)) AS t(m)) c LEFT JOIN obs o ON o.ticket = c.ticket AND o.date = c.date")
def w20(s, d):
    """Every series on a calendar that runs to a future month."""
    o = obs(s, d)
    c = o.groupBy("ticket").agg(F.min("date").alias("a")).select("ticket", F.explode(F.expr("sequence(a, date'2002-06-01', interval 1 month)")).alias("date"))
    return c.join(o, ["ticket", "date"], "left")


@query("w23_rolling", f" SELECT ticket, date, CASE WHEN count(value) OVER w7 >= 3 THEN round(avg(value) OVER w7, 6) END AS short, CASE WHEN count(value) OVER w12 >= 12 THEN round(avg(value) OVER w12, 6) END AS year FROM obs WINDOW w7 AS (PARTITION BY ticket ORDER BY date ROWS 6 PRECEDING), w12 AS (PARTITION BY ticket ORDER BY date ROWS 11 PRECEDING)")
def w23(s, d):
    """Rolling means of 7 and 12 rows where enough of them are there."""
    view = lambda n, least: F.when(F.count("value").over(W.partitionBy("ticket").orderBy("date").rowsBetween(1 - n, 0)) >= least, F.round(F.avg("value").over(W.partitionBy("ticket").orderBy("date").rowsBetween(1 - n, 0)), 6))
    return obs(s, d).select("ticket", "date", view(7, 3).alias("short"), view(12, 12).alias("year"))


# ---------------------------------------------------------------- quality rules


@query(
    "d04_adjusted",
    """, x AS (SELECT ticket, date, value, row_number() OVER (PARTITION BY ticket ORDER BY date) AS i, count(*) OVER (PARTITION BY ticket) AS n FROM obs WHERE value IS NOT NULL),
t AS (SELECT *, (sum(value) OVER (PARTITION BY ticket ORDER BY date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - (lag(value, 6) OVER (PARTITION BY ticket ORDER BY date) + lead(value, 6) OVER (PARTITION BY ticket ORDER BY date)) / 2) / 12 AS t FROM x WHERE n >= 24),
e AS (SELECT ticket, regr_slope(t, i) FILTER (i <= 18) AS b0, regr_intercept(t, i) FILTER (i <= 18) AS a0, regr_slope(t, i) FILTER (i > n - 18) AS b1, regr_intercept(t, i) FILTER (i > n - 18) AS a1 FROM t GROUP BY 1),
r AS (SELECT t.ticket, date, value, (i - 1) % 12 AS k, coalesce(t, CASE WHEN i <= 6 THEN a0 + b0 * i ELSE a1 + b1 * i END) AS trend FROM t JOIN e USING (ticket)),
m AS (SELECT ticket, k, avg(value - trend) AS m FROM r GROUP BY 1, 2), c AS (SELECT ticket, k, m - avg(m) OVER (PARTITION BY ticket) AS seasonal FROM m)
SELECT ticket, date, value, round(trend, 5) AS trend, round(seasonal, 5) AS seasonal, round(value - seasonal, 5) AS adjusted FROM r JOIN c USING (ticket, k)""",
)
def d04(s, d):
    return rounded(seasonal.adjusted(obs(s, d)), "trend", "seasonal", "adjusted", places=5)


_QPANEL = f", qc AS (SELECT t.ticket, q.date, qobs.value FROM (SELECT DISTINCT ticket FROM qobs) t CROSS JOIN (SELECT date FROM target WHERE date <= DATE '{TEST}') q LEFT JOIN qobs ON qobs.ticket = t.ticket AND qobs.date = q.date), qk AS (SELECT ticket FROM qc GROUP BY 1 HAVING avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) <= 0.75)"


@query("d09_quarterly_panel", _QPANEL + f" SELECT ticket, date, round(coalesce(last_value(value IGNORE NULLS) {_B}, first_value(value IGNORE NULLS) {_A}), 6) AS value FROM qc WHERE ticket IN (SELECT ticket FROM qk)")
def d09(s, d):
    """The panel by quarters of the target up to a last one: series that are mostly missing go, gaps are filled."""
    q = panel.to_quarter(obs(s, d), meta(s, d))
    dates = target(s, d).filter(f"date <= date'{TEST}'").select("date")  # some dozens of quarters
    full = q.select("ticket").distinct().crossJoin(F.broadcast(dates)).join(q, ["ticket", "date"], "left")
    full = full.withColumn("gone", F.avg(F.col("value").isNull().cast("int")).over(panel.whole())).filter("gone <= 0.75")
    by = W.partitionBy("ticket").orderBy("date")
    value = F.coalesce(F.last("value", True).over(by.rowsBetween(W.unboundedPreceding, 0)), F.first("value", True).over(by.rowsBetween(0, W.unboundedFollowing)))
    return full.select("ticket", "date", F.round(value, 6).alias("value"))


@query("d10_redundant", " SELECT ticket, date, value FROM obs WHERE ticket NOT IN (SELECT ticket FROM meta WHERE (months_lag = 8 AND nominal = 1) OR (months_lag = 0 AND agg_method = 'sum') OR ticket LIKE '%99')")
def d10(s, d):
    """Series named in a table of rules go: mechanical copies, net balances, and those left out by decision."""
    m = meta(s, d)
    rule = F.when((F.col("months_lag") == 8) & (F.col("nominal") == 1), "mechanical").when((F.col("months_lag") == 0) & (F.col("agg_method") == "sum"), "balance").when(F.col("ticket").endswith("99"), "decision")
    rules = m.select("ticket", rule.alias("rule")).filter("rule is not null")
    return obs(s, d).join(rules, "ticket", "left_anti")


@query("d11_identities", ", a AS (SELECT substr(ticket, 1, 7) AS family, date, sum(value) AS total FROM obs GROUP BY 1, 2), p AS (SELECT ticket, avg(value / nullif(total, 0)) AS share FROM obs JOIN a ON family = substr(ticket, 1, 7) AND a.date = obs.date GROUP BY 1) SELECT ticket, round(share, 6) AS share, share < 0.1 AS dropped FROM p")
def d11(s, d):
    """Mean share of each component in its family's aggregate; small components are dropped."""
    o = obs(s, d).withColumn("family", F.substring("ticket", 1, 7))
    total = o.groupBy("family", "date").agg(F.sum("value").alias("total"))
    p = o.join(total, ["family", "date"]).groupBy("ticket").agg(F.avg(F.col("value") / F.nullif(F.col("total"), F.lit(0))).alias("share"))
    return p.select("ticket", F.round("share", 6).alias("share"), (F.col("share") < 0.1).alias("dropped"))


@query("d16_selected_quality", f", t AS (SELECT *, round(abs((value - avg(CASE WHEN date < DATE '{SPLIT}' THEN value END) OVER (PARTITION BY ticket)) / nullif(stddev_samp(CASE WHEN date < DATE '{SPLIT}' THEN value END) OVER (PARTITION BY ticket), 0)), 8) AS z FROM obs) SELECT ticket, z, date, z > 4 AS excluded FROM (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY z DESC, date DESC) AS r FROM t WHERE z IS NOT NULL) WHERE r = 1 AND ticket IN (SELECT ticket FROM meta WHERE months_lag <= 3)")
def d16(s, d):
    """Largest z-score of the chosen series, where it is, and whether it excludes them."""
    chosen = obs(s, d).join(meta(s, d).filter("months_lag <= 3"), "ticket", "left_semi")
    return panel.extremes(chosen, SPLIT).withColumn("excluded", F.col("z") > 4)


@query("d20_next_tickets", ", f AS (SELECT p_brand, max(p_partkey) AS top FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), n AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 3 = 0) SELECT p_partkey, p_brand || '-' || lpad(CAST(coalesce(top, 0) + r AS VARCHAR), 6, '0') AS ticket FROM n LEFT JOIN f USING (p_brand)")
def d20(s, d):
    """New series get the next free numbers of their family."""
    p = read(s, d, "part")
    known = p.filter("p_partkey % 3 <> 0").groupBy("p_brand").agg(F.max("p_partkey").alias("top"))
    new = p.filter("p_partkey % 3 = 0").withColumn("r", F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")))
    number = (F.coalesce("top", F.lit(0)) + F.col("r")).cast("string")
    return new.join(known, "p_brand", "left").select("p_partkey", F.concat("p_brand", F.lit("-"), F.lpad(number, 6, "0")).alias("ticket"))


# ---------------------------------------------------------------- pool


@query("e01_long_pool", POOL + " SELECT date, spec, vintage, pred FROM readings WHERE pred IS NOT NULL")
def e01(s, d):
    """Readings with a column for each vintage become rows again; missing ones drop."""
    wide = readings(s, d).groupBy("date", "spec").pivot("vintage", list(vintage.VINTAGES)).agg(F.first("pred"))
    long = wide.unpivot(["date", "spec"], [str(v) for v in vintage.VINTAGES], "vintage", "pred")
    return long.filter("pred is not null").select("date", "spec", F.col("vintage").cast("int").alias("vintage"), "pred")


@query("e07_known_prints", _GRID + " SELECT g.date, g.vintage, count(t.date) AS prints, count(t.date) < 3 AS burn_in FROM g LEFT JOIN target t ON t.date < g.date AND t.date + INTERVAL 2 MONTH <= g.date + to_months(g.vintage) GROUP BY 1, 2")
def e07(s, d):
    g = vintage.grid(target(s, d))
    p = F.broadcast(target(s, d).select(F.col("date").alias("p")))  # one row a quarter
    j = g.join(p, (F.col("p") < F.col("date")) & (F.add_months("p", 2) <= F.add_months("date", F.col("vintage"))), "left")
    return j.groupBy("date", "vintage").agg(F.count("p").alias("prints")).withColumn("burn_in", F.col("prints") < 3)


@query("e15_summary", POOL + f", i AS (SELECT date, round(avg(pred), 6) AS fit FROM readings WHERE vintage = 0 AND date < DATE '{END}' GROUP BY 1), l AS (SELECT date, round(avg(pred), 6) AS live FROM readings WHERE vintage = -2 AND date >= DATE '{END}' GROUP BY 1), a AS (SELECT date, round(growth, 6) AS actual FROM ygrowth WHERE growth IS NOT NULL) SELECT date, actual, fit, live, coalesce(fit, live) AS nowcast FROM a FULL JOIN i USING (date) FULL JOIN l USING (date)")
def e15(s, d):
    """Prints, readings in the sample and live ones, side by side."""
    r = readings(s, d)
    mean = lambda v, when, name: r.filter(f"vintage = {v} and date {when} date'{END}'").groupBy("date").agg(F.round(F.avg("pred"), 6).alias(name))
    a = _growths(s, d)[1].filter("growth is not null").select("date", F.round("growth", 6).alias("actual"))
    return a.join(mean(0, "<", "fit"), "date", "full").join(mean(-2, ">=", "live"), "date", "full").withColumn("nowcast", F.coalesce("fit", "live"))


@query(
    "m25_midas",
    """, c AS (SELECT ticket, date, value AS m0, lag(value) OVER w AS m1, lag(value, 2) OVER w AS m2, lag(value, 3) OVER w AS m3, lag(value, 4) OVER w AS m4, lag(value, 5) OVER w AS m5 FROM obs WINDOW w AS (PARTITION BY ticket ORDER BY date)),
x AS (SELECT ticket, y.growth AS y, th, (m0 + m1 * exp(th) + m2 * exp(2 * th) + m3 * exp(3 * th) + m4 * exp(4 * th) + m5 * exp(5 * th)) / (1 + exp(th) + exp(2 * th) + exp(3 * th) + exp(4 * th) + exp(5 * th)) AS x FROM c JOIN ygrowth y USING (date), unnest([0.0, -0.25, -0.5, -1.0, -2.0]) AS t(th) WHERE m5 IS NOT NULL AND y.growth IS NOT NULL),
f AS (SELECT ticket, th, count(*) AS n, round(regr_r2(y, x), 6) AS r2, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM x GROUP BY 1, 2 HAVING count(*) >= 8)
SELECT ticket, CAST(th AS DOUBLE) AS theta, n, r2, slope, intercept FROM (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY r2 DESC, th DESC) AS r FROM f) WHERE r = 1""",
)
def m25(s, d):
    """Mixed-frequency regression with exponential lag weights: of a grid of thetas the one with the best fit, by series."""
    by = W.partitionBy("ticket").orderBy("date")
    c = obs(s, d).select("ticket", "date", *[F.lag("value", k).over(by).alias(f"m{k}") for k in range(6)]).filter("m5 is not null")
    y = _growths(s, d)[1].filter("growth is not null").select("date", F.col("growth").alias("y"))
    x = c.join(F.broadcast(y), "date").withColumn("theta", F.explode(F.array(*map(F.lit, (0.0, -0.25, -0.5, -1.0, -2.0)))))
    w = [F.exp(k * F.col("theta")) for k in range(6)]
    x = x.withColumn("x", sum(F.col(f"m{k}") * w[k] for k in range(6)) / sum(w))
    f = x.groupBy("ticket", "theta").agg(F.count("*").alias("n"), *[F.round(g("y", "x"), 6).alias(n) for g, n in ((F.regr_r2, "r2"), (F.regr_slope, "slope"), (F.regr_intercept, "intercept"))]).filter("n >= 8")
    return f.withColumn("r", F.row_number().over(W.partitionBy("ticket").orderBy(F.desc("r2"), F.desc("theta")))).filter("r = 1").drop("r")


# ---------------------------------------------------------------- incremental jobs and sites


@query("n04_site_upsert", ", k AS (SELECT user_id, CAST(ts AS DATE) AS date, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id % 2 DESC, event_id DESC) AS r FROM events) SELECT user_id, date, value FROM k WHERE r = 1")
def n04(s, d):
    """Stored readings and a batch with the same sites and dates in part: what arrives replaces what is stored, the rest stays."""
    e = read(s, d, "events").select("user_id", F.to_date("ts").alias("date"), "value", "event_id")
    last = lambda part: e.filter(f"event_id % 2 = {part}").groupBy("user_id", "date").agg(F.max_by("value", "event_id").alias("value"))
    stored, arrived = last(0), last(1)
    return stored.join(arrived, ["user_id", "date"], "left_anti").unionByName(arrived)


@query("n08_before_after", " SELECT sector, site, a.value AS before, b.value AS after, round(b.value - a.value, 6) AS change FROM (SELECT sector, site, round(avg(value), 6) AS value FROM daily WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1, 2) a JOIN (SELECT sector, site, round(avg(value), 6) AS value FROM daily WHERE date BETWEEN DATE '2024-01-16' AND DATE '2024-01-22' GROUP BY 1, 2) b USING (sector, site)")
def n08(s, d):
    """Means of the week before and the week after an event, by site."""
    x = daily(s, d)
    part = lambda a, b, name: x.filter(f"date between date'{a}' and date'{b}'").groupBy("sector", "site").agg(F.round(F.avg("value"), 6).alias(name))
    j = part("2024-01-08", "2024-01-14", "before").join(part("2024-01-16", "2024-01-22", "after"), ["sector", "site"])
    return j.withColumn("change", F.round(F.col("after") - F.col("before"), 6))


@query("n10_missing_nights", " SELECT tile, CAST(m AS DATE) AS date FROM (SELECT DISTINCT site % 40 AS tile FROM daily), (SELECT min(date) AS a, max(date) AS b FROM daily), unnest(generate_series(a, b, INTERVAL 1 DAY)) AS t(m) EXCEPT SELECT site % 40, date FROM daily")
def n10(s, d):
    """Nights of each tile that are available but not stored."""
    x = daily(s, d).withColumn("tile", F.col("site") % 40)
    nights = x.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    return x.select("tile").distinct().crossJoin(F.broadcast(nights)).join(x.select("tile", "date"), ["tile", "date"], "left_anti")


@query("g01_current_terms", " SELECT ticket, max(date) AS logged, max(date) >= DATE '2001-10-01' AS current FROM obs GROUP BY 1")
def g01(s, d):
    """A term is current when its log reaches the last complete month."""
    return obs(s, d).groupBy("ticket").agg(F.max("date").alias("logged")).withColumn("current", F.col("logged") >= F.to_date(F.lit("2001-10-01")))


@query("g02_replaced", ", n AS (SELECT ticket, date, value * 1.5 AS value FROM obs JOIN meta USING (ticket) WHERE months_lag = 3 AND date >= DATE '1997-01-01') SELECT * FROM n UNION ALL SELECT ticket, date, value FROM obs WHERE ticket NOT IN (SELECT ticket FROM n)")
def g02(s, d):
    """A download replaces the whole of its series, since every download is scaled anew."""
    o = obs(s, d)
    new = o.join(meta(s, d).filter("months_lag = 3"), "ticket", "left_semi").filter("date >= date'1997-01-01'").withColumn("value", F.col("value") * 1.5)
    return new.unionByName(o.join(new.select("ticket").distinct(), "ticket", "left_anti"))


@query("g04_fetch_log", ", l AS (SELECT ticket, CAST(max(date) AS DATE) AS last, 'first' AS source FROM obs WHERE date < DATE '2000-01-01' GROUP BY 1), n AS (SELECT ticket, max(date) AS last, 'second' AS source FROM obs WHERE date >= DATE '2000-01-01' AND ticket LIKE '%1' GROUP BY 1) SELECT ticket, coalesce(n.last, l.last) AS last, coalesce(n.source, l.source) AS source FROM l FULL JOIN n USING (ticket)")
def g04(s, d):
    """The log of what was fetched: a newer entry of a column takes the place of the older one."""
    o = obs(s, d)
    entry = lambda x, name: x.groupBy("ticket").agg(F.max("date").alias("last")).withColumn("source", F.lit(name))
    both = entry(o.filter("date < date'2000-01-01'"), "first").unionByName(entry(o.filter("date >= date'2000-01-01' and ticket like '%1'"), "second"))
    return both.groupBy("ticket").agg(F.max(F.struct("last", "source")).alias("x")).select("ticket", "x.last", "x.source")


@query("g05_composite_terms", " SELECT date, round(avg(value), 6) AS everything, round(avg(value) FILTER (sector IN ('view', 'click')), 6) AS chosen FROM daily GROUP BY 1")
def g05(s, d):
    return rounded(daily(s, d).groupBy("date").agg(F.avg("value").alias("everything"), F.avg(F.when(F.col("sector").isin("view", "click"), F.col("value"))).alias("chosen")), "everything", "chosen")


@query("g06_stale_first", " SELECT ticket, last, months FROM (SELECT ticket, max(date) AS last, CAST(date_diff('month', max(date), DATE '2001-12-01') AS INTEGER) AS months FROM obs WHERE value > 0 GROUP BY 1)")
def g06(s, d):
    """Last month with data of each series, the stalest first."""
    x = obs(s, d).filter("value > 0").groupBy("ticket").agg(F.max("date").alias("last"))
    return x.withColumn("months", ((F.lit(2001) - F.year("last")) * 12 + 12 - F.month("last")).cast("int")).orderBy(F.desc("months"), "ticket")


@query("r05_pending_cells", ", c AS (SELECT p_brand AS spec, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS variables FROM part GROUP BY 1), k AS (SELECT p_brand AS spec, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS variables FROM part WHERE p_size < 45 GROUP BY 1) SELECT spec, variables FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.spec = c.spec AND k.variables = c.variables) OR spec LIKE '%1'")
def r05(s, d):
    """Cells, by name and sorted variables, that are not done yet."""
    cell = lambda p: p.groupBy(F.col("p_brand").alias("spec")).agg(F.concat_ws(",", F.array_sort(F.collect_set("p_type"))).alias("variables"))
    p = read(s, d, "part")
    done = cell(p.filter("p_size < 45")).filter("spec not like '%1'")
    return cell(p).join(done, ["spec", "variables"], "left_anti")


@query("r03_month_of_days", " SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def r03(s, d):
    """The month's aggregate of readings, by calendar month of their time."""
    return rounded(read(s, d, "events").groupBy(month("ts").alias("month"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")
