"""Registered panel queries, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import month, quarter_stamp
from tidemark.operators import panel, vintage
from tidemark.testbed import CTE, daily, meta, obs, read, target

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SPLIT, TEST = "2000-01-01", "2000-12-01"
CAL = ", span AS (SELECT ticket, min(date) AS a, max(date) AS b FROM obs GROUP BY 1), cal AS (SELECT s.ticket, CAST(m AS DATE) AS date FROM span s, unnest(generate_series(s.a, s.b, INTERVAL 1 MONTH)) AS g(m)), full_obs AS (SELECT c.ticket, c.date, o.value FROM cal c LEFT JOIN obs o ON o.ticket = c.ticket AND o.date = c.date)"
BY, QS = "OVER (PARTITION BY ticket ORDER BY date)", "CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)"


def query(name: str, sql: str | None):
    """Register a query; without SQL, where SQL cannot express it, tests hold it against brute force."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = CTE + sql
        return f

    return put


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _growths(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    y = target(s, d)
    return panel.quarterly_growth(panel.to_quarter(obs(s, d), meta(s, d))), y.select("date", panel.growth(F.col("y"), F.lag("y").over(W.orderBy("date"))).alias("growth"))


_SCREEN = f""", r AS (SELECT ticket, corr(q.growth, y.growth) AS r, count(*) AS n FROM qgrowth q JOIN ygrowth y USING (date) WHERE date < DATE '{TEST}' AND q.growth IS NOT NULL AND y.growth IS NOT NULL GROUP BY 1),
ranked AS (SELECT ticket, round(abs(r), 8) AS score, CAST(row_number() OVER (ORDER BY round(abs(r), 8) DESC, ticket) AS INTEGER) AS rank FROM r WHERE n >= 8 AND r IS NOT NULL AND NOT isnan(r))"""


@query("flagship", _SCREEN + " SELECT ticket, score, rank, months_lag, v.vintage, greatest(months_lag - v.vintage, 0) AS blanked FROM ranked JOIN meta USING (ticket), (SELECT CAST(unnest(range(-2, 7)) AS INTEGER) AS vintage) v WHERE rank <= 5")
def flagship(s, d):
    """Best five screened series, and how many of their months are unknown at each vintage."""
    top = vintage.screened(*_growths(s, d), TEST).filter("rank <= 5").join(meta(s, d), "ticket")
    return top.withColumn("vintage", F.explode(F.array(*map(F.lit, vintage.VINTAGES)))).select("ticket", "score", "rank", "months_lag", "vintage", F.greatest(F.col("months_lag") - F.col("vintage"), F.lit(0)).alias("blanked"))


@query("m01_screen", _SCREEN + " SELECT ticket, score, rank FROM ranked")
def m01(s, d):
    return vintage.screened(*_growths(s, d), TEST)


@query("a01_to_month", " SELECT sector, site, CAST(date_trunc('month', date) AS DATE) AS month, round(max_by(value, date), 6) AS last, round(avg(value), 6) AS mean, round(sum(value), 6) AS total FROM daily GROUP BY 1, 2, 3")
def a01(s, d):
    return rounded(panel.to_month(daily(s, d), ["sector", "site"]), "last", "mean", "total")


@query("a02_to_quarter", " SELECT ticket, date, round(value, 6) AS value FROM qobs")
def a02(s, d):
    return rounded(panel.to_quarter(obs(s, d), meta(s, d)), "value")


@query("a04_frequency", f", g AS (SELECT ticket, date_diff('day', lag(date) {BY}, date) AS gap FROM obs), m AS (SELECT ticket, median(gap) AS gap FROM g GROUP BY 1) SELECT ticket, gap, CASE WHEN gap <= 2 THEN 'daily' WHEN gap BETWEEN 25 AND 35 THEN 'monthly' WHEN gap BETWEEN 80 AND 100 THEN 'quarterly' WHEN gap BETWEEN 320 AND 430 THEN 'yearly' ELSE 'unknown' END AS freq FROM m")
def a04(s, d):
    return panel.infer_frequency(obs(s, d))


@query("a05_profile", " SELECT ticket, min(date) AS start_date, max(date) AS end_date, count(value) AS obs FROM obs GROUP BY 1")
def a05(s, d):
    return panel.profile(obs(s, d))


@query("a06_inferred_lag", " SELECT ticket, CAST(greatest(date_diff('month', max(date), DATE '2001-12-01'), 0) AS INTEGER) AS months_lag FROM obs GROUP BY 1")
def a06(s, d):
    return panel.inferred_lag(obs(s, d), "2001-12-01")


@query("a07_by_sector", " SELECT sector, date, round(avg(value), 6) AS mean, round(sum(value), 6) AS total FROM daily GROUP BY 1, 2")
def a07(s, d):
    return rounded(daily(s, d).groupBy("sector", "date").agg(F.avg("value").alias("mean"), F.sum("value").alias("total")), "mean", "total")


@query("a08_capped", ", c AS (SELECT quantile_cont(value, 0.9) AS cut FROM daily), l AS (SELECT avg(value) AS low FROM daily, c WHERE value <= cut) SELECT sector, site, date, round(CASE WHEN value > cut THEN low ELSE value END, 6) AS value FROM daily, c, l")
def a08(s, d):
    return rounded(panel.capped(daily(s, d)), "value")


@query("a09_tiles", ", p AS (SELECT site % 4 AS tile, date, sum(value) AS s, count(*) AS n FROM daily GROUP BY 1, 2) SELECT date, round(sum(s), 6) AS total, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS mean, count(*) AS tiles, count(*) = 4 AS complete FROM p GROUP BY 1")
def a09(s, d):
    """Tile sums and counts added up; a date is complete when all four tiles are there (A09, A10)."""
    p = daily(s, d).groupBy((F.col("site") % 4).alias("tile"), "date").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    x = p.groupBy("date").agg(F.sum("s").alias("total"), F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("tiles"))
    return rounded(x.withColumn("complete", F.col("tiles") == 4), "total", "mean")


@query("a11_quarter_range", f" SELECT ticket, {QS} AS date, min(value) AS low, max(value) AS high, max(value) - min(value) AS range FROM obs GROUP BY 1, 2")
def a11(s, d):
    return panel.quarter_range(obs(s, d))


@query("a13_describe", " SELECT ticket, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM obs GROUP BY 1")
def a13(s, d):
    v = F.col("value")
    x = obs(s, d).groupBy("ticket").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), *[F.percentile(v, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))], F.max(v).alias("high"))
    return rounded(x, "mean", "sd", "q1", "median", "q3")


@query("a24_families", " SELECT substr(ticket, 1, 7) AS family, count(DISTINCT ticket) AS n FROM obs GROUP BY 1")
def a24(s, d):
    return obs(s, d).groupBy(F.substring("ticket", 1, 7).alias("family")).agg(F.count_distinct("ticket").alias("n"))


@query("a28_missing_months", CAL + " SELECT ticket, count(*) AS months, count(*) - count(value) AS missing FROM full_obs GROUP BY 1")
def a28(s, d):
    return panel.on_calendar(obs(s, d)).groupBy("ticket").agg(F.count("*").alias("months"), F.count_if(F.col("value").isNull()).alias("missing"))


@query("w01_quarterly_growth", " SELECT ticket, date, round(growth, 6) AS growth FROM qgrowth")
def w01(s, d):
    return rounded(panel.quarterly_growth(panel.to_quarter(obs(s, d), meta(s, d))), "growth")


def _growth_sql(back: int) -> str:
    return f" SELECT a.ticket, a.date, round(100 * (a.value / nullif(b.value, 0) - 1), 6) AS growth FROM obs a LEFT JOIN obs b ON a.ticket = b.ticket AND CAST(b.date + INTERVAL {back} MONTH AS DATE) = a.date"


@query("w02_monthly_growth", _growth_sql(1))
def w02(s, d):
    return rounded(panel.monthly_growth(obs(s, d)), "growth")


@query("w03_yearly_growth", _growth_sql(12))
def w03(s, d):
    return rounded(panel.monthly_growth(obs(s, d), 12), "growth")


_B, _A = "OVER (PARTITION BY ticket ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "OVER (PARTITION BY ticket ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("w04_filled", CAL + f" SELECT ticket, date, coalesce(last_value(value IGNORE NULLS) {_B}, first_value(value IGNORE NULLS) {_A}) AS value FROM full_obs")
def w04(s, d):
    return panel.filled(obs(s, d))


@query("w05_mean_filled", CAL + f" SELECT ticket, date, round(coalesce(value, avg(CASE WHEN date < DATE '{SPLIT}' THEN value END) OVER (PARTITION BY ticket)), 6) AS value FROM full_obs")
def w05(s, d):
    return rounded(panel.mean_filled(obs(s, d), SPLIT), "value")


@query("w06_rolling_last", ", x AS (SELECT sector, date, avg(value) AS value FROM daily GROUP BY 1, 2), r AS (SELECT sector, date, avg(value) OVER (PARTITION BY sector ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS value FROM x) SELECT sector, CAST(date_trunc('month', date) AS DATE) AS month, round(max_by(value, date), 6) AS value FROM r GROUP BY 1, 2")
def w06(s, d):
    return rounded(panel.rolling_last(daily(s, d), 7), "value")


@query("w07_flattened", CAL + f" SELECT * FROM (SELECT ticket, date, value AS m0, lag(value) {BY} AS m1, lag(value, 2) {BY} AS m2 FROM full_obs) WHERE month(date) % 3 = 0")
def w07(s, d):
    return panel.flattened(obs(s, d))


@query("w08_aligned", " SELECT ticket, CAST(date + to_months(CAST(greatest(months_lag - 1, 0) AS INTEGER)) AS DATE) AS date, value FROM obs JOIN meta USING (ticket)")
def w08(s, d):
    return vintage.aligned(obs(s, d), meta(s, d), 1)


@query("w09_blanked", f" SELECT ticket, date, CASE WHEN date_diff('month', date, DATE '{TEST}') >= greatest(months_lag + 1, 0) THEN value END AS value FROM obs JOIN meta USING (ticket) WHERE date <= DATE '{TEST}'")
def w09(s, d):
    return vintage.blanked(obs(s, d), meta(s, d), TEST, -1)


_GRID = ", g AS (SELECT DISTINCT date, CAST(v AS INTEGER) AS vintage FROM target, unnest(range(-2, 7)) AS t(v))"


@query("w10_target_lags", _GRID + " SELECT date, vintage, l, y FROM (SELECT g.date, g.vintage, CAST(row_number() OVER (PARTITION BY g.date, g.vintage ORDER BY t.date DESC) AS INTEGER) AS l, t.y FROM g JOIN target t ON t.date < g.date AND t.date + INTERVAL 2 MONTH <= g.date + to_months(g.vintage)) WHERE l <= 2")
def w10(s, d):
    return vintage.target_lags(target(s, d), 2)


@query("w16_no_change", " SELECT date, y, lag(y) OVER (ORDER BY date) AS forecast FROM target")
def w16(s, d):
    return target(s, d).select("date", "y", F.lag("y").over(W.orderBy("date")).alias("forecast"))


@query("w17_decay", f" SELECT ticket, date, round(pow(0.95, date_diff('day', date, max(date) OVER (PARTITION BY ticket)) / 90.0), 9) AS weight FROM obs")
def w17(s, d):
    return obs(s, d).select("ticket", "date", F.round(F.pow(F.lit(0.95), F.datediff(F.max("date").over(panel.whole()), F.col("date")) / 90.0), 9).alias("weight"))


@query("w21_interpolated", CAL + f", w AS (SELECT ticket, date, value, last_value(value IGNORE NULLS) {_B} AS v0, first_value(value IGNORE NULLS) {_A} AS v1, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) {_B} AS d0, first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) {_A} AS d1 FROM full_obs) SELECT ticket, date, round(coalesce(value, v0 + (v1 - v0) * date_diff('month', d0, date) / date_diff('month', d0, d1)), 6) AS value FROM w")
def w21(s, d):
    return rounded(panel.interpolated(obs(s, d)), "value")


@query("w24_folds", ", q AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM target)), f AS (SELECT unnest(range(16, (SELECT count(*) FROM q) - 4, 2)) AS fold) SELECT fold, date, CASE WHEN i < fold THEN 'train' ELSE 'test' END AS part FROM q JOIN f ON i < fold + 4")
def w24(s, d):
    return vintage.folds(target(s, d))


@query("w26_months_observed", _GRID + f" SELECT o.ticket, g.date AS quarter, g.vintage, count(o.value) AS months FROM obs o JOIN meta m USING (ticket) JOIN g ON g.date = CAST(date_trunc('quarter', o.date) + INTERVAL 2 MONTH AS DATE) AND o.date + to_months(months_lag) <= g.date + to_months(g.vintage) GROUP BY 1, 2, 3")
def w26(s, d):
    return vintage.months_observed(obs(s, d), meta(s, d), target(s, d))


@query("d01_deflated", ", p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1), b AS (SELECT avg(price) AS base FROM p WHERE year(date) = 1998) SELECT ticket, date, round(CASE nominal WHEN 1 THEN value / price * base ELSE value END, 6) AS value FROM obs JOIN meta USING (ticket) LEFT JOIN p USING (date), b")
def d01(s, d):
    price = read(s, d, "lineitem").groupBy(month("l_shipdate").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return rounded(panel.deflated(obs(s, d), meta(s, d), price, 1998), "value")


@query("d02_usable", ", r AS (SELECT ticket, value, row_number() OVER (PARTITION BY ticket ORDER BY date DESC) AS r FROM obs WHERE value IS NOT NULL) SELECT ticket, count(*) AS n, count(*) < 24 AS short, count(DISTINCT CASE WHEN r <= 36 THEN value END) <= 1 OR count(DISTINCT value) < 10 AS degenerate FROM r GROUP BY 1")
def d02(s, d):
    return panel.usable(obs(s, d))


@query("d07_publication_rule", " SELECT ticket, date, value FROM obs WHERE ticket IN (SELECT ticket FROM meta WHERE coalesce(months_lag, 1) <= 6)")
def d07(s, d):
    return obs(s, d).join(meta(s, d).filter(F.coalesce("months_lag", F.lit(1)) <= 6), "ticket", "left_semi")


@query("d08_extremes", f", t AS (SELECT *, round(abs((value - avg(CASE WHEN date < DATE '{SPLIT}' THEN value END) OVER (PARTITION BY ticket)) / nullif(stddev_samp(CASE WHEN date < DATE '{SPLIT}' THEN value END) OVER (PARTITION BY ticket), 0)), 8) AS z FROM obs) SELECT ticket, z, date FROM (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY z DESC, date DESC) AS r FROM t WHERE z IS NOT NULL) WHERE r = 1")
def d08(s, d):
    return panel.extremes(obs(s, d), SPLIT)


@query("d17_shock_companions", f", q AS (SELECT ticket, {QS} AS quarter, min(value) AS low, max(value) - min(value) AS range FROM obs GROUP BY 1, 2) SELECT o.ticket || 'N' AS ticket, o.date, low AS value FROM obs o JOIN q ON q.ticket = o.ticket AND quarter = CAST(date_trunc('quarter', o.date) + INTERVAL 2 MONTH AS DATE) UNION ALL SELECT o.ticket || 'R', o.date, range FROM obs o JOIN q ON q.ticket = o.ticket AND quarter = CAST(date_trunc('quarter', o.date) + INTERVAL 2 MONTH AS DATE)")
def d17(s, d):
    """Quarterly minimum and range as series of their own, in every observed month."""
    o = obs(s, d)
    q = panel.quarter_range(o).withColumnRenamed("date", "quarter")
    x = o.withColumn("quarter", quarter_stamp("date")).join(q, ["ticket", "quarter"])
    both = F.explode(F.array(F.struct(F.lit("N").alias("k"), F.col("low").alias("v")), F.struct(F.lit("R").alias("k"), F.col("range").alias("v"))))
    return x.withColumn("x", both).select(F.concat("ticket", F.col("x.k")).alias("ticket"), "date", F.col("x.v").alias("value"))


@query("d18_shock_quarters", f", q AS (SELECT ticket, {QS} AS date, min(value) AS low FROM obs GROUP BY 1, 2), t AS (SELECT *, low < avg(CASE WHEN date < DATE '{SPLIT}' THEN low END) OVER (PARTITION BY ticket) - 1.5 * stddev_samp(CASE WHEN date < DATE '{SPLIT}' THEN low END) OVER (PARTITION BY ticket) AS broken FROM q), c AS (SELECT date, count(*) AS n, coalesce(CAST(sum(CAST(broken AS INTEGER)) AS BIGINT), 0) AS broken FROM t GROUP BY 1) SELECT date, n, broken, broken >= greatest(4, ceil(n * 5 / 100)) AS shock FROM c")
def d18(s, d):
    return panel.shock_quarters(obs(s, d), SPLIT, 1.5)


@query("j05_combined", " SELECT date, round(coalesce(a.y, b.v), 6) AS value FROM target a FULL JOIN (SELECT date, sum(value) AS v FROM obs GROUP BY 1) b USING (date)")
def j05(s, d):
    """A second source fills what the first lacks."""
    b = obs(s, d).groupBy("date").agg(F.sum("value").alias("v"))
    return target(s, d).join(b, "date", "full").select("date", F.round(F.coalesce("y", "v"), 6).alias("value"))


@query("j06_pending", " SELECT site, date FROM daily v WHERE sector = 'view' AND NOT EXISTS (SELECT 1 FROM daily e WHERE e.sector = 'error' AND e.site = v.site AND e.date = v.date)")
def j06(s, d):
    x = daily(s, d)
    return x.filter("sector = 'view'").select("site", "date").join(x.filter("sector = 'error'"), ["site", "date"], "left_anti")


@query("p07_pivot", " SELECT date, round(avg(CASE WHEN sector = 'click' THEN value END), 6) AS click, round(avg(CASE WHEN sector = 'view' THEN value END), 6) AS view FROM daily GROUP BY 1")
def p07(s, d):
    return rounded(daily(s, d).groupBy("date").pivot("sector", ["click", "view"]).agg(F.avg("value")), "click", "view")


@query("p20_annualised", " SELECT date, round((pow(1 + growth / 100, 4) - 1) * 100, 6) AS growth FROM ygrowth")
def p20(s, d):
    return _growths(s, d)[1].select("date", F.round((F.pow(1 + F.col("growth") / 100, F.lit(4)) - 1) * 100, 6).alias("growth"))


@query("r01_latest_reading", ", r AS (SELECT user_id, CAST(ts AS DATE) AS date, value, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) AS r FROM events) SELECT user_id, date, event_id, value FROM r WHERE r = 1")
def r01(s, d):
    """Of several readings of a site and day the latest arrival counts."""
    x = read(s, d, "events").groupBy("user_id", F.to_date("ts").alias("date"))
    return x.agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


def _register() -> None:
    """The other modules of queries register their own when they are imported."""
    from tidemark.plans import accuracy_queries, cell_queries, choice_queries, ensemble_queries, panel_queries, pool_queries, preparation_queries, selection_queries, shaping_queries, sheet_queries, site_queries, source_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _register()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(SQL)
