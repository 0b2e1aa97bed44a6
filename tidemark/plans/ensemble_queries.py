"""Queries from the pool of readings to the published number: clusters, regimes, weights, nowcasts, bands, live quarters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cells, ensemble, panel
from tidemark.plans.accuracy_queries import BREADTH, broad
from tidemark.plans.pool_queries import POOL, brand_lags, brands, readings
from tidemark.plans.queries import query, rounded
from tidemark.plans.selection_queries import _SHOCK, e04
from tidemark.sources.files import written
from tidemark.testbed import target

MARGIN, RELEASE = 0.4, 2
ADDED, REMOVED = ("2000-03-01",), ("1999-12-01",)
#: Last printed quarter, and the month up to which data are in, of the live query.
PRINTED, CUT, DESIRED = "2001-03-01", "2001-07-01", "2001-09-01"


def clusters(r: DataFrame) -> DataFrame:
    """Brands by their first digit, watched at all vintages; those that end in 1 or 2 at vintage 1, in 3 never to alert."""
    every = r.select("spec").distinct()
    digit, end = F.substring("spec", 7, 1), F.substring("spec", -1, 1).cast("int")
    x = every.select("spec", F.concat(F.lit("first"), digit).alias("cluster"), F.lit(None).cast("int").alias("at"), F.lit(True).alias("alerts"))
    x = x.unionByName(every.filter(end.isin(1, 2)).select("spec", F.lit("early").alias("cluster"), F.lit(1).alias("at"), F.lit(True).alias("alerts")))
    return x.unionByName(every.filter(end == 3).select("spec", F.lit("silent").alias("cluster"), F.lit(None).cast("int").alias("at"), F.lit(False).alias("alerts")))


def regime_log(s: SparkSession, d: str, r: DataFrame) -> DataFrame:
    b = broad(s, d).withColumnRenamed("quarter", "date")
    return ensemble.regimes(b, ensemble.watched(r, clusters(r), MARGIN), ADDED, REMOVED)


def weighted(s: SparkSession, d: str, r: DataFrame) -> DataFrame:
    return ensemble.weights(r, regime_log(s, d, r), RELEASE, e04(s, d).select("spec", "residual"))


def live_pool(s: SparkSession, d: str) -> DataFrame:
    """The pool up to the last print, and unprinted quarters read with the last fitted lines at the cut."""
    y = target(s, d).select("date", panel.growth(F.col("y"), F.lag("y").over(ensemble.W.orderBy("date"))).alias("y")).filter(F.col("date") <= F.to_date(F.lit(PRINTED)))
    x = written(cells.carried(brands(s, d).filter(F.col("date") <= F.to_date(F.lit(CUT))), DESIRED))
    table = written(cells.lines(x, y))
    last = table.filter(F.col("date") == F.to_date(F.lit(PRINTED)))
    at = cells.live_grid(y, CUT, RELEASE, DESIRED).filter(F.col("date") > F.to_date(F.lit(PRINTED)))
    r = cells.readings(table, x, brand_lags(x)).unionByName(cells.readings(last, x, brand_lags(x), at=at))
    return r.join(F.broadcast(y), "date", "left").select("date", "vintage", "spec", F.round("pred", 6).alias("pred"), F.round("y", 6).alias("actual"))


_DIGIT, _END = "substr(spec, 7, 1)", "right(spec, 1)"


def _ensemble(r: str = "readings") -> str:
    """CTEs on the pool named r: watch, log, record, hist, w."""
    return f""", kin AS (SELECT DISTINCT spec FROM {r}),
clusters AS (SELECT spec, 'first' || {_DIGIT} AS cluster, CAST(NULL AS INTEGER) AS at_, true AS alerts FROM kin UNION ALL SELECT spec, 'early', 1, true FROM kin WHERE {_END} IN ('1', '2') UNION ALL SELECT spec, 'silent', NULL, false FROM kin WHERE {_END} = '3'),
pooled AS (SELECT date, vintage, median(pred) AS pooled_median FROM {r} GROUP BY 1, 2),
clustered AS (SELECT date, vintage, cluster, alerts, count(*) AS n, quantile_cont(pred, 0.25) AS p25, median(pred) AS median, quantile_cont(pred, 0.75) AS p75 FROM {r} JOIN clusters USING (spec) WHERE at_ IS NULL OR at_ = vintage GROUP BY 1, 2, 3, 4),
apart AS (SELECT *, round(median - pooled_median, 6) AS divergence FROM clustered JOIN pooled USING (date, vintage)),
watch AS (SELECT *, CASE WHEN NOT alerts THEN 0 WHEN divergence <= -{MARGIN} THEN -1 WHEN divergence >= {MARGIN} THEN 1 ELSE 0 END AS flag FROM apart),
alarm AS (SELECT DISTINCT date, vintage FROM watch WHERE flag = -1),
held AS (SELECT b.quarter AS date, b.vintage, b.n, b.broken AS breadth, CAST(greatest(4, ceil(b.n * 5 / 100.0)) AS BIGINT) AS threshold, a.date IS NOT NULL AS watch_alert FROM breadth b LEFT JOIN alarm a ON a.date = b.quarter AND a.vintage = b.vintage),
hit AS (SELECT *, breadth >= threshold AS wide, watch_alert AND breadth >= greatest(3, threshold // 3) AS near FROM held),
log AS (SELECT date, vintage, n, breadth, threshold, watch_alert, CASE WHEN wide AND near THEN 'both' WHEN wide THEN 'breadth' WHEN near THEN 'watchlist' ELSE '' END AS trigger,
  CASE CAST(date AS VARCHAR) WHEN '{ADDED[0]}' THEN true WHEN '{REMOVED[0]}' THEN false ELSE bool_or(wide OR near) OVER (PARTITION BY date ORDER BY vintage ROWS UNBOUNDED PRECEDING) END AS is_shock,
  CASE CAST(date AS VARCHAR) WHEN '{ADDED[0]}' THEN 'added' WHEN '{REMOVED[0]}' THEN 'removed' ELSE '' END AS override FROM hit),
refit AS (SELECT spec, round(residual, 5) AS residual FROM loo WHERE spec NOT LIKE '%3'),
record AS (SELECT spec, residual FROM refit UNION ALL SELECT spec, round((SELECT median(abs(predicted - actual)) FROM loo WHERE spec NOT LIKE '%3'), 5) FROM (SELECT DISTINCT spec FROM readings) WHERE spec NOT IN (SELECT spec FROM refit)),
hist AS (SELECT r.date, r.vintage, r.spec, r.pred, r.actual, g.is_shock, count(p.actual) FILTER (q.is_shock) + max(CASE WHEN record.residual IS NULL THEN 0 ELSE 1 END) AS sn, coalesce(sum(pow(p.pred - p.actual, 2)) FILTER (q.is_shock), 0) + max(coalesce(pow(record.residual, 2), 0)) AS se,
  count(p.actual) FILTER (NOT q.is_shock) AS qn, coalesce(sum(pow(p.pred - p.actual, 2)) FILTER (NOT q.is_shock), 0) AS qe
  FROM {r} r JOIN log g ON g.date = r.date AND g.vintage = r.vintage LEFT JOIN record ON record.spec = r.spec LEFT JOIN {r} p ON p.spec = r.spec AND p.vintage = r.vintage AND p.actual IS NOT NULL AND p.date < r.date AND p.date + INTERVAL {RELEASE} MONTH <= r.date + to_months(r.vintage)
  LEFT JOIN log q ON q.date = p.date AND q.vintage = p.vintage GROUP BY 1, 2, 3, 4, 5, 6),
printed AS (SELECT a.date, a.vintage, count(b.date) AS prints FROM (SELECT DISTINCT date, vintage FROM {r}) a LEFT JOIN (SELECT DISTINCT date FROM {r} WHERE actual IS NOT NULL) b ON b.date < a.date AND b.date + INTERVAL {RELEASE} MONTH <= a.date + to_months(a.vintage) GROUP BY 1, 2),
schemed AS (SELECT *, CASE WHEN is_shock AND max(sn) OVER (PARTITION BY date, vintage) > 0 THEN 'shock' WHEN prints >= 3 AND max(qn) OVER (PARTITION BY date, vintage) > 0 THEN 'ordinary' ELSE 'equal' END AS scheme FROM hist JOIN printed USING (date, vintage)),
raw AS (SELECT *, CASE scheme WHEN 'shock' THEN CASE WHEN se > 0 THEN sn / se ELSE 0 END WHEN 'ordinary' THEN CASE WHEN qe > 0 THEN qn / qe ELSE 0 END ELSE 1 END AS u FROM schemed),
w AS (SELECT date, vintage, spec, pred, actual, is_shock, prints, scheme, CASE WHEN sum(u) OVER g > 0 THEN u / sum(u) OVER g ELSE 1.0 / count(*) OVER g END AS w FROM raw WINDOW g AS (PARTITION BY date, vintage))"""


_ALL = POOL + BREADTH + _SHOCK + _ensemble()


@query("e02_clusters", POOL + BREADTH + _SHOCK + _ensemble() + " SELECT date, vintage, cluster, n, round(p25, 9) AS p25, round(median, 9) AS median, round(p75, 9) AS p75, round(pooled_median, 9) AS pooled_median, divergence, flag, CASE WHEN flag = -1 THEN 1 ELSE 0 END AS alert FROM watch")
def e02(s, d):
    """Median of each watched cluster against the pool's, with the side of a wide divergence and the alert."""
    r = readings(s, d)
    return rounded(ensemble.watched(r, clusters(r), MARGIN), "p25", "median", "p75", "pooled_median", places=9)


@query("e06_regime", _ALL + " SELECT date, vintage, n, breadth, threshold, watch_alert, trigger, is_shock, override FROM log")
def e06(s, d):
    return regime_log(s, d, readings(s, d))


@query("e08_weighted_pool", _ALL + " SELECT date, vintage, spec, is_shock, prints, scheme, round(w, 7) AS w FROM w")
def e08(s, d):
    return rounded(weighted(s, d, readings(s, d)), "w", places=7).select("date", "vintage", "spec", "is_shock", "prints", "scheme", "w")


@query("e09_nowcast", _ALL + " SELECT date, vintage, bool_or(is_shock) AS is_shock, max(scheme) AS scheme, max(actual) AS actual, round(sum(w * pred) / sum(w), 5) AS nowcast, round(sum(w * pred) / sum(w) - max(actual), 5) AS error FROM w GROUP BY 1, 2")
def e09(s, d):
    return rounded(ensemble.nowcast(weighted(s, d, readings(s, d))), "nowcast", "error", places=5)


def _bands(pool: str = "w") -> str:
    """CTE bands: each level from the first cumulative weight at or above it."""
    at = ", ".join(f"min(CASE WHEN c >= {q} - 1e-12 THEN i END) AS i_{n}" for n, q in ensemble.LEVELS.items())
    take = ", ".join(f"max(CASE WHEN i = i_{n} THEN CASE WHEN c0 IS NULL THEN pred ELSE v0 + (pred - v0) * ({q} - c0) / (c - c0) END END) AS {n}" for n, q in ensemble.LEVELS.items())
    g = "PARTITION BY date, vintage"
    return f""", up AS (SELECT *, sum(w) OVER ({g} ORDER BY pred, spec ROWS UNBOUNDED PRECEDING) / sum(w) OVER ({g}) AS c, row_number() OVER ({g} ORDER BY pred, spec) AS i FROM {pool} WHERE w > 0),
steps AS (SELECT *, lag(c) OVER ({g} ORDER BY i) AS c0, lag(pred) OVER ({g} ORDER BY i) AS v0 FROM up), firsts AS (SELECT date, vintage, {at} FROM steps GROUP BY 1, 2),
bands AS (SELECT date, vintage, bool_or(is_shock) AS is_shock, {take} FROM steps JOIN firsts USING (date, vintage) GROUP BY 1, 2)"""


_LEVELS = ", ".join(f"round({n}, 4) AS {n}" for n in ensemble.LEVELS)
_NAMED = "round(p10, 4) AS lo_80, round(p90, 4) AS hi_80, round(p025, 4) AS lo_95, round(p975, 4) AS hi_95"


@query("e10_band", _ALL + _bands() + f" SELECT date, vintage, is_shock, {_LEVELS}, {_NAMED} FROM bands")
def e10(s, d):
    b = ensemble.bands(weighted(s, d, readings(s, d)))
    return rounded(b, *[c for c in b.columns if c not in ("date", "vintage", "is_shock")], places=4)


_LIVE = POOL + f""", lx AS (SELECT a.spec, a.date, 100 * (a.value / nullif(b.value, 0) - 1) AS g FROM bm a JOIN bm b ON b.spec = a.spec AND b.date = a.date - INTERVAL 1 MONTH WHERE a.date <= DATE '{CUT}'),
lf AS (SELECT s.spec, m.date, last_value(g IGNORE NULLS) OVER (PARTITION BY s.spec ORDER BY m.date ROWS UNBOUNDED PRECEDING) AS x FROM (SELECT DISTINCT spec FROM lx) s CROSS JOIN (SELECT CAST(unnest(generate_series((SELECT min(date) FROM lx), DATE '{DESIRED}', INTERVAL 1 MONTH)) AS DATE) AS date) m LEFT JOIN lx ON lx.spec = s.spec AND lx.date = m.date),
lq AS (SELECT CAST(q AS DATE) AS date, CAST(least(datediff('month', CAST(q AS DATE), DATE '{CUT}'), 6) AS INTEGER) AS vintage FROM unnest(generate_series(DATE '{PRINTED}' + INTERVAL 3 MONTH, DATE '{DESIRED}', INTERVAL 3 MONTH)) AS t(q)),
live AS (SELECT date, vintage, spec, pred, actual FROM readings WHERE date <= DATE '{PRINTED}' UNION ALL SELECT lq.date, lq.vintage, bl.spec, round((sy - b * sx) / s + b * lf.x, 6), NULL FROM bl CROSS JOIN lq
  JOIN lf ON lf.spec = bl.spec AND lf.date = lq.date - to_months(CAST(greatest(0, CAST(regexp_extract(bl.spec, '[0-9]+$') AS INTEGER) % 5 - lq.vintage) AS INTEGER)) WHERE bl.date = DATE '{PRINTED}')"""


@query(
    "e11_live_quarter",
    _LIVE + BREADTH + _SHOCK + _ensemble("live") + _bands() + f""" SELECT date, year(date) || '-Q' || quarter(date) AS quarter, vintage, log.is_shock, breadth, threshold, trigger, watch_alert, max(scheme) AS scheme, max(prints) AS prints, count(*) AS n_cells, round(sum(w * pred) / sum(w), 5) AS nowcast, round(any_value(pooled_median), 5) AS pooled_median,
  any_value(round(p10, 4)) AS lo_80, any_value(round(p90, 4)) AS hi_80, any_value(round(p025, 4)) AS lo_95, any_value(round(p975, 4)) AS hi_95
FROM w JOIN log USING (date, vintage) JOIN pooled USING (date, vintage) JOIN bands USING (date, vintage) WHERE date > DATE '{PRINTED}' GROUP BY 1, 3, 4, 5, 6, 7, 8""",
)
def e11(s, d):
    """Unprinted quarters at the cut: vintage, regime, weights of the nearest vintage's record, nowcast and bands."""
    r = written(live_pool(s, d))
    log = written(regime_log(s, d, r))
    w = written(ensemble.weights(r, log, RELEASE, e04(s, d).select("spec", "residual")).filter(F.col("date") > F.to_date(F.lit(PRINTED))))
    each = w.groupBy("date", "vintage").agg(F.max("scheme").alias("scheme"), F.max("prints").alias("prints"), F.count("*").alias("n_cells"), (F.sum(F.col("w") * F.col("pred")) / F.sum("w")).alias("nowcast"), F.median("pred").alias("pooled_median"))
    b = ensemble.bands(w).select("date", "vintage", "lo_80", "hi_80", "lo_95", "hi_95")
    x = each.join(log.drop("n", "override"), ["date", "vintage"]).join(b, ["date", "vintage"])
    x = x.withColumn("quarter", F.concat(F.year("date"), F.lit("-Q"), F.quarter("date")))
    return rounded(rounded(x, "nowcast", "pooled_median", places=5), "lo_80", "hi_80", "lo_95", "hi_95", places=4)


@query("e16_first_shock", _ALL + " SELECT date, min(vintage) AS vintage FROM log WHERE is_shock GROUP BY 1")
def e16(s, d):
    """First vintage at which a quarter was in shock."""
    return regime_log(s, d, readings(s, d)).filter("is_shock").groupBy("date").agg(F.min("vintage").alias("vintage"))


FIXED = "2000-12-01"


@query(
    "e12_fixed_date",
    _ALL + f""", one AS (SELECT r.vintage, r.spec, r.pred, r.actual, g.is_shock FROM readings r JOIN log g USING (date, vintage) WHERE r.date = DATE '{FIXED}' AND r.actual IS NOT NULL),
past AS (SELECT o.vintage, o.spec, o.pred, o.actual, o.is_shock, count(p.pred) AS n, sum(pow(p.pred - p.actual, 2)) AS e FROM one o LEFT JOIN (SELECT r.*, g.is_shock FROM readings r JOIN log g USING (date, vintage)) p ON p.spec = o.spec AND p.vintage = o.vintage AND p.is_shock = o.is_shock AND p.date <> DATE '{FIXED}' GROUP BY 1, 2, 3, 4, 5),
mine AS (SELECT *, CASE WHEN n > 0 AND e > 1e-12 THEN n / e ELSE 0 END AS u FROM past), part AS (SELECT *, CASE WHEN sum(u) OVER (PARTITION BY vintage) > 0 THEN u / sum(u) OVER (PARTITION BY vintage) ELSE 1.0 / count(*) OVER (PARTITION BY vintage) END AS w FROM mine)
SELECT vintage, bool_or(is_shock) AS is_shock, count(*) AS n, max(actual) AS actual, round(sum(w * pred), 5) AS nowcast, round(max(w), 6) AS top_weight FROM part GROUP BY 1""",
)
def e12(s, d):
    """One fixed quarter by weights from all other quarters of its regime, its own error taken out of them."""
    r = readings(s, d)
    w = ensemble.without_target(r, regime_log(s, d, r), FIXED)
    return w.groupBy("vintage").agg(F.max("is_shock").alias("is_shock"), F.count("*").alias("n"), F.max("actual").alias("actual"), F.round(F.sum(F.col("w") * F.col("pred")), 5).alias("nowcast"), F.round(F.max("w"), 6).alias("top_weight"))
