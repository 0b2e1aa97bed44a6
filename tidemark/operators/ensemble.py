"""From the pool of readings to a published number: watched clusters, regimes, weights by regime, nowcast, bands.

readings: (date, vintage, <cell columns>, pred, actual); actual is null for quarters without a print. A quarter's print is
out `release` months after its stamp, and is never known to a reading of the quarter itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

READING = ["date", "vintage"]
LEVELS = {"p025": 0.025, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p975": 0.975}


def watched(readings: DataFrame, clusters: DataFrame, margin: float, side: str = "below", cell: tuple[str, ...] = ("spec",)) -> DataFrame:
    """(date, vintage, cluster, n, p25, median, p75, pooled_median, divergence, flag, alert).

    clusters: (cluster, at, alerts, <cell columns>), a cell may be in several; `at` is the one vintage a cluster is watched at,
    null for all; clusters that may not alert keep flag 0. The flag is the side on which a cluster's median lies at least
    `margin` from the pool's; an alert is a flag below it, or on either side.
    """
    seen = readings.filter("pred is not null")
    pool = seen.groupBy(*READING).agg(F.median("pred").alias("pooled_median"))
    x = seen.join(clusters, list(cell)).filter(F.col("at").isNull() | (F.col("at") == F.col("vintage")))
    q = [F.percentile("pred", p).alias(n) for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))]
    x = x.groupBy(*READING, "cluster", "alerts").agg(F.count("*").alias("n"), *q).join(pool, READING)
    apart = F.round(F.col("median") - F.col("pooled_median"), 6)
    x = x.withColumn("divergence", apart).withColumn("flag", F.when(~F.col("alerts"), 0).when(apart <= -margin, -1).when(apart >= margin, 1).otherwise(0))
    hit = F.col("flag") == -1 if side == "below" else F.col("flag") != 0
    return x.select(*READING, "cluster", "n", "p25", "median", "p75", "pooled_median", "divergence", "flag", hit.cast("int").alias("alert"))


def regimes(breadth: DataFrame, alerts: DataFrame, add: tuple[str, ...] = (), remove: tuple[str, ...] = (), least: int = 4, percent: int = 5) -> DataFrame:
    """(date, vintage, n, breadth, threshold, watch_alert, trigger, is_shock, override).

    breadth: (date, vintage, n, broken). A reading triggers if at least max(least, percent of n) series are broken, or if a
    cluster alerts and at least max(3, a third of that) are. A quarter stays in shock at the vintages behind one that
    triggered; quarters in `add` and `remove` are as stated there.
    """
    threshold = F.greatest(F.lit(least), F.ceil(F.col("n") * percent / 100)).cast("long")
    x = breadth.join(alerts.filter("alert = 1").select(*READING, F.lit(True).alias("watch_alert")).distinct(), READING, "left")
    x = x.select(*READING, "n", F.col("broken").alias("breadth"), threshold.alias("threshold"), F.coalesce("watch_alert", F.lit(False)).alias("watch_alert"))
    wide = F.col("breadth") >= F.col("threshold")
    watch = F.col("watch_alert") & (F.col("breadth") >= F.greatest(F.lit(3), F.floor(F.col("threshold") / 3)))
    on = F.max((wide | watch).cast("int")).over(W.partitionBy("date").orderBy("vintage").rowsBetween(W.unboundedPreceding, 0)) == 1
    day = F.col("date").cast("string")
    forced = F.when(day.isin(*remove), "removed").when(day.isin(*add), "added").otherwise("") if add or remove else F.lit("")
    x = x.withColumn("trigger", F.when(wide & watch, "both").when(wide, "breadth").when(watch, "watchlist").otherwise("")).withColumn("is_shock", on).withColumn("override", forced)
    return x.withColumn("is_shock", F.when(F.col("override") == "added", True).when(F.col("override") == "removed", False).otherwise(F.col("is_shock")))


def known_before(readings: DataFrame, by: list[str], release: int, sums: dict[str, Column]) -> DataFrame:
    """readings with sums over the rows of the same `by` (vintage among them) whose quarter was printed by then.

    Prints and readings are put in one order of months, prints first, and a running window adds the prints up; so the work
    grows with the rows, not with pairs of quarters.
    """
    names, kept = list(sums), readings.columns
    x = readings.withColumns({f"_{n}": c for n, c in sums.items()})
    wait = F.greatest(F.lit(release) - F.col("vintage"), F.lit(3))
    prints = x.filter(F.col("actual").isNotNull()).select(*[F.col(c) if c in by else F.lit(None).cast(x.schema[c].dataType).alias(c) for c in kept], *[f"_{n}" for n in names], F.add_months("date", wait).alias("_at"), F.lit(0).alias("_ask"))
    asks = x.select(*kept, *[F.lit(None).cast(x.schema[f"_{n}"].dataType).alias(f"_{n}") for n in names], F.col("date").alias("_at"), F.lit(1).alias("_ask"))
    past = W.partitionBy(*by).orderBy("_at", "_ask").rowsBetween(W.unboundedPreceding, 0)
    y = prints.unionByName(asks).withColumns({n: F.coalesce(F.sum(f"_{n}").over(past), F.lit(0)) for n in names})
    return y.filter("_ask = 1").select(*kept, *names)


def prints_known(readings: DataFrame, release: int, burn_in: int = 3) -> DataFrame:
    """(date, vintage, prints, burn_in): how many quarters of the pool were printed by each reading."""
    x = readings.groupBy(*READING).agg(F.max("actual").alias("actual"))
    x = known_before(x, ["vintage"], release, {"prints": F.lit(1).cast("long")})
    return x.select(*READING, "prints", (F.col("prints") < burn_in).alias("burn_in"))


def weights(readings: DataFrame, regime: DataFrame, release: int, record: DataFrame | None = None, burn_in: int = 3, cell: tuple[str, ...] = ("spec",)) -> DataFrame:
    """(date, vintage, <cell columns>, pred, actual, is_shock, prints, scheme, w), weights of each reading adding up to 1.

    Weights are inverse mean squared errors of a cell over quarters printed by then that were in the same regime at that
    vintage. In shock, record (<cell columns>, residual) counts as further prints of every cell it names; without any such
    history, ordinary weights are used. With fewer than burn_in prints, or without any, weights are equal. Cells without a
    history, or without error in it, have weight 0; if all have, the mean is taken.
    """
    r = readings.filter("pred is not null").join(regime.select(*READING, "is_shock"), READING)
    e, on = (F.col("pred") - F.col("actual")) ** 2, F.col("is_shock")
    one = F.lit(1).cast("long")
    x = known_before(r, [*cell, "vintage"], release, {"_sn": F.when(on, one), "_se": F.when(on, e), "_on": F.when(~on, one), "_oe": F.when(~on, e)})
    if record is not None:
        told = record.groupBy(*cell).agg(F.count("residual").alias("_rn"), F.sum(F.col("residual") ** 2).alias("_re"))
        x = x.join(told, list(cell), "left").withColumns({"_sn": F.col("_sn") + F.coalesce("_rn", F.lit(0)), "_se": F.col("_se") + F.coalesce("_re", F.lit(0.0))})
    x = x.join(prints_known(readings, release, burn_in), READING)
    pool = W.partitionBy(*READING)
    scheme = F.when(on & (F.max("_sn").over(pool) > 0), "shock").when(~F.col("burn_in") & (F.max("_on").over(pool) > 0), "ordinary").otherwise("equal")
    x = x.withColumn("scheme", scheme)
    inverse = lambda n, s: F.when(F.col(s) > 0, F.col(n) / F.col(s)).otherwise(0.0)
    x = x.withColumn("_u", F.when(F.col("scheme") == "shock", inverse("_sn", "_se")).when(F.col("scheme") == "ordinary", inverse("_on", "_oe")).otherwise(1.0))
    w = F.when(F.sum("_u").over(pool) > 0, F.col("_u") / F.sum("_u").over(pool)).otherwise(1 / F.count("*").over(pool))
    return x.select(*READING, *cell, "pred", "actual", "is_shock", "prints", "scheme", w.alias("w"))


def nowcast(weighted: DataFrame) -> DataFrame:
    """(date, vintage, is_shock, scheme, actual, nowcast, error)."""
    x = weighted.groupBy(*READING).agg(F.max("is_shock").alias("is_shock"), F.max("scheme").alias("scheme"), F.max("actual").alias("actual"), (F.sum(F.col("w") * F.col("pred")) / F.sum("w")).alias("nowcast"))
    return x.withColumn("error", F.col("nowcast") - F.col("actual"))


def bands(weighted: DataFrame, levels: dict[str, float] = LEVELS, cell: tuple[str, ...] = ("spec",)) -> DataFrame:
    """Weighted quantiles of each reading, interpolated on cumulative weights, all from one sorted window; below the first
    cumulative weight the smallest value. lo_80, hi_80, lo_95 and hi_95 name the outer four again."""
    by = W.partitionBy(*READING).orderBy("pred", *cell)
    x = weighted.filter("w > 0")
    x = x.withColumn("_c", F.sum("w").over(by.rowsBetween(W.unboundedPreceding, 0)) / F.sum("w").over(W.partitionBy(*READING)))
    x = x.withColumns({"_c0": F.lag("_c").over(by), "_v0": F.lag("pred").over(by), "_i": F.row_number().over(by)})
    at = lambda q: F.when(F.col("_c0").isNull(), F.col("pred")).otherwise(F.col("_v0") + (F.col("pred") - F.col("_v0")) * (q - F.col("_c0")) / (F.col("_c") - F.col("_c0")))
    out = x.groupBy(*READING).agg(F.max("is_shock").alias("is_shock"), *[F.min_by(F.when(F.col("_c") >= q - 1e-12, at(q)), F.when(F.col("_c") >= q - 1e-12, F.col("_i"))).alias(n) for n, q in levels.items()])
    names = {"lo_80": "p10", "hi_80": "p90", "lo_95": "p025", "hi_95": "p975"}
    return out.withColumns({a: F.col(b) for a, b in names.items() if b in levels})


def without_target(readings: DataFrame, regime: DataFrame, target: str, cell: tuple[str, ...] = ("spec",)) -> DataFrame:
    """(vintage, <cell columns>, pred, actual, w): weights for one fixed quarter from all other quarters of its regime.

    Each cell's error is its total over the regime less the quarter's own part, so the target never calibrates itself.
    """
    r = readings.filter("pred is not null and actual is not null").join(regime.select(*READING, "is_shock"), READING)
    aim = F.col("date") == F.to_date(F.lit(target))
    mine = r.filter(aim).select("vintage", *cell, "pred", "actual", "is_shock", ((F.col("pred") - F.col("actual")) ** 2).alias("_own"))
    total = r.groupBy("vintage", *cell, "is_shock").agg(F.sum((F.col("pred") - F.col("actual")) ** 2).alias("_e"), F.count("*").alias("_n"))
    x = mine.join(total, ["vintage", *cell, "is_shock"]).withColumns({"_e": F.col("_e") - F.col("_own"), "_n": F.col("_n") - 1})
    u = F.when((F.col("_n") > 0) & (F.col("_e") > 1e-12), F.col("_n") / F.col("_e")).otherwise(0.0)
    pool = W.partitionBy("vintage")
    x = x.withColumn("_u", u)
    return x.select("vintage", *cell, "pred", "actual", "is_shock", F.when(F.sum("_u").over(pool) > 0, F.col("_u") / F.sum("_u").over(pool)).otherwise(1 / F.count("*").over(pool)).alias("w"))
