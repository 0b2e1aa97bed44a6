"""The pool of readings: errors, weights, weighted quantiles, regimes.

readings: (date, vintage, spec, pred, actual), one row per reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ensemble import known_before


def spread(readings: DataFrame) -> DataFrame:
    """Size, quartiles and actual of every (date, vintage)."""
    q = [F.percentile("pred", p).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return readings.groupBy("date", "vintage").agg(F.count("pred").alias("n"), *q, F.max("actual").alias("actual"))


def errors(readings: DataFrame) -> DataFrame:
    """Root mean squared error by specification and vintage; nulls are skipped."""
    return readings.groupBy("spec", "vintage").agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("actual"), F.lit(2)))).alias("rmse"))


def guarded(readings: DataFrame, most: float = 20.0) -> DataFrame:
    return readings.withColumn("pred", F.when(F.abs("pred") <= most, F.col("pred")))


def weights(readings: DataFrame, months_to_print: int, burn_in: int = 3) -> DataFrame:
    """Weight of each specification at each reading: inverse mean squared error over the quarters printed by then.

    With fewer than burn_in of those, weights are equal.
    """
    r = readings.filter("pred is not null")
    x = known_before(r, ["spec", "vintage"], months_to_print, {"prints": F.lit(1).cast("long"), "e": F.pow(F.col("pred") - F.col("actual"), F.lit(2))})
    raw = F.when(F.col("prints") < burn_in, 1.0).otherwise(1 / F.greatest(F.col("e") / F.col("prints"), F.lit(1e-12)))
    x = x.withColumn("w", raw)
    return x.select("date", "vintage", "spec", "pred", "prints", (F.col("w") / F.sum("w").over(W.partitionBy("date", "vintage"))).alias("w"))


def combined(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("date", "vintage").agg((F.sum(F.col("pred") * F.col("w")) / F.sum("w")).alias("nowcast"))


def latched(flags: DataFrame) -> DataFrame:
    """Once a quarter is flagged at a vintage it stays so."""
    return flags.withColumn("on", F.max(F.col("flag").cast("int")).over(W.partitionBy("date").orderBy("vintage").rowsBetween(W.unboundedPreceding, 0)) == 1)
