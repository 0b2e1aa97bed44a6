"""Lags as a few weighted sums: a basis of polynomials over the lags, orthogonal on their grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def legendre(lags: int, degree: int = 2) -> np.ndarray:
    """(degree + 1) x lags: Legendre polynomials on the lags, from -1 to 1, made orthogonal on that grid and of length 1, each
    with its first lag as the polynomial has it in sign."""
    at = np.linspace(-1, 1, lags) if lags > 1 else np.zeros(1)
    rows = np.stack([np.polynomial.legendre.Legendre.basis(k)(at) for k in range(min(degree + 1, lags))])
    out: list[np.ndarray] = []
    for r in rows:
        v = r - sum((r @ o) * o for o in out)
        out.append(v / np.linalg.norm(v))
    return np.array(out)


def basis(spark: SparkSession, lags: int, degree: int = 2) -> DataFrame:
    """(power, lag, weight)."""
    return spark.createDataFrame([(k, i, float(w)) for k, row in enumerate(legendre(lags, degree)) for i, w in enumerate(row)], "power int, lag int, weight double")


def compressed(panel: DataFrame, quarters: DataFrame, lags: int, degree: int = 2) -> DataFrame:
    """(ticket, date, power, value): each quarter's months, its last and the lags - 1 before it, as weighted sums; quarters that
    lack a month drop out. panel: (ticket, date, value) by month, quarters: (date), few."""
    b = F.broadcast(basis(panel.sparkSession, lags, degree))
    at = F.broadcast(quarters.select(F.col("date").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag")).withColumn("date", F.add_months("q", -F.col("lag"))))
    x = panel.filter("value is not null").select("ticket", "date", "value").join(at, "date").join(b, "lag")
    return x.groupBy("ticket", F.col("q").alias("date"), "power").agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.count("*").alias("n")).filter(F.col("n") == lags).drop("n")
