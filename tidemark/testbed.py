"""The driver tables as a panel: obs(ticket, date, value), meta, target and daily readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import month, quarter_stamp


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticket(column: str):
    return F.concat(F.lit("S"), F.lpad(F.col(column).cast("string"), 7, "0"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly quantity of every supplier; months without sales are the natural gaps."""
    return read(spark, sf_dir, "lineitem").groupBy(ticket("l_suppkey").alias("ticket"), month("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("value"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    method = F.when(k % 3 == 0, "mean").when(k % 3 == 1, "last").otherwise("sum")
    return read(spark, sf_dir, "supplier").select(ticket("s_suppkey").alias("ticket"), (k % 9).cast("int").alias("months_lag"), (k % 2).cast("int").alias("nominal"), method.alias("agg_method"))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly orders, stamped at the quarter's last month."""
    return read(spark, sf_dir, "orders").groupBy(quarter_stamp("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice") / 1000, 2).alias("y"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily readings of sites: the mean of a user's events of one type on a day."""
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("sector"), F.col("user_id").alias("site"), F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 6).alias("value"))


#: The same tables for the oracle.
CTE = """
WITH obs AS (SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') AS ticket, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
meta AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS ticket, CAST(s_suppkey % 9 AS INTEGER) AS months_lag, CAST(s_suppkey % 2 AS INTEGER) AS nominal,
  CASE s_suppkey % 3 WHEN 0 THEN 'mean' WHEN 1 THEN 'last' ELSE 'sum' END AS agg_method FROM supplier),
target AS (SELECT CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE) AS date, round(sum(o_totalprice) / 1000, 2) AS y FROM orders GROUP BY 1),
daily AS (SELECT event_type AS sector, user_id AS site, CAST(ts AS DATE) AS date, round(avg(value), 6) AS value FROM events GROUP BY 1, 2, 3),
qobs AS (SELECT ticket, CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE) AS date,
  CASE any_value(agg_method) WHEN 'mean' THEN avg(value) WHEN 'last' THEN max_by(value, date) ELSE sum(value) END AS value FROM obs JOIN meta USING (ticket) GROUP BY 1, 2),
qgrowth AS (SELECT ticket, date, 100 * (value / nullif(lag(value) OVER (PARTITION BY ticket ORDER BY date), 0) - 1) AS growth FROM qobs),
ygrowth AS (SELECT date, 100 * (y / nullif(lag(y) OVER (ORDER BY date), 0) - 1) AS growth FROM target)
"""
