"""Month stamps, quarter stamps and vintage arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month(c: str) -> Column:
    return F.trunc(F.col(c).cast("date"), "MM")


def quarter_stamp(c: str) -> Column:
    """First day of the quarter's last month."""
    return F.add_months(F.trunc(F.col(c).cast("date"), "QUARTER"), 2)


def months_between(later: Column, earlier: Column) -> Column:
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("int")


def shifted(c: Column, months: Column) -> Column:
    return F.add_months(c, months)


def month_calendar(obs: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Every month of each key from its first to its last observation."""
    spans = obs.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    return spans.select(*keys, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias(date))
