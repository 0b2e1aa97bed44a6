"""Sheets as they are published: stacked headers, years carried along, labelled rows, lettered months, file names.

Cells are (line, at, text): the line from the top, the column from the left, both from 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stacked_names(cells: DataFrame, lines: int = 3) -> DataFrame:
    """(at, name): names of columns from header lines, of which the first is filled to the right. A sheet's columns are few."""
    head = cells.filter(F.col("line") < lines)
    by = W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    wide = head.groupBy("at").agg(*[F.max(F.when(F.col("line") == i, F.nullif(F.trim("text"), F.lit("")))).alias(f"l{i}") for i in range(lines)])
    return wide.withColumn("l0", F.last("l0", ignorenulls=True).over(by)).select("at", F.concat_ws("_", *[f"l{i}" for i in range(lines)]).alias("name"))


def labelled_rows(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(ticket, date, value) of a sheet whose line 0 holds dates and whose column 0 holds labels; lines whose label is in
    labels (label, ticket) stay. Nothing is transposed: cells meet their line's label and their column's date."""
    text = F.trim("text")
    dates = cells.filter("line = 0 and at > 0").select("at", F.to_date(text).alias("date"))
    named = cells.filter("line > 0 and at = 0").select("line", text.alias("label")).join(F.broadcast(labels), "label")
    body = cells.filter("line > 0 and at > 0").select("line", "at", F.expr("try_cast(trim(text) as double)").alias("value"))
    return body.join(named, "line").join(dates, "at").filter("value is not null").select("ticket", "date", "value")


_ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4}


def carried_quarters(rows: DataFrame) -> DataFrame:
    """(ticket, date, value) of rows (ticket, line, year, quarter, value) whose year stands in a text of some rows only and
    holds until the next, for leading rows from the first one after; quarters are roman and stamped at their last month."""
    found = F.nullif(F.regexp_extract("year", r"(\d{4})", 1), F.lit("")).cast("int")
    by = W.partitionBy("ticket").orderBy("line")
    y = F.coalesce(F.last("y", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)), F.first("y", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing)))
    q = F.create_map(*[F.lit(x) for pair in _ROMAN.items() for x in pair])[F.upper(F.trim("quarter"))]
    return rows.withColumn("y", found).withColumn("y", y).select("ticket", F.make_date("y", q * 3, F.lit(1)).alias("date"), "value")


def lettered_months(sheet: DataFrame, key: str, letters: dict[str, str]) -> DataFrame:
    """(key, date, one column per letter) of a wide sheet with columns such as E1995JAN; dates are ends of months."""
    long = sheet.unpivot(key, [c for c in sheet.columns if c != key], "name", "value").filter("value is not null")
    date = F.last_day(F.to_date(F.concat(F.initcap(F.substring("name", 6, 3)), F.substring("name", 2, 4)), "MMMyyyy"))
    return long.withColumn("date", date).withColumn("letter", F.substring("name", 1, 1)).groupBy(key, "date").pivot("letter", list(letters)).agg(F.first("value")).withColumnsRenamed(letters)


def plain_header(sheet: DataFrame) -> DataFrame:
    """Columns in lower case, runs of anything but letters and digits one underscore, none at the ends."""
    import re

    return sheet.toDF(*[re.sub("[^a-z0-9]+", "_", c.lower()).strip("_") for c in sheet.columns])


def inventory(names: DataFrame) -> DataFrame:
    """(product, date, tile, name) of files named product.AyyyyDDD.hHHvVV.*; other names drop out."""
    form = r"^([A-Z0-9]+)\.A(\d{7})\.(h\d+v\d+)\."
    part = lambda i: F.regexp_extract("name", form, i)
    return names.filter(F.col("name").rlike(form)).select(part(1).alias("product"), F.to_date(part(2), "yyyyDDD").alias("date"), part(3).alias("tile"), "name")
