"""Series in files: CSV, JSON and XML observations, exports with a title, wide tables, result tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.texts import slug


def folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder; where spark.checkpoint.dir is unset, as in tests, in a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/tidemark"
    return f"{top.rstrip('/')}/files-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, read from a table in the shared folder: lost executors cost no recomputation, and plans stay short."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_series(spark: SparkSession, path: str, pattern: str = "M/d/yyyy") -> DataFrame:
    """(ticket, date, value) of CSV files with columns seq, ticket, date, value; of rows with one date the last counts."""
    x = spark.read.csv(path, header=True, schema="seq long, ticket string, date string, value double")
    x = x.withColumn("date", F.to_date("date", pattern)).filter("date is not null")
    return x.groupBy("ticket", "date").agg(F.max_by("value", "seq").alias("value"))


def csv_folders(spark: SparkSession, top: str, leave: tuple[str, ...] = ("meta",)) -> DataFrame:
    """Rows of all CSV folders `source=...` below top but those named in leave, with the source."""
    x = spark.read.csv(f"{top}/*", header=True, schema="ticket string, date date, value double")
    x = x.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), "source=([^/]+)/", 1))
    return x.filter(~F.col("source").isin(*leave))


def json_observations(spark: SparkSession, path: str) -> DataFrame:
    """(ticket, date, value) of documents {ticket, observations: [{date, value as text}]}; texts that are no number are null."""
    x = spark.read.json(path, schema="ticket string, observations array<struct<date: date, value: string>>")
    return x.select("ticket", F.inline("observations")).withColumn("value", F.expr("try_cast(value as double)"))


def xml_observations(spark: SparkSession, path: str) -> DataFrame:
    """(ticket, date, value) of XML with Series elements: attributes of the series, and Obs children with attributes."""
    x = spark.read.format("xml").option("rowTag", "Series").schema("_TICKET string, Obs array<struct<_OBS_VALUE: double, _TIME_PERIOD: string>>").load(path)
    x = x.select(F.col("_TICKET").alias("ticket"), F.explode("Obs").alias("o"))
    return x.select("ticket", F.to_date("o._TIME_PERIOD").alias("date"), F.col("o._OBS_VALUE").alias("value"))


def titled_exports(spark: SparkSession, path: str) -> DataFrame:
    """(term, place, date, value) of exports: a title line, a blank one, `Day,term: (Place)`, then the data. `<1` is 0."""
    x = spark.read.text(path, wholetext=True).select(F.split(F.col("value"), "\n").alias("l"))
    head = F.element_at("l", 3)
    x = x.select(F.regexp_extract(head, "^Day,(.*): \\(", 1).alias("term"), F.regexp_extract(head, "\\(([^)]*)\\)", 1).alias("place"), F.explode(F.slice("l", F.lit(4), F.greatest(F.size("l") - 3, F.lit(0)))).alias("row"))
    parts = F.split("row", ",")
    x = x.filter("row <> ''").select("term", "place", F.to_date(parts[0]).alias("date"), parts[1].alias("text"))
    return x.select("term", "place", "date", F.when(F.col("text") == "<1", 0.0).otherwise(F.expr("try_cast(text as double)")).alias("value"))


def wide_months(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, date, value) of a wide table whose columns are months such as 1995M03."""
    x = spark.read.csv(path, header=True)
    months = [c for c in x.columns if c != key]
    long = x.unpivot(key, months, "month", "text").filter("text is not null")
    return long.select(key, F.to_date("month", "yyyy'M'MM").alias("date"), F.col("text").cast("double").alias("value"))


def named_months(rows: DataFrame) -> DataFrame:
    """(ticket, date, value) of tables with month names and the year only in the row of January: it holds until the next.
    Rows before a series' first year have no date."""
    by = W.partitionBy("ticket").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    year = F.last("year", ignorenulls=True).over(by)
    return rows.withColumn("year", year).select("ticket", F.to_date(F.concat("year", F.lit(" "), "month"), "yyyy MMMM").alias("date"), "value")


def upserted(stored: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of new take the place of stored ones with the same keys."""
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new).orderBy(*keys).select(*keys, value)


def keyword_list(rows: DataFrame) -> DataFrame:
    """(keyword, geo, col) of a term list (seq, keyword, geo, col): trimmed, blanks dropped, of repeated terms and places
    the first; those without a column get one from the term and the place."""
    x = rows.withColumn("keyword", F.trim("keyword")).filter("keyword <> ''").groupBy("keyword", "geo").agg(F.min_by("col", "seq").alias("col"))
    return x.select("keyword", "geo", F.coalesce(F.nullif("col", F.lit("")), automatic("keyword", "geo")).alias("col"))


def automatic(term: str, geo: str) -> Column:
    place = F.coalesce(F.nullif(F.lower(geo), F.lit("")), F.lit("worldwide"))
    return F.concat_ws("_", F.lit("gtrends"), slug(F.col(term)), place)


def matched_columns(asked: DataFrame, keywords: DataFrame) -> DataFrame:
    """(term, geo, col): a term that one row of the list has takes its column, else the row of its place, else a new name."""
    k = keywords.withColumn("slug", slug(F.col("keyword")))
    one = k.groupBy("slug").agg(F.count("*").alias("rows"), F.first("col").alias("only"))
    placed = k.groupBy("slug", F.upper("geo").alias("place")).agg(F.count("*").alias("same"), F.first("col").alias("there"))
    x = asked.withColumn("slug", slug(F.col("term"))).withColumn("place", F.upper("geo")).join(one, "slug", "left").join(placed, ["slug", "place"], "left")
    col = F.when(F.col("rows") == 1, F.col("only")).when(F.col("same") == 1, F.col("there")).otherwise(automatic("term", "geo"))
    return x.select("term", "geo", col.alias("col"))


def html_cells(pages: DataFrame, html: str) -> DataFrame:
    """One row per cell of a page's table: the other columns, row from 0, name from the head, text without tags."""
    found = lambda text, tag: F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    bare = lambda text: F.trim(F.regexp_replace(text, "<[^>]*>", ""))
    keep = [c for c in pages.columns if c != html]
    x = pages.withColumn("names", found(F.col(html), "th")).withColumn("body", F.element_at(found(F.col(html), "tbody"), 1))
    x = x.select(*keep, "names", F.posexplode(found(F.col("body"), "tr")).alias("row", "line"))
    x = x.select(*keep, "names", "row", F.posexplode(found(F.col("line"), "td")).alias("at", "cell"))
    return x.select(*keep, "row", bare(F.get("names", F.col("at"))).alias("name"), bare(F.col("cell")).alias("text"))
