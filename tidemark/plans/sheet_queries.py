"""Queries that lay the given tables out as published sheets and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.queries import query
from tidemark.plans.site_queries import points
from tidemark.sources import files, sheets
from tidemark.testbed import daily, meta, obs

_METHODS = "m AS (SELECT agg_method, date, sum(value) AS value FROM obs JOIN meta USING (ticket) GROUP BY 1, 2)"


def by_method(s, d) -> DataFrame:
    return obs(s, d).join(meta(s, d), "ticket").groupBy("agg_method", "date").agg(F.sum("value").alias("value"))


def cells(wide: DataFrame) -> DataFrame:
    """Dates in line 0, one line a method under it, with its label in column 0."""
    at = F.dense_rank().over(W.orderBy("date"))
    body = wide.withColumn("at", at).withColumn("line", F.expr("array_position(array('last', 'mean', 'sum'), agg_method)").cast("int"))
    labels = body.select("line", F.lit(0).alias("at"), F.concat(F.lit(" "), F.initcap("agg_method")).alias("text")).distinct()
    dates = body.select(F.lit(0).alias("line"), "at", F.col("date").cast("string").alias("text")).distinct()
    return body.select("line", "at", F.col("value").cast("string").alias("text")).unionByName(labels).unionByName(dates)


@query("s09_stacked_header", f", {_METHODS}, q AS (SELECT DISTINCT year(date) AS y, month(date) AS mo FROM m) SELECT CAST(row_number() OVER (ORDER BY y, mo) AS INTEGER) AS at, 'Y' || y || '_M' || mo || '_value' AS name FROM q")
def s09(s, d):
    """Months under years: the year stands over its first month only."""
    q = by_method(s, d).select(F.year("date").alias("y"), F.month("date").alias("mo")).distinct()
    q = q.withColumn("at", F.row_number().over(W.orderBy("y", "mo"))).withColumn("new", F.row_number().over(W.partitionBy("y").orderBy("mo")) == 1)
    line = lambda i, text: F.struct(F.lit(i).alias("line"), text.alias("text"))
    head = F.array(line(0, F.when(F.col("new"), F.concat(F.lit("Y"), "y")).otherwise("")), line(1, F.concat(F.lit(" M"), "mo")), line(2, F.lit("value")))
    return sheets.stacked_names(q.select("at", F.inline(head)))


@query("s10_bulk_trade", ", p AS (SELECT date, ticket, value FROM obs JOIN meta USING (ticket) WHERE agg_method = 'sum') SELECT date, sum(value) AS total FROM p GROUP BY 1")
def s10(s, d):
    """A bulk file with its own header: renamed, one partner kept, summed by month."""
    path = files.folder(s)
    x = obs(s, d).join(meta(s, d), "ticket")
    x.select(F.col("ticket").alias("Commodity Code"), F.col("agg_method").alias("PARTNER (name)"), F.year("date").alias("Year"), F.month("date").alias("Month."), F.col("value").alias(" Value, total")).write.csv(path, header=True)
    y = sheets.plain_header(s.read.csv(path, header=True, schema="a string, b string, c int, d int, e double").toDF("Commodity Code", "PARTNER (name)", "Year", "Month.", " Value, total"))
    return y.filter("partner_name = 'sum'").groupBy(F.make_date("year", "month", F.lit(1)).alias("date")).agg(F.sum("value_total").alias("total"))


@query("s12_lettered_months", f", {_METHODS} SELECT agg_method, last_day(date) AS date, value AS exports, value * 2 AS imports FROM m")
def s12(s, d):
    x = by_method(s, d)
    name = lambda letter: F.concat(F.lit(letter), F.date_format("date", "yyyy"), F.upper(F.date_format("date", "MMM")))
    long = x.select("agg_method", F.inline(F.array(F.struct(name("E").alias("name"), F.col("value").alias("value")), F.struct(name("I").alias("name"), (F.col("value") * 2).alias("value")))))
    return sheets.lettered_months(long.groupBy("agg_method").pivot("name").agg(F.first("value")), "agg_method", {"E": "exports", "I": "imports"})


@query("s15_inventory", ", x AS (SELECT DISTINCT site // 72 AS h, site % 12 // 6 AS v, date FROM daily) SELECT 'RAD1' AS product, date, 'h' || lpad(CAST(h AS VARCHAR), 2, '0') || 'v' || lpad(CAST(v AS VARCHAR), 2, '0') AS tile, count(*) AS files FROM x WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1, 2, 3")
def s15(s, d):
    """Files by product, night and tile, between two nights, by their names alone; names of another form stand among them."""
    x = daily(s, d).join(points(s, d), "site").select("h", "v", "date").distinct()
    tile = F.concat(F.lit("h"), F.lpad(F.col("h").cast("string"), 2, "0"), F.lit("v"), F.lpad(F.col("v").cast("string"), 2, "0"))
    name = F.concat(F.lit("RAD1.A"), F.date_format("date", "yyyyDDD"), F.lit("."), tile, F.lit(".001.h5"))
    names = x.select(name.alias("name")).unionByName(x.select(F.concat(F.lit("notes-"), F.date_format("date", "yyyyDDD"), F.lit(".txt")).alias("name")))
    return sheets.inventory(names).filter("date between date'2024-01-10' and date'2024-01-20'").groupBy("product", "date", "tile").agg(F.count("*").alias("files"))


@query("s17_sheets", " SELECT agg_method AS sheet, count(*) AS rows, round(sum(value), 4) AS total FROM obs JOIN meta USING (ticket) GROUP BY 1")
def s17(s, d):
    """One table a sheet, read again one by one."""
    path = files.folder(s)
    obs(s, d).join(meta(s, d), "ticket").select("agg_method", "ticket", "date", "value").write.partitionBy("agg_method").parquet(path)
    one = [s.read.parquet(f"{path}/agg_method={m}").agg(F.lit(m).alias("sheet"), F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("total")) for m in ("last", "mean", "sum")]
    return one[0].unionByName(one[1]).unionByName(one[2])


@query("s22_carried_years", " SELECT ticket, date, round(value, 6) AS value FROM qobs")
def s22(s, d):
    """The year stands at its first quarter, in a series' first year at its last one there; quarters are roman."""
    from tidemark.operators import panel

    q = panel.to_quarter(obs(s, d), meta(s, d)).withColumn("y", F.year("date"))
    by = W.partitionBy("ticket")
    q = q.withColumn("first", F.min("y").over(by)).withColumn("line", F.row_number().over(by.orderBy("date")))
    a, z = F.min("date").over(W.partitionBy("ticket", "y")), F.max("date").over(W.partitionBy("ticket", "y"))
    shown = F.when(F.col("date") == F.when(F.col("y") == F.col("first"), z).otherwise(a), F.concat(F.lit("Anno "), "y", F.lit(" (p)")))
    roman = F.element_at(F.array(*map(F.lit, ("I", "II", " iii", "IV "))), F.quarter("date"))
    rows = q.select("ticket", "line", shown.alias("year"), roman.alias("quarter"), F.round("value", 6).alias("value"))
    return sheets.carried_quarters(rows)


@query("s23_labelled_rows", f", {_METHODS} SELECT 'T_' || agg_method AS ticket, date, value FROM m WHERE agg_method <> 'last'")
def s23(s, d):
    labels = s.createDataFrame([("Mean", "T_mean"), ("Sum", "T_sum")], "label string, ticket string")
    return sheets.labelled_rows(cells(by_method(s, d)), labels)


@query("s24_wide_years", " SELECT ticket, CAST(year(date) AS INTEGER) AS year, sum(value) AS value FROM obs GROUP BY 1, 2")
def s24(s, d):
    """A sheet with a column a year, melted; empty cells drop out."""
    path = files.folder(s)
    x = obs(s, d).withColumn("year", F.year("date"))
    first, last = x.agg(F.min("year"), F.max("year")).first()
    x.groupBy("ticket").pivot("year", list(range(first, last + 1))).agg(F.sum("value")).write.csv(path, header=True)
    wide = s.read.csv(path, header=True)
    return wide.unpivot("ticket", [c for c in wide.columns if c != "ticket"], "year", "value").filter("value is not null").select("ticket", F.col("year").cast("int").alias("year"), F.col("value").cast("double").alias("value"))
