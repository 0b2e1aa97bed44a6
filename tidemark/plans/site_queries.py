"""Queries on sites, pixels and shapes, and on terms, names and tables that come as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.texts import slug
from tidemark.operators import panel, sites
from tidemark.plans.queries import query, rounded
from tidemark.sources import files
from tidemark.testbed import daily, obs, read

SIDE = 6


def points(s: SparkSession, d: str) -> DataFrame:
    """Users as sites, one to a pixel of tiles of 10 by 10 with 6 by 6 pixels; twelve rows of pixels, running east."""
    u = read(s, d, "events").select(F.col("user_id").alias("site")).distinct()
    u = u.select("site", ((F.floor(F.col("site") / 12) + 0.5) * 10 / SIDE).alias("x"), ((F.col("site") % 12 + 0.5) * 10 / SIDE).alias("y"))
    return sites.placed(u, 10.0, SIDE)


def pixels(s: SparkSession, d: str) -> DataFrame:
    """Readings of a night as pixels; every seventh site has the fill value."""
    x = daily(s, d).groupBy("site", "date").agg(F.avg("value").alias("value"))
    raw = F.when(F.col("site") % 7 == 0, 65535.0).otherwise(F.col("value"))
    return x.join(points(s, d), "site").select("date", "h", "v", "row", "col", sites.valid(raw).alias("value"))


PIX = """, pix AS (SELECT date, site // 12 // 6 AS h, site % 12 // 6 AS v, site % 12 % 6 AS row, site // 12 % 6 AS col, CASE WHEN site % 7 <> 0 THEN value END AS value FROM (SELECT site, date, avg(value) AS value FROM daily GROUP BY 1, 2))"""
_BLOCK = PIX + """, b AS (SELECT s.site, p.date, p.value, p.row = s.row AND p.col = s.col AS own FROM (SELECT DISTINCT site, site // 12 // 6 AS h, site % 12 // 6 AS v, site % 12 % 6 AS row, site // 12 % 6 AS col FROM daily) s JOIN pix p ON p.h = s.h AND p.v = s.v AND abs(p.row - s.row) <= 1 AND abs(p.col - s.col) <= 1)"""


@query("j14_point_pixels", PIX + " SELECT DISTINCT site, site // 12 // 6 AS h, site % 12 // 6 AS v, site % 12 % 6 AS row, site // 12 % 6 AS col FROM daily")
def j14(s, d):
    return points(s, d).select("site", "h", "v", "row", "col")


@query("s14_valid_pixels", PIX + " SELECT date, h, v, count(*) AS pixels, count(value) AS valid, round(min(value), 6) AS low, round(max(value), 6) AS high FROM pix GROUP BY 1, 2, 3")
def s14(s, d):
    x = pixels(s, d).groupBy("date", "h", "v").agg(F.count("*").alias("pixels"), F.count("value").alias("valid"), F.min("value").alias("low"), F.max("value").alias("high"))
    return rounded(x, "low", "high")


@query("n01_pixel_blocks", _BLOCK + " SELECT site, date, round(max(value) FILTER (own), 6) AS own, round(avg(value), 11) AS around, count(value) AS n FROM b GROUP BY 1, 2")
def n01(s, d):
    """Each site's own pixel and the mean of the block around it, clipped at the edge of its tile."""
    return rounded(sites.blocks(points(s, d).select("site", "h", "v", "row", "col"), pixels(s, d), SIDE, places=11), "own")


#: Corners (x east, y south) of two shapes; the second is not convex.
SHAPES = {"west": [(1.0, 1.0), (9.0, 2.0), (12.5, 15.0), (2.0, 18.0)], "notch": [(5.0, 0.0), (20.0, 0.0), (20.0, 19.0), (12.0, 7.0), (5.0, 19.0)]}
_EDGES = ", ".join(f"('{n}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for n, c in SHAPES.items() for a, b in zip(c, c[1:] + c[:1], strict=True))
_INSIDE = PIX + f""", edge(shape, x1, y1, x2, y2) AS (VALUES {_EDGES}),
place AS (SELECT DISTINCT h, v, row, col, h * 10 + (col + 0.5) * 10 / 6 AS x, v * 10 + (row + 0.5) * 10 / 6 AS y FROM pix),
inside AS (SELECT shape, h, v, row, col FROM place, edge WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1),
partial AS (SELECT shape, h, v, date, avg(value) AS mean, sum(value) AS total, count(value) AS n FROM pix JOIN inside USING (h, v, row, col) GROUP BY 1, 2, 3, 4)"""


def inside(s: SparkSession, d: str) -> DataFrame:
    return sites.mask(points(s, d).select("h", "v", "row", "col", "x", "y"), sites.edges(s, SHAPES))


@query("j15_pixels_in_shapes", _INSIDE + " SELECT * FROM inside")
def j15(s, d):
    return inside(s, d)


@query("n02_shape_readings", _INSIDE + " SELECT shape, h, v, date, round(mean, 6) AS mean, round(total, 6) AS total, n FROM partial")
def n02(s, d):
    return rounded(sites.shape_readings(pixels(s, d), inside(s, d)), "mean", "total")


@query("n03_shape_upsert", _INSIDE + ", fresh AS (SELECT shape, date, round(sum(total) / nullif(sum(n), 0), 5) AS mean, count(*) AS tiles FROM partial GROUP BY 1, 2) SELECT shape, date, mean, tiles FROM fresh WHERE date >= DATE '2024-01-20' UNION ALL SELECT shape, date, 0.0, 0 FROM fresh WHERE date < DATE '2024-01-20'")
def n03(s, d):
    """Nights read again take the place of stored ones; here all are stored as zero and the last third is read again."""
    new = rounded(sites.merged_tiles(sites.shape_readings(pixels(s, d), inside(s, d))), "mean", places=5).select("shape", "date", "mean", "tiles")
    old = new.select("shape", "date", F.lit(0.0).alias("mean"), F.lit(0).cast("long").alias("tiles"))
    again = new.filter("date >= date'2024-01-20'")
    return old.join(again.select("shape", "date"), ["shape", "date"], "left_anti").unionByName(again)


@query("n07_mosaic", PIX + ", x AS (SELECT date, (v - min(v) OVER (PARTITION BY date)) * 6 + row AS row, (h - min(h) OVER (PARTITION BY date)) * 6 + col AS col, value FROM pix) SELECT date, row, col, round(value, 6) AS value FROM x")
def n07(s, d):
    return rounded(sites.mosaic(pixels(s, d), SIDE), "value")


_FEATURES = """, q AS (SELECT quantile_cont(value, 0.9) AS cut FROM daily), lo AS (SELECT avg(value) AS low FROM daily, q WHERE value <= cut),
c AS (SELECT sector, date, CASE WHEN value > cut THEN low ELSE value END AS value FROM daily, q, lo),
bd AS (SELECT sector, date, avg(value) AS value FROM c GROUP BY 1, 2 UNION ALL SELECT 'all', date, avg(value) FROM c GROUP BY 2),
r AS (SELECT sector, date, value, avg(value) OVER (PARTITION BY sector ORDER BY date ROWS {0} PRECEDING) AS roll FROM bd),
m AS (SELECT sector, CAST(date_trunc('month', date) AS DATE) AS month, max_by(roll, date) AS last, avg(value) AS mean FROM r GROUP BY 1, 2)
"""


def _features_sql(rows: int) -> str:
    return f"SELECT 'ntl_' || lower(sector) || '_meanw{rows}' AS feature, month, round(last, 5) AS value FROM m UNION ALL SELECT 'ntl_' || lower(sector) || '_mean', month, round(mean, 5) FROM m"


@query("n05_monthly_features", _FEATURES.format(29) + _features_sql(30))
def n05(s, d):
    """Capped readings by sector and over all: the month's last mean over 30 rows, and the mean of its days."""
    return rounded(sites.monthly_features(panel.capped(daily(s, d)), 30), "value", places=5)


@query("n06_short_features", _FEATURES.format(6) + _features_sql(7))
def n06(s, d):
    """The same over 7 rows."""
    return rounded(sites.monthly_features(panel.capped(daily(s, d)), 7), "value", places=5)


@query("s13_plain_names", r" SELECT DISTINCT regexp_extract(text, '^\S+') AS name, trim(regexp_replace(strip_accents(regexp_extract(text, '^\S+')), '[^\x00-\x7F]', '', 'g')) AS \"plain\" FROM documents WHERE text IS NOT NULL".replace('\\"', '"'))
def s13(s, d):
    """First words of documents as place names, without marks."""
    return read(s, d, "documents").filter("text is not null").select(F.regexp_extract("text", r"^\S+", 0).alias("name")).distinct().withColumn("plain", sites.plain(F.col("name")))


_KEYS = """, kw AS (SELECT doc_id AS seq, CASE WHEN doc_id % 10 = 3 THEN '  ' ELSE ' ' || source || ' ' END AS keyword, CASE WHEN lang = 'en' THEN '' ELSE lang END AS geo, CASE WHEN doc_id % 4 = 0 THEN 'col_' || source || '_' || lang ELSE '' END AS col FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
dim AS (SELECT trim(keyword) AS keyword, geo, arg_min(col, seq) AS col FROM kw WHERE trim(keyword) <> '' GROUP BY 1, 2),
keys AS (SELECT keyword, geo, coalesce(nullif(col, ''), 'gtrends_' || keyword || '_' || coalesce(nullif(lower(geo), ''), 'worldwide')) AS col FROM dim)"""


def keywords(s: SparkSession, d: str) -> DataFrame:
    """Sources and languages of documents as a list of terms and places: some blank, most repeated, few named."""
    x = read(s, d, "documents").filter("source is not null and lang is not null")
    k = x.select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 10 == 3, "  ").otherwise(F.concat(F.lit(" "), "source", F.lit(" "))).alias("keyword"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("geo"), F.when(F.col("doc_id") % 4 == 0, F.concat_ws("_", F.lit("col"), "source", "lang")).otherwise("").alias("col"))
    return files.keyword_list(k)


@query("s08_keywords", _KEYS + " SELECT * FROM keys")
def s08(s, d):
    return keywords(s, d)


@query(
    "g03_matched",
    _KEYS + """, req AS (SELECT DISTINCT upper(source) AS term, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS geo FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
n AS (SELECT keyword, count(*) AS rows, any_value(col) AS one FROM keys GROUP BY 1)
SELECT term, req.geo, CASE WHEN n.rows = 1 THEN n.one ELSE coalesce(k.col, 'gtrends_' || lower(term) || '_' || coalesce(nullif(lower(req.geo), ''), 'worldwide')) END AS col
FROM req LEFT JOIN n ON n.keyword = lower(term) LEFT JOIN keys k ON k.keyword = lower(term) AND upper(k.geo) = upper(req.geo)""",
)
def g03(s, d):
    """Downloaded columns, in capitals and with a place in most, find their name in the list."""
    x = read(s, d, "documents").filter("source is not null and lang is not null")
    asked = x.select(F.upper("source").alias("term"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("geo")).distinct()
    return files.matched_columns(asked, keywords(s, d))


@query("s06_html_tables", " SELECT ticket, date, value FROM obs")
def s06(s, d):
    """Series written as pages with a table, then read from the tables."""
    path = files.folder(s)
    cell = lambda c: F.concat(F.lit("<td class='x'>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(F.concat(F.lit("<b>"), F.col("date").cast("string"), F.lit("</b>"))), cell(F.col("value").cast("string")), F.lit("</tr>"))
    page = F.concat(F.lit("<html><table><thead><tr><th>date</th><th> value </th></tr></thead>\n<tbody>"), F.array_join(F.collect_list(row), "\n"), F.lit("</tbody></table></html>"))
    obs(s, d).groupBy("ticket").agg(page.alias("html")).write.parquet(path)
    cells = files.html_cells(s.read.parquet(path), "html")
    return cells.groupBy("ticket", "row").pivot("name", ["date", "value"]).agg(F.first("text")).select("ticket", F.to_date("date").alias("date"), F.col("value").cast("double").alias("value"))
