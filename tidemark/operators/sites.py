"""Sites on a plane of square tiles of pixels: blocks around sites, shapes, mosaics.

A pixel is (date, h, v, row, col, value): its tile, its place in the tile from the north-west corner, its reading.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Letters that are a plain letter with marks, by the decomposition of Unicode.
_MARKED = {chr(c): n for c in range(0xC0, 0x250) if (n := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))).isascii() and len(n) == 1}


def plain(text: Column) -> Column:
    """Without marks on letters, without what has no plain letter, trimmed; null is empty."""
    bare = F.translate(F.coalesce(text, F.lit("")), "".join(_MARKED), "".join(_MARKED.values()))
    return F.trim(F.regexp_replace(bare, r"[^\x00-\x7F]", ""))


def valid(reading: Column) -> Column:
    """Fill values (65535 and more, or below 0) are null."""
    return F.when((reading < 65535) & (reading >= 0), reading)


def placed(sites: DataFrame, tile: float, pixels: int) -> DataFrame:
    """Tile, row and column of sites (.., x east, y south), by the size of a tile and the pixels along its side."""
    size = tile / pixels
    h, v = F.floor(F.col("x") / tile), F.floor(F.col("y") / tile)
    at = lambda c, t: F.floor((F.col(c) - t * tile) / size).cast("long")
    return sites.withColumns({"h": h, "v": v, "row": at("y", v), "col": at("x", h)})


def blocks(sites: DataFrame, pixels: DataFrame, side: int, places: int = 2) -> DataFrame:
    """(site, date, own, around, n): each site's pixel and the mean, rounded, of the 3 x 3 pixels around it in its tile.

    A block at the edge of a tile is what the tile has of it; null pixels are skipped. Sites, with nine offsets each,
    meet pixels by place; nothing is compared with more than nine rows a date.
    """
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    near = sites.withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    near = near.withColumns({"row": F.col("row") + F.col("dr"), "col": F.col("col") + F.col("dc")})
    near = near.filter(F.col("row").between(0, side - 1) & F.col("col").between(0, side - 1))
    j = near.join(pixels, ["h", "v", "row", "col"])
    own = F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("value")))
    return j.groupBy("site", "date").agg(own.alias("own"), F.round(F.avg("value"), places).alias("around"), F.count("value").alias("n"))


def edges(spark: SparkSession, shapes: dict[str, Iterable[tuple[float, float]]]) -> DataFrame:
    """(shape, x1, y1, x2, y2, and the shape's box) of closed shapes given by corners."""
    rows = []
    for name, corners in shapes.items():
        c = list(corners)
        xs, ys = [p[0] for p in c], [p[1] for p in c]
        rows += [(name, *map(float, a), *map(float, b), float(min(xs)), float(max(xs)), float(min(ys)), float(max(ys))) for a, b in zip(c, c[1:] + c[:1], strict=True)]
    return spark.createDataFrame(rows, "shape string, x1 double, y1 double, x2 double, y2 double, west double, east double, north double, south double")


def mask(places: DataFrame, edge: DataFrame) -> DataFrame:
    """(shape, h, v, row, col) of places (with centres x, y) inside a shape: a ray to the east crosses its edges an odd
    number of times. Edges are as many as the corners given by the caller, so they are broadcast."""
    box = (F.col("x") >= F.col("west")) & (F.col("x") <= F.col("east")) & (F.col("y") >= F.col("north")) & (F.col("y") <= F.col("south"))
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    j = places.join(F.broadcast(edge), box)
    return j.groupBy("shape", "h", "v", "row", "col").agg((F.count_if(crosses) % 2).alias("odd")).filter("odd = 1").drop("odd")


def shape_readings(pixels: DataFrame, inside: DataFrame) -> DataFrame:
    """(shape, h, v, date, mean, total, n) over the valid pixels of each tile and night."""
    j = pixels.join(inside, ["h", "v", "row", "col"])
    return j.groupBy("shape", "h", "v", "date").agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("value").alias("n"))


def merged_tiles(partial: DataFrame) -> DataFrame:
    """Tiles of one shape and night together: sums and numbers add up, the mean is their quotient."""
    return partial.groupBy("shape", "date").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.count("*").alias("tiles")).withColumn("mean", F.col("total") / F.nullif("n", F.lit(0)))


def mosaic(pixels: DataFrame, side: int) -> DataFrame:
    """Pixels of all tiles on one grid that starts at the north-west corner of each night's tiles."""
    x = pixels.select("date", (F.col("v") * side + F.col("row")).alias("row"), (F.col("h") * side + F.col("col")).alias("col"), "h", "v", "value")
    low = x.groupBy("date").agg((F.min("v") * side).alias("r0"), (F.min("h") * side).alias("c0"))
    return x.join(low, "date").select("date", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "value")


def monthly_features(daily: DataFrame, rows: int) -> DataFrame:
    """(feature, month, value): by sector and over all, the month's last mean over some rows and its mean of days."""
    by_day = daily.groupBy("sector", "date").agg(F.avg("value").alias("value"))
    all_ = daily.groupBy("date").agg(F.avg("value").alias("value")).select(F.lit("all").alias("sector"), "date", "value")
    x = by_day.unionByName(all_)
    roll = F.avg("value").over(W.partitionBy("sector").orderBy("date").rowsBetween(-(rows - 1), 0))
    m = x.withColumn("roll", roll).groupBy("sector", F.trunc("date", "MM").alias("month")).agg(F.max_by("roll", "date").alias("last"), F.avg("value").alias("mean"))
    named = lambda kind: F.concat_ws("_", F.lit("ntl"), F.lower("sector"), F.lit(kind))
    return m.select("month", F.inline(F.array(F.struct(named(f"meanw{rows}").alias("feature"), F.col("last").alias("value")), F.struct(named("mean").alias("feature"), F.col("mean").alias("value")))))
