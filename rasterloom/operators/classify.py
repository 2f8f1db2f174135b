"""Photo or graphic: distinct colours and the share of equal neighbours on a sample grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sample grid and the limits of a graphic.
ROWS, COLUMNS, COLOURS, FLAT = 64, 2048, 256, 0.5


def sampled(pixels: DataFrame, *, image: str = "image", x: str = "x", y: str = "y", width: str = "width", height: str = "height") -> DataFrame:
    """The pixels on the grid: every ceil(h / 64)th row and ceil(w / 2048)th column."""
    step = lambda side, most: F.ceil(F.col(side) / F.lit(most))
    return pixels.filter((F.col(y) % step(height, ROWS) == 0) & (F.col(x) % step(width, COLUMNS) == 0))


def content(distinct: Column, flat: Column) -> Column:
    return F.when((distinct <= COLOURS) | (flat >= FLAT), "graphic").otherwise("photo")


def classify(pixels: DataFrame, image: list[str], line: list[str], order: list[str], pixel: list[str]) -> DataFrame:
    """(image, n_pixels, n_colours, flat_share, content) of each image.

    pixels: sampled rows; pixel: the columns that make a colour, compared as they are; neighbours
    follow each other by order within a line. n_colours saturates one past the limit. An image
    without neighbours has a flat share of 0.
    """
    before = Window.partitionBy(*image, *line).orderBy(*order)
    value = F.struct(*pixel)
    rows = pixels.withColumns({"__same": (F.lag(value).over(before) == value).cast("double"), "__value": value})
    out = rows.groupBy(*image).agg(F.count("*").alias("n_pixels"), F.least(F.count_distinct("__value"), F.lit(COLOURS + 1)).alias("n_colours"), F.coalesce(F.avg("__same"), F.lit(0.0)).alias("flat_share"))
    return out.withColumn("content", content(F.col("n_colours"), F.col("flat_share")))


def within(pixels: DataFrame, image: list[str], pixel: list[str], most: int) -> DataFrame:
    """(image, fits): whether an image has at most so many colours."""
    return pixels.groupBy(*image).agg((F.count_distinct(F.struct(*pixel)) <= most).alias("fits"))
