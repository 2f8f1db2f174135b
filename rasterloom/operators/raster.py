"""Operators on exploded images: one row a pixel, (image, y, x) and channel columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import orientation as turning


def pattern(spark: SparkSession, width: int = 48, height: int = 32) -> DataFrame:
    """The canonical test pattern (y, x, r, g, b, a, gray)."""
    at = spark.range(width * height).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    r, g = F.floor(F.col("x") * 255 / F.lit(width - 1)), F.floor(F.col("y") * 255 / F.lit(height - 1))
    out = at.select("y", "x", r.alias("r"), g.alias("g"), F.when(F.col("x") < width // 2, 40).otherwise(220).cast("long").alias("b"), F.when(F.col("y") % 2 == 0, 255).otherwise(128).cast("long").alias("a"))
    return out.withColumn("gray", F.floor((F.col("r") + F.col("g") + F.col("b")) / F.lit(3)))


def quantised(sample: Column, quality: Column, least: int = 1, base: int = 0) -> Column:
    """The closed-form lossy codec of the tests: samples rounded to a step that falls with quality."""
    step = F.greatest(F.round(1 + (100 - quality) / 100.0 * 63), F.lit(least)).cast("long")
    n = F.floor((sample - base + F.floor(step / F.lit(2))) / step)
    return F.least(F.lit(255).cast("long"), base + n * step)


def mean_error(pairs: DataFrame, keys: list[str], channels: list[tuple[str, str]]) -> DataFrame:
    """Mean absolute differences: mae over all channels, mae_<first name> of each."""
    each = [F.abs(F.col(a) - F.col(b)) for a, b in channels]
    total = reduce(lambda x, y: x + y, each) / F.lit(len(each))
    return pairs.groupBy(*keys).agg(F.avg(total).alias("mae"), *[F.avg(e).alias(f"mae_{a}") for e, (a, _) in zip(each, channels, strict=True)])


def upright(pixels: DataFrame, width: Column, height: Column, orientation: Column) -> DataFrame:
    """pixels with x and y as after putting the image upright."""
    x, y = turning.place(F.col("x"), F.col("y"), width, height, orientation)
    return pixels.withColumns({"x": x, "y": y})


def nearest(pixels: DataFrame, factor: int) -> DataFrame:
    """Every factor-th pixel, at centres: integer reduction without mixing."""
    half = factor // 2
    return pixels.filter((F.col("x") % factor == half) & (F.col("y") % factor == half)).withColumns({"x": F.floor(F.col("x") / F.lit(factor)), "y": F.floor(F.col("y") / F.lit(factor))})


def box(pixels: DataFrame, factor: int, channels: list[str], keys: list[str] | None = None) -> DataFrame:
    """Means of factor x factor blocks."""
    at = [F.floor(F.col(c) / F.lit(factor)).alias(c) for c in ("y", "x")]
    return pixels.groupBy(*(keys or []), *at).agg(*[F.avg(c).alias(c) for c in channels])


def moving_box(pixels: DataFrame, radius: int, channels: list[str], keys: list[str] | None = None) -> DataFrame:
    """Horizontal means over 2 * radius + 1 pixels, fewer at the edges."""
    along = Window.partitionBy(*(keys or []), "y").orderBy("x").rowsBetween(-radius, radius)
    return pixels.withColumns({c: F.avg(c).over(along) for c in channels})


def padded(pixels: DataFrame, width: int, height: int, left: int, top: int, background: dict[str, int], keys: list[str] | None = None) -> DataFrame:
    """Each image on a larger canvas: background where it has no pixel. keys name the columns that tell images apart.

    Every row of pixels gives its own place and every image its canvas once; an image without pixels gives none.
    """
    own = list(keys or [])
    grid = pixels.sparkSession.range(width * height).select(F.floor(F.col("id") / width).alias("y"), (F.col("id") % width).alias("x"))
    if own:  # each image unfolds its own canvas
        cells = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width * height - 1).cast("long")))
        grid = pixels.select(*own).distinct().withColumn("__at", cells)
        grid = grid.withColumns({"y": F.floor(F.col("__at") / width), "x": F.col("__at") % width}).drop("__at")
    moved = pixels.withColumns({"x": F.col("x") + left, "y": F.col("y") + top})
    g, m = grid.alias("g"), moved.alias("m")
    on = [F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}")) for c in own] + [F.col(f"g.{c}") == F.col(f"m.{c}") for c in ("y", "x")]
    out = g.join(m, on, "left")
    return out.select(*[F.col(f"g.{c}") for c in (*own, "y", "x")], *[F.coalesce(F.col(f"m.{c}"), F.lit(v)).cast("long").alias(c) for c, v in background.items()])


def padded_layout(grey: Column, alpha: Column, red: Column, green: Column, blue: Column, back_alpha: Column) -> Column:
    """The channel layout after padding: grey only on grey, alpha if either has it."""
    plain = grey & (red == green) & (green == blue)
    clear = alpha | (back_alpha < 255)
    return F.when(plain & clear, "gray_alpha").when(plain, "gray").when(clear, "rgba").otherwise("rgb")


def background(given: Column, takes_alpha: Column) -> Column:
    """rrggbbaa of the padding: as given, or clear or white; opaque without alpha."""
    own = F.coalesce(given, F.when(takes_alpha, "00000000").otherwise("ffffffff"))
    return F.when(takes_alpha, own).otherwise(F.concat(F.substring(own, 1, 6), F.lit("ff")))
