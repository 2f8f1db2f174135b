"""HEIF headers composed from tables of boxes: properties, their associations, and item references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import orientation

#: Orientation numbers of quarter turns against the clock, and of mirrors by axis.
TURNS = {0: 1, 1: 8, 2: 3, 3: 6}
MIRRORS = {0: 2, 1: 4}


def associated(associations: DataFrame, properties: DataFrame, primary: DataFrame) -> DataFrame:
    """Properties of each image's primary item, with the position in which they apply.

    associations: (image, item, position, index: 1-based, 0 for none); properties: (image, place:
    1-based, ...); primary: (image, item). Indexes beyond the properties name nothing.
    """
    own = associations.join(primary, ["image", "item"], "left_semi").select("image", "position", F.col("index").alias("place"))
    return own.join(properties, ["image", "place"])


def transform(kind: Column, value: Column) -> Column:
    """The orientation that a property stands for: irot and imir; upright for all others."""
    out = F.lit(1)
    for v, n in TURNS.items():
        out = F.when((kind == "irot") & (value % 4 == v), n).otherwise(out)
    for v, n in MIRRORS.items():
        out = F.when((kind == "imir") & (value % 2 == v), n).otherwise(out)
    return out.cast("long")


def headers(own: DataFrame) -> DataFrame:
    """(image, width, height, orientation) from associated() rows with kind, width, height and value.

    The last ispe and the last clap count; an aperture never grows an image; turns and mirrors
    apply in order. Images without an ispe have no header. An image has few properties, so they
    are folded as one array.
    """
    last = lambda kind, c: F.max_by(c, F.when(F.col("kind") == kind, F.col("position")))
    moves = F.array_sort(F.collect_list(F.when(F.col("kind").isin("irot", "imir"), F.struct("position", transform(F.col("kind"), F.col("value")).alias("o")))))
    own = own.groupBy("image").agg(
        F.max(F.when(F.col("kind") == "ispe", F.col("position"))).alias("sized"), last("ispe", "width").alias("w"), last("ispe", "height").alias("h"),
        F.max(F.when(F.col("kind") == "clap", F.col("position"))).alias("cut"), last("clap", "width").alias("cw"), last("clap", "height").alias("ch"), moves.alias("moves"),
    )
    cut = F.col("cut").isNotNull()
    own = own.filter("sized IS NOT NULL").select(
        "image", F.when(cut, F.least("w", "cw")).otherwise(F.col("w")).alias("w"), F.when(cut, F.least("h", "ch")).otherwise(F.col("h")).alias("h"),
        F.aggregate("moves", F.lit(1).cast("long"), lambda a, m: orientation.then(a, m["o"])).alias("orientation"),
    )
    width, height = orientation.size(F.col("w"), F.col("h"), F.col("orientation"))
    return own.select("image", width.alias("width"), height.alias("height"), "orientation")


def describing(items: DataFrame, references: DataFrame, primary: DataFrame, kind: str) -> DataFrame:
    """(image, item): of each image the first item of a kind that describes its primary item.

    items: (image, item, kind, position); references: (image, from, to) of the kind that
    describes. An item that describes something else, or nothing, isn't the image's.
    """
    to = references.join(primary.withColumnRenamed("item", "to"), ["image", "to"], "left_semi").select("image", F.col("from").alias("item"))
    found = items.filter(F.col("kind") == kind).join(to, ["image", "item"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("image").orderBy("position"))
    return found.withColumn("__n", rank).filter("__n = 1").select("image", "item")
