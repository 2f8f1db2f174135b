"""Calibrated seeds: curves of a setting over targets, looked up with interpolation, and fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the first step.
LEAST_STEP, MOST_STEP = 2.0, 20.0


def segments(points: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces [target, next target) of each curve; the last has no end."""
    after = Window.partitionBy(*keys).orderBy("target")
    names = ["target", "quality", "low", "high"]
    out = points.withColumns({f"next_{c}": F.lead(c).over(after) for c in names})
    return out.withColumn("first", F.row_number().over(after) == 1)


def lookup(targets: DataFrame, points: DataFrame, keys: list[str], *, target: str = "target") -> DataFrame:
    """targets with quality and step: curves are straight between points and flat beyond the ends.

    A target that is null, NaN or infinite gets the first point. Rows whose keys have no curve
    get nulls. Curves have few points, so keys are joined first, and each row then keeps its piece.
    """
    t = targets.withColumn("__t", F.struct(F.col(target).cast("double").alias("v")))
    value = F.col("__t.v")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    curve = segments(points, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("target", "quality", "low", "high", "next_target", "next_quality", "next_low", "next_high", "first"))).alias("__curve"))
    piece = F.get(F.filter("__curve", lambda s: F.when(finite, (s["first"] | (s["target"] <= value)) & (s["next_target"].isNull() | (value < s["next_target"]))).otherwise(s["first"])), F.lit(0))
    out = t.join(curve, keys, "left").withColumn("__s", piece)
    s = F.col("__s")
    share = F.when(~finite | s["next_target"].isNull() | (value <= s["target"]), F.lit(0.0)).otherwise((value - s["target"]) / (s["next_target"] - s["target"]))
    at = lambda c: s[c] + F.coalesce(s[f"next_{c}"] - s[c], F.lit(0.0)) * share
    step = F.least(F.greatest((at("high") - at("low")) / 2, F.lit(LEAST_STEP)), F.lit(MOST_STEP))
    return out.withColumns({"quality": at("quality"), "step": F.when(s.isNotNull(), step)}).drop("__t", "__curve", "__s")


def crossings(curves: DataFrame, targets: list[float], keys: list[str]) -> DataFrame:
    """(keys, target, crossing): where each curve (quality, score) first reaches each target.

    Straight between neighbours; the first point counts as it is; a piece that doesn't rise
    crosses at its right end; no crossing is null.
    """
    before = Window.partitionBy(*keys).orderBy("quality")
    pairs = curves.withColumns({"q0": F.lag("quality").over(before), "s0": F.lag("score").over(before)})
    grid = F.explode(F.array(*[F.lit(float(t)) for t in sorted(set(targets))])).alias("target")
    met = pairs.select("*", grid).filter(~F.isnan("score") & (F.col("score") >= F.col("target")))
    at = F.when(F.col("q0").isNull() | (F.col("score") <= F.col("s0")), F.col("quality")).otherwise(F.col("q0") + (F.col("target") - F.col("s0")) / (F.col("score") - F.col("s0")) * (F.col("quality") - F.col("q0")))
    first = met.groupBy(*keys, "target").agg(F.min_by(at, "quality").alias("crossing"))
    every = curves.select(*keys).distinct().select(*keys, grid)
    return every.join(first, [*keys, "target"], "left")


def fit(crossed: DataFrame, keys: list[str], top: float) -> DataFrame:
    """(keys, target, quality, low, high, hits, unreachable): median and quartiles of crossings, or top."""
    some = lambda c: F.coalesce(c, F.lit(top))
    quartiles = F.percentile("crossing", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = crossed.groupBy(*keys, "target").agg(quartiles.alias("p"), F.count("crossing").alias("hits"), F.count("*").alias("n"))
    return out.select(*keys, "target", some(F.col("p")[1]).alias("quality"), some(F.col("p")[0]).alias("low"), some(F.col("p")[2]).alias("high"), "hits", (F.col("n") - F.col("hits")).alias("unreachable"))


def merged(fitted: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    """Fitted curves, and committed ones of keys that weren't fitted."""
    return committed.join(fitted.select(*keys).distinct(), keys, "left_anti").unionByName(fitted)


def interpolation_step(low: Column, high: Column) -> Column:
    return F.least(F.greatest((high - low) / 2, F.lit(LEAST_STEP)), F.lit(MOST_STEP))
