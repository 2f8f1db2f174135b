"""Decisions before any encoding: format, mode, refusals, presets, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Estimated bytes a pixel, of a decode and on top of it by work.
DECODE_BYTES, WORK_BYTES = 8, {"plan": 0, "encode": 24, "search": 152}
MOST = 2**63 - 1


def default_format(lossless: Column, graphic: Column, alpha: Column, perceptual: Column, webp: Column, avif: Column, avif_decoder: Column) -> Column:
    """The format of an output whose request names none."""
    photo = F.when(avif & (~perceptual | avif_decoder), "avif").when(alpha, "png").otherwise("jpeg")
    return F.when(lossless, "png").when(graphic & webp, "webp").when(graphic, "png").otherwise(photo)


def encode_mode(kind: Column, lossy: Column, named: Column, palette: Column, fast: Column, seeded: Column, inexact: Column, lossy_builds: Column) -> Column:
    """What an encode does, or refused:<why>.

    kind: score, quality or lossless; named: the request names the format; palette: the options ask
    for a palette search; inexact: options give samples up; lossy_builds: builds that write this
    format lossy.
    """
    quality, score, lossless = kind == "quality", kind == "score", kind == "lossless"
    return (
        F.when(quality & ~lossy & named & (lossy_builds == 0), "refused:unsupported")
        .when(quality & ~lossy & named, "refused:unavailable")
        .when(lossless & inexact, "refused:lossless contradicts options")
        .when(palette & ~(score & ~fast), "refused:palette search needs a target")
        .when(palette, "palette search")
        .when(~lossless & ~lossy, "lossless only")
        .when(score & fast & ~seeded, "refused:no seed")
        .when(score & fast, "seed")
        .when(score, "search")
        .otherwise("explicit")
    )


def request(kind: Column, fmt_lossy: Column, fmt_lossless: Column, decoder: Column, alpha: Column, translucent: Column, encoder: Column) -> Column:
    """Why a requested format can't serve, or null."""
    return (
        F.when(~encoder, "no encoder")
        .when(translucent & ~alpha, "no alpha for a translucent background")
        .when((kind == "quality") & ~fmt_lossy, "no lossy mode")
        .when((kind == "lossless") & ~fmt_lossless, "no lossless mode")
        .when((kind == "score") & fmt_lossy & ~decoder, "no decoder to score with")
    )


def lossy_options(options: Column, exact_alone: Column, exact: Column) -> Column:
    """The options to blame: those that aren't exact alone, or all if they are only so together.

    options and exact_alone: maps by the same keys.
    """
    named = F.map_filter(options, lambda k, _: ~F.coalesce(F.try_element_at(exact_alone, k), F.lit(True)))
    shown = F.when(F.size(named) > 0, named).otherwise(options)
    entries = F.array_sort(F.transform(F.map_entries(shown), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(exact, F.array().cast("array<string>")).otherwise(entries)


def codec_options(options: Column, codec: str) -> Column:
    """The options of one codec, without its prefix."""
    prefix = f"{codec}:"
    own = F.map_filter(options, lambda k, _: k.startswith(prefix))
    return F.transform_keys(own, lambda k, _: F.substring(k, len(prefix) + 1, 1000))


def precedence(registered: DataFrame, key: list[str], order: str, *, last: bool) -> DataFrame:
    """Of the rows of each key the one registered last, or first."""
    by = F.col(order).desc() if last else F.col(order).asc()
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(by))
    return registered.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def _saturated(c: Column) -> Column:
    return F.least(c, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def memory_estimate(decoded: Column, output: Column, work: Column) -> Column:
    """Estimated peak bytes of an image; saturates."""
    per = F.lit(0)
    for name, n in WORK_BYTES.items():
        per = F.when(work == name, F.lit(n)).otherwise(per)
    wide = lambda c: c.cast("decimal(19,0)")
    return _saturated(_saturated(wide(decoded) * F.lit(DECODE_BYTES).cast("decimal(3,0)")).cast("decimal(38,0)") + _saturated(wide(output) * per.cast("decimal(3,0)")).cast("decimal(38,0)"))


def budget_limits(available: Column, max_pixels: Column, jobs: Column) -> tuple[Column, Column]:
    """Bytes and pixels that images in work may take together."""
    pixels = F.floor(_saturated(max_pixels.cast("decimal(19,0)") * jobs.cast("decimal(19,0)")) / F.lit(4)).cast("long")
    quarter = F.floor(available.cast("decimal(19,0)") / F.lit(4)).cast("long")
    return F.coalesce(quarter * 3, F.lit(MOST)), F.greatest(pixels, max_pixels)


def partitions(cost: DataFrame, *, bytes_column: str, limit: int) -> int:
    """How many partitions keep each within limit, from the sum of estimates: one row to the driver."""
    total = cost.agg(F.coalesce(F.sum(F.col(bytes_column).cast("decimal(38,0)")), F.lit(0))).first()[0]
    return max(1, -(-int(total) // limit))
