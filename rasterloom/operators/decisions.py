"""Decisions that need no pixels: a script's options, metadata, colour signalling, admission, run plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import geometry

#: The keys that a script's options object may have.
SCRIPT_KEYS = (
    "format", "target", "quality", "lossless", "preset", "effort", "subsampling", "keepIcc", "keepMetadata", "fast", "width", "height", "fit", "position", "background", "scale", "enlarge",
    "filter", "maxPixels", "codecOpts", "onTrial",
)
#: Fixed values (ITU-T H.273): code points with known primaries, with an SDR curve, and curves that sRGB stands for on BT.709 primaries.
KNOWN_PRIMARIES = (1, 4, 5, 6, 7, 8, 9, 11, 12, 22)
SDR_CURVES = (1, 4, 5, 6, 7, 8, 13, 14, 15)
SRGB_CURVES = (1, 6, 13, 14, 15)
UNSPECIFIED, BT709, SRGB = 2, 1, 13
#: X and y of red, green, blue and white of Rec. 709.
REC709 = ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), (0.3127, 0.3290))


def unknown_keys(options: Column) -> Column:
    """The keys of an options object (map of strings) that no option has."""
    return F.array_except(F.map_keys(options), F.array(*map(F.lit, SCRIPT_KEYS)))


def script_problem(options: Column, preset_fit: Column) -> Column:
    """Why a script's options (map of spelled values; missing keys are defaults) are refused, or null.

    preset_fit: the fit that the preset brings, which the options may override.
    """
    has = lambda k: F.map_contains_key(options, F.lit(k))
    text = lambda k: F.try_element_at(options, F.lit(k))
    number = lambda k: text(k).try_cast("double")
    on = lambda k: F.coalesce(text(k) == "true", F.lit(False))
    unknown = unknown_keys(options)
    targets = has("target").cast("int") + has("quality").cast("int") + on("lossless").cast("int")
    target, quality = number("target"), number("quality")
    infinite = F.isnan(target) | (F.abs(target) == F.lit(float("inf")))
    fit = F.coalesce(text("fit"), preset_fit)
    return (
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown option "), F.get(unknown, F.lit(0))))
        .when(targets > 1, "alternatives")
        .when(on("fast") & (has("quality") | on("lossless")), "fast needs a target")
        .when(infinite | (target > 100), "target is a number up to 100")
        .when(~quality.between(0, 100) | F.isnan(quality), "quality is 0 to 100")
        .when(number("effort") > 10, "effort is 0 to 10")
        .when(has("scale") & (has("width") | has("height") | has("fit")), "scale excludes width, height and fit")
        .when(has("position") & ~fit.isin("cover", "contain"), "position needs cover or contain")
        .when(has("background") & (fit != "contain"), "background needs contain")
        .otherwise(geometry.problem(number("width"), number("height"), number("scale"), fit))
    )


def stripped(exif: Column, xmp: Column, keep: Column) -> tuple[Column, Column]:
    """EXIF and XMP after the metadata policy: both go unless they are kept; a profile isn't its business."""
    return F.when(keep, exif), F.when(keep, xmp)


def carry_problem(exif: Column, xmp: Column, can_exif: Column, can_xmp: Column) -> Column:
    """The first kind of metadata that an image carries and its encoder can't embed, or null."""
    return F.when(exif.isNotNull() & ~can_exif, "EXIF").when(xmp.isNotNull() & ~can_xmp, "XMP")


def reported_target(kind: Column, target: Column, searched: Column, lossless: Column) -> Column:
    """The target score that a record names: one that was searched for or that lossless output meets."""
    return F.when((kind == "score") & (searched | lossless), target)


def signalled_colour(primaries: Column, transfer: Column) -> Column:
    """What code points ask for: srgb, profile, or none where no profile can tell them."""
    p = F.when(primaries == UNSPECIFIED, BT709).otherwise(primaries)
    t = F.when(transfer == UNSPECIFIED, SRGB).otherwise(transfer)
    told = p.isin(*KNOWN_PRIMARIES) & t.isin(*SDR_CURVES)
    return F.when(~told, "none").when((p == BT709) & t.isin(*SRGB_CURVES), "srgb").otherwise("profile")


def primaries_kind(red: tuple[Column, Column], green: tuple[Column, Column], blue: tuple[Column, Column], white: tuple[Column, Column]) -> Column:
    """What chromaticities (x, y) ask for: malformed, rec709, degenerate or profile.

    Degenerate ones give colorants whose matrix, scaled to the white point, can't be inverted.
    """
    points = (red, green, blue, white)
    bad = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    malformed, same = F.lit(False), F.lit(True)
    for (x, y), (rx, ry) in zip(points, REC709, strict=True):
        malformed = malformed | bad(x) | bad(y) | (y <= 0)
        same = same & (F.abs(x - rx) < 1e-4) & (F.abs(y - ry) < 1e-4)
    r, g, b, w = [(F.try_divide(x, y), F.lit(1.0), F.try_divide(1 - x - y, y)) for x, y in points]

    def det(a: tuple, b: tuple, c: tuple) -> Column:
        return a[0] * (b[1] * c[2] - c[1] * b[2]) - b[0] * (a[1] * c[2] - c[1] * a[2]) + c[0] * (a[1] * b[2] - b[1] * a[2])

    # each primary's share of white is a quotient of determinants (Cramer); their product scales the matrix
    flat = F.abs(det(r, g, b)) < 1e-9  # three points on a line
    scaled = F.try_divide(det(w, g, b) * det(r, w, b) * det(r, g, w), det(r, g, b) * det(r, g, b))
    return F.when(malformed, "malformed").when(same, "rec709").when(F.coalesce(flat | (F.abs(scaled) < 1e-6), F.lit(True)), "degenerate").otherwise("profile")


def png_effort(effort: Column) -> tuple[Column, Column]:
    """A PNG encoder's preset, and whether it deflates exhaustively, by effort."""
    preset = F.when(effort < 2, effort).when(effort < 8, F.floor(effort / 2) + 1).when(effort == 8, 5).otherwise(6)
    return preset.cast("int"), effort >= 10


def admitted(files: DataFrame, pool: list[str], order: list[str], cost: Column, limit: Column) -> DataFrame:
    """files with reserved, the running sum of costs of its pool by arrival, and at_once: whether that is within the limit.

    The first of a pool is taken however large it is. Pools are budgets of their own, so the sum
    needs one task for a pool, not for all files.
    """
    by = Window.partitionBy(*pool).orderBy(*order)
    now = files.withColumn("reserved", F.sum(cost).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return now.withColumn("at_once", (F.col("reserved") <= limit) | (F.row_number().over(by) == 1))


def truncated(rows: DataFrame, dataset: list[str], order: list[str], limit: int) -> DataFrame:
    """The first rows of each dataset, all if limit is 0."""
    if not limit:
        return rows
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*dataset).orderBy(*order))).filter(F.col("__n") <= limit).drop("__n")


def left_out(feature: Column, native: Column, system: Column, arch: Column, libc: Column) -> Column:
    """Whether a native build for a machine leaves a feature out that others have."""
    static = libc == "musl"
    no_jpegli = (system == "windows") | static | ((arch == "aarch64") & (system == "linux"))
    return native & (((feature == "native-jxl") & static) | ((feature == "native-jpegli") & no_jpegli) | ((feature == "native-heif") & static))


def split_features(features: Column, native: Column, system: Column, arch: Column, libc: Column) -> tuple[Column, Column]:
    """Features that a user can still enable, and those that the target leaves out."""
    out = lambda f: left_out(f, native, system, arch, libc)
    return F.filter(features, lambda f: ~out(f)), F.filter(features, out)


def dry_run(request: Column, carry: Column, destination: Column, exists: Column, force: Column, in_place: Column) -> tuple[Column, Column]:
    """(status, reason) of a file that is planned and not encoded: the first refusal tells."""
    reason = F.coalesce(request, F.concat(F.lit("can't carry "), carry), destination, F.when(exists & ~force & ~in_place, "output exists"))
    return F.when(reason.isNull(), "planned").otherwise("failed"), reason
