"""Dimension tables: formats, aliases, encoders, decoders, options, presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Format, extension, media type, display name, aliases, in a stable order.
FORMATS = [
    ("jpeg", "jpg", "image/jpeg", "JPEG", "jpg jpeg jpe jfif"),
    ("png", "png", "image/png", "PNG", "png"),
    ("webp", "webp", "image/webp", "WebP", "webp"),
    ("avif", "avif", "image/avif", "AVIF", "avif"),
    ("jxl", "jxl", "image/jxl", "JPEG XL", "jxl"),
    ("gif", "gif", "image/gif", "GIF", "gif"),
    ("tiff", "tiff", "image/tiff", "TIFF", "tif tiff"),
    ("bmp", "bmp", "image/bmp", "BMP", "bmp dib"),
    ("tga", "tga", "image/x-tga", "TGA", "tga icb vda vst"),
    ("ico", "ico", "image/vnd.microsoft.icon", "ICO", "ico cur"),
    ("qoi", "qoi", "image/qoi", "QOI", "qoi"),
    ("pnm", "pnm", "image/x-portable-anymap", "PNM", "pnm pbm pgm ppm pam"),
    ("exr", "exr", "image/x-exr", "OpenEXR", "exr"),
    ("heic", "heic", "image/heic", "HEIC", "heic heif"),
    ("svg", "svg", "image/svg+xml", "SVG", "svg"),
]
#: Format, backend, tier, order of registration, lossy, lossless, alpha.
ENCODERS = [
    ("jpeg", "mozjpeg", "portable", 1, True, False, False),
    ("png", "oxipng", "portable", 2, False, True, True),
    ("webp", "image-webp", "portable", 3, False, True, True),
    ("avif", "ravif", "portable", 4, True, False, True),
    ("webp", "libwebp", "native", 5, True, True, True),
    ("jxl", "libjxl", "native", 6, True, True, True),
    ("avif", "libavif", "native", 7, True, False, True),
    ("jpeg", "jpegli", "native", 8, True, False, False),
]
#: Option keys of a backend and their defaults.
OPTIONS = [
    ("mozjpeg", "progressive", "true"), ("mozjpeg", "optimize_scans", "true"), ("mozjpeg", "smoothing", "0"),
    ("oxipng", "interlace", "false"), ("oxipng", "optimize_alpha", "false"), ("oxipng", "colors", "off"), ("oxipng", "dither", "100"),
    ("image-webp", "predictor", "true"), ("ravif", "alpha_quality", ""), ("ravif", "bit_depth", "auto"), ("ravif", "color_model", "ycbcr"),
    ("libwebp", "alpha_quality", "100"), ("libwebp", "sharp_yuv", "false"), ("libjxl", "container", "false"), ("libavif", "alpha_quality", ""),
]
#: Name, target score (null: lossless), effort, longest side.
PRESETS = [("web", 70.0, 6, None), ("thumbnail", 60.0, 6, 512), ("archive", 85.0, 8, None), ("lossless", None, 8, None)]


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, f, e, m, d) for n, (f, e, m, d, _) in enumerate(FORMATS)], "position int, format string, extension string, mime string, display string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, f[0]) for f in FORMATS for a in f[4].split()], "alias string, format string")


def encoders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENCODERS, "format string, backend string, tier string, registered int, lossy boolean, lossless boolean, alpha boolean")


def options(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OPTIONS, "backend string, key string, standard string")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, target double, effort int, side int")


def values(rows: list[tuple], columns: str) -> str:
    """A table as SQL that both Spark and other engines read: (VALUES ...) AS t(columns)."""
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({columns})"
