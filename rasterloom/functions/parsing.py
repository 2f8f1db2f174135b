"""Values that requests spell as strings, and numbers spelled for people. Bad values are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def boolean(s: Column) -> Column:
    return F.when(s.isin("true", "1", "yes", "on"), F.lit(True)).when(s.isin("false", "0", "no", "off"), F.lit(False))


def whole(s: Column, least: int, most: int) -> Column:
    """A whole number within bounds."""
    n = F.when(s.rlike(r"^\+?\d{1,18}$"), s.cast("long"))
    return F.when(n.between(least, most), n)


def number(s: Column) -> Column:
    return F.when(s.rlike(_NUMBER), s.cast("double"))


def score(s: Column) -> Column:
    n = number(s)
    return F.when(n <= 100, n)


def quality(s: Column) -> Column:
    n = number(s)
    return F.when(n.between(0, 100), n)


def percentage(s: Column) -> Column:
    """50% as 0.5."""
    n = F.when(s.endswith("%"), number(F.trim(F.regexp_replace(s, "%$", ""))))
    return F.when(n > 0, n / 100)


def palette(s: Column) -> Column:
    """0 for off, -1 for auto, else 2 to 256."""
    return F.when(s == "off", F.lit(0).cast("long")).when(s == "auto", F.lit(-1).cast("long")).otherwise(whole(s, 2, 256))


def pixels(s: Column) -> Column:
    """A pixel count with an optional k, M or G."""
    digits = F.regexp_extract(s, r"^(\d{1,18})[kKmMgG]*$", 1)
    last = F.lower(F.right(s, F.lit(1)))
    factor = F.when(last == "k", 1e3).when(last == "m", 1e6).when(last == "g", 1e9).otherwise(1.0).cast("decimal(20,0)")
    n = F.when(digits != "", digits.cast("decimal(18,0)") * factor)
    return F.when((n > 0) & (n <= 2**63 - 1), n.cast("long"))


def colour(s: Column) -> Column:
    """#rgb, #rrggbb, #rrggbbaa or a name as rrggbbaa in lower case."""
    low = F.lower(s)
    hex_ = F.regexp_replace(low, "^#", "")
    doubled = F.concat(*[F.repeat(F.substring(hex_, i, 1), 2) for i in (1, 2, 3)], F.lit("ff"))
    return (
        F.when(low == "white", "ffffffff").when(low == "black", "000000ff").when(low == "transparent", "00000000")
        .when(hex_.rlike("^[0-9a-f]{3}$"), doubled).when(hex_.rlike("^[0-9a-f]{6}$"), F.concat(hex_, F.lit("ff"))).when(hex_.rlike("^[0-9a-f]{8}$"), hex_)
    )


def byte_size(n: Column) -> Column:
    """673 B, 45.6 KB, 1.2 MB, 1.20 GB; rounded by the double's exact value, halves to even."""
    # format_string rounds the shortest decimal that names the double, and its halves up
    shown = lambda x, pattern, unit: F.concat(F.call_function("format_number", x, F.lit(pattern)), F.lit(unit))
    d = n.cast("double")
    return (
        F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1_000_000, shown(d / 1e3, "0.0", " KB"))
        .when(n < 1_000_000_000, shown(d / 1e6, "0.0", " MB"))
        .otherwise(shown(d / 1e9, "0.00", " GB"))
    )


def change(before: Column, after: Column) -> Column:
    """-63% or +12%, halves to even; n/a from nothing."""
    percent = (after - before).cast("double") / before.cast("double") * 100
    even = F.bround(percent)
    return F.when(before == 0, "n/a").when((even == 0) & (percent < 0), "-0%").otherwise(F.format_string("%+.0f%%", even))
