"""What a file is, from its bytes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(content: Column, first: int, n: int) -> Column:
    """n bytes from the 0-based first on, in upper-case hex; shorter at the end."""
    return F.hex(F.substring(content, first + 1, n))


def number(content: Column, first: int, n: int, little: bool = False) -> Column:
    """An unsigned whole number of n bytes, or null beyond the end."""
    digits = _hex(content, first, n)
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(n, 0, -1)])
    return F.when(F.length(content) >= first + n, F.conv(digits, 16, 10).cast("long"))


def _starts(content: Column, *signatures: str) -> Column:
    found = F.lit(False)
    for s in signatures:
        found = found | (_hex(content, 0, len(s) // 2) == s)
    return found


def _brand(content: Column, brands: list[str], major: bool = False) -> Column:
    """Whether an ftyp box names one of the brands."""
    size = F.least(number(content, 0, 4), F.length(content).cast("long"))
    is_ftyp = _hex(content, 4, 4) == "66747970"
    wanted = [b.encode().hex().upper() for b in brands]
    first = _hex(content, 8, 4).isin(wanted)
    if major:
        return is_ftyp & first
    rest = F.hex(F.substr(content, F.lit(17), F.greatest(size - 16, F.lit(0)).cast("int")))
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length(rest) / F.lit(8)).cast("int") - 1, F.lit(0))), lambda i: F.substr(rest, i * 8 + 1, F.lit(8)))
    return is_ftyp & (first | F.exists(every, lambda b: b.isin(wanted)))


def is_svg(text: Column) -> Column:
    """Whether the first element of a text is svg, after a mark, declarations, comments and a doctype."""
    return F.substring(text, 1, 4096).rlike(r"(?s)^\x{FEFF}?[ \t\n\f\r]*((<\?.*?\?>|<!--.*?-->|<!(?!--).*?>)[ \t\n\f\r]*)*<svg[ \t\n\f\r>/]")


def is_tga(content: Column) -> Column:
    """A signature at the end, or a header whose fields agree and data as long as they say."""
    at = lambda i: number(content, i, 1)
    kind, mapped, bits = at(2), at(1), at(16)
    n_map, map_bits, w, h = number(content, 5, 2, True), at(7), number(content, 12, 2, True), number(content, 14, 2, True)
    signature = F.hex(F.substring(content, -18, 18)) == b"TRUEVISION-XFILE.\0".hex().upper()
    bits_ok = F.when(kind.isin(1, 9, 3, 11), bits.isin(8, 16)).otherwise(bits.isin(15, 16, 24, 32))
    palette = kind.isin(1, 9)
    map_ok = F.when(mapped == 1, (n_map > 0) & map_bits.isin(15, 16, 24, 32)).otherwise(n_map == 0)
    sane = kind.isin(1, 2, 3, 9, 10, 11) & bits_ok & (w > 0) & (h > 0) & (at(17) < 64) & (at(17) % 16 <= 8) & (mapped <= 1) & (palette == (mapped == 1)) & map_ok
    whole = lambda b: F.floor((b + 7) / F.lit(8))
    need = 18 + at(0) + F.when(mapped == 1, n_map * whole(map_bits)).otherwise(0) + w * h * whole(bits)
    return (F.length(content) >= 18) & F.coalesce(signature | (sane & (kind.isin(9, 10, 11) | (F.length(content) >= need))), F.lit(False))


def identify(content: Column) -> Column:
    """The format of a file's bytes, or null. TGA, which has no mark of its own, comes last."""
    n = F.length(content)
    text = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    text = F.regexp_replace(text, "^ï»¿", "")
    return (
        F.when(_starts(content, "FFD8FF"), "jpeg")
        .when(_starts(content, "89504E470D0A1A0A"), "png")
        .when(_starts(content, "52494646") & (_hex(content, 8, 4) == "57454250"), "webp")
        .when(_brand(content, ["avif", "avis"]), "avif")
        .when(_starts(content, "FF0A", "0000000C4A584C200D0A870A"), "jxl")
        .when(_starts(content, "474946383761", "474946383961") & (n >= 13), "gif")
        .when(_starts(content, "49492A00", "4D4D002A", "49492B00", "4D4D002B"), "tiff")
        .when(_starts(content, "424D") & (n >= 26), "bmp")
        .when(_starts(content, "00000100", "00000200") & (number(content, 4, 2, True) > 0), "ico")
        .when(_starts(content, "716F6966") & (n >= 14), "qoi")
        .when(_hex(content, 0, 1).eqNullSafe("50") & _hex(content, 1, 1).between("31", "37") & _hex(content, 2, 1).isin("20", "09", "0A", "0B", "0C", "0D", "23"), "pnm")
        .when(_starts(content, "762F3101"), "exr")
        .when(_brand(content, ["heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs"]), "heic")
        .when(is_svg(text), "svg")
        .when(is_tga(content), "tga")
    )


def dimensions(content: Column, fmt: Column) -> Column:
    """struct<width, height: long> from the header of formats that keep it at a fixed place, else null."""
    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    side = lambda i: F.when(number(content, i, 1) == 0, F.lit(256).cast("long")).otherwise(number(content, i, 1))
    tall = number(content, 22, 4, True)
    pixels = (
        F.when(fmt == "png", pair(number(content, 16, 4), number(content, 20, 4)))
        .when(fmt == "gif", pair(number(content, 6, 2, True), number(content, 8, 2, True)))
        .when(fmt == "bmp", pair(number(content, 18, 4, True), F.when(tall >= 2**31, 2**32 - tall).otherwise(tall)))
        .when(fmt == "qoi", pair(number(content, 4, 4), number(content, 8, 4)))
        .when(fmt == "tga", pair(number(content, 12, 2, True), number(content, 14, 2, True)))
        .when(fmt == "ico", pair(side(6), side(7)))
    )
    return F.when(pixels["width"].isNotNull() & pixels["height"].isNotNull(), pixels)


def too_large(width: Column, height: Column, limit: int) -> Column:
    return width.cast("decimal(19,0)") * height.cast("decimal(19,0)") > limit
