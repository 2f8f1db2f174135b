"""Transfer curves, depth and alpha conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(c: Column) -> Column:
    """Clipped to 0..1; NaN is black."""
    return F.when(F.isnan(c), F.lit(0.0)).otherwise(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))


def linear_to_srgb(linear: Column) -> Column:
    u = _unit(linear)
    return F.when(u <= 0.0031308, 12.92 * u).otherwise(1.055 * F.pow(u, F.lit(1.0 / 2.4)) - 0.055)


def srgb_to_linear(encoded: Column) -> Column:
    u = _unit(encoded)
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def unit_to_u16(unit: Column) -> Column:
    return F.round(_unit(unit) * 65535.0).cast("long")


def u16_to_u8(sample: Column) -> Column:
    return F.floor((sample + 128) / F.lit(257)).cast("long")


def u8_to_u16(sample: Column) -> Column:
    return (sample * 257).cast("long")


def widened(sample: Column, bits: int) -> Column:
    """A 10- or 12-bit sample as 16 bits, its top bits repeated below."""
    return (F.shiftleft(sample, 16 - bits).bitwiseOR(F.shiftright(sample, 2 * bits - 16))).cast("long")


def unpremultiplied(colour: Column, alpha: Column, most: int) -> Column:
    """Colour without its alpha, rounded; 0 where alpha is 0, unchanged where it is full."""
    divided = F.least(F.floor((colour * most + F.floor(alpha / F.lit(2))) / alpha), F.lit(most)).cast("long")
    return F.when(alpha == 0, F.lit(0).cast("long")).when(alpha >= most, colour.cast("long")).otherwise(divided)


def to_srgb16(linear: Column, alpha: bool = False) -> Column:
    """A float sample as 16 bits: colour through the sRGB curve, alpha only scaled."""
    return unit_to_u16(linear if alpha else linear_to_srgb(linear))


def without_alpha(samples: Column, channels: int) -> Column:
    """An interleaved array without the last of its channels."""
    return F.filter(samples, lambda _, i: i % channels != channels - 1)


def grey_to_rgb(samples: Column) -> Column:
    return F.flatten(F.transform(samples, lambda v: F.array(v, v, v)))


def opaque(samples: Column, most: int) -> Column:
    """Whether every fourth sample of RGBA is full."""
    return F.forall(F.filter(samples, lambda _, i: i % 4 == 3), lambda a: a == most)
