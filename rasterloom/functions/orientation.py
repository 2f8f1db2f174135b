"""The eight orientations as a group of a swap and two flips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (swap, flip x, flip y) by EXIF number 1 to 8.
PARTS = {1: (0, 0, 0), 2: (0, 1, 0), 3: (0, 1, 1), 4: (0, 0, 1), 5: (1, 0, 0), 6: (1, 1, 0), 7: (1, 1, 1), 8: (1, 0, 1)}


def parts(orientation: Column) -> tuple[Column, Column, Column]:
    """Swap, flip x and flip y as booleans; numbers outside 1..8 are upright."""
    has = lambda at: orientation.isin([k for k, v in PARTS.items() if v[at]])
    return has(0), has(1), has(2)


def number(swap: Column, flip_x: Column, flip_y: Column) -> Column:
    out = F.lit(1)
    for k, (s, x, y) in PARTS.items():
        out = F.when((swap == bool(s)) & (flip_x == bool(x)) & (flip_y == bool(y)), F.lit(k)).otherwise(out)
    return out.cast("long")


def then(first: Column, second: Column) -> Column:
    """The orientation of applying first and then second."""
    s1, x1, y1 = parts(first)
    s2, x2, y2 = parts(second)
    moved_x, moved_y = F.when(s2, y1).otherwise(x1), F.when(s2, x1).otherwise(y1)
    return number(s1 != s2, moved_x != x2, moved_y != y2)


def size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    swap, _, _ = parts(orientation)
    return F.when(swap, height).otherwise(width), F.when(swap, width).otherwise(height)


def place(x: Column, y: Column, width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Where a pixel goes when an image of width x height is put upright."""
    swap, flip_x, flip_y = parts(orientation)
    w, h = size(width, height, orientation)
    u, v = F.when(swap, y).otherwise(x), F.when(swap, x).otherwise(y)
    return F.when(flip_x, w - 1 - u).otherwise(u), F.when(flip_y, h - 1 - v).otherwise(v)
