"""Resize geometry as column expressions: what to crop, resample and pad.

Sides are whole pixels up to 2**32 - 1. Products of two sides don't fit a long, so cross products
are decimals; results saturate at 2**32 - 1, which pixel limits then refuse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 2**32 - 1
#: Shares of the free space that lie left of and above an image, by position.
ANCHORS = {
    "center": (0.5, 0.5), "top": (0.5, 0.0), "bottom": (0.5, 1.0), "left": (0.0, 0.5), "right": (1.0, 0.5),
    "top-left": (0.0, 0.0), "top-right": (1.0, 0.0), "bottom-left": (0.0, 1.0), "bottom-right": (1.0, 1.0),
}
FITS = ("inside", "cover", "contain", "fill", "outside")


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _narrow(c: Column) -> Column:
    return F.least(c, F.lit(MOST)).cast("long")


def _side(c: Column) -> Column:
    return F.greatest(c.cast("long"), F.lit(1).cast("long"))


def scaled(n: Column, by: Column, of: Column) -> Column:
    """n * by / of, rounded half up, at least 1."""
    half = F.floor(of / F.lit(2)).cast("decimal(19,0)")
    top = (_wide(n) * _wide(by)).cast("decimal(38,0)") + half
    return _narrow(F.greatest(F.floor(top / _wide(of)), F.lit(1)))


def anchor(position: Column | str) -> tuple[Column, Column]:
    """Shares left of and above, by position; unknown positions are the centre."""
    if isinstance(position, str):
        x, y = ANCHORS.get(position, (0.5, 0.5))
        return F.lit(x), F.lit(y)
    x, y = F.lit(0.5), F.lit(0.5)
    for name, (ax, ay) in ANCHORS.items():
        x, y = F.when(position == name, F.lit(ax)).otherwise(x), F.when(position == name, F.lit(ay)).otherwise(y)
    return x, y


def _tighter(w: Column, h: Column, bw: Column, bh: Column) -> Column:
    """Whether the width bound scales down at least as much as the height bound."""
    return _wide(bw) * _wide(h) <= _wide(bh) * _wide(w)


def inside(w: Column, h: Column, bw: Column, bh: Column, enlarge: Column) -> tuple[Column, Column]:
    """Size within the box in the image's proportions; a null bound doesn't bind."""
    by_width = F.when(bw.isNull(), F.lit(False)).when(bh.isNull(), F.lit(True)).otherwise(_tighter(w, h, bw, bh))
    keep = (bw.isNull() & bh.isNull()) | (~enlarge & F.when(by_width, bw >= w).otherwise(bh >= h))
    return F.when(keep, w).when(by_width, bw).otherwise(scaled(w, bh, h)), F.when(keep, h).when(by_width, scaled(h, bw, w)).otherwise(bh)


def outside(w: Column, h: Column, bw: Column, bh: Column, enlarge: Column) -> tuple[Column, Column]:
    """Size that covers the box in the image's proportions."""
    by_width = _wide(bw) * _wide(h) >= _wide(bh) * _wide(w)
    keep = ~enlarge & F.when(by_width, bw >= w).otherwise(bh >= h)
    return F.when(keep, w).when(by_width, bw).otherwise(scaled(w, bh, h)), F.when(keep, h).when(by_width, scaled(h, bw, w)).otherwise(bh)


def _chosen(cases: list[tuple[Column, Column]], other: Column) -> Column:
    """The value of the first case that holds."""
    out = other
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def fit(width: Column, height: Column, box_width: Column, box_height: Column, *, how: Column | str, position: Column | str, enlarge: Column) -> Column:
    """Geometry of a resize, or null where the image is left as it is or has no size.

    struct<crop: struct<left, top, width, height: double>, width, height: long, canvas:
    struct<width, height, x, y: long>>; crop and canvas are null where they do nothing. Fits
    other than inside that lack a bound are read as inside. A fit or position that is the same for all
    rows may be a string, which keeps the expression small.
    """
    w, h = _side(width), _side(height)
    bw, bh = F.when(box_width.isNotNull(), _side(box_width)), F.when(box_height.isNotNull(), _side(box_height))
    both = bw.isNotNull() & bh.isNotNull()
    is_ = {how: both} if isinstance(how, str) else {k: (how == k) & both for k in FITS}
    ax, ay = anchor(position)
    iw, ih = inside(w, h, bw, bh, enlarge)
    wd, hd = w.cast("double"), h.cast("double")
    sizes: list[tuple[Column, tuple[Column, Column]]] = []
    crop = F.lit(None).cast("struct<left:double,top:double,width:double,height:double>")
    canvas = F.lit(None).cast("struct<width:bigint,height:bigint,x:bigint,y:bigint>")
    if "cover" in is_:  # the largest part with the box's proportions
        wider = _wide(bw) * _wide(h) >= _wide(bh) * _wide(w)
        cw = F.when(wider, wd).otherwise(hd * bw.cast("double") / bh.cast("double"))
        ch = F.when(wider, wd * bh.cast("double") / bw.cast("double")).otherwise(hd)
        to_box = enlarge | (cw >= bw.cast("double"))
        rw = F.least(F.greatest(F.round(cw).cast("long"), F.lit(1)), w)
        rh = F.least(F.greatest(F.round(ch).cast("long"), F.lit(1)), h)
        kw, kh = F.when(to_box, cw).otherwise(rw.cast("double")), F.when(to_box, ch).otherwise(rh.cast("double"))
        part = F.struct(F.floor((wd - kw) * ax).cast("double").alias("left"), F.floor((hd - kh) * ay).cast("double").alias("top"), kw.alias("width"), kh.alias("height"))
        crop = F.when(is_["cover"] & ((kw < wd) | (kh < hd)), part)
        sizes.append((is_["cover"], (F.when(to_box, bw).otherwise(rw), F.when(to_box, bh).otherwise(rh))))
    if "fill" in is_:
        sizes.append((is_["fill"], (F.when(enlarge, bw).otherwise(F.least(bw, w)), F.when(enlarge, bh).otherwise(F.least(bh, h)))))
    if "outside" in is_:
        sizes.append((is_["outside"], outside(w, h, bw, bh, enlarge)))
    if "contain" in is_:
        free = lambda b, i, a: F.floor((b - i).cast("double") * a).cast("long")
        canvas = F.when(is_["contain"] & ((iw != bw) | (ih != bh)), F.struct(_narrow(bw).alias("width"), _narrow(bh).alias("height"), free(bw, iw, ax).alias("x"), free(bh, ih, ay).alias("y")))
    out_w, out_h = _chosen([(c, s[0]) for c, s in sizes], iw), _chosen([(c, s[1]) for c, s in sizes], ih)
    out = F.struct(crop.alias("crop"), _narrow(out_w).alias("width"), _narrow(out_h).alias("height"), canvas.alias("canvas"))
    some = width.isNotNull() & height.isNotNull()
    return F.when(some & (crop.isNotNull() | canvas.isNotNull() | (out_w != width) | (out_h != height)), out)


def scale(width: Column, height: Column, factor: Column, enlarge: Column) -> Column:
    """Geometry of a resize by a factor, or null where nothing changes or the factor is no positive number."""
    good = factor.isNotNull() & ~F.isnan(factor) & (factor > 0) & (factor < F.lit(float("inf")))
    f = F.when(enlarge, factor).otherwise(F.least(factor, F.lit(1.0)))
    side = lambda n: F.least(F.greatest(F.round(_side(n).cast("double") * f), F.lit(1.0)), F.lit(float(MOST))).cast("long")
    w, h = side(width), side(height)
    none = F.lit(None)
    crop, canvas = none.cast("struct<left:double,top:double,width:double,height:double>"), none.cast("struct<width:bigint,height:bigint,x:bigint,y:bigint>")
    out = F.struct(crop.alias("crop"), w.alias("width"), h.alias("height"), canvas.alias("canvas"))
    return F.when(good & ((w != _side(width)) | (h != _side(height))), out)


def output_size(width: Column, height: Column, geometry: Column) -> tuple[Column, Column]:
    """What an encoder gets: the canvas, or the resampled size, or the image's own."""
    return F.coalesce(geometry["canvas"]["width"], geometry["width"], width), F.coalesce(geometry["canvas"]["height"], geometry["height"], height)


def resamples(width: Column, height: Column, geometry: Column) -> Column:
    """Whether samples are computed anew, not only padded."""
    changed = geometry["crop"].isNotNull() | (geometry["width"] != width) | (geometry["height"] != height)
    return F.coalesce(geometry.isNotNull() & changed, F.lit(False))


def problem(box_width: Column, box_height: Column, factor: Column, how: Column) -> Column:
    """Why a resize request is refused, or null."""
    bad = factor.isNotNull() & (F.isnan(factor) | (factor <= 0) | (factor == F.lit(float("inf"))))
    one = box_width.isNull() | box_height.isNull()
    return (
        F.when(bad, "factor must be a positive number")
        .when(factor.isNull() & ((box_width == 0) | (box_height == 0)), "a bound must be at least one pixel")
        .when(factor.isNull() & (how != "inside") & one, F.concat(F.lit("fit "), how, F.lit(" needs both sides")))
    )
