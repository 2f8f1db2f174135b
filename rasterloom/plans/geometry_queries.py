"""Geometry, srcset and budget queries over part sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.operators import planning
from rasterloom.plans.catalog import query

_SIZES = "SELECT p_partkey AS id, 1 + p_partkey % 4000 AS w, CAST(1 + p_size * 37 AS BIGINT) AS h FROM part"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("id"), (1 + F.col("p_partkey") % 4000).alias("w"), (1 + F.col("p_size") * 37).cast("long").alias("h"))


def _flat(df: DataFrame) -> DataFrame:
    g = F.col("g")
    return df.select(
        "id", g.isNotNull().alias("resized"), g["width"].alias("width"), g["height"].alias("height"), g["crop"]["left"].alias("crop_left"), g["crop"]["top"].alias("crop_top"),
        F.round(g["crop"]["width"], 6).alias("crop_width"), F.round(g["crop"]["height"], 6).alias("crop_height"), g["canvas"]["width"].alias("canvas_width"), g["canvas"]["height"].alias("canvas_height"),
        g["canvas"]["x"].alias("canvas_x"), g["canvas"]["y"].alias("canvas_y"),
    )


def _fit(how: str, bw: int | None, bh: int | None, position: str, enlarge: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        side = lambda v: F.lit(v).cast("long")
        g = G.fit(F.col("w"), F.col("h"), side(bw), side(bh), how=how, position=position, enlarge=F.lit(enlarge))
        return _flat(sizes(spark, sf_dir).withColumn("g", g))

    return run


_NULLS = {c: "CAST(NULL AS DOUBLE)" for c in ("crop_left", "crop_top", "crop_width", "crop_height")} | {c: "CAST(NULL AS BIGINT)" for c in ("canvas_width", "canvas_height", "canvas_x", "canvas_y")}


def _sql(inner: str, shown: dict[str, str] | None = None, keep: str = "(ow = w AND oh = h)") -> str:
    """inner gives id, w, h, ow, oh and whatever shown needs; null geometry where keep holds."""
    cols = _NULLS | (shown or {})
    rest = ", ".join(f"CASE WHEN {keep} THEN NULL ELSE {e} END AS {c}" for c, e in cols.items())
    return f"SELECT id, NOT {keep} AS resized, CASE WHEN {keep} THEN NULL ELSE ow END AS width, CASE WHEN {keep} THEN NULL ELSE oh END AS height, {rest} FROM ({inner}) q"


def _ratio(n: str, by: str, of: str) -> str:
    return f"greatest(({n} * {by} + {of} // 2) // {of}, 1)"


def _bounded(bw: int, bh: int, compare: str, enlarge: bool) -> str:
    by_w = f"{bw} * h {compare} {bh} * w"
    keep = "FALSE" if enlarge else f"CASE WHEN {by_w} THEN {bw} >= w ELSE {bh} >= h END"
    return f"SELECT *, CASE WHEN {keep} THEN w WHEN {by_w} THEN {bw} ELSE {_ratio('w', str(bh), 'h')} END AS ow, CASE WHEN {keep} THEN h WHEN {by_w} THEN {_ratio('h', str(bw), 'w')} ELSE {bh} END AS oh FROM ({_SIZES}) s"


def _contain(bw: int, bh: int, ax: float, ay: float, enlarge: bool) -> str:
    some = f"(ow <> {bw} OR oh <> {bh})"
    shown = {"canvas_width": f"CASE WHEN {some} THEN {bw} END", "canvas_height": f"CASE WHEN {some} THEN {bh} END", "canvas_x": f"CASE WHEN {some} THEN CAST(floor(({bw} - ow) * {ax}) AS BIGINT) END", "canvas_y": f"CASE WHEN {some} THEN CAST(floor(({bh} - oh) * {ay}) AS BIGINT) END"}
    return _sql(_bounded(bw, bh, "<=", enlarge), shown, f"(ow = w AND oh = h AND NOT {some})")


def _cover(bw: int, bh: int, ax: float, ay: float, enlarge: bool) -> str:
    wider = f"{bw} * h >= {bh} * w"
    a = f"SELECT *, CASE WHEN {wider} THEN CAST(w AS DOUBLE) ELSE CAST(h AS DOUBLE) * {bw} / {bh} END AS cw, CASE WHEN {wider} THEN CAST(w AS DOUBLE) * {bh} / {bw} ELSE CAST(h AS DOUBLE) END AS ch FROM ({_SIZES}) s"
    b = f"SELECT *, {'TRUE' if enlarge else f'cw >= {bw}'} AS full_box, least(greatest(CAST(round(cw) AS BIGINT), 1), w) AS rw, least(greatest(CAST(round(ch) AS BIGINT), 1), h) AS rh FROM ({a}) t"
    c = f"SELECT *, CASE WHEN full_box THEN {bw} ELSE rw END AS ow, CASE WHEN full_box THEN {bh} ELSE rh END AS oh, CASE WHEN full_box THEN cw ELSE CAST(rw AS DOUBLE) END AS kw, CASE WHEN full_box THEN ch ELSE CAST(rh AS DOUBLE) END AS kh FROM ({b}) u"
    some = "(kw < w OR kh < h)"
    shown = {"crop_left": f"CASE WHEN {some} THEN floor((w - kw) * {ax}) END", "crop_top": f"CASE WHEN {some} THEN floor((h - kh) * {ay}) END", "crop_width": f"CASE WHEN {some} THEN round(kw, 6) END", "crop_height": f"CASE WHEN {some} THEN round(kh, 6) END"}
    return _sql(c, shown, f"(ow = w AND oh = h AND NOT {some})")


query("geometry_inside", _sql(_bounded(1600, 900, "<=", False)))(_fit("inside", 1600, 900, "center", False))
query("geometry_inside_enlarge", _sql(_bounded(1600, 900, "<=", True)))(_fit("inside", 1600, 900, "center", True))
query("geometry_outside", _sql(_bounded(1000, 700, ">=", False)))(_fit("outside", 1000, 700, "center", False))
query("geometry_contain", _contain(800, 600, 0.5, 0.5, False))(_fit("contain", 800, 600, "center", False))
query("geometry_contain_corner", _contain(800, 600, 1.0, 0.0, True))(_fit("contain", 800, 600, "top-right", True))
query("geometry_cover", _cover(1000, 500, 0.5, 0.5, False))(_fit("cover", 1000, 500, "center", False))
query("geometry_cover_enlarge", _cover(400, 900, 0.0, 1.0, True))(_fit("cover", 400, 900, "bottom-left", True))
query("geometry_fill", _sql(f"SELECT *, least(640, w) AS ow, least(480, h) AS oh FROM ({_SIZES}) s"))(_fit("fill", 640, 480, "center", False))
query(
    "geometry_width_only",
    _sql(f"SELECT *, CASE WHEN 480 >= w THEN w ELSE 480 END AS ow, CASE WHEN 480 >= w THEN h ELSE {_ratio('h', '480', 'w')} END AS oh FROM ({_SIZES}) s"),
)(_fit("inside", 480, None, "center", False))


@query("geometry_scale", _sql(f"SELECT *, CAST(greatest(round(w * 0.37), 1) AS BIGINT) AS ow, CAST(greatest(round(h * 0.37), 1) AS BIGINT) AS oh FROM ({_SIZES}) s"))
def geometry_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(sizes(spark, sf_dir).withColumn("g", G.scale(F.col("w"), F.col("h"), F.lit(0.37).cast("double"), F.lit(False))))


_WIDTHS = [320, 640, 1000, 1600, 2400]
_SRCSET = f"""
WITH s AS ({_SIZES}), o AS (
  SELECT id, i, CASE WHEN b >= w THEN w ELSE b END AS ow, CASE WHEN b >= w THEN h ELSE {_ratio('h', 'b', 'w')} END AS oh
  FROM s, (VALUES {', '.join(f'({i}, {b})' for i, b in enumerate(_WIDTHS))}) AS t(i, b))
SELECT b.id, CAST(b.i AS BIGINT) AS nth, CAST(min(a.i) AS BIGINT) AS clashes_with, b.ow AS width, b.oh AS height
FROM o a JOIN o b ON a.id = b.id AND a.ow = b.ow AND a.oh = b.oh AND a.i < b.i GROUP BY b.id, b.i, b.ow, b.oh"""


@query("geometry_srcset_collisions", _SRCSET)
def geometry_srcset_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of a list that give an image the size that an earlier one gave it."""
    s = sizes(spark, sf_dir).select("*", F.posexplode(F.array(*[F.lit(b).cast("long") for b in _WIDTHS])).alias("i", "b"))
    g = G.fit(F.col("w"), F.col("h"), F.col("b"), F.lit(None).cast("long"), how="inside", position="center", enlarge=F.lit(False))
    w, h = G.output_size(F.col("w"), F.col("h"), F.col("g"))
    o = s.withColumn("g", g).select("id", F.col("i").cast("long").alias("i"), w.alias("width"), h.alias("height"))
    # a size's places meet in one group: no join of places with each other
    same = o.groupBy("id", "width", "height").agg(F.sort_array(F.collect_list("i")).alias("at")).filter(F.size("at") > 1)
    return same.select("id", F.explode(F.slice("at", 2, len(_WIDTHS))).alias("nth"), F.col("at")[0].alias("clashes_with"), "width", "height")


@query(
    "memory_estimate",
    f"SELECT id, work, CAST(w * h * 8 + w * h * CASE work WHEN 'plan' THEN 0 WHEN 'encode' THEN 24 ELSE 152 END AS BIGINT) AS bytes FROM ({_SIZES}) s, (VALUES ('plan'), ('encode'), ('search')) AS t(work)",
)
def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sizes(spark, sf_dir).select("id", (F.col("w") * F.col("h")).alias("n"), F.explode(F.array(*map(F.lit, planning.WORK_BYTES))).alias("work"))
    return s.select("id", "work", planning.memory_estimate(F.col("n"), F.col("n"), F.col("work")).alias("bytes"))


@query(
    "budget_limits",
    f"SELECT id, CAST((w * 1000003 // 4) * 3 AS BIGINT) AS bytes, CAST(greatest(h * 100000 * (1 + id % 16) // 4, h * 100000) AS BIGINT) AS pixels FROM ({_SIZES}) s",
)
def budget_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, p = planning.budget_limits(F.col("w") * 1000003, F.col("h") * 100000, 1 + F.col("id") % 16)
    return sizes(spark, sf_dir).select("id", b.alias("bytes"), p.alias("pixels"))


_PEAK = f"""
WITH s AS ({_SIZES}), o AS (
  SELECT id, w, h, b, turned, CASE WHEN b >= x THEN x ELSE b END AS ow, CASE WHEN b >= x THEN y ELSE {_ratio('y', 'b', 'x')} END AS oh
  FROM (SELECT id, w, h, b, turned, CASE WHEN turned THEN h ELSE w END AS x, CASE WHEN turned THEN w ELSE h END AS y
        FROM s, (VALUES {', '.join(f'({b})' for b in _WIDTHS)}) AS t(b), (VALUES (FALSE), (TRUE)) AS u(turned)) q)
SELECT id, CAST(max(ow * oh) AS BIGINT) AS pixels FROM o GROUP BY id"""


@query("output_pixels", _PEAK)
def output_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most pixels of an image over a list of widths, upright or turned."""

    def of(w, h, b):
        x, y = G.inside(w, h, F.lit(b).cast("long"), F.lit(None).cast("long"), F.lit(False))
        return x * y

    w, h = F.col("w"), F.col("h")
    return sizes(spark, sf_dir).select("id", F.greatest(*[of(a, c, b) for b in _WIDTHS for a, c in ((w, h), (h, w))]).alias("pixels"))


@query("pixel_cap", f"SELECT id, w * h > 4000000 AS too_large FROM ({_SIZES}) s")
def pixel_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rasterloom.sources.probe import too_large

    return sizes(spark, sf_dir).select("id", too_large(F.col("w"), F.col("h"), 4_000_000).alias("too_large"))
