"""Queries on the pattern and on exploded tables: quantising, classes, conversions, padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import colour, orientation
from rasterloom.operators import classify, raster
from rasterloom.plans.catalog import query

#: The pattern in SQL.
PATTERN = """(SELECT y, x, r, g, b, a, (r + g + b) // 3 AS gray FROM (
  SELECT y, x, x * 255 // 47 AS r, y * 255 // 31 AS g, CASE WHEN x < 24 THEN 40 ELSE 220 END AS b, CASE WHEN y % 2 = 0 THEN 255 ELSE 128 END AS a
  FROM (SELECT CAST(i // 48 AS BIGINT) AS y, CAST(i % 48 AS BIGINT) AS x FROM range(1536) t(i)) p) p)"""


def _quantised(v: str, q: str) -> str:
    step = f"CAST(greatest(round(1 + (100 - {q}) / 100.0 * 63), 1) AS BIGINT)"
    return f"least(255, ({v} + {step} // 2) // {step} * {step})"


_QUALITIES = [5, 25, 50, 75, 95, 100]
_MAE = f"""
SELECT CAST(q AS BIGINT) AS quality, round(avg((abs(r - qr) + abs(g - qg) + abs(b - qb)) / 3.0), 9) AS mae, round(avg(abs(r - qr)), 9) AS mae_r, round(avg(abs(g - qg)), 9) AS mae_g, round(avg(abs(b - qb)), 9) AS mae_b
FROM (SELECT *, {_quantised('r', 'q')} AS qr, {_quantised('g', 'q')} AS qg, {_quantised('b', 'q')} AS qb FROM {PATTERN} p, (VALUES {', '.join(f'({q})' for q in _QUALITIES)}) AS t(q)) z GROUP BY q"""


@query("pattern_quantise_mae", _MAE)
def pattern_quantise_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the closed-form codec on the pattern, by quality."""
    p = raster.pattern(spark).withColumn("quality", F.explode(F.array(*[F.lit(q).cast("long") for q in _QUALITIES])))
    p = p.withColumns({f"q{c}": raster.quantised(F.col(c), F.col("quality")) for c in "rgb"})
    out = raster.mean_error(p, ["quality"], [(c, f"q{c}") for c in "rgb"])
    return out.select("quality", *[F.round(c, 9).alias(c) for c in ("mae", "mae_r", "mae_g", "mae_b")])


_BYTE = "CAST(least(greatest(floor((CAST(v AS DOUBLE) + 1) * 127.5), 0), 255) AS BIGINT)"


@query(
    "embedding_quantise",
    f"SELECT vec_id, CAST(q AS BIGINT) AS quality, round(avg(abs(s - {_quantised('s', 'q')})), 9) AS mae FROM (SELECT vec_id, {_BYTE} AS s FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings) e) f, (VALUES {', '.join(f'({q})' for q in _QUALITIES)}) AS t(q) GROUP BY vec_id, q",
)
def embedding_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as signals of one row: errors of the closed-form codec, inside each array."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    s = F.transform("embedding", lambda v: F.least(F.greatest(F.floor((v.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("long"))
    e = e.select("vec_id", s.alias("s"), F.explode(F.array(*[F.lit(q).cast("long") for q in _QUALITIES])).alias("quality"))
    off = F.aggregate("s", F.lit(0).cast("long"), lambda n, v: n + F.abs(v - raster.quantised(v, F.col("quality"))))
    return e.select("vec_id", "quality", F.round(off / F.size("s"), 9).alias("mae"))


@query(
    "classify_events",
    """SELECT user_id, count(*) AS n_pixels, CAST(least(count(DISTINCT event_type), 257) AS BIGINT) AS n_colours, round(coalesce(avg(CAST(same AS DOUBLE)), 0), 9) AS flat_share,
    CASE WHEN count(DISTINCT event_type) <= 256 OR coalesce(avg(CAST(same AS DOUBLE)), 0) >= 0.5 THEN 'graphic' ELSE 'photo' END AS content
    FROM (SELECT user_id, event_type, CASE WHEN lag(event_type) OVER w IS NULL THEN NULL WHEN lag(event_type) OVER w = event_type THEN 1 ELSE 0 END AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) e GROUP BY user_id""",
)
def classify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    out = classify.classify(e, ["user_id"], [], ["ts", "event_id"], ["event_type"])
    return out.select("user_id", "n_pixels", F.col("n_colours").cast("long").alias("n_colours"), F.round("flat_share", 9).alias("flat_share"), "content")


_LINE = "l_orderkey, l_partkey, l_extendedprice, l_discount, l_tax, l_shipdate"


@query(
    "classify_lineitem",
    f"""SELECT l_suppkey, count(*) AS n_pixels, CAST(least(count(DISTINCT (l_quantity, l_discount)), 257) AS BIGINT) AS n_colours, round(coalesce(avg(CAST(same AS DOUBLE)), 0), 9) AS flat_share,
    CASE WHEN count(DISTINCT (l_quantity, l_discount)) <= 256 OR coalesce(avg(CAST(same AS DOUBLE)), 0) >= 0.5 THEN 'graphic' ELSE 'photo' END AS content
    FROM (SELECT l_suppkey, l_quantity, l_discount, CASE WHEN lag(l_quantity) OVER w IS NULL THEN NULL WHEN lag(l_quantity) OVER w = l_quantity AND lag(l_discount) OVER w = l_discount THEN 1 ELSE 0 END AS same
    FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_linenumber ORDER BY {_LINE}, l_quantity)) e GROUP BY l_suppkey""",
)
def classify_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_suppkey", "l_linenumber", "l_quantity", *_LINE.split(", ")]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*names)
    out = classify.classify(rows, ["l_suppkey"], ["l_linenumber"], [*_LINE.split(", "), "l_quantity"], ["l_quantity", "l_discount"])
    return out.select("l_suppkey", "n_pixels", F.col("n_colours").cast("long").alias("n_colours"), F.round("flat_share", 9).alias("flat_share"), "content")


@query(
    "sampling_grid",
    """SELECT i AS image, count(*) AS n, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(x) AS BIGINT) AS sum_x FROM (SELECT i, y, x, h, w FROM
    (SELECT i, 30 + 50 * i AS h, 40 * i AS w, v // (40 * i) AS y, v % (40 * i) AS x FROM (VALUES (1), (2), (3)) t(i), range(21600) r(v) WHERE v < (30 + 50 * i) * 40 * i) p
    WHERE y % CAST(ceil(h / 64.0) AS BIGINT) = 0 AND x % CAST(ceil(w / 2048.0) AS BIGINT) = 0) q GROUP BY i""",
)
def sampling_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.range(1, 4).select(F.col("id").cast("int").alias("image"), (30 + 50 * F.col("id")).alias("height"), (40 * F.col("id")).alias("width"))
    p = s.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") * F.col("width") - 1)).alias("v")).select("*", F.floor(F.col("v") / F.col("width")).alias("y"), (F.col("v") % F.col("width")).alias("x"))
    return classify.sampled(p).groupBy("image").agg(F.count("*").alias("n"), F.sum("y").alias("sum_y"), F.sum("x").alias("sum_x"))


@query(
    "palette_within",
    "SELECT user_id, count(DISTINCT event_type) <= 4 AS fits FROM events GROUP BY user_id",
)
def palette_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.within(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], ["event_type"], 4)


_SWAP, _FX, _FY = "o IN (5, 6, 7, 8)", "o IN (2, 3, 6, 7)", "o IN (3, 4, 7, 8)"


@query(
    "orientation_remap",
    f"""SELECT o AS orientation, CASE WHEN {_FX} THEN (CASE WHEN {_SWAP} THEN 32 ELSE 48 END) - 1 - u ELSE u END AS x, CASE WHEN {_FY} THEN (CASE WHEN {_SWAP} THEN 48 ELSE 32 END) - 1 - v ELSE v END AS y, r, g, b
    FROM (SELECT CAST(o AS BIGINT) AS o, CASE WHEN {_SWAP} THEN y ELSE x END AS u, CASE WHEN {_SWAP} THEN x ELSE y END AS v, r, g, CAST(b AS BIGINT) AS b FROM {PATTERN} p, range(1, 9) t(o)) q""",
)
def orientation_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster.pattern(spark).withColumn("orientation", F.explode(F.sequence(F.lit(1), F.lit(8)).cast("array<long>")))
    return raster.upright(p, F.lit(48).cast("long"), F.lit(32).cast("long"), F.col("orientation")).select("orientation", "x", "y", "r", "g", "b")


_COMPOSE = f"""
WITH o AS (SELECT CAST(o AS BIGINT) AS o, {_SWAP} AS s, {_FX} AS fx, {_FY} AS fy FROM range(1, 9) t(o)),
c AS (SELECT a.o AS first, b.o AS second, (a.s <> b.s) AS s, ((CASE WHEN b.s THEN a.fy ELSE a.fx END) <> b.fx) AS fx, ((CASE WHEN b.s THEN a.fx ELSE a.fy END) <> b.fy) AS fy FROM o a, o b)
SELECT c.first, c.second, o.o AS together FROM c JOIN o ON c.s = o.s AND c.fx = o.fx AND c.fy = o.fy"""


@query("orientation_compose", _COMPOSE)
def orientation_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.range(64).select((F.floor(F.col("id") / 8) + 1).alias("first"), (F.col("id") % 8 + 1).alias("second"))
    return pairs.select("first", "second", orientation.then(F.col("first"), F.col("second")).alias("together"))


@query("depth_convert", "SELECT CAST(i AS BIGINT) AS s, CAST((i + 128) // 257 AS BIGINT) AS u8, CAST(((i + 128) // 257) * 257 AS BIGINT) AS back FROM range(65536) t(i)")
def depth_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.range(65536).select(F.col("id").alias("s"))
    return s.withColumn("u8", colour.u16_to_u8(F.col("s"))).withColumn("back", colour.u8_to_u16(F.col("u8")))


@query("widen_bits", "SELECT CAST(i AS BIGINT) AS s, CASE WHEN i < 1024 THEN CAST((i << 6) | (i >> 4) AS BIGINT) END AS from10, CAST((i << 4) | (i >> 8) AS BIGINT) AS from12 FROM range(4096) t(i)")
def widen_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return spark.range(4096).select(F.col("id").alias("s")).select("s", F.when(s < 1024, colour.widened(s, 10)).alias("from10"), colour.widened(s, 12).alias("from12"))


@query(
    "range_stage",
    """SELECT CAST(i AS BIGINT) AS i, CAST(round((CASE WHEN u <= 0.0031308 THEN 12.92 * u ELSE 1.055 * pow(u, 1.0 / 2.4) - 0.055 END) * 65535) AS BIGINT) AS colour, CAST(round(u * 65535) AS BIGINT) AS alpha
    FROM (SELECT i, CAST(greatest(least((i - 100) / 1000.0, 1), 0) AS DOUBLE) AS u FROM range(1300) t(i)) q""",
)
def range_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("i") - 100) / 1000.0
    return spark.range(1300).select(F.col("id").alias("i")).select("i", colour.to_srgb16(v).alias("colour"), colour.to_srgb16(v, alpha=True).alias("alpha"))


@query(
    "unpremultiply",
    "SELECT CAST(c AS BIGINT) AS c, CAST(a AS BIGINT) AS a, CASE WHEN a = 0 THEN 0 WHEN a >= 255 THEN c ELSE CAST(least((c * 255 + a // 2) // a, 255) AS BIGINT) END AS plain FROM range(256) t(c), range(256) u(a) WHERE c <= a",
)
def unpremultiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.range(65536).select(F.floor(F.col("id") / 256).alias("c"), (F.col("id") % 256).alias("a")).filter("c <= a")
    return p.select("c", "a", colour.unpremultiplied(F.col("c"), F.col("a"), 255).alias("plain"))


@query("resample_nearest", f"SELECT x // 4 AS x, y // 4 AS y, r, g, CAST(b AS BIGINT) AS b FROM {PATTERN} p WHERE x % 4 = 2 AND y % 4 = 2")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.nearest(raster.pattern(spark), 4).select("x", "y", "r", "g", "b")


@query("resample_box", f"SELECT y // 4 AS y, x // 4 AS x, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM {PATTERN} p GROUP BY y // 4, x // 4")
def resample_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.box(raster.pattern(spark), 4, ["r", "g", "b"])


@query("box_filter_rows", f"SELECT y, x, round(avg(r) OVER w, 9) AS r, round(avg(g) OVER w, 9) AS g FROM {PATTERN} p WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def box_filter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.moving_box(raster.pattern(spark), 2, ["r", "g"]).select("y", "x", F.round("r", 9).alias("r"), F.round("g", 9).alias("g"))


@query(
    "pad_canvas",
    f"SELECT c.y, c.x, coalesce(r, 10) AS r, coalesce(g, 20) AS g, CAST(coalesce(b, 30) AS BIGINT) AS b FROM (SELECT CAST(i // 64 AS BIGINT) AS y, CAST(i % 64 AS BIGINT) AS x FROM range(2560) t(i)) c LEFT JOIN {PATTERN} p ON p.x + 8 = c.x AND p.y + 4 = c.y",
)
def pad_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.padded(raster.pattern(spark).select("y", "x", "r", "g", "b"), 64, 40, 8, 4, {"r": 10, "g": 20, "b": 30})


@query(
    "pad_layout",
    """SELECT CAST(i AS BIGINT) AS i, CASE WHEN gray AND same AND clear THEN 'gray_alpha' WHEN gray AND same THEN 'gray' WHEN clear THEN 'rgba' ELSE 'rgb' END AS layout,
    CASE WHEN takes THEN coalesce(given, '00000000') ELSE substring(coalesce(given, 'ffffffff'), 1, 6) || 'ff' END AS background
    FROM (SELECT i, i % 2 = 0 AS gray, (i // 8) % 2 = 0 AS same, ((i // 2) % 2 = 0 OR (i // 4) % 2 = 0) AS clear, (i // 16) % 2 = 0 AS takes, CASE WHEN (i // 32) % 2 = 0 THEN '10203040' END AS given FROM range(64) t(i)) q""",
)
def pad_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda n: F.floor(F.col("i") / F.lit(n)) % 2 == 0
    grey = F.when(bit(8), 9).otherwise(7)
    layout = raster.padded_layout(bit(1), bit(2), F.lit(9), F.lit(9), grey, F.when(bit(4), 128).otherwise(255))
    return spark.range(64).select(F.col("id").alias("i")).select("i", layout.alias("layout"), raster.background(F.when(bit(32), "10203040"), bit(16)).alias("background"))


@query(
    "opaque_pixels",
    "SELECT CAST(i AS BIGINT) AS i, i % 3 <> 0 AS opaque, CASE WHEN i % 3 <> 0 THEN 6 ELSE 8 END AS n_kept FROM range(100) t(i)",
)
def opaque_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGBA arrays of two pixels: alpha is dropped where it is full everywhere."""
    a = F.when(F.col("i") % 3 == 0, 254).otherwise(255)
    rows = spark.range(100).select(F.col("id").alias("i")).withColumn("s", F.array(*[F.lit(7)] * 3, F.lit(255), *[F.lit(9)] * 3, a))
    clear = colour.opaque(F.col("s"), 255)
    return rows.select("i", clear.alias("opaque"), F.size(F.when(clear, colour.without_alpha(F.col("s"), 4)).otherwise(F.col("s"))).alias("n_kept"))
