"""Queries on decisions: script options, metadata, colour signalling, admission, dry runs, HEIF headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import geometry, orientation
from rasterloom.operators import decisions
from rasterloom.plans.catalog import query
from rasterloom.sources import heif_items, inputs


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(
    "script_options",
    """WITH o AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 4 = 0 THEN 60 + p_partkey % 7 * 10 END AS target, CASE WHEN p_partkey % 9 = 2 THEN p_partkey % 13 * 10 - 5 END AS quality, p_partkey % 11 = 3 AS lossless,
    p_partkey % 5 = 1 AS fast, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 14 END AS effort, p_partkey % 6 = 5 AS scale, p_partkey % 10 = 4 AS width, CASE p_partkey % 8 WHEN 1 THEN 'cover' WHEN 2 THEN 'contain' WHEN 3 THEN 'inside' END AS fit,
    p_partkey % 7 = 1 AS position, p_partkey % 16 IN (2, 3) AS background, p_partkey % 17 = 6 AS strange FROM part)
    SELECT i AS p_partkey, CASE WHEN strange THEN 'unknown option colour' WHEN (target IS NOT NULL)::INT + (quality IS NOT NULL)::INT + lossless::INT > 1 THEN 'alternatives' WHEN fast AND (quality IS NOT NULL OR lossless) THEN 'fast needs a target'
    WHEN target > 100 THEN 'target is a number up to 100' WHEN quality NOT BETWEEN 0 AND 100 THEN 'quality is 0 to 100' WHEN effort > 10 THEN 'effort is 0 to 10' WHEN scale AND (width OR fit IS NOT NULL) THEN 'scale excludes width, height and fit'
    WHEN position AND (fit IS NULL OR fit = 'inside') THEN 'position needs cover or contain' WHEN background AND (fit IS NULL OR fit <> 'contain') THEN 'background needs contain'
    WHEN NOT scale AND fit IN ('cover', 'contain') THEN 'fit ' || fit || ' needs both sides' END AS problem FROM o""",
)
def script_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options objects of scripts, each with the first rule that it breaks."""
    i = F.col("p_partkey")
    given = {
        "target": F.when(i % 4 == 0, (60 + i % 7 * 10).cast("string")), "quality": F.when(i % 9 == 2, (i % 13 * 10 - 5).cast("string")), "lossless": F.when(i % 11 == 3, "true").otherwise("false"),
        "fast": F.when(i % 5 == 1, "true"), "effort": F.when(i % 3 == 0, (i % 14).cast("string")), "scale": F.when(i % 6 == 5, "0.5"), "width": F.when(i % 10 == 4, "100"),
        "fit": F.when(i % 8 == 1, "cover").when(i % 8 == 2, "contain").when(i % 8 == 3, "inside"), "position": F.when(i % 7 == 1, "top"), "background": F.when((i % 16).isin(2, 3), "white"), "colour": F.when(i % 17 == 6, "red"),
    }
    options = F.map_filter(F.create_map(*[c for k, v in given.items() for c in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return _table(spark, sf_dir, "part").select("p_partkey", decisions.script_problem(options, F.lit("inside")).alias("problem"))


@query(
    "metadata_carry",
    """SELECT o_orderkey, CASE WHEN k THEN e END AS exif, CASE WHEN k THEN x END AS xmp, CASE WHEN k AND e IS NOT NULL AND NOT ce THEN 'EXIF' WHEN k AND x IS NOT NULL AND NOT cx THEN 'XMP' END AS problem
    FROM (SELECT o_orderkey, o_orderkey % 5 < 3 AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS e, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS x, o_orderstatus <> 'P' AS ce, o_orderstatus = 'O' AS cx FROM orders) q""",
)
def metadata_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata after the strip policy, and what an encoder can't carry."""
    k = F.col("o_orderkey")
    exif, xmp = decisions.stripped(F.when(k % 2 == 0, F.col("o_orderstatus")), F.when(k % 3 == 0, F.col("o_orderpriority")), k % 5 < 3)
    problem = decisions.carry_problem(exif, xmp, F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O")
    return _table(spark, sf_dir, "orders").select("o_orderkey", exif.alias("exif"), xmp.alias("xmp"), problem.alias("problem"))


@query("target_reported", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND (l_linestatus = 'F' AND l_quantity > 25 OR l_suppkey % 5 = 0) THEN CAST(l_quantity AS DOUBLE) END AS target FROM lineitem")
def target_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of records: a score that was searched for or met without loss."""
    kind = F.when(F.col("l_returnflag") == "A", "score").otherwise("quality")
    target = decisions.reported_target(kind, F.col("l_quantity").cast("double"), (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 25), F.col("l_suppkey") % 5 == 0)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", target.alias("target"))


@query(
    "signalled_colour",
    """SELECT CAST(p AS BIGINT) AS primaries, CAST(t AS BIGINT) AS transfer, CASE WHEN p IN (0, 3, 10) OR p BETWEEN 13 AND 21 OR p > 22 OR t IN (0, 3, 9, 10, 11, 12) OR t > 15 THEN 'none'
    WHEN p IN (1, 2) AND t IN (1, 2, 6, 13, 14, 15) THEN 'srgb' ELSE 'profile' END AS colour FROM range(26) a(p), range(20) b(t)""",
)
def signalled_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of code points and what describes it."""
    grid = spark.range(26 * 20).select(F.floor(F.col("id") / 20).alias("primaries"), (F.col("id") % 20).alias("transfer"))
    return grid.select("primaries", "transfer", decisions.signalled_colour(F.col("primaries"), F.col("transfer")).alias("colour"))


_PRIMARIES = {0: "0.64, 0.33, 0.30, 0.60, 0.15, 0.06", 1: "0.64, 0.0, 0.30, 0.60, 0.15, 0.06", 2: "0.30, 0.60, 0.30, 0.60, 0.15, 0.06", 3: "0.68, 0.32, 0.265, 0.69, 0.15, 0.06", 4: "0.708, 0.292, 0.17, 0.797, 0.131, 0.046", 5: "0.64005, 0.33, 0.30, 0.60, 0.15, 0.06", 6: "0.1, 0.2, 0.2, 0.3, 0.3, 0.4"}
_PRIMARY_KINDS = {0: "rec709", 1: "malformed", 2: "degenerate", 3: "profile", 4: "profile", 5: "rec709", 6: "degenerate"}


@query("layer_primaries", f"SELECT p_partkey, CASE p_partkey % 7 {' '.join(f'WHEN {k} THEN {v!r}' for k, v in _PRIMARY_KINDS.items())} END AS kind FROM part")
def layer_primaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromaticities of layers: the standard ones, wider ones, and some that span no colours."""
    told = _fixed(spark, [(k, *map(float, v.split(","))) for k, v in _PRIMARIES.items()], "k long, rx double, ry double, gx double, gy double, bx double, by double")
    p = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 7).alias("k")).join(F.broadcast(told), "k")  # a fixed table of seven rows
    xy = lambda c: (F.col(f"{c}x"), F.col(f"{c}y"))
    return p.select("p_partkey", decisions.primaries_kind(xy("r"), xy("g"), xy("b"), (F.lit(0.3127), F.lit(0.3290))).alias("kind"))


@query(
    "png_effort",
    "SELECT p_partkey, CAST([0, 1, 2, 2, 3, 3, 4, 4, 5, 6, 6][p_size % 11 + 1] AS INT) AS preset, p_size % 11 = 10 AS exhaustive FROM part",
)
def png_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    preset, exhaustive = decisions.png_effort(F.col("p_size") % 11)
    return _table(spark, sf_dir, "part").select("p_partkey", preset.alias("preset"), exhaustive.alias("exhaustive"))


@query(
    "reservations",
    """SELECT o_orderkey, CAST(r AS BIGINT) AS reserved, r <= 300000 OR n = 1 AS at_once FROM (SELECT o_orderkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS r,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) q""",
)
def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by worker in order of arrival: which fit the budget while none is given back."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.floor("o_totalprice").cast("long").alias("cost"))
    return decisions.admitted(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("cost"), F.lit(300_000)).select("o_orderkey", "reserved", "at_once")


@query("corpus_truncated", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS n FROM part) q WHERE n <= 12 UNION ALL SELECT 'all', p_partkey FROM part")
def corpus_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve images of each dataset by path, and a corpus without a limit."""
    p = _table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey")
    cut = decisions.truncated(p, ["p_brand"], ["p_name", "p_partkey"], 12)
    every = decisions.truncated(p, ["p_brand"], ["p_name", "p_partkey"], 0).withColumn("p_brand", F.lit("all"))
    return cut.unionByName(every).select("p_brand", "p_partkey")


_FEATURES = ["native-jxl", "native-jpegli", "native-heif", "jpeg"]


@query(
    "feature_split",
    """WITH m AS (SELECT n_nationkey AS k, n_nationkey % 7 <> 0 AS native, n_nationkey % 2 = 1 AS musl, n_nationkey % 3 = 1 AS windows, n_nationkey % 3 = 0 AND n_nationkey % 4 >= 2 AS arm_linux FROM nation)
    SELECT k AS n_nationkey, concat_ws(',', CASE WHEN NOT (native AND musl) THEN 'native-jxl' END, CASE WHEN NOT (native AND (musl OR windows OR arm_linux)) THEN 'native-jpegli' END, CASE WHEN NOT (native AND musl) THEN 'native-heif' END, 'jpeg') AS enable,
    concat_ws(',', CASE WHEN native AND musl THEN 'native-jxl' END, CASE WHEN native AND (musl OR windows OR arm_linux) THEN 'native-jpegli' END, CASE WHEN native AND musl THEN 'native-heif' END) AS left_out FROM m""",
)
def feature_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of builds for several machines: what can be enabled, and what the machine leaves out."""
    k = F.col("n_nationkey")
    system = F.when(k % 3 == 0, "linux").when(k % 3 == 1, "windows").otherwise("macos")
    enable, out = decisions.split_features(F.array(*map(F.lit, _FEATURES)), k % 7 != 0, system, F.when(k % 4 >= 2, "aarch64").otherwise("x86_64"), F.when(k % 2 == 1, "musl").otherwise("gnu"))
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(enable, ",").alias("enable"), F.array_join(out, ",").alias("left_out"))


@query(
    "dry_run",
    """SELECT o_orderkey, CASE WHEN r IS NULL THEN 'planned' ELSE 'failed' END AS status, r AS reason FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'no lossy mode' WHEN o_orderkey % 5 < 3 AND o_orderkey % 2 = 0 AND o_orderstatus = 'P' THEN 'can''t carry EXIF'
    WHEN o_orderkey % 11 = 4 THEN 'overwrites the input' WHEN o_orderkey % 7 = 2 AND o_orderpriority <> '1-URGENT' AND o_orderkey % 4 <> 3 THEN 'output exists' END AS r FROM orders) q""",
)
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run would do with each file: the first refusal, or that it is planned."""
    k = F.col("o_orderkey")
    exif, xmp = decisions.stripped(F.when(k % 2 == 0, F.lit("e")), F.lit(None).cast("string"), k % 5 < 3)
    carry = decisions.carry_problem(exif, xmp, F.col("o_orderstatus") != "P", F.lit(True))
    status, reason = decisions.dry_run(F.when(k % 13 == 0, "no lossy mode"), carry, F.when(k % 11 == 4, "overwrites the input"), k % 7 == 2, F.col("o_orderpriority") == "1-URGENT", k % 4 == 3)
    return _table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), reason.alias("reason"))


_ARGUMENTS = [(0, "in/FRANCE.png"), (1, "in/*A.png"), (2, "in"), (3, "zz*"), (4, "missing"), (5, "in/[EF*.txt"), (6, "in/?RAN.txt")]


@query(
    "resolved_inputs",
    """WITH f AS (SELECT 'in/' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.png' ELSE '.txt' END AS path FROM nation), m AS (
    SELECT 0 AS position, path FROM f WHERE path = 'in/FRANCE.png' UNION ALL SELECT 1, path FROM f WHERE path ILIKE 'in/%A.png' UNION ALL SELECT 2, path FROM f WHERE path LIKE '%.png' UNION ALL SELECT 6, path FROM f WHERE path ILIKE 'in/_RAN.txt')
    SELECT CAST(min(position) AS INT) AS position, path, CAST(NULL AS VARCHAR) AS reason FROM m GROUP BY path
    UNION ALL SELECT CAST(p AS INT), NULL, 'no such file or match' FROM range(7) t(p) WHERE p NOT IN (SELECT position FROM m)""",
)
def resolved_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments that are paths, globs, a folder, or nothing at all, over files named after nations."""
    n = _table(spark, sf_dir, "nation")
    path = F.concat(F.lit("in/"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, ".png").otherwise(".txt"))
    files = n.select(path.alias("path"), F.lit(False).alias("is_folder")).unionByName(_fixed(spark, [("in", True)], "path string, is_folder boolean"))
    found, failures = inputs.resolve(_fixed(spark, _ARGUMENTS, "position int, argument string"), files, ["png", "webp"], recursive=True)
    return found.select("position", "path", F.lit(None).cast("string").alias("reason")).unionByName(failures.select("position", F.lit(None).cast("string").alias("path"), "reason"))


@query(
    "geometry_problems",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size % 5 IN (0, 1, 2) THEN 'factor must be a positive number' WHEN p_partkey % 3 <> 0 AND (p_size % 4 = 0 OR p_partkey % 7 = 0) THEN 'a bound must be at least one pixel'
    WHEN p_partkey % 3 <> 0 AND p_partkey % 5 IN (1, 2) AND p_partkey % 7 = 1 THEN 'fit ' || CASE p_partkey % 5 WHEN 1 THEN 'cover' ELSE 'contain' END || ' needs both sides' END AS problem FROM part""",
)
def geometry_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resize requests by factor and by bounds, and why they are refused."""
    k, s = F.col("p_partkey"), F.col("p_size")
    odd = F.when(s % 5 == 0, float("nan")).when(s % 5 == 1, 0.0).when(s % 5 == 2, float("inf")).otherwise(0.5)
    fit = F.when(k % 5 == 1, "cover").when(k % 5 == 2, "contain").otherwise("inside")
    problem = geometry.problem((s % 4 * 100).cast("long"), F.when(k % 7 != 1, k % 7), F.when(k % 3 == 0, odd), fit)
    return _table(spark, sf_dir, "part").select("p_partkey", problem.alias("problem"))


@query("display_width", "SELECT p_brand, CAST(max(length(p_name)) AS INT) AS width FROM part GROUP BY p_brand")
def display_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest name of each run, to which its lines are padded."""
    return _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(F.length("p_name")).alias("width"))


_LINES = "SELECT o_orderkey AS image, o_custkey AS c, CAST(n AS BIGINT) AS n FROM orders, range(1, 8) t(n)"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Seven boxes for each order, which stands for an image."""
    return _table(spark, folder, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_custkey").alias("c"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("n"))


def _primary(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "orders").select(F.col("o_orderkey").alias("image"), (F.col("o_orderkey") % 3 + 1).alias("item"))


@query(
    "box_headers",
    f"""WITH b AS (SELECT image, n, CASE WHEN n = 1 THEN 'ispe' ELSE ['clap', 'irot', 'imir', 'colr'][(c + n * 5) % 4 + 1] END AS kind, (c * 13 + n * 101) % 4000 + 1 AS w, (image * 17 + n * 31) % 3000 + 1 AS h, (image + n * n) % 50 AS v,
    CASE WHEN n = 1 THEN 1 WHEN (c + n) % 7 = 3 THEN 0 ELSE n * 3 % 8 END AS i FROM ({_LINES}) q),
    a AS (SELECT x.image, x.n AS position, y.kind, y.w, y.h, y.v FROM b x JOIN b y ON y.image = x.image AND y.n = x.i),
    g AS (SELECT image, max_by(w, position) FILTER (WHERE kind = 'ispe') AS w, max_by(h, position) FILTER (WHERE kind = 'ispe') AS h, max_by(w, position) FILTER (WHERE kind = 'clap') AS cw, max_by(h, position) FILTER (WHERE kind = 'clap') AS ch,
    count(*) FILTER (WHERE kind = 'irot' AND v % 2 = 1) % 2 = 1 AS swapped, count(*) FILTER (WHERE kind = 'imir') % 2 = 1 AS mirrored FROM a GROUP BY image)
    SELECT image, CASE WHEN swapped THEN least(h, ch) ELSE least(w, cw) END AS width, CASE WHEN swapped THEN least(w, cw) ELSE least(h, ch) END AS height, swapped, mirrored FROM g WHERE w IS NOT NULL""",
)
def box_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of images as shown, composed from their primary item's boxes."""
    c, n, image = F.col("c"), F.col("n"), F.col("image")
    rows = _lines(spark, sf_dir)
    kind: Column = F.when(n == 1, "ispe").otherwise(F.get(F.array(*map(F.lit, ("clap", "irot", "imir", "colr"))), ((c + n * 5) % 4).cast("int")))
    properties = rows.select("image", n.alias("place"), kind.alias("kind"), ((c * 13 + n * 101) % 4000 + 1).alias("width"), ((image * 17 + n * 31) % 3000 + 1).alias("height"), ((image + n * n) % 50).alias("value"))
    index = F.when(n == 1, 1).when((c + n) % 7 == 3, 0).otherwise(n * 3 % 8)
    own = rows.select("image", (image % 3 + 1).alias("item"), n.alias("position"), index.alias("index"))
    other = own.withColumns({"item": F.col("item") + 1, "index": F.col("position")})  # another item's boxes don't count
    head = heif_items.headers(heif_items.associated(own.unionByName(other), properties, _primary(spark, sf_dir)))
    swap, x, y = orientation.parts(F.col("orientation"))
    return head.select("image", "width", "height", swap.alias("swapped"), ((swap != x) != y).alias("mirrored"))


@query("box_metadata", f"SELECT image, min(n) AS item FROM ({_LINES}) q WHERE (c + n) % 3 <> 0 AND c * n % 3 = image % 3 GROUP BY image")
def box_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each image the first metadata item that describes its primary item."""
    rows, c, n = _lines(spark, sf_dir), F.col("c"), F.col("n")
    items = rows.select("image", n.alias("item"), F.when((c + n) % 3 != 0, "Exif").otherwise("hvc1").alias("kind"), n.alias("position"))
    references = rows.select("image", n.alias("from"), (c * n % 3 + 1).alias("to"))
    return heif_items.describing(items, references, _primary(spark, sf_dir), "Exif")
