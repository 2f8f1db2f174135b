"""Queries on requests, inputs and outputs: formats, options, paths, probes, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import parsing
from rasterloom.operators import planning, report
from rasterloom.plans import dims
from rasterloom.plans.catalog import query
from rasterloom.sources import inputs, probe

_ALIASES = dims.values([(a, f[0]) for f in dims.FORMATS for a in f[4].split()], "alias, format")
_FORMATS = dims.values([f[:4] for f in dims.FORMATS], "format, extension, mime, display")
_ENDINGS = ["JPG", ".png", "jfif", "dib", "Cur", "pam", "heif", "txt", "svg", "vst"]
_ENDING_SQL = "CASE " + " ".join(f"WHEN p_partkey % {len(_ENDINGS)} = {i} THEN '{e}'" for i, e in enumerate(_ENDINGS)) + " END"


@query(
    "extension_format",
    f"SELECT p_partkey, e AS ending, a.format, f.extension, f.mime, f.display FROM (SELECT p_partkey, {_ENDING_SQL} AS e FROM part) p LEFT JOIN (SELECT * FROM {_ALIASES}) a ON a.alias = lower(ltrim(e, '.')) LEFT JOIN (SELECT * FROM {_FORMATS}) f ON f.format = a.format",
)
def extension_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.get(F.array(*map(F.lit, _ENDINGS)), (F.col("p_partkey") % len(_ENDINGS)).cast("int"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", ending.alias("ending")).withColumn("alias", F.lower(F.regexp_replace("ending", r"^\.+", "")))
    # both tables are fixed and have a few rows
    out = p.join(F.broadcast(dims.aliases(spark)), "alias", "left").join(F.broadcast(dims.formats(spark).drop("position")), "format", "left")
    return out.select("p_partkey", "ending", "format", "extension", "mime", "display")


_ENCODERS = dims.values(dims.ENCODERS, "format, backend, tier, registered, lossy, lossless, alpha")


@query("encoder_precedence", f"SELECT format, backend, tier FROM (SELECT *, row_number() OVER (PARTITION BY format ORDER BY registered DESC) AS k FROM {_ENCODERS}) q WHERE k = 1")
def encoder_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.precedence(dims.encoders(spark), ["format"], "registered", last=True).select("format", "backend", "tier")


_TYPES = "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size % 3 <> 0"


@query("decoder_first_usable", f"SELECT p_brand, p_partkey AS decoder, CAST(p_size AS BIGINT) AS size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM ({_TYPES}) t) q WHERE k = 1")
def decoder_first_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand the first registered part that is usable."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size % 3 <> 0").select("p_partkey", "p_brand", "p_size")
    return planning.precedence(p, ["p_brand"], "p_partkey", last=False).select("p_brand", F.col("p_partkey").alias("decoder"), F.col("p_size").cast("long").alias("size"))


def _bits(n: int) -> list:
    return [F.floor(F.col("i") / F.lit(2**k)) % 2 == 1 for k in range(n)]


_B = [f"(i // {2**k}) % 2 = 1" for k in range(10)]


@query(
    "default_format",
    f"SELECT CAST(i AS BIGINT) AS i, CASE WHEN {_B[0]} THEN 'png' WHEN {_B[1]} AND {_B[4]} THEN 'webp' WHEN {_B[1]} THEN 'png' WHEN {_B[5]} AND (NOT {_B[3]} OR {_B[6]}) THEN 'avif' WHEN {_B[2]} THEN 'png' ELSE 'jpeg' END AS format FROM range(128) t(i)",
)
def default_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(128).select(F.col("id").alias("i")).select("i", planning.default_format(*_bits(7)).alias("format"))


_KIND = "CASE i % 3 WHEN 0 THEN 'score' WHEN 1 THEN 'quality' ELSE 'lossless' END"


@query(
    "encode_mode",
    f"""SELECT i, CASE WHEN k = 'quality' AND NOT lossy AND named AND builds = 0 THEN 'refused:unsupported' WHEN k = 'quality' AND NOT lossy AND named THEN 'refused:unavailable' WHEN k = 'lossless' AND inexact THEN 'refused:lossless contradicts options'
    WHEN palette AND (k <> 'score' OR fast) THEN 'refused:palette search needs a target' WHEN palette THEN 'palette search' WHEN k <> 'lossless' AND NOT lossy THEN 'lossless only' WHEN k = 'score' AND fast AND NOT seeded THEN 'refused:no seed'
    WHEN k = 'score' AND fast THEN 'seed' WHEN k = 'score' THEN 'search' ELSE 'explicit' END AS mode
    FROM (SELECT CAST(i AS BIGINT) AS i, {_KIND} AS k, {_B[0]} AS lossy, {_B[1]} AS named, {_B[2]} AS palette, {_B[3]} AS fast, {_B[4]} AS seeded, {_B[5]} AS inexact, (i // 64) % 2 AS builds FROM range(384) t(i)) q""",
)
def encode_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bits(6)
    kind = F.when(F.col("i") % 3 == 0, "score").when(F.col("i") % 3 == 1, "quality").otherwise("lossless")
    return spark.range(384).select(F.col("id").alias("i")).select("i", planning.encode_mode(kind, *b, F.floor(F.col("i") / F.lit(64)) % 2).alias("mode"))


@query(
    "format_refusals",
    f"""SELECT CAST(i AS BIGINT) AS i, CASE WHEN NOT {_B[5]} THEN 'no encoder' WHEN {_B[4]} AND NOT {_B[3]} THEN 'no alpha for a translucent background' WHEN {_KIND} = 'quality' AND NOT {_B[0]} THEN 'no lossy mode' WHEN {_KIND} = 'lossless' AND NOT {_B[1]} THEN 'no lossless mode'
    WHEN {_KIND} = 'score' AND {_B[0]} AND NOT {_B[2]} THEN 'no decoder to score with' END AS problem FROM range(192) t(i)""",
)
def format_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("i") % 3 == 0, "score").when(F.col("i") % 3 == 1, "quality").otherwise("lossless")
    return spark.range(192).select(F.col("id").alias("i")).select("i", planning.request(kind, *_bits(6)).alias("problem"))


_GIVEN = ["jpeg:progressive=false", "png:colors=auto", "png:level=9", "jpg:smoothing=20", "gif:loop=1", "colors=3", "avif:bit_depth=", "webp:sharp_yuv=on", "jxl:container=1", "tiff"]


@query(
    "option_validation",
    f"""WITH g AS (SELECT * FROM {dims.values([(i, g) for i, g in enumerate(_GIVEN)], "n, given")}),
    p AS (SELECT o.o_orderkey AS id, given, regexp_matches(given, '^[^:=]+:[^=]+=') AS formed, split_part(given, ':', 1) AS codec, split_part(split_part(given, ':', 2), '=', 1) AS key FROM orders o JOIN g ON o.o_orderkey % {len(_GIVEN)} = g.n),
    e AS (SELECT format, backend FROM (SELECT *, row_number() OVER (PARTITION BY format ORDER BY registered DESC) AS k FROM (SELECT * FROM {_ENCODERS}) x WHERE tier = 'portable') q WHERE k = 1),
    k AS (SELECT DISTINCT backend, key FROM {dims.values(dims.OPTIONS, "backend, key, standard")})
    SELECT p.id, p.given, CASE WHEN NOT formed THEN 'malformed' WHEN a.format IS NULL OR e.backend IS NULL THEN 'unknown codec' WHEN k.key IS NULL THEN 'unknown option' ELSE 'ok' END AS verdict
    FROM p LEFT JOIN (SELECT * FROM {_ALIASES}) a ON a.alias = lower(p.codec) LEFT JOIN e ON e.format = a.format LEFT JOIN k ON k.backend = e.backend AND k.key = p.key""",
)
def option_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """codec:key=value options against the portable encoder that owns them."""
    given = F.get(F.array(*map(F.lit, _GIVEN)), (F.col("o_orderkey") % len(_GIVEN)).cast("int"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), given.alias("given"))
    o = o.withColumns({"alias": F.lower(F.split_part("given", F.lit(":"), F.lit(1))), "key": F.split_part(F.split_part("given", F.lit(":"), F.lit(2)), F.lit("="), F.lit(1))})
    owner = planning.precedence(dims.encoders(spark).filter("tier = 'portable'"), ["format"], "registered", last=True).select("format", "backend")
    known = dims.options(spark).select("backend", "key").distinct().withColumn("known", F.lit(True))
    # fixed tables of a few rows
    out = o.join(F.broadcast(dims.aliases(spark)), "alias", "left").join(F.broadcast(owner), "format", "left").join(F.broadcast(known), ["backend", "key"], "left")
    verdict = F.when(~F.col("given").rlike("^[^:=]+:[^=]+="), "malformed").when(F.col("backend").isNull(), "unknown codec").when(F.col("known").isNull(), "unknown option").otherwise("ok")
    return out.select("id", "given", verdict.alias("verdict"))


_RULES = {
    "in place with widths": "{0} AND {1}", "template without width": "{2} AND {1} AND NOT {3}", "template without format": "{2} AND {4} AND NOT {5}", "fit needs both sides": "{6} AND NOT {7}",
    "position without crop or pad": "{8} AND NOT {6}", "background without pad": "{9} AND NOT {6}",
}


@query("argument_rules", "SELECT CAST(i AS BIGINT) AS i, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN {r.format(*_B)} THEN '{n}' END" for n, r in _RULES.items()) + "] IF x IS NOT NULL], '; ') AS problems FROM range(1024) t(i)")
def argument_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that a combination of arguments breaks."""
    place, widths, template, has_width, formats, has_format, boxed, both, position, back = _bits(10)
    broken = {
        "in place with widths": place & widths, "template without width": template & widths & ~has_width, "template without format": template & formats & ~has_format, "fit needs both sides": boxed & ~both,
        "position without crop or pad": position & ~boxed, "background without pad": back & ~boxed,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in broken.items()]))
    return spark.range(1024).select(F.col("id").alias("i")).select("i", F.array_join(found, "; ").alias("problems"))


_PRESETS = dims.values(dims.PRESETS, "preset, target, effort, side")


@query(
    "presets_overrides",
    f"SELECT o_orderkey, p.preset, CAST(CASE WHEN q IS NULL THEN p.target END AS DOUBLE) AS target, q AS quality, CAST(p.effort AS BIGINT) AS effort, CAST(coalesce(mw, p.side) AS BIGINT) AS width, CAST(CASE WHEN mw IS NULL THEN p.side END AS BIGINT) AS height FROM (SELECT o_orderkey, ['web', 'thumbnail', 'archive', 'lossless'][1 + o_orderkey % 4] AS preset, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 101 AS DOUBLE) END AS q, CASE WHEN o_orderkey % 7 = 0 THEN 1600 END AS mw FROM orders) o JOIN (SELECT * FROM {_PRESETS}) p ON p.preset = o.preset",
)
def presets_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preset and the flags over it; a size flag replaces the preset's box as a whole."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.get(F.array(*[F.lit(p[0]) for p in dims.PRESETS]), (k % 4).cast("int")).alias("preset"), F.when(k % 5 == 0, (k % 101).cast("double")).alias("quality"), F.when(k % 7 == 0, F.lit(1600)).alias("mw"))
    out = o.join(F.broadcast(dims.presets(spark)), "preset")
    side = F.col("side")
    return out.select("o_orderkey", "preset", F.when(F.col("quality").isNull(), F.col("target")).alias("target"), "quality", F.col("effort").cast("long").alias("effort"), F.coalesce("mw", side).cast("long").alias("width"), F.when(F.col("mw").isNull(), side).cast("long").alias("height"))


_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || CASE WHEN page_id % 3 = 0 THEN 'a.b.JPG' WHEN page_id % 3 = 1 THEN '/.hidden' ELSE '/x.txt' END"
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_STEM = f"CASE WHEN regexp_matches({_NAME}, '^.+\\.[^.]*$') THEN regexp_extract({_NAME}, '^(.+)\\.[^.]*$', 1) ELSE {_NAME} END"
_DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(path, F.when(k % 3 == 0, "a.b.JPG").when(k % 3 == 1, "/.hidden").otherwise("/x.txt")).alias("path"))


@query(
    "placement_template",
    f"""SELECT page_id, path, {_STEM} AS stem, {_DIR} AS folder, {_DIR} || CASE WHEN {_DIR} = '' THEN '' ELSE '/' END || {_STEM} || '@backup' || CASE WHEN regexp_matches({_NAME}, '^.+\\.[^.]*$') THEN '.' || regexp_extract({_NAME}, '\\.([^.]*)$', 1) ELSE '' END AS backup,
    {_STEM} || '-' || CAST(page_id AS VARCHAR) || 'x' || CAST(page_id + 1 AS VARCHAR) || '.webp.q' || CASE WHEN page_id % 2 = 0 THEN 'auto' ELSE CAST(CAST(round(page_id / 2.0) AS BIGINT) AS VARCHAR) END || '/' || {_NAME} AS named FROM (SELECT page_id, {_PATH} AS path FROM pages) p""",
)
def placement_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = F.col("path"), F.col("page_id")
    tag = report.quality_tag(F.when(k % 2 == 1, k / 2.0), F.lit(None).cast("string"))
    named = report.rendered(F.lit("{stem}-{width}x{height}.{ext}.q{quality}/{name}"), p, F.lit("webp"), F.lit("webp"), k, k + 1, tag)
    return _paths(spark, sf_dir).select("page_id", "path", report.stem(p).alias("stem"), report.folder(p).alias("folder"), report.backup_path(p).alias("backup"), named.alias("named"))


@query(
    "input_resolution",
    f"SELECT path, min(page_id) AS first_page, TRUE AS readable FROM (SELECT page_id, {_PATH} AS path FROM pages) p WHERE lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) IN ('jpg', 'png') AND NOT regexp_matches(path, '(?i)^(?!\\.).*/de/.*$'.replace('(?!\\.)', '')) AND regexp_matches(path, '(?i)^.*example.*$') GROUP BY path",
)
def input_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable, included, not excluded, each path once."""
    found = inputs.walked(_paths(spark, sf_dir), ["jpg", "png"], ["*example*"], ["*/de/*"])
    return inputs.first_seen(found, order="page_id").select("path", F.col("page_id").alias("first_page"), F.lit(True).alias("readable"))


@query("files_from", "SELECT doc_id, len([y FOR y IN [regexp_replace(x, '\r$', '') FOR x IN string_split(coalesce(text, ''), chr(10))] IF y <> '']) AS n_paths FROM documents")
def files_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as lists of paths."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.size(inputs.listed(F.coalesce("text", F.lit("")))).cast("long").alias("n_paths"))


@query("svg_root_sniff", "SELECT page_id, regexp_matches(html, '^\\s*(<!DOCTYPE [^>]*>)?\\s*<svg[\\s>/]') AS page, page_id % 2 = 0 AS wrapped FROM pages")
def svg_root_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they are, and behind a declaration, a comment and an svg element."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    start = F.when(F.col("page_id") % 2 == 0, '<?xml version="1.0"?>\n<!-- a > b --><!DOCTYPE svg>\n<svg>').otherwise("<!-- <svg> --><svga>")
    return p.select("page_id", probe.is_svg(F.col("html")).alias("page"), probe.is_svg(F.concat(start, F.col("html"))).alias("wrapped"))


#: Heads of files in hex, what they are, and the size that they say.
BLOBS = [
    ("89504E470D0A1A0A0000000D4948445200000030000000200802000000", "png", 48, 32), ("4749463839613000200080000000000000", "gif", 48, 32), ("FFD8FFE000104A46", "jpeg", None, None),
    ("424D00000000000000000000000028000000300000002000000001001800", "bmp", 48, 32), ("424D000000000000000000000000280000003000000000FFFFFF01001800", "bmp", 48, 256), ("716F696600000030000000200300", "qoi", 48, 32),
    ("50360A343820", "pnm", None, None), ("503820", None, None, None), ("5249464600000000574542505650384C", "webp", None, None), ("0000001C6674797061766966000000006D696631", "avif", None, None),
    ("000000186674797068656963000000006D696631", "heic", None, None), ("00000018667479706D696631000000006D69663168656963", "heic", None, None), ("FF0A", "jxl", None, None), ("49492A00", "tiff", None, None),
    ("000001000100302000", "ico", 48, 32), ("762F3101", "exr", None, None), ("3C73766720783D", "svg", None, None), ("000002000000000000000000010001001800010203", "tga", 1, 1), ("0000020000000000000000000100010018000102", None, None, None), ("", None, None, None),
]


@query("byte_probe", f"SELECT CAST(n AS BIGINT) AS n, format, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height FROM {dims.values([(i, *b[1:]) for i, b in enumerate(BLOBS)], 'n, format, width, height')}")
def byte_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats and sizes from the first bytes of files."""
    b = spark.createDataFrame([(i, x[0]) for i, x in enumerate(BLOBS)], "n long, h string").select("n", F.unhex("h").alias("content"))
    b = b.withColumn("format", probe.identify(F.col("content")))
    size = probe.dimensions(F.col("content"), F.col("format"))
    return b.select("n", "format", size["width"].alias("width"), size["height"].alias("height"))


_IN, _OUT = "CAST(floor(o_totalprice) AS BIGINT)", "CAST(floor(o_totalprice * (o_orderkey % 13) / 10) AS BIGINT)"
_STATUS = f"CASE WHEN {_OUT} > {_IN} THEN 'skipped' WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'written' END"


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.floor("o_totalprice")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", n.alias("input_bytes"), F.floor(F.col("o_totalprice") * (k % 13) / 10).alias("output_bytes"))
    no = F.lit(False)
    policy = report.write_policy(F.col("output_bytes"), F.col("input_bytes"), k % 11 == 0, no, in_place=no, backup=no, force=no)
    return o.withColumn("p", policy).select("*", F.col("p.status").alias("status"), F.col("p.reason").alias("reason")).drop("p")


@query("write_policy", f"SELECT o_orderkey, {_STATUS} AS status, CASE WHEN {_OUT} > {_IN} THEN 'larger than the input' WHEN o_orderkey % 11 = 0 THEN 'output exists' END AS reason FROM orders")
def write_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).select("o_orderkey", "status", "reason")


@query(
    "run_tally",
    f"""SELECT o_orderstatus, CAST(count(*) FILTER (WHERE s = 'written') AS BIGINT) AS written, CAST(count(*) FILTER (WHERE s = 'skipped') AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS planned, CAST(count(*) FILTER (WHERE s = 'failed') AS BIGINT) AS failed,
    CAST(coalesce(sum(i) FILTER (WHERE s = 'written'), 0) AS BIGINT) AS input_bytes, CAST(coalesce(sum(o) FILTER (WHERE s = 'written'), 0) AS BIGINT) AS output_bytes FROM (SELECT o_orderstatus, {_STATUS} AS s, {_IN} AS i, {_OUT} AS o FROM orders) q GROUP BY o_orderstatus""",
)
def run_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tally(_written(spark, sf_dir), ["o_orderstatus"])


@query(
    "record_json",
    f"""SELECT o_orderkey, '{{"input":"' || CAST(o_orderkey AS VARCHAR) || '.png","status":"' || s || '"' || CASE WHEN s = 'skipped' THEN ',"reason":"larger than the input"' WHEN s = 'failed' THEN ',"reason":"output exists"' ELSE '' END || ',"input_bytes":' || CAST(i AS VARCHAR) || ',"output_bytes":' || CAST(o AS VARCHAR) || '}}' AS json
    FROM (SELECT o_orderkey, {_STATUS} AS s, {_IN} AS i, {_OUT} AS o FROM orders) q""",
)
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _written(spark, sf_dir).withColumn("input", F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")))
    have = [c for c in report.FIELDS if c in r.columns]
    return r.select("o_orderkey", F.to_json(F.struct(*have)).alias("json"))


@query(
    "byte_format",
    f"""SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1000000 THEN printf('%.1f KB', n / 1e3) WHEN n < 1000000000 THEN printf('%.1f MB', n / 1e6) ELSE printf('%.2f GB', n / 1e9) END AS size
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 8) * 8 + 1 AS BIGINT) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 16 ELSE 4096 END AS n FROM orders) q""",
)
def byte_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = (F.floor(F.col("o_totalprice") * 8) * 8 + 1) * F.when(k % 3 == 0, 1).when(k % 3 == 1, 16).otherwise(4096)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", parsing.byte_size(n).alias("size"))


_SPELLED = ["true", "off", "1", "on", "no", "yes", "auto", "2", "256", "257", "50%", "0%", "12.5 %", "75", "101", "-3", "#fff", "#A1b2C3", "12345678", "white", "Transparent", "268M", "10k", "0", "3G", "", "abc", "1e2"]
_PARSED = [
    # spelled, boolean, percent 0..100, palette, pixels, scale, colour
    ("true", True, None, None, None, None, None), ("off", False, None, 0, None, None, None), ("1", True, 1, None, 1, None, None), ("on", True, None, None, None, None, None), ("no", False, None, None, None, None, None), ("yes", True, None, None, None, None, None),
    ("auto", None, None, -1, None, None, None), ("2", None, 2, 2, 2, None, None), ("256", None, None, 256, 256, None, "225566ff"), ("257", None, None, None, 257, None, "225577ff"), ("50%", None, None, None, None, 0.5, None), ("0%", None, None, None, None, None, None),
    ("12.5 %", None, None, None, None, 0.125, None), ("75", None, 75, 75, 75, None, None), ("101", None, None, 101, 101, None, "110011ff"), ("-3", None, None, None, None, None, None), ("#fff", None, None, None, None, None, "ffffffff"), ("#A1b2C3", None, None, None, None, None, "a1b2c3ff"),
    ("12345678", None, None, None, 12345678, None, "12345678"), ("white", None, None, None, None, None, "ffffffff"), ("Transparent", None, None, None, None, None, "00000000"), ("268M", None, None, None, 268000000, None, None), ("10k", None, None, None, 10000, None, None),
    ("0", False, 0, None, None, None, None), ("3G", None, None, None, 3000000000, None, None), ("", None, None, None, None, None, None), ("abc", None, None, None, None, None, "aabbccff"), ("1e2", None, None, None, None, None, "11ee22ff"),
]


@query("parse_values", f"SELECT spelled, CAST(b AS BOOLEAN) AS boolean, CAST(p AS BIGINT) AS percent, CAST(c AS BIGINT) AS palette, CAST(x AS BIGINT) AS pixels, CAST(s AS DOUBLE) AS scale, CAST(h AS VARCHAR) AS colour FROM {dims.values(_PARSED, 'spelled, b, p, c, x, s, h')}")
def parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("spelled")
    rows = spark.createDataFrame([(x,) for x in _SPELLED], "spelled string")
    return rows.select("spelled", parsing.boolean(s).alias("boolean"), parsing.whole(s, 0, 100).alias("percent"), parsing.palette(s).alias("palette"), parsing.pixels(s).alias("pixels"), parsing.percentage(s).alias("scale"), parsing.colour(s).alias("colour"))


_CHANGE = "SELECT o_orderkey, CASE WHEN i = 0 THEN 'n/a' ELSE printf('%+.0f%%', (o - i) / CAST(i AS DOUBLE) * 100) END AS change FROM (SELECT o_orderkey, 1000 * (o_orderkey % 7) AS i, 10 * (o_orderkey % 977) AS o FROM orders) q"


@query("size_change", _CHANGE)
def size_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's change in size, n/a from nothing."""
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", parsing.change(1000 * (k % 7), 10 * (k % 977)).alias("change"))


_OPTS = "map_from_entries([('png:colors', '16'), ('png:dither', '0'), ('jpeg:smoothing', CAST(o_orderkey % 100 AS VARCHAR))])"


@query("codec_options", "SELECT o_orderkey, 'colors=16,dither=0' AS png, 'smoothing=' || CAST(o_orderkey % 100 AS VARCHAR) AS jpeg, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'png:colors=16' END AS blamed FROM orders")
def codec_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's options by codec, and those that give samples up."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    given = F.create_map(F.lit("png:colors"), F.lit("16"), F.lit("png:dither"), F.lit("0"), F.lit("jpeg:smoothing"), (k % 100).cast("string"))
    shown = lambda codec: F.array_join(F.array_sort(F.transform(F.map_entries(planning.codec_options(given, codec)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    png = F.map_filter(given, lambda key, _: key.startswith("png:"))
    alone = F.create_map(F.lit("png:colors"), F.lit(False), F.lit("png:dither"), F.lit(True))
    return o.select("o_orderkey", shown("png").alias("png"), shown("jpeg").alias("jpeg"), F.array_join(planning.lossy_options(png, alone, k % 2 == 0), ",").alias("blamed"))
