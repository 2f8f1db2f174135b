"""Listings, logs and labels: what a run shows for people and for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import parsing
from rasterloom.operators import report, search
from rasterloom.plans import dims
from rasterloom.plans.catalog import query
from rasterloom.plans.search_queries import _TRIALS, _linear
from rasterloom.sources import inputs

_ENCODERS = dims.values(dims.ENCODERS, "format, backend, tier, registered, lossy, lossless, alpha")
_OPTIONS = dims.values(dims.OPTIONS, "backend, key, standard")


@query(
    "codec_listing",
    f"""WITH o AS (SELECT backend, string_agg(key || '=' || standard, ', ' ORDER BY key) AS options FROM {_OPTIONS} GROUP BY backend)
    SELECT format, string_agg(e.backend, ', ' ORDER BY registered) AS backends, array_to_string(list_sort(list_distinct(list(tier))), ', ') AS tiers, bool_or(lossy) AS lossy, bool_or(lossless) AS lossless, string_agg(coalesce(options, '-'), '; ' ORDER BY registered) AS options
    FROM (SELECT * FROM {_ENCODERS}) e LEFT JOIN o ON o.backend = e.backend GROUP BY format""",
)
def codec_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every format that can be written, by whom and with which options."""
    shown = dims.options(spark).groupBy("backend").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "key", "standard"))), ", ").alias("options"))
    e = dims.encoders(spark).join(shown, "backend", "left").withColumn("options", F.coalesce("options", F.lit("-")))
    row = F.array_sort(F.collect_list(F.struct("registered", "backend", "options")))
    out = e.groupBy("format").agg(row.alias("r"), F.array_join(F.array_sort(F.collect_set("tier")), ", ").alias("tiers"), F.bool_or("lossy").alias("lossy"), F.bool_or("lossless").alias("lossless"))
    return out.select("format", F.array_join("r.backend", ", ").alias("backends"), "tiers", "lossy", "lossless", F.array_join("r.options", "; ").alias("options"))


@query("group_labels", "SELECT n_regionkey, string_agg(c || ' ' || s, ', ' ORDER BY s) AS label FROM (SELECT n_regionkey, substring(n_name, 1, 1) AS s, CAST(count(*) AS VARCHAR) AS c FROM nation GROUP BY 1, 2) q GROUP BY n_regionkey")
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of groups as one line each."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey", F.substring("n_name", 1, 1).alias("s")).agg(F.count("*").alias("c"))
    rows = F.array_sort(F.collect_list(F.struct("s", F.concat_ws(" ", F.col("c").cast("string"), "s").alias("t"))))
    return n.groupBy("n_regionkey").agg(F.array_join(rows["t"], ", ").alias("label"))


@query("trial_log", _TRIALS)
def trial_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every search, trial by trial, with the bracket's lower end before each."""
    log = _linear(spark, sf_dir, False).select("id", F.posexplode("found.trials").alias("n", "t"))
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    short = F.when(F.col("t.score") < 70.0 - search.TOLERANCE, F.col("t.value"))
    return log.select("id", (F.col("n") + 1).cast("long").alias("n"), F.col("t.value").alias("value"), F.round("t.score", 9).alias("score"), F.coalesce(F.max(short).over(before), F.lit(search.QUALITY[0])).alias("low"))


_SIZE = "CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1000000 THEN printf('%.1f KB', n / 1e3) WHEN n < 1000000000 THEN printf('%.1f MB', n / 1e6) ELSE printf('%.2f GB', n / 1e9) END"


@query("summary_lines", f"SELECT o_orderpriority AS run, CAST(c AS VARCHAR) || ' written, ' || {_SIZE} AS line FROM (SELECT o_orderpriority, count(*) AS c, CAST(sum(floor(o_totalprice)) AS BIGINT) * 8 AS n FROM orders GROUP BY 1) q")
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing line of each run."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("run"), F.lit("written").alias("status"), (F.floor("o_totalprice") * 8).alias("output_bytes"), F.lit(0).cast("long").alias("input_bytes"))
    t = report.tally(o, ["run"])
    return t.select("run", F.concat(F.col("written").cast("string"), F.lit(" written, "), parsing.byte_size(F.col("output_bytes"))).alias("line"))


_GLOBS = [("*.png", "a/B.PNG", True), ("*.png", ".a.png", False), (".*.png", ".a.png", True), ("a?c", "abc", True), ("a?c", "ac", False), ("*/x", "a/b/x", True), ("[ab]x", "bX", True), ("[!ab]x", "bx", False), ("a+b(1).jpg", "a+b(1).jpg", True), ("a[b", "a[b", True), ("a[b", "ab", False), ("x[a[b]", "x[", True), ("x[a[b]", "xb", True), ("[]", "[]", True), ("a[!b", "a[!b", True), ("[a&&b]", "&", True), ("**.gif", "d/e.gif", True)]


@query("glob_match", f"SELECT pattern, path, CAST(fits AS BOOLEAN) AS fits FROM {dims.values(_GLOBS, 'pattern, path, fits')}")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([g[:2] for g in _GLOBS], "pattern string, path string")
    return rows.select("pattern", "path", F.regexp_like("path", inputs.glob_regex(F.col("pattern"))).alias("fits"))


@query(
    "destination_paths",
    """SELECT n_nationkey, CASE WHEN k = 0 AND f <> 'png' THEN NULL WHEN k = 0 THEN p WHEN k = 1 THEN 'out/r/' || s || '_s-480w.' || e WHEN k = 2 AND e = 'png' THEN NULL ELSE 'in/' || s || '.' || e END AS path,
    CASE WHEN k = 0 AND f <> 'png' THEN 'would change the format' WHEN k = 2 AND e = 'png' THEN 'overwrites the input' END AS problem
    FROM (SELECT n_nationkey, n_nationkey % 3 AS k, 'in/' || n_name || '.png' AS p, n_name AS s, CASE WHEN n_nationkey % 2 = 0 THEN 'png' ELSE 'webp' END AS f, CASE WHEN n_nationkey % 2 = 0 THEN 'png' ELSE 'webp' END AS e FROM nation) q""",
)
def destination_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs in place, in a folder with a width tag, and beside the input."""
    k = F.col("n_nationkey") % 3
    fmt = F.when(F.col("n_nationkey") % 2 == 0, "png").otherwise("webp")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat(F.lit("in/"), "n_name", F.lit(".png")).alias("p"))
    to = report.destination(
        F.col("p"), fmt, F.lit("png"), fmt, F.lit(480), output=F.when(k == 1, "out"), in_place=k == 0, single=F.lit(False), relative=F.lit("r"), width_list=k == 1, suffix_text=F.when(k == 1, "_s")
    )
    return n.select("n_nationkey", to.alias("t")).select("n_nationkey", "t.path", "t.problem")
