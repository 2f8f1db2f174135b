"""Search, seed and calibration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import search, seeds
from rasterloom.plans.catalog import query

#: An example curve for the queries; real ones come from calibration.
CURVES = [
    ("jpeg", "portable", 50.0, 40.0, 30.0, 50.0), ("jpeg", "portable", 70.0, 60.0, 56.0, 64.0), ("jpeg", "portable", 90.0, 90.0, 89.0, 91.0),
    ("avif", "native", 30.0, 20.0, 10.0, 60.0), ("avif", "native", 80.0, 65.0, 50.0, 75.0),
]


def curves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CURVES, "format string, tier string, target double, quality double, low double, high double")


_BEST = """SELECT id, best AS value, round(best_score, 9) AS score, CAST(n AS BIGINT) AS iterations, best_reaches AS reached, (NOT best_reaches AND hit_top) AS capped
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS k FROM run) q WHERE k = 1"""


def _recursive(rows: str, score: str, target: str, *, lo: float, hi: float, middle: str, seed: str = "CAST(NULL AS DOUBLE)", stride: str = "CAST(NULL AS DOUBLE)", shown: str = _BEST) -> str:
    """The state machine as a recursive query. rows: id and columns of the score; score in v; shown: what is taken from its states."""
    mid = middle.format(lo="lo", hi="hi")
    return f"""
WITH RECURSIVE base AS (SELECT *, CAST({target} AS DOUBLE) AS target, {seed} AS seed, {stride} AS seed_step FROM ({rows}) b),
run(id, n, lo, hi, short, reach, step, v, best, best_score, best_reaches, done, hit_top) AS (
  SELECT id, 0, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), FALSE, FALSE, CASE WHEN seed IS NULL THEN NULL ELSE seed_step END, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), FALSE, FALSE, FALSE FROM base
  UNION ALL
  SELECT id, n, CASE WHEN ok THEN lo ELSE v END, CASE WHEN ok THEN v ELSE hi END, short OR NOT ok, reach OR ok, CASE WHEN (short OR NOT ok) AND (reach OR ok) THEN NULL ELSE step END, v,
    CASE WHEN better THEN v ELSE best END, CASE WHEN better THEN s ELSE best_score END, CASE WHEN better THEN ok ELSE best_reaches END,
    abs(s - target) <= 1 OR (CASE WHEN ok THEN v ELSE hi END) - (CASE WHEN ok THEN lo ELSE v END) <= 1, hit_top OR v = {hi}
  FROM (SELECT *, (best IS NULL OR (ok AND (NOT best_reaches OR v < best)) OR (NOT ok AND NOT best_reaches AND s >= best_score)) AS better
    FROM (SELECT *, s >= target - 1 AS ok FROM (SELECT w.*, CAST({score} AS DOUBLE) AS s FROM (
      SELECT r.id, r.n + 1 AS n, lo, hi, short, reach,
        CASE WHEN r.n >= 1 AND NOT (r.n + 1 = 6 AND NOT reach) AND step IS NOT NULL THEN step * 2 ELSE step END AS step,
        CASE WHEN r.n = 0 AND seed IS NOT NULL THEN least(greatest(round(seed), lo), hi) WHEN r.n = 0 THEN {mid} WHEN r.n + 1 = 6 AND NOT reach THEN CAST({hi} AS DOUBLE)
          WHEN step IS NOT NULL THEN CASE WHEN reach THEN greatest(round(r.v - step), lo) ELSE least(round(r.v + step), hi) END ELSE {mid} END AS v,
        best, best_score, best_reaches, hit_top, base.* EXCLUDE (id)
      FROM run r JOIN base ON base.id = r.id WHERE NOT done AND r.n < 6) w) x) y) z)
{shown}"""


def _shown(df: DataFrame) -> DataFrame:
    f = F.col("found")
    return df.select("id", f["value"].alias("value"), F.round(f["score"], 9).alias("score"), f["iterations"].cast("long").alias("iterations"), f["reached"].alias("reached"), f["capped"].alias("capped"))


_SLOPES = "SELECT p_partkey AS id, 0.2 + (p_partkey % 97) / 100.0 AS k FROM part"
_LINEAR = _recursive(_SLOPES, "k * v", "70", lo=1, hi=100, middle="round(({lo} + {hi}) / 2)")
_TRIALS = _recursive(
    _SLOPES, "k * v", "70", lo=1, hi=100, middle="round(({lo} + {hi}) / 2)",
    shown="SELECT id, CAST(n AS BIGINT) AS n, v AS value, round(k * v, 9) AS score, low FROM (SELECT r.id, n, v, k, lag(lo) OVER (PARTITION BY r.id ORDER BY n) AS low FROM run r JOIN base ON base.id = r.id) q WHERE n > 0",
)
_SEEDED = _recursive(_SLOPES, "k * v", "70", lo=1, hi=100, middle="round(({lo} + {hi}) / 2)", seed="CAST(10 + id % 90 AS DOUBLE)", stride="CAST(2 + id % 18 AS DOUBLE)")
_PALETTE = _recursive("SELECT p_partkey AS id, CAST(5 + p_partkey % 90 AS DOUBLE) AS k FROM part", "10 + 10 * log2(v)", "k", lo=2, hi=256, middle="round(sqrt({lo} * {hi}))")


def _linear(spark: SparkSession, sf_dir: str, seeded: bool) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    k = 0.2 + (F.col("id") % 97) / 100.0
    more = {"seed": (10 + F.col("id") % 90).cast("double"), "step": (2 + F.col("id") % 18).cast("double")} if seeded else {}
    found = search.search_column(lambda v: k * v, F.lit(70.0), **more)
    return part.withColumn("found", found)


@query("search_linear", _LINEAR)
def search_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_linear(spark, sf_dir, False))


@query("search_seeded", _SEEDED)
def search_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_linear(spark, sf_dir, True))


@query("search_palette", _PALETTE)
def search_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"))
    target = (5 + F.col("id") % 90).cast("double")
    found = search.search_column(lambda v: 10 + 10 * F.log2(v), target, geometric=True, axis=search.PALETTE)
    return _shown(part.withColumn("found", found))


_SUMMARY = "round(avg(iterations), 6) AS encodes, CAST(count(*) FILTER (WHERE iterations = 1) AS BIGINT) AS first_hits, CAST(count(*) FILTER (WHERE reached) AS BIGINT) AS reached, round(avg(value), 6) AS value"


@query("search_summary", f"SELECT 'plain' AS run, {_SUMMARY} FROM ({_LINEAR}) a UNION ALL SELECT 'seeded', {_SUMMARY} FROM ({_SEEDED}) b")
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all searches, without and with seeds."""
    runs = _shown(_linear(spark, sf_dir, False)).withColumn("run", F.lit("plain")).unionByName(_shown(_linear(spark, sf_dir, True)).withColumn("run", F.lit("seeded")))
    return runs.groupBy("run").agg(F.round(F.avg("iterations"), 6).alias("encodes"), F.count_if(F.col("iterations") == 1).alias("first_hits"), F.count_if("reached").alias("reached"), F.round(F.avg("value"), 6).alias("value"))


_POINTS = ", ".join(f"('{f}', '{t}', {a}, {q}, {lo}, {hi})" for f, t, a, q, lo, hi in CURVES)


@query(
    "seed_lookup",
    f"""WITH p AS (SELECT *, lead(target) OVER w AS nt, lead(quality) OVER w AS nq, lead(low) OVER w AS nl, lead(high) OVER w AS nh, row_number() OVER w = 1 AS f
      FROM (SELECT f AS format, t AS tier, CAST(a AS DOUBLE) AS target, CAST(b AS DOUBLE) AS quality, CAST(c AS DOUBLE) AS low, CAST(d AS DOUBLE) AS high FROM (VALUES {_POINTS}) AS u(f, t, a, b, c, d)) v WINDOW w AS (PARTITION BY format, tier ORDER BY target)),
    t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'jpeg' ELSE 'avif' END AS format, CASE WHEN o_orderkey % 2 = 0 THEN 'portable' ELSE 'native' END AS tier, CAST(20 + o_orderkey % 80 AS DOUBLE) AS target FROM orders),
    m AS (SELECT o_orderkey, t.target, p.quality AS q, p.low AS l, p.high AS h, nq, nl, nh, CASE WHEN nt IS NULL OR t.target <= p.target THEN 0 ELSE (t.target - p.target) / (nt - p.target) END AS s
      FROM t JOIN p ON t.format = p.format AND t.tier = p.tier AND (f OR p.target <= t.target) AND (nt IS NULL OR t.target < nt))
    SELECT o_orderkey, target, round(q + coalesce(nq - q, 0) * s, 9) AS quality, round(least(greatest(((h + coalesce(nh - h, 0) * s) - (l + coalesce(nl - l, 0) * s)) / 2, 2), 20), 9) AS step FROM m""",
)
def seed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(even, "jpeg").otherwise("avif").alias("format"), F.when(even, "portable").otherwise("native").alias("tier"), (20 + F.col("o_orderkey") % 80).cast("double").alias("target"))
    out = seeds.lookup(o, curves(spark), ["format", "tier"])
    return out.select("o_orderkey", "target", F.round("quality", 9).alias("quality"), F.round("step", 9).alias("step"))


_TARGETS = [float(t) for t in range(20, 100, 5)]
_CURVE = "SELECT l_suppkey, l_quantity AS quality, round(avg(l_extendedprice) / 500.0, 4) AS score FROM lineitem GROUP BY l_suppkey, l_quantity"
_GRID = ", ".join(f"({t})" for t in _TARGETS)
_CROSSING = f"""
WITH c AS ({_CURVE}), p AS (SELECT *, lag(quality) OVER w AS q0, lag(score) OVER w AS s0 FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY quality)),
g AS (SELECT DISTINCT l_suppkey, CAST(t AS DOUBLE) AS target FROM c, (VALUES {_GRID}) AS v(t)),
m AS (SELECT p.l_suppkey, target, arg_min(CASE WHEN q0 IS NULL OR score <= s0 THEN quality ELSE q0 + (target - s0) / (score - s0) * (quality - q0) END, quality) AS crossing
  FROM p JOIN (SELECT DISTINCT target FROM g) d ON score >= target GROUP BY p.l_suppkey, target)
SELECT g.l_suppkey, g.target, round(m.crossing, 6) AS crossing FROM g LEFT JOIN m ON g.l_suppkey = m.l_suppkey AND g.target = m.target"""


def _crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    c = rows.groupBy("l_suppkey", F.col("l_quantity").alias("quality")).agg(F.round(F.avg("l_extendedprice") / 500.0, 4).alias("score"))
    return seeds.crossings(c, _TARGETS, ["l_suppkey"]).withColumn("crossing", F.round("crossing", 6))


@query("calibrate_crossing", _CROSSING)
def calibrate_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crossed(spark, sf_dir)


@query(
    "calibrate_fit",
    f"""SELECT target, round(coalesce(quantile_cont(crossing, 0.5), 50), 6) AS quality, round(coalesce(quantile_cont(crossing, 0.25), 50), 6) AS low, round(coalesce(quantile_cont(crossing, 0.75), 50), 6) AS high,
    count(crossing) AS hits, count(*) - count(crossing) AS unreachable FROM ({_CROSSING}) x GROUP BY target""",
)
def calibrate_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seeds.fit(_crossed(spark, sf_dir), [], 50.0)
    return out.select("target", *[F.round(c, 6).alias(c) for c in ("quality", "low", "high")], "hits", "unreachable")


@query(
    "calibrate_merge",
    f"""WITH c AS (SELECT f AS format, t AS tier, CAST(a AS DOUBLE) AS target, CAST(b AS DOUBLE) AS quality FROM (VALUES {_POINTS}) AS u(f, t, a, b, c, d)), f AS (SELECT 'avif' AS format, 'native' AS tier, CAST(n_nationkey AS DOUBLE) AS target, CAST(n_regionkey AS DOUBLE) AS quality FROM nation)
    SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.format = c.format AND f.tier = c.tier) UNION ALL SELECT * FROM f""",
)
def calibrate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    fitted = n.select(F.lit("avif").alias("format"), F.lit("native").alias("tier"), F.col("n_nationkey").cast("double").alias("target"), F.col("n_regionkey").cast("double").alias("quality"))
    return seeds.merged(fitted, curves(spark).select("format", "tier", "target", "quality"), ["format", "tier"])


@query(
    "search_settings",
    """SELECT CAST(i AS BIGINT) AS i, CASE WHEN i % 7 = 0 THEN 'target must be finite' WHEN i % 5 = 0 THEN 'tolerance must be finite and not negative' WHEN i % 3 = 0 THEN 'at least one trial is needed' WHEN i % 11 = 1 THEN 'range must lie in the axis, floor first'
    WHEN i % 13 = 2 THEN 'seed must be finite' WHEN i % 17 = 3 THEN 'step must be finite and positive' END AS problem FROM range(2000) t(i)""",
)
def search_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    bad = lambda n, k, worse, good: F.when(i % n == k, F.lit(worse)).otherwise(F.lit(good))
    p = search.problem(bad(7, 0, float("nan"), 70.0), bad(5, 0, -1.0, 1.0), bad(3, 0, 0, 6), bad(11, 1, 90.0, 1.0), F.lit(80.0), bad(13, 2, float("inf"), 50.0), bad(17, 3, 0.0, 5.0))
    return spark.range(2000).select(F.col("id").alias("i")).select("i", p.alias("problem"))
