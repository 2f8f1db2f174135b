"""Geometry examples and properties that the tables don't reach."""

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G

BIG = 2**32 - 1


def fit(spark, w, h, bw, bh, how="inside", position="center", enlarge=False):
    long = lambda v: F.lit(v).cast("long")
    g = G.fit(long(w), long(h), long(bw), long(bh), how=F.lit(how), position=F.lit(position), enlarge=F.lit(enlarge))
    return spark.range(1).select(g.alias("g")).first()["g"]


@pytest.mark.parametrize(
    ("args", "size"),
    [((4000, 3000, 1600, None), (1600, 1200)), ((300, 200, 100, None), (100, 67)), ((10000, 3, 10, None), (10, 1)), ((4000, 3000, 1000, 1000, "outside"), (1333, 1000)), ((BIG, BIG, 10, 10), (10, 10)), ((2, 1, BIG, BIG, "inside", "center", True), (BIG, 2147483648)), ((1, 2, BIG, None, "inside", "center", True), (BIG, BIG))],
)
def test_sizes(spark, args, size):
    g = fit(spark, *args)
    assert (g["width"], g["height"]) == size


def test_crops_and_canvases(spark):
    g = fit(spark, 800, 600, 400, 400, "cover")
    assert tuple(g["crop"]) == (100.0, 0.0, 600.0, 600.0) and (g["width"], g["height"]) == (400, 400)
    g = fit(spark, 600, 600, 1000, 500, "cover")
    assert g["crop"]["top"] == 150 and (g["width"], g["height"]) == (600, 300)
    g = fit(spark, 800, 600, 400, 400, "contain")
    assert (g["width"], g["height"]) == (400, 300) and (g["canvas"]["x"], g["canvas"]["y"]) == (0, 50)
    assert tuple(fit(spark, 100, 50, 400, 400, "contain")["canvas"])[2:] == (150, 175)


def test_nothing_to_do(spark):
    assert fit(spark, 100, 100, 200, 200) is None
    assert fit(spark, 100, 100, None, None) is None
    assert fit(spark, None, 100, 50, 50) is None
    factor = spark.range(4).select(G.scale(F.lit(10).cast("long"), F.lit(10).cast("long"), F.element_at(F.array(F.lit(float("nan")), F.lit(0.0), F.lit(2.0), F.lit(0.5)), F.col("id").cast("int") + 1), F.lit(False)).alias("g")).collect()
    assert [r["g"] and r["g"]["width"] for r in factor] == [None, None, None, 5]


@pytest.mark.parametrize("how", G.FITS)
@pytest.mark.parametrize("enlarge", [True, False])
def test_fits_by_row_equal_fits_by_name(spark, how, enlarge):
    rows = spark.range(200).select((1 + F.col("id") * 37 % 500).alias("w"), (1 + F.col("id") * 91 % 400).alias("h"), F.when(F.col("id") % 9 > 0, F.lit(220)).cast("long").alias("bw"), F.lit(140).cast("long").alias("bh"), F.lit(how).alias("how"), F.lit("bottom-right").alias("at"))
    args = [F.col(c) for c in ("w", "h", "bw", "bh")]
    one = G.fit(*args, how=how, position="bottom-right", enlarge=F.lit(enlarge))
    each = G.fit(*args, how=F.col("how"), position=F.col("at"), enlarge=F.lit(enlarge))
    assert rows.filter(~one.eqNullSafe(each)).count() == 0


def test_inside_never_leaves_the_box(spark):
    rows = spark.range(5000).select((1 + F.pmod(F.xxhash64("id"), F.lit(5000))).alias("w"), (1 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000))).alias("h"), (1 + F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3000))).alias("bw"), (1 + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3000))).alias("bh"))
    w, h = G.inside(F.col("w"), F.col("h"), F.col("bw"), F.col("bh"), F.lit(True))
    assert rows.filter((w > F.col("bw")) | (h > F.col("bh"))).count() == 0


def test_problems(spark):
    none = F.lit(None)
    cases = [(F.lit(0), F.lit(5), none.cast("double"), F.lit("inside")), (F.lit(5), none.cast("int"), none.cast("double"), F.lit("cover")), (F.lit(5), F.lit(5), F.lit(-1.0), F.lit("inside")), (F.lit(5), none.cast("int"), none.cast("double"), F.lit("inside"))]
    got = spark.range(1).select(*[G.problem(*c).alias(f"c{i}") for i, c in enumerate(cases)]).first()
    assert list(got) == ["a bound must be at least one pixel", "fit cover needs both sides", "factor must be a positive number", None]
