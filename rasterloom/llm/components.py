"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm._session import half, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to its least one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", half("a"), F.least("a", "least").alias("least"))
    out = both.filter("b > a").select("*", half("a")).join(least, ["a", "half"]).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours, and itself, to the least of them. edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    linked = edges.select("*", half("a")).join(least.select("*", half("a")), ["a", "half"]).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return linked.unionByName(least.withColumnRenamed("least", "b")).filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every vertex that edges (a, b: long) name; root: its component's least id.

    Loops and repeated edges don't matter; edges with a null end are ignored; an empty table
    gives an empty result. Rounds grow with the logarithm of the longest path; a RuntimeError
    says that they didn't suffice. Each round is saved. A vertex of very many edges is split over tasks.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    now = saved(now)
    before = None
    for _ in range(rounds):
        now = saved(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("b").alias("id")).distinct().withColumn("root", F.col("id"))
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
        before = state
    raise RuntimeError("components: more rounds are needed")
