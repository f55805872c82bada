"""Connected components of an edge table by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v: neighbours move to the smallest neighbour."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(u, v): each vertex of edges(a, b) but the smallest of its component, with that smallest vertex."""
    spark = edges.sparkSession
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, "edges0")
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before, turn = state(now), 0
    while before[0]:
        turn += 1
        after = materialise(star(star(now, True), False), folder, f"edges{turn}")
        discard(spark, folder, f"edges{turn - 1}")
        now, last, before = after, before, state(after)
        if before == last:
            break
    return now
