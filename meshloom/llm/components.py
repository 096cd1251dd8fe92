"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators.skew import looked_up

from .storage import materialize


def _stars(edges: DataFrame, count: int) -> DataFrame:
    """One large-star and one small-star step over ``count`` (a, b) rows with a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("k"))
    large = looked_up(both, least, "a", 2 * count).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    large = materialize(large, "cc-large")  # used three times
    down = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k"))
    small = looked_up(large, down, "a", count).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(down.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node it reaches.

    Rounds go on until one changes nothing; each is written to the shared folder, so
    a lost executor repeats one round at most.  Nulls and loops are ignored."""
    measure = [F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-0")
    last, state = None, now.agg(*measure).first()
    while state != last:
        now = materialize(_stars(now, state[0]), "cc")
        last, state = state, now.agg(*measure).first()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
