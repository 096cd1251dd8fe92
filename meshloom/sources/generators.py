"""Structured grids and point clouds from ``range``: no input, any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Corner offsets of a hexahedral cell and the corners of its six faces.  Fixed values.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))
FACES = ((0, 3, 2, 1), (0, 1, 5, 4), (0, 4, 7, 3), (1, 2, 6, 5), (2, 3, 7, 6), (4, 5, 6, 7))


def cells_of(ids: DataFrame, width: int) -> DataFrame:
    """(e, i, j, k, node_tags, faces) of hexahedral cells; ``ids`` has e, the row-major number on a width**3 lattice."""
    w, q = width, width + 1
    placed = ids.select("e", F.expr(f"e div {w * w}").alias("i"), F.expr(f"(e div {w}) % {w}").alias("j"), F.expr(f"e % {w}").alias("k"))
    node = [(F.col("i") + a) * (q * q) + (F.col("j") + b) * q + (F.col("k") + c) for a, b, c in CORNERS]
    return placed.select("e", "i", "j", "k", F.array(*node).alias("node_tags"), F.array(*[F.array_sort(F.array(*[node[c] for c in face])) for face in FACES]).alias("faces"))


def hex_grid(spark: SparkSession, n: int) -> DataFrame:
    return cells_of(spark.range(n**3).select(F.col("id").alias("e")), n)


def lattice_edges(ids: DataFrame, width: int) -> DataFrame:
    """(u, v) of the 6-neighbour lattice among existing rows; an offset is an edge only inside its line."""
    w = width
    right = [(F.expr(f"e % {w} < {w - 1}"), 1), (F.expr(f"(e div {w}) % {w} < {w - 1}"), w), (F.expr(f"e div {w * w} < {w - 1}"), w * w)]
    pairs = ids.select(F.col("e").alias("u"), F.explode(F.filter(F.array(*[F.when(ok, F.col("e") + d) for ok, d in right]), lambda x: x.isNotNull())).alias("v"))
    return pairs.join(ids.select(F.col("e").alias("v")), "v", "left_semi").select("u", "v")


def square_grid(spark: SparkSession, n: int, diagonal: bool = False) -> DataFrame:
    """(u, v) of an n x n grid with 4 or 8 neighbours a cell."""
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    cell = spark.range(n * n).select((F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j"))
    moved = cell.select("i", "j", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])).alias("s"))
    to = moved.select((F.col("i") * n + F.col("j")).alias("u"), (F.col("i") + F.col("s.a")).alias("x"), (F.col("j") + F.col("s.b")).alias("y"))
    return to.where((F.col("x") < n) & (F.col("y") >= 0) & (F.col("y") < n)).select("u", (F.col("x") * n + F.col("y")).alias("v"))


def random_points(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return spark.range(n).select(F.col("id"), *[F.rand(seed + k).alias(c) for k, c in enumerate("xyz")])
