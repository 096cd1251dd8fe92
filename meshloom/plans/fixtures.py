"""Meshes, graphs and logs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.operators.iterate import written
from meshloom.sources.generators import cells_of, lattice_edges
from meshloom.sources.tables import load

PARTS = 8


def points(spark: SparkSession, sf: str) -> DataFrame:
    """(v, x, y, z): the first three embedding dimensions."""
    e = load(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("v"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def width(spark: SparkSession, sf: str) -> int:
    """The least w with w**3 >= count(orders)."""
    n, w = load(spark, sf, "orders").count(), 1
    while w**3 < n:
        w += 1
    return w


def ids(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(F.col("o_orderkey").alias("e"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return cells_of(ids(spark, sf), width(spark, sf))


def lattice(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the orders lattice."""
    own = ids(spark, sf)
    return own.select(F.col("e").alias("v")), lattice_edges(own, width(spark, sf))


def octree_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with six neighbour tags, null at the border of the lattice; a tag may lack its row."""
    w = width(spark, sf)
    i, j, k = F.expr(f"e div {w * w}"), F.expr(f"(e div {w}) % {w}"), F.expr(f"e % {w}")
    near = [F.when(axis > 0, F.col("e") - d) for axis, d in ((i, w * w), (j, w), (k, 1))] + [F.when(axis < w - 1, F.col("e") + d) for axis, d in ((i, w * w), (j, w), (k, 1))]
    return ids(spark, sf).select("e", F.array(*near).alias("neigh"))


def copurchase(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): parts on consecutive lines of an order; edges are written once, as all that follows reads them several times."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    a = li.select("l_orderkey", F.col("l_partkey").alias("p"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    pairs = a.join(li, ["l_orderkey", "l_linenumber"]).where(F.col("p") != F.col("l_partkey"))
    edges = written(pairs.select(F.least("p", "l_partkey").alias("u"), F.greatest("p", "l_partkey").alias("v")).distinct(), "copurchase")
    vertices = edges.select(F.col("u").alias("v")).union(edges.select("v")).distinct()
    return vertices, edges


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """(mesh_idx, np, run_idx, time): a log-shaped view of lineitem; times are whole."""
    li = load(spark, sf, "lineitem")
    return li.select(
        (F.col("l_suppkey") % 10).cast("long").alias("mesh_idx"), F.pow(F.lit(2.0), (F.col("l_partkey") % 5).cast("double")).cast("long").alias("np"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_idx"), F.round(F.col("l_extendedprice")).cast("long").alias("time"),
    )


def block_seeds(vertices: DataFrame, parts: int = PARTS) -> DataFrame:
    from meshloom.operators.labelling import seeds_along

    return seeds_along(vertices, ["v"], parts)


def key_labels(vertices: DataFrame, parts: int = PARTS) -> DataFrame:
    """(v, label): equal blocks in key order."""
    from meshloom.operators.ordering import block_labels

    return block_labels(vertices, ["v"], parts).select("v", "label")
