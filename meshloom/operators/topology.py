"""Connectivity of meshes: incidences, face and node adjacency, ghosts, CSR."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .iterate import symmetric
from .ordering import global_index

PER_TASK = 1 << 20  # incidences of a task


def tasks_for(rows: DataFrame, per: int | None = None) -> int:
    """Shuffle partitions, or as many more as leave a task ``per`` rows, so that its memory doesn't grow with the input."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // (per or PER_TASK)))


def incidence(elements: DataFrame, column: str, out: str) -> DataFrame:
    """(e, out): one row per element and entry of an array column."""
    return elements.select("e", F.explode(column).alias(out))


def faces(incident: DataFrame) -> DataFrame:
    """(face, a, b, n): least and greatest element and the number of elements on each face.

    Minimum, maximum and count combine on the map side, so one shuffle of partial
    rows replaces a self-join.  A third element on a face is an error."""
    found = incident.groupBy("face").agg(F.min("e").alias("a"), F.max("e").alias("b"), F.count(F.lit(1)).alias("n"))
    return found.where(F.when(F.col("n") > 2, F.raise_error(F.lit("a face with more than two elements"))).otherwise(F.lit(True)))


def face_edges(incident: DataFrame) -> DataFrame:
    return faces(incident).where("n = 2").select(F.col("a").alias("u"), F.col("b").alias("v"))


def boundary_faces(incident: DataFrame) -> DataFrame:
    return faces(incident).where("n = 1").select(F.col("a").alias("e"), "face")


def node_edges(incident: DataFrame) -> DataFrame:
    """Pairs of elements that share a node.

    Nodes are dealt by ranges of their tags, where elements that share several nodes meet in one task, so that most
    repeated pairs go before the shuffle of pairs.  Only incidences are shuffled before; a node holds a list of its elements."""
    near = incident.repartitionByRange(tasks_for(incident), "node").groupBy("node").agg(F.collect_list("e").alias("l"))
    pairs = near.select(F.explode("l").alias("u"), "l").select("u", F.explode(F.filter("l", lambda x: x > F.col("u"))).alias("v"))
    return pairs.distinct()


def neighbor_edges(cells: DataFrame, tags: DataFrame) -> DataFrame:
    """Edges of cells with neighbour lists; nulls are borders and unknown tags are dropped."""
    listed = cells.select("e", F.explode("neigh").alias("w")).where("w is not null")
    return listed.join(tags.select(F.col("e").alias("w")), "w").select(F.least("e", "w").alias("u"), F.greatest("e", "w").alias("v")).distinct()


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    arcs = symmetric(edges).groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    return vertices.join(arcs, vertices.v == arcs.src, "left").select("v", F.coalesce("k", F.lit(0)).cast("long").alias("degree"))


def csr_offsets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, degree, offset): exclusive sum of degrees in the order of v, in two phases."""
    indexed = global_index(degrees(vertices, edges), ["v"], "_pos")
    per = 1 << 16
    dealt = indexed.withColumn("_g", F.floor(F.col("_pos") / per))
    groups = dealt.groupBy("_g").agg(F.sum("degree").alias("_gk"))
    before = groups.select("_g", (F.sum("_gk").over(W.orderBy("_g")) - F.col("_gk")).alias("_gb"))
    inner = F.sum("degree").over(W.partitionBy("_g").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) - F.col("degree")
    return dealt.withColumn("_in", inner).join(before, "_g").select("v", "degree", (F.col("_gb") + F.col("_in")).alias("offset"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, neighbors): ascending, comma-joined."""
    return symmetric(edges).groupBy(F.col("src").alias("v")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string"))).alias("neighbors"))


def labelled_arcs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, ls, ld)."""
    arcs = symmetric(edges)
    ls, ld = labels.select(F.col("v").alias("src"), F.col("label").alias("ls")), labels.select(F.col("v").alias("dst"), F.col("label").alias("ld"))
    return arcs.join(ls, "src").join(ld, "dst")


def ghosts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, owner, v): remote endpoints of each part."""
    return labelled_arcs(edges, labels).where("ls <> ld").select(F.col("ls").alias("part"), F.col("ld").alias("owner"), F.col("dst").alias("v")).distinct()


def scatter_map(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, target, v): own vertices to send to each other part."""
    return ghosts(edges, labels).select(F.col("owner").alias("part"), F.col("part").alias("target"), "v")


def node_owners(incident: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, owner, node_idx): the least label at a node owns it; nodes are numbered by owner and tag."""
    parts = tasks_for(incident)
    labelled = incident.repartition(parts, "e").join(labels.select(F.col("v").alias("e"), "label").repartition(parts, "e"), "e")
    owned = labelled.groupBy("node").agg(F.min("label").alias("owner"))
    return global_index(owned, ["owner", "node"], "node_idx")


def node_means(incident: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(e, columns): the means of an element's nodes' values; ``nodes``: (node, columns)."""
    parts = tasks_for(incident)
    joined = incident.repartition(parts, "node").join(nodes.repartition(parts, "node"), "node")
    return joined.groupBy("e").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
