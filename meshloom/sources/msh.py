"""Gmsh text meshes (MSH 2.2 and 4.1 ASCII), read and written by many tasks.

A mesh is a document of numbered lines (``lines.numbered_lines``).  Sections are ranges
of lines between markers, of which a file has a few.  In MSH 4.1 a section is a chain of
blocks, each of which tells where the next one begins; the chain is followed by pointer
jumping, and lines meet the header of their block by equi-joins on runs of lines.

Defined results: lines outside of known sections are ignored, as are blank ones in
MSH 2.2; a malformed number is null; a binary mesh is an error; several meshes are told apart by ``path``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.operators.iterate import written

from .lines import numbered_lines, numbers, write_document

#: Nodes of an element by Gmsh type, and the local corners of its faces.  Fixed values of the format.
NODES_OF = {1: 2, 2: 3, 3: 4, 4: 4, 5: 8, 6: 6, 7: 5, 15: 1}
FACES_OF = {4: ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)), 5: ((0, 3, 2, 1), (0, 1, 5, 4), (0, 4, 7, 3), (1, 2, 6, 5), (2, 3, 7, 6), (4, 5, 6, 7))}
RUN = 4096


class Mesh:
    """The sections of the meshes at a path as tables; each is parsed when it is asked for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.lines = written(numbered_lines(spark, path).withColumn("w", F.filter(F.split("value", r"\s+"), lambda x: x != "")), "mesh-lines")
        marks = self.lines.where("value like '$%'").select("doc", "at", F.trim("value").alias("mark"))  # two a section
        ends = F.lead("at").over(W.partitionBy("doc").orderBy("at"))
        self.sections = written(marks.withColumn("end", ends).where("mark not like '$End%'").select("doc", F.expr("substring(mark, 2)").alias("section"), F.col("at").alias("begin"), "end"), "mesh-sections")
        head = self._body("MeshFormat").where("place = 0").select("doc", F.get("w", F.lit(0)).try_cast("double").alias("version"), F.get("w", F.lit(1)).alias("kind"))
        head = written(head, "mesh-formats")  # a row per file
        if not head.where("kind <> '0'").isEmpty():
            raise ValueError("binary meshes are not supported")
        self.versions = head.drop("kind")

    def _body(self, section: str) -> DataFrame:
        """(doc, place, w): the lines of a section, counted from 0 within it.

        Sections, a row for each of a file, are sent to the lines: by name all lines of a file would meet in one task."""
        s = self.sections.where(F.col("section") == section).drop("section")
        return self.lines.join(F.broadcast(s), "doc").where("at > begin and (end is null or at < end)").select("doc", (F.col("at") - F.col("begin") - 1).alias("place"), "w")

    def _split(self, section: str) -> tuple[DataFrame, DataFrame]:
        """The section's lines after its first one, of MSH 2 and of MSH 4."""
        body = self._body(section).where("place > 0").join(F.broadcast(self.versions), "doc")
        return body.where("version < 4 and size(w) > 0").drop("version"), body.where("version >= 4").drop("version")

    def nodes(self) -> DataFrame:
        """(path, node_tag, x, y, z)."""
        flat, blocked = self._split("Nodes")
        flat = flat.select(F.col("doc").alias("path"), _long("w", 0).alias("node_tag"), *[_double("w", k + 1).alias(c) for k, c in enumerate("xyz")])
        inside = _in_blocks(blocked, 2)
        tags = inside.where("k < n").select("doc", "head", "k", _long("w", 0).alias("node_tag"))
        places = inside.where("k >= n").select("doc", "head", (F.col("k") - F.col("n")).alias("k"), *[_double("w", i).alias(c) for i, c in enumerate("xyz")])
        return flat.union(tags.join(places, ["doc", "head", "k"]).select("doc", "node_tag", "x", "y", "z"))

    def elements(self) -> DataFrame:
        """(path, element_tag, etype, node_tags)."""
        flat, blocked = self._split("Elements")
        tags = F.transform("w", lambda x: x.try_cast("long"))
        flat = flat.withColumn("t", tags).select(F.col("doc").alias("path"), F.get("t", F.lit(0)).alias("element_tag"), F.get("t", F.lit(1)).cast("int").alias("etype"), F.expr("slice(t, cast(greatest(1, 4 + coalesce(get(t, 2), 0)) as int), size(t))").alias("node_tags"))
        inside = _in_blocks(blocked, 1).withColumn("t", tags)
        return flat.union(inside.select("doc", F.get("t", F.lit(0)), F.col("third").cast("int"), F.expr("slice(t, 2, size(t))")))

    def entities(self) -> DataFrame:
        """(path, dim, tag, physical, boundary): the entities of MSH 4.1, with the physical groups they belong to and the entities that bound them, with signs."""
        body = self._body("Entities")
        counts = body.where("place = 0").select("doc", F.transform("w", lambda x: x.try_cast("long")).alias("c"))
        rows = body.where("place > 0 and size(w) > 0").join(F.broadcast(counts), "doc")
        upto = [F.expr("+".join(f"get(c, {i})" for i in range(d + 1))) for d in range(4)]
        dim = F.when(F.col("place") <= upto[0], 0).when(F.col("place") <= upto[1], 1).when(F.col("place") <= upto[2], 2).otherwise(3)
        rows = rows.withColumn("dim", dim).withColumn("at", F.when(F.col("dim") == 0, 4).otherwise(7))  # after a point's three coordinates, or a box's six
        longs = lambda from_, n: F.transform(F.slice("w", from_, F.greatest(F.lit(0), n)), lambda x: x.try_cast("long"))
        count = lambda at: F.coalesce(F.get("w", at).try_cast("int"), F.lit(0))
        rows = rows.withColumn("n", count(F.col("at"))).withColumn("m", F.when(F.col("dim") > 0, count(F.col("at") + 1 + F.col("n"))).otherwise(0))
        return rows.select(F.col("doc").alias("path"), "dim", _long("w", 0).alias("tag"), longs(F.col("at") + 2, F.col("n")).alias("physical"), longs(F.greatest(F.lit(1), F.col("at") + 3 + F.col("n")), F.col("m")).alias("boundary"))

    def physical_names(self) -> DataFrame:
        """(path, dim, tag, name)."""
        named = self._body("PhysicalNames").where("place > 0 and size(w) > 2")
        name = F.regexp_extract(F.array_join(F.slice("w", F.lit(3), F.greatest(F.lit(0), F.size("w") - 2)), " "), '^"(.*)"$', 1)
        return named.select(F.col("doc").alias("path"), F.get("w", F.lit(0)).try_cast("int").alias("dim"), _long("w", 1).alias("tag"), name.alias("name"))


def _long(c: str, k: int) -> Column:
    return F.get(c, F.lit(k)).try_cast("long")


def _double(c: str, k: int) -> Column:
    return F.get(c, F.lit(k)).try_cast("double")


def _in_blocks(body: DataFrame, lines_each: int) -> DataFrame:
    """(doc, head, third, n, k, w): the k-th line of every block of n entries, ``lines_each`` lines an entry, and the header's third number.

    A line of four whole numbers may be a header; it is one if the chain of blocks from
    the section's first one comes by.  Each round doubles the reach."""
    body = written(body, "mesh-body")  # read by each step below; joined anew it would be found among all lines every time
    whole = r"^-?\d+$"
    maybe = F.forall("w", lambda x: x.rlike(whole)) & (F.size("w") == 4)
    jump = written(body.where(maybe).select("doc", "place", (F.col("place") + 1 + lines_each * _long("w", 3)).alias("next")), "mesh-jumps")
    heads = body.where("place = 1").select("doc", "place")
    known, before = written(heads, "mesh-heads"), -1
    while (now := known.count()) != before:
        before = now
        further = known.join(jump, ["doc", "place"]).select("doc", F.col("next").alias("place"))
        known = written(known.union(further).distinct(), "mesh-heads")
        onward = jump.select("doc", F.col("place").alias("next"), F.col("next").alias("_after"))
        jump = written(jump.join(onward, ["doc", "next"]).select("doc", "place", F.col("_after").alias("next")), "mesh-jumps")
    heads = body.join(known, ["doc", "place"]).where("size(w) = 4").select("doc", F.col("place").alias("head"), _long("w", 2).alias("third"), _long("w", 3).alias("n"))
    runs = heads.withColumn("run", F.explode(F.sequence(F.expr(f"(head + 1) div {RUN}"), F.expr(f"(head + {lines_each} * n) div {RUN}"))))
    inside = body.withColumn("run", F.expr(f"place div {RUN}")).join(runs, ["doc", "run"]).where(f"place > head and place <= head + {lines_each} * n")
    return inside.select("doc", "head", "third", "n", (F.col("place") - F.col("head") - 1).alias("k"), "w")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements) of the mesh files at ``path``."""
    mesh = Mesh(spark, path)
    return mesh.nodes(), mesh.elements()


def write_mesh(nodes: DataFrame, elements: DataFrame, path: str, version: str = "4.1") -> None:
    """Writes nodes (node_tag, x, y, z) and elements (element_tag, etype, node_tags) as a document in parts: one block of nodes, and one of elements for each type."""
    spark = nodes.sparkSession
    line = lambda at, text: spark.createDataFrame([(at, 0, 0, text)], "section int, block long, k long, line string")
    row = lambda at, block, k, text: (F.lit(at).alias("section"), block.cast("long").alias("block"), k.cast("long").alias("k"), text.alias("line"))
    zero, n = F.lit(0), nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("node_tag"), F.lit(0)).alias("low"), F.coalesce(F.max("node_tag"), F.lit(0)).alias("high"))
    total = elements.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("etype").alias("types"), F.coalesce(F.min("element_tag"), F.lit(0)).alias("low"), F.coalesce(F.max("element_tag"), F.lit(0)).alias("high"))
    place = numbers(F.col("x"), F.col("y"), F.col("z"))
    if version == "4.1":
        parts = [
            n.select(*row(2, zero, F.lit(-2), numbers(F.least(F.lit(1), "n"), F.col("n"), F.col("low"), F.col("high")))), n.where("n > 0").select(*row(2, zero, F.lit(-1), numbers(F.lit(3), F.lit(1), zero, F.col("n")))),
            nodes.select(*row(2, zero, F.col("node_tag"), F.col("node_tag").cast("string"))), nodes.select(*row(2, F.lit(1), F.col("node_tag"), place)),
            total.select(*row(5, F.lit(-1), zero, numbers(F.col("types"), F.col("n"), F.col("low"), F.col("high")))),
            elements.groupBy("etype").agg(F.count(F.lit(1)).alias("n")).select(*row(5, F.col("etype"), F.lit(-1), numbers(F.lit(3), F.lit(1), F.col("etype"), F.col("n")))),
            elements.select(*row(5, F.col("etype"), F.col("element_tag"), F.concat_ws(" ", F.col("element_tag").cast("string"), F.col("node_tags").cast("array<string>")))),
        ]
    else:
        parts = [
            n.select(*row(2, zero, F.lit(-1), F.col("n").cast("string"))), nodes.select(*row(2, zero, F.col("node_tag"), numbers(F.col("node_tag"), F.col("x"), F.col("y"), F.col("z")))),
            total.select(*row(5, F.lit(-1), zero, F.col("n").cast("string"))),
            elements.select(*row(5, zero, F.col("element_tag"), F.concat_ws(" ", numbers(F.col("element_tag"), F.col("etype"), F.lit(2), F.lit(1), F.lit(1)), F.col("node_tags").cast("array<string>")))),
        ]
    out = line(0, f"$MeshFormat\n{version} 0 8\n$EndMeshFormat\n$Nodes")
    for more in [*parts, line(4, "$EndNodes\n$Elements"), line(7, "$EndElements")]:
        out = out.union(more)
    write_document(out, ["section", "block", "k"], path)


def element_type(elements: DataFrame) -> int:
    """The one 3-D element type, 4 or 5; other meshes are errors."""
    found = [r[0] for r in elements.where(F.col("etype").isin(4, 5)).select("etype").distinct().collect()]  # two rows at most
    if len(found) != 1:
        raise ValueError(f"exactly one type of 3-D element is needed, found {sorted(found)}")
    return found[0]


def element_rows(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(e, x, y, z, node_tags, faces): centroids and sorted face keys of the 3-D elements."""
    etype = element_type(elements)
    solid = elements.where(F.col("etype") == etype)
    spread = solid.select(F.col("element_tag").alias("e"), F.explode("node_tags").alias("node_tag"))
    centre = spread.join(nodes, "node_tag").groupBy("e").agg(*[F.avg(c).alias(c) for c in "xyz"])
    faces = F.array(*[F.array_sort(F.array(*[F.get("node_tags", F.lit(i)) for i in f])) for f in FACES_OF[etype]])
    return solid.select(F.col("element_tag").alias("e"), "node_tags", faces.alias("faces")).join(centre, "e").select("e", "x", "y", "z", "node_tags", "faces")


def grain_processes(elements: int, grain: int) -> int:
    return elements // grain
