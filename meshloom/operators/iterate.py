"""Driver loops over DataFrames: the state is a table, a round is a plan.

Every round is written below spark.checkpoint.dir, which cuts the lineage and
survives lost executors; how many rows it added or changed is observed by the write
itself.  Loops end when a round changes nothing; none has a limit of rounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .skew import looked_up

SCOPE = "spark.meshloom.scratch"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder (our own below /tmp only in local mode without one)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/meshloom/{spark.conf.get(SCOPE, '')}{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scope at whose end all tables that its loops wrote are deleted: what is needed later must be written elsewhere inside it."""
    outer = spark.conf.get(SCOPE, "")
    inner = f"{outer}scope-{uuid.uuid4().hex}/"
    spark.conf.set(SCOPE, inner)
    root = new_path(spark, "x").rsplit("/", 1)[0]
    try:
        yield root
    finally:
        spark.conf.set(SCOPE, outer)
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str = "state") -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, path: str, count: Column | None = None) -> int:
    """Writes ``df`` and returns an aggregate of what was written, its number of rows unless told otherwise."""
    seen = Observation()
    df.observe(seen, F.coalesce(F.count(F.lit(1)) if count is None else count, F.lit(0)).alias("n")).write.parquet(path)
    return int(seen.get.get("n") or 0)


class Layers:
    """Tables of successive rounds in one folder; the round is a folder column, so all are read as one table."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.root, self.rounds, self.rows = spark, new_path(spark, label), 0, 0

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/round={self.rounds}"
        self.rows = counted(df, path)
        self.rounds += 1
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(StructType(self.schema.fields).add("round", "integer")).parquet(self.root)


@contextmanager
def held(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` partitioned and sorted by ``key`` and kept by the executors, so that no round shuffles or sorts it again; lost parts are made anew."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], stop: Callable[[DataFrame], bool] = lambda _: False) -> DataFrame:
    """Applies ``step`` until no row has ``changed``, or ``stop`` says so of a round's table; the state has a boolean column ``changed``."""
    spark, changed, now = state.sparkSession, 1, written(state)
    while changed and not stop(now):
        new, path = step(now), new_path(state.sparkSession, "round")
        changed = counted(new, path, F.count_if("changed"))
        now = spark.read.schema(new.schema).parquet(path)
    return now.drop("changed")


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions from undirected (u, v)."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(edges.select(F.col("v"), F.col("u")))


def bfs(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(v, label, dist): the lexicographic minimum of (distance, label) over the seeds (v, label).

    Frontier only: in an undirected graph the neighbours of a layer lie in it, in
    the one before and in the one after, so a round's anti-join is against two
    layers, never against everything reached.  Arcs are partitioned by their source
    once and kept; a round shuffles its frontier (or broadcasts it while Spark finds
    it small) and what it reaches."""
    layers = Layers(edges.sparkSession, "layers")
    with held(symmetric(edges), "src") as arcs:
        frontier = layers.add(seeds.groupBy("v").agg(F.min("label").alias("label")))
        recent = frontier.select("v")
        while layers.rows:
            reached = arcs.join(frontier, arcs.src == frontier.v).groupBy(F.col("dst").alias("v")).agg(F.min("label").alias("label"))
            before, frontier = frontier, layers.add(reached.join(recent, "v", "left_anti"))
            recent = frontier.select("v").union(before.select("v"))
    return layers.table().select("v", "label", F.col("round").alias("dist"))


def relax(edges: DataFrame, state: DataFrame, cost: DataFrame | None = None) -> DataFrame:
    """(v, label, dist) after relaxation to rest: a vertex takes the least (dist, label) that its neighbours offer.

    A hop costs 1, or the ``step`` of its label in ``cost`` (label, step), which has a
    row per part.  Only rows that the last round changed make offers."""

    def step(s: DataFrame) -> DataFrame:
        sender = s.where("changed")
        if cost is not None:
            sender = sender.join(F.broadcast(cost), "label").select("v", "label", (F.col("dist") + F.col("step")).alias("dist"))
        else:
            sender = sender.select("v", "label", (F.col("dist") + 1).alias("dist"))
        offers = sender.join(arcs, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "label", "dist", F.lit(False).alias("own"))
        every = s.select("v", "label", "dist", F.lit(True).alias("own")).union(offers)
        at = F.struct("dist", "label")
        least = every.groupBy("v").agg(F.min(at).alias("m"), F.min(F.when(F.col("own"), at)).alias("old"))
        return least.select("v", "m.label", "m.dist", F.coalesce(F.col("m") < F.col("old"), F.lit(True)).alias("changed"))

    with held(symmetric(edges), "src") as arcs:
        return fixpoint(state.select("v", "label", "dist", F.lit(True).alias("changed")), step)


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex of each component, by minimum labels with pointer jumping.

    The jump looks up the component of a component; one of them may hold all vertices."""
    n = vertices.count()

    def step(s: DataFrame) -> DataFrame:
        sent = s.join(arcs, s.v == arcs.src).select(F.col("dst").alias("v"), "component", F.lit(None).cast("long").alias("old"))
        low = s.select("v", "component", F.col("component").cast("long").alias("old")).union(sent).groupBy("v").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        up = s.select(F.col("v").alias("component"), F.col("component").alias("higher"))  # the jump takes the last round's labels
        table = low.groupBy("component").agg(F.count(F.lit(1)).alias("k")).join(up, "component")
        jumped = looked_up(low, table, "component", n).select("v", F.least("component", "higher").alias("component"), "old")
        return jumped.select("v", "component", (F.col("component") < F.col("old")).alias("changed"))

    with held(symmetric(edges), "src") as arcs:
        return fixpoint(vertices.select("v", F.col("v").alias("component"), F.lit(True).alias("changed")), step)


def is_connected(vertices: DataFrame, edges: DataFrame) -> bool:
    return connected_components(vertices, edges).select("component").distinct().limit(2).count() <= 1
