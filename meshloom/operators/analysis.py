"""Analysis of run logs: best runs, scaling, filters, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import global_index
from .skew import looked_up


def best_of(runs: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows with their group's least value; ties stay.

    The minimum combines on the map side; rows meet it on group and value, so a group's rows don't."""
    best = runs.groupBy(*group).agg(F.min(value).alias(value))
    return runs.join(best, [*group, value], "left_semi")


def best_first(runs: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """One row per group, the first in ``order``; equal rows are one."""
    rest = [c for c in runs.columns if c not in {*group, *order}]
    least = runs.groupBy(*group).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return least.select(*[F.col(c) if c in group else F.col(f"m.{c}").alias(c) for c in runs.columns])


def best_by_value(runs: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value): the least value of each group."""
    return runs.groupBy(*group).agg(F.min(value).alias(value))


def of_run(runs: DataFrame, run: int = 0) -> DataFrame:
    """The rows of one repetition."""
    return runs.where(F.col("run_idx") == run)


def before_cutoff(runs: DataFrame, cutoff: int) -> DataFrame:
    """The rows of meshes that every file of a sweep has."""
    return runs.where(F.col("mesh_idx") < cutoff)


def ideal_scaling(times: DataFrame, group: list[str]) -> DataFrame:
    """Adds ideal = t0 * p0 / np, anchored at the least np of the group."""
    first = times.groupBy(*group).agg(F.min(F.struct("np", "time")).alias("f"))
    return times.join(first, group).withColumn("ideal", F.col("f.time") * F.col("f.np") / F.col("np")).drop("f")


def speedup(ours: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """time / other time, aligned by ``keys``."""
    return ours.join(other.withColumnRenamed("time", "other_time"), keys).select(*keys, (F.col("time") / F.col("other_time")).alias("speedup"))


def zscore_filter(rows: DataFrame, group: list[str], value: str, limit: float = 3.0) -> DataFrame:
    """Rows whose population z-score is at most ``limit``; a group without spread stays."""
    stats = rows.groupBy(*group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return rows.join(stats, group).where((F.col("_s") == 0) | ((F.col(value) - F.col("_m")) <= limit * F.col("_s"))).drop("_m", "_s")


def standardise(rows: DataFrame, value: str, out: str = "z") -> DataFrame:
    stats = rows.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return rows.crossJoin(F.broadcast(stats)).withColumn(out, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def rank_highest(rows: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """0-based rank; ties share the highest, which is the last place of the value in the order of all rows."""
    placed = global_index(rows, [value], "_pos")
    last = placed.groupBy(value).agg(F.max("_pos").alias(out), F.count(F.lit(1)).alias("k"))
    return looked_up(rows, last, value, rows.count()).drop("k")


def at_positions(rows: DataFrame, value: str, positions: list[float]) -> DataFrame:
    """(k, value): interpolated values at fractional places of the order, the k-th for the k-th of ``positions`` (shares of n - 1)."""
    placed = global_index(rows.select(value).where(F.col(value).isNotNull()), [value], "_pos")
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select("n", F.posexplode(F.array(*[F.lit(x) for x in positions])).alias("k", "share")).withColumn("at", (F.col("n") - 1) * F.col("share"))
    wanted = wanted.select("k", "at", F.floor("at").alias("low"), F.explode(F.array(F.floor("at"), F.floor("at") + 1)).alias("_pos"))  # two rows per position
    near = placed.join(F.broadcast(wanted), "_pos")
    both = near.groupBy("k", "at", "low").agg(F.max(F.when(F.col("_pos") == F.col("low"), F.col(value))).alias("a"), F.max(F.when(F.col("_pos") > F.col("low"), F.col(value))).alias("b"))
    return both.select("k", (F.col("a") + (F.coalesce("b", "a") - F.col("a")) * (F.col("at") - F.col("low"))).alias(value))


def sketched_positions(rows: DataFrame, value: str, positions: list[float], accuracy: int = 1000) -> DataFrame:
    """(k, value, rank, n): a value for each of ``positions`` in one pass, without an order of all rows.

    Summaries are merged from partial ones; a value's rank is off by at most n / ``accuracy``
    (stated by the summary's method, and checked against the rows: ``rank`` counts the
    rows up to the value)."""
    known = rows.select(value).where(F.col(value).isNotNull())
    found = known.agg(F.percentile_approx(value, F.array(*[F.lit(x) for x in positions]), F.lit(accuracy)).alias("q"))
    held = known.crossJoin(F.broadcast(found))  # one row
    counted = held.agg(F.count(F.lit(1)).alias("n"), F.first("q").alias("q"), F.array(*[F.count_if(F.col(value) <= F.get("q", F.lit(k))) for k in range(len(positions))]).alias("r"))
    return counted.select("n", F.posexplode(F.arrays_zip("q", "r")).alias("k", "z")).select("k", F.col("z.q").alias(value), F.col("z.r").alias("rank"), "n")


def summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Least, quartiles (interpolated) and greatest of every group.

    Places come from one global order, so a group may be of any size."""
    placed = global_index(rows.select(*group, value).where(F.col(value).isNotNull()), [*group, value], "_pos")
    ends = placed.groupBy(*group).agg(F.min("_pos").alias("_from"), F.count(F.lit(1)).alias("_n"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    wanted = ends.select(*group, F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("_share"), F.col("_from"), ((F.col("_n") - 1) * F.col("_share")).alias("_at"))
    wanted = wanted.select(*group, "_share", "_at", F.explode(F.array(F.floor("_at"), F.floor("_at") + 1)).alias("_step"), (F.col("_from") + F.col("_step")).alias("_pos"))
    near = placed.join(wanted, [*group, "_pos"])  # on the place too, so that a group's rows don't meet
    low = F.floor("_at")
    both = near.groupBy(*group, "_share", "_at").agg(F.max(F.when(F.col("_step") == low, F.col(value))).alias("a"), F.max(F.when(F.col("_step") > low, F.col(value))).alias("b"))
    q = both.withColumn("q", F.col("a") + (F.coalesce("b", "a") - F.col("a")) * (F.col("_at") - low)).groupBy(*group).agg(*[F.max(F.when(F.col("_share") == x, F.col("q"))).alias(c) for x, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    return ends.join(q, group).select(*group, "least", "q1", "median", "q3", "greatest")


def series(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, series): x:y pairs in order, as text."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(x), F.col(y))))
    return rows.groupBy(*group).agg(F.concat_ws(",", F.transform(pairs, lambda p: F.concat_ws(":", p[x].cast("string"), p[y].cast("string")))).alias("series"))
