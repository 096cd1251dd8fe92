"""Orders along a curve, dense indexes, block labels and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.functions.curves import bounds, morton3, quantize

from .iterate import written


def with_morton(points: DataFrame, levels: int = 20, offset: int = 0, per_axis: bool = False) -> DataFrame:
    """Adds ``morton`` to rows with x, y, z, quantised in the cube (or box) around all points."""
    if per_axis:
        box = points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "low"), (F.max, "high"))])
        cell = [quantize(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}"), levels, offset) for c in "xyz"]
    else:
        box = points.agg(*bounds())
        cell = [quantize(F.col(c), F.col("low"), F.col("high"), levels, offset) for c in "xyz"]
    return points.crossJoin(F.broadcast(box)).select(*points.columns, morton3(*cell).alias("morton"))  # the box is one row


def global_index(rows: DataFrame, keys: list[str], out: str = "global_idx", partitions: int | None = None) -> DataFrame:
    """Dense 0-based index in the order of ``keys``, in one shuffle and without a window over rows.

    Rows are range-partitioned, sorted within their range and written once with the id
    that tells their range and their place in it; the index is the place plus the number
    of rows in the ranges before.  Rows with equal keys are in one range, in the order in
    which they were written."""
    parts = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    starts = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + place).drop("_range", "_start", "_at")


def block_of(position: Column, n: Column, parts: int) -> Column:
    """Block of a 0-based position when the first n mod parts blocks get one row more."""
    size, extra = F.floor(n / parts), n % parts
    wide = (size + 1) * extra
    return F.when(position < wide, F.floor(position / (size + 1))).otherwise(extra + F.floor((position - wide) / F.greatest(size, F.lit(1)))).cast("long")


def block_labels(rows: DataFrame, keys: list[str], parts: int, out: str = "label") -> DataFrame:
    """Equal-block labels along ``keys``."""
    indexed = global_index(rows, keys, "_pos")
    n = rows.agg(F.count(F.lit(1)).alias("_rows"))
    return indexed.crossJoin(F.broadcast(n)).withColumn(out, block_of(F.col("_pos"), F.col("_rows"), parts)).drop("_pos", "_rows")


def floor_labels(rows: DataFrame, keys: list[str], parts: int, out: str = "label") -> DataFrame:
    """Blocks of n div parts rows; the last one takes the remainder."""
    indexed = global_index(rows, keys, "_pos")
    n = rows.agg(F.count(F.lit(1)).alias("_rows"))
    size = F.greatest(F.lit(1), F.floor(F.col("_rows") / parts))
    return indexed.crossJoin(F.broadcast(n)).withColumn(out, F.least(F.floor(F.col("_pos") / size), F.lit(parts - 1)).cast("long")).drop("_pos", "_rows")


def mid_seeds(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """The row at position size div 2 of every label, in the order of ``keys``.

    Places come from one order by label and keys; only a row per label is picked from it."""
    placed = global_index(labelled, ["label", *keys], "_pos")
    middle = placed.groupBy("label").agg((F.min("_pos") + F.floor(F.count(F.lit(1)) / 2)).alias("_mid"))
    return placed.join(F.broadcast(middle.select("_mid")), F.col("_pos") == F.col("_mid")).select(*labelled.columns)  # a row per label


def least_gaps(values: DataFrame, group: str, value: str, out: str = "gap") -> DataFrame:
    """(group, out): the least positive difference of neighbouring values in each group.

    Neighbours are found within ranges of one order, and each range's first value
    meets the last one of the range before; no task sees a whole group."""
    spread = values.select(group, value).where(F.col(value).isNotNull()).distinct()
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(spread.repartitionByRange(parts, group, value).withColumn("_part", F.spark_partition_id()), "ranged")
    inner = ranged.withColumn(out, F.col(value) - F.lag(value).over(W.partitionBy("_part", group).orderBy(value))).groupBy(group).agg(F.min(out).alias(out))
    ends = ranged.groupBy(group, "_part").agg(F.min(value).alias("_first"), F.max(value).alias("_last"))  # a row per range and group
    outer = ends.withColumn(out, F.col("_first") - F.lag("_last").over(W.partitionBy(group).orderBy("_part"))).groupBy(group).agg(F.min(out).alias(out))
    return inner.union(outer).groupBy(group).agg(F.min(out).alias(out))


def centroid_seeds(labelled: DataFrame, key: str) -> DataFrame:
    """The point nearest to its label's mean; squared distances are compared to six places, then keys."""
    mean = labelled.groupBy("label").agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])
    d2 = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "yz"), (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")))
    near = labelled.join(mean, "label").withColumn("_d2", F.round(d2, 6))
    return near.groupBy("label").agg(F.min(F.struct(F.col("_d2"), F.col(key))).alias("m")).select("label", F.col(f"m.{key}").alias(key))


def stride_samples(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows at positions s * (n div k), s < k."""
    indexed = global_index(rows, keys, "position")
    n = rows.agg(F.count(F.lit(1)).alias("_rows"))
    stride = F.greatest(F.lit(1), F.floor(F.col("_rows") / k))
    return indexed.crossJoin(F.broadcast(n)).where((F.col("position") % stride == 0) & (F.floor(F.col("position") / stride) < k)).drop("_rows")


def weighted_blocks(rows: DataFrame, keys: list[str], weight: Column, parts: int) -> DataFrame:
    """Order-preserving blocks of about equal weight: floor(weight before the row * parts / total), weights being whole."""
    indexed = global_index(rows.withColumn("_w", weight.cast("long")), keys, "_pos")
    per = 1 << 16
    groups = indexed.groupBy(F.floor(F.col("_pos") / per).alias("_g")).agg(F.sum("_w").alias("_gw"))
    before = groups.select("_g", (F.sum("_gw").over(W.orderBy("_g")) - F.col("_gw")).alias("_gb"), F.sum("_gw").over(W.partitionBy()).alias("_total"))
    inner = F.sum("_w").over(W.partitionBy("_g").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)) - F.col("_w")
    joined = indexed.withColumn("_g", F.floor(F.col("_pos") / per)).withColumn("_in", inner).join(before, "_g")
    block = F.when(F.col("_total") > 0, F.least(F.expr(f"((_gb + _in) * {parts}) div _total"), F.lit(parts - 1))).otherwise(F.lit(0))
    return joined.withColumn("label", block.cast("long")).drop("_w", "_pos", "_g", "_in", "_gb", "_total")


def redistribute(labelled: DataFrame, order: list[str], out: str = "new_idx") -> DataFrame:
    """Rows renumbered by (label, order); the same ranges would place them on disk."""
    return global_index(labelled, ["label", *order], out)
