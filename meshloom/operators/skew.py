"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``table`` (key, k, ...), where k counts the rows of a key and ``total`` all rows.

    A key with more than its share of the rows would fill one task.  Fewer such keys
    than shuffle partitions can exist, so they are broadcast, and their rows are dealt
    by a hash of the whole row instead of the key."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(total // parts, 1)
    values = [c for c in table.columns if c != key]
    hot = F.broadcast(table.where(F.col("k") > share).select(key, F.struct(*values).alias("_hot")))
    zero = F.when(F.col("k") < 0, 1).otherwise(0).cast("long")  # no literal: that would be folded out of the join's keys
    cold = table.where(F.col("k") <= share).select(key, zero.alias("_deal"), F.struct(*values).alias("_cold"))
    deal = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(parts))).cast("long")
    both = rows.join(hot, key, "left").withColumn("_deal", deal).join(cold, [key, "_deal"], "left").where("_hot is not null or _cold is not null")
    return both.select(*rows.columns, *[F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in values])
