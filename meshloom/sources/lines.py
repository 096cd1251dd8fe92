"""Numbered lines of text documents, read in splits, and documents written in ordered parts.

A folder that Spark wrote (``part-*`` files) is one document, its parts in the order of
their names; any other file is a document of its own.  Files are read through Spark's
file systems, and a large one by several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshloom.operators.iterate import written


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc, at, value): every line with its 0-based number in its document.

    The lines of a split have consecutive ids; a split's first number is the count of
    lines in the document's splits before it."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    read = written(read.withColumn("doc", F.regexp_replace("_file", r"/part-[^/]*$", "")), "lines")
    splits = read.groupBy("doc", "_file", "_start").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n"))  # a row per split
    order = W.partitionBy("doc").orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, 0)
    starts = splits.withColumn("_first", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    return read.join(F.broadcast(starts), ["doc", "_file", "_start"]).select("doc", (F.col("_first") + F.col("_id") - F.col("_low")).alias("at"), "value")


def write_document(lines: DataFrame, order: list[str], path: str, parts: int | None = None) -> None:
    """Writes the column ``line`` in ``order`` as text parts whose concatenation, by name, is the document.

    Spark's own commit applies: a part of a task that fails or is run twice never shows."""
    parts = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def numbers(*columns: Column) -> Column:
    return F.concat_ws(" ", *[c.cast("string") for c in columns])
