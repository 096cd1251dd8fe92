"""A one-hash Bloom filter as a table: a semi-join that needs no shuffle of the large side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(97), key), F.lit(BITS))


def _words(wanted: DataFrame, key: str) -> DataFrame:
    """The filter: at most BITS / 64 rows of two numbers, 4 MB whatever the data, so it can be broadcast."""
    return wanted.select(_bit(F.col(key)).alias("bit")).groupBy(F.expr("bit div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("_bits"))


def _placed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("_bit", _bit(F.col(key))).withColumn("_word", F.expr("_bit div 64"))


_IS_SET = "shiftright(_bits, cast(_bit % 64 as int)) & 1L = 1L"


def possible(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``rows`` whose ``key`` may be among that of ``wanted``; none that is gets lost.

    A join on ``key`` must follow: it drops the few others."""
    return _placed(rows, key).join(F.broadcast(_words(wanted, key)), "_word").where(_IS_SET).select(*rows.columns)


def told(rows: DataFrame, wanted: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``; it is false only where ``key`` is surely not among that of ``wanted``."""
    flag = F.coalesce(F.expr(_IS_SET), F.lit(False)).alias(name)
    return _placed(rows, key).join(F.broadcast(_words(wanted, key)), "_word", "left").select(*rows.columns, flag)
