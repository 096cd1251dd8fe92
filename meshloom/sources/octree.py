"""Octree leaves in 80-byte records of ten native longs: id, three coordinates, six neighbours.

Files are split between records, so a large one is read by many tasks, through Spark's
file systems.  A file whose name ends in ``_<count>.<extension>`` must hold so many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = np.dtype([("eid", "<i8"), ("coord", "<i8", 3), ("e2e", "<i8", 6)])
BORDER = 4294967295
SCHEMA = "e long, x double, y double, z double, neigh array<long>"


def decode(records: pa.Array) -> pa.RecordBatch:
    """(e, x, y, z, neigh) of an array of records; a neighbour beyond the border is null."""
    rows = np.frombuffer(b"".join(records.to_pylist()), RECORD)
    near = rows["e2e"].reshape(-1)
    offsets = pa.array(np.arange(0, len(near) + 1, 6, dtype=np.int32))
    neigh = pa.ListArray.from_arrays(offsets, pa.array(near, mask=near == BORDER))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows["eid"])), *(pa.array(rows["coord"][:, k].astype(float)) for k in range(3)), neigh], ["e", "x", "y", "z", "neigh"])


def checked(spark: SparkSession, path: str) -> None:
    """Raises unless every file is a whole number of records, and the number that its name tells; lengths come from the listing."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    told = F.try_to_number(F.regexp_extract("path", r"_(\d+)\.[^./]*$", 1), F.lit("999999999999999999"))
    wrong = files.where((F.col("length") % RECORD.itemsize != 0) | (told * RECORD.itemsize != F.col("length"))).select("path").take(1)
    if wrong:
        raise ValueError(f"{wrong[0][0]} doesn't hold the number of records it should")


def read_octree(spark: SparkSession, path: str) -> DataFrame:
    """Leaves of the files at ``path``."""
    checked(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decode(batch.column("record"))

    records = spark.createDataFrame(spark.sparkContext.binaryRecords(path, RECORD.itemsize).map(lambda record: (record,)), "record binary")
    return records.mapInArrow(run, SCHEMA)
