"""Shared intermediate tables.

Intermediates go to Parquet below ``spark.checkpoint.dir``, the one folder that
driver and executors share.  A table written there survives lost executors and
cuts the lineage.  A folder of our own is chosen only when the setting is
absent and the master is local (tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The configured checkpoint folder as a URI or path without trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/meshloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` once and returns the table read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, table: DataFrame | str) -> None:
    """Deletes an intermediate, a path or a table from ``materialize``, through Hadoop's file system, whatever the store."""
    folders = [table] if isinstance(table, str) else sorted({x.rsplit("/", 1)[0] for x in table.inputFiles()})
    for folder in folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
