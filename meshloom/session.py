"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "meshloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI semantics; ``conf`` keys use _ for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}
    return builder.config(map=defaults | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
