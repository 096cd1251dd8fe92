"""Spark-first analytics for mesh and graph partitioning."""
