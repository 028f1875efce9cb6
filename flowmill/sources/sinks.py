"""Sinks of the pipeline's tables and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from flowmill.session import delete_path, move_path


def write_table(df: DataFrame, path: str) -> bool:
    """Snappy Parquet; True when rows were written.  An empty table leaves what is at the path as it is.

    The plan runs once: rows go to a folder beside the path, which takes its place when it holds any.  A failed
    job leaves the old table.
    """
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "snappy").parquet(fresh)
        if spark.read.schema(df.schema).parquet(fresh).isEmpty():
            return False
        delete_path(spark, path)
        move_path(spark, fresh, path)
        return True
    finally:
        delete_path(spark, fresh)


def write_splits(split: DataFrame, path: str) -> None:
    """One pass, one folder per split value."""
    split.write.mode("overwrite").option("compression", "snappy").partitionBy("split").parquet(path)


def write_document(lines: DataFrame, path: str) -> None:
    """A long-form metric table as JSON lines."""
    lines.write.mode("overwrite").json(path)
