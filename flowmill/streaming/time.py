"""Time as instants and whole microseconds, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SECOND = 1_000_000


def as_instant(df: DataFrame, column: str) -> DataFrame:
    """A zone-less timestamp column becomes the UTC instant; watermarks need one."""
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return df
    return df.withColumn(column, F.concat(F.col(column).cast("string"), F.lit("Z")).cast("timestamp"))


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.unix_micros(F.concat(F.col(column).cast("string"), F.lit("Z")).cast("timestamp"))
    return F.unix_micros(column)
