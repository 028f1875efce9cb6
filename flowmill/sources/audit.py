"""The request log: JSON lines with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AUDIT_SCHEMA = "ts timestamp, ip string, method string, path string, status int, ms long"
API_PREFIX = "/api/"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Log entries; malformed lines are skipped."""
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def audit_tail(log: DataFrame, n: int = 100) -> DataFrame:
    """Newest n entries, at least one."""
    return log.orderBy(F.desc("ts"), *[F.col(c) for c in log.columns if c != "ts"]).limit(max(1, n))


def api_calls(log: DataFrame) -> DataFrame:
    return log.filter(F.col("path").startswith(API_PREFIX))


def append_audit(log: DataFrame, path: str) -> None:
    """Append API calls as JSON lines."""
    api_calls(log).write.mode("append").option("timestampFormat", TIMESTAMP_FORMAT).json(path)
