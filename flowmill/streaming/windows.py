"""Event-time windows: drift against a fixed baseline, and request activity.

Streams keep no window state. Every micro-batch is summed up by itself into a part of its own, and
readers merge the parts of a window: counts add up, so the newest windows are there at once, an event that
comes late joins its window whatever the watermark, and a repeated batch replaces its own part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowmill.operators import drift as D
from flowmill.operators.compare import pooled_range
from flowmill.plans.small import broadcast_checked, settle
from flowmill.streaming.time import as_instant


def baseline_bins(baseline: DataFrame, features: Sequence[str], bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(edges, counts) of a baseline table: all a drift stream needs to know about it."""
    edges = settle(D.plan_edges(pooled_range(baseline, baseline, features), bins))
    return edges, settle(D.binned(baseline, edges, features, "n_a", bins))


def window_bins(current: DataFrame, ts: str, edges: DataFrame, features: Sequence[str], width: str,
                bins: int = 10) -> DataFrame:
    """(window, feature, bin, n_b) per tumbling window of a table or a micro-batch."""
    timed = as_instant(current, ts).withColumn("window", F.window(ts, width))
    return D.binned(timed, edges, features, "n_b", bins, ["window"])


def score_windows(counts: DataFrame, baseline: DataFrame, method: str = "reference", bins: int = 10) -> DataFrame:
    """(window, feature, psi, severity) of complete windows."""
    seen = counts.select("window", "feature").distinct()
    both = (
        seen.join(broadcast_checked(baseline), "feature")
        .join(counts, ["window", "feature", "bin"], "full").fillna(0, ["n_a", "n_b"]))
    scored = D.score_bins(both, seen, method, bins, ["window"])
    return scored.withColumn("severity", D.severity(F.col("psi")))


def part_stream(stream: DataFrame, summarise: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                after: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Write `summarise` of every micro-batch below `path`, one folder per batch; then call `after` with the part
    written and its number. A first empty part lets readers start before any data."""
    spark = stream.sparkSession
    summarise(spark.createDataFrame([], stream.schema)).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        part = f"{path}/batch={number}"
        summarise(batch).write.mode("overwrite").parquet(part)
        if after:
            after(spark.read.parquet(part), number)

    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(**(trigger or {"availableNow": True})).start())


def drift_stream(current: DataFrame, ts: str, baseline: DataFrame, features: Sequence[str], width: str,
                 path: str, checkpoint: str, method: str = "reference", **trigger) -> StreamingQuery:
    """Score, after every micro-batch, the windows it touched with all their events so far. Read with
    `drift_windows`, which takes the newest version of each window."""
    edges, known = baseline_bins(baseline, features)
    spark = current.sparkSession

    def score(part: DataFrame, number: int) -> None:
        touched = part.select("window").distinct()
        # A repeated batch must not see parts that came after it.
        so_far = spark.read.parquet(f"{path}/counts").where(F.col("batch") <= number)
        counts = so_far.join(touched, "window", "left_semi").groupBy("window", "feature", "bin").agg(F.sum("n_b").alias("n_b"))
        score_windows(counts, known, method).write.mode("overwrite").parquet(f"{path}/scores/batch={number}")

    return part_stream(current, lambda batch: window_bins(batch, ts, edges, features, width), f"{path}/counts", checkpoint,
                       score, **trigger)


SCORES = "window struct<start:timestamp,end:timestamp>, feature string, psi double, severity string, batch long"


def drift_windows(spark: SparkSession, path: str) -> DataFrame:
    """(window, feature, psi, severity): the newest version of every window a drift stream has scored."""
    versions = spark.read.schema(SCORES).option("basePath", f"{path}/scores").parquet(f"{path}/scores")
    newest = F.max_by(F.struct("psi", "severity"), "batch").alias("v")
    return versions.groupBy("window", "feature").agg(newest).select("window", "feature", "v.psi", "v.severity")


def audit_parts(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Sums of API calls per (window, path, status) that can be added up."""
    return as_instant(log, "ts").groupBy(F.window("ts", width).alias("window"), "path", "status").agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"),
        F.sum("ms").alias("total_ms"), F.count("ms").alias("timed"), F.max("ms").alias("max_ms"))


def merge_audit(parts: DataFrame) -> DataFrame:
    """(window, path, status, requests, errors, mean_ms, max_ms) of all parts."""
    return parts.groupBy("window", "path", "status").agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"),
        F.try_divide(F.sum("total_ms"), F.sum("timed")).alias("mean_ms"), F.max("max_ms").alias("max_ms"))


def audit_windows(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """The same over a table of calls."""
    return merge_audit(audit_parts(log, width))


def audit_stream(log: DataFrame, path: str, checkpoint: str, width: str = "1 hour", **trigger) -> StreamingQuery:
    """Sum up every micro-batch; `merge_audit` of what is below `path` are the windows so far."""
    return part_stream(log, lambda batch: audit_parts(batch, width), path, checkpoint, **trigger)
