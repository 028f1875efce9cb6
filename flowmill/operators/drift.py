"""Distribution drift of a current table against a baseline."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.operators.compare import pooled_range
from flowmill.operators.quality import is_numeric, unpivot_numeric
from flowmill.plans.small import broadcast_checked, settle

EPSILON = 1e-6
METHODS = ("reference", "psi")


def rounded_edges(low: float, high: float, bins: int = 10) -> list[float]:
    """Bin edges of the pooled range, the lowest moved down by a thousandth of it.

    Edges are rounded to three places - after the point, or significant where the
    whole part is zero - or to as many more as it takes to keep them apart.
    """
    step = (high - low) / bins
    edges = [low + i * step for i in range(bins)] + [high]
    edges[0] -= (high - low) * 0.001

    def shorten(x: float, places: int) -> float:
        if x == 0:
            return x
        if abs(x) < 1:
            places += -math.floor(math.log10(abs(x))) - 1
        scale = 10.0**places
        return round(x * scale) / scale if math.isfinite(x * scale) else x

    for places in range(3, 20):
        short = [shorten(e, places) for e in edges]
        if len(set(short)) == len(short):
            return short
    return [shorten(e, 3) for e in edges]


def plan_edges(ranges: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, edges) as a local table: one line per feature of a pooled range."""
    rows = [(r["feature"], rounded_edges(r["low"], r["high"], bins))
            for r in ranges.filter("high > low and n_a > 0 and n_b > 0").collect()]
    return ranges.sparkSession.createDataFrame(rows, "feature string, edges array<double>")


def bin_of(value: Column, edges: Column, bins: int = 10) -> Column:
    """0-based right-closed bin, null outside all bins."""
    rule = None
    for i in range(bins):
        inside = (value > F.element_at(edges, i + 1)) & (value <= F.element_at(edges, i + 2))
        rule = F.when(inside, i) if rule is None else rule.when(inside, i)
    return rule


def binned(df: DataFrame, edges: DataFrame, columns: Sequence[str], name: str, bins: int = 10,
           by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, bin, <name>): counts of binned values.  Works on a stream too."""
    return (
        unpivot_numeric(df, columns, by).join(broadcast_checked(edges), "feature")
        .withColumn("bin", bin_of(F.col("value"), F.col("edges"), bins))
        .filter("bin is not null").groupBy(*by, "feature", "bin").agg(F.count("*").alias(name)))


def drift_terms(expected: Column, actual: Column, method: str) -> Column:
    """One bin's share of the score from the two (unsmoothed) bin shares.

    'reference' sums (a - e) - e ln(a / e), a generalised divergence; 'psi' is the textbook
    index, the sum of (a - e) ln(a / e).
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    e, a = expected + EPSILON, actual + EPSILON
    return (a - e) * F.log(a / e) if method == "psi" else (a - e) - e * F.log(a / e)


def score_bins(counts: DataFrame, features: DataFrame, method: str = "reference", bins: int = 10,
               by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, psi) from (by..., feature, bin, n_a, n_b)."""
    grid = features.select(*by, "feature").distinct().select(
        *by, "feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    whole = Window.partitionBy(*by, "feature")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(whole)), F.lit(0.0))
    shares = grid.join(counts, [*by, "feature", "bin"], "left").fillna(0, ["n_a", "n_b"]).select(
        *by, "feature", drift_terms(share("n_a"), share("n_b"), method).alias("t"))
    return shares.groupBy(*by, "feature").agg(
        F.round(F.greatest(F.lit(0.0), F.sum("t")), 6).alias("psi"))


def severity(psi: Column) -> Column:
    return F.when(psi < 0.1, "stable").when(psi < 0.25, "moderate").otherwise("high")


def drift_report(baseline: DataFrame, current: DataFrame, features: Sequence[str],
                 method: str = "reference", bins: int = 10) -> DataFrame:
    """(feature, psi, severity) for every listed feature, highest psi first.

    Features absent from a table are `missing`, without values on a side `empty`.
    """
    spark = baseline.sparkSession
    types_a, types_b = dict(baseline.dtypes), dict(current.dtypes)
    usable = [f for f in features if f in types_a and f in types_b
              and is_numeric(types_a[f]) and is_numeric(types_b[f])]
    listed = spark.createDataFrame(
        [(f, f in types_a and f in types_b) for f in features], "feature string, present boolean")
    if not usable:
        return listed.select("feature", F.lit(None).cast("double").alias("psi"),
                             F.when(F.col("present"), "empty").otherwise("missing").alias("severity"))
    ranges = settle(pooled_range(baseline, current, usable))
    edges = settle(plan_edges(ranges, bins))
    counts = binned(baseline, edges, usable, "n_a", bins).join(
        binned(current, edges, usable, "n_b", bins), ["feature", "bin"], "full").fillna(0, ["n_a", "n_b"])
    scored = score_bins(counts, edges, method, bins)
    filled = ranges.select("feature", ((F.col("n_a") > 0) & (F.col("n_b") > 0)).alias("filled"))
    score = F.when(F.col("filled"), F.coalesce("psi", F.lit(0.0)))
    out = (
        listed.join(broadcast_checked(filled), "feature", "left")
        .join(broadcast_checked(scored), "feature", "left")
        .select("feature", "present", "filled", score.alias("psi")))
    state = (F.when(~F.col("present"), "missing").when(F.col("filled"), severity(F.col("psi")))
             .otherwise("empty"))
    return out.select("feature", "psi", state.alias("severity")).orderBy(*psi_order())


def psi_order() -> list[Column]:
    """Highest score first; missing and zero scores last."""
    return [F.coalesce(F.nullif(F.col("psi"), F.lit(0.0)), F.lit(-1.0)).desc(), F.col("feature").asc()]


def top_drifted(report: DataFrame, level: str, n: int = 10) -> DataFrame:
    """The n worst features of one severity."""
    return report.filter(F.col("severity") == level).orderBy(*psi_order()).limit(n)


def drift_summary(report: DataFrame) -> DataFrame:
    """One row: analysed and drifted features, fraction, overall severity, retraining advice."""
    drifted = F.count_if(F.col("severity").isin("moderate", "high"))
    fraction = F.coalesce(F.try_divide(F.col("drifted_features"), F.col("features")), F.lit(0.0))
    return report.agg(
        F.count("*").alias("features"), F.count("psi").alias("features_analysed"),
        drifted.alias("drifted_features"),
    ).select(
        "features_analysed", "drifted_features", F.round(fraction, 4).alias("drift_fraction"),
        F.when(fraction > 0.3, "high").when(fraction > 0.1, "moderate").otherwise("stable").alias("overall_severity"),
        (fraction > 0.2).alias("retraining_recommended"))
