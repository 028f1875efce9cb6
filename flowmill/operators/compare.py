"""Two tables side by side: histograms, divergences, KS, Wasserstein, correlation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.functions.numeric import finite
from flowmill.operators.quality import unpivot_numeric
from flowmill.operators.split import sample_rows
from flowmill.plans.ordered import running_totals
from flowmill.plans.small import broadcast_checked


def _sides(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form (side, feature, value): side 0 is a, side 1 is b."""
    tag = lambda df, s: unpivot_numeric(df, columns).withColumn("side", F.lit(s))
    return tag(a, 0).unionByName(tag(b, 1))


def pooled_range(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, low, high, n_a, n_b) of the finite cells of both tables: two wide aggregates, no row shuffle."""
    def one(df, name):
        df = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
        wide = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns],
                      *[F.max(c).alias(f"hi_{c}") for c in columns],
                      *[F.count(c).alias(f"n_{c}") for c in columns])
        return wide.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").cast("double").alias("low"),
                     F.col(f"hi_{c}").cast("double").alias("high"), F.col(f"n_{c}").alias(name))
            for c in columns])))
    both = one(a, "n").withColumn("side", F.lit(0)).unionByName(one(b, "n").withColumn("side", F.lit(1)))
    return both.groupBy("feature").agg(
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("n_a"),
        F.sum(F.when(F.col("side") == 1, F.col("n"))).alias("n_b"))


def _equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of [low, high] in equal steps, last bin closed; edges are low + i * step."""
    step = (high - low) / bins
    guess = F.least(F.floor(F.try_divide(value - low, high - low) * bins), F.lit(bins - 1))
    # The division can land one bin off next to an edge; the edges decide.
    return (
        F.when((value < low + guess * step) & (guess > 0), guess - 1)
        .when((value >= low + (guess + 1) * step) & (guess < bins - 1), guess + 1)
        .otherwise(guess).cast("int"))


def histogram(a: DataFrame, b: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """(feature, bin, n_a, n_b) on the pooled range of each feature; empty bins absent."""
    return _histogram(_sides(a, b, columns), pooled_range(a, b, columns), bins)


def _histogram(sides: DataFrame, ranges: DataFrame, bins: int) -> DataFrame:
    usable = ranges.filter("high > low and n_a > 0 and n_b > 0")
    return (
        sides.join(broadcast_checked(usable), "feature")
        .withColumn("bin", _equal_width_bin(F.col("value"), F.col("low"), F.col("high"), bins))
        .groupBy("feature", "bin")
        .agg(F.count_if(F.col("side") == 0).alias("n_a"), F.count_if(F.col("side") == 1).alias("n_b")))


def _full_bins(hist: DataFrame, bins: int) -> DataFrame:
    """Every bin of every feature present, missing ones zero."""
    grid = hist.select("feature").distinct().select(
        "feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(hist, ["feature", "bin"], "left").fillna(0, ["n_a", "n_b"])


def js_divergence(a: DataFrame, b: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """(feature, js_divergence) in bits; an empty side or a single value gives 0."""
    ranges = pooled_range(a, b, columns)
    return _js(_histogram(_sides(a, b, columns), ranges, bins), ranges, bins)


def _js(hist: DataFrame, ranges: DataFrame, bins: int) -> DataFrame:
    eps = 1e-12
    whole = Window.partitionBy("feature")
    shares = _full_bins(hist, bins).select(
        "feature",
        ((F.col("n_a") + eps) / F.sum(F.col("n_a") + eps).over(whole)).alias("p"),
        ((F.col("n_b") + eps) / F.sum(F.col("n_b") + eps).over(whole)).alias("q"))
    middle = (F.col("p") + F.col("q")) / 2
    term = F.col("p") * F.log2(F.col("p") / middle) + F.col("q") * F.log2(F.col("q") / middle)
    scored = shares.groupBy("feature").agg(F.greatest(F.sum(term) / 2, F.lit(0.0)).alias("js_divergence"))
    return ranges.select("feature").join(scored, "feature", "left").fillna(0.0, ["js_divergence"])


# ------------------------------------------------------------ KS, Wasserstein

def ks_wasserstein(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n_a, n_b, ks_statistic, wasserstein_distance), features empty on a side left out.

    Values collapse to counts first; running shares come from range-partitioned totals,
    so one heavy feature is spread over many tasks.
    """
    counts = _sides(a, b, columns).groupBy("feature", "value").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    ranked = running_totals(counts, ["feature"], "value", ["a", "b"], with_next=True)
    gap = F.abs(
        F.try_divide(F.col("a_before") + F.col("a"), F.col("a_total"))
        - F.try_divide(F.col("b_before") + F.col("b"), F.col("b_total")))
    return (
        ranked.filter("a_total > 0 and b_total > 0")
        .select("feature", "a_total", "b_total", gap.alias("gap"),
                (gap * F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))).alias("area"))
        .groupBy("feature")
        .agg(F.max("a_total").alias("n_a"), F.max("b_total").alias("n_b"),
             F.max("gap").alias("ks_statistic"), F.sum("area").alias("wasserstein_distance")))


def ks_pvalue(statistic: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """Two-sided asymptotic p-value: the Kolmogorov series at D * sqrt(n_a n_b / (n_a + n_b)).

    Small arguments use the series' theta form, which converges there.
    """
    size = n_a.cast("double") * n_b / (n_a.cast("double") + n_b)
    x = statistic * F.sqrt(size)
    ks = F.sequence(F.lit(1), F.lit(terms))
    tail = 2 * F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0)
                           * F.exp(-2.0 * k * k * x * x))
    body = F.lit(math.sqrt(2 * math.pi)) / x * F.aggregate(
        ks, F.lit(0.0), lambda acc, k: acc + F.exp(-((2 * k - 1) * (2 * k - 1)) * F.lit(math.pi**2 / 8) / (x * x)))
    p = F.when(x <= 1e-9, 1.0).when(x < 1, 1 - body).otherwise(tail)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


# ------------------------------------------------------------ correlation

def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, correlation) for all ordered pairs, pairwise complete, undefined as 0.

    Each task folds its rows into d x d moment matrices (numpy on Arrow batches), so what
    is shuffled is one small matrix per task.  Values are centred on the column means
    first to keep the sums of squares well conditioned. Infinite cells count as missing.
    """
    columns = list(columns)
    df = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centre = np.array([means[c] if means[c] is not None else 0.0 for c in columns])
    d = len(columns)
    left, right = np.triu_indices(d)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, d, d))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - centre
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            m = known.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        part = total[:, left, right]
        yield pd.DataFrame({"i": left, "j": right, "n": part[0], "sx": part[1], "sy": part[2],
                            "sxx": part[3], "syy": part[4], "sxy": part[5]})

    parts = df.mapInPandas(
        fold, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in names)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    # Rounding leaves a constant column with a tiny variance; compare with its scale.
    spread = (vx > 1e-12 * n * sxx) & (vy > 1e-12 * n * syy)
    value = F.try_divide(n * sxy - sx * sy, F.sqrt(vx * vy))
    value = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
    value = F.when(spread, value).otherwise(0.0)
    name = lambda c: F.element_at(F.array(*[F.lit(k) for k in columns]), F.col(c) + 1)
    upper = sums.select("i", "j", value.alias("correlation"))
    lower = upper.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "correlation")
    return upper.unionByName(lower).select(name("i").alias("x"), name("j").alias("y"), "correlation")


def correlation_preservation(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: Frobenius norm of the difference and 1 - difference / norm of a, at least 0."""
    both = correlation_matrix(a, columns).withColumnRenamed("correlation", "a").join(
        correlation_matrix(b, columns).withColumnRenamed("correlation", "b"), ["x", "y"])
    norms = both.agg(
        F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("norm"),
        F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("delta"))
    safe = F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    return norms.select(
        F.coalesce("delta", F.lit(0.0)).alias("correlation_frobenius_delta"),
        F.greatest(F.lit(0.0), 1 - F.coalesce(F.col("delta") / safe, F.lit(0.0))).alias("correlation_preservation"))


# ------------------------------------------------------------ fidelity

def feature_fidelity(a: DataFrame, b: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Per feature: KS statistic and p-value, JS divergence, Wasserstein; worst JS first."""
    ks = ks_wasserstein(a, b, columns)
    js = js_divergence(a, b, columns, bins)
    return (
        ks.join(broadcast_checked(js), "feature")
        .withColumn("ks_pvalue", ks_pvalue(F.col("ks_statistic"), F.col("n_a"), F.col("n_b")))
        .select("feature", "ks_statistic", "ks_pvalue", "js_divergence", "wasserstein_distance")
        .orderBy(F.desc("js_divergence"), "feature"))


def fidelity_report(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], bins: int = 30,
                    max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """Long form (metric, feature, value): per-feature lines, averages and correlation.

    max_rows samples both sides first; None compares the whole tables.
    """
    if max_rows is not None:
        real = sample_rows(real, max_rows, seed)
        synthetic = sample_rows(synthetic, max_rows, seed + 1)
    lines = feature_fidelity(real, synthetic, columns, bins)
    names = ("ks_statistic", "ks_pvalue", "js_divergence", "wasserstein_distance")
    long = lines.select("feature", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])))
    averages = lines.agg(
        F.count("*").cast("double").alias("numeric_features_compared"),
        F.coalesce(F.avg("js_divergence"), F.lit(0.0)).alias("average_js_divergence"),
        F.coalesce(F.avg((F.col("ks_pvalue") < 0.05).cast("double")), F.lit(0.0)).alias("ks_failure_rate_p_lt_0_05"))
    def as_lines(one_row):
        return one_row.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.lit(None).cast("string").alias("feature"),
                     F.col(c).alias("value")) for c in one_row.columns])))
    return (
        long.select("metric", "feature", "value")
        .unionByName(as_lines(averages))
        .unionByName(as_lines(correlation_preservation(real, synthetic, columns))))
