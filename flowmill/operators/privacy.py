"""How close synthetic rows come to real ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from flowmill.functions.numeric import finite
from flowmill.operators import quality as Q
from flowmill.operators.split import sample_rows
from flowmill.plans.neighbours import nearest_two
from flowmill.plans.ordered import exact_quantiles
from flowmill.schema import META_COLUMNS, QUASI_IDENTIFIERS


def k_anonymity(df: DataFrame, quasi: Sequence[str] = tuple(QUASI_IDENTIFIERS)) -> DataFrame:
    """One row: size of the smallest group of equal quasi-identifiers (nulls are values)."""
    quasi = [c for c in quasi if c in df.columns]
    if not quasi:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("k_anonymity_min"))
    return df.groupBy(*quasi).agg(F.count("*").alias("n")).agg(F.min("n").alias("k_anonymity_min"))


def standardisation(real: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median, mean, scale) of the real side: mean and population deviation after
    filling with the median; a constant column scales by 1."""
    clean = real.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    middle = Q.medians(clean, columns)
    filled = clean.select(*[F.coalesce(F.col(c), F.lit(middle[c])).alias(c) for c in columns])
    wide = filled.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    scale = lambda c: F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(middle[c]).alias("median"),
                 F.coalesce(F.col(f"m_{c}"), F.lit(0.0)).alias("mean"), scale(c).alias("scale"))
        for c in columns])))


def standardise(df: DataFrame, columns: Sequence[str], stats: dict, keep: Sequence[str] = ()) -> DataFrame:
    """Rows as a vector column `v`, filled and scaled with the real side's statistics."""
    cell = lambda c: (F.coalesce(finite(F.col(c).cast("double")), F.lit(stats[c]["median"]))
                      - F.lit(stats[c]["mean"])) / F.lit(stats[c]["scale"])
    return df.select(*keep, F.array(*[cell(c) for c in columns]).alias("v"))


def distance_ratios(distances: DataFrame) -> DataFrame:
    """Add dcr and nndr = d1 / d2 (1 where there is no second neighbour)."""
    return distances.select(
        "*", F.col("d1").alias("dcr"),
        F.when(F.col("d2").isNull(), 1.0).otherwise(F.col("d1") / F.greatest("d2", F.lit(1e-12))).alias("nndr"))


def distance_summary(distances: DataFrame) -> DataFrame:
    """One row: mean, median and tails of dcr, mean and median of nndr."""
    ratios = distance_ratios(distances)
    long = ratios.select(F.inline(F.array(
        F.struct(F.lit("dcr").alias("m"), F.col("dcr").alias("value")),
        F.struct(F.lit("nndr").alias("m"), F.col("nndr").alias("value")))))
    tails = exact_quantiles(long, ["m"], "value", [0.05, 0.5, 0.95])
    at = lambda m, p, name: F.max(F.when((F.col("m") == m) & (F.col("prob") == p), F.col("quantile"))).alias(name)
    means = ratios.agg(F.avg("dcr").alias("dcr_mean"), F.avg("nndr").alias("nndr_mean")).withColumn("_one", F.lit(1))
    middle = tails.agg(at("dcr", 0.5, "dcr_median"), at("dcr", 0.05, "dcr_p05"), at("dcr", 0.95, "dcr_p95"),
                       at("nndr", 0.5, "nndr_median")).withColumn("_one", F.lit(1))
    return means.join(middle, "_one").select(
        "dcr_mean", "dcr_median", "dcr_p05", "dcr_p95", "nndr_mean", "nndr_median")


def nearest_real(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], max_rows: int | None = None,
                 seed: int = 42) -> DataFrame:
    """Distances of synthetic rows to their two nearest real rows: all rows, or seeded samples of max_rows a side."""
    base, rows = real.select(*columns), synthetic.select(*columns)
    if max_rows is not None:
        base, rows = sample_rows(base, max_rows, seed), sample_rows(rows, max_rows, seed + 1)
    stats = {r["feature"]: r.asDict() for r in standardisation(base, columns).collect()}
    keyed = rows.withColumn("id", F.monotonically_increasing_id())
    return nearest_two(standardise(keyed, columns, stats, ["id"]), standardise(base, columns, stats))


def privacy_report(real: DataFrame, synthetic: DataFrame, columns: Sequence[str] | None = None,
                   max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """One row: exact matches, distance summary and k-anonymity."""
    if columns is None:
        numeric, _ = Q.feature_classes(real, META_COLUMNS, categorical=())
        columns = [c for c in numeric if c in synthetic.columns]
    parts = [Q.exact_match_count(synthetic, real), k_anonymity(synthetic)]
    if columns:
        parts.append(distance_summary(nearest_real(real, synthetic, columns, max_rows, seed)))
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")
