"""Counts, facets, dedup, missing values, constraints and readiness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.functions.numeric import finite, null_token, text_to_number, to_number
from flowmill.plans.ordered import exact_quantiles
from flowmill.plans.small import broadcast_checked, settle
from flowmill.schema import (
    LINEAGE_COLUMNS, META_COLUMNS, NON_NEGATIVE, PORT_COLUMNS, PORT_MAX, STRING_FEATURES,
)
from flowmill.session import stored

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(data_type: str) -> bool:
    return data_type in NUMERIC_TYPES or data_type.startswith("decimal")


# ------------------------------------------------------------------ counts

def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(name, rows), most frequent first, missing counted as Unknown."""
    name = F.coalesce(F.col(column).cast("string"), F.lit("Unknown")).alias("name")
    return df.groupBy(name).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "name")


def facet_counts(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """value_counts of several columns in one pass: (facet, name, rows). A line counts `weight` times, or once."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("facet"),
                 F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias("name"))
        for c in columns
    ])).alias("p")
    if weight is not None:
        return df.select(pairs, weight).groupBy("p.facet", "p.name").agg(F.sum(weight).alias("rows"))
    return df.select(pairs).groupBy("p.facet", "p.name").agg(F.count("*").alias("rows"))


def label_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Normal and attack rows, optionally per group."""
    label = F.col("label").cast("int")
    return df.groupBy(*by).agg(
        F.count_if(label == 0).alias("normal_rows"), F.count_if(label == 1).alias("attack_rows")
    )


def group_mode(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column): most frequent value per key, the smallest on ties.

    Counts are collapsed before the window, which sees one row per key and value.
    """
    best = Window.partitionBy(key).orderBy(F.desc("_n"), column)
    return (
        df.filter(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("_n"))
        .withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").select(key, column)
    )


def top_per_group(df: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """(key, column, rows, rank): the k most frequent values per key."""
    order = Window.partitionBy(key).orderBy(F.desc("rows"), column)
    return (
        df.groupBy(key, column).agg(F.count("*").alias("rows"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    )


def category_facets(df: DataFrame, k: int = 5) -> DataFrame:
    """Per attack category: rows, majority label and the k commonest subcategories in order."""
    counts = df.groupBy("attack_category", "label", "attack_subcategory").agg(
        F.count("*").alias("n")
    )
    by_label = counts.groupBy("attack_category", "label").agg(F.sum("n").alias("n"))
    labels = by_label.groupBy("attack_category").agg(
        F.sum("n").alias("rows"),
        F.max_by("label", F.struct(F.col("n"), -F.col("label").cast("int"))).cast("int").alias("label"),
    )
    order = Window.partitionBy("attack_category").orderBy(F.desc("n"), "attack_subcategory")
    subs = (
        counts.groupBy("attack_category", "attack_subcategory").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .groupBy("attack_category")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "attack_subcategory"))).alias("s"))
        .select("attack_category", F.col("s.attack_subcategory").alias("top_subcategories"))
    )
    return labels.join(subs, "attack_category").select(
        "attack_category", "rows", "label", "top_subcategories"
    )


def ingest_summary(df: DataFrame, k: int = 20) -> DataFrame:
    """Per dataset: rows, files, label counts; one line per top-k attack category."""
    totals = df.groupBy("dataset_source", "source_file").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("label") == 0).alias("normal_rows"),
        F.count_if(F.col("label") == 1).alias("attack_rows"),
    ).groupBy("dataset_source").agg(
        F.sum("rows").alias("rows"), F.count("*").alias("files"),
        F.sum("normal_rows").alias("normal_rows"), F.sum("attack_rows").alias("attack_rows"),
    )
    top = top_per_group(df, "dataset_source", "attack_category", k).select(
        "dataset_source", "attack_category", F.col("rows").alias("category_rows"), "rank"
    )
    same = F.col("dataset_source").eqNullSafe(F.col("_source"))
    return totals.join(top.withColumnRenamed("dataset_source", "_source"), same).drop("_source")


# ------------------------------------------------------- filters and facets

FACETS = {
    "attack_categories": "attack_category",
    "attack_subcategories": "attack_subcategory",
    "dataset_sources": "dataset_source",
    "environment_types": "environment_type",
    "labels": "label",
}


def faceted_filter(df: DataFrame, **wanted) -> tuple[DataFrame, dict[str, list]]:
    """AND of optional IN-lists named as in FACETS; also returns what was applied, sorted."""
    unknown = set(wanted) - set(FACETS)
    if unknown:
        raise ValueError(f"unknown facet(s): {', '.join(sorted(unknown))}")
    applied = {}
    for facet, column in FACETS.items():
        values = wanted.get(facet)
        if values:
            applied[facet] = sorted(set(values))
            df = df.filter(F.col(column).isin(applied[facet]))
    return df, applied


def unknown_facet_values(df: DataFrame, **wanted) -> DataFrame:
    """(facet, name): requested values that the table does not hold."""
    asked = [(f, str(v)) for f in FACETS for v in sorted(set(wanted.get(f) or []), key=str)]
    spark = df.sparkSession
    requested = spark.createDataFrame(asked, "facet string, name string")
    columns = {FACETS[f]: f for f in FACETS if wanted.get(f)}
    if not columns:
        return requested
    names = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
    held = facet_counts(df, list(columns)).select(names[F.col("facet")].alias("facet"), "name")
    # Labels have a fixed domain, whatever the table holds.
    held = held.unionByName(
        spark.createDataFrame([("labels", "0"), ("labels", "1")], "facet string, name string")
    )
    return requested.join(held, ["facet", "name"], "left_anti")


def check_generation_request(rows: int, mode: str, minimum_per_category: int,
                             noise_scale: float, clip_quantile: float, interactive: bool = True) -> None:
    """Range checks of a generation request. Interactive ones have bounds; a batch job may ask for any number
    of rows, more noise and a wider clip, which is clamped, but for nothing below zero."""
    if not interactive:
        # What a batch job may exceed is checked at its lower end only.
        rows, noise_scale = (100 if rows >= 1 else rows), min(noise_scale, 0.5)
        minimum_per_category, clip_quantile = min(minimum_per_category, rows), min(clip_quantile, 0.1)
    problems = {
        "mode must be proportional, balanced or label_balanced":
            mode not in ("proportional", "balanced", "label_balanced"),
        "rows must be between 100 and 1,000,000": not 100 <= rows <= 1_000_000,
        "minimum_per_category must be between 0 and rows": not 0 <= minimum_per_category <= rows,
        "noise_scale must be between 0 and 0.5": not 0 <= noise_scale <= 0.5,
        "clip_quantile must be between 0 and 0.1": not 0 <= clip_quantile <= 0.1,
    }
    for message, broken in problems.items():
        if broken:
            raise ValueError(message)


def by_label_or_all(df: DataFrame, label: int) -> DataFrame:
    """Rows of one label, or the whole table when it has none."""
    chosen = df.filter(F.col("label") == label)
    return df if chosen.isEmpty() else chosen


# ----------------------------------------------------------- dedup, missing

def dedup(df: DataFrame) -> DataFrame:
    """Distinct rows; nulls equal each other.  Copies combine before the shuffle."""
    return df.dropDuplicates()


# Rows that are shuffled whole at a time.
PORTION_ROWS = 25_000_000


def dedup_portions(df: DataFrame) -> list[DataFrame]:
    """`dedup` as disjoint tables. Copies share a fingerprint, so each class of fingerprints is a table of its own;
    who runs one after the other holds the shuffle of one at a time. `df` is read once for each."""
    types = dict(df.dtypes)
    plain = all(is_numeric(t) or t in ("string", "boolean", "date", "timestamp", "binary") for t in types.values())
    n = -(-df.count() // PORTION_ROWS)
    if n <= 1 or not plain or not df.columns:
        return [dedup(df)]
    part = F.pmod(row_fingerprint(types, df.columns), F.lit(n))
    return [dedup(df.filter(part == i)) for i in range(n)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: total, distinct and surplus copies. Where few fingerprints repeat, only their rows move whole."""
    types = dict(df.dtypes)
    if df.columns and all(is_numeric(t) or t in ("string", "boolean", "date", "timestamp", "binary") for t in types.values()):
        marked = df.withColumn("_h", row_fingerprint(types, df.columns))
        seen = marked.groupBy("_h").agg(F.count("*").alias("_n"))
        repeated = seen.filter("_n > 1").select("_h")
        if repeated.count() <= MAX_SHARED_FINGERPRINTS:
            single = seen.agg(F.count_if(F.col("_n") == 1).alias("_single"))
            again = _copies(marked.join(broadcast_checked(repeated, MAX_SHARED_FINGERPRINTS), "_h", "left_semi"))
            return again.crossJoin(single).select(
                (F.col("rows") + F.col("_single")).alias("rows"),
                (F.col("distinct_rows") + F.col("_single")).alias("distinct_rows"), "duplicate_rows")
    return _copies(df)


def _copies(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def _stack(one_row: DataFrame, names: Sequence[str], key: str, value: str) -> DataFrame:
    """A one-row table of per-column results as (key, value) lines."""
    lines = F.array(*[
        F.struct(F.lit(n).alias(key), F.col(f"`{n}`").alias(value)) for n in names
    ])
    return one_row.select(F.inline(lines))


def missing_profile(df: DataFrame, top: int = 30) -> DataFrame:
    """(column, missing): columns with nulls, worst first."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (
        _stack(counts, df.columns, "column", "missing").filter("missing > 0")
        .orderBy(F.desc("missing"), "column").limit(top)
    )


def missing_cells(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.select(sum((F.col(c) for c in df.columns), F.lit(0)).alias("missing_cells"))


def feature_classes(df: DataFrame, leaky: Sequence[str] = META_COLUMNS,
                    categorical: Sequence[str] = STRING_FEATURES) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns by type; `categorical` names are forced."""
    types = {c: t for c, t in df.dtypes if c not in leaky}
    numeric = [c for c, t in types.items() if is_numeric(t) and c not in categorical]
    return numeric, [c for c in types if c not in numeric]


def empty_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without any value: one aggregate, one row back."""
    if not columns:
        return []
    row = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in columns]).first()
    return [c for c in columns if not row[c]]


def quality_report(before: DataFrame, after: DataFrame | Sequence[DataFrame]) -> DataFrame:
    """Long form (section, key, value) of the dataset quality document; `after` may come as disjoint tables."""
    parts = [after] if isinstance(after, DataFrame) else list(after)
    after, facets = parts[0], ["dataset_source", "label", "attack_category"]
    numeric, categorical = feature_classes(after, categorical=())
    n_before = before.agg(F.count("*").alias("value")).select(
        F.lit("rows").alias("section"), F.lit("before_dedup").alias("key"), "value")
    n_before = settle(n_before)
    # Each part is gone through once, down to a line per facet values; the lines below add these up.
    lines = [settle(part.groupBy(*[F.col(c).alias(f"_f_{c}") for c in facets]).agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in after.columns])) for part in parts]
    per = settle(reduce(DataFrame.unionByName, lines))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counted = settle(per.agg(total("rows").alias("rows"), *[total(f"_n_{c}").alias(c) for c in after.columns]))
    n_after = counted.select(
        F.lit("rows").alias("section"), F.lit("after_dedup").alias("key"), F.col("rows").alias("value"))
    missing = (
        _stack(counted, after.columns, "key", "value").filter("value > 0")
        .orderBy(F.desc("value"), "key").limit(30)
        .select(F.lit("missing").alias("section"), "key", "value")
    )
    facets = facet_counts(per.select("rows", *[F.col(f"_f_{c}").alias(c) for c in facets]), facets, "rows").select(
        F.col("facet").alias("section"), F.col("name").alias("key"), F.col("rows").alias("value"))
    shape = before.sparkSession.createDataFrame(
        [("columns", "all", len(after.columns)), ("columns", "numeric_features", len(numeric)),
         ("columns", "categorical_features", len(categorical))],
        "section string, key string, value long")
    rows = n_before.unionByName(n_after)
    removed = rows.agg(
        (F.max("value") - F.min("value")).alias("value")
    ).select(F.lit("rows").alias("section"), F.lit("duplicates_removed").alias("key"), "value")
    return rows.unionByName(removed).unionByName(shape).unionByName(facets).unionByName(missing)


# -------------------------------------------------- fill, profile, constraints

def unpivot_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep..., feature, value) without nulls; cells that are not finite count as missing."""
    lines = F.array(*[
        F.struct(F.lit(c).alias("feature"), finite(F.col(c).cast("double")).alias("value")) for c in columns
    ])
    return df.select(*keep, F.inline(lines)).filter(F.col("value").isNotNull())


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, low, high, n, rows): bounds and filled, finite cells of numeric columns in one aggregate."""
    wide = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns]).agg(F.count("*").alias("rows"), *[
        f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))])
    return wide.select("rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").cast("double").alias("low"),
                 F.col(f"hi_{c}").cast("double").alias("high"), F.col(f"n_{c}").alias("n")) for c in columns])))


def medians(df: DataFrame, columns: Sequence[str], only_missing: bool = False) -> dict[str, float]:
    """Exact median per column, 0.0 for empty ones; only_missing leaves out full columns."""
    if not columns:
        return {}
    ranges = settle(column_ranges(df, columns))
    if only_missing:
        ranges = settle(ranges.filter("n < rows"))
    listed = [r["feature"] for r in ranges.select("feature").collect()]
    if not listed:
        return {}
    rows = exact_quantiles(unpivot_numeric(df, listed), ["feature"], "value", [0.5],
                           settle(ranges.drop("rows"))).collect()
    found = {r["feature"]: r["quantile"] for r in rows}
    return {c: float(found.get(c, 0.0)) for c in listed}


def fill_missing(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Median for numbers, empty text for the rest."""
    middle = medians(df, numeric, only_missing=True)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c])) if c in middle else F.col(c).cast("double")
    return df.withColumns(
        {c: number(c) for c in numeric}
        | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in categorical}
    )


def numeric_profile(df: DataFrame, columns: Sequence[str], key: str = "attack_category",
                    quantile: float = 0.005) -> DataFrame:
    """(key, feature, std, low, high): sample deviation and clip bounds per group.

    quantile is clamped to [0, 0.1]; 0 means minimum and maximum. A null key is a group too; cells that are
    not finite count as missing.
    """
    q = min(max(float(quantile), 0.0), 0.1)
    # Joins by the key go through a text that nulls have as well.
    held = df.select(key, F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")).alias("_key"),
                     *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    spread = (
        held.groupBy(key, "_key")
        .agg(*[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
             *[F.min(c).alias(f"lo_{c}") for c in columns],
             *[F.max(c).alias(f"hi_{c}") for c in columns],
             *[F.count(c).alias(f"n_{c}") for c in columns])
        .select(key, "_key", F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"s_{c}").cast("double").alias("std"),
                     F.col(f"lo_{c}").cast("double").alias("low"),
                     F.col(f"hi_{c}").cast("double").alias("high"), F.col(f"n_{c}").alias("n"))
            for c in columns])))
        .filter("n > 0").fillna(0.0, ["std"])
    )
    if q == 0:
        return spread.drop("n", "_key")
    spread = settle(spread)
    bounds = (
        exact_quantiles(unpivot_numeric(held, columns, ["_key"]), ["_key", "feature"], "value", [q, 1 - q],
                        spread.select("_key", "feature", "low", "high", "n"))
        .groupBy("_key", "feature")
        .agg(F.min_by("quantile", "prob").alias("low"), F.max_by("quantile", "prob").alias("high"))
    )
    return spread.drop("low", "high", "n").join(broadcast_checked(bounds), ["_key", "feature"]).select(
        key, "feature", "std", "low", "high")


def constraint_violations(df: DataFrame) -> DataFrame:
    """(constraint, column, rows): negatives and ports out of range, non-zero only."""
    types = dict(df.dtypes)
    checks = {f"non_negative:{c}": F.col(c) < 0
              for c in NON_NEGATIVE if c in types and is_numeric(types[c])}
    checks |= {f"port_range:{c}": (F.col(c) < 0) | (F.col(c) > PORT_MAX)
               for c in PORT_COLUMNS if c in types}
    if not checks:
        return df.sparkSession.createDataFrame([], "constraint string, column string, rows long")
    counts = df.agg(*[F.count_if(rule).alias(name) for name, rule in checks.items()])
    return _stack(counts, list(checks), "check", "rows").filter("rows > 0").select(
        F.substring_index("check", ":", 1).alias("constraint"),
        F.substring_index("check", ":", -1).alias("column"), "rows")


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    """Same column names in the same order."""
    return a.columns == b.columns


# ----------------------------------------------------------- alignment

def align_to_columns(df: DataFrame, columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """Exactly these columns in this order, absent ones null."""
    types = types or {}
    return df.select(*[
        F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "double")).alias(c)
        for c in columns
    ])


def align_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                   keep: Sequence[str] = ()) -> DataFrame:
    """Any table in the shape a model expects: numbers parsed, absent or missing text empty."""
    types = dict(df.dtypes)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in types else F.lit("")
    number = lambda c: to_number(F.col(c), types[c]) if c in types else F.lit(None).cast("double")
    return df.select(*keep, *[number(c).alias(c) for c in numeric],
                     *[text(c).alias(c) for c in categorical])


# ----------------------------------------------------------- readiness

def parse_issues(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, invalid_values): filled text cells that are not numbers, non-zero only."""
    types = dict(df.dtypes)
    text = [c for c in columns if types.get(c) == "string"]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, invalid_values long")
    def invalid(c):
        cell = null_token(F.col(f"`{c}`"))
        return F.count_if((F.trim(cell) != "") & text_to_number(cell).isNull()).alias(c)
    counts = df.agg(*[invalid(c) for c in text])
    return _stack(counts, text, "column", "invalid_values").filter("invalid_values > 0")


def schema_coverage(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict:
    """Present, missing and ignored columns against a feature list; no data is read."""
    expected = [*numeric, *categorical]
    present = [c for c in expected if c in df.columns]
    return {
        "present": present,
        "missing": [c for c in expected if c not in df.columns],
        "ignored": [c for c in df.columns if c not in expected],
        "coverage": len(present) / len(expected) if expected else 0.0,
        "numeric_present": sum(c in numeric for c in present),
        "categorical_present": sum(c in categorical for c in present),
    }


def validation_summary(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One row: coverage, parse issues, readiness and recommendations."""
    seen = schema_coverage(df, numeric, categorical)
    types = dict(df.dtypes)
    text = [c for c in numeric if types.get(c) == "string"]
    def invalid(c):
        cell = null_token(F.col(f"`{c}`"))
        return F.count_if((F.trim(cell) != "") & text_to_number(cell).isNull())
    # A fold keeps the total inside one aggregate row.
    one = df.agg(F.count("*").alias("rows"),
                 sum((invalid(c) for c in text), F.lit(0).cast("long")).alias("parse_issues"))
    cov = F.lit(seen["coverage"])
    readiness = (
        F.when(F.col("rows") == 0, "not_ready")
        .when((cov >= 0.75) & (F.col("parse_issues") == 0), "ready")
        .when(cov >= 0.35, "review").otherwise("not_ready")
    )
    missing, ignored = len(seen["missing"]), len(seen["ignored"])
    notes = F.array_compact(F.array(
        F.lit(f"{missing} model features are missing") if missing else F.lit(None).cast("string"),
        F.lit(f"{ignored} extra columns are ignored") if ignored else F.lit(None).cast("string"),
        F.when(F.col("parse_issues") > 0,
               F.concat(F.col("parse_issues").cast("string"), F.lit(" numeric cells do not parse"))),
    ))
    return one.select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        cov.alias("feature_coverage"),
        F.lit(len(seen["present"])).alias("features_present"),
        F.lit(seen["numeric_present"]).alias("numeric_present"),
        F.lit(seen["categorical_present"]).alias("categorical_present"),
        F.lit(missing).alias("missing_feature_count"),
        F.lit(ignored).alias("ignored_column_count"),
        "parse_issues", readiness.alias("readiness"),
        F.when(F.size(notes) == 0, F.lit("structure is ready for scoring"))
        .otherwise(F.concat_ws("; ", notes)).alias("recommendations"),
    )


def preview(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """First five rows of up to eight columns, known features first."""
    seen = schema_coverage(df, numeric, categorical)
    columns = (seen["present"] + seen["ignored"])[:8] or df.columns
    return df.select(*[F.col(f"`{c}`") for c in columns]).limit(5)


# ----------------------------------------------------------- membership

def compare_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Shared columns that describe the row itself."""
    return [c for c in a.columns if c in b.columns and c not in LINEAGE_COLUMNS]


# Fingerprints that both tables hold are broadcast up to this many (8 bytes each).
MAX_SHARED_FINGERPRINTS = 2_000_000


def row_fingerprint(types: dict[str, str], columns: Sequence[str]) -> Column:
    """64 bits that equal rows share. 0.0 and -0.0 are equal cells but hash apart: add 0.0 first."""
    return F.xxhash64(*[F.col(f"`{c}`") + F.lit(0.0) if types[c] in ("double", "float") else F.col(f"`{c}`") for c in columns])


def _membership(synthetic: DataFrame, real: DataFrame, columns: Sequence[str], how: str,
                fingerprint=row_fingerprint) -> DataFrame:
    """Rows of equal fingerprint are compared cell by cell; a fingerprint that different rows share costs
    comparisons, not rows. Fingerprints meet first where few are synthetic or shared, so that only real rows of
    those move. Where many are shared both tables are dealt by fingerprint, once each and in portions."""
    cells = [F.col(f"s.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in columns]
    # One value of all cells: as keys of the join, they would be dealt and sorted by.
    same = (F.col("s._h") == F.col("r._h")) & (F.least(F.lit(1), *[cell.cast("int") for cell in cells]) == 1)
    marked = lambda df: df.withColumn("_h", fingerprint(dict(df.dtypes), columns))
    left, right = marked(synthetic), marked(real.select(*[F.col(f"`{c}`") for c in columns]))
    few = left.select("_h").distinct()
    if few.count() > MAX_SHARED_FINGERPRINTS:
        few = few.join(right.select("_h").distinct(), "_h", "left_semi")
        if few.count() > MAX_SHARED_FINGERPRINTS:
            n = -(-(left.count() + right.count()) // PORTION_ROWS)
            if n <= 1:
                return left.alias("s").join(right.alias("r"), same, how).drop("_h")
            # A class of fingerprints after the other: disk holds the shuffle of one.
            of = lambda df, i: df.filter(F.pmod("_h", F.lit(n)) == i)
            return reduce(DataFrame.unionByName, [
                stored(of(left, i).alias("s").join(of(right, i).alias("r"), same, how).drop("_h")) for i in range(n)])
    narrowed = right.join(broadcast_checked(few, MAX_SHARED_FINGERPRINTS), "_h", "left_semi")
    return left.alias("s").join(narrowed.dropDuplicates().alias("r"), same, how).drop("_h")


def exact_matches(synthetic: DataFrame, real: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of synthetic equal to some real row; fingerprints narrow, the cells decide."""
    columns = compare_columns(synthetic, real) if columns is None else columns
    if not columns:
        return synthetic.filter(F.lit(False))
    return _membership(synthetic, real, columns, "left_semi")


def novel_rows(synthetic: DataFrame, real: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of synthetic that equal no real row."""
    columns = compare_columns(synthetic, real) if columns is None else columns
    return _membership(synthetic, real, columns, "left_anti") if columns else synthetic


def exact_match_count(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    """One row: how many synthetic rows equal a real row."""
    return exact_matches(synthetic, real).agg(F.count("*").alias("exact_real_row_matches"))


def generation_quality(synthetic: DataFrame, real: DataFrame) -> DataFrame:
    """One row: schema match, missing cells, duplicates, exact matches and violations."""
    violations = constraint_violations(synthetic).agg(
        F.coalesce(F.sum(F.when(F.col("constraint") == "non_negative", F.col("rows"))), F.lit(0))
        .alias("non_negative_violations"),
        F.coalesce(F.sum(F.when(F.col("constraint") == "port_range", F.col("rows"))), F.lit(0))
        .alias("port_range_violations"),
    )
    parts = [missing_cells(synthetic), duplicate_rows(synthetic).select("rows", "duplicate_rows"),
             exact_match_count(synthetic, real), violations]
    out = synthetic.sparkSession.range(1).select(
        F.lit(same_schema(synthetic, real)).alias("schema_match"), F.lit(1).alias("_one"))
    for part in parts:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")
