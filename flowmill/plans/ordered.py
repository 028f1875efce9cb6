"""Running totals, exact quantiles and ranks that never sort one group in one task.

All of them work on collapsed input (one row per key and value), are range-partitioned
over key *and* value so that a hot key spreads over many tasks, and carry a small
table of partition totals as offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.plans.small import broadcast_checked, column_max, settle
from flowmill.session import cut_lineage

_PART = "_part"
# Bin counts kept on the driver between rounds: numbers only, a few megabytes.
MAX_BIN_ROWS = 300_000


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    with_next: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Add `<c>_before` (sum over smaller values) and `<c>_total` (sum over the key) for
    every column in `sums`; with_next adds `next_<order>`, the following value.

    `df` must hold each (keys, order) once.  descending reverses the order.
    """
    keys = list(keys)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    # The partition number is materialised: range bounds come from sampling, so the
    # two uses below must read the same rows, also after a lost executor.
    ranged = cut_lineage(
        df.select(*keys, order, *sums)
        .repartitionByRange(*[F.col(k).asc() for k in keys], direction)
        .withColumn(_PART, F.spark_partition_id())
    )

    edge = F.max(order) if descending else F.min(order)
    totals = ranged.groupBy(*keys, _PART).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in sums], edge.alias("_first")
    )
    by_part = Window.partitionBy(*keys).orderBy(_PART)
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        _PART,
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(f"{c}_total") for c in sums],
        F.lead("_first").over(by_part).alias("_next_first"),
    )
    offsets = broadcast_checked(offsets)

    within = Window.partitionBy(*keys, _PART).orderBy(direction)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.select(
        "*",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_w_{c}") for c in sums],
        *([F.lead(order).over(within).alias("_next_in")] if with_next else []),
    ).join(offsets, [*keys, _PART])
    return joined.select(
        *keys,
        order,
        *sums,
        *[(F.col(f"_w_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in sums],
        *[f"{c}_total" for c in sums],
        *([F.coalesce("_next_in", "_next_first").alias(f"next_{order}")] if with_next else []),
    )


def value_ranges(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, low, high, n) of the non-null values per key."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], ranges: DataFrame | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per key: columns keys, prob, quantile.

    Selection instead of sorting.  Values are counted in 1,024 bins between each key's
    bounds; the bin holding a wanted rank gives new bounds, and only values inside small
    enough bins are ranked.  The table is scanned two or three times and what is shuffled
    are bin counts; built-in `percentile` would hold every distinct value of a group in one
    task.  `ranges` (keys, low, high, n) saves the first scan where it is already known.
    """
    keys = list(keys)
    known = settle(value_ranges(df, keys, value) if ranges is None else ranges)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    positions = known.filter("n > 0").select(*keys, F.col("low").cast("double").alias("low"),
                                             F.col("high").cast("double").alias("high"), "n",
                                             F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
    position = F.col("prob") * (F.col("n") - 1)
    ends = positions.select(
        *keys, "prob", (position - F.floor(position)).alias("frac"), "low", "high", "n",
        F.floor(position).cast("long").alias("low_rank"), F.ceil(position).cast("long").alias("high_rank"))
    wanted = ends.select(*keys, "low", "high", "n", F.explode(F.array("low_rank", "high_rank")).alias("rank")).distinct()
    # `at` is the rank inside the bounds, which narrow around it.
    open_ = settle(wanted.withColumn("at", F.col("rank")))
    ends = settle(ends.drop("low", "high", "n"))
    found = None
    for _ in range(_MAX_ROUNDS):
        done = open_.filter("low = high").select(*keys, "rank", F.col("low").alias("found"))
        found = done if found is None else found.unionByName(done)
        open_ = settle(open_.filter("low < high"))
        largest = column_max(open_, "n")
        if largest is None or largest <= MAX_RANKED_ROWS:
            break
        open_ = settle(_narrow(rows, open_, keys))
    if column_max(open_, "n") is not None:
        found = found.unionByName(_rank_inside(rows, open_, keys))
    found = settle(found)
    pick = lambda rank, name: found.select(*keys, F.col("rank").alias(rank), F.col("found").alias(name))
    return (
        ends.join(pick("low_rank", "_a"), [*keys, "low_rank"])
        .join(pick("high_rank", "_b"), [*keys, "high_rank"])
        .select(*keys, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("frac")).alias("quantile")))


_QUANTILE_BINS = 1024
_MAX_ROUNDS = 40


def _inside(rows: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows within each of their key's few bounds."""
    if keys:
        joined = rows.join(broadcast_checked(bounds), list(keys))
    else:
        joined = rows.join(broadcast_checked(bounds), F.lit(True))
    return joined.filter((F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high")))


def _narrow(rows: DataFrame, open_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the bounds of every open rank by those of the bin that holds it."""
    bounds = settle(open_.select(*keys, "low", "high").distinct())
    span = [*keys, "low", "high"]
    # Halves keep the difference finite for the widest doubles.
    share = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    binned = _inside(rows, bounds, keys).withColumn(
        "_bin", F.least(F.floor(share * _QUANTILE_BINS), F.lit(_QUANTILE_BINS - 1)))
    counts = binned.groupBy(*span, "_bin").agg(
        F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    upto = F.sum("_c").over(Window.partitionBy(*span).orderBy("_bin"))
    counts = settle(counts.select("*", upto.alias("_upto")), max_rows=MAX_BIN_ROWS)
    hit = open_.join(counts, span).filter(
        (F.col("at") < F.col("_upto")) & (F.col("at") >= F.col("_upto") - F.col("_c")))
    return hit.select(*keys, "rank", F.col("_lo").alias("low"), F.col("_hi").alias("high"), F.col("_c").alias("n"),
                      (F.col("at") - F.col("_upto") + F.col("_c")).alias("at"))


def _rank_inside(rows: DataFrame, open_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rank, found) by ranking the distinct values inside small bounds."""
    span = [*keys, "low", "high"]
    bounds = settle(open_.select(*span).distinct())
    counts = _inside(rows, bounds, keys).groupBy(*span, "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*span).orderBy("_v"))
    return (
        counts.withColumn("_upto", upto).join(broadcast_checked(open_), span)
        .filter((F.col("at") < F.col("_upto")) & (F.col("at") >= F.col("_upto") - F.col("_c")))
        .select(*keys, "rank", F.col("_v").alias("found")))


_SLICE_DIGITS = 3
_MAX_DIGITS = 30
MAX_RANKED_ROWS = 100_000


def hash_cuts(df: DataFrame, key: str, digest: str, wanted: DataFrame, digits: int = _MAX_DIGITS) -> DataFrame:
    """The digest at 0-based rank `k` of each key, as (key, cut, short).

    `digest` is a lower-case hex string, narrowed by up to `digits` digits; `wanted` holds (key, k).  Rows with digest < cut
    are the k smallest, `short` of them missing when rows with the cut's own digest
    (copies) straddle the rank; short is 0 where digests are unique.

    Only slice counts are shuffled: each round narrows a key to the 1/4096 of its digests
    holding rank k, until that slice is small enough to rank.  k at or beyond the key's
    size gives 'g', above every hex digit.
    """
    targets = settle(wanted.select(key, F.col("k").cast("long").alias("k"), F.lit("").alias("prefix")))
    depth = 0
    while True:
        depth += _SLICE_DIGITS
        counts = (
            df.select(key, F.substring(digest, 1, depth).alias("slice"))
            .withColumn("prefix", F.substring("slice", 1, depth - _SLICE_DIGITS))
            .join(broadcast_checked(targets).drop("n"), [key, "prefix"])
            .groupBy(key, "k", "slice")
            .agg(F.count("*").alias("n"))
        )
        found = settle(_rank_holder(counts, key, "slice").withColumnRenamed("slice", "prefix"))
        largest = column_max(found, "n")
        targets = found
        if largest is None or largest <= MAX_RANKED_ROWS or depth >= digits:
            break
    copies = (
        df.select(key, digest)
        .withColumn("prefix", F.substring(digest, 1, depth))
        .join(broadcast_checked(targets).drop("n"), [key, "prefix"])
        .groupBy(key, "k", digest)
        .agg(F.count("*").alias("n"))
    )
    cuts = _rank_holder(copies, key, digest).select(
        key, F.col(digest).alias("cut"), F.col("k").alias("short"))
    return wanted.select(key).join(cuts, key, "left").select(
        key, F.coalesce("cut", F.lit("g")).alias("cut"), F.coalesce("short", F.lit(0)).alias("short"))


def _rank_holder(counts: DataFrame, key: str, order: str) -> DataFrame:
    """The line of each key, in `order`, that holds rank k; k becomes the rank inside it."""
    seen = F.sum("n").over(Window.partitionBy(key).orderBy(order))
    return (
        counts.withColumn("_seen", seen)
        .filter((F.col("_seen") - F.col("n") <= F.col("k")) & (F.col("k") < F.col("_seen")))
        .select(key, (F.col("k") - F.col("_seen") + F.col("n")).alias("k"), order, "n")
    )


def rows_at(df: DataFrame, key: str, digest: str, sizes: DataFrame, wanted: DataFrame,
            rows_per_slice: int = 4_096) -> DataFrame:
    """`wanted` (key, idx, ...) with the row of `df` that has the 0-based rank idx by digest within key.

    Rows of one key and digest are equal.  `sizes` holds (key, n).  A directory holds how many rows lie in each
    digest slice of a key; only digests of slices that hold a wanted rank are sorted, and only rows of wanted
    digests move whole.  Ranks outside a key have no row.
    """
    slices = broadcast_checked(sizes.select(key, F.ceil(F.col("n") / rows_per_slice).alias("_slices")))
    share = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    narrow = df.select(key, digest).join(slices, key).select(
        key, digest, F.floor(share * F.col("_slices")).alias("_slice"))
    upto = F.sum("_n").over(Window.partitionBy(key).orderBy("_slice"))
    directory = narrow.groupBy(key, "_slice").agg(F.count("*").alias("_n")).select(
        key, "_slice", (upto - F.col("_n")).alias("_from"), upto.alias("_to"))
    # A slice is listed under each stretch of ranks it overlaps: an equal join finds it.
    stretch = lambda rank: F.floor(rank / rows_per_slice)
    listed = directory.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_from")), stretch(F.col("_to") - 1))))
    asked = wanted.select(key, "idx").distinct().withColumn("_stretch", stretch(F.col("idx")))
    inside = (F.col("idx") >= F.col("_from")) & (F.col("idx") < F.col("_to"))
    placed = settle(asked.join(broadcast_checked(listed), [key, "_stretch"]).filter(inside).select(
        key, "idx", "_slice", (F.col("idx") - F.col("_from")).alias("_rank")))
    opened = narrow.join(broadcast_checked(placed.select(key, "_slice").distinct()), [key, "_slice"], "left_semi")
    rank = F.row_number().over(Window.partitionBy(key, "_slice").orderBy(digest)) - 1
    found = settle(opened.withColumn("_rank", rank.cast("long")).join(placed, [key, "_slice", "_rank"]).select(
        key, "idx", digest))
    moved = df.join(broadcast_checked(found.select(key, digest).distinct()), [key, digest], "left_semi")
    return (wanted.join(found, [key, "idx"])
            .join(moved.dropDuplicates([key, digest]), [key, digest]).drop(digest))
