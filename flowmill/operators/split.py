"""Exact seeded samples and stratified splits without sorting the table.

Rows are ordered by a digest of their content.  The cut that leaves exactly n rows below
it is found from slice counts, and the rows are then labelled by a plain comparison: the
table itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowmill.functions.hashing import row_digest
from flowmill.plans.ordered import hash_cuts
from flowmill.plans.small import broadcast_checked, column_max, settle
from flowmill.session import release, stored


# Copies of one row that are numbered by one task.
COPIES = 100_000
# Digits of a key's digest and a row's behind it that slices may go into.
KEYED_DIGITS = 46


def _digest(df: DataFrame, seed: int, key: Column | None) -> Column:
    """Digest of the row, or of a key column and then of the row; equal ones are copies."""
    if key is None:
        return row_digest(df.columns, seed)
    # Behind the key 64 bits of the row, nulls marked: they part rows that share a key.
    cells = [F.col(f"`{c}`") if "map<" not in kind else F.col(f"`{c}`").cast("string") for c, kind in df.dtypes]
    row = F.lpad(F.lower(F.hex(F.xxhash64(*cells, *[c.isNull() for c in cells]))), 16, "0")
    return F.concat(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), row)


def _numbered(copies: DataFrame) -> DataFrame:
    """The rows with `_ordinal`, 1 .. n among equal rows. Equal rows are collapsed to a count and made again in
    portions, so that no task sees all copies of a row."""
    counted = copies.groupBy(*copies.columns).agg(F.count("*").alias("_n"))
    portions = counted.withColumn("_from", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {COPIES}"))))
    first, last = F.col("_from") * COPIES + 1, F.least("_n", (F.col("_from") + 1) * COPIES)
    return portions.repartition("_from", "_h").withColumn("_ordinal", F.explode(F.sequence(first, last))).drop("_n", "_from")


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: Column | None = None) -> DataFrame:
    """All rows if there are at most n, else exactly n of them without replacement."""
    keyed = df.withColumn("_h", _digest(df, seed, key))
    narrow = keyed.select(F.lit(0).alias("_g"), "_h")
    wanted = df.sparkSession.createDataFrame([(0, n)], "_g int, k long")
    found = hash_cuts(narrow, "_g", "_h", wanted, KEYED_DIGITS if key is not None else 30).first()
    below = keyed.filter(F.col("_h") < found["cut"])
    if found["short"]:
        # Copies of one row straddle the cut; any of them will do.
        below = below.unionByName(keyed.filter(F.col("_h") == found["cut"]).limit(found["short"]))
    return below.drop("_h")


def stratum_key(counts: DataFrame, min_count: int) -> DataFrame:
    """(category, label, stratum) from (category, label, n): categories with fewer than
    min_count rows are pooled by label."""
    total = F.sum("n").over(Window.partitionBy("category"))
    return counts.select(
        "category", "label", "n",
        F.when(total < min_count, F.concat(F.lit("label_"), F.col("label").cast("string")))
        .otherwise(F.col("category")).alias("stratum"))


def quotas(strata: DataFrame, fraction: float) -> DataFrame:
    """(stratum, n, k): floor(fraction * rows) shared by stratum size, largest remainders
    rounded up, names break ties.  The windows run over one line per stratum."""
    everything = Window.partitionBy(F.lit(1))
    sizes = strata.groupBy("stratum").agg(F.sum("n").alias("n")).withColumn("_all", F.sum("n").over(everything))
    # Whole-number arithmetic: quotient and remainder of n * total / all.
    product = "cast(n as decimal(19,0)) * cast(_total as decimal(19,0))"
    divisor = "cast(_all as decimal(19,0))"
    parts = sizes.withColumn("_total", F.floor(F.lit(float(fraction)) * F.col("_all"))).select(
        "stratum", "n", "_total", F.expr(f"({product}) div {divisor}").alias("base"),
        F.expr(f"({product}) % {divisor}").alias("rest"))
    order = everything.orderBy(F.desc("rest"), "stratum")
    spare = F.col("_total") - F.sum("base").over(everything)
    return parts.select(
        "stratum", "n", (F.col("base") + (F.row_number().over(order) <= spare).cast("long")).alias("k"))


# Stands for a missing label where strata are counted and joined.
NO_LABEL = -1


def stratified_split(df: DataFrame, train: float = 0.70, val: float = 0.15, test: float = 0.15,
                     seed: int = 42, category: str = "attack_category", key: Column | None = None,
                     names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Add `split`: floor(train * n) rows of train, then the rest divided val : test.

    Each cut keeps stratum shares (rare categories are pooled by label, below 10 rows at
    the first cut and below 4 at the second).  Rows without label are a class of their own. Copies that straddle a
    cut are numbered, and as many go below it as are missing there.
    """
    if round(train + val + test, 6) != 1.0:
        raise ValueError("split sizes must sum to 1")
    keyed = df.withColumn("_h", _digest(df, seed, key)).withColumn(
        "_c", F.coalesce(F.col(category).cast("string"), F.lit("Unknown")))
    # Three narrow columns carry all the counting; the wide table is read once, at the end.
    held = stored(keyed.select(F.col("_c").alias("category"), F.coalesce(F.col("label").cast("int"), F.lit(NO_LABEL)).alias("label"),
                               F.unhex("_h").alias("_b")))
    narrow = held.select("category", "label", F.lower(F.hex("_b")).alias("_h"))

    def cuts(rows: DataFrame, min_count: int, fraction: float) -> DataFrame:
        """(category, label, cut) leaving floor(fraction * rows) rows below their cuts."""
        counts = settle(rows.groupBy("category", "label").agg(F.count("*").alias("n")))
        strata = stratum_key(counts, min_count)
        classes = settle(
            strata.select("category", "label", "stratum").join(
                quotas(strata, fraction).select("stratum", "k"), "stratum"))
        keyed_rows = rows.join(broadcast_checked(classes).drop("k"), ["category", "label"])
        found = hash_cuts(keyed_rows, "stratum", "_h", classes.select("stratum", "k").distinct(),
                          KEYED_DIGITS if key is not None else 30)
        return settle(classes.join(found, "stratum").select("category", "label", "cut", "short"))

    first = cuts(narrow, 10, train)
    placed = narrow.join(broadcast_checked(first), ["category", "label"])
    rest = placed.filter((F.col("_h") > F.col("cut")) | ((F.col("_h") == F.col("cut")) & (F.col("short") == 0)))
    copied = bool(column_max(first, "short"))
    if copied:
        tied = _numbered(placed.filter((F.col("_h") == F.col("cut")) & (F.col("short") > 0)))
        rest = rest.unionByName(tied.filter(F.col("_ordinal") > F.col("short")).drop("_ordinal"))
    second = cuts(rest.drop("cut", "short"), 4, val / (val + test))
    copied = copied or bool(column_max(second, "short"))
    release(held)  # the cuts are known
    name = lambda cut, to: broadcast_checked(cut).withColumnsRenamed(
        {"category": "_c", "label": "_y", "cut": f"_cut{to}", "short": f"_short{to}"})
    cut_rows = (
        keyed.withColumn("_y", F.coalesce(F.col("label").cast("int"), F.lit(NO_LABEL))).join(name(first, 1), ["_c", "_y"])
        .join(name(second, 2), ["_c", "_y"], "left").fillna(0, ["_short2"]))
    own = ["_c", "_y", "_h", "_cut1", "_cut2", "_short1", "_short2"]
    h, below = F.col("_h"), lambda n: F.col("_h") < F.col(f"_cut{n}")
    side = F.when(below(1), names[0]).when(below(2), names[1]).otherwise(names[2])
    if not copied:
        return cut_rows.withColumn("split", side).drop(*own)
    at = lambda n: (h == F.col(f"_cut{n}")) & (F.col(f"_short{n}") > 0)
    tie = F.coalesce(at(1), F.lit(False)) | F.coalesce(at(2), F.lit(False))
    # Of a row's copies those missing below the first cut come first, then those missing below the second.
    before = F.when(at(1), F.col("_short1")).otherwise(0)
    tied_side = (F.when(at(1) & (F.col("_ordinal") <= F.col("_short1")), names[0])
                 .when(below(2) | (at(2) & (F.col("_ordinal") <= before + F.col("_short2"))), names[1]).otherwise(names[2]))
    numbered = _numbered(cut_rows.filter(tie)).withColumn("split", tied_side).drop("_ordinal")
    return cut_rows.filter(~tie).withColumn("split", side).unionByName(numbered).drop(*own)


def split_counts(split: DataFrame) -> DataFrame:
    """(split, label, rows)."""
    return split.groupBy("split", F.col("label").cast("int").alias("label")).agg(F.count("*").alias("rows"))


def seeded_shuffle(df: DataFrame, seed: int = 42, key: Column | None = None) -> DataFrame:
    """Global order by digest: a range-partitioned sort, for callers that need an order."""
    return df.withColumn("_h", _digest(df, seed, key)).orderBy("_h").drop("_h")
