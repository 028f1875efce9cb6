"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowmill.session import cut_lineage

# Links of a part of a round's table.
PART_ROWS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); component is the least node reachable.

    Rounds of large stars and small stars: every node hands its larger neighbours, then its smaller
    ones, to the least of them, until nothing moves. Rounds grow with the logarithm of the longest
    chain. A round's links are checkpointed, in as many parts as their count asks for; only that count and
    a checksum reach the driver. A node with many links is one aggregate and one side of a join that
    adaptive execution may split.
    """
    both = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges = cut_lineage(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state, parts = now, 1 + now[0] // PART_ROWS
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        two = edges.coalesce(parts).select(F.inline(ways))
        least = two.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (two.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # The row of the least neighbour itself becomes the link to it.
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.distinct().coalesce(parts))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(centres)
