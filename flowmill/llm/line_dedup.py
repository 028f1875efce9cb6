"""Line dedup: lines that many documents share stay in one document only (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowmill.llm.common import digest, keep_row, lower_ascii, strip_spaces, unfold

# A shared line's occurrences meet its decision in so many partitions.
SALTS = 16


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Documents without the lines that at least `min_docs` documents hold.

    A line's key is the line stripped of white space, A-Z lower-cased; keys under `min_chars` code
    points always stay, and the document with the largest doc_id that holds a key keeps its lines.
    Returns the columns of `docs` with `text` rewritten, and n_lines (before dropping) and n_dropped.

    Lines are exploded and hashed; the documents of a hash are counted in two steps (distinct pairs,
    then hashes), so a line of every document is spread by document before it meets itself; the
    decisions on shared lines are repeated SALTS times, so its occurrences are many tasks. Only
    (document, position) pairs of dropped lines go back to the texts, which are shuffled once.

    Null texts count as one empty line. Rows without doc_id count as one document, smaller than
    any other. Rows with equal doc_id are the same document to the count; each keeps its own lines.
    An empty table gives an empty table. Columns named like the added ones are replaced.
    """
    source = (keep_row(docs)
              .withColumn("lines", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1))
              .withColumn("text_id", digest(F.coalesce(F.col("row.text"), F.lit(""))))
              .withColumn("id", F.col("row.doc_id")))
    lines = (source.select("id", "text_id", F.posexplode_outer("lines").alias("position", "line"))
             .where(F.length("line") >= min_chars)
             .select("id", "text_id", "position", strip_spaces(F.col("line")).alias("key"))
             .where(F.length("key") >= min_chars)
             .select("id", "text_id", "position", digest(lower_ascii(F.col("key"))).alias("hash")))
    shared = (lines.groupBy("hash", "id").agg(F.lit(1).alias("one"))
              .groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
              .where(F.col("n_docs") >= min_docs).select("hash", "keeper"))
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dropped = (lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
               .join(salted, ["hash", "salt"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
               .groupBy(F.col("id").alias("drop_id"), F.col("text_id").alias("drop_text"))
               .agg(F.collect_set("position").alias("positions")))
    joined = source.join(dropped, F.col("id").eqNullSafe(F.col("drop_id"))
                         & (F.col("text_id") == F.col("drop_text")), "left")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.array_except(every, F.col("positions"))
    text = F.when(F.col("positions").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    return unfold(joined, docs.columns, {
        "text": text, "n_lines": F.size("lines").cast("long"),
        "n_dropped": F.coalesce(F.size("positions"), F.lit(0)).cast("long")})
