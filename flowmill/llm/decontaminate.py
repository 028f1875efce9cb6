"""Benchmark decontamination: MinHash containment search by item size, then exact containment
(DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowmill.llm.common import computed, digest, words

# An item table beyond this many shingles is joined by shuffling, not broadcast.
MAX_BROADCAST_SHINGLES = 200_000


def _shingles(word_list: Column, width: int, make) -> Column:
    """make(list of `width` word columns) for each run of `width` words."""
    starts = F.sequence(F.lit(0), F.size(word_list) - width)
    runs = F.transform(starts, lambda i: make([F.get(word_list, i + k) for k in range(width)]))
    return F.when(F.size(word_list) >= width, runs)


def _hash(run: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(run)), *run)


def _text(run: list[Column]) -> Column:
    return F.concat_ws(" ", *run)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_SHINGLES else df


def find_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Pairs of a document and a benchmark item of whose distinct word shingles it holds `percent` %.

    Returns doc_id, item_id, n_shared, n_item. Words are lower-cased (A-Z); an item with fewer than
    `width` words is one shingle of all its words.

    The search side: items are partitioned by size. A document that holds `percent` % of an item's q
    shingles misses at most m = q - ceil(q * percent / 100), so it holds at least one of the item's
    m + 1 smallest hashes, its bottom MinHash signature: no match is lost. Each size class (powers of
    two) is searched by itself: a document sends it only hashes up to the largest of the class's signatures,
    and nothing when it has too few shingles to hold `percent` % of the class's smallest item. Few hashes
    pass for classes of long items; a class of items with up to four shingles has nearly any hash for its
    largest. The check: shingles of candidate documents are compared as texts, not hashes.

    Null or blank texts and items match nothing. Rows are judged one by one and reported by
    id: for rows of equal doc_id, or items of equal item_id, the largest count is given. Null ids are
    ids like any other. Only
    doc_id, text, item_id and text are read, so further columns cannot clash. Empty tables give none.
    """
    items = benchmark.select("item_id", digest(F.coalesce("text", F.lit(""))).alias("item"),
                             words(F.col("text")).alias("words")).where(F.size("words") > 0)
    item_words = computed(items.select("item", "words").dropDuplicates(["item"]), "words", F.col("words"))
    widths = sorted(r[0] for r in item_words.select(
        F.least(F.size("words"), F.lit(width)).alias("w")).distinct().collect())  # at most `width` values
    if not widths:
        none = F.lit(0).cast("long")
        return docs.select("doc_id").join(benchmark.select("item_id"), F.lit(False)).select(
            "doc_id", "item_id", none.alias("n_shared"), none.alias("n_item"))

    def runs(make, of_items: bool = False) -> Column:
        """Distinct shingles of a row: of each width for documents, of its own width for an item."""
        parts = [F.when(F.size("words") == w, _shingles(F.col("words"), w, make)) if of_items and w < width
                 else _shingles(F.col("words"), w, make) for w in widths]
        none = F.array().cast("array<string>" if make is _text else "array<bigint>")
        return F.array_distinct(F.concat(*[F.coalesce(p, none) for p in parts]))

    item_sets = item_words.select("item", runs(_text, True).alias("shingles"))
    hashed = item_words.select("item", F.array_sort(runs(_hash, True)).alias("hashes"))
    missing = F.size("hashes") - F.ceil(F.size("hashes") * percent / F.lit(100)).cast("int")
    n_hashes = F.size("hashes").cast("int")
    signatures = hashed.select("item", F.floor(F.log2(n_hashes)).cast("int").alias("size_class"), n_hashes.alias("n_hashes"),
                               F.explode(F.slice("hashes", F.lit(1), missing + 1)).alias("hash"))
    classes = signatures.groupBy("size_class").agg(  # one row a size class: at most 31
        F.max("hash").alias("top"), F.min("n_hashes").alias("least"), F.count("*").alias("n")).collect()
    n_signature = sum(r["n"] for r in classes)
    n_shingles = item_sets.agg(F.sum(F.size("shingles"))).first()[0]

    texts = docs.select("doc_id", digest(F.coalesce("text", F.lit(""))).alias("text_id"), "text")
    doc_words = computed(texts, "words", words(F.col("text"))).drop("text")
    doc_hashes = computed(doc_words, "hashes", runs(_hash)).drop("words")

    def probes(r) -> Column:
        """A document's hashes that a size class may hold; none when it is too short for the class."""
        small = F.filter("hashes", lambda h: h <= F.lit(r["top"]))
        enough = F.size("hashes") * 100 >= F.lit(r["least"] * percent)
        found = F.transform(small, lambda h: F.struct(F.lit(r["size_class"]).alias("size_class"), h.alias("hash")))
        return F.coalesce(F.when(enough, found), F.array().cast("array<struct<size_class:int,hash:bigint>>"))

    probed = doc_hashes.select("doc_id", "text_id", F.explode(F.concat(*[probes(r) for r in classes])).alias("probe"))
    candidates = (probed.select("doc_id", "text_id", "probe.size_class", "probe.hash")
                  .join(_small(signatures.select("size_class", "hash", "item"), n_signature), ["size_class", "hash"])
                  .groupBy(F.col("doc_id").alias("of_doc"), F.col("text_id").alias("of_text"))
                  .agg(F.collect_set("item").alias("items")))
    held = texts.join(candidates, F.col("doc_id").eqNullSafe(F.col("of_doc"))
                      & (F.col("text_id") == F.col("of_text"))).dropDuplicates(["doc_id", "text_id"])
    doc_shingles = computed(held, "words", words(F.col("text"))).select(
        "doc_id", "text_id", "items", F.explode_outer(runs(_text)).alias("shingle"))
    sized = item_sets.select("item", F.size("shingles").cast("long").alias("n_item"),
                             F.explode("shingles").alias("shingle"))
    found = (doc_shingles.join(_small(sized, n_shingles), "shingle").where(F.array_contains("items", F.col("item")))
             .groupBy("doc_id", "text_id", "item")
             .agg(F.count("*").alias("n_shared"), F.max("n_item").alias("n_item"))
             .where(F.col("n_shared") * 100 >= F.col("n_item") * percent))
    ids = _small(items.select("item_id", "item").distinct(), n_shingles)
    best = F.max(F.struct("n_shared", "n_item"))
    return (found.join(ids, "item").groupBy("doc_id", "item_id").agg(best.alias("best"))
            .select("doc_id", "item_id", "best.n_shared", "best.n_item"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that hold no benchmark item; columns as in `docs`. Rows without doc_id are
    dropped when any row without doc_id holds one."""
    found = find_contaminated(docs, benchmark, width, percent).select(F.col("doc_id").alias("leaked")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("leaked")), "left_anti")
