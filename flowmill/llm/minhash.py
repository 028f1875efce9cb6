"""MinHash near-dedup: circulant signatures, bands, exact check of links, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowmill.llm.components import components
from flowmill.session import cut_lineage

# 32 bands of 4: two sets of similarity 0.8 share no band with a chance of 5e-8.
BANDS, BAND_ROWS = 32, 4
# Bits that hold the parities of a set's shingles.
PARITIES = 1024
MULTIPLIERS = np.random.default_rng(20_240_531).integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _finish(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers (in place)."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers (in place)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


class _WordHashes(dict):
    """64-bit hashes of words, each distinct one hashed once per task (emptied when it gets large)."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(text: str, width: int, known: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of `width` words (A-Z lower-cased); of all its
    words when it has fewer; none for a blank text."""
    found = text.encode().lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    words = np.fromiter([known[w] for w in found], np.uint64, n)
    reach = min(width, n)
    total = np.full(n - reach + 1, np.uint64(reach))
    for k in range(reach):
        total += words[k:n - reach + 1 + k] * MULTIPLIERS[k % 64]
        total ^= total >> np.uint64(32)
        total *= MULTIPLIERS[63 - k % 32]
    return np.unique(_finish(total))


def signatures(shingles: np.ndarray, cuts: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of many sets at once, `size` coordinates each: one permutation spreads the
    shingles over 32 bits, the second is applied after a circular shift by 1, 2, ... places."""
    spread = (_finish(shingles * MULTIPLIERS[7]) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(cuts) - 1, size), np.uint32)
    for low in range(0, len(cuts) - 1, 64):  # sets in runs that stay in the cache
        high = min(low + 64, len(cuts) - 1)
        part = spread[cuts[low]:cuts[high]]
        starts = cuts[low:high] - cuts[low]
        for k in range(size):
            out[low:high, k] = np.minimum.reduceat(_second(part - np.uint32(k + 1)), starts)
    return out


def _set_key(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes that stand for the set; null if empty) and band keys."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        known = _WordHashes()
        number = np.arange(BANDS, dtype=np.uint64) * MULTIPLIERS[40]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                sets = [shingle_hashes(t or "", width, known) for t in texts[at:at + 512]]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if full:
                    cuts = np.cumsum([0] + [len(sets[i]) for i in full])
                    signed = signatures(np.concatenate([sets[i] for i in full]), cuts, BANDS * BAND_ROWS)
                    rows = signed.reshape(len(full), BANDS, BAND_ROWS).astype(np.uint64)
                    keys = np.broadcast_to(number, (len(full), BANDS)).copy()
                    for k in range(BAND_ROWS):
                        keys = _finish(keys * MULTIPLIERS[41 + k] + rows[:, :, k])
                    for i, row in zip(full, keys.view(np.int64)):
                        bands[i] = row
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, 512), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def briefs(sets: DataFrame) -> DataFrame:
    """node and what tells two sets apart without their shingles: s0, s1, ... hold the last four bits of
    the signature's coordinates, p0, p1, ... whether odd or even counts of shingles fall on each of
    PARITIES places."""
    signed, parities = BANDS * BAND_ROWS // 16, PARITIES // 64
    names = [f"s{k}" for k in range(signed)] + [f"p{k}" for k in range(parities)]
    schema = T.StructType([sets.schema["node"], *[T.StructField(c, T.LongType()) for c in names]])

    def run(batches):
        places = np.arange(16, dtype=np.uint64) * np.uint64(4)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [np.array(x, np.int64).view(np.uint64) for x in part.column("shingles").to_pylist()]
                cuts = np.cumsum([0] + [len(x) for x in found])
                low = signatures(np.concatenate(found), cuts, BANDS * BAND_ROWS) & np.uint32(15)
                packed = (low.reshape(len(found), -1, 16).astype(np.uint64) << places).sum(2, dtype=np.uint64)
                odd = np.stack([np.packbits((np.bincount((_finish(x * MULTIPLIERS[9]) >> np.uint64(32)).astype(np.int64)
                                                         % PARITIES, minlength=PARITIES) & 1).astype(np.uint8))
                                for x in found]).view(np.int64)
                columns = [*packed.view(np.int64).T, *odd.T]
                yield pa.RecordBatch.from_arrays([part.column("node"), *[pa.array(c, pa.int64()) for c in columns]],
                                                 names=schema.names)

    return sets.select("node", "shingles").mapInArrow(run, schema)


def _least_difference(a: list, b: list):
    """A lower bound, never above the truth, of the shingles that only one of two sets has: places
    whose parities differ (columns of longs)."""
    total = F.lit(0)
    for x, y in zip(a, b):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def _agreeing(a: list, b: list):
    """Signature coordinates whose last four bits agree, of two packed signatures (columns of longs)."""
    total = F.lit(BANDS * BAND_ROWS)
    for x, y in zip(a, b):
        d = x.bitwiseXOR(y)
        for bits in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, bits))
        total = total - F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def least_agreeing(percent: int) -> int:
    """Agreeing coordinates that a pair of the similarity reaches but for a chance of one in a million
    (five standard deviations under its mean)."""
    n, p = BANDS * BAND_ROWS, percent / 100 + (1 - percent / 100) / 16
    return int(n * p - 5 * (n * p * (1 - p)) ** 0.5)


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the sets in `wanted` (node, set_key), made again from the texts."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("set_key", T.BinaryType()),
                           T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):
        known = _WordHashes()
        for batch in batches:
            for node, want, text in zip(*(batch.column(c).to_pylist() for c in ("node", "want", "text"))):
                shingles = shingle_hashes(text or "", width, known)
                if len(shingles) and _set_key(shingles) == want:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([node], pa.int64()), pa.array([want], pa.binary()),
                        pa.array([shingles.view(np.int64)], pa.list_(pa.int64()))], names=schema.names)

    nodes = wanted.select("node", F.col("set_key").alias("want"))
    held = docs.select("doc_id", "text").join(nodes, F.col("doc_id") == F.col("node")).select("node", "want", "text")
    return held.mapInArrow(run, schema).dropDuplicates(["node", "set_key"]).select("node", "shingles")


def _pairs(rows: DataFrame, x, x_n, y, y_n, percent: int) -> DataFrame:
    """Ordered distinct pairs (a, b) of two node columns whose set sizes allow the similarity."""
    possible = F.least(x_n, y_n) * 100 >= F.greatest(x_n, y_n) * percent
    return rows.where((x != y) & possible).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", both.alias("both"), (F.size("a_set") + F.size("b_set")).alias("sizes"))
            .where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "b"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document row.

    Documents are linked whose sets of word shingles have a Jaccard similarity of `percent` % or more;
    component_id is the smallest doc_id reachable over links, and kept marks the row that has it.

    1. Circulant MinHash signatures; equal sets become one class, so copies never make pairs.
    2. In every band bucket each class is paired with the bucket's head, the class that shares most places
       in buckets, which for near copies is the text they were copied from. The pairs are confirmed on
       full sets; links make components.
    3. Buckets that still hold several components: classes outside the bucket's largest component are
       held against the classes of other components. Pairs go that cannot be similar, as the parities of
       their shingles differ in more places than two such sets have shingles of their own, or whose
       signatures agree five standard deviations less than at the similarity; the others are confirmed.
       No likelier pair that shares a bucket is left untested unless both are linked already.

    Null and blank texts have an empty set, are linked with nothing and are kept. Rows without doc_id
    are linked with nothing; their component_id is null and they are kept. Rows of equal doc_id are
    one node: what one links to, the other does. Only doc_id and text are read. doc_id is an integer.
    """
    base = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = cut_lineage(sketch(base, width))
    known = sketches.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"),
                                           F.first("bands").alias("bands"))
    places = classes.select("node", "n", F.explode("bands").alias("band"))
    crowds = places.groupBy("band").agg(F.count("*").alias("crowd")).where(F.col("crowd") > 1)
    shared = cut_lineage(places.join(crowds, "band"))
    central = shared.groupBy("node").agg(F.sum("crowd").alias("central"))
    wanted = classes.select("node", "set_key").join(central.select("node"), "node", "left_semi")
    sets = cut_lineage(_full_sets(base, wanted, width))
    same_id = (known.select("doc_id", "set_key").distinct().join(classes.select("set_key", "node"), "set_key")
               .where(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    heads = (shared.join(central, "node").groupBy("band")
             .agg(F.max_by(F.struct("node", "n"), F.struct("central", F.xxhash64("node"))).alias("head")))
    tested = cut_lineage(_pairs(shared.join(heads, "band"), F.col("node"), F.col("n"), F.col("head.node"),
                                F.col("head.n"), percent))
    links = _confirm(tested, sets, percent).union(same_id)
    groups = components(links)
    placed = cut_lineage(shared.join(groups, "node", "left").select(
        *[shared[c] for c in shared.columns], F.coalesce("component", "node").alias("component")))
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
    largest = (sizes.groupBy("band").agg(F.count("*").alias("groups"), F.max(F.struct("size", "component")).alias("top"))
               .where(F.col("groups") > 1).select("band", F.col("top.component").alias("top")))
    mixed = placed.join(largest, "band")
    told = cut_lineage(briefs(sets.join(mixed.select("node"), "node", "left_semi")))
    signed, parities = ([c for c in told.columns if c[0] == kind] for kind in "sp")
    mixed = mixed.join(told, "node")
    outside = mixed.where(F.col("component") != F.col("top")).select(
        F.col("band").alias("x_band"), *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "component", *signed, *parities)])
    sides = lambda names: ([F.col(c) for c in names], [F.col(f"x_{c}") for c in names])
    apart = mixed.join(outside, (F.col("band") == F.col("x_band")) & (F.col("component") != F.col("x_component"))
                       & (_least_difference(*sides(parities)) * (100 + percent)
                          <= (F.col("n") + F.col("x_n")) * (100 - percent))
                       & (_agreeing(*sides(signed)) >= least_agreeing(percent)))
    more = _pairs(apart, F.col("node"), F.col("n"), F.col("x_node"), F.col("x_n"), percent)
    late = cut_lineage(_confirm(more.join(tested, ["a", "b"], "left_anti"), sets, percent))
    if not late.isEmpty():
        groups = components(groups.select(F.col("component").alias("a"), F.col("node").alias("b")).union(late))
    component = F.coalesce("component", "doc_id")
    return (sketches.join(groups, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id; columns as in `docs`. Of
    rows with equal doc_id one stays; all rows without doc_id stay."""
    gone = near_duplicates(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    named = left.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.unionByName(left.where(F.col("doc_id").isNull()))
