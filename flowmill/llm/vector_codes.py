"""Product codes of vectors: parts find their nearest codebook entry through memoised grid cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowmill.plans.small import broadcast_checked
from flowmill.session import cut_lineage

SCALE = 256
# Scaled components must stay below this, so that squared distances and their sums are exact.
MAX_COMPONENT = 1 << 27


@dataclass(frozen=True)
class Codebooks:
    """Entries as an array (parts, entries, width of a part)."""

    entries: np.ndarray

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


class Cells:
    """Nearest entries of one codebook. A grid cell of side 2**bits keeps the entries that could be nearest for some
    point of it: those whose least distance to the box is no more than the least greatest distance of any
    entry. Entries beyond are farther than another one from every point of the box, ties included."""

    def __init__(self, book: np.ndarray, bits: int, most: int):
        self.book, self.bits, self.most = book, bits, most
        self.weights = np.random.default_rng(1).integers(1, 1 << 62, book.shape[1], np.int64).astype(np.uint64) | np.uint64(1)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.corners = np.zeros((0, self.book.shape[1]), np.int64)
        self.masks = np.zeros((0, len(self.book)), bool)

    def undominated(self, corners: np.ndarray) -> np.ndarray:
        low = (corners << self.bits)[:, None, :]
        high = low + (1 << self.bits) - 1
        least = (np.maximum(np.maximum(low - self.book, self.book - high), 0) ** 2).sum(2)
        greatest = (np.maximum(np.abs(low - self.book), np.abs(high - self.book)) ** 2).sum(2)
        return least <= greatest.min(1, keepdims=True)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (lowest of ties) and squared distance of every point's nearest entry."""
        corners = points >> self.bits
        hashes = (corners.astype(np.uint64) * self.weights).sum(1, dtype=np.uint64)
        hashes ^= hashes >> np.uint64(29)
        different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        keys = different.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.slot]
        if len(self.slot) + len(new) > self.most:
            self.forget()
            new = list(range(len(keys)))
        if new:
            held = len(self.slot)
            self.slot.update((keys[i], held + k) for k, i in enumerate(new))
            fresh = corners[first[new]]
            self.corners = np.concatenate((self.corners, fresh))
            self.masks = np.concatenate((self.masks, self.undominated(fresh)))
        slots = np.fromiter((self.slot[h] for h in keys), np.int64, len(keys))[which]
        masks = self.masks[slots]
        masks[(self.corners[slots] != corners).any(1)] = True  # another cell with this hash: every entry is evaluated
        point, entry = np.nonzero(masks)
        distance = ((points[point] - self.book[entry]) ** 2).sum(1)
        begins = np.searchsorted(point, np.arange(len(points)))
        least = np.minimum.reduceat(distance, begins)
        hits = np.flatnonzero(distance == least[point])
        return entry[hits[np.searchsorted(point[hits], np.arange(len(points)))]], least


def usable(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows whose vector is there, as long as the longest, and finite in every component; and that length."""
    v = F.col(f"`{vector}`")
    longest = df.agg(F.max(F.size(v))).first()[0]
    width = max(longest or 0, 0)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & (F.size(v) == width) & (width > 0) & finite), width


def _points(column: pa.Array, parts: int) -> np.ndarray:
    """Integer components as (rows, parts, width of a part)."""
    if not len(column):
        return np.zeros((0, parts, 0), np.int64)
    flat = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    if np.abs(flat).max() >= MAX_COMPONENT:
        raise ValueError(f"vector components must be below {MAX_COMPONENT // SCALE} in size")
    return flat.astype(np.int64).reshape(len(column), parts, -1)


def _pieces(batches, most: int):
    for batch in batches:
        for at in range(0, len(batch), most):
            yield batch.slice(at, most)


def first_books(rows: DataFrame, parts: int, entries: int, key: str, vector: str) -> Codebooks:
    """The parts of the vectors with the smallest keys; nulls come last, ties go by the vector."""
    start = rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").alias("v"))
    held = start.orderBy(F.asc_nulls_last("k"), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    return Codebooks(np.ascontiguousarray(_points(held, parts).transpose(1, 0, 2)))


def refine(rows: DataFrame, books: Codebooks, vector: str, bits: int, most_cells: int, block: int) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts. A task sends one row of sums per part and entry."""
    parts, entries, width = books.entries.shape

    def run(batches):
        cells = [Cells(book, bits, most_cells) for book in books.entries]
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for piece in _pieces(batches, block):
            points = _points(piece.column("v"), parts)
            for p in range(parts):
                near = cells[p].nearest(points[:, p])[0] + p * entries
                np.add.at(sums, near, points[:, p])
                counts += np.bincount(near, minlength=parts * entries)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
            names=["slot", "n", "sums"])

    sent = rows.select(F.col(f"`{vector}`").alias("v")).mapInArrow(run, "slot long, n long, sums array<long>")
    totals = sent.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    entries_now = books.entries.reshape(-1, width).copy()
    for row in totals.collect():  # one row per part and entry
        entries_now[row.slot] = [row[f"s{i}"] // row.n for i in range(width)]
    return Codebooks(entries_now.reshape(books.entries.shape))


def assign(rows: DataFrame, books: Codebooks, key: str, label: str, vector: str, bits: int, most_cells: int,
           block: int) -> DataFrame:
    """key, label, `code` and `error` of every row."""
    parts, entries = books.entries.shape[:2]
    held = rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("l"), F.col(f"`{vector}`").alias("v"))
    schema = T.StructType([held.schema["k"], held.schema["l"], T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])

    def run(batches):
        cells = [Cells(book, bits, most_cells) for book in books.entries]
        for piece in _pieces(batches, block):
            points = _points(piece.column("v"), parts)
            codes, error = np.zeros((len(piece), parts), np.uint8), np.zeros(len(piece), np.int64)
            for p in range(parts):
                codes[:, p], distance = cells[p].nearest(points[:, p])
                error += distance
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [piece.column("k"), piece.column("l"),
                 pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)],
                names=schema.names)

    return held.mapInArrow(run, schema)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16,
             entries: int = 64, rounds: int = 2, bits: int = 5, most_cells: int = 8192,
             block: int = 4096) -> tuple[DataFrame, Codebooks]:
    """(key, code, error, label, label_error) of every usable vector, and the final codebooks.

    Components become floor(256 * x). Each part position has a codebook of up to 256 `entries`, begun with the vectors of
    the smallest keys and refined in `rounds` over all vectors. A part is compared only with the entries that its
    coarse grid cell keeps (`Cells`); a task remembers up to `most_cells` cells a part position and forgets them
    all when there are more, so memory is bounded and results are the same. Rounds read the table again and
    shuffle one row of sums per task, part and entry. The driver holds the codebooks only.

    Rows whose vector is null, empty, shorter than the longest or holds null or non-finite components go. Vectors whose length
    is no multiple of `parts`, or with components of 2**19 and more, are an error. Ties go to the lower
    entry. Null keys come last when codebooks are begun; repeated keys and rows each count and each keep
    their row. Null labels sum up together. Only the named columns are read. Fewer vectors than entries
    give shorter codebooks; an empty table gives an empty table and empty codebooks.
    """
    if entries > 256:
        raise ValueError("codes have two hex digits a part")
    rows, width = usable(df, vector)
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    books = first_books(rows, parts, entries, key, vector)
    if books.entries.shape[1]:
        for _ in range(rounds):
            books = refine(rows, books, vector, bits, most_cells, block)
    coded = cut_lineage(assign(rows, books, key, label, vector, bits, most_cells, block))
    totals = broadcast_checked(coded.groupBy(F.col("l").alias("total_of")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(totals, F.col("l").eqNullSafe(F.col("total_of")))
    return joined.select(F.col("k").alias(key), "code", "error", F.col("l").alias(label), "label_error"), books
