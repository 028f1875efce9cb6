"""Substring dedup of whole texts as bytes: distributed prefix doubling over shared strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from flowmill.llm.bpe import binary_array, pack_numbers, ragged, unpack_numbers

# Length of the first ranked prefixes; the rest of the threshold is where an anchor may lie.
ANCHOR = 24
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
NULL_ID = -2 ** 63
KEY_BITS = np.uint64(24)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * A
    x ^= x >> np.uint64(32)
    x *= B
    x ^= x >> np.uint64(29)
    return x


def _anchor_ranks(data: np.ndarray) -> np.ndarray:
    """A 64-bit rank of the ANCHOR bytes from each position, by doubling 1, 2, 4, 8, then 3 x 8."""
    v = data.astype(np.uint64)
    for step in (1, 2, 4):
        v = v[:-step] | (v[step:] << np.uint64(8 * step))
    v = _mix(v)
    return _mix(v[:-16] * A + (v[8:-8] ^ B) * C + v[16:])


def segments(data: np.ndarray, ends: np.ndarray, size: int, chunk: int = 1 << 17):
    """Runs of windows of `size` bytes with the same least anchor rank: (rank, first, last) arrays.

    Every window holds size - ANCHOR + 1 anchors and takes the least rank among them, so equal windows
    take equal ranks wherever they stand. `ends` holds the end of each document; none is crossed."""
    ranks, firsts, lasts = [], [], []
    span = size - ANCHOR + 1
    starts = np.concatenate(([0], ends[:-1]))
    for low, high in zip(starts, ends):
        n = int(high - low) - size + 1
        for at in range(0, max(n, 0), chunk):
            to = min(n, at + chunk)
            m = _anchor_ranks(data[low + at:low + to + size - 1])
            reach = 1
            while reach * 2 <= span:
                m = np.minimum(m[:-reach], m[reach:])
                reach *= 2
            if reach < span:
                m = np.minimum(m[:len(m) - (span - reach)], m[span - reach:])
            cut = np.flatnonzero(m[1:] != m[:-1]) + 1
            first = np.concatenate(([0], cut))
            ranks.append(m[first])
            firsts.append(first + (low + at))
            lasts.append(np.concatenate((cut, [len(m)])) - 1 + (low + at))
    if not ranks:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    return np.concatenate(ranks), np.concatenate(firsts), np.concatenate(lasts)


def _keys(ranks: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and short key of each rank: two strings may share a key, equal strings always do."""
    return (ranks % np.uint64(buckets)).astype(np.int64), (ranks >> KEY_BITS).astype(np.int64)


class _Block:
    def __init__(self, table: pa.Table):
        row = table.slice(0, 1)
        self.name = row.column("block")[0].as_py()
        sizes = np.array(row.column("sizes")[0].as_py(), np.int64)
        self.ids = np.array(row.column("ids")[0].as_py(), np.int64)
        self.ends = np.cumsum(sizes)
        total = int(self.ends[-1]) if len(sizes) else 0
        packed = row.column("texts")[0].as_py()
        self.bytes = pa.Codec("zstd").decompress(packed, total, asbytes=True) if total else b""
        self.data = np.frombuffer(self.bytes, np.uint8)

    def segments(self, size: int):
        ranks, first, last = segments(self.data, self.ends, size)
        return ranks, first, last, self.ids[np.searchsorted(self.ends, first, side="right")]


def _packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents as blocks of about `block_bytes` bytes, so that a pass over them moves few, compressed rows."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType())])

    def run(batches):
        base, done, codec = TaskContext.get().partitionId() << 33, 0, pa.Codec("zstd", 3)
        ids, texts, held = [], [], 0

        def block():
            return pa.RecordBatch.from_arrays([
                pa.array([base | done], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                pa.array([codec.compress(b"".join(texts), asbytes=True)], pa.binary())], names=schema.names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(NULL_ID if doc_id is None else doc_id)
                texts.append((text or "").encode())
                held += len(texts[-1])
                if held >= block_bytes:
                    yield block()
                    done, ids, texts, held = done + 1, [], [], 0
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _anchor_lists(size: int, buckets: int):
    def run(table):
        block = _Block(table)
        ranks, _, _, ids = block.segments(size)
        bucket, key = _keys(ranks, buckets)
        order = np.lexsort((ids, key, bucket))
        bucket, key, ids = bucket[order], key[order], ids[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(key)) - 1
        several = ids[last] != ids[at] if len(at) else np.zeros(0, bool)  # held by two documents of the block
        bucket, key = bucket[at], key[at]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        steps = np.diff(key, prepend=0)
        steps[edges[:-1][edges[:-1] < len(key)]] = key[edges[:-1][edges[:-1] < len(key)]]
        data, bounds = pack_numbers(steps * 2 + several, np.diff(edges))
        full = np.flatnonzero(np.diff(edges))
        return pa.Table.from_arrays([
            pa.array(full, pa.int32()), pa.array(np.full(len(full), block.name), pa.int64()),
            binary_array(data, bounds).take(pa.array(full))], names=["bucket", "block", "keys"])

    return run


def _unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    values, _ = unpack_numbers(np.frombuffer(data, np.uint8))
    return np.cumsum(values >> 1), (values & 1).astype(bool)


def _shared_masks(table: pa.Table) -> pa.Table:
    """For every block's list of a bucket: which keys another document holds as well."""
    lists = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
    key = np.concatenate([k for k, _ in lists])
    several = np.concatenate([f for _, f in lists])
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    several[order[1:]] |= same
    several[order[:-1]] |= same
    cuts = np.cumsum([0] + [len(k) for k, _ in lists])
    live = [i for i in range(len(lists)) if several[cuts[i]:cuts[i + 1]].any()]
    return pa.Table.from_arrays([
        table.column("block").take(pa.array(live, pa.int64())), table.column("bucket").take(pa.array(live, pa.int64())),
        pa.array([lists[i][0][several[cuts[i]:cuts[i + 1]]].astype("<i8").tobytes() for i in live], pa.binary())],
        names=["block", "bucket", "keys"])


def _shared_segments(size: int, buckets: int):
    """Segments whose anchor is shared, by bucket. Of equal segments in a block only those of the smallest
    doc_id go on; the others are spans to remove already."""
    def run(block_table, masks):
        codec = pa.Codec("zstd", 3)
        block = _Block(block_table)
        ranks, first, last, ids = block.segments(size)
        bucket, key = _keys(ranks, buckets)
        live = np.zeros(len(key), bool)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b, shared in zip(masks.column("bucket").to_pylist(), masks.column("keys").to_pylist()):
            part = order[edges[b]:edges[b + 1]]
            shared = np.frombuffer(shared, "<i8")
            found = np.searchsorted(shared, key[part])
            live[part] = shared[np.minimum(found, len(shared) - 1)] == key[part]
        at = np.flatnonzero(live)
        at = at[np.lexsort((first[at], ids[at], bucket[at]))]
        out = {n: [] for n in ("bucket", "block", "ids", "starts", "sizes", "bytes", "spans")}
        edges = np.searchsorted(bucket[at], np.arange(buckets + 1))
        done, text = [], block.bytes
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = at[edges[b]:edges[b + 1]]
            holder, keep, contents = {}, [], []
            for i, s, e, d in zip(part.tolist(), first[part].tolist(), (last[part] + size).tolist(), ids[part].tolist()):
                content = text[s:e]
                if holder.setdefault(content, d) == d:
                    keep.append(i)
                    contents.append(content)
                else:
                    done.append((s, e))
            keep = np.array(keep, np.int64)
            out["bucket"].append(b)
            out["block"].append(block.name)
            out["ids"].append(codec.compress(ids[keep].astype("<i8").tobytes(), asbytes=True))
            out["starts"].append(codec.compress(first[keep].astype("<u4").tobytes(), asbytes=True))
            out["sizes"].append((last[keep] + size - first[keep]).astype("<u4").tobytes())
            out["bytes"].append(codec.compress(b"".join(contents), asbytes=True))
            out["spans"].append(None)
        if done:
            out["bucket"].append(block.name % buckets)
            out["block"].append(block.name)
            for n in ("ids", "starts", "sizes", "bytes"):
                out[n].append(None)
            out["spans"].append(np.array(done, "<u4").tobytes())
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 5
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return run


def _window_ranks(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Equal numbers for equal windows: ranks of 8 bytes, then of rank pairs at growing offsets. A
    window whose prefix is unique is ranked no further (it keeps a number of its own)."""
    rank = np.zeros(len(data), np.int64)
    v = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    for step in (1, 2, 4):
        v = v[:-step] | (v[step:] << np.uint64(8 * step))
    rank = np.unique(v[:len(data)], return_inverse=True)[1]
    length = 8
    while length < size:
        offset = min(length, size - length)
        other = np.concatenate((rank[offset:], np.zeros(offset, np.int64)))
        rank = np.unique(rank * (int(rank.max()) + 1) + other, return_inverse=True)[1]
        length += offset
    return rank[at]


def _covered_spans(size: int):
    """Spans of each block that a smaller document holds as well, from all segments of a bucket."""
    def run(table):
        codec = pa.Codec("zstd")
        spans: dict[int, list] = {}
        rows = table.to_pylist()
        owner, ids, starts, sizes, texts = [], [], [], [], []
        for row in rows:
            if row["spans"] is not None:
                spans.setdefault(row["block"], []).append(np.frombuffer(row["spans"], "<u4").reshape(-1, 2))
                continue
            length = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
            n = len(length)
            ids.append(np.frombuffer(codec.decompress(row["ids"], 8 * n, asbytes=True), "<i8"))
            starts.append(np.frombuffer(codec.decompress(row["starts"], 4 * n, asbytes=True), "<u4").astype(np.int64))
            sizes.append(length)
            texts.append(codec.decompress(row["bytes"], int(length.sum()), asbytes=True))
            owner.append(np.full(n, row["block"], np.int64))
        if ids:
            owner, ids, starts, sizes = map(np.concatenate, (owner, ids, starts, sizes))
            text = b"".join(texts)
            ends = np.cumsum(sizes)
            order = np.argsort(ids, kind="stable")
            number: dict[bytes, int] = {}
            least, content, whole = [], np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
            for i, e, n, d in zip(order.tolist(), ends[order].tolist(), sizes[order].tolist(), ids[order].tolist()):
                c = number.setdefault(text[e - n:e], len(number))
                if c == len(least):
                    least.append(d)
                content[i], whole[i] = c, least[c] != d
            found = [(np.flatnonzero(whole), None)]
            # distinct segments: those that share an anchor with another one are compared window by window
            lengths = np.fromiter(map(len, number), np.int64, len(number))
            data = np.frombuffer(b"".join(number), np.uint8)
            begin = np.cumsum(lengths) - lengths
            anchors = _anchor_ranks(data)
            inside = np.minimum.reduceat(
                np.concatenate((anchors, np.full(len(data) - len(anchors), np.iinfo(np.uint64).max, np.uint64))),
                np.stack((begin, begin + lengths - ANCHOR + 1), 1).ravel().clip(max=len(data) - 1))[::2]
            values, group, times = np.unique(inside, return_inverse=True, return_counts=True)
            several = np.flatnonzero(times[group] > 1)
            if len(several):
                counts = lengths[several] - size + 1
                part = data[ragged(begin[several], lengths[several])]
                part_begin = np.cumsum(lengths[several]) - lengths[several]
                at = ragged(part_begin, counts)
                rank = _window_ranks(part, at, size)
                doc = np.repeat(np.array(least, np.int64)[several], counts)
                lowest = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
                np.minimum.at(lowest, rank, doc)
                hit = np.flatnonzero(lowest[rank] < doc)
                if len(hit):
                    which = np.repeat(np.arange(len(several)), counts)[hit]
                    offset = at[hit] - part_begin[which]
                    new = np.ones(len(hit), bool)
                    new[1:] = (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)
                    a = np.flatnonzero(new)
                    z = np.append(a[1:], len(hit)) - 1
                    runs: dict[int, list] = {}
                    for c, s, e in zip(several[which[a]].tolist(), offset[a].tolist(), (offset[z] + size).tolist()):
                        runs.setdefault(c, []).append((s, e))
                    for i in np.flatnonzero(~whole & np.isin(content, list(runs))).tolist():
                        for s, e in runs[int(content[i])]:
                            spans.setdefault(int(owner[i]), []).append(np.array([[starts[i] + s, starts[i] + e]], "<u4"))
            i = found[0][0]
            i = i[np.argsort(owner[i], kind="stable")]
            cuts = np.flatnonzero(np.diff(owner[i])) + 1
            for part in np.split(i, cuts):
                if len(part):
                    spans.setdefault(int(owner[part[0]]), []).append(
                        np.stack((starts[part], starts[part] + sizes[part]), 1).astype("<u4"))
        pack = [codec.compress(np.ascontiguousarray(np.concatenate(v)).tobytes(), asbytes=True) for v in spans.values()]
        return pa.Table.from_arrays([
            pa.array(list(spans), pa.int64()), pa.array([sum(map(len, v)) for v in spans.values()], pa.int64()),
            pa.array(pack, pa.binary())], names=["block", "n", "spans"])

    return run


def _remove(block_table: pa.Table, span_table: pa.Table) -> pa.Table:
    codec = pa.Codec("zstd")
    block = _Block(block_table)
    steps = np.zeros(len(block.data) + 1, np.int32)
    for n, packed in zip(span_table.column("n").to_pylist(), span_table.column("spans").to_pylist()):
        spans = np.frombuffer(codec.decompress(packed, 8 * n, asbytes=True), "<u4").reshape(-1, 2)
        np.add.at(steps, spans[:, 0], 1)
        np.add.at(steps, spans[:, 1], -1)
    gone = np.cumsum(steps[:-1]) > 0
    starts = np.concatenate(([0], block.ends[:-1])) if len(block.ends) else block.ends
    opened = gone.copy()
    opened[1:] &= ~gone[:-1]
    inner = starts[(starts < len(gone))]
    opened[inner] = gone[inner]  # a run does not continue into the next document
    upto = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    removed, runs = upto(gone), upto(opened)
    kept = block.data[~gone]
    bounds = np.concatenate(([0], block.ends - removed[block.ends])) if len(block.ends) else np.zeros(1, np.int64)
    return pa.Table.from_arrays([
        pa.array(block.ids, pa.int64(), mask=block.ids == NULL_ID), pa.array(block.ends - starts),
        pa.array(removed[block.ends] - removed[starts]), pa.array(runs[block.ends] - runs[starts]),
        binary_array(kept, bounds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, size: int = 50, block_bytes: int = 4 << 20, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and `kept` (the bytes left) of every document.

    A byte goes when a string of `size` bytes that covers it also starts in a document with a smaller
    doc_id. The strings of a suffix array's rank are found by prefix doubling in three rounds:

    1. Ranks of ANCHOR bytes. Of the anchors in a window only the least-ranked stands for it, about one
       in fourteen positions. Ranks are dealt to buckets; those that one document alone holds are unique
       and end there.
    2. The segments (runs of windows with the same anchor) that are left go to the bucket of their rank.
       Equal segments are decided by their smallest doc_id.
    3. Where different segments share an anchor, windows are compared by rank pairs at offsets 8, 16, 18
       up to `size`, on bytes, without hashes.

    Blocks of documents are shuffled once, compressed, and met by what comes back; a string of every
    document is one entry per block, since a block sends the segment of its smallest doc_id only.

    doc_id must be integral. Null texts are empty. Null doc_ids count as one document smaller than all.
    Rows of equal doc_id do not remove each other's bytes. Only doc_id and text are read. `size` must be
    at least ANCHOR + 1. An empty table gives an empty table.
    """
    if size <= ANCHOR:
        raise ValueError(f"size must be above {ANCHOR}")
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _packed(docs, block_bytes)
    lists = blocks.groupBy("block").applyInArrow(_anchor_lists(size, buckets), "bucket int, block long, keys binary")
    masks = lists.groupBy("bucket").applyInArrow(_shared_masks, "block long, bucket int, keys binary")
    found = blocks.groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(
        _shared_segments(size, buckets),
        "bucket int, block long, ids binary, starts binary, sizes binary, bytes binary, spans binary")
    spans = found.groupBy("bucket").applyInArrow(_covered_spans(size), "block long, n long, spans binary")
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
