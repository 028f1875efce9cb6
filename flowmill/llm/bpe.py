"""Byte-level BPE: each distinct word is encoded once, after a global shuffle by word."""

from __future__ import annotations

import base64
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

# Rank files beyond this size are refused: the table goes to every task.
MAX_VOCABULARY_BYTES = 64 << 20


@dataclass(frozen=True)
class Vocabulary:
    """The lines of a rank file (base64 token, rank) and the pattern that splits text before merging."""

    lines: bytes
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
        with open(path, "rb") as file:
            return cls(file.read(), pattern)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines())}

    def encoder(self):
        import tiktoken

        core = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})
        return core._core_bpe.encode_single_piece

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The token-byte table: all tokens' bytes in order of id, and where each begins."""
        ranks = self.ranks()
        parts = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            parts[rank] = token
        return (np.frombuffer(b"".join(parts), np.uint8),
                np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + size."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def pack_numbers(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of 7 bits, the last of each number below 128; bytes per group of `groups` numbers."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        sizes += values >= np.uint64(1 << bits)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, left = ends - sizes, sizes.copy()
    for k in range(int(sizes.max()) if len(sizes) else 0):
        live = left > k
        byte = (values[live] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[at[live] + k] = np.where(left[live] == k + 1, byte, byte | 128)
    bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(groups)))]
    return out, bounds


def unpack_numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of pack_numbers, and the index of each one's last byte."""
    last = np.flatnonzero(data < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    values = np.zeros(len(last), np.uint64)
    for k in range(int((last - first).max()) + 1 if len(last) else 0):
        live = first + k <= last
        values[live] |= (data[first[live] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return values.astype(np.int64), last


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [
        None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of binary values without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.cast(pa.binary()).buffers()
    bounds = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return values[bounds[0]:bounds[-1]], bounds - bounds[0]


def _pieces(lengths: np.ndarray, data: bytes) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[e - n:e] for e, n in zip(ends, lengths.tolist())]


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers below 2**32, first bytes first: the high bytes of small numbers are runs of zeros."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", 3).compress(planes.tobytes(), asbytes=True)


def _expand(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _exploded(docs: DataFrame, pattern: str, block_bytes: int) -> DataFrame:
    """Blocks of documents: their pre-tokens as word numbers by position, and the block's distinct words."""
    schema = ("block long, docs binary, n_codes long, codes binary, n_words long, lengths binary, "
              "n_bytes long, words binary")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import regex

        split = regex.compile(pattern).findall
        base, done, codec = TaskContext.get().partitionId() << 33, 0, pa.Codec("zstd", 3)

        def block(ids, counts, codes, number):
            head = pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64())], names=["doc_id", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            words = [w.encode() for w in number]
            codes = np.array(codes, np.int64)
            frequent = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            words = [words[i] for i in frequent.tolist()]  # frequent words get small numbers
            rank = np.empty(len(words), np.int64)
            rank[frequent] = np.arange(len(words))
            data = b"".join(words)
            row = [base | done, sink.getvalue().to_pybytes(), len(codes), _squeeze(rank[codes]),
                   len(words), _squeeze(np.fromiter(map(len, words), np.int64, len(words))),
                   len(data), codec.compress(data, asbytes=True)]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        ids, counts, codes, held, number = [], [], [], 0, {}
        for batch in batches:
            column, first = batch.column("doc_id"), 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = split(text) if text else []
                codes += [number.setdefault(w, len(number)) for w in found]
                counts.append(len(found))
                held += len(text or "")
                if held >= block_bytes:
                    ids.append(column.slice(first, i + 1 - first))
                    yield block(pa.concat_arrays(ids), counts, codes, number)
                    done, first = done + 1, i + 1
                    ids, counts, codes, held, number = [], [], [], 0, {}
            ids.append(column.slice(first))
        if counts:
            yield block(pa.concat_arrays(ids), counts, codes, number)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _block_words(row: dict) -> list[bytes]:
    return _pieces(_expand(row["lengths"], row["n_words"]),
                   pa.Codec("zstd").decompress(row["words"], row["n_bytes"], asbytes=True))


def _word_buckets(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers in order of bucket, and where each bucket begins."""
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def encode(docs: DataFrame, vocabulary: Vocabulary, block_bytes: int = 4 << 20, buckets: int | None = None) -> DataFrame:
    """doc_id and `ids` (little-endian unsigned 32-bit token ids) of every whole text.

    Every task splits its documents into pre-tokens and explodes them by position, in blocks of about
    `block_bytes` characters (a longer document is a block of its own): each position holds the number of its
    word among the block's distinct words. These words are shuffled to buckets by hash, so all blocks'
    copies of a word meet and each distinct word is encoded once in the whole job; a word of every
    document is one entry per block, not one per occurrence. Its ids go back to the blocks that hold
    it, and the ids of a block's positions are read off in order. The blocks themselves move once,
    compressed; nothing is held beyond a block or a bucket.

    Null and empty texts have no ids. Null and repeated doc_ids and repeated rows each keep their row.
    Only doc_id and text are read. An empty table gives an empty table.
    """
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _exploded(docs, vocabulary.pattern, block_bytes)
    codec_of = lambda: pa.Codec("zstd", 3)

    def deal(table):
        row = table.to_pylist()[0]
        words, codec = _block_words(row), codec_of()
        order, edges = _word_buckets(words, buckets)
        out = []
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = [words[i] for i in order[edges[b]:edges[b + 1]].tolist()]
            data = b"".join(part)
            out.append((b, row["block"], len(part), _squeeze(np.fromiter(map(len, part), np.int64, len(part))),
                        len(data), codec.compress(data, asbytes=True)))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        columns = list(zip(*out)) or [()] * 6
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                    names=["bucket", "block", "n_words", "lengths", "n_bytes", "words"])

    encoder: list = []  # made once a task

    def encode_words(table):
        if not encoder:
            encoder.append(vocabulary.encoder())
        merge, ids, number = encoder[0], [], {}
        out = []
        for row in table.to_pylist():
            known = []
            for word in _block_words(row):
                k = number.get(word)
                if k is None:
                    k = number[word] = len(ids)
                    ids.append(np.array(merge(word), np.uint32))
                known.append(ids[k])
            flat = np.concatenate(known)
            out.append((row["bucket"], row["block"], len(known),
                        _squeeze(np.fromiter(map(len, known), np.int64, len(known))), len(flat), _squeeze(flat)))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                                    names=["bucket", "block", "n_words", "lengths", "n_ids", "ids"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])

    def assemble(block_table, id_table):
        row = block_table.to_pylist()[0]
        head = pa.ipc.open_stream(row["docs"]).read_all()
        counts = head.column("n").to_numpy()
        words = _block_words(row)
        order, edges = _word_buckets(words, buckets)
        parts = sorted(id_table.to_pylist(), key=lambda r: r["bucket"])  # the order in which `deal` sent them
        lengths, flat = np.zeros(len(words), np.int64), [np.zeros(0, np.int64)]
        for part in parts:
            b = part["bucket"]
            lengths[order[edges[b]:edges[b + 1]]] = _expand(part["lengths"], part["n_words"])
            flat.append(_expand(part["ids"], part["n_ids"]))
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        codes = _expand(row["codes"], row["n_codes"])
        stream = np.concatenate(flat)[ragged(starts[codes], lengths[codes])]
        ends = np.concatenate(([0], np.cumsum(lengths[codes])))
        cuts = ends[np.concatenate(([0], np.cumsum(counts)))]
        doc_ids = pa.concat_arrays(head.column("doc_id").chunks)
        return pa.Table.from_arrays([doc_ids, binary_array(stream.astype("<u4").view(np.uint8), cuts * 4)],
                                    names=schema.names)

    dealt = blocks.groupBy("block").applyInArrow(
        deal, "bucket int, block long, n_words long, lengths binary, n_bytes long, words binary")
    known = dealt.groupBy("bucket").applyInArrow(
        encode_words, "bucket int, block long, n_words long, lengths binary, n_ids long, ids binary")
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(assemble, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, slice_bytes: int = 2 << 20) -> DataFrame:
    """`encoded` with `decoded`, the bytes of its ids: an equi-join of ids with the token-byte table.
    The table has one row an id, bounded by the vocabulary, so it is held by every task as an array
    and joined by index. Null ids give null bytes; an id outside the table is an error."""
    columns = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*[encoded.schema[c] for c in columns], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        data, bounds = vocabulary.token_bytes()
        sizes = np.diff(bounds)
        for batch in batches:
            ends = np.cumsum(np.concatenate(([0], pc.fill_null(pc.binary_length(batch.column("ids")), 0).to_numpy())))
            at = 0
            while at < len(batch):  # a bounded part of the rows at a time; at least one
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + slice_bytes)) - 1)
                part = batch.slice(at, to - at)
                at = to
                column = part.column("ids")
                flat, cuts = _flat(column.fill_null(b""))
                ids = flat.view("<u4").astype(np.int64)
                lengths = sizes[ids]
                decoded = binary_array(data[ragged(bounds[ids], lengths)],
                                       np.concatenate(([0], np.cumsum(lengths)))[cuts // 4])
                if column.null_count:
                    decoded = pc.if_else(column.is_valid(), decoded, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], decoded], names=schema.names)

    return encoded.select(*columns).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    both = decode(encode(docs, vocabulary), vocabulary)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
